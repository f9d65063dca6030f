"""Small cases of the lineage operators: cycles, case, ambiguity, quoting, malformed input, empty input."""

import pytest
from pyspark.sql import functions as F

from lineagrid.functions import dax, mquery as mq
from lineagrid.functions.text import pieces
from lineagrid.operators import checks, diff, graph, report, source_map
from lineagrid.operators.binding import bind
from lineagrid.sources import files as fs
from lineagrid.sources import pbir, tmdl

PK = "project_id string, snapshot_id string"


def df(spark, rows, schema):
    return spark.createDataFrame([("p", "s", *r) for r in rows], f"{PK}, {schema}")


def got(frame, *cols):
    return sorted((tuple(r[c] for c in cols) for r in frame.collect()), key=repr)


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def test_closure_with_cycle_self_reference_and_diamond(spark):
    e = df(spark, [("a", "b"), ("b", "a"), ("b", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "source string, target string")
    seeds = df(spark, [("a",)], "seed string")
    assert got(graph.closure(e, seeds), "node", "depth") == [("b", 1), ("c", 1), ("d", 2)]
    assert got(graph.closure(e, seeds, "downstream"), "node", "depth") == [("b", 1)]
    m = {r.node: (r.depth, r.direction) for r in graph.depth_map(e, seeds).collect()}
    assert m["a"] == (0, "self") and m["b"] == (1, "downstream") and m["d"] == (2, "upstream")
    assert got(graph.chain_edges(e, seeds), "parent", "node", "is_cycle") == [("a", "b", False), ("a", "c", False), ("b", "a", True), ("b", "b", True), ("b", "d", False), ("c", "d", False)]
    assert graph.closure(e.limit(0), seeds).count() == 0
    stop = df(spark, [("b",)], "node string")
    assert got(graph.closure(e, seeds, stop=stop), "node") == [("b",), ("c",), ("d",)]


def test_projects_do_not_mix(spark):
    e = spark.createDataFrame([("p", "s", "a", "b"), ("q", "s", "b", "c")], f"{PK}, source string, target string")
    assert got(graph.closure(e, df(spark, [("a",)], "seed string")), "node") == [("b",)]


def test_binding_tiers(spark):
    objects = df(spark, [("measure", "T", "m"), ("measure", "U", "m"), ("column", "T", "c"), ("column", "U", "k"), ("measure", "U", "k"), ("measure", "V", "x"), ("measure", "W", "x")], "kind string, table_name string, name string")
    refs = df(spark, [("T", "o", "measure", "measure", None, "m"), ("T", "o", "measure", "measure", None, "c"), ("T", "o", "measure", "measure", None, "x"), ("T", "o", "measure", "column", "U", "k"), ("T", "m", "measure", "measure", None, "m"), ("T", "o", "measure", "measure", None, "M")], "table_name string, name string, owner_kind string, ref_kind string, ref_table string, ref_name string")
    assert got(bind(refs, objects), "source", "target") == [("measure::T.o", "column::T.c"), ("measure::T.o", "measure::T.m"), ("measure::T.o", "measure::U.k"), ("measure::T.o", "measure::V.x"), ("measure::T.o", "measure::W.x")]


def test_broken_references_ignore_case(spark):
    objects = df(spark, [("T", "Orders On Time %"), ("T", "c")], "table_name string, name string")
    refs = df(spark, [("T", "m", "measure", None, "orders on time %"), ("T", "m", "column", "X", "C"), ("T", "m", "column", "T", "gone"), ("T", "m", "table", "t", None), ("T", "m", "table", "Nowhere", None)], "table_name string, name string, ref_kind string, ref_table string, ref_name string")
    assert got(checks.broken_references(refs, objects, df(spark, [("T",)], "name string")), "item") == [("T[m] -> Nowhere",), ("T[m] -> T[gone]",)]


def test_dax_references(spark):
    text = """VAR t = SELECTCOLUMNS('My T', "new", [m1], "Known[X]", 1) /* 'No'[a] */ RETURN CALCULATE(SUM(T2[c]), FILTER(t, [new] > "x [no] 'T'[no]"), ALL(Dates)) // [z]"""
    refs = dax.references(spark.createDataFrame([("p", "s", "T", "m", text)], f"{PK}, table_name string, name string, expression string"))
    by = lambda k, c: {r[c] for r in refs.filter(F.col("ref_kind") == k).collect()}
    assert by("column", "ref_name") == {"c"} and by("measure", "ref_name") == {"m1"} and by("table", "ref_table") == {"My T", "T2", "Dates"}
    assert [tuple(x) for x in one(spark, "NAMEOF('A'[x]), NAMEOF([y]), nameof('a'[X])", dax.nameof_targets)] == [("A", "x"), (None, "y")]


def test_m_facts(spark):
    assert one(spark, 'a "x // y" // gone\n/* b */ c', mq.strip_comments).split() == ["a", '"x', "//", 'y"', "c"]
    s = one(spark, 'Sql.Databases("s") & Sql.Database("a", #"P") & OData.Feed("u") & Lakehouse.Contents(null)', mq.data_sources)
    assert [(x.type, x.server or x.url, x.database) for x in s] == [("SQL Server", "s", None), ("SQL Server", "a", "P"), ("OData", "u", None), ("Fabric Lakehouse", None, None)]
    assert pieces('a, "x, y", f(b, c), {d, [e]}') == ["a", '"x, y"', "f(b, c)", "{d, [e]}"] and pieces(None) == [] and pieces("a)b") == ["a"]
    assert one(spark, "SELECT * FROM [a].[b] JOIN c.d ON 1=1", mq.sql_select_list) == ["*"] and one(spark, "SELECT * FROM [a].[b] JOIN c.d ON 1=1", mq.sql_tables) == ["a.b", "c.d"]
    for text, want in [("if a then Table.Sort(x) else Table.PromoteHeaders(x)", True), ("Table.Sort(x)", False), ("Table.SelectColumns(x, {}, MissingField.UseNull)", True), ("Source{0}[Data]", True), ('Source{[Item="x"]}[Data]', False), ("Source[Data]", False)]:
        assert one(spark, text, mq.affects_names) is want


def test_derived_circle_stops(spark):
    smap = df(spark, [("A", "x", None, None, "unresolved", "unknown"), ("B", "x", None, None, "unresolved", "unknown"), ("C", "y", "y", "dbo.t.y", "source", "inferred"), ("D", "z", None, None, "unresolved", "unknown")], "model_table string, model_column string, source_column string, physical_path string, origin string, confidence string")
    links = df(spark, [("A", "x", "B", "x"), ("B", "x", "A", "x"), ("D", "z", "C", "y")], "model_table string, model_column string, from_table string, from_column string")
    assert got(source_map.link_derived(smap, links), "model_table", "physical_path", "confidence") == [("A", None, "unknown"), ("B", None, "unknown"), ("C", "dbo.t.y", "inferred"), ("D", "dbo.t.y", "inferred")]


def test_tmdl_quoting_and_blocks(spark):
    text = "table 'It''s'\n\n    /// note\n    measure 'a = b' = ```\n            VAR x = 1\n            RETURN x\n            ```\n        isHidden\n        formatString: 0\n\n    column Plain\n        dataType: int64\n        sourceColumn: 'src x'\n\n    refreshPolicy\n        sourceExpression =\n                let S = 2 in S\n\n    partition p = m\n        source = let S = 1 in S\n"
    rows = tmdl.rows(df(spark, [("t.tmdl", text), ("e.tmdl", ""), ("n.tmdl", None)], "path string, content string"))
    m = tmdl.measures(rows).first()
    assert (m.table_name, m.name, m.expression.split(), m.is_hidden, m.format_string) == ("It's", "a = b", ["VAR", "x", "=", "1", "RETURN", "x"], True, "0")
    assert got(tmdl.columns(rows), "name", "source_column", "is_calculated") == [("Plain", "src x", False)]
    assert tmdl.partitions(rows).first().m_body == "let S = 2 in S"


def test_report_json(spark):
    bad = df(spark, [("r/pages/pg/page.json", "{"), ("r/pages/q/page.json", '{"displayName": "Q"}')], "path string, content string")
    assert got(pbir.pages(bad), "page_id", "name", "width") == [("pg", "pg", 1280.0), ("q", "Q", 1280.0)]
    assert pbir.fields_of(None) == [] and pbir.bookmark_states(bad.select("project_id", "snapshot_id", "content")).count() == 0


def test_parameter_expansion_keeps_the_more_direct_route(spark):
    cols = "page_id string, visual_id string, kind string, table_name string, name string, via string"
    fields = df(spark, [("g", "v", "measure", "T", "a", "filter"), ("g", "v", "measure", "T", "b", "query")], cols)
    bound = df(spark, [("g", "v", "P")], "page_id string, visual_id string, parameter_table string")
    offers = df(spark, [("P", 0, "measure", "T", "A"), ("P", 1, "measure", "T", "b")], "parameter_table string, ordinal int, kind string, table_name string, name string")
    assert got(report.expand_parameters(fields, bound, offers), "name", "via") == [("A", "parameter"), ("b", "query")]


def test_visibility(spark):
    v = df(spark, [("g", "a", True, "grp"), ("g", "b", True, None), ("g", "c", True, None), ("g", "d", False, None)], "page_id string, visual_id string, is_hidden boolean, parent_group string")
    s = df(spark, [("k1", "g", "grp", "shown"), ("k1", "g", "b", "shown"), ("k2", "g", "a", "hidden"), ("k2", "g", "grp", "shown"), ("k1", "other", "c", "shown")], "bookmark_id string, page_id string, object_id string, state string")
    r = {x.visual_id: x for x in report.visibility(v, s).collect()}
    assert r["a"].revealed_by == ["k1"] and r["a"].hidden_by == ["k2"] and not r["b"].never_shown and r["c"].never_shown and not r["d"].never_shown


def test_diff(spark):
    b = spark.createDataFrame([("p", "k", "a  b"), ("p", "x", "1")], "project_id string, key string, v string")
    a = spark.createDataFrame([("p", "k", " a\nb "), ("p", "y", "2")], "project_id string, key string, v string")
    assert got(diff.keyed_diff(b, a, ["project_id", "key"], "v", "thing", normalise=True), "key", "type") == [("x", "thing_removed"), ("y", "thing_added")]
    assert diff.keyed_diff(b, b, ["project_id", "key"], "v", "thing").count() == 0
    assert diff.keyed_diff(b.limit(0), a, ["project_id", "key"], "v", "thing").count() == 2


def test_files(spark, tmp_path):
    for p in ("one/S.SemanticModel/definition/tables/T.tmdl", "one/.git/x.json", "two/a.abf", "two/R.Report/definition.pbir"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("table T\n")
    f = fs.read_projects(spark, str(tmp_path), "s9")
    assert got(f, "project_id", "snapshot_id", "path") == [("one", "s9", "S.SemanticModel/definition/tables/T.tmdl"), ("two", "s9", "R.Report/definition.pbir")]
    pairs = fs.report_pairs(df(spark, [("R.Report/definition.pbir", '{"datasetReference": {"byPath": {"path": "../M.SemanticModel"}}}'), ("Q.Report/definition.pbir", "{"), ("M.SemanticModel/x.tmdl", "")], "path string, content string"))
    assert got(pairs, "report_root", "model_root", "exists", "chosen") == [("R.Report", "M.SemanticModel", True, True)]


@pytest.mark.parametrize(("text", "want"), [('"a" meta [x]', True), ("12.5", True), ("let a = 1 in a", False), ("null", True)])
def test_parameter_like(spark, text, want):
    assert one(spark, text, diff.parameter_like) is want


def test_walks_have_no_depth_of_their_own(spark):
    """A chain of 70 measures is reached whole; one of 12 shared expressions is followed to its end, and a circle has none."""
    from lineagrid.operators import graph, source_map

    edges = spark.createDataFrame([("p", "s", f"m{i}", f"m{i + 1}", "measure_to_measure") for i in range(70)], "project_id string, snapshot_id string, source string, target string, type string")
    hit = graph.reached(edges, spark.createDataFrame([("p", "s", "m0")], "project_id string, snapshot_id string, node string"))
    assert {r.node: r.depth for r in hit.collect()} == {f"m{i}": i for i in range(71)}
    bodies = spark.createDataFrame([("p", "s", "T", "e0", "e0"), ("p", "s", "U", None, "own"), ("p", "s", "V", "c0", "c0")], "project_id string, snapshot_id string, table_name string, delegate string, body string")
    chain = [("p", "s", f"e{i}", f"e{i + 1}" if i < 11 else None, f"body{i}") for i in range(12)] + [("p", "s", "c0", "c1", "x"), ("p", "s", "c1", "c0", "y")]
    found = source_map.resolve_delegates(bodies, spark.createDataFrame(chain, "project_id string, snapshot_id string, name string, delegate string, body string"))
    assert {r.table_name: r.source_body for r in found.collect()} == {"T": "body11", "U": "own", "V": None}


def test_chain_edges_mark_cycles(spark):
    from lineagrid.operators import graph

    edges = spark.createDataFrame([("p", "s", a, b, "measure_to_measure") for a, b in ["ab", "ac", "bd", "cd", "de", "ed", "ff"]], "project_id string, snapshot_id string, source string, target string, type string")
    got = graph.chain_edges(edges, spark.createDataFrame([("p", "s", x) for x in "adf"], "project_id string, snapshot_id string, seed string")).collect()
    assert sorted((r.seed, r.parent + r.node, r.is_cycle) for r in got) == [("a", "ab", False), ("a", "ac", False), ("a", "bd", False), ("a", "cd", False), ("a", "de", False), ("a", "ed", True), ("d", "de", False), ("d", "ed", True), ("f", "ff", True)]


def test_steps_that_may_rename(spark):
    from lineagrid.functions import mquery

    texts = {
        "Table.LastN(X, 3)": False, "Table.RenameColumns(X, {})": False, "Table.PromoteHeaders(X)": True, "Table.AddIndexColumn(X, \"i\")": True, "X": False, '#"Some Step"': False,
        'if a = 1 then #"Filtered" else Base': False, "if a then Table.SelectRows(X, each true) else Table.Pivot(X)": True, "Table.TransformColumnTypes(X, {}, [MissingField = MissingField.UseNull])": True,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.x for r in df.select("t", mquery.affects_names(F.col("t")).alias("x")).collect()} == texts
