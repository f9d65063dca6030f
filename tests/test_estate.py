"""The job from files to source map and graph, and the graph walks, on small fixtures typed by hand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lineagrid.functions import mquery as mq
from lineagrid.functions.text import spans
from lineagrid.operators import estate, graph as g, graph_build as build, source_map as sm
from lineagrid.plans.jobs import graph_of_files

FILES = "project_id string, snapshot_id string, path string, content string"


def files(spark, contents, snapshot="s1"):
    return spark.createDataFrame([("p", snapshot, path, text) for path, text in contents.items()], FILES)


def table(name, columns, partition):
    head = "".join(f"\tcolumn {c}\n\t\tdataType: string\n\t\tsourceColumn: {s}\n\n" for c, s in columns)
    return f"table '{name}'\n\n{head}{partition}"


def m(name, *lines):
    return f"\tpartition '{name}' = m\n\t\tmode: import\n\t\tsource =\n" + "".join(f"\t\t\t\t{x}\n" for x in lines)


EXPRESSIONS = """expression Server = "srv-1" meta [IsParameterQuery=true, Type="Text"]

expression 'One' =
\t\tlet
\t\t  Source = Two,
\t\t  Renamed = Table.RenameColumns(Source, {{"far", "near"}})
\t\tin
\t\t  Renamed

expression Two =
\t\tlet
\t\t  Source = #"Three"
\t\tin
\t\t  Source

expression Three =
\t\tlet
\t\t  Source = Sql.Database(Server, "Lake"),
\t\t  Nav = Source{[Schema="dbo",Item="base"]}[Data]
\t\tin
\t\t  Nav

expression Ring =
\t\tlet
\t\t  Source = Back
\t\tin
\t\t  Source

expression Back =
\t\tlet
\t\t  Source = Ring
\t\tin
\t\t  Source
"""
#: A Direct Lake fact, imports through shared expressions, derived and calculated tables, a calculation group and a field parameter.
MODEL = {
    "M.SemanticModel/definition/expressions.tmdl": EXPRESSIONS,
    "M.SemanticModel/definition/tables/fact.tmdl": table("fact", [("k", "k"), ("amount", "amount"), ("qty", "qty")], "\tpartition fact = entity\n\t\tmode: directLake\n\t\tsource\n\t\t\tentityName: fact\n\t\t\tschemaName: dbo\n\t\t\texpressionSource: 'DirectLake - Lake'\n") + "\n\tmeasure Total = SUM(fact[amount])\n\n\tmeasure Share = DIVIDE([Total], [Total])\n",
    "M.SemanticModel/definition/tables/near.tmdl": table("near", [("near", "near"), ("kept", "kept")], m("near", "let", "  Source = One,", '  Sorted = Table.Sort(Source, {"near"}),', "  Fewer = Table.Skip(Sorted, 1)", "in", "  Fewer")),
    "M.SemanticModel/definition/tables/ring.tmdl": table("ring", [("r", "r")], m("ring", "let", "  Source = Ring", "in", "  Source")),
    "M.SemanticModel/definition/tables/copy.tmdl": table("copy", [("mine", "mine"), ("kept", "kept")], m("copy", "let", "  Source = near,", '  Renamed = Table.RenameColumns(Source, {{"near", "mine"}})', "in", "  Renamed")),
    "M.SemanticModel/definition/tables/again.tmdl": table("again", [("mine", "mine")], m("again", "let", "  Source = copy,", "  Odd = Table.PromoteHeaders(Source)", "in", "  Odd")),
    "M.SemanticModel/definition/tables/both.tmdl": table("both", [("kept", "near[kept]"), ("own", "[own]")], "\tpartition both = calculated\n\t\tmode: import\n\t\tsource = UNION(DISTINCT(near[kept]), DISTINCT(copy[kept]), DISTINCT(fact[k]), DISTINCT(ring[kept]))\n"),
    "M.SemanticModel/definition/tables/Time.tmdl": table("Time", [("Calc", "Name"), ("Order", "Ordinal")], "\tcalculationGroup\n\n\t\tcalculationItem YTD = CALCULATE(SELECTEDMEASURE())\n"),
    "M.SemanticModel/definition/tables/Pick.tmdl": table("Pick", [("Pick", "[Value1]"), ("Fields", "[Value2]"), ("Order", "[Value3]")], "\tpartition Pick = calculated\n\t\tmode: import\n\t\tsource = {(\"The total\", NAMEOF('fact'[Total]), 0), (\"Key\", NAMEOF('fact'[k]), 1)}\n"),
}


@pytest.fixture(scope="module")
def mapped(spark):
    out = estate.source_map(files(spark, MODEL))
    return out | {"rows": {(r.model_table, r.model_column): r for r in out["columns"].collect()}}


def test_source_map_from_files(mapped):
    said = {k: (r.physical_path, r.origin, r.confidence) for k, r in mapped["rows"].items()}
    base = "Lake.dbo.base"
    assert said == {
        ("fact", "k"): ("Lake.dbo.fact.k", "source", "exact"), ("fact", "amount"): ("Lake.dbo.fact.amount", "source", "exact"), ("fact", "qty"): ("Lake.dbo.fact.qty", "source", "exact"),
        # a rename three expressions away; Table.Sort and Table.Skip keep names
        ("near", "near"): (f"{base}.far", "source", "exact"), ("near", "kept"): (f"{base}.kept", "source", "exact"),
        ("ring", "r"): (None, "unresolved", "unknown"),
        ("copy", "mine"): (f"{base}.far", "source", "exact"), ("copy", "kept"): (f"{base}.kept", "source", "exact"),
        # headers may have changed on the way: the weakest link counts
        ("again", "mine"): (f"{base}.far", "source", "inferred"),
        ("both", "kept"): (f"{base}.kept", "source", "exact"), ("both", "own"): (None, "unresolved", "unknown"),
        **{x: (None, "model-defined", "exact") for x in [("Time", "Calc"), ("Time", "Order"), ("Pick", "Pick"), ("Pick", "Fields"), ("Pick", "Order")]},
    }
    assert mapped["rows"]["both", "kept"].also_from == [f"{base}.kept"]  # copy[kept]; fact[k] has another name, ring[kept] no source
    assert [r for k, r in mapped["rows"].items() if k != ("both", "kept") and r.also_from] == []


def test_projects_are_read_from_folders(spark, tmp_path):
    """Whole files, below any folder, of the kinds that are read."""
    from lineagrid.sources import files as fs

    for path, text in (MODEL | REPORT | {".git/x.json": "{}", "M.Report/readme.md": "no"}).items():
        at = tmp_path / "root" / "p" / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    got = fs.read_projects(spark, str(tmp_path / "root"), "s1")
    assert {(r.project_id, r.snapshot_id, r.path): r.content for r in got.collect()} == {("p", "s1", path): text for path, text in (MODEL | REPORT).items()}


def test_coverage_does_not_count_machinery(mapped):
    (r,) = estate.coverage(mapped["columns"]).collect()
    assert (r.total, r.model_defined, r.unresolved, r.sourced, r.inferred, r.coverage) == (16, 5, 2, 9, 1, 0.818)


def test_spliced_steps(mapped):
    rows = estate.ordered_steps(mapped["steps"]).filter("kind = 'table'").orderBy("owner", "step_no").collect()
    by = {}
    for r in rows:
        by.setdefault(r.owner, []).append((r.name, r.via))
    assert by["near"] == [("Source", "Three"), ("Nav", "Three"), ("Renamed", "One"), ("Sorted", None), ("Fewer", None)]
    assert by["ring"] == [("Source", "Back")]  # the circle's last name stays
    assert by["copy"] == [("Source", None), ("Renamed", None)]


def test_snapshots_do_not_mix(spark):
    after = dict(MODEL) | {"M.SemanticModel/definition/expressions.tmdl": EXPRESSIONS.replace('"far", "near"', '"other", "near"')}
    both = files(spark, MODEL).unionByName(files(spark, after, "s2"))
    got = {r.snapshot_id: r.physical_path for r in estate.source_map(both)["columns"].filter("model_table = 'again'").collect()}
    assert got == {"s1": "Lake.dbo.base.far", "s2": "Lake.dbo.base.other"}


def test_circles_of_derived_columns_stay_unresolved(spark):
    key = "project_id string, snapshot_id string, model_table string, model_column string, source_column string, physical_path string, origin string, confidence string"
    state = spark.createDataFrame([("p", "s", "A", "x", None, None, "unresolved", "unknown"), ("p", "s", "B", "x", None, None, "unresolved", "unknown"), *(("p", "s", f"T{i}", "x", None, None, "unresolved", "unknown") for i in range(1, 30)), ("p", "s", "T0", "x", "x", "db.x", "source", "exact")], key)
    links = spark.createDataFrame([("p", "s", "A", "x", "B", "x", 0), ("p", "s", "B", "x", "A", "x", 0), *(("p", "s", f"T{i}", "x", f"T{i - 1}", "x", int(i == 15)) for i in range(1, 30))], "project_id string, snapshot_id string, model_table string, model_column string, from_table string, from_column string, hop int")
    got = {r.model_table: (r.physical_path, r.confidence) for r in sm.link_derived(state, links).collect()}
    assert got["A"] == got["B"] == (None, "unknown")
    assert got["T14"] == ("db.x", "exact") and got["T29"] == ("db.x", "inferred")  # a chain longer than ten, weaker from its fifteenth link on


REPORT = {
    "M.Report/definition/pages/p1/page.json": '{"name": "p1", "displayName": "First"}',
    "M.Report/definition/pages/p1/visuals/v1/visual.json": '{"name": "v1", "visual": {"visualType": "card", "prototypeQuery": {"Select": [{"Measure": {"Expression": {"SourceRef": {"Entity": "fact"}}, "Property": "Share"}}]}}}',
    "M.Report/definition/pages/p1/visuals/v2/visual.json": '{"name": "v2", "visual": {"visualType": "card", "prototypeQuery": {"Select": [{"Column": {"Expression": {"SourceRef": {"Entity": "Pick"}}, "Property": "Pick"}}]}}}',
}


def test_routes_of_a_change(spark):
    gold, edges = graph_of_files(files(spark, MODEL | REPORT))
    moves = [("m", "measure_to_measure", "m"), ("m", "visual_to_field", "v"), ("m", "field_param_to_field", "p"), ("p", "visual_to_field", "w")]
    seed = spark.createDataFrame([("p", "s1", "measure::fact.Total"), ("p", "s1", "measure::fact.Share")], "project_id string, snapshot_id string, seed string")
    got = {(r.seed[14:], r.node, r.state, r.depth) for r in g.routes(edges, seed, moves).collect() if r.state in "vw"}
    assert got == {("Total", "visual::p1/v1", "v", 2), ("Total", "visual::p1/v2", "w", 2), ("Share", "visual::p1/v1", "v", 1)}
    assert {(r.parameter, r.target, r.display_name) for r in build.display_names(gold).collect()} >= {("table::Pick", "measure::fact.Total", "The total"), ("table::Pick", "column::fact.k", "Key")}
    kinds = {(r.source, r.target, r.type) for r in edges.collect()}
    assert ("table::Pick", "column::fact.k", "field_param_to_field") in kinds and ("visual::p1/v2", "table::Pick", "visual_to_field") in kinds and ("expression::Three", "source::srv-1/Lake", "expression_to_source") in kinds
    assert ("table::near", "expression::One", "table_to_expression") in kinds


def _edges(spark, pairs):
    return spark.createDataFrame([("p", "s", a, b) for a, b in pairs], "project_id string, snapshot_id string, source string, target string")


def _seeds(spark, *names):
    return spark.createDataFrame([("p", "s", x) for x in names], "project_id string, snapshot_id string, seed string")


def test_only_the_closing_edge_of_a_circle_is_marked(spark):
    chain = {(r.seed, r.parent, r.node): r.is_cycle for r in g.chain_edges(_edges(spark, [("a", "b"), ("b", "a"), ("b", "x"), ("x", "y")]), _seeds(spark, "a", "b")).collect()}
    assert chain == {("a", "a", "b"): False, ("a", "b", "a"): True, ("a", "b", "x"): False, ("a", "x", "y"): False, ("b", "b", "a"): False, ("b", "a", "b"): True, ("b", "b", "x"): False, ("b", "x", "y"): False}
    pairs = [("s", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "c"), ("s", "e"), ("e", "e"), ("q", "d")]
    marked = lambda seed: {(r.parent, r.node) for r in g.chain_edges(_edges(spark, pairs), _seeds(spark, seed)).collect() if r.is_cycle}
    assert marked("s") == {("d", "b"), ("d", "c"), ("e", "e")}
    assert marked("q") == {("b", "c"), ("c", "d")} or marked("q") == {("c", "d")}  # entered at d: d-b-c-d closes at d, and d-c is met with c on the path or done


def test_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("z", "a"), ("g", "h")]
    got = {r.node: r.component for r in g.components(_edges(spark, pairs)).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "d": "e", "e": "e"}
    assert g.components(_edges(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_navigation_by_position(spark):
    texts = {
        "three": 'S{[Name="proj"]}[Data]{[Name="ds"]}[Data]{[Name="tbl"]}[Data]', "two": 'S{[Name="ds"]}[Data]{[Name="tbl"]}[Data]', "four": 'S{[Name="x"]}[Data]{[Name="p"]}[Data]{[Name="d"]}[Data]{[Name="t"]}[Data]',
        "native": 'S{[Name="billing"]}[Data], Q = Value.NativeQuery(S, "SELECT 1")', "tagged": 'S{[Name="proj"]}[Data]{[Name="ds",Kind="Schema"]}[Data]{[Name="v",Kind="View"]}[Data]',
        "parameter": 'S{[Name=_Project]}[Data]{[Name=#"Data Set"]}[Data]{[Name="t"]}[Data]', "stated": 'S{[Schema="a",Item="b"]}[Data]{[Schema="c",Item="d"]}[Data]{[Name="n"]}[Data]', "none": "S", "column": 'S{[Name="x"]}[Other]',
    }
    df = spark.createDataFrame(list(texts.items()), "k string, m string").withColumn("values", F.expr("map('_Project', 'real', 'Other', 'x')"))
    got = {r.k: tuple(r.n) for r in df.select("k", mq.navigation(F.col("m"), F.col("values")).alias("n")).collect()}
    assert got == {
        "three": (None, "tbl", "ds", "proj"), "two": (None, "tbl", "ds", None), "four": (None, "t", "d", "p"), "native": (None, None, None, "billing"), "tagged": ("ds", "v", None, "proj"),
        "parameter": (None, "t", "Data Set", "real"), "stated": ("c", "d", None, None), "none": (None, None, None, None), "column": (None, None, None, None),
    }


def test_step_kinds_and_names(spark):
    kinds = {
        "Table.SelectColumns(A, {})": "Projection", "Table.ReorderColumns(A, {})": "Projection", "Table.RemoveColumns(A, {})": "Projection", "Table.RenameColumns(A, {})": "Rename", "Table.SelectRows(A, each true)": "Filter", "Table.NestedJoin(A)": "Join", "Table.Combine({A})": "Join",
        "Table.AddColumn(A)": "AddColumn", "Table.TransformColumnTypes(A)": "TypeChange", "Table.ExpandTableColumn(A)": "Expand", "Table.Distinct(A)": "Custom", "Table.Skip(A, 1)": "Custom", "Table.FirstN(A, 1)": "Custom", "Table.Join(A)": "Custom", "Table.AddIndexColumn(A)": "Custom",
        "Table.SelectRowsWithErrors(A)": "Custom", 'Sql.Database("a")': "Source", "sql.databases()": "Source", "Value.NativeQuery(A)": "Source", '#"a-b"{[Name="x"]}[Data]': "Navigation", "A[col]": "Navigation", "A": "Custom", "1": "Custom",
    }
    df = spark.createDataFrame([(k,) for k in kinds], "e string")
    assert {r.e: r.k for r in df.select("e", mq.step_kind(F.col("e")).alias("k")).collect()} == kinds
    refs = spark.createDataFrame([("Table.Combine({A, #\"B c\"}, \"B c\")",), ("each [A] + x.A",), ("A",), ("f(B.A, A )",)], "e string")
    names = F.array(*map(F.lit, ["A", "B c"]))
    assert [r.x for r in refs.select(mq.step_references(F.col("e"), names).alias("x")).collect()] == [["A"], [], ["A"], ["A"]]


def test_calls_in_one_pass():
    import re
    import time

    opener = re.compile(r"\b(?:f|g)\s*\(", re.I)
    assert spans('f(a, g(b), "f(no)", {[x]}) + F(")") + f(open', opener) == ['a, g(b), "f(no)", {[x]}', "b", '")"']
    began = time.time()
    assert len(spans("f(" * 20_000 + ")" * 20_000 + " f(x)" * 20_000, opener)) == 40_000
    assert time.time() - began < 20


def test_documents_are_files_in_order(spark, tmp_path):
    """One file a project; the lines stand in the order of section, part and position, however they come."""
    from lineagrid.sources import export

    both = files(spark, MODEL | REPORT).unionByName(files(spark, MODEL | REPORT, "s2"))
    _, edges = graph_of_files(both)
    lines = export.documents(estate.source_map(both), edges).repartition(7, F.rand(1))
    export.write_documents(lines, str(tmp_path / "docs"))
    text = export.read_document(spark, str(tmp_path / "docs"), "s1", "p")
    assert text == export.read_document(spark, str(tmp_path / "docs"), "s2", "p")
    want = [r.line for r in export.numbered(lines).filter("snapshot_id = 's1'").orderBy("line_no").collect()]
    assert text.split("\n")[:-1] == want
    assert want[:6] == ["# Model", "", "## Overview", "", "|  | Count |", "|-|-|"][:6] and "| Tables | 8 |" in want and "| Share | fact | 1 visuals |" in want
    at = want.index("### near")
    assert want[at : at + 8] == ["### near", "", "**Source:** `Lake.dbo.base`", "", "| Column | Physical column | Type | Confidence |", "|-|-|-|-|", "| kept | Lake.dbo.base.kept | string | ● exact |", "| near | Lake.dbo.base.far | string | ● exact |"]
    assert want[want.index("### fact[Total]") :][:5] == ["### fact[Total]", "", "```dax", "SUM(fact[amount])", "```"]


def test_changes_within_json_by_path(spark):
    from lineagrid.operators import diff as d

    side = lambda texts: spark.createDataFrame(list(texts.items()), "k string, t string")
    b = side({"same": '{"a": [1, {"b": null}], "c": {}}', "moved": '{"x": 1, "y": {"z": [1, 2]}}', "gone": "{}", "bad": "{", "deep": "[" * 30 + "1" + "]" * 30, "kind": '{"v": []}'})
    a = side({"same": ' {"c": {}, "a": [1,{"b":null}]}', "moved": '{"y": {"z": [1, 3, "q"]}, "n": null}', "new": "{}", "bad": "{", "deep": "[" * 30 + "2" + "]" * 30, "kind": '{"v": {}}'})
    got = {tuple(r) for r in d.path_diff(b, a, ["k"], "t", "json").collect()}
    assert got == {
        ("moved", "$.x", "json_removed", "1", None), ("moved", "$.y.z[1]", "json_changed", "2", "3"), ("moved", "$.y.z[2]", "json_added", None, '"q"'), ("moved", "$.n", "json_added", None, "null"),
        ("deep", "$" + "[0]" * 30, "json_changed", "1", "2"), ("kind", "$.v", "json_changed", "[]", "{}"),
    }


def test_impact_follows_what_has_changed(spark):
    """A seed that is no node reaches nothing; others are not walked from."""
    e = spark.createDataFrame([("p", "s", "m2", "m1", "measure_to_measure"), ("p", "s", "v", "m2", "visual_to_field"), ("p", "s", "f", "m1", "field_param_to_field"), ("p", "s", "w", "f", "visual_to_field")], "project_id string, snapshot_id string, source string, target string, type string")
    from lineagrid.plans.graphs import impact

    applied = spark.createDataFrame([("p", "s", "w")], "project_id string, snapshot_id string, visual string")
    got = {(r.seed, r.kind, r.visual) for r in impact(e, _seeds(spark, "m1", "nothing").withColumn("snapshot_id", F.lit("s")), applied).collect()}
    assert got == {("m1", "direct", "v"), ("m1", "direct", "w"), ("m1", "field_parameter", "w"), ("m1", "calculation_group", "w")}
