"""Queries of the source map: M, SQL and DAX text generated from table rows, read back, and set against the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dax, mquery as mq
from ..functions.text import split_top
from ..operators import source_map as sm
from ..operators.common import PK
from .bridge import VIEWS, oracle, view

VIEWS["b_m"] = """SELECT 'P' || CAST(s_suppkey % 8 AS STRING) AS project_id, 's1' AS snapshot_id, s_suppkey AS k, 'S' || CAST(s_suppkey AS STRING) AS table_name, s_suppkey % 6 AS connector, lower(replace(n_name, ' ', '-')) AS nation,
  s_suppkey % 4 = 0 AS delegated FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey"""

_PARAM = "ServerName"


def _models(spark, sf):
    """b_m with the M text of each table (``body``), what the partition itself says (``partition``) and its shared expression, if any."""
    m = view(spark, sf, "b_m")
    k, n = F.col("k").cast("string"), F.col("nation")
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    by = F.col("connector")
    conn = (
        F.when(by == 0, c('Sql.Database("srv-', n, '", "db', k, '")')).when(by == 1, c(f'Snowflake.Databases(#"{_PARAM}", "wh', k, '")')).when(by == 2, c('Oracle.Database("ora-', n, '")'))
        .when(by == 3, c('Web.Contents("https://', n, ".example/", k, '")')).when(by == 4, c('Excel.Workbook(File.Contents("C:\\data\\', k, '.xlsx"))'))
        .otherwise(c('Value.NativeQuery(Sql.Database("srv-', n, '", "db', k, '"), "SELECT t.a, t.b AS x', k, ", f(t.c, 1) AS y FROM dbo.tab_", k, ' t JOIN [dbo].[other] o ON o.k = t.k", null)'))
    )
    nav = F.when(by <= 2, c('Source{[Schema="dbo",Item="tab_', k, '"]}[Data]')).when(F.col("k") % 9 == 0, F.lit("Elsewhere")).otherwise(F.lit("Source"))
    missing = F.when(F.col("k") % 5 == 0, ", [MissingField = MissingField.UseNull]").otherwise("")
    more = F.when(F.col("k") % 5 == 0, c('  More = Table.Combine({Joined, #"Old ', k, '"}),\n')).otherwise("")
    body = c(
        "let\n  Source = ", conn, ', // old: Sql.Databases("decoy")\n  Nav = ', nav, ',\n  #"Renamed Columns" = Table.RenameColumns(Nav,{{"src_', k, '", "c', k, '"}, {"a b", "b"}}),\n',
        '  Added = Table.AddColumn(#"Renamed Columns", "added', k, '", each "x, y" /* Web.Contents("no") */),\n  Kept = Table.SelectColumns(Added,{"c', k, '", "b", "added', k, '"}),\n',
        '  Less = Table.RemoveColumns(Kept,{"b"}),\n  Joined = Table.NestedJoin(Less, {"k"}, #"Dim ', k, '", {"k"}, "dim", JoinKind.LeftOuter),\n', more, '  Expanded = Table.ExpandTableColumn(Joined, "dim", {"name', k, '", "as is"}, {"dim.name', k, '"}),\n  Typed = Table.TransformColumnTypes(Expanded,{{"c', k, '", type text}}', missing, ")\nin\n  Typed",
    )
    out = m.withColumn("body", body)
    return out.withColumns({"partition": F.when(F.col("delegated"), c('let Source = #"Shared', k, '" in Source')).otherwise(F.col("body")), "shared": F.when(F.col("delegated"), c("Shared", k))})


def _clean(spark, sf):
    return _models(spark, sf).withColumn("m", mq.strip_comments(F.col("body")))


def _parameters(spark, sf):
    return view(spark, sf, "b_project").select(*PK, F.lit(_PARAM).alias("parameter"), F.concat(F.lit("host-"), F.lower("project_id")).alias("value"))


def x9_comments(spark, sf):
    return _clean(spark, sf).select("project_id", "table_name", F.col("m").contains("decoy").alias("has_decoy"), F.col("m").contains('Contents("no")').alias("has_block"), F.col("m").contains('"x, y"').alias("keeps_string"))


def _sources(spark, sf):
    each = _clean(spark, sf).select(*PK, "table_name", "k", F.posexplode(mq.data_sources(F.col("m"))).alias("no", "s"))
    j = each.join(_parameters(spark, sf), [*PK], "left")
    server = F.when(F.col("s.parameter") == F.col("parameter"), F.col("value")).otherwise(F.col("s.server"))
    return j.select(*PK, "table_name", "no", F.col("s.type").alias("type"), server.alias("server"), "s.database", "s.url", "s.path", F.col("s.parameter").isNotNull().alias("parameterized"))


def x10_data_sources(spark, sf):
    return _sources(spark, sf).select("project_id", "table_name", "type", "server", "database", "url", "path", "parameterized")


def x11_concatenation(spark, sf):
    t = view(spark, sf, "b_m").select(*PK, "table_name", F.concat(F.lit('"db_" & '), F.when(F.col("connector") == 1, F.lit(_PARAM)).otherwise(F.lit("Unknown")), F.lit(' & "_'), F.col("k").cast("string"), F.lit(' ""q"""')).alias("text"))
    return mq.resolve_concatenations(t, "text", _parameters(spark, sf), [*PK, "table_name"]).select("project_id", "table_name", "resolved", "complete")


def x12_navigation(spark, sf):
    return _clean(spark, sf).select("project_id", "table_name", mq.navigation(F.col("m")).alias("n")).select("project_id", "table_name", "n.schema", "n.item")


def x12_positional(spark, sf):
    """Project, schema or dataset and table of navigation by untagged, tagged and parameter-valued records, and under a native query."""
    m = view(spark, sf, "b_m")
    k = F.col("k").cast("string")
    name = lambda *x: F.concat(F.lit('{[Name='), *x, F.lit(']}[Data]'))
    q = lambda text: F.concat(F.lit('"'), F.lit(text), k, F.lit('"'))
    tag = lambda text, kind: name(q(text), F.lit(f', Kind="{kind}"'))
    three = F.concat(name(q("p")), name(q("d")), name(q("t")))
    nav = (
        F.when(F.col("k") % 6 == 0, three).when(F.col("k") % 6 == 1, F.concat(name(q("d")), name(q("t")))).when(F.col("k") % 6 == 2, F.concat(name(F.lit("_Project")), name(q("d")), name(q("t"))))
        .when(F.col("k") % 6 == 3, F.concat(name(q("p")), tag("s", "Schema"), tag("v", "View"))).when(F.col("k") % 6 == 4, F.concat(three, F.lit(', Q = Value.NativeQuery(Source, "SELECT 1")'))).otherwise(F.concat(three, F.lit('{[Schema="a", Item="'), k, F.lit('"]}[Data]')))
    )
    values = F.create_map(F.lit("_Project"), F.concat(F.lit("real-"), F.lower("project_id")))
    n = m.select("project_id", "table_name", mq.navigation(F.concat(F.lit("let Source = GoogleBigQuery.Database(), Nav = Source"), nav, F.lit(" in Nav")), values).alias("n"))
    return n.select("project_id", "table_name", "n.project", "n.dataset", "n.schema", "n.item")


def x13_facts(spark, sf):
    m = F.col("m")
    pairs = F.array_join(F.transform(mq.rename_pairs(m), lambda p: F.concat(p.old, F.lit(">"), p.new)), ",")
    joins = F.array_join(F.transform(mq.nested_joins(m), lambda j: F.concat(j.expression, F.lit("("), F.array_join(j.left_keys, "+"), F.lit("="), F.array_join(j.right_keys, "+"), F.lit(")>"), j.column)), ",")
    expands = F.array_join(F.transform(mq.expand_pairs(m), lambda e: F.concat(e.column, F.lit("."), e.source_name, F.lit(">"), e.new_name)), ",")
    return _clean(spark, sf).select("project_id", "table_name", pairs.alias("renames"), F.array_join(mq.selected_columns(m), ",").alias("selected"), F.array_join(mq.added_columns(m), ",").alias("added"), joins.alias("joins"), expands.alias("expands"), F.array_join(mq.combined(m), ",").alias("combines"))


def _steps(spark, sf):
    s = _clean(spark, sf).select(*PK, "table_name", mq.steps(F.col("m")).alias("all")).select(*PK, "table_name", F.transform("all", lambda x: x["name"]).alias("names"), F.posexplode("all").alias("step_no", "s"))
    e = F.col("s.expression")
    return s.select(*PK, "table_name", "step_no", "s.name", "s.expression", mq.step_kind(e).alias("kind"), mq.affects_names(e).alias("affects_names"), mq.dangling(e, F.col("names")).alias("dangling"), mq.step_references(e, F.col("names")).alias("refs"))


def x14_steps(spark, sf):
    return _steps(spark, sf).select("project_id", "table_name", "step_no", "name", "kind", F.array_join("refs", ",").alias("refs"))


def x15_affects_names(spark, sf):
    return _steps(spark, sf).filter("affects_names").select("project_id", "table_name", "name")


def _native(spark, sf):
    q = _clean(spark, sf).filter("connector = 5").select(*PK, "table_name", mq.native_query(F.col("m")).alias("q"))
    return q.withColumn("sql", F.regexp_extract("q", r'(?s)^"(.*)"$', 1))


def x16_sql_tables(spark, sf):
    return _native(spark, sf).select("project_id", "table_name", F.array_join(mq.sql_tables(F.col("sql")), ",").alias("tables"), mq.sql_first_path(F.col("sql")).alias("first_path"))


def x17_select_list(spark, sf):
    return _native(spark, sf).select("project_id", "table_name", F.array_join(mq.sql_select_list(F.col("sql")), ",").alias("names"))


def x18_gateway(spark, sf):
    return _sources(spark, sf).select("project_id", "table_name", "type", mq.needs_gateway(F.col("type"), F.col("server"), F.col("path")).alias("gateway"))


def x19_paths(spark, sf):
    n = _clean(spark, sf).filter("connector <= 2").select(*PK, "table_name", mq.navigation(F.col("m")).alias("n"))
    db = _sources(spark, sf).filter("no = 0").select(*PK, "table_name", "database")
    return n.join(db, [*PK, "table_name"]).select("project_id", "table_name", mq.physical_path("database", "n.schema", "n.item").alias("path"))


def x20_refs(spark, sf):
    from ..operators.common import ref

    r = view(spark, sf, "b_measure").select("project_id", ref("table_name", "name").alias("ref"))
    return r.select("project_id", "ref", F.regexp_extract("ref", r"^([^\[]*)\[", 1).alias("table_name"), F.regexp_extract("ref", r"^[^\[]*\[(.*)\]$", 1).alias("name"))


def x5_use_relationship(spark, sf):
    r = view(spark, sf, "b_rel").withColumn("text", F.concat(F.lit("CALCULATE([x], USERELATIONSHIP('"), "from_table", F.lit("'[k], "), "to_table", F.lit("[k])) // USERELATIONSHIP(A[b], C[d])")))
    return r.select("project_id", "cross_filter", "is_active", F.explode(dax.use_relationships(F.col("text"))).alias("u")).select("project_id", "cross_filter", "is_active", "u.from_table", "u.from_column", "u.to_table", "u.to_column")


def _parameter_text(spark, sf):
    o = view(spark, sf, "b_offer")
    row = F.concat(F.lit('("Show '), "ordinal", F.lit('", NAMEOF('), F.when(F.col("ordinal") % 2 == 0, F.lit("'T 1'")).otherwise(F.lit("")), F.lit("["), "offered", F.lit("]), "), "ordinal", F.lit(")"))
    g = o.groupBy("project_id", "parameter_table").agg(F.sort_array(F.collect_list(F.struct("ordinal", row.alias("t")))).alias("r"))
    return g.select("project_id", "parameter_table", F.concat(F.lit("{"), F.array_join(F.transform("r", lambda x: x.t), ", "), F.lit("}")).alias("text"))


def x6_nameof(spark, sf):
    twice = F.concat("text", F.lower("text"))
    return _parameter_text(spark, sf).select("project_id", "parameter_table", F.posexplode(dax.nameof_targets(twice)).alias("no", "t")).select("project_id", "parameter_table", "no", "t.ref_table", "t.ref_name")


def x7_parameter_rows(spark, sf):
    return _parameter_text(spark, sf).select("project_id", "parameter_table", F.explode(dax.parameter_rows(F.col("text"))).alias("t")).select("project_id", "parameter_table", "t.display_name", "t.ref_table", "t.ref_name", "t.ordinal")


def x8_calculation_groups(spark, sf):
    """Measures that a calculation item's text marks by SELECTEDMEASURE, and the branches of SWITCH measures."""
    m = view(spark, sf, "b_measure")
    text = F.when(F.col("size") % 2 == 0, F.concat(F.lit('SWITCH(SELECTEDVALUE(P[k]), 1, [M'), "i", F.lit('], "b", \'T\'[N'), "i", F.lit("])"))).otherwise(F.lit("CALCULATE(SELECTEDMEASURE(), ALL(D))"))
    return m.select("project_id", "name", text.rlike(r"(?i)\bSELECTEDMEASURE\s*\(").alias("is_item"), F.array_join(dax.switch_branches(text), ",").alias("branches"))


def split_parts(spark, sf):
    t = view(spark, sf, "b_m").select("project_id", "table_name", F.concat(F.lit('f(a, "x, )"), {b, ['), "k", F.lit(", 2]}, c")).alias("t"))
    return t.select("project_id", "table_name", F.array_join(split_top(F.col("t")), "|").alias("parts"))


def _delegates(spark, sf):
    m = _models(spark, sf)
    bodies = m.select(*PK, "table_name", F.regexp_extract("partition", r'^let Source = #"([^"]+)" in Source$', 1).alias("d"), F.col("partition").alias("body"))
    bodies = bodies.select(*PK, "table_name", F.when(F.col("d") != "", F.col("d")).alias("delegate"), "body")
    # every eighth shared expression passes on to a second one, every forty-eighth runs in a circle
    s = m.filter("delegated")
    second = F.concat("shared", F.lit("b"))
    first = s.select(*PK, F.col("shared").alias("name"), F.when(F.col("k") % 8 == 0, second).alias("delegate"), F.col("body"))
    back = s.filter("k % 8 = 0").select(*PK, second.alias("name"), F.when(F.col("k") % 48 == 0, F.col("shared")).alias("delegate"), "body")
    return bodies, first.unionByName(back)


def j2_delegation(spark, sf):
    out = sm.resolve_delegates(*_delegates(spark, sf))
    first = F.element_at(mq.data_sources(mq.strip_comments(F.col("source_body"))), 1)
    return out.select("project_id", "table_name", F.col("delegate").isNotNull().alias("delegated"), first["type"].alias("type"))


def j3_table_sources(spark, sf):
    out = sm.resolve_delegates(*_delegates(spark, sf)).filter("source_body is not null")
    keys = out.select(*PK, "table_name", F.explode(mq.data_sources(mq.strip_comments(F.col("source_body")))).alias("s")).select(*PK, "table_name", mq.source_key(F.col("s")).alias("key"))
    return keys.groupBy("project_id", "table_name").agg(F.array_join(F.sort_array(F.collect_set("key")), ",").alias("sources"))


def j4_expression_links(spark, sf):
    """Tables and the shared expressions that their M text names: quoted names are read once and joined, the Source step first."""
    m = _models(spark, sf)
    names = m.filter("delegated").select(*PK, F.col("shared").alias("expression"))
    said = m.select(*PK, "table_name", F.posexplode(F.regexp_extract_all("partition", F.lit(r'(Source\s*=\s*)?#"([^"]+)"'), F.lit(2))).alias("no", "expression"))
    return said.join(names, [*PK, "expression"]).groupBy("project_id", "table_name").agg(F.min_by("expression", "no").alias("expression"))


def j5_join_edges(spark, sf):
    j = _clean(spark, sf).select(*PK, "table_name", F.explode(mq.nested_joins(F.col("m"))).alias("j")).select(*PK, "table_name", F.regexp_replace("j.expression", "^Dim ", "S").alias("other"))
    j = j.withColumn("other", F.when(F.substring("table_name", 2, 9).cast("int") % 3 == 0, F.concat(F.lit("S"), (F.substring("table_name", 2, 9).cast("int") + 8).cast("string"))).otherwise(F.col("other")))
    known = view(spark, sf, "b_m").select(*PK, F.col("table_name").alias("other"))
    return j.join(known, [*PK, "other"], "left_semi").filter("other <> table_name").distinct().select("project_id", "table_name", "other")


def a8_deduplicate(spark, sf):
    m = view(spark, sf, "lineitem").select(F.concat(F.lit("P"), F.floor(F.col("l_orderkey") / 64)).alias("project_id"), F.lit("s1").alias("snapshot_id"), F.concat(F.lit("S"), F.col("l_suppkey") % 20).alias("table_name"), F.col("l_orderkey").alias("no"), F.lower(F.concat(F.lit("SQL|"), F.col("l_partkey") % 5)).alias("key"), (F.col("l_orderkey") % 3 == 0).alias("is_native"), "l_linenumber")
    m = m.withColumn("no", F.col("no") * 10 + F.col("l_linenumber"))
    return sm.first_sources(m).select("project_id", "table_name", "no", "key", "is_native")


def _ladder(spark, sf):
    """Columns and facts for every rung of the ladder, by the column number modulo 11; each rung has tables of its own."""
    rung = F.col("size") % 11
    c = view(spark, sf, "b_column").withColumn("rung", rung).withColumn("table_name", F.concat("table_name", F.lit("_"), rung))
    even = F.col("size") % 2 == 0
    keys = [*PK, "table_name"]
    columns = c.select(*keys, "name", F.when(F.col("size") % 5 != 0, F.col("source_column")).alias("source_column"), (rung == 2).alias("is_calculated"), "rung", even.alias("even"), "size")
    path = F.when(~F.col("rung").isin(0, 6), F.concat(F.lit("dbo."), "table_name"))
    kind = F.when(F.col("rung") == 0, "model-defined").when(F.col("rung") == 1, "direct-lake").otherwise("m")
    tables = c.groupBy(*keys, "rung").agg(F.max("size").alias("top")).select(*keys, kind.alias("kind"), path.alias("table_path"), F.when(F.col("rung") == 8, "list").alias("native_kind"), (F.col("rung") == 9).alias("has_projection"), (F.col("top") % 2 == 0).alias("intact"))
    pq = F.coalesce("source_column", "name")
    renames = columns.filter("rung = 7").select(*keys, pq.alias("new_name"), F.concat(F.lit("old_"), "size").alias("old_name"))
    added = columns.filter("rung = 3").select(*keys, F.col("name").alias("added"))
    expanded = columns.filter("rung in (4, 5)").select(*keys, pq.alias("expanded"), F.concat(F.lit("e"), "size").alias("source_name"), F.when(F.col("rung") == 4, "dim.t").alias("expanded_path"))
    native = columns.filter("rung = 8 and even").select(*keys, pq.alias("pq_name"))
    projected = columns.filter("rung = 9 and even").select(*keys, pq.alias("pq_name"))
    return columns.drop("rung", "even", "size"), tables, renames, added, expanded, native, projected


def j9_ladder(spark, sf):
    return sm.resolve_columns(*_ladder(spark, sf)).drop("snapshot_id")


def s6_source_rows(spark, sf):
    """The source map as flat rows for a table file: no nulls, one text a cell."""
    s = sm.resolve_columns(*_ladder(spark, sf))
    return s.select("project_id", *(F.coalesce(F.regexp_replace(F.col(c), r"[\r\n]+", " "), F.lit("")).alias(c) for c in ("model_table", "model_column", "physical_path", "confidence")))


def j8_expanded(spark, sf):
    """Joined-in columns: expand pair to nested-join column to joined expression to that expression's table."""
    m = _clean(spark, sf)
    joins = m.select(*PK, "table_name", F.explode(mq.nested_joins(F.col("m"))).alias("j")).select(*PK, "table_name", F.col("j.column").alias("column"), F.col("j.expression").alias("expression"))
    pairs = m.select(*PK, "table_name", F.explode(mq.expand_pairs(F.col("m"))).alias("e")).select(*PK, "table_name", "e.column", "e.source_name", "e.new_name")
    tables = view(spark, sf, "b_m").filter("k % 2 = 0").select(*PK, F.concat(F.lit("Dim "), "k").alias("expression"), F.concat(F.lit("dbo.dim_"), "k").alias("path"))
    return pairs.join(joins, [*PK, "table_name", "column"]).join(tables, [*PK, "expression"], "left").select("project_id", "table_name", "new_name", "source_name", "path")


def j10_name_chain(spark, sf):
    return sm.name_chain(_steps(spark, sf)).select("project_id", "table_name", "intact")


def j11_derived(spark, sf):
    """Chains of derived tables: c<n> copies c<n // 2> where 3 divides n; those that 5 divides point at themselves."""
    c = view(spark, sf, "b_column").select(*PK, "table_name", "size")
    name = lambda x: F.concat(F.lit("c"), x)
    derived = (F.col("size") % 3 == 0)
    smap = c.select(*PK, F.col("table_name").alias("model_table"), name(F.col("size")).alias("model_column"), F.when(~derived, name(F.col("size"))).alias("source_column"), F.when(~derived, F.concat(F.lit("dbo.t."), name(F.col("size")))).alias("physical_path"), F.when(derived, "unresolved").otherwise("source").alias("origin"), F.when(derived, "unknown").when(F.col("size") % 4 == 1, "inferred").otherwise("exact").alias("confidence"))
    target = F.when(F.col("size") % 5 == 0, F.col("size")).otherwise(F.floor(F.col("size") / 2))
    links = c.filter(derived).select(*PK, F.col("table_name").alias("model_table"), name(F.col("size")).alias("model_column"), F.col("table_name").alias("from_table"), name(target).alias("from_column"), F.lit(0).alias("hop"))
    return sm.link_derived(smap, links).select("project_id", "model_table", "model_column", "physical_path", "origin", "confidence")


def j13_column_sources(spark, sf):
    """Graph side: source column of each model column through the rename list, with its full path."""
    c = view(spark, sf, "b_column")
    ren = c.filter("size % 3 = 0").select(*PK, "table_name", "name", F.col("source_column").alias("old"))
    j = c.join(ren, [*PK, "table_name", "name"], "left")
    col = F.coalesce("old", "name")
    return j.select("project_id", "table_name", "name", col.alias("source_column"), mq.physical_path(F.lit("dbo"), "table_name", col).alias("path"))


_TYPES = "['SQL Server', 'Snowflake', 'Oracle', 'Web', 'Excel', 'SQL Server'][connector + 1]"
_SRC = f"""src AS (SELECT project_id, table_name, k, connector, delegated, {_TYPES} AS type, CASE connector WHEN 0 THEN 'srv-' || nation WHEN 1 THEN 'host-' || lower(project_id) WHEN 2 THEN 'ora-' || nation WHEN 5 THEN 'srv-' || nation END AS server,
CASE WHEN connector IN (0, 5) THEN 'db' || k WHEN connector = 1 THEN 'wh' || k END AS database, CASE WHEN connector = 3 THEN 'https://' || nation || '.example/' || k END AS url, CASE WHEN connector = 4 THEN 'C:\\data\\' || k || '.xlsx' END AS path, connector = 1 AS parameterized FROM {{b_m}})"""
_LOST = "delegated AND k % 48 = 0"

_RAW = {
    "x9_comments": "SELECT project_id, table_name, false AS has_decoy, false AS has_block, true AS keeps_string FROM {b_m}",
    "x10_data_sources": f"WITH {_SRC} SELECT project_id, table_name, type, server, database, url, path, parameterized FROM src",
    "x11_concatenation": "SELECT project_id, table_name, 'db_' || CASE WHEN connector = 1 THEN 'host-' || lower(project_id) ELSE '{{Unknown}}' END || '_' || k || ' \"q\"' AS resolved, connector = 1 AS complete FROM {b_m}".replace("{{Unknown}}", "' || chr(123) || 'Unknown' || chr(125) || '"),
    "x12_navigation": "SELECT project_id, table_name, CASE WHEN connector <= 2 THEN 'dbo' END AS schema, CASE WHEN connector <= 2 THEN 'tab_' || k END AS item FROM {b_m}",
    "x12_positional": """SELECT project_id, table_name, CASE k % 6 WHEN 0 THEN 'p' || k WHEN 2 THEN 'real-' || lower(project_id) WHEN 3 THEN 'p' || k WHEN 4 THEN 'p' || k END AS project, CASE WHEN k % 6 IN (0, 1, 2) THEN 'd' || k END AS dataset,
CASE k % 6 WHEN 3 THEN 's' || k WHEN 5 THEN 'a' END AS schema, CASE k % 6 WHEN 0 THEN 't' || k WHEN 1 THEN 't' || k WHEN 2 THEN 't' || k WHEN 3 THEN 'v' || k WHEN 5 THEN CAST(k AS VARCHAR) END AS item FROM {b_m}""",
    "x13_facts": "SELECT project_id, table_name, 'src_' || k || '>c' || k || ',a b>b' AS renames, 'c' || k || ',added' || k AS selected, 'added' || k AS added, 'Dim ' || k || '(k=k)>dim' AS joins, 'dim.name' || k || '>dim.name' || k || ',dim.as is>as is' AS expands, CASE WHEN k % 5 = 0 THEN 'Joined,Old ' || k ELSE '' END AS combines FROM {b_m}",
    "x14_steps": "SELECT project_id, table_name, CAST(unnest(range(CASE WHEN k % 5 = 0 THEN 10 ELSE 9 END)) AS INTEGER) AS step_no, unnest(['Source', 'Nav', 'Renamed Columns', 'Added', 'Kept', 'Less', 'Joined'] || CASE WHEN k % 5 = 0 THEN ['More'] ELSE [] END || ['Expanded', 'Typed']) AS name, unnest(['Source', CASE WHEN connector <= 2 THEN 'Navigation' ELSE 'Custom' END, 'Rename', 'AddColumn', 'Projection', 'Projection', 'Join'] || CASE WHEN k % 5 = 0 THEN ['Join'] ELSE [] END || ['Expand', 'TypeChange']) AS kind, unnest(['', CASE WHEN connector > 2 AND k % 9 = 0 THEN '' ELSE 'Source' END, 'Nav', 'Renamed Columns', 'Added', 'Kept', 'Less'] || CASE WHEN k % 5 = 0 THEN ['Joined'] ELSE [] END || ['Joined', 'Expanded']) AS refs FROM {b_m}",
    "x15_affects_names": "SELECT project_id, table_name, unnest(['More', 'Typed']) AS name FROM {b_m} WHERE k % 5 = 0",
    "x16_sql_tables": "SELECT project_id, table_name, 'dbo.tab_' || k || ',dbo.other' AS tables, 'dbo.tab_' || k AS first_path FROM {b_m} WHERE connector = 5",
    "x17_select_list": "SELECT project_id, table_name, 'a,x' || k || ',y' AS names FROM {b_m} WHERE connector = 5",
    "x18_gateway": f"WITH {_SRC} SELECT project_id, table_name, type, connector NOT IN (1, 3) AS gateway FROM src",
    "x19_paths": f"WITH {_SRC} SELECT project_id, table_name, CASE WHEN database IS NULL THEN '' ELSE database || '.' END || 'dbo.tab_' || k AS path FROM src WHERE connector <= 2",
    "x20_refs": "SELECT project_id, table_name || '[' || name || ']' AS ref, table_name, name FROM {b_measure}",
    "x5_use_relationship": "SELECT project_id, cross_filter, is_active, from_table, 'k' AS from_column, to_table, 'k' AS to_column FROM {b_rel}",
    "x6_nameof": "SELECT project_id, parameter_table, CAST(row_number() OVER (PARTITION BY project_id, parameter_table ORDER BY ordinal) - 1 AS INTEGER) AS no, CASE WHEN ordinal % 2 = 0 THEN 'T 1' END AS ref_table, offered AS ref_name FROM {b_offer}",
    "x7_parameter_rows": "SELECT project_id, parameter_table, 'Show ' || ordinal AS display_name, CASE WHEN ordinal % 2 = 0 THEN 'T 1' END AS ref_table, offered AS ref_name, CAST(ordinal AS INTEGER) AS ordinal FROM {b_offer}",
    "x8_calculation_groups": "SELECT project_id, name, size % 2 <> 0 AS is_item, CASE WHEN size % 2 = 0 THEN 'M' || i || ',N' || i ELSE '' END AS branches FROM {b_measure}",
    "split_parts": """SELECT project_id, table_name, 'f(a, "x, )")|' || chr(123) || 'b, [' || k || ', 2]' || chr(125) || '|c' AS parts FROM {b_m}""",
    "j2_delegation": f"WITH {_SRC} SELECT project_id, table_name, delegated, CASE WHEN NOT ({_LOST}) THEN type END AS type FROM src",
    "j3_table_sources": f"WITH {_SRC} SELECT project_id, table_name, lower(type || '|' || CASE WHEN connector = 1 THEN 'ServerName' ELSE coalesce(server, '') END || '|' || coalesce(database, '') || '|' || coalesce(url, '') || '|' || coalesce(path, '')) AS sources FROM src WHERE NOT ({_LOST})",
    "j4_expression_links": "SELECT project_id, table_name, 'Shared' || k AS expression FROM {b_m} WHERE delegated",
    "j5_join_edges": "SELECT a.project_id, a.table_name, b.table_name AS other FROM {b_m} a JOIN {b_m} b ON b.project_id = a.project_id AND b.k = a.k + 8 WHERE a.k % 3 = 0",
    "a8_deduplicate": "WITH m AS (SELECT 'P' || CAST(floor(l_orderkey / 64) AS BIGINT) AS project_id, 'S' || l_suppkey % 20 AS table_name, l_orderkey * 10 + l_linenumber AS no, 'sql|' || l_partkey % 5 AS key, l_orderkey % 3 = 0 AS is_native FROM {lineitem}), r AS (SELECT *, row_number() OVER (PARTITION BY project_id, table_name, key ORDER BY CASE WHEN is_native THEN 0 ELSE 1 END, no) AS n FROM m) SELECT project_id, table_name, no, key, is_native FROM r WHERE n = 1",
    "j9_ladder": None,
    "s6_source_rows": None,
    "j8_expanded": "SELECT project_id, table_name, unnest(['dim.name' || k, 'as is']) AS new_name, unnest(['name' || k, 'as is']) AS source_name, CASE WHEN k % 2 = 0 THEN 'dbo.dim_' || k END AS path FROM {b_m}",
    "j10_name_chain": "SELECT project_id, table_name, k % 5 <> 0 AND NOT (connector > 2 AND k % 9 = 0) AS intact FROM {b_m}",
    "j11_derived": None,
    "j13_column_sources": "SELECT project_id, table_name, name, CASE WHEN size % 3 = 0 THEN source_column ELSE name END AS source_column, 'dbo.' || table_name || '.' || CASE WHEN size % 3 = 0 THEN source_column ELSE name END AS path FROM {b_column}",
}
_LADDER = """WITH c AS (SELECT *, size % 11 AS rung, table_name || '_' || size % 11 AS t, CASE WHEN size % 5 <> 0 THEN source_column ELSE name END AS pq, size % 2 = 0 AS even FROM {b_column}),
x AS (SELECT *, max(size) OVER (PARTITION BY project_id, t) % 2 = 0 AS intact FROM c),
y AS (SELECT project_id, t AS model_table, name AS model_column, pq AS pq_name,
CASE WHEN rung = 0 THEN 'model-defined' WHEN rung = 2 THEN 'computed-dax' WHEN rung = 3 THEN 'computed-pq' WHEN rung IN (5, 6) OR (rung IN (8, 9) AND NOT even) THEN 'unresolved' ELSE 'source' END AS origin,
CASE WHEN rung IN (5, 6) OR (rung IN (8, 9) AND NOT even) THEN 'unknown' WHEN rung = 10 AND NOT intact THEN 'inferred' ELSE 'exact' END AS confidence,
CASE WHEN rung = 4 THEN 'e' || size WHEN rung = 7 THEN 'old_' || size ELSE pq END AS s, CASE WHEN rung = 4 THEN 'dim.t' ELSE 'dbo.' || t END AS p FROM x)
"""
_RAW["j9_ladder"] = _LADDER + "SELECT project_id, model_table, model_column, pq_name, CASE WHEN origin = 'source' THEN s END AS source_column, CASE WHEN origin = 'source' THEN p || '.' || s END AS physical_path, origin, confidence FROM y"
_RAW["s6_source_rows"] = _LADDER + "SELECT project_id, model_table, model_column, CASE WHEN origin = 'source' THEN p || '.' || s ELSE '' END AS physical_path, confidence FROM y"
_RAW["j11_derived"] = """WITH RECURSIVE c AS (SELECT project_id, table_name, size FROM {b_column}),
r AS (SELECT project_id, table_name, size AS root, size AS pos, 0 AS hops FROM c WHERE size % 3 = 0 UNION ALL SELECT r.project_id, r.table_name, r.root, c.size, r.hops + 1 FROM r JOIN c ON c.project_id = r.project_id AND c.table_name = r.table_name AND c.size = CAST(floor(r.pos / 2) AS BIGINT) WHERE r.pos % 3 = 0 AND r.pos % 5 <> 0 AND r.hops < 10),
f AS (SELECT project_id, table_name, root AS size, pos FROM r WHERE pos % 3 <> 0)
SELECT c.project_id, c.table_name AS model_table, 'c' || c.size AS model_column, 'dbo.t.c' || CASE WHEN c.size % 3 <> 0 THEN c.size ELSE f.pos END AS physical_path, CASE WHEN c.size % 3 <> 0 OR f.pos IS NOT NULL THEN 'source' ELSE 'unresolved' END AS origin,
CASE WHEN c.size % 3 = 0 AND f.pos IS NULL THEN 'unknown' WHEN CASE WHEN c.size % 3 <> 0 THEN c.size ELSE f.pos END % 4 = 1 THEN 'inferred' ELSE 'exact' END AS confidence FROM c LEFT JOIN f USING (project_id, table_name, size)"""

QUERIES = {k: f for k, f in globals().items() if k in _RAW}
ORACLES = {k: oracle(q) for k, q in _RAW.items()}
