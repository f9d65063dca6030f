"""Queries of sources, ingest and exports: project files generated from table rows, read back, and set against the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.common import PK, cut  # noqa: F401
from ..sources import files as fs
from ..sources import pbir, tmdl
from .bridge import oracle, view


def _c(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _s(name):
    return F.col(name).cast("string")


def _file(df, path, content):
    return df.select(*PK, path.alias("path"), content.alias("content"))


def _table_files(spark, sf):
    """A TMDL file for each brand of each project: a column for each size, a measure for each part, a partition; every fifth brand has a calculation group."""
    cols = view(spark, sf, "b_column")
    text = _c("\tcolumn ", F.when(F.col("size") % 2 == 0, _c("'", "name" and F.col("name"), "'")).otherwise(F.col("name")), F.when(F.col("size") % 7 == 0, _c(" = 1 + ", _s("size"))).otherwise(F.lit("")), "\n\t\tdataType: ", F.when(F.col("size") % 3 == 0, "int64").otherwise("string"), F.when(F.col("size") % 4 == 0, F.lit("\n\t\tisHidden")).otherwise(F.lit("")), F.when(F.col("size") % 7 != 0, _c("\n\t\tsourceColumn: ", F.col("source_column"))).otherwise(F.lit("")), "\n\n")
    c = cols.groupBy(*PK, "table_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("size", text.alias("t")))), lambda x: x.t), "").alias("c"))
    m = view(spark, sf, "b_measure")
    mt = _c("\tmeasure '", F.col("name"), "' =\n\t\t\tVAR x = [M", _s("i"), "]\n\n\t\t\tRETURN x + ", _s("size"), "\n\t\tformatString: #,0\n", F.when(F.col("is_hidden"), F.lit("\t\tisHidden\n")).otherwise(F.lit("")), "\n\t\tannotation Note = a: b\n\n")
    ms = m.groupBy(*PK, "table_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", mt.alias("t")))), lambda x: x.t), "").alias("m"))
    part = _c("\tpartition '", F.col("table_name"), "' = m\n\t\tmode: Import\n\t\tsource =\n\t\t\t\tlet\n\t\t\t\t  S = \"", F.col("table_name"), "\"\n\t\t\t\tin\n\t\t\t\t  S\n\n")
    group = F.when(F.col("table_name").endswith("5"), _c("\tcalculationGroup\n\t\tprecedence: 1\n\n\t\tcalculationItem 'YTD ", F.col("table_name"), "' = CALCULATE(SELECTEDMEASURE(), D[x])\n\n\t\tcalculationItem Now = SELECTEDMEASURE()\n\n")).otherwise(F.lit(""))
    j = c.join(ms, [*PK, "table_name"])
    return _file(j, _c("Sales.SemanticModel/definition/tables/", F.col("table_name"), ".tmdl"), _c("table '", F.col("table_name"), "'\n\tlineageTag: x\n\n", F.col("c"), F.col("m"), group, part))


def i1_columns(spark, sf):
    return tmdl.columns(tmdl.rows(_table_files(spark, sf))).drop("snapshot_id")


def i1_measures(spark, sf):
    return tmdl.measures(tmdl.rows(_table_files(spark, sf))).select("project_id", "table_name", "name", F.regexp_replace("expression", r"\s+", " ").alias("expression"), "is_hidden", "format_string")


def i1_partitions(spark, sf):
    return tmdl.partitions(tmdl.rows(_table_files(spark, sf))).select("project_id", "table_name", "name", "type", "mode", F.regexp_replace("m_body", r"\s+", " ").alias("m_body"))


def i1_calculation_items(spark, sf):
    return tmdl.calculation_items(tmdl.rows(_table_files(spark, sf))).drop("snapshot_id")


def i2_expressions(spark, sf):
    p = view(spark, sf, "part").select(_c("P", (F.col("p_partkey") % 8).cast("string")).alias("project_id"), F.lit("s1").alias("snapshot_id"), "p_partkey", "p_size", "p_name")
    t = F.when(F.col("p_size") % 2 == 0, _c("expression 'E ", _s("p_partkey"), '\' = "', F.col("p_name"), '" meta [IsParameterQuery=true]\n')).otherwise(_c("expression E", _s("p_partkey"), " =\n\t\tlet\n\t\t  S = ", _s("p_size"), "\n\t\tin S\n\tlineageTag: q\n"))
    f = p.groupBy(*PK).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", t.alias("t")))), lambda x: x.t), "\n").alias("t"))
    return tmdl.expressions(tmdl.rows(_file(f, F.lit("Sales.SemanticModel/definition/expressions.tmdl"), F.col("t")))).select("project_id", "name", "kind", F.regexp_replace("body", r"\s+", " ").alias("body"), "value")


def i3_relationships(spark, sf):
    r = view(spark, sf, "b_rel").withColumn("form", F.substring("to_table", 2, 9).cast("int") % 4)
    f, t = F.col("from_table"), F.col("to_table")
    ends = lambda x: F.when(F.col("form") == 0, _c(x, ".k")).when(F.col("form") == 1, _c("'", x, "'.k")).when(F.col("form") == 2, _c(x, ".'k'")).otherwise(_c(x, "[k]"))
    text = _c("relationship r\n", F.when(~F.col("is_active"), F.lit("\tisActive: false\n")).otherwise(F.lit("")), "\tfromColumn: ", ends(f), "\n\ttoColumn: ", ends(t), "\n", F.when(F.col("cross_filter") == "both", F.lit("\tcrossFilteringBehavior: bothDirections\n")).otherwise(F.lit("")))
    g = r.groupBy(*PK).agg(F.array_join(F.sort_array(F.collect_list(text)), "\n").alias("t"))
    return tmdl.relationships(tmdl.rows(_file(g, F.lit("Sales.SemanticModel/definition/relationships.tmdl"), F.col("t")))).drop("snapshot_id", "name")


def i4_pages(spark, sf):
    c = view(spark, sf, "customer").select(_c("P", (F.col("c_custkey") % 8).cast("string")).alias("project_id"), F.lit("s1").alias("snapshot_id"), "c_custkey", "c_name")
    k = F.col("c_custkey")
    body = _c('{"name": "page', _s("c_custkey"), '", "displayName": "', F.col("c_name"), '", "ordinal": ', (k % 9).cast("string"), F.when(k % 2 == 0, F.lit(', "width": 800')).otherwise(F.lit("")), "}")
    return pbir.pages(_file(c, _c("S.Report/definition/pages/p", _s("c_custkey"), "/page.json"), F.when(k % 17 == 0, F.lit('{"name": ')).otherwise(body))).drop("snapshot_id")


def _visual_files(spark, sf):
    v = view(spark, sf, "b_visual")
    k, title = F.col("vkey") % 6, F.col("title")
    lit = _c('"text": {"expr": {"Literal": {"Value": "\'', title, "'\"}}}")
    shape = (
        F.when(k == 0, _c('"visual": {"visualType": "card", "title": "', title, '"}')).when(k == 1, _c('"visual": {"visualType": "card", "title": {"text": "', title, '"}}'))
        .when(k == 2, _c('"visual": {"visualType": "bar", "objects": {"title": {"properties": {', lit, "}}}}")).when(k == 3, _c('"visual": {"visualType": "bar", "vcObjects": {"title": [{"properties": {', lit, "}}]}}"))
        .when(k == 4, _c('"visual": {"visualType": "bar", "visualContainerObjects": {"title": [{"properties": {', lit, "}}]}}")).otherwise(_c('"visualGroup": {"displayName": "', title, '"}'))
    )
    body = _c('{"name": "', F.col("visual_id"), '", "position": {"x": ', _s("x"), ', "y": ', _s("y"), ', "width": ', _s("width"), ', "height": ', _s("height"), '}, "parentGroupName": "', F.col("parent_group"), '", ', F.when(F.col("is_hidden"), F.lit('"isHidden": true, ')).otherwise(F.lit("")), shape, "}")
    return _file(v, _c("S.Report/definition/pages/", F.col("page_id"), "/visuals/", F.col("visual_id"), "/visual.json"), body)


def i5_visuals(spark, sf):
    """Visuals with what they plot and their roles: three of six kinds plot vkey % 4 measures and a column, one reads a measure in its title alone."""
    files = _visual_files(spark, sf)
    n = F.regexp_extract("path", r"visuals/(\d+)/", 1).cast("long")
    measure = '{"field": {"Measure": {"Expression": {"SourceRef": {"Entity": "T"}}, "Property": "M'
    values = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.when(i <= n % 4, F.concat(F.lit(measure), i.cast("string"), F.lit('"}}}')))), ", ")
    rows = F.lit('"Rows": {"projections": [{"field": {"Column": {"Expression": {"SourceRef": {"Entity": "T"}}, "Property": "c"}}}]}, "Odd": {"projections": "none"}')
    query = F.concat(F.lit('"visual": {"query": {"queryState": {"Values": {"projections": ['), values, F.lit("]}, "), rows, F.lit("}}, "))
    title = F.lit('"visual": {"vcObjects": {"subTitle": [{"Measure": {"Expression": {"SourceRef": {"Entity": "T"}}, "Property": "M1"}}]}, ')
    files = files.withColumn("content", F.when(n % 6 < 3, F.replace("content", F.lit('"visual": {'), query)).when(n % 6 == 4, F.replace("content", F.lit('"visual": {'), title)).otherwise(F.col("content")))
    return pbir.with_roles(pbir.visuals(files), pbir.visual_fields(files)).drop("snapshot_id")


def i6_fields(spark, sf):
    f = view(spark, sf, "b_field").groupBy(*PK, "page_id", "visual_id", "i").agg(F.min("via_rank").alias("via_rank"))
    ref = _c('{"Measure": {"Expression": {"SourceRef": {"Source": "t"}}, "Property": "M', _s("i"), '"}}')
    direct = _c('{"Measure": {"Expression": {"SourceRef": {"Entity": "T"}}, "Property": "M', _s("i"), '"}}')
    g = f.groupBy(*PK, "page_id", "visual_id").agg(
        F.collect_list(F.when(F.col("via_rank") == 0, ref)).alias("q"), F.collect_list(F.when(F.col("via_rank") == 1, direct)).alias("v"), F.collect_list(F.when(F.col("via_rank") == 3, direct)).alias("t"),
        F.collect_list(F.when(F.col("via_rank") == 4, _c('{"field": ', direct, "}"))).alias("f"), F.collect_list(F.when(F.col("via_rank") == 5, direct)).alias("a"), F.collect_list(F.when(F.col("via_rank").isin(2, 6), direct)).alias("o"),
    )
    arr = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    body = _c('{"name": "', F.col("visual_id"), '", "filterConfig": {"filters": ', arr("f"), '}, "visual": {"visualType": "card", "prototypeQuery": {"From": [{"Name": "t", "Entity": "T"}], "Select": ', arr("q"), '}, "objects": {"values": ', arr("v"), ', "labels": ', arr("o"), '}, "visualContainerObjects": {"title": ', arr("t"), ', "visualLink": ', arr("a"), "}}}")
    return pbir.visual_fields(_file(g, _c("S.Report/definition/pages/", F.col("page_id"), "/visuals/v/visual.json"), body)).drop("snapshot_id")


def i7_bookmarks(spark, sf):
    s = view(spark, sf, "b_state").groupBy(*PK, "bookmark_id", "page_id", "object_id").agg(F.max("state").alias("state"))
    group = (F.length("object_id") % 2) == 0
    mode = F.when(F.col("state") == "hidden", F.lit('{"singleVisual": {"display": {"mode": "hidden"}}}')).otherwise(F.lit('{"singleVisual": {}}'))
    hid = F.when(F.col("state") == "hidden", F.lit("true")).otherwise(F.lit("false"))
    vis = F.when(~group, _c('"', F.col("object_id"), '": ', mode))
    grp = F.when(group, _c('"', F.col("object_id"), '": {"isHidden": ', hid, "}"))
    pg = s.groupBy(*PK, "bookmark_id", "page_id").agg(F.collect_list(vis).alias("v"), F.collect_list(grp).alias("g"))
    section = _c('"', F.col("page_id"), '": {"visualContainers": {', F.array_join("v", ", "), '}, "visualContainerGroups": {"outer": {"children": {', F.array_join("g", ", "), "}}}}")
    b = pg.groupBy(*PK, "bookmark_id").agg(F.array_join(F.collect_list(section), ", ").alias("s"))
    ok = _file(b, _c("S.Report/definition/bookmarks/", F.col("bookmark_id"), ".bookmark.json"), _c('{"name": "', F.col("bookmark_id"), '", "explorationState": {"sections": {', F.col("s"), "}}}"))
    bad = _file(b, F.lit("S.Report/definition/bookmarks/x.bookmark.json"), F.lit('{"name": '))
    return pbir.bookmark_states(ok.unionByName(bad)).drop("snapshot_id")


def i8_report_measures(spark, sf):
    m = view(spark, sf, "b_measure")
    one = _c('{"name": "', F.col("name"), '", "expression": "[M', _s("i"), '] + 1"}')
    e = m.groupBy(*PK, "table_name").agg(F.array_join(F.collect_list(one), ", ").alias("m"))
    f = e.groupBy(*PK).agg(F.array_join(F.collect_list(_c('{"name": "', F.col("table_name"), '", "measures": [', F.col("m"), "]}")), ", ").alias("e"))
    return pbir.report_measures(_file(f, F.lit("S.Report/definition/reportExtensions.json"), _c('{"entities": [', F.col("e"), "]}"))).drop("snapshot_id")


def i9_filters(spark, sf):
    o = view(spark, sf, "orders").select(_c("P", (F.col("o_custkey") % 8).cast("string")).alias("project_id"), F.lit("s1").alias("snapshot_id"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    k = F.col("o_orderkey")
    lit = lambda v: _c('{"Literal": {"Value": "\'', v, "'\"}}")
    inn = _c('{"In": {"Values": [[', lit(F.col("o_orderpriority")), "], [", lit(F.col("o_orderstatus")), "]]}}")
    cond = F.when(k % 2 == 0, _c('{"Not": {"Expression": ', inn, "}}")).otherwise(inn)
    kind = F.when(k % 5 == 0, F.lit("Measure")).otherwise(F.lit("Column"))
    flt = _c('{"name": "f', _s("o_orderkey"), '", "type": "Categorical", "isHiddenInViewMode": ', F.when(k % 7 == 0, F.lit("true")).otherwise(F.lit("false")), ', "field": {"', kind, '": {"Expression": {"SourceRef": {"Entity": "T', (k % 4).cast("string"), '"}}, "Property": "p"}}, "filter": {"Where": [{"Condition": ', cond, "}]}}")
    path = F.when(k % 3 == 0, F.lit("S.Report/definition/report.json")).when(k % 3 == 1, F.lit("S.Report/definition/pages/p/page.json")).otherwise(_c("S.Report/definition/pages/p/visuals/", _s("o_orderkey"), "/visual.json"))
    body = F.when(k % 3 == 2, _c('{"filterConfig": {"filters": [', flt, "]}}")).otherwise(_c('{"filters": [', flt, "]}"))
    return pbir.filters(_file(o, path, body)).select("project_id", "level", "name", "entity", "property", "type", "is_hidden", _c(F.col("negated"), F.array_join("values", ",")).alias("values"))


def _tree(spark, sf):
    """Files of every kind and decoys, one an order."""
    o = view(spark, sf, "orders").select(_c("P", (F.col("o_custkey") % 8).cast("string")).alias("project_id"), F.lit("s1").alias("snapshot_id"), "o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    paths = ["S.SemanticModel/definition/tables/{}.tmdl", "S.SemanticModel/definition/cultures/{}.tmdl", "S.SemanticModel/definition/relationships{}.tmdl", "S{}/expressions.tmdl", "S.Report\\definition\\pages\\p\\visuals\\{}\\visual.json", "S.Report/definition/bookmarks/{}.bookmark.json", "S{}.Report/reportExtensions.json", "S.Report/definition/pages/{}/page.json", ".git/objects/{}.json", "S.SemanticModel/{}.abf", "S{}.Report/definition.pbir", "./S{}/.platform"]
    picked = F.element_at(F.array(*map(F.lit, paths)), (k % len(paths) + 1).cast("int"))
    text = F.when(k % len(paths) == 0, _c("table T", _s("o_orderkey"), "\n\tcolumn a\n")).otherwise(F.lit("{}"))
    return o.select(*PK, "o_orderkey", fs.normalised(F.replace(picked, F.lit("{}"), _s("o_orderkey"))).alias("path"), text.alias("content"))


def s1_wanted(spark, sf):
    return _tree(spark, sf).filter(fs.wanted(F.col("path"))).select("project_id", "path")


def s2_snapshots(spark, sf):
    """Two snapshots landed by partition; one is read back."""
    t = _tree(spark, sf)
    both = t.unionByName(t.filter("o_orderkey % 3 = 0").withColumn("snapshot_id", F.lit("s2")))
    sc = spark.sparkContext
    cut(t.limit(1))  # makes sure that the shared folder is set
    root = f"{sc.getCheckpointDir()}/snapshots-{uuid.uuid4().hex}"
    fs.write_snapshot(both, root)
    return fs.read_snapshots(spark, root, ["s2"]).select("project_id", "path", "snapshot_id")


def s3_kinds(spark, sf):
    return _tree(spark, sf).select("project_id", "path", fs.kind(F.col("path"), F.col("content")).alias("kind")).filter("kind is not null")


def s4_pairs(spark, sf):
    """A project with one report for each priority: pointers to a model, to one that is missing, and one that is no JSON."""
    o = view(spark, sf, "orders").select(_c("P", (F.col("o_custkey") % 8).cast("string")).alias("project_id"), F.lit("s1").alias("snapshot_id"), F.substring("o_orderpriority", 1, 1).alias("r"), "o_orderkey")
    vis = _file(o, _c("R", F.col("r"), ".Report/definition/pages/p/visuals/", _s("o_orderkey"), "/visual.json"), F.lit("{}"))
    r = o.select(*PK, "r").distinct()
    to = F.when(F.col("r") == "5", F.lit("{nothing")).otherwise(_c('{"datasetReference": {"byPath": {"path": "../', F.when(F.col("r") == "4", F.lit("Gone")).otherwise(F.lit("./x/../Sales")), '.SemanticModel"}}}'))
    model = r.select(*PK).distinct()
    all_ = vis.unionByName(_file(r, _c("R", F.col("r"), ".Report/definition.pbir"), to)).unionByName(_file(model, F.lit("Sales.SemanticModel/definition/model.tmdl"), F.lit("model")))
    return fs.report_pairs(all_).drop("snapshot_id")


def s5_json(spark, sf):
    """One versioned JSON document per project and table (a project's tables are its parts, so that no row holds a whole estate)."""
    m = view(spark, sf, "b_measure").groupBy("project_id", "table_name").agg(F.sort_array(F.collect_list(F.struct("i", "name"))).alias("measures"))
    doc = F.to_json(F.struct(F.lit(2).alias("version"), F.col("table_name").alias("table"), F.transform("measures", lambda x: x["name"]).alias("measures")))
    return m.select("project_id", "table_name", doc.alias("document"))


def s7_markdown(spark, sf):
    """A documentation section per table: a row for each column, pipes escaped, with its source."""
    c = view(spark, sf, "b_column")
    cell = lambda x: F.regexp_replace(F.regexp_replace(x, r"\|", "\\\\|"), r"[\r\n]+", " ")
    line = _c("| ", cell(F.col("name")), " | ", cell(_c("dbo|", F.col("source_column"))), " |")
    g = c.groupBy("project_id", "table_name").agg(F.sort_array(F.collect_list(F.struct("size", line.alias("t")))).alias("r"))
    return g.select("project_id", "table_name", _c("## ", F.col("table_name"), "\n\n| column | source |\n|-|-|\n", F.array_join(F.transform("r", lambda x: x.t), "\n"), "\n").alias("section"))


_PID = "'P' || o_custkey % 8 AS project_id"
_PATH = """t AS (SELECT 'P' || o_custkey % 8 AS project_id, o_orderkey AS k, CAST(o_orderkey % 12 AS INTEGER) AS f, ['S.SemanticModel/definition/tables/#.tmdl', 'S.SemanticModel/definition/cultures/#.tmdl', 'S.SemanticModel/definition/relationships#.tmdl', 'S#/expressions.tmdl', 'S.Report/definition/pages/p/visuals/#/visual.json', 'S.Report/definition/bookmarks/#.bookmark.json', 'S#.Report/reportExtensions.json', 'S.Report/definition/pages/#/page.json', '.git/objects/#.json', 'S.SemanticModel/#.abf', 'S#.Report/definition.pbir', 'S#/.platform'] AS ps FROM {orders}),
p AS (SELECT *, replace(ps[f + 1], '#', CAST(k AS STRING)) AS path FROM t)"""

_RAW = {
    "i1_columns": "SELECT project_id, table_name, name, CASE WHEN size % 3 = 0 THEN 'int64' ELSE 'string' END AS data_type, CASE WHEN size % 7 <> 0 THEN source_column END AS source_column, CASE WHEN size % 7 = 0 THEN '1 + ' || size END AS expression, size % 4 = 0 AS is_hidden, size % 7 = 0 AS is_calculated FROM {b_column}",
    "i1_measures": "SELECT project_id, table_name, name, 'VAR x = [M' || i || '] RETURN x + ' || size AS expression, is_hidden, '#,0' AS format_string FROM {b_measure}",
    "i1_partitions": """SELECT DISTINCT project_id, table_name, table_name AS name, 'm' AS type, 'import' AS mode, 'let S = "' || table_name || '" in S' AS m_body FROM {b_column}""",
    "i1_calculation_items": "SELECT DISTINCT project_id, table_name, unnest(['YTD ' || table_name, 'Now']) AS name, unnest(['CALCULATE(SELECTEDMEASURE(), D[x])', 'SELECTEDMEASURE()']) AS expression FROM {b_column} WHERE table_name LIKE '%5'",
    "i2_expressions": """SELECT 'P' || p_partkey % 8 AS project_id, CASE WHEN p_size % 2 = 0 THEN 'E ' ELSE 'E' END || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'parameter' ELSE 'expression' END AS kind, CASE WHEN p_size % 2 = 0 THEN '"' || p_name || '" meta [IsParameterQuery=true]' ELSE 'let S = ' || p_size || ' in S' END AS body, CASE WHEN p_size % 2 = 0 THEN p_name END AS value FROM {part}""",
    "i3_relationships": "SELECT project_id, from_table, 'k' AS from_column, to_table, 'k' AS to_column, cross_filter, is_active FROM {b_rel}",
    "i4_pages": "SELECT 'P' || c_custkey % 8 AS project_id, CASE WHEN c_custkey % 17 = 0 THEN 'p' ELSE 'page' END || c_custkey AS page_id, CASE WHEN c_custkey % 17 = 0 THEN 'p' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_custkey % 9 AS INTEGER) END AS ordinal, CASE WHEN c_custkey % 17 <> 0 AND c_custkey % 2 = 0 THEN CAST(800 AS DOUBLE) ELSE CAST(1280 AS DOUBLE) END AS width, CAST(720 AS DOUBLE) AS height FROM {customer}",
    "i5_visuals": "SELECT project_id, page_id, visual_id, CASE WHEN vkey % 6 < 2 THEN 'card' WHEN vkey % 6 < 5 THEN 'bar' ELSE 'group' END AS visual_type, title, is_hidden, parent_group, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height, CAST(CASE WHEN vkey % 6 < 3 THEN 1 + vkey % 4 ELSE 0 END AS INTEGER) AS bound_fields, CASE WHEN vkey % 6 = 5 THEN 'container' WHEN vkey % 6 = 3 THEN 'decoration' ELSE 'data' END AS role FROM {b_visual}",
    "i6_fields": "SELECT project_id, page_id, visual_id, 'measure' AS kind, 'T' AS table_name, 'M' || i AS name, ['query', 'value', 'format', 'title', 'filter', 'action', 'format'][min(via_rank) + 1] AS via FROM {b_field} GROUP BY project_id, page_id, visual_id, i",
    "i7_bookmarks": "SELECT project_id, bookmark_id, page_id, object_id, CASE WHEN length(object_id) % 2 = 0 THEN 'group' ELSE 'visual' END AS object_kind, max(state) AS state FROM {b_state} GROUP BY ALL",
    "i8_report_measures": "SELECT project_id, table_name, name, '[M' || i || '] + 1' AS expression FROM {b_measure}",
    "i9_filters": f"""SELECT {_PID}, ['report', 'page', 'visual'][o_orderkey % 3 + 1] AS level, 'f' || o_orderkey AS name, 'T' || o_orderkey % 4 AS entity, 'p' AS property, 'Categorical' AS type, o_orderkey % 7 = 0 AS is_hidden,
CASE WHEN o_orderkey % 2 = 0 THEN 'not ' ELSE '' END || array_to_string(list_sort(['''' || o_orderpriority || '''', '''' || o_orderstatus || '''']), ',') AS values FROM {{orders}}""",
    "s1_wanted": f"WITH {_PATH} SELECT project_id, path FROM p WHERE f NOT IN (8, 9)",
    "s2_snapshots": f"WITH {_PATH} SELECT project_id, path, 's2' AS snapshot_id FROM p WHERE k % 3 = 0",
    "s3_kinds": f"WITH {_PATH} SELECT project_id, path, CASE f WHEN 0 THEN 'table' WHEN 2 THEN 'relationship' WHEN 3 THEN 'expression' WHEN 4 THEN 'visual' WHEN 5 THEN 'bookmark' WHEN 6 THEN 'extension' ELSE 'page' END AS kind FROM p WHERE f IN (0, 2, 3, 4, 5, 6, 7, 10)",
    "s4_pairs": f"""WITH o AS (SELECT {_PID}, substr(o_orderpriority, 1, 1) AS r, count(*) AS visuals FROM {{orders}} GROUP BY ALL), q AS (SELECT project_id, 'R' || r || '.Report' AS report_root, CASE WHEN r = '4' THEN 'Gone' ELSE 'Sales' END || '.SemanticModel' AS model_root, r <> '4' AS "exists", visuals FROM o WHERE r <> '5')
SELECT *, "exists" AND row_number() OVER (PARTITION BY project_id ORDER BY CASE WHEN "exists" THEN 0 ELSE 1 END, visuals DESC, report_root) = 1 AS chosen FROM q""",
    "s5_json": """SELECT project_id, table_name, '{"version":2,"table":"' || table_name || '","measures":[' || string_agg('"' || name || '"', ',' ORDER BY i) || ']}' AS document FROM b_measure GROUP BY project_id, table_name""",
    "s7_markdown": """SELECT project_id, table_name, '## ' || table_name || chr(10) || chr(10) || '| column | source |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || name || ' | dbo' || chr(92) || '|' || source_column || ' |', chr(10) ORDER BY size) || chr(10) AS section FROM {b_column} GROUP BY project_id, table_name""",
}

QUERIES = {k: f for k, f in globals().items() if k in _RAW}
ORACLES = {k: oracle(q) for k, q in _RAW.items() if k != "s5_json"}
ORACLES["s5_json"] = oracle("SELECT * FROM {b_measure}").replace("SELECT * FROM b_measure", _RAW["s5_json"])
