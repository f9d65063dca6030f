"""The job from files to source map over model files that are written from table rows; projects grow with the tables.

Each supplier is a table of one of ten shapes, and a project holds forty: plain navigation, a chain of three shared expressions, an unread rename, a native
query, joined-in columns, Direct Lake, a table that reads another, a calculated table over two others, a calculation group, a projection.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estate
from ..operators import graph_build as build
from ..operators.common import PK, cut
from ..sources import export, pbir
from ..sources.files import kind
from .bridge import VIEWS, oracle, view

VIEWS["b_src"] = """SELECT 'P' || CAST(CAST(floor(s_suppkey / 40) AS BIGINT) AS STRING) AS project_id, 's1' AS snapshot_id, s_suppkey AS k, 'S ' || CAST(s_suppkey AS STRING) AS table_name,
  CAST(s_suppkey % 10 AS INT) AS shape, s_suppkey % 4 = 0 AS odd, lower(replace(n_name, ' ', '-')) AS nation FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey"""


def _fill(text: str):
    """A column of a text in which @ stands for the supplier's number, @@ for the one before the first of its ten and ~ for its nation."""
    k = F.col("k")
    filled = F.replace(F.lit(text), F.lit("@@"), (k - F.col("shape")).cast("string"))
    return F.replace(F.replace(filled, F.lit("@"), k.cast("string")), F.lit("~"), F.col("nation"))


_SQL = 'Source = Sql.Database("srv-~", Catalog),\n\t\t\t\t  Nav = Source{[Schema="dbo",Item="tab_@"]}[Data]'
_BODIES = {
    0: f'let\n\t\t\t\t  {_SQL}, // Table.PromoteHeaders\n\t\t\t\t  #"Renamed Columns" = Table.RenameColumns(Nav, {{{{"src_@", "c"}}}}),\n\t\t\t\t  Sorted = Table.Sort(#"Renamed Columns", {{"plain"}})\n\t\t\t\tin\n\t\t\t\t  Sorted',
    1: 'let\n\t\t\t\t  Source = #"Shared @",\n\t\t\t\t  Kept = Table.SelectRows(Source, each [plain] <> null)\n\t\t\t\tin\n\t\t\t\t  Kept',
    2: f"let\n\t\t\t\t  {_SQL},\n\t\t\t\t  Heads = Table.PromoteHeaders(Nav)\n\t\t\t\tin\n\t\t\t\t  Heads",
    3: 'let\n\t\t\t\t  Source = Value.NativeQuery(Sql.Database("srv-~", Catalog), "SELECT t.plain, t.b AS c FROM dbo.tab_@ t", null)\n\t\t\t\tin\n\t\t\t\t  Source',
    4: f'let\n\t\t\t\t  {_SQL},\n\t\t\t\t  Joined = Table.NestedJoin(Nav, {{"k"}}, #"Dim @", {{"k"}}, "dim", JoinKind.LeftOuter),\n\t\t\t\t  Wide = Table.ExpandTableColumn(Joined, "dim", {{"name"}}, {{"c"}}),\n\t\t\t\t  More = Table.NestedJoin(Wide, {{"k"}}, #"S @@", {{"k"}}, "more", JoinKind.Inner)\n\t\t\t\tin\n\t\t\t\t  More',
    6: 'let\n\t\t\t\t  Source = #"S @@",\n\t\t\t\t  Renamed = Table.RenameColumns(Source, {{"plain", "own"}})\n\t\t\t\tin\n\t\t\t\t  Renamed',
    9: f'let\n\t\t\t\t  {_SQL},\n\t\t\t\t  Added = Table.AddColumn(Nav, "c", each 1),\n\t\t\t\t  Kept = Table.SelectColumns(Added, {{"plain", "c"}})\n\t\t\t\tin\n\t\t\t\t  Kept',
}
_COLUMNS = {s: {"plain": "plain", "c": "c", "gone": "gone"} for s in (0, 1, 2, 3, 4, 5, 9)} | {6: {"own": "own", "c": "c", "plain": "plain"}, 7: {"plain": "'S @@'[plain]", "c": "[c]"}, 8: {"Name": "Name"}}


def model_files(spark, sf):
    """TMDL files: one for each table, one a project for relationships of nothing, one of expressions for each ten tables."""
    v = view(spark, sf, "b_src")
    parts, heads = F.lit(""), F.lit("")
    for shape, body in _BODIES.items():
        parts = F.when(F.col("shape") == shape, _fill(f"\tpartition 'S @' = m\n\t\tmode: import\n\t\tsource =\n\t\t\t\t{body}\n")).otherwise(parts)
    lake = _fill("\tpartition 'S @' = entity\n\t\tmode: directLake\n\t\tsource\n\t\t\tentityName: ent_@\n\t\t\tschemaName: dbo\n\t\t\texpressionSource: DirectLake - Lake ~\n")
    dax = F.concat(_fill("\tpartition 'S @' = calculated\n\t\tmode: import\n\t\tsource = UNION(DISTINCT('S @@'[plain]), DISTINCT('S "), (F.col("k") - 6).cast("string"), F.lit("'[plain]), DISTINCT('S "), F.col("k").cast("string"), F.lit("'[c]))\n"))
    group = F.lit("\tcalculationGroup\n\n\t\tcalculationItem YTD = CALCULATE(SELECTEDMEASURE())\n\n")
    parts = F.when(F.col("shape") == 5, lake).when(F.col("shape") == 7, dax).when(F.col("shape") == 8, group).otherwise(parts)
    for shape, cols in _COLUMNS.items():
        text = "".join(f"\tcolumn {name}\n\t\tdataType: string\n\t\tsourceColumn: {source}\n\n" for name, source in cols.items())
        heads = F.when(F.col("shape") == shape, _fill(text)).otherwise(heads)
    calc = F.when(F.col("odd"), F.lit("\tcolumn calc = 1 + 1\n\t\tdataType: int64\n\n")).otherwise(F.lit(""))
    tables = v.select(*PK, F.concat(F.lit("S.SemanticModel/definition/tables/"), "table_name", F.lit(".tmdl")).alias("path"), F.concat(F.lit("table '"), "table_name", F.lit("'\n\n"), heads, calc, parts).alias("content"))
    shared = _fill(f'expression \'Shared @\' =\n\t\tlet\n\t\t  Source = #"Middle @",\n\t\t  Renamed = Table.RenameColumns(Source, {{{{"src_@", "c"}}}})\n\t\tin\n\t\t  Renamed\n\nexpression \'Middle @\' =\n\t\tlet\n\t\t  Source = #"Base @"\n\t\tin\n\t\t  Source\n\nexpression \'Base @\' =\n\t\tlet\n\t\t  {_SQL}\n\t\tin\n\t\t  Nav\n')
    dim = _fill('expression \'Dim @\' =\n\t\tlet\n\t\t  Source = Sql.Database("srv-~", Catalog),\n\t\t  Nav = Source{[Schema="dbo",Item="dim_@"]}[Data]\n\t\tin\n\t\t  Nav\n')
    some = v.filter("shape = 1 or shape = 4 and not odd").select(*PK, F.concat(F.lit("S.SemanticModel/definition/"), F.col("k").cast("string"), F.lit("/expressions.tmdl")).alias("path"), F.when(F.col("shape") == 1, shared).otherwise(dim).alias("content"))
    catalog = v.select(*PK).distinct().select(*PK, F.lit("S.SemanticModel/definition/expressions.tmdl").alias("path"), F.concat(F.lit('expression Catalog = "db_'), F.lower("project_id"), F.lit('" meta [IsParameterQuery=true, Type="Text"]\n')).alias("content"))
    return tables.unionByName(some).unionByName(catalog)


def _landed(files):
    """The files as a table of their own: a small table of rows makes one task's worth of text, which is dealt out before it is read, and made once however often it is read."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by size they would be few: repeated text is small once packed, but slow to read
    return cut(files.repartition(n, *PK, "path"))


def j9_from_files(spark, sf):
    """Files to source map in one job."""
    return estate.source_map(_landed(model_files(spark, sf)))["columns"].select("project_id", "model_table", "model_column", "source_column", "physical_path", "origin", "confidence", F.array_join("also_from", ",").alias("also_from"))


def j2_spliced_steps(spark, sf):
    """Steps of each table with those of shared expressions in their place, in order, and the expression in which each is written."""
    g = estate.gold(_landed(model_files(spark, sf)))
    s = estate.ordered_steps(estate.spliced(estate.own_steps(g["bodies"]))).filter("kind = 'table'")
    return s.select("project_id", F.col("owner").alias("table_name"), "step_no", "name", "via")


def a2_from_files(spark, sf):
    """Coverage of each project's source map."""
    return estate.coverage(estate.source_map(_landed(model_files(spark, sf)))["columns"]).drop("snapshot_id")


def report_files(spark, sf):
    """Report JSON, and what the model has besides: measures, relationships, a calculated column, field parameters."""
    v = view(spark, sf, "b_src")
    k, shape = F.col("k").cast("string"), F.col("shape")
    before = (F.col("k") - 1).cast("string")
    at = lambda path, content, keep: v.filter(keep).select(*PK, path.alias("path"), content.alias("content"))
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    more = F.when(shape.between(1, 5), c(" + [M ", before, "]")).otherwise(F.lit(""))
    uses = F.when(shape == 2, c(" + CALCULATE([M ", k, "], USERELATIONSHIP('S ", k, "'[plain], 'S ", before, "'[plain])) // USERELATIONSHIP(A[b], C[d])")).otherwise(F.lit(""))
    calc = F.when(shape == 3, c("\tcolumn both = 'S ", k, "'[plain] & [M ", k, "]\n\n")).otherwise(F.lit(""))
    measures = at(c("S.SemanticModel/definition/tables/more ", k, ".tmdl"), c("table 'S ", k, "'\n\n\tmeasure 'M ", k, "' = SUM('S ", k, "'[plain])", more, uses, "\n\n", calc), shape.isin(0, 1, 2, 3, 4, 5, 9))
    first = (F.col("k") - shape).cast("string")
    params = at(c("S.SemanticModel/definition/tables/FP ", k, ".tmdl"), c("table 'FP ", k, "'\n\n\tpartition 'FP ", k, "' = calculated\n\t\tmode: import\n\t\tsource = {(\"Show\", NAMEOF('S ", first, "'[M ", first, "]), 0), (\"Other\", NAMEOF('S ", first, "'[plain]), 1), (\"None\", NAMEOF('S ", first, "'[Gone]), 2)}\n"), shape == 8)
    rel = v.filter("shape between 1 and 3").groupBy(*PK).agg(F.array_join(F.sort_array(F.collect_list(c("relationship r", k, "\n\tfromColumn: 'S ", k, "'.plain\n\ttoColumn: 'S ", before, "'.plain\n"))), "\n").alias("content"))
    rel = rel.select(*PK, F.lit("S.SemanticModel/definition/relationships.tmdl").alias("path"), "content")
    page = v.select(*PK).distinct().select(*PK, F.lit("S.Report/definition/pages/p/page.json").alias("path"), F.lit('{"name": "p", "displayName": "Page"}').alias("content"))
    field = lambda kind, table, name: c('{"', kind, '": {"Expression": {"SourceRef": {"Entity": "', table, '"}}, "Property": "', name, '"}}')
    own = c(field("Measure", c("S ", k), c("M ", k)), ", ", field("Column", c("S ", k), F.lit("plain")), F.when(shape == 3, c(", ", field("Measure", c("S ", k), F.lit("Gone")))).otherwise(F.lit("")))
    select = F.when(shape == 8, field("Column", c("FP ", k), c("FP ", k))).otherwise(own)
    visual = at(c("S.Report/definition/pages/p/visuals/v", k, "/visual.json"), c('{"name": "v', k, '", "visual": {"visualType": "card", "prototypeQuery": {"Select": [', select, "]}}}"), shape.isin(0, 1, 2, 3, 8))
    return measures.unionByName(params).unionByName(rel).unionByName(page).unionByName(visual)


def graph_of_files(files):
    """(gold tables, edges) of model and report files."""
    g = estate.gold(files)
    report = files.withColumn("kind", kind(F.col("path"), F.col("content"))).filter("kind in ('visual', 'page')")
    visuals = report.filter("kind = 'visual'")
    return g, build.edges(g, pbir.pages(report.filter("kind = 'page'")), pbir.visuals(visuals), pbir.visual_fields(visuals))


def g1_from_files(spark, sf):
    """Edges of all kinds, from the text of model and report files."""
    _, e = graph_of_files(_landed(model_files(spark, sf).unionByName(report_files(spark, sf))))
    return e.select("project_id", "source", "target", "type")


def s7_documents(spark, sf):
    """Documentation of each project, line by line, from files alone."""
    g, e = graph_of_files(_landed(model_files(spark, sf).unionByName(report_files(spark, sf))))
    return export.numbered(export.documents(estate.source_map(None, g), e)).drop("snapshot_id")


_T = "'db_' || lower(project_id) || '.dbo.tab_'"
_MAP = f"""WITH s AS (SELECT *, k - shape AS f FROM {{b_src}}), col(shape, name) AS (VALUES {", ".join(f"({s}, '{n}')" for s, cols in _COLUMNS.items() for n in cols)}),
c AS (SELECT s.*, name FROM s JOIN col USING (shape) UNION ALL SELECT s.*, 'calc' FROM s WHERE odd),
r AS (SELECT project_id, table_name AS model_table, name AS model_column, k, f, shape, odd, CASE WHEN shape = 8 THEN 'model-defined' WHEN name = 'calc' THEN 'computed-dax' WHEN shape = 9 AND name = 'c' THEN 'computed-pq'
WHEN shape IN (3, 9) AND name = 'gone' OR shape = 4 AND name = 'c' AND odd OR shape = 7 AND name = 'c' THEN 'unresolved' ELSE 'source' END AS origin,
CASE WHEN name IN ('own', 'plain') THEN 'plain' WHEN shape IN (0, 1) AND name = 'c' THEN 'src_' || k WHEN shape = 6 AND name = 'c' THEN 'src_' || f WHEN shape = 4 AND name = 'c' THEN 'name' ELSE name END AS source_column,
CASE WHEN shape = 5 THEN 'Lake ' || nation || '.dbo.ent_' || k WHEN shape IN (6, 7) THEN {_T} || f WHEN shape = 4 AND name = 'c' THEN 'db_' || lower(project_id) || '.dbo.dim_' || k ELSE {_T} || k END AS path FROM c),
m AS (SELECT project_id, model_table, model_column, CASE WHEN origin = 'source' THEN source_column END AS source_column, CASE WHEN origin = 'source' THEN path || '.' || source_column END AS physical_path, origin,
CASE WHEN origin = 'unresolved' THEN 'unknown' WHEN shape = 2 AND origin = 'source' THEN 'inferred' ELSE 'exact' END AS confidence, CASE WHEN shape = 7 AND model_column = 'plain' THEN {_T} || (f + 1) || '.plain' END AS also_from FROM r)"""
_STEPS = {
    0: ["Source", "Nav", "Renamed Columns", "Sorted"], 1: ["Source@Base", "Nav@Base", "Renamed@Shared", "Kept"], 2: ["Source", "Nav", "Heads"], 3: ["Source"], 4: ["Source", "Nav", "Joined", "Wide", "More"], 6: ["Source", "Renamed"], 9: ["Source", "Nav", "Added", "Kept"],
}
_ROWS = ", ".join(f"({s}, {no}, '{n.partition('@')[0]}', {repr(n.partition('@')[2]) if '@' in n else 'NULL'})" for s, names in _STEPS.items() for no, n in enumerate(names))
_RAW = {
    "j9_from_files": _MAP + " SELECT * FROM m",
    "j2_spliced_steps": f"WITH st(shape, step_no, name, ex) AS (VALUES {_ROWS}) SELECT project_id, table_name, step_no, st.name, ex || ' ' || k AS via FROM {{b_src}} s JOIN st ON st.shape = s.shape",
    "a2_from_files": _MAP + """ SELECT project_id, count(*) AS total, count(*) FILTER (confidence = 'exact') AS exact, count(*) FILTER (confidence = 'inferred') AS inferred, count(*) FILTER (confidence = 'unknown') AS unknown, count(*) FILTER (origin = 'source') AS sourced,
count(*) FILTER (origin = 'unresolved') AS unresolved, count(*) FILTER (origin = 'model-defined') AS model_defined, count(*) FILTER (origin LIKE 'computed%') AS computed,
CASE WHEN count(*) FILTER (origin IN ('source', 'unresolved')) = 0 THEN 0.0 ELSE round(count(*) FILTER (origin = 'source')::DOUBLE / count(*) FILTER (origin IN ('source', 'unresolved')), 3) END AS coverage FROM m GROUP BY project_id""",
}
_S, _C, _ME = "'table::S ' || k", "'column::S ' || k || '.", "'measure::S ' || k || '.M ' || k"
_B = {x: y.replace("|| k", "|| (k - 1)") for x, y in {"S": _S, "C": _C, "M": _ME}.items()}
_F = {x: y.replace("|| k", "|| f") for x, y in {"S": _S, "C": _C, "M": _ME}.items()}
_SRC = "'source::srv-' || nation || '/db_' || lower(project_id)"
_V = "'visual::p/v' || k"
_EDGES = [
    ("column_to_table", f"'column::' || table_name || '.' || name", "'table::' || table_name", "(SELECT s.*, name FROM s JOIN col USING (shape) UNION ALL SELECT s.*, 'calc' FROM s WHERE odd UNION ALL SELECT s.*, 'both' FROM s WHERE shape = 3)", "true"),
    ("measure_to_column", _ME, f"{_C}plain'", "s", "shape IN (0, 1, 2, 3, 4, 5, 9)"), ("measure_to_measure", _ME, _B["M"], "s", "shape BETWEEN 1 AND 5"), ("measure_to_column", _ME, f"{_B['C']}plain'", "s", "shape = 2"),
    ("measure_to_userelationship", _ME, f"{_C}plain'", "s", "shape = 2"), ("measure_to_userelationship", _ME, f"{_B['C']}plain'", "s", "shape = 2"),
    ("calc_column_to_column", f"{_C}both'", f"{_C}plain'", "s", "shape = 3"), ("calc_column_to_measure", f"{_C}both'", _ME, "s", "shape = 3"), ("table_relationship", _S, _B["S"], "s", "shape BETWEEN 1 AND 3"),
    ("expression_to_source", "'expression::Base ' || k", _SRC, "s", "shape = 1"), ("expression_to_source", "'expression::Dim ' || k", _SRC, "s", "shape = 4 AND NOT odd"), ("table_to_source", _S, _SRC, "s", "shape IN (0, 2, 3, 4, 9)"),
    ("table_to_expression", _S, "'expression::Shared ' || k", "s", "shape = 1"), ("table_to_expression", _S, "'expression::Dim ' || k", "s", "shape = 4 AND NOT odd"), ("table_to_table_join", _S, _F["S"], "s", "shape = 4"),
    ("visual_to_page", _V, "'page::p'", "s", "shape IN (0, 1, 2, 3, 8)"), ("visual_to_field", _V, _ME, "s", "shape IN (0, 1, 2, 3)"), ("visual_to_field", _V, f"{_C}plain'", "s", "shape IN (0, 1, 2, 3)"), ("visual_to_field", _V, "'measure::S ' || k || '.Gone'", "s", "shape = 3"),
    ("visual_to_field", _V, "'table::FP ' || k", "s", "shape = 8"), ("field_param_to_field", "'table::FP ' || k", _F["M"], "s", "shape = 8"), ("field_param_to_field", "'table::FP ' || k", f"{_F['C']}plain'", "s", "shape = 8"),
]
_RAW["g1_from_files"] = _MAP.split(",\nc AS (")[0] + " " + " UNION ALL ".join(f"SELECT project_id, {a} AS source, {b} AS target, '{t}' AS type FROM {src} WHERE {when}" for t, a, b, src, when in _EDGES)
_KIND_OF = {"Source": "Source", "Nav": "Navigation", "Renamed Columns": "Rename", "Renamed": "Rename", "Sorted": "Custom", "Heads": "Custom", "Joined": "Join", "More": "Join", "Wide": "Expand", "Added": "AddColumn"}


def _kind(shape: int, no: int, name: str) -> str:
    if name == "Kept":
        return {1: "Filter", 9: "Projection"}[shape]
    return "Custom" if (shape, no) == (6, 0) else _KIND_OF[name]


_KINDS = ", ".join(f"({s}, {no + 1}, '{n.partition('@')[0]}', '{_kind(s, no, n.partition('@')[0])}')" for s, names in _STEPS.items() for no, n in enumerate(names))
# lines by section, part, sub-part and place; rows of one table are put in order at the end
_RAW["s7_documents"] = _MAP + f""", st(shape, no, step, kind) AS (VALUES {_KINDS}),
cols AS (SELECT * FROM m UNION ALL SELECT project_id, table_name, 'both', NULL, NULL, 'computed-dax', 'exact', NULL FROM s WHERE shape = 3),
tab AS (SELECT project_id, table_name, k, shape, CASE WHEN shape IN (0, 1, 2, 3, 4, 9) THEN {_T} || k WHEN shape = 5 THEN 'Lake ' || nation || '.dbo.ent_' || k END AS path FROM s),
ms AS (SELECT project_id, table_name, 'M ' || k AS name, k, shape, 'SUM(''S ' || k || '''[plain])' || CASE WHEN shape BETWEEN 1 AND 5 THEN ' + [M ' || (k - 1) || ']' ELSE '' END || CASE WHEN shape = 2 THEN ' + CALCULATE([M ' || k || '], USERELATIONSHIP(''S ' || k || '''[plain], ''S ' || (k - 1) || '''[plain])) // USERELATIONSHIP(A[b], C[d])' ELSE '' END AS dax, CASE WHEN shape < 4 THEN '1 visuals' ELSE '_no visual_' END AS shown FROM s WHERE shape IN (0, 1, 2, 3, 4, 5, 9)),
n AS (SELECT p.project_id, (SELECT count(*) FROM tab t WHERE t.project_id = p.project_id) AS t, (SELECT count(*) FROM cols t WHERE t.project_id = p.project_id) AS c, (SELECT count(*) FROM ms t WHERE t.project_id = p.project_id) AS m, (SELECT count(*) FROM s t WHERE t.project_id = p.project_id AND shape BETWEEN 1 AND 3) AS r FROM (SELECT DISTINCT project_id FROM s) p),
q AS (SELECT project_id, count(*) FILTER (origin = 'source') AS a, count(*) FILTER (origin IN ('source', 'unresolved')) AS b, count(*) FILTER (confidence = 'exact') AS e, count(*) FILTER (confidence = 'inferred') AS i, count(*) FILTER (confidence = 'unknown') AS u FROM cols GROUP BY project_id),
nc AS (SELECT project_id, model_table AS table_name, count(*) AS c FROM cols GROUP BY ALL),
l AS (SELECT project_id, 10 AS section, '' AS part, '' AS sub, unnest(range(6)) AS pos, unnest(['# Model', '', '## Overview', '', '|  | Count |', '|-|-|']) AS line FROM n
UNION ALL SELECT * FROM (SELECT project_id, 11, '', '', unnest(range(4)) AS z, unnest(['| Tables | ' || t || ' |', '| Columns | ' || c || ' |', '| Measures | ' || m || ' |', CASE WHEN r > 0 THEN '| Relationships | ' || r || ' |' END]) AS x FROM n) WHERE x IS NOT NULL
UNION ALL SELECT project_id, 12, '', '', unnest(range(7)), unnest(['', '**' || a || ' of ' || b || ' columns** that read from a source are traced to a physical column. Confidence: ' || e || ' stated, ' || i || ' assumed, ' || u || ' unresolved.', '', '## Tables', '', '| Table | Physical source | Columns | Measures |', '|-|-|-|-|']) FROM q
UNION ALL SELECT tab.project_id, 13, tab.table_name, '', 0, '| ' || tab.table_name || ' | ' || coalesce(path, '_unresolved_') || ' | ' || c || ' | ' || CASE WHEN shape IN (0, 1, 2, 3, 4, 5, 9) THEN 1 ELSE 0 END || ' |' FROM tab JOIN nc ON nc.project_id = tab.project_id AND nc.table_name = tab.table_name
UNION ALL SELECT * FROM (SELECT project_id, 20, table_name, '', unnest(range(7)) AS z, unnest(['', '### ' || table_name, CASE WHEN path IS NOT NULL THEN '' END, '**Source:** `' || path || '`', '', '| Column | Physical column | Type | Confidence |', '|-|-|-|-|']) AS x FROM tab) WHERE x IS NOT NULL
UNION ALL SELECT project_id, 20, model_table, model_column, 10, '| ' || model_column || ' | ' || coalesce(physical_path, '_unresolved_') || ' | ' || CASE model_column WHEN 'calc' THEN 'int64' WHEN 'both' THEN '' ELSE 'string' END || ' | ' || CASE confidence WHEN 'exact' THEN '●' WHEN 'inferred' THEN '◐' ELSE '○' END || ' ' || confidence || ' |' FROM cols
UNION ALL SELECT project_id, 21, table_name, '', unnest(range(3)), unnest(['', '| # | Step | Kind |', '|-|-|-|']) FROM tab WHERE shape IN (SELECT shape FROM st)
UNION ALL SELECT project_id, 21, table_name, '', 10 + no, '| ' || no || ' | ' || step || ' | ' || kind || ' |' FROM tab JOIN st USING (shape)
UNION ALL SELECT project_id, 30, '', '', unnest(range(5)), unnest(['', '## Measures', '', '| Measure | Table | Shown in |', '|-|-|-|']) FROM n
UNION ALL SELECT project_id, 31, table_name, name, 0, '| ' || name || ' | ' || table_name || ' | ' || shown || ' |' FROM ms
UNION ALL SELECT project_id, 40, table_name, name, unnest(range(6)), unnest(['', '### ' || table_name || '[' || name || ']', '', '```dax', dax, '```']) FROM ms)
SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY CASE section WHEN 21 THEN 20 ELSE section END, part, section, CASE WHEN section = 20 AND sub <> '' THEN 1 ELSE 0 END, sub, pos) AS INTEGER) AS line_no, line FROM l"""
QUERIES = {k: f for k, f in globals().items() if k in _RAW}
ORACLES = {k: oracle(q) for k, q in _RAW.items()}
