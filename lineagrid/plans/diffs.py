"""Queries of the snapshot diff over the bridge views: keys that end in 0 are missing before, those that end in 1 after; every seventh value changes, every thirteenth in white space only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import diff as d
from ..operators.common import PK, cut, node_id
from . import graphs
from .bridge import oracle, view

_P = ["project_id"]


def _snapshots(df: DataFrame, key: str, value):
    """The before and after sides of rows with an integer key and a value."""
    k = F.col(key)
    before = df.filter(k % 10 != 0).withColumn("value", value)
    changed = F.when(k % 7 == 0, F.concat(value, F.lit(" v2"))).when(k % 13 == 0, F.concat(F.lit(" "), F.regexp_replace(value, " ", "  \n"))).otherwise(value)
    return before, df.filter(k % 10 != 1).withColumn("value", changed)


def _plain(key: str, value: str) -> tuple[str, str]:
    """The same in SQL: (before value, after value); white-space changes are left out as they compare equal."""
    return value, f"CASE WHEN {key} % 7 = 0 THEN {value} || ' v2' ELSE {value} END"


def _measures(spark, sf):
    return _snapshots(view(spark, sf, "part").select((F.col("p_partkey") % 8).alias("project_id"), "p_partkey", F.col("p_brand").alias("table_name"), F.concat(F.lit("M"), F.floor(F.col("p_partkey") / 8)).alias("name"), "p_name", "p_type", "p_size"), "p_partkey", F.col("p_name"))


def _out(df, *keys):
    return df.select("project_id", *keys, "type", d.normalised(F.col("before_value")).alias("before_value"), d.normalised(F.col("after_value")).alias("after_value"))


def d1_measures(spark, sf):
    b, a = _measures(spark, sf)
    return _out(d.keyed_diff(b, a, ["project_id", "table_name", "name"], "value", "measure", normalise=True), "table_name", "name")


def d2_calculation_items(spark, sf):
    b, a = (x.withColumn("calc_group", F.concat(F.lit("CG"), F.col("p_size") % 5)) for x in _measures(spark, sf))
    return _out(d.keyed_diff(b, a, ["project_id", "calc_group", "name"], "value", "calculation_item", normalise=True), "calc_group", "name")


def d3_columns(spark, sf):
    p = view(spark, sf, "part").select((F.col("p_partkey") % 8).alias("project_id"), "p_partkey", F.col("p_brand").alias("table_name"), F.concat(F.lit("c"), F.col("p_partkey")).alias("name"))
    k = F.col("p_partkey")
    kind = lambda v: F.when(k % 11 == 0, "").when(v, "int64").otherwise("string")
    b = p.filter(k % 10 != 0).withColumn("data_type", kind(F.lit(False)))
    a = p.filter(k % 10 != 1).withColumn("data_type", kind(k % 7 == 0))
    return _out(d.keyed_diff(b, a, ["project_id", "table_name", "name"], "data_type", "column", both_known=True), "table_name", "name")


def d4_relationships(spark, sf):
    x = view(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 8).alias("project_id"), F.concat(F.lit("T"), F.col("l_suppkey"), F.lit(".k->T"), F.col("l_partkey"), F.lit(".k")).alias("name")).agg(F.min("l_orderkey").alias("k"))
    b = x.filter("k % 10 <> 0").withColumn("cross_filter", F.lit("single"))
    a = x.filter("k % 10 <> 1").withColumn("cross_filter", F.when(F.col("k") % 7 == 0, "both").otherwise("single"))
    return _out(d.keyed_diff(b, a, ["project_id", "name"], "cross_filter", "relationship"), "name")


def d5_partitions(spark, sf):
    b, a = _measures(spark, sf)
    return _out(d.keyed_diff(b, a, ["project_id", "table_name", "name"], "value", "partition_source", added=False, normalise=True), "table_name", "name")


def d6_expressions(spark, sf):
    p = view(spark, sf, "part").select((F.col("p_partkey") % 8).alias("project_id"), "p_partkey", F.concat(F.lit("E"), F.col("p_partkey")).alias("name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"'), F.col("p_name"), F.lit('" meta [IsParameterQuery=true]'))).otherwise(F.concat(F.lit("let S = "), F.col("p_name"), F.lit(" in S"))).alias("body"))
    k, v2 = F.col("p_partkey"), F.regexp_replace("body", r'^"', '"new ')
    b = p.filter(k % 10 != 0)
    a = p.filter(k % 10 != 1).withColumn("body", F.when(k % 7 == 0, F.when(F.col("body").startswith('"'), v2).otherwise(F.concat("body", F.lit(" v2")))).when(k % 13 == 0, F.concat(F.lit("\n "), "body")).otherwise(F.col("body")))
    out = d.keyed_diff(b, a, ["project_id", "name"], "body", "expression", added=False, normalise=True)
    both = d.parameter_like(F.col("before_value")) & d.parameter_like(F.col("after_value"))
    return out.select("project_id", "name", F.when(both, "parameter_changed").otherwise("expression_changed").alias("type"))


def d7_pages(spark, sf):
    p = view(spark, sf, "customer").select((F.col("c_custkey") % 8).alias("project_id"), "c_custkey", F.col("c_custkey").cast("string").alias("page_id"), F.col("c_name").alias("name"))
    b, a = p.filter("c_custkey % 10 <> 0"), p.filter("c_custkey % 10 <> 1")
    pages = d.keyed_diff(b, a, ["project_id", "page_id"], "name", "page")
    first = lambda x: x.groupBy("project_id").agg(F.min("c_custkey").cast("string").alias("page"))
    default = d.keyed_diff(first(b), first(a), _P, "page", "default_page", added=False).withColumn("page_id", F.lit(None).cast("string"))
    return _out(pages.unionByName(default), "page_id")


def _filters(spark, sf):
    """(project_id, level, name, values): one filter an order, on the report, its page or its visual."""
    o = view(spark, sf, "orders").join(view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("v"), F.col("l_linenumber")).alias("v")), "o_orderkey")
    g = o.groupBy((F.col("o_custkey") % 8).alias("project_id"), "o_orderkey").agg(F.sort_array(F.collect_set("v")).alias("values"))
    k = F.col("o_orderkey")
    g = g.withColumn("level", F.element_at(F.array(F.lit("report"), F.lit("page"), F.lit("visual")), (k % 3 + 1).cast("int"))).withColumn("name", F.concat(F.lit("f"), k))
    after = F.when(k % 7 == 0, F.concat(F.slice("values", 2, 99), F.array(F.lit("new")))).otherwise(F.col("values"))
    return g.filter(k % 10 != 0), g.filter(k % 10 != 1).withColumn("values", after)


def d8_filters(spark, sf):
    b, a = _filters(spark, sf)
    keys = ["project_id", "level", "name"]
    text = lambda x: x.withColumn("text", F.array_join("values", ","))
    changes = d.keyed_diff(text(b), text(a), keys, "text", "filter")
    items = d.set_diff(b, a, keys, "values")
    return changes.join(items, keys, "left").select(*keys, "type", F.array_join("gained", ",").alias("selected"), F.array_join("lost", ",").alias("deselected"))


def d9_visuals(spark, sf):
    v = view(spark, sf, "b_visual").select("project_id", "page_id", "visual_id", "vkey", "is_hidden")
    k = F.col("vkey")
    b, a = v.filter(k % 10 != 0), v.filter(k % 10 != 1).withColumn("is_hidden", F.when(k % 7 == 0, ~F.col("is_hidden")).otherwise(F.col("is_hidden")))
    keys = ["project_id", "page_id", "visual_id"]
    out = d.keyed_diff(b, a, keys, "is_hidden", "visual")
    kind = F.when(F.col("type") != "visual_changed", F.col("type")).when(F.col("after_value") == "true", "visual_hidden").otherwise("visual_unhidden")
    return out.select(*keys, kind.alias("type"))


def d9_bindings(spark, sf):
    f = view(spark, sf, "b_field").select("project_id", "page_id", "visual_id", "i").distinct()
    fields = lambda x: x.groupBy("project_id", "page_id", "visual_id").agg(F.collect_set(F.concat(F.lit("M"), F.col("i"))).alias("fields"))
    b, a = fields(f.filter("i % 10 <> 0")), fields(f.filter("i % 10 <> 1"))
    keys = ["project_id", "page_id", "visual_id"]
    return d.set_diff(b, a, keys, "fields").select(*keys, F.array_join("gained", ",").alias("gained"), F.array_join("lost", ",").alias("lost"))


def d10_bookmarks(spark, sf):
    e = view(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 50).alias("bookmark")).agg(F.min("user_id").alias("section"), F.min("event_type").alias("target"))
    e = e.select((F.col("bookmark") % 8).alias("project_id"), "bookmark", F.col("section").cast("string").alias("section"), "target")
    k = F.col("bookmark")
    b, a = e.filter(k % 10 != 0), e.filter(k % 10 != 1).withColumns({"section": F.when(k % 7 == 0, F.concat("section", F.lit("x"))).otherwise(F.col("section")), "target": F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("target"))})
    keys = ["project_id", "bookmark"]
    parts = [d.keyed_diff(b, a, keys, "section", "bookmark").withColumn("what", F.lit("section")), d.keyed_diff(b, a, keys, "target", "bookmark", added=False).withColumn("what", F.lit("target"))]
    return reduce(DataFrame.unionByName, parts).select(*keys, "what", "type", "before_value", "after_value")


def d9_bookmark_refs(spark, sf):
    """Buttons whose bookmarks change: the ids are read from the visuals' JSON."""
    v = view(spark, sf, "b_visual").select("project_id", "page_id", "visual_id", "vkey")
    k = F.col("vkey")
    name = lambda x: F.concat(F.lit("Bookmark"), F.substring(F.md5(x.cast("string")), 1, 20))
    body = lambda other: F.concat(F.lit('{"visual": {"visualContainerObjects": {"visualLink": [{"properties": {"bookmark": {"expr": {"Literal": {"Value": "\''), name(k), F.lit("'\"}}}}}, {\"a\": \""), name(other), F.lit('"}]}}}'))
    side = lambda df, other: df.select("project_id", "page_id", "visual_id", d.bookmark_refs(body(other)).alias("refs"))
    keys = ["project_id", "page_id", "visual_id"]
    out = d.set_diff(side(v.filter(k % 10 != 0), k + 1), side(v.filter(k % 10 != 1), F.when(k % 7 == 0, k + 2).when(k % 13 == 0, k).otherwise(k + 1)), keys, "refs")
    return out.select(*keys, F.array_join("gained", ",").alias("gained"), F.array_join("lost", ",").alias("lost"))


def d10_overrides(spark, sf):
    """What changes within bookmarks, by path: filter overrides, targets and sections out of their JSON."""
    e = view(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 50).alias("bookmark")).agg(F.min("user_id").alias("user"), F.min("event_type").alias("kind"))
    e = e.select((F.col("bookmark") % 8).alias("project_id"), "bookmark", F.col("user").cast("string").alias("user"), "kind")
    k = F.col("bookmark")

    def text(section, value, more, swapped):
        c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
        by_name = F.when(swapped, c('{"g": {"n": null}, "f": {"op": "In", "v": [1, ', value, "]}}")).otherwise(c('{"f": {"op": "In",  "v": [1, ', value, ']}, "g": {"n": null}}'))
        return c('{"displayName": "B ', k.cast("string"), ' \\"q\\"", "options": {"targetVisualNames": ["v1"', more, ']}, "unused": ', value, ', "explorationState": {"activeSection": "', section, '", "filters": {"byName": ', by_name, ', "byExpr": [{"e": "', F.col("kind"), '"}]}}}')

    none = F.lit("")
    b = e.filter(k % 10 != 0).select("project_id", "bookmark", d.bookmark_summary(text(F.col("user"), F.lit("2"), none, F.lit(False))).alias("text"))
    a = e.filter(k % 10 != 1).select("project_id", "bookmark", d.bookmark_summary(text(F.when(k % 11 == 0, F.concat("user", F.lit("x"))).otherwise(F.col("user")), F.when(k % 7 == 0, "3").otherwise("2"), F.when(k % 13 == 0, ', "v2"').otherwise(""), k % 3 == 0)).alias("text"))
    return d.path_diff(b, a, ["project_id", "bookmark"], "text", "bookmark").select("project_id", "bookmark", "path", "type", "before_value", "after_value")


# what each detector reports: scope -> (detector, columns that name what changed)
_DETECTORS = {
    "page": ("d7_pages", ["page_id"]), "filter": ("d8_filters", ["level", "name"]), "visual": ("d9_visuals", ["page_id", "visual_id"]), "binding": ("d9_bindings", ["page_id", "visual_id"]),
    "bookmark": ("d10_bookmarks", ["bookmark", "what"]), "measure": ("d1_measures", ["table_name", "name"]), "calculation_item": ("d2_calculation_items", ["calc_group", "name"]),
    "column": ("d3_columns", ["table_name", "name"]), "relationship": ("d4_relationships", ["name"]), "partition": ("d5_partitions", ["table_name", "name"]), "expression": ("d6_expressions", ["name"]),
}


def _all_changes(spark, sf):
    """(project_id, scope, type, target): the changes of every detector."""
    parts = []
    for scope, (detector, keys) in _DETECTORS.items():
        c = globals()[detector](spark, sf)
        kind = F.col("type") if "type" in c.columns else F.lit("bindings_changed")
        project = F.concat(F.lit("P"), F.ltrim(F.col("project_id").cast("string"), F.lit("P")))
        parts.append(c.select(project.alias("project_id"), F.lit(scope).alias("scope"), kind.alias("type"), F.concat_ws(".", *keys).alias("target")))
    return reduce(DataFrame.unionByName, parts)


def a7_summary(spark, sf):
    return d.summary(_all_changes(spark, sf), _P)


def _missing_after(spark, sf):
    """(pk, node): measures that the after side doesn't have."""
    key = F.col("i") * 8 + F.expr("CAST(substring(project_id, 2) AS BIGINT)")
    return view(spark, sf, "b_measure").filter(key % 10 == 1).select(*PK, node_id("measure", F.col("table_name"), F.col("name")).alias("node"))


def d11_changes(spark, sf):
    """All changes; those of measures and calculation items with the visuals that they reach in the after snapshot: at all, by a field parameter, under a calculation group.

    The walk starts from what has changed alone, over the graph of the after side: what is removed has no impact, and what only it led to isn't reached.
    """
    changes = cut(_all_changes(spark, sf))
    gone = cut(_missing_after(spark, sf))
    edges = graphs.routed_edges(spark, sf)
    for end in ("source", "target"):
        edges = edges.join(gone.withColumnRenamed("node", end), [*PK, end], "left_anti")
    node = F.when(F.col("scope") == "measure", F.concat(F.lit("measure::"), "target")).when(F.col("scope") == "calculation_item", F.split_part("target", F.lit("."), F.lit(1)))
    changes = changes.withColumn("node", node)
    seeds = changes.filter("scope = 'measure'").select("project_id", F.lit("s1").alias("snapshot_id"), F.col("node").alias("seed")).distinct().join(gone.withColumnRenamed("node", "seed"), [*PK, "seed"], "left_anti")
    applied = view(spark, sf, "b_applied").select(*PK, graphs._visual_id())
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n_visuals")).otherwise(0))
    by_measure = graphs.impact_counts(edges, seeds, applied).groupBy("project_id", F.lit("measure").alias("scope"), F.col("seed").alias("node")).agg(of("direct").alias("direct"), of("field_parameter").alias("parameter"), of("calculation_group").alias("grouped"))
    by_group = view(spark, sf, "b_applied").groupBy("project_id", F.lit("calculation_item").alias("scope"), F.col("calc_group").alias("node")).agg(F.lit(0).alias("direct"), F.lit(0).alias("parameter"), F.count("*").alias("grouped"))
    out = changes.join(by_measure.unionByName(by_group), ["project_id", "scope", "node"], "left")
    return out.select("project_id", "scope", "type", "target", *(F.coalesce(c, F.lit(0)).cast("long").alias(f"n_{c}") for c in ("direct", "parameter", "grouped")))


def x21_normalise(spark, sf):
    b, a = _measures(spark, sf)
    lit = F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))
    return a.select("project_id", "name", d.normalised(F.col("value")).alias("value"), d.parameter_like(F.when(F.col("p_size") % 2 == 0, lit).otherwise(F.col("p_name"))).alias("is_parameter"))


def _diff(src: str, keys: str, key: str, before: str, after: str, scope: str, how: str = "FULL", extra: str = "") -> str:
    cols = ", ".join(f"coalesce(b.{k}, a.{k}) AS {k}" for k in keys.split(", "))
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""WITH s AS ({src}), b AS (SELECT *, {before} AS v FROM s WHERE {key} % 10 <> 0), a AS (SELECT *, {after} AS v FROM s WHERE {key} % 10 <> 1),
x AS (SELECT {cols}, CASE WHEN b.{key} IS NULL THEN '{scope}_added' WHEN a.{key} IS NULL THEN '{scope}_removed' WHEN b.v IS DISTINCT FROM a.v {extra} THEN '{scope}_changed' END AS type, coalesce(CAST(b.v AS STRING), '') AS before_value, coalesce(CAST(a.v AS STRING), '') AS after_value
FROM b {how} JOIN a ON {on}) SELECT * FROM x WHERE type IS NOT NULL"""


_PART = "SELECT p_partkey % 8 AS project_id, p_partkey, p_brand AS table_name, 'M' || CAST(floor(p_partkey / 8) AS BIGINT) AS name, p_name, 'CG' || p_size % 5 AS calc_group, p_size FROM {part}"
_VIS = _diff("SELECT project_id, page_id, visual_id, vkey, is_hidden FROM {b_visual}", "project_id, page_id, visual_id", "vkey", "is_hidden", "CASE WHEN vkey % 7 = 0 THEN NOT is_hidden ELSE is_hidden END", "visual")
_PAGES = _diff("SELECT c_custkey % 8 AS project_id, c_custkey, CAST(c_custkey AS STRING) AS page_id, c_name FROM {customer}", "project_id, page_id", "c_custkey", "c_name", "c_name", "page")
_MEASURES = _diff(_PART, "project_id, table_name, name", "p_partkey", *_plain("p_partkey", "p_name"), "measure")
_DEFAULT = """SELECT b.project_id, NULL AS page_id, 'default_page_changed' AS type, CAST(b.m AS STRING) AS before_value, CAST(a.m AS STRING) AS after_value FROM
(SELECT c_custkey % 8 AS project_id, min(c_custkey) AS m FROM {customer} WHERE c_custkey % 10 <> 0 GROUP BY 1) b JOIN (SELECT c_custkey % 8 AS project_id, min(c_custkey) AS m FROM {customer} WHERE c_custkey % 10 <> 1 GROUP BY 1) a ON a.project_id = b.project_id AND a.m <> b.m"""
_BM = """WITH s AS (SELECT bm % 8 AS project_id, bm AS bookmark, CAST(u AS STRING) AS section, t AS target FROM (SELECT CAST(floor(event_id / 50) AS BIGINT) AS bm, min(user_id) AS u, min(event_type) AS t FROM {events} GROUP BY 1)),
b AS (SELECT * FROM s WHERE bookmark % 10 <> 0), a AS (SELECT project_id, bookmark, CASE WHEN bookmark % 7 = 0 THEN section || 'x' ELSE section END AS section, CASE WHEN bookmark % 13 = 0 THEN NULL ELSE target END AS target FROM s WHERE bookmark % 10 <> 1),
x AS (SELECT coalesce(b.project_id, a.project_id) AS project_id, coalesce(b.bookmark, a.bookmark) AS bookmark, 'section' AS what, CASE WHEN b.bookmark IS NULL THEN 'bookmark_added' WHEN a.bookmark IS NULL THEN 'bookmark_removed' WHEN a.section <> b.section THEN 'bookmark_changed' END AS type, b.section AS before_value, a.section AS after_value FROM b FULL JOIN a ON a.bookmark = b.bookmark
UNION ALL SELECT b.project_id, b.bookmark, 'target', CASE WHEN a.target IS DISTINCT FROM b.target THEN 'bookmark_changed' END, b.target, a.target FROM b JOIN a ON a.bookmark = b.bookmark) SELECT * FROM x WHERE type IS NOT NULL"""

_RAW = {
    "d1_measures": _MEASURES,
    "d2_calculation_items": _diff(_PART, "project_id, calc_group, name", "p_partkey", *_plain("p_partkey", "p_name"), "calculation_item"),
    "d3_columns": _diff("SELECT p_partkey % 8 AS project_id, p_partkey, p_brand AS table_name, 'c' || p_partkey AS name FROM {part}", "project_id, table_name, name", "p_partkey", "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'string' END", "CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN 'int64' ELSE 'string' END", "column"),
    "d4_relationships": _diff("SELECT l_orderkey % 8 AS project_id, 'T' || l_suppkey || '.k->T' || l_partkey || '.k' AS name, min(l_orderkey) AS k FROM {lineitem} GROUP BY 1, 2", "project_id, name", "k", "'single'", "CASE WHEN k % 7 = 0 THEN 'both' ELSE 'single' END", "relationship"),
    "d5_partitions": _diff(_PART, "project_id, table_name, name", "p_partkey", *_plain("p_partkey", "p_name"), "partition_source", "INNER"),
    "d6_expressions": "SELECT p_partkey % 8 AS project_id, 'E' || p_partkey AS name, CASE WHEN p_size % 2 = 0 THEN 'parameter_changed' ELSE 'expression_changed' END AS type FROM {part} WHERE p_partkey % 10 NOT IN (0, 1) AND p_partkey % 7 = 0",
    "d7_pages": f"SELECT project_id, page_id, type, before_value, after_value FROM ({_PAGES}) UNION ALL {_DEFAULT}",
    "d8_filters": """WITH s AS (SELECT o_custkey % 8 AS project_id, o_orderkey AS k, ['report', 'page', 'visual'][o_orderkey % 3 + 1] AS level, 'f' || o_orderkey AS name, list_sort(list(DISTINCT 'v' || l_linenumber)) AS vs FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY ALL),
t AS (SELECT *, CASE WHEN k % 10 = 0 THEN 'filter_added' WHEN k % 10 = 1 THEN 'filter_removed' WHEN k % 7 = 0 THEN 'filter_changed' END AS type FROM s)
SELECT project_id, level, name, type, CASE WHEN type = 'filter_changed' THEN 'new' END AS selected, CASE WHEN type = 'filter_changed' THEN vs[1] END AS deselected FROM t WHERE type IS NOT NULL""",
    "d9_visuals": f"SELECT project_id, page_id, visual_id, CASE WHEN type <> 'visual_changed' THEN type WHEN after_value = 'true' THEN 'visual_hidden' ELSE 'visual_unhidden' END AS type FROM ({_VIS})",
    "d9_bindings": """WITH f AS (SELECT DISTINCT project_id, page_id, visual_id, i FROM {b_field}), k AS (SELECT project_id, page_id, visual_id, count(CASE WHEN i % 10 <> 0 THEN 1 END) AS nb, count(CASE WHEN i % 10 <> 1 THEN 1 END) AS na,
coalesce(string_agg(CASE WHEN i % 10 = 0 THEN 'M' || i END, ',' ORDER BY 'M' || i), '') AS gained, coalesce(string_agg(CASE WHEN i % 10 = 1 THEN 'M' || i END, ',' ORDER BY 'M' || i), '') AS lost FROM f GROUP BY ALL)
SELECT project_id, page_id, visual_id, gained, lost FROM k WHERE nb > 0 AND na > 0 AND (gained <> '' OR lost <> '')""",
    "d10_bookmarks": _BM,
    "d9_bookmark_refs": """WITH v AS (SELECT project_id, page_id, visual_id, vkey AS k, 'Bookmark' || substr(md5(CAST(vkey + 1 AS STRING)), 1, 20) AS one, 'Bookmark' || substr(md5(CAST(vkey + 2 AS STRING)), 1, 20) AS two FROM {b_visual} WHERE vkey % 10 NOT IN (0, 1))
SELECT project_id, page_id, visual_id, CASE WHEN k % 7 = 0 THEN two ELSE '' END AS gained, one AS lost FROM v WHERE k % 7 = 0 OR k % 13 = 0""",
    "d10_overrides": """WITH s AS (SELECT bm % 8 AS project_id, bm AS bookmark, CAST(u AS STRING) AS section FROM (SELECT CAST(floor(event_id / 50) AS BIGINT) AS bm, min(user_id) AS u FROM {events} GROUP BY 1) WHERE bm % 10 NOT IN (0, 1))
SELECT project_id, bookmark, '$.activeSection' AS path, 'bookmark_changed' AS type, '"' || section || '"' AS before_value, '"' || section || 'x"' AS after_value FROM s WHERE bookmark % 11 = 0
UNION ALL SELECT project_id, bookmark, '$.byName.f.v[1]', 'bookmark_changed', '2', '3' FROM s WHERE bookmark % 7 = 0 UNION ALL SELECT project_id, bookmark, '$.targetVisuals[1]', 'bookmark_added', NULL, '"v2"' FROM s WHERE bookmark % 13 = 0""",
    "x21_normalise": "SELECT p_partkey % 8 AS project_id, 'M' || CAST(floor(p_partkey / 8) AS BIGINT) AS name, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' v2' ELSE p_name END AS value, p_size % 2 = 0 AS is_parameter FROM {part} WHERE p_partkey % 10 <> 1",
}

_ALL = " UNION ALL ".join(
    f"SELECT 'P' || ltrim(CAST(project_id AS STRING), 'P') AS project_id, '{scope}' AS scope, {chr(39) + 'bindings_changed' + chr(39) if detector == 'd9_bindings' else 'type'} AS type, concat_ws('.', {', '.join(keys)}) AS target FROM ({_RAW[detector]})"
    for scope, (detector, keys) in _DETECTORS.items()
)
_RAW["a7_summary"] = f"WITH c AS ({_ALL}) SELECT project_id, type, scope, count(*) AS n FROM c GROUP BY GROUPING SETS ((project_id), (project_id, type), (project_id, scope))"
# the same routes over what the after side has: views without the measures that it lacks
_AFTER = graphs.SQL["g15_change_impact"].replace("{b_mm}", "after_mm").replace("{b_edge}", "after_edge").replace("{b_measure}", "after_measure").replace("WITH RECURSIVE ", """WITH RECURSIVE after_measure AS (SELECT * FROM {b_measure} WHERE (i * 8 + CAST(substr(project_id, 2) AS BIGINT)) % 10 <> 1),
kept AS (SELECT project_id, 'measure::' || table_name || '.' || name AS id FROM after_measure), after_mm AS (SELECT m.* FROM {b_mm} m JOIN kept a ON a.project_id = m.project_id AND a.id = m.source JOIN kept b ON b.project_id = m.project_id AND b.id = m.target),
after_edge AS (SELECT e.* FROM {b_edge} e JOIN kept b ON b.project_id = e.project_id AND b.id = e.target WHERE e.type = 'visual_to_field'), """, 1)
_RAW["d11_changes"] = f"""WITH c AS ({_ALL}), g AS ({_AFTER}),
i AS (SELECT project_id, 'measure' AS scope, seed AS node, sum(CASE kind WHEN 'direct' THEN n_visuals ELSE 0 END) AS d, sum(CASE kind WHEN 'field_parameter' THEN n_visuals ELSE 0 END) AS p, sum(CASE kind WHEN 'calculation_group' THEN n_visuals ELSE 0 END) AS cg FROM g GROUP BY project_id, seed
UNION ALL SELECT project_id, 'calculation_item', calc_group, 0, 0, count(*) FROM {{b_applied}} GROUP BY project_id, calc_group)
SELECT c.project_id, c.scope, c.type, c.target, CAST(coalesce(i.d, 0) AS BIGINT) AS n_direct, CAST(coalesce(i.p, 0) AS BIGINT) AS n_parameter, CAST(coalesce(i.cg, 0) AS BIGINT) AS n_grouped
FROM c LEFT JOIN i ON i.project_id = c.project_id AND i.scope = c.scope AND i.node = CASE c.scope WHEN 'measure' THEN 'measure::' || c.target ELSE split_part(c.target, '.', 1) END"""

QUERIES = {k: f for k, f in globals().items() if k in _RAW}
ORACLES = {k: oracle(q) for k, q in _RAW.items()}
