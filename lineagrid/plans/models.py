"""Queries of checks, report side, model shape, counts, rankings and look-ups over the bridge views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import checks as c
from ..operators import report as r
from ..operators import shape as sh
from ..operators.common import PK, node_id
from . import graphs
from .bridge import oracle, view


def _measure_id():
    return node_id("measure", F.col("table_name"), F.col("name"))


def _fields(spark, sf):
    """Measure bindings with names; a binding without a measure keeps a made-up table."""
    f, m = view(spark, sf, "b_field"), view(spark, sf, "b_measure").select(*PK, "i", "table_name", "name")
    j = f.join(m.hint("shuffle_hash"), [*PK, "i"], "left")  # the few are built, the many not sorted
    name = F.coalesce("name", F.concat(F.lit("M"), F.col("i").cast("string")))
    return j.select(*PK, "page_id", "visual_id", F.lit("measure").alias("kind"), F.coalesce("table_name", F.lit("?")).alias("table_name"), name.alias("name"), r.via_name(F.col("via_rank")).alias("via"))


def _refs(spark, sf):
    """References of measures: columns, a few with another case, a few unknown, and their tables."""
    m = view(spark, sf, "b_measure")
    name = F.concat(F.when(F.col("size") % 4 == 0, "C").otherwise("c"), F.when(F.col("size") % 25 == 0, F.lit("x")).otherwise(F.lit("")), F.col("size"))
    col = m.select(*PK, "table_name", "name", F.lit("column").alias("ref_kind"), F.col("table_name").alias("ref_table"), name.alias("ref_name"))
    tab = m.select(*PK, "table_name", "name", F.lit("table").alias("ref_kind"), F.when(F.col("size") % 30 == 0, "Nowhere").otherwise(F.upper("table_name")).alias("ref_table"), F.lit(None).cast("string").alias("ref_name"))
    return col.unionByName(tab)


def _objects(spark, sf):
    return view(spark, sf, "b_measure").select(*PK, F.lit("measure").alias("kind"), "table_name", "name").unionByName(view(spark, sf, "b_column").select(*PK, F.lit("column").alias("kind"), "table_name", "name"))


def _model_tables(spark, sf):
    return view(spark, sf, "b_column").select(*PK, F.col("table_name").alias("name")).distinct()


def _broken(spark, sf):
    return c.broken_references(_refs(spark, sf), _objects(spark, sf), _model_tables(spark, sf))


def _dangling(spark, sf):
    m = view(spark, sf, "b_measure")
    cols = view(spark, sf, "b_column").select(*PK, "table_name", "name")
    of_report = m.filter("is_hidden").select(*PK, F.lit("?").alias("table_name"), F.concat(F.lit("M"), F.col("i") + 100000).alias("name"))
    return c.dangling_visual_refs(_fields(spark, sf), m, of_report, cols)


def _unused(spark, sf):
    m = view(spark, sf, "b_measure").select(*PK, _measure_id().alias("id"))
    bound = view(spark, sf, "b_field").select(*PK, "i").distinct()  # lines by number, before they meet names
    shown = view(spark, sf, "b_measure").join(bound, [*PK, "i"], "left_semi").select(*PK, _measure_id().alias("node"))
    return c.unused_measures(view(spark, sf, "b_mm"), m, shown)


def _source_map(spark, sf):
    """A source map by residues of the column number, for the counts alone (the ladder itself has its own query)."""
    b, k = view(spark, sf, "b_column"), F.col("size") % 11
    origin = F.when(k == 0, "unresolved").when(k == 1, "computed-dax").when(k == 2, "computed-pq").when(k == 3, "model-defined").otherwise("source")
    conf = F.when(k == 0, "unknown").when(k == 4, "inferred").otherwise("exact")
    path = F.when(origin == "source", F.concat_ws(".", F.lit("dbo"), "table_name", "source_column"))
    return b.select(*PK, F.col("table_name").alias("model_table"), F.col("name").alias("model_column"), "size", origin.alias("origin"), conf.alias("confidence"), path.alias("physical_path"), F.concat(F.lit("Query "), "source_column").alias("pq_name"))


def _visibility(spark, sf):
    return r.visibility(view(spark, sf, "b_visual"), view(spark, sf, "b_state"))


def c1_broken(spark, sf):
    return _broken(spark, sf).select("project_id", "rule", "severity", "item")


def c2_dangling(spark, sf):
    return _dangling(spark, sf).select("project_id", "rule", "item")


def c3_unused(spark, sf):
    return _unused(spark, sf).select("project_id", "rule", "item")


def c4_coverage(spark, sf):
    return c.low_coverage(_source_map(spark, sf), 0.9).select("project_id", "rule", "item")


def c5_dead(spark, sf):
    return c.dead_visuals(_visibility(spark, sf)).select("project_id", "rule", "item")


def _all_findings(spark, sf):
    return [_broken(spark, sf), _dangling(spark, sf), _unused(spark, sf), c.low_coverage(_source_map(spark, sf), 0.9), c.dead_visuals(_visibility(spark, sf))]


def c6_decide(spark, sf):
    return c.decide(_all_findings(spark, sf), view(spark, sf, "b_project"), ["broken-refs", "dangling-visual-refs", "coverage"]).select("project_id", "n_findings", "n_rules", "fails")


def w2_listing(spark, sf):
    return c.listing(_unused(spark, sf).unionByName(_dangling(spark, sf))).select("project_id", "rule", "no", "item", "more")


def a2_coverage(spark, sf):
    return c.coverage(_source_map(spark, sf)).drop("snapshot_id")


def w3_source_order(spark, sf):
    from pyspark.sql import Window

    s = _source_map(spark, sf)
    rank = F.when(F.col("confidence") == "exact", 0).when(F.col("confidence") == "inferred", 1).otherwise(2)
    by = lambda *o: F.row_number().over(Window.partitionBy(*PK).orderBy(*o))
    return s.select("project_id", "model_table", "model_column", by("model_table", "model_column").alias("by_name"), by(F.asc_nulls_last("physical_path"), "model_table", "model_column").alias("by_path"), by(rank, "model_table", "model_column").alias("by_confidence"))


def f1_search_columns(spark, sf):
    s = _source_map(spark, sf)
    text = F.lower(F.concat_ws("\n", "model_column", "model_table", "physical_path", "pq_name"))
    return s.filter(text.contains("src_1") & (F.col("confidence") == "exact")).select("project_id", "model_table", "model_column", "physical_path")


def j19_reverse_lookup(spark, sf):
    """The model columns behind each physical path, case-blind, over all projects: a row each, with the number of columns and of projects that the path has."""
    s = _source_map(spark, sf).filter("physical_path is not null").withColumn("path", F.lower("physical_path"))
    shared = s.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("project_id").alias("n_projects"))
    return s.join(shared, "path").select("path", "project_id", "model_table", "model_column", "confidence", "n", "n_projects")


def w1_best_route(spark, sf):
    return r.best_routes(_fields(spark, sf)).select("project_id", "page_id", "visual_id", "name", "via")


def w1_role_labels(spark, sf):
    """What each visual does with its data: plots it, or by which route it shows it without plotting."""
    f = _fields(spark, sf)
    plotted = f.filter("via = 'query'").groupBy(*PK, "page_id", "visual_id").agg(F.count("*").alias("bound"))
    k = F.col("vkey") % 6
    v = view(spark, sf, "b_visual").join(plotted.filter("visual_id % 2 = 0"), [*PK, "page_id", "visual_id"], "left")
    role = F.when(k == 5, "container").when(k == 3, "decoration").otherwise("data")
    v = v.select(*PK, "page_id", "visual_id", role.alias("role"), F.coalesce("bound", F.lit(0)).alias("bound_fields"))
    return r.role_labels(v, f).select("project_id", "page_id", "visual_id", "via", "role_label")


def _offers(spark, sf):
    o = view(spark, sf, "b_offer")
    return r.resolve_offers(o.select(*PK, "parameter_table", "ordinal", F.lit(None).cast("string").alias("ref_table"), F.col("offered").alias("ref_name")), view(spark, sf, "b_measure"), view(spark, sf, "b_column"))


def j6_offers(spark, sf):
    return _offers(spark, sf).select("project_id", "parameter_table", "ordinal", "kind", "table_name", "name")


def _bound(spark, sf):
    return view(spark, sf, "b_bound").select(*PK, "page_id", "visual_id", "parameter_table")


def j7_expand(spark, sf):
    return r.expand_parameters(_fields(spark, sf), _bound(spark, sf), _offers(spark, sf)).select("project_id", "page_id", "visual_id", "name", "via", "via_parameter")


def a5_machinery(spark, sf):
    """Per field parameter: fields offered and visuals bound to it. Per calculation group: visuals that apply it."""
    offers, bound = _offers(spark, sf), _bound(spark, sf)
    a = offers.groupBy(*PK, "parameter_table").agg(F.count("*").alias("n_offered"))
    b = bound.groupBy(*PK, "parameter_table").agg(F.countDistinct("page_id", "visual_id").alias("n_visuals"))
    parameters = a.join(b, [*PK, "parameter_table"], "left").select("project_id", F.lit("field_parameter").alias("kind"), F.col("parameter_table").alias("name"), "n_offered", F.coalesce("n_visuals", F.lit(0)).alias("n_visuals"))
    groups = view(spark, sf, "b_applied").groupBy("project_id", F.lit("calculation_group").alias("kind"), F.col("calc_group").alias("name")).agg(F.lit(None).cast("long").alias("n_offered"), F.countDistinct("page_id", "visual_id").alias("n_visuals"))
    return parameters.unionByName(groups)


def j14_usage(spark, sf):
    return r.usage(view(spark, sf, "b_measure"), _fields(spark, sf)).select("project_id", "table_name", "name", "n_visuals")


def j15_calculation_groups(spark, sf):
    """Measures that a calculation group rewrites: shown by a visual that applies the group too; "n of m visuals" of each."""
    groups = view(spark, sf, "b_applied")
    f = r.best_routes(_fields(spark, sf))
    all_ = f.groupBy(*PK, "table_name", "name").agg(F.countDistinct("page_id", "visual_id").alias("m"))
    hit = f.join(groups, [*PK, "page_id", "visual_id"]).groupBy(*PK, "table_name", "name", "calc_group").agg(F.countDistinct("page_id", "visual_id").alias("n"))
    return hit.join(all_, [*PK, "table_name", "name"]).select("project_id", "name", "calc_group", F.concat_ws(" ", "n", F.lit("of"), "m", F.lit("visuals")).alias("note"))


def j16_visibility(spark, sf):
    v = _visibility(spark, sf)
    return v.select("project_id", "page_id", "visual_id", "is_hidden", F.array_join("revealed_by", ",").alias("revealed_by"), F.array_join("hidden_by", ",").alias("hidden_by"), "never_shown")


def j17_placeholders(spark, sf):
    return r.placeholders(_fields(spark, sf), _objects(spark, sf)).select("project_id", "kind", "table_name", "name")


def j18_overlaps(spark, sf):
    v = view(spark, sf, "b_visual").withColumn("role", F.when(F.col("vkey") % 13 == 0, "container").otherwise("data"))
    return r.overlaps(v, first=8).select("project_id", "page_id", "visual_id", "other", "no")


def w5_reading_order(spark, sf):
    return r.reading_order(view(spark, sf, "b_visual")).select("project_id", "page_id", "visual_id", "no")


def f3_search_visuals(spark, sf):
    f = r.best_routes(_fields(spark, sf)).groupBy(*PK, "page_id", "visual_id").agg(F.sort_array(F.collect_set("name")).alias("names"))
    kind = F.when(F.col("vkey") % 9 == 0, "decompositionTree").when(F.col("vkey") % 9 == 4, "urgentCard").otherwise("card")
    v = view(spark, sf, "b_visual").withColumn("visual_type", kind).join(f, [*PK, "page_id", "visual_id"], "left")
    found = v.filter(F.lower("title").contains("urgent") | F.lower("visual_type").contains("urgent") | F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.lower(n).contains("m1")))
    more = F.greatest(F.lit(0), F.coalesce(F.size("names"), F.lit(0)) - 2)
    return found.select("project_id", "visual_id", F.coalesce(F.array_join(F.slice("names", 1, 2), ","), F.lit("")).alias("first_fields"), more.alias("more"))


def f2_search_measures(spark, sf):
    text = graphs.dax_measures(spark, sf).select(*PK, "table_name", "name", "expression")
    used = r.usage(view(spark, sf, "b_measure"), _fields(spark, sf)).join(text, [*PK, "table_name", "name"])
    return used.filter((F.lower("name").contains("m2") | F.lower("table_name").contains("#5") | F.lower("expression").contains("m2")) & (F.col("n_visuals") == 0)).select("project_id", "table_name", "name")


def f5_labels(spark, sf):
    v = view(spark, sf, "b_visual")
    pages = view(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("page_id"), F.col("c_name").alias("page_name"))
    title = F.when(F.col("vkey") % 4 == 0, " ").otherwise(F.col("title"))
    kind = F.when(F.col("vkey") % 8 != 0, F.lit("card"))
    return v.join(pages, "page_id", "left").select("project_id", "visual_id", r.label(title, kind, F.col("visual_id"), F.col("is_hidden")).alias("label"), F.coalesce("page_name", "page_id").alias("page"))


def a1_stats(spark, sf):
    return sh.node_stats(view(spark, sf, "b_node"), view(spark, sf, "b_edge")).drop("snapshot_id")


def a3_roles(spark, sf):
    return sh.table_shape(view(spark, sf, "b_table"), view(spark, sf, "b_rel")).drop("snapshot_id")


def a3_shape_counts(spark, sf):
    return sh.shape_counts(view(spark, sf, "b_table"), view(spark, sf, "b_rel")).drop("snapshot_id")


def g16_neighbourhood(spark, sf):
    return sh.neighbourhood(view(spark, sf, "b_rel")).drop("snapshot_id")


def s8_er_edges(spark, sf):
    rels = view(spark, sf, "b_rel").withColumn("from_column", F.when(F.col("cross_filter") == "both", "k2").otherwise("k1"))
    return sh.er_edges(rels, view(spark, sf, "b_table")).drop("snapshot_id")


def w4_table_order(spark, sf):
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, sh.ROLES)), F.col("role"))
    t = sh.table_shape(view(spark, sf, "b_table"), view(spark, sf, "b_rel"))
    return t.select("project_id", "table_name", F.row_number().over(Window.partitionBy(*PK).orderBy(rank, F.desc("degree"), "table_name")).alias("no"))


def f4_filter_tables(spark, sf):
    t = sh.table_shape(view(spark, sf, "b_table"), view(spark, sf, "b_rel"))
    return t.filter((F.col("role") == "fact") & F.lower("table_name").contains("t1")).select("project_id", "table_name", "degree")


def a4_counts(spark, sf):
    m = view(spark, sf, "b_measure").groupBy(*PK, "table_name").agg(F.count("*").alias("n_measures"))
    cols = view(spark, sf, "b_column").groupBy(*PK, "table_name").agg(F.count("*").alias("n_columns"))
    return cols.join(m, [*PK, "table_name"], "full_outer").select("project_id", "table_name", F.coalesce("n_columns", F.lit(0)).alias("n_columns"), F.coalesce("n_measures", F.lit(0)).alias("n_measures"))


def a4_visuals_per_page(spark, sf):
    v = view(spark, sf, "b_visual").groupBy("page_id").agg(F.count("*").alias("n"))
    pages = view(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("page_id"))
    return pages.join(v, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_visuals"))


def a6_observations(spark, sf):
    parts = [
        (_visibility(spark, sf), {"hidden visuals": F.col("is_hidden"), "never shown": F.col("never_shown")}),
        (sh.known_relationships(view(spark, sf, "b_rel"), view(spark, sf, "b_table")), {"dangling relationships": F.col("dangling"), "bidirectional": F.col("cross_filter") == "both"}),
        (_source_map(spark, sf), {"unresolved columns": F.col("origin") == "unresolved"}), (_unused(spark, sf), {"unused measures": F.lit(True)}), (view(spark, sf, "b_measure"), {"hidden measures": F.col("is_hidden")}),
    ]
    return sh.observations(view(spark, sf, "b_project"), parts).select("project_id", "observation", "n")


_SM = """sm AS (SELECT project_id, table_name AS model_table, name AS model_column, CASE size % 11 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'computed-dax' WHEN 2 THEN 'computed-pq' WHEN 3 THEN 'model-defined' ELSE 'source' END AS origin,
CASE size % 11 WHEN 0 THEN 'unknown' WHEN 4 THEN 'inferred' ELSE 'exact' END AS confidence, CASE WHEN size % 11 > 3 THEN 'dbo.' || table_name || '.' || source_column END AS physical_path, 'Query ' || source_column AS pq_name FROM {b_column})"""
_FLD = """fl AS (SELECT f.project_id, f.page_id, f.visual_id, coalesce(m.table_name, '?') AS table_name, 'M' || f.i AS name, f.via_rank FROM {b_field} f LEFT JOIN {b_measure} m ON m.project_id = f.project_id AND m.i = f.i)"""
_VIA = "['query', 'value', 'parameter', 'title', 'filter', 'action', 'format']"
_SAID = """said AS (SELECT v.project_id, v.page_id, v.visual_id, s.bookmark_id, bool_or(s.state = 'hidden') AS h FROM {b_visual} v JOIN {b_state} s ON s.project_id = v.project_id AND s.page_id = v.page_id AND s.object_id IN (v.visual_id, v.parent_group) GROUP BY ALL),
mk AS (SELECT project_id, page_id, visual_id, coalesce(string_agg(CASE WHEN NOT h THEN bookmark_id END, ',' ORDER BY bookmark_id), '') AS revealed_by, coalesce(string_agg(CASE WHEN h THEN bookmark_id END, ',' ORDER BY bookmark_id), '') AS hidden_by FROM said GROUP BY ALL),
vis AS (SELECT v.project_id, v.page_id, v.visual_id, v.is_hidden, coalesce(mk.revealed_by, '') AS revealed_by, coalesce(mk.hidden_by, '') AS hidden_by, v.is_hidden AND coalesce(mk.revealed_by, '') = '' AS never_shown FROM {b_visual} v LEFT JOIN mk USING (project_id, page_id, visual_id))"""
_UNUSED = """hit AS (SELECT DISTINCT project_id, 'measure::' || table_name || '.' || name AS node FROM {b_shown} UNION SELECT h.project_id, e.target FROM hit h JOIN {b_mm} e ON e.project_id = h.project_id AND e.source = h.node),
un AS (SELECT n.project_id, 'unused-measures' AS rule, n.id AS item FROM {b_node} n WHERE n.type = 'measure' AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.project_id = n.project_id AND hit.node = n.id))"""
_DANG = _FLD + """, da AS (SELECT DISTINCT project_id, 'dangling-visual-refs' AS rule, page_id || ' ' || visual_id || ' ' || table_name || '[' || name || ']' AS item FROM fl WHERE table_name = '?' AND NOT EXISTS (SELECT 1 FROM {b_measure} r WHERE r.is_hidden AND r.project_id = fl.project_id AND 'M' || (r.i + 100000) = fl.name))"""
_BROK = """rf AS (SELECT project_id, table_name, name, size, CASE WHEN size % 4 = 0 THEN 'C' ELSE 'c' END || CASE WHEN size % 25 = 0 THEN 'x' ELSE '' END || size AS rn FROM {b_measure}),
nm AS (SELECT project_id, lower(name) AS k FROM {b_measure} UNION SELECT project_id, lower(name) FROM {b_column}),
br AS (SELECT DISTINCT project_id, 'broken-refs' AS rule, table_name || '[' || name || '] -> ' || table_name || '[' || rn || ']' AS item FROM rf WHERE NOT EXISTS (SELECT 1 FROM nm WHERE nm.project_id = rf.project_id AND nm.k = lower(rn))
UNION ALL SELECT DISTINCT project_id, 'broken-refs', table_name || '[' || name || '] -> Nowhere' FROM rf WHERE size % 30 = 0)"""
_COV = _SM + """, cv AS (SELECT project_id, count(*) AS total, count_if(confidence = 'exact') AS exact, count_if(confidence = 'inferred') AS inferred, count_if(confidence = 'unknown') AS "unknown", count_if(origin = 'source') AS sourced,
count_if(origin LIKE 'computed%') AS computed, count_if(origin = 'model-defined') AS model_defined, count_if(origin = 'unresolved') AS unresolved FROM sm GROUP BY project_id),
cw AS (SELECT *, CASE WHEN sourced + unresolved > 0 THEN round(sourced / (sourced + unresolved), 3) ELSE 0.0 END AS coverage FROM cv),
lc AS (SELECT sm.project_id, 'coverage' AS rule, model_table || '[' || model_column || ']' AS item FROM sm JOIN cw USING (project_id) WHERE coverage < 0.9 AND origin = 'unresolved')"""
_DEAD = _SAID + ", dd AS (SELECT project_id, 'dead-visuals' AS rule, page_id || ' ' || visual_id AS item FROM vis WHERE never_shown)"
_SHAPE = """k AS (SELECT r.*, f.name IS NULL OR t.name IS NULL AS dangling FROM {b_rel} r LEFT JOIN {b_table} f ON f.project_id = r.project_id AND f.name = r.from_table LEFT JOIN {b_table} t ON t.project_id = r.project_id AND t.name = r.to_table),
en AS (SELECT project_id, from_table AS name, 1 AS o, 0 AS i FROM k WHERE NOT dangling UNION ALL SELECT project_id, to_table, 0, 1 FROM k WHERE NOT dangling),
dg AS (SELECT project_id, name, CAST(sum(o) AS BIGINT) AS o, CAST(sum(i) AS BIGINT) AS i FROM en GROUP BY ALL),
ts AS (SELECT b.project_id, b.name AS table_name, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, CASE WHEN coalesce(o, 0) > 0 AND coalesce(i, 0) > 0 THEN 'bridge' WHEN coalesce(o, 0) > 0 THEN 'fact' WHEN coalesce(i, 0) > 0 THEN 'dimension' ELSE 'standalone' END AS role, coalesce(o, 0) + coalesce(i, 0) AS degree FROM {b_table} b LEFT JOIN dg USING (project_id, name))"""
_OFF = "of AS (SELECT o.project_id, o.parameter_table, o.ordinal, m.table_name, m.name FROM {b_offer} o JOIN {b_measure} m ON m.project_id = o.project_id AND upper(m.name) = o.offered)"
_BND = "bd AS (SELECT * FROM {b_bound})"

_RAW = {
    "c1_broken": f"WITH {_BROK} SELECT project_id, rule, 'error' AS severity, item FROM br",
    "c2_dangling": f"WITH {_DANG} SELECT * FROM da",
    "c3_unused": f"WITH RECURSIVE {_UNUSED} SELECT * FROM un",
    "c4_coverage": f"WITH {_COV} SELECT * FROM lc",
    "c5_dead": f"WITH {_DEAD} SELECT * FROM dd",
    "c6_decide": f"WITH RECURSIVE {_UNUSED}, {_BROK}, {_DANG}, {_COV}, {_DEAD}, al AS (SELECT project_id, rule FROM un UNION ALL SELECT project_id, rule FROM br UNION ALL SELECT project_id, rule FROM da UNION ALL SELECT project_id, rule FROM lc UNION ALL SELECT project_id, rule FROM dd) SELECT p.project_id, CAST(count(al.rule) AS BIGINT) AS n_findings, count(DISTINCT al.rule) AS n_rules, coalesce(bool_or(al.rule IN ('broken-refs', 'dangling-visual-refs', 'coverage')), false) AS fails FROM {{b_project}} p LEFT JOIN al USING (project_id) GROUP BY p.project_id",
    "w2_listing": f"WITH RECURSIVE {_UNUSED}, {_DANG}, x AS (SELECT *, row_number() OVER (PARTITION BY project_id, rule ORDER BY item) AS no, count(*) OVER (PARTITION BY project_id, rule) AS n FROM (SELECT * FROM un UNION ALL SELECT * FROM da)) SELECT project_id, rule, no, item, greatest(0, n - 12) AS more FROM x WHERE no <= 12",
    "a2_coverage": f"WITH {_COV} SELECT * FROM cw",
    "w3_source_order": f"WITH {_SM} SELECT project_id, model_table, model_column, row_number() OVER (PARTITION BY project_id ORDER BY model_table, model_column) AS by_name, row_number() OVER (PARTITION BY project_id ORDER BY physical_path NULLS LAST, model_table, model_column) AS by_path, row_number() OVER (PARTITION BY project_id ORDER BY CASE confidence WHEN 'exact' THEN 0 WHEN 'inferred' THEN 1 ELSE 2 END, model_table, model_column) AS by_confidence FROM sm",
    "f1_search_columns": f"WITH {_SM} SELECT project_id, model_table, model_column, physical_path FROM sm WHERE confidence = 'exact' AND lower(pq_name) LIKE '%src!_1%' ESCAPE '!'",
    "j19_reverse_lookup": f"WITH {_SM} SELECT lower(physical_path) AS path, project_id, model_table, model_column, confidence, g.n, g.n_projects FROM sm JOIN (SELECT lower(physical_path) AS p, count(*) AS n, count(DISTINCT project_id) AS n_projects FROM sm GROUP BY 1) g ON g.p = lower(physical_path)",
    "w1_best_route": f"WITH {_FLD} SELECT project_id, page_id, visual_id, name, {_VIA}[min(via_rank) + 1] AS via FROM fl GROUP BY project_id, page_id, visual_id, table_name, name",
    "w1_role_labels": f"""WITH {_FLD}, b AS (SELECT project_id, page_id, visual_id, count(*) FILTER (via_rank = 0) AS n, min(CASE WHEN via_rank > 0 THEN via_rank END) AS r FROM fl GROUP BY ALL),
x AS (SELECT v.*, CASE vkey % 6 WHEN 5 THEN 'c' WHEN 3 THEN 'd' ELSE 'a' END AS role, CASE WHEN vkey % 2 = 0 THEN coalesce(n, 0) ELSE 0 END AS bound, r FROM {{b_visual}} v LEFT JOIN b USING (project_id, page_id, visual_id)),
y AS (SELECT *, CASE WHEN role = 'a' AND bound = 0 THEN r END AS w FROM x)
SELECT project_id, page_id, visual_id, {_VIA}[w + 1] AS via, CASE role WHEN 'c' THEN 'group container' WHEN 'd' THEN 'layout or navigation' ELSE CASE WHEN bound > 0 THEN 'plots data' WHEN w IS NOT NULL THEN 'shows data as a ' || ['', 'dynamic value', 'field parameter', 'dynamic title', 'filter', 'link', 'conditional formatting'][w + 1] ELSE 'displays data in text' END END AS role_label FROM y""",
    "j6_offers": f"WITH {_OFF} SELECT project_id, parameter_table, ordinal, 'measure' AS kind, table_name, name FROM of",
    "j7_expand": f"WITH {_FLD}, {_OFF}, {_BND}, al AS (SELECT project_id, page_id, visual_id, table_name, name, via_rank, NULL AS p FROM fl UNION ALL SELECT bd.project_id, bd.page_id, bd.visual_id, of.table_name, of.name, 2, bd.parameter_table FROM bd JOIN of USING (project_id, parameter_table)) SELECT project_id, page_id, visual_id, name, {_VIA}[min(via_rank) + 1] AS via, min(p) AS via_parameter FROM al GROUP BY project_id, page_id, visual_id, table_name, name",
    "a5_machinery": f"WITH {_OFF}, {_BND} SELECT of.project_id, 'field_parameter' AS kind, of.parameter_table AS name, count(*) AS n_offered, coalesce(any_value(b.n), 0) AS n_visuals FROM of LEFT JOIN (SELECT project_id, parameter_table, count(*) AS n FROM bd GROUP BY ALL) b USING (project_id, parameter_table) GROUP BY of.project_id, of.parameter_table UNION ALL SELECT project_id, 'calculation_group', calc_group, NULL, count(DISTINCT page_id || '.' || visual_id) FROM {{b_applied}} GROUP BY project_id, calc_group",
    "j14_usage": "SELECT m.project_id, m.table_name, m.name, count(DISTINCT f.visual_id) AS n_visuals FROM {b_measure} m LEFT JOIN {b_field} f ON f.project_id = m.project_id AND f.i = m.i GROUP BY ALL",
    "j15_calculation_groups": f"WITH {_FLD}, f AS (SELECT DISTINCT project_id, page_id, visual_id, table_name, name FROM fl), a AS (SELECT project_id, table_name, name, count(*) AS m FROM f GROUP BY ALL), h AS (SELECT f.project_id, f.table_name, f.name, v.calc_group, count(*) AS n FROM f JOIN {{b_applied}} v USING (project_id, page_id, visual_id) GROUP BY ALL) SELECT project_id, name, calc_group, n || ' of ' || m || ' visuals' AS note FROM h JOIN a USING (project_id, table_name, name)",
    "j16_visibility": f"WITH {_SAID} SELECT * FROM vis",
    "j17_placeholders": f"WITH {_FLD} SELECT DISTINCT project_id, 'measure' AS kind, table_name, name FROM fl WHERE table_name = '?'",
    "j18_overlaps": """WITH p AS (SELECT a.project_id, a.page_id, a.visual_id, b.visual_id AS other FROM {b_visual} a JOIN {b_visual} b ON b.project_id = a.project_id AND b.page_id = a.page_id AND b.visual_id <> a.visual_id
WHERE a.vkey % 13 <> 0 AND b.vkey % 13 <> 0 AND least(a.x + a.width, b.x + b.width) > greatest(a.x, b.x) AND least(a.y + a.height, b.y + b.height) > greatest(a.y, b.y) AND (least(a.x + a.width, b.x + b.width) - greatest(a.x, b.x)) * (least(a.y + a.height, b.y + b.height) - greatest(a.y, b.y)) > 0.5 * least(a.width * a.height, b.width * b.height)),
n AS (SELECT *, row_number() OVER (PARTITION BY project_id, page_id, visual_id ORDER BY other) AS no FROM p) SELECT * FROM n WHERE no <= 8""",
    "w5_reading_order": "SELECT project_id, page_id, visual_id, row_number() OVER (PARTITION BY project_id, page_id ORDER BY floor(y / 40), x, visual_id) AS no FROM {b_visual}",
    "f3_search_visuals": f"WITH {_FLD}, f AS (SELECT project_id, page_id, visual_id, list_sort(list(DISTINCT name)) AS names FROM fl GROUP BY ALL) SELECT v.project_id, v.visual_id, coalesce(array_to_string(names[1:2], ','), '') AS first_fields, greatest(0, coalesce(len(names), 0) - 2) AS more FROM {{b_visual}} v LEFT JOIN f USING (project_id, page_id, visual_id) WHERE lower(v.title) LIKE '%urgent%' OR vkey % 9 = 4 OR len(list_filter(coalesce(names, []), lambda n: lower(n) LIKE '%m1%')) > 0",
    "f2_search_measures": "SELECT m.project_id, m.table_name, m.name FROM {b_measure} m LEFT JOIN {b_field} f ON f.project_id = m.project_id AND f.i = m.i WHERE f.i IS NULL AND (lower(m.name) LIKE '%m2%' OR lower(m.table_name) LIKE '%#5%' OR EXISTS (SELECT 1 FROM {b_dep} d WHERE d.project_id = m.project_id AND d.i = m.i AND CAST(d.j AS STRING) LIKE '2%'))",
    "f5_labels": "SELECT v.project_id, v.visual_id, CASE WHEN vkey % 4 <> 0 THEN title WHEN vkey % 8 <> 0 THEN 'card' ELSE visual_id END || CASE WHEN is_hidden THEN ' (hidden)' ELSE '' END AS label, CASE WHEN CAST(page_id AS BIGINT) % 3 <> 0 THEN coalesce(c.c_name, page_id) ELSE page_id END AS page FROM {b_visual} v LEFT JOIN {customer} c ON CAST(c.c_custkey AS STRING) = v.page_id",
    "a1_stats": "WITH a AS (SELECT n.project_id, count(*) AS o FROM {b_node} n WHERE n.type = 'measure' AND NOT EXISTS (SELECT 1 FROM {b_edge} e WHERE e.project_id = n.project_id AND e.target = n.id) GROUP BY ALL), e AS (SELECT project_id, count(*) AS edges FROM {b_edge} GROUP BY ALL) SELECT n.project_id, count(*) AS nodes, count_if(type = 'column') AS columns, count_if(type = 'measure') AS measures, count_if(type = 'table') AS tables, count_if(type = 'visual') AS visuals, any_value(e.edges) AS edges, coalesce(any_value(a.o), 0) AS orphaned_measures FROM {b_node} n LEFT JOIN e USING (project_id) LEFT JOIN a USING (project_id) GROUP BY n.project_id",
    "a3_roles": f"WITH {_SHAPE} SELECT * FROM ts",
    "a3_shape_counts": f"WITH {_SHAPE}, c AS (SELECT project_id, count_if(NOT dangling AND cross_filter = 'both') AS bidirectional, count_if(NOT dangling AND NOT is_active) AS inactive, count_if(dangling) AS dangling FROM k GROUP BY ALL) SELECT project_id, count_if(role = 'fact') AS fact, count_if(role = 'bridge') AS bridge, count_if(role = 'dimension') AS dimension, count_if(role = 'standalone') AS standalone, any_value(bidirectional) AS bidirectional, any_value(inactive) AS inactive, any_value(dangling) AS dangling FROM ts JOIN c USING (project_id) GROUP BY project_id",
    "g16_neighbourhood": "WITH x AS (SELECT DISTINCT project_id, from_table AS table_name, 'out' AS direction, to_table AS other FROM {b_rel} UNION SELECT DISTINCT project_id, to_table, 'in', from_table FROM {b_rel}) SELECT *, row_number() OVER (PARTITION BY project_id, table_name ORDER BY CASE direction WHEN 'out' THEN 0 ELSE 1 END, other) AS no FROM x",
    "s8_er_edges": f"WITH {_SHAPE}, d AS (SELECT project_id FROM ts WHERE role <> 'standalone' GROUP BY project_id HAVING count(*) <= 40) SELECT project_id, from_table, to_table, CASE WHEN cross_filter = 'both' THEN 'k2' ELSE 'k1' END AS from_column, min(CASE WHEN cross_filter = 'both' THEN 'k2' ELSE 'k1' END || CASE WHEN NOT is_active THEN ' (inactive)' WHEN cross_filter = 'both' THEN ' (both)' ELSE '' END) AS label FROM k WHERE NOT dangling AND project_id IN (SELECT project_id FROM d) GROUP BY ALL",
    "w4_table_order": f"WITH {_SHAPE} SELECT project_id, table_name, row_number() OVER (PARTITION BY project_id ORDER BY CASE role WHEN 'fact' THEN 1 WHEN 'bridge' THEN 2 WHEN 'dimension' THEN 3 ELSE 4 END, degree DESC, table_name) AS no FROM ts",
    "f4_filter_tables": f"WITH {_SHAPE} SELECT project_id, table_name, degree FROM ts WHERE role = 'fact' AND lower(table_name) LIKE '%t1%'",
    "a4_counts": "SELECT coalesce(c.project_id, m.project_id) AS project_id, coalesce(c.table_name, m.table_name) AS table_name, coalesce(c.n, 0) AS n_columns, coalesce(m.n, 0) AS n_measures FROM (SELECT project_id, table_name, count(*) AS n FROM {b_column} GROUP BY ALL) c FULL JOIN (SELECT project_id, table_name, count(*) AS n FROM {b_measure} GROUP BY ALL) m ON m.project_id = c.project_id AND m.table_name = c.table_name",
    "a4_visuals_per_page": "SELECT CAST(c_custkey AS STRING) AS page_id, count(o_orderkey) AS n_visuals FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey GROUP BY c_custkey",
    "a6_observations": f"WITH RECURSIVE {_UNUSED}, {_SM}, {_SAID}, {_SHAPE}, x AS (SELECT project_id, 'hidden visuals' AS observation FROM {{b_visual}} WHERE is_hidden UNION ALL SELECT project_id, 'never shown' FROM vis WHERE never_shown UNION ALL SELECT project_id, 'dangling relationships' FROM k WHERE dangling UNION ALL SELECT project_id, 'bidirectional' FROM k WHERE cross_filter = 'both' UNION ALL SELECT project_id, 'unresolved columns' FROM sm WHERE origin = 'unresolved' UNION ALL SELECT project_id, 'unused measures' FROM un UNION ALL SELECT project_id, 'hidden measures' FROM {{b_measure}} WHERE is_hidden) SELECT project_id, observation, count(*) AS n FROM x GROUP BY ALL",
}

QUERIES = {k: f for k, f in globals().items() if k in _RAW}
ORACLES = {k: oracle(q) for k, q in _RAW.items()}
