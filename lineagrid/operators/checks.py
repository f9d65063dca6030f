"""The gate: rules over a fleet of models, as anti-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import PK, ref
from .graph import reached

SEVERITY = {"broken-refs": "error", "dangling-visual-refs": "error", "unused-measures": "warning", "coverage": "error", "dead-visuals": "warning"}


def _finding(df: DataFrame, rule: str, item) -> DataFrame:
    return df.select(*PK, F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity"), item.alias("item"))


def broken_references(refs: DataFrame, objects: DataFrame, tables: DataFrame) -> DataFrame:
    """References (pk, table_name, name, ref_kind, ref_table, ref_name) that match neither a qualified nor a bare name of any kind, and tables that do not exist; case-blind.

    objects: (pk, table_name, name), measures and columns. tables: (pk, name).
    """
    named = refs.filter("ref_kind <> 'table'").withColumn("full", F.lower(ref(F.coalesce("ref_table", "table_name"), "ref_name"))).withColumn("bare", F.lower("ref_name"))
    full = objects.select(*PK, F.lower(ref("table_name", "name")).alias("full")).distinct()
    bare = objects.select(*PK, F.lower("name").alias("bare")).distinct()
    lost = named.join(full, [*PK, "full"], "left_anti").join(bare, [*PK, "bare"], "left_anti")
    text = F.when(F.col("ref_table").isNull(), F.concat(F.lit("["), "ref_name", F.lit("]"))).otherwise(ref("ref_table", "ref_name"))
    t = refs.filter("ref_kind = 'table'").withColumn("key", F.lower("ref_table"))
    lost_tables = t.join(tables.select(*PK, F.lower("name").alias("key")).distinct(), [*PK, "key"], "left_anti")
    say = lambda what: F.concat(ref("table_name", "name"), F.lit(" -> "), what)
    return _finding(lost, "broken-refs", say(text)).unionByName(_finding(lost_tables, "broken-refs", say(F.col("ref_table")))).distinct()


def dangling_visual_refs(fields: DataFrame, measures: DataFrame, report_measures: DataFrame, columns: DataFrame) -> DataFrame:
    """Measure bindings (pk, page_id, visual_id, table_name, name) known neither as a measure of the model or report nor as a column."""
    key = F.lower(ref("table_name", "name"))
    out = fields.withColumn("key", key)
    for known in (measures, report_measures, columns):
        out = out.join(known.select(*PK, key.alias("key")).distinct(), [*PK, "key"], "left_anti")
    return _finding(out, "dangling-visual-refs", F.concat_ws(" ", "page_id", "visual_id", ref("table_name", "name"))).distinct()


def unused_measures(edges: DataFrame, measures: DataFrame, shown: DataFrame) -> DataFrame:
    """Measures (pk, id) that no shown measure (pk, node) reaches by measure references."""
    hit = reached(edges, shown).select(*PK, F.col("node").alias("id"))
    return _finding(measures.join(hit, [*PK, "id"], "left_anti"), "unused-measures", F.col("id"))


def coverage(source_map: DataFrame) -> DataFrame:
    """Counts by confidence and origin a project, and the share of columns with a source among those that should have one."""
    c = lambda cond: F.count_if(cond)
    out = source_map.groupBy(*PK).agg(
        F.count("*").alias("total"), *(c(F.col("confidence") == x).alias(x) for x in ("exact", "inferred", "unknown")),
        c(F.col("origin") == "source").alias("sourced"), c(F.col("origin").isin("computed-pq", "computed-dax")).alias("computed"),
        c(F.col("origin") == "model-defined").alias("model_defined"), c(F.col("origin") == "unresolved").alias("unresolved"),
    )
    n = F.col("sourced") + F.col("unresolved")
    return out.withColumn("coverage", F.when(n > 0, F.round(F.col("sourced") / n, 3)).otherwise(0.0))


def low_coverage(source_map: DataFrame, least: float | None) -> DataFrame:
    """Columns without a path in projects whose coverage is below ``least``; none without a threshold."""
    cov = coverage(source_map).filter(F.col("coverage") < (least if least is not None else -1.0)).select(*PK)
    lost = source_map.filter("origin = 'unresolved'").join(cov, PK, "left_semi")
    return _finding(lost, "coverage", ref("model_table", "model_column"))


def dead_visuals(visibility: DataFrame) -> DataFrame:
    return _finding(visibility.filter("never_shown"), "dead-visuals", F.concat_ws(" ", "page_id", "visual_id"))


def decide(findings: list[DataFrame], projects: DataFrame, fail_on: list[str]) -> DataFrame:
    """Per project: number of findings of each rule, and whether a rule of fail_on has any."""
    all_ = reduce(DataFrame.unionByName, findings)
    by_rule = all_.groupBy(*PK, "rule").agg(F.count("*").alias("n"))
    out = projects.select(*PK).distinct().join(by_rule, PK, "left").groupBy(*PK)
    return out.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_findings"), F.count("rule").alias("n_rules"), F.coalesce(F.bool_or(F.col("rule").isin(fail_on)), F.lit(False)).alias("fails"))


def listing(findings: DataFrame, first: int = 12) -> DataFrame:
    """The first items of each project and rule, with the number of further ones."""
    w = Window.partitionBy(*PK, "rule")
    n = findings.withColumns({"no": F.row_number().over(w.orderBy("item")), "n": F.count("*").over(w)})
    return n.filter(F.col("no") <= first).withColumn("more", F.greatest(F.lit(0), F.col("n") - first)).drop("n")
