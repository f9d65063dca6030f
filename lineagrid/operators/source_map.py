"""Where each model column physically comes from, and how certain that is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mquery as mq
from .common import PK, cut


def resolve_delegates(bodies: DataFrame, expressions: DataFrame) -> DataFrame:
    """bodies (pk, table_name, delegate, body) with ``source_body``: the body at the end of the chain of shared expressions.

    expressions: (pk, name, delegate, body); delegate names the expression that a body merely passes on, else null. A chain that runs into a circle has
    no source body; one of any length is followed to its end.
    """
    e = expressions.select(*PK, F.col("name").alias("delegate"), F.col("delegate").alias("next"), F.col("body").alias("next_body"))
    open_ = bodies.select(*PK, "table_name", "delegate", "body")
    done = [open_.filter("delegate is null").select(*PK, "table_name", F.col("body").alias("source_body"))]
    todo = cut(open_.filter("delegate is not null").select(*PK, "table_name", "delegate", F.array("delegate").alias("visited")))
    while not todo.isEmpty():
        met = todo.join(e, [*PK, "delegate"]).filter(F.col("next").isNull() | ~F.array_contains("visited", F.col("next")))
        step = cut(met.select(*PK, "table_name", F.col("next").alias("delegate"), F.col("next_body").alias("source_body"), F.concat("visited", F.array("next")).alias("visited")))
        done.append(step.filter("delegate is null").select(*PK, "table_name", "source_body"))
        todo = step.filter("delegate is not null").select(*PK, "table_name", "delegate", "visited")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return bodies.join(out, [*PK, "table_name"], "left")


def first_sources(sources: DataFrame) -> DataFrame:
    """Sources (pk, table_name, no, key, is_native) once a key, the first kept; of equal keys a native query hides the bare connector."""
    w = Window.partitionBy(*PK, "table_name", "key").orderBy(F.desc(F.col("is_native").cast("int")), "no")
    return sources.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def name_chain(steps: DataFrame, upstream: DataFrame | None = None) -> DataFrame:
    """(pk, table_name, intact): no step may rename a column, and none merely names what is no step of the chain and no table that it reads.

    steps: (pk, table_name, name, expression), those of shared expressions put in place. upstream: (pk, table_name, upstream), the model
    table that a chain goes on in. A table without steps has no row.
    """
    s = steps.withColumn("named", mq.bare_name(F.col("expression")))
    known = steps.select(*PK, "table_name", F.col("name").alias("named"))
    if upstream is not None:
        known = known.unionByName(upstream.select(*PK, "table_name", F.col("upstream").alias("named")))
    s = s.join(known.distinct().withColumn("known", F.lit(True)), [*PK, "table_name", "named"], "left")
    ok = F.when(F.col("named").isNotNull(), F.coalesce("known", F.lit(False))).otherwise(~mq.affects_names(F.col("expression")))
    return s.groupBy(*PK, "table_name").agg(F.bool_and(ok).alias("intact"))


def _lookup(df: DataFrame, facts: DataFrame, by: str, out: list[str], prefix: str) -> DataFrame:
    """df with a fact looked up by query name first, then by model column name."""
    f = facts.groupBy(*PK, "table_name", by).agg(F.min(F.struct(*out, F.lit(1).alias("_hit"))).alias("f"))
    a = f.select(*PK, "table_name", F.col(by).alias("pq_name"), F.col("f").alias("_a"))
    b = f.select(*PK, "table_name", F.col(by).alias("name"), F.col("f").alias("_b"))
    return df.join(a, [*PK, "table_name", "pq_name"], "left").join(b, [*PK, "table_name", "name"], "left").withColumn(prefix, F.coalesce("_a", "_b")).drop("_a", "_b")


def resolve_columns(columns: DataFrame, tables: DataFrame, renames: DataFrame, added: DataFrame, expanded: DataFrame, native: DataFrame, projected: DataFrame) -> DataFrame:
    """(pk, model_table, model_column, pq_name, source_column, physical_path, origin, confidence).

    columns: (pk, table_name, name, source_column, is_calculated). tables: (pk, table_name, kind, table_path, native_kind, has_projection, intact);
    kind model-defined, direct-lake, m or none; native_kind list, star or null. renames: (…, new_name, old_name). added: (…, added). expanded: (…, expanded,
    source_name, expanded_path). native and projected: (…, pq_name). The first rung that applies decides.
    """
    c = columns.withColumn("pq_name", F.coalesce("source_column", "name")).join(tables, [*PK, "table_name"], "left")
    c = _lookup(c, added, "added", [], "is_added")
    c = _lookup(c, expanded, "expanded", ["source_name", "expanded_path"], "ex")
    c = _lookup(c, renames, "new_name", ["old_name"], "rn")
    c = c.join(native.select(*PK, "table_name", "pq_name", F.lit(True).alias("in_list")).distinct(), [*PK, "table_name", "pq_name"], "left")
    c = c.join(projected.select(*PK, "table_name", "pq_name", F.lit(True).alias("in_projection")).distinct(), [*PK, "table_name", "pq_name"], "left")
    kind, path, intact = F.col("kind"), F.col("table_path"), F.coalesce("intact", F.lit(False))
    full = lambda col: F.concat_ws(".", path, col)
    r = lambda origin, conf, col=None, p=None: F.struct(F.lit(origin).alias("origin"), F.lit(conf).alias("confidence"), (F.lit(None).cast("string") if col is None else col).alias("source_column"), (F.lit(None).cast("string") if p is None else p).alias("physical_path"))
    source = lambda conf, col: r("source", conf, col, full(col))
    pq = F.col("pq_name")
    ladder = (
        F.when(kind == "model-defined", r("model-defined", "exact"))
        .when(F.col("is_calculated"), r("computed-dax", "exact"))
        .when(kind == "direct-lake", source("exact", pq))
        .when(F.col("is_added").isNotNull(), r("computed-pq", "exact"))
        .when(F.col("ex.expanded_path").isNotNull(), r("source", "exact", F.col("ex.source_name"), F.concat_ws(".", "ex.expanded_path", "ex.source_name")))
        .when(F.col("ex").isNotNull() | path.isNull(), r("unresolved", "unknown"))
        .when(F.col("rn").isNotNull(), source("exact", F.col("rn.old_name")))
        .when(F.col("native_kind") == "list", F.when(F.col("in_list"), source("exact", pq)).otherwise(r("unresolved", "unknown")))
        .when(F.col("has_projection"), F.when(F.col("in_projection"), source("exact", pq)).otherwise(r("unresolved", "unknown")))
        .when(intact, source("exact", pq))
        .otherwise(source("inferred", pq))
    )
    return c.select(*PK, F.col("table_name").alias("model_table"), F.col("name").alias("model_column"), "pq_name", ladder.alias("x")).select(*PK, "model_table", "model_column", "pq_name", "x.source_column", "x.physical_path", "x.origin", "x.confidence")


def link_derived(source_map: DataFrame, links: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """source_map with unresolved columns of derived tables filled from the columns that they copy, and ``also_from``.

    links: (pk, model_table, model_column, from_table, from_column, hop); hop is 1 where that the names agree is an assumption, else 0 (also where it isn't given). Confidence is the
    weakest along the way; a chain of any length is followed, circles stay unresolved. also: (pk, model_table, model_column, no, also_table, also_column), further
    columns that a derived one reads; also_from holds the paths of those that have one, in the order of no, else null.
    """
    key = [*PK, "model_table", "model_column"]
    rank = F.when(F.col("confidence") == "exact", 0).otherwise(1)
    links = links if "hop" in links.columns else links.withColumn("hop", F.lit(0))
    state = cut(source_map)
    at = lambda df: df.select(*PK, F.col("model_table").alias("from_table"), F.col("model_column").alias("from_column"), "physical_path", "source_column", "origin", "rank")
    todo = cut(links.join(state.filter("origin = 'unresolved'").select(*key), key, "left_semi"))
    known = cut(at(state.filter("confidence <> 'unknown'").withColumn("rank", rank)))
    found = None
    while True:
        best = F.min(F.struct(F.greatest("hop", "rank").alias("rank"), "from_table", "from_column", "physical_path", "source_column", "origin")).alias("h")
        hit = cut(todo.join(known, [*PK, "from_table", "from_column"]).groupBy(*key).agg(best).select(*key, "h.physical_path", "h.source_column", "h.origin", "h.rank"))
        if hit.isEmpty():
            break
        found = hit if found is None else found.unionByName(hit)
        todo = cut(todo.join(hit.select(*key), key, "left_anti"))
        known = at(hit)
    out = state
    if found is not None:
        f = found.select(*key, *(F.col(c).alias(f"_{c}") for c in ("physical_path", "source_column", "origin", "rank")))
        conf = F.when(F.col("_rank").isNull(), F.col("confidence")).when(F.col("_rank") == 0, "exact").otherwise("inferred")
        out = state.join(f, key, "left").withColumns({"confidence": conf, **{c: F.coalesce(f"_{c}", c) for c in ("origin", "physical_path", "source_column")}}).drop("_physical_path", "_source_column", "_origin", "_rank")
        out = cut(out)
    if also is None:
        return out.withColumn("also_from", F.lit(None).cast("array<string>"))
    paths = out.filter("confidence <> 'unknown' and physical_path is not null").select(*PK, F.col("model_table").alias("also_table"), F.col("model_column").alias("also_column"), "physical_path")
    more = also.join(paths, [*PK, "also_table", "also_column"]).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "physical_path"))), lambda x: x.physical_path).alias("also_from"))
    linked = F.when(F.col("origin") != "unresolved", F.col("also_from"))
    return out.join(more, key, "left").withColumn("also_from", linked)
