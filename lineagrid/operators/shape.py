"""Shape of models: table roles, counts and observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PK

ROLES = ["fact", "bridge", "dimension", "standalone"]


def known_relationships(rels: DataFrame, tables: DataFrame) -> DataFrame:
    """Relationships with ``dangling``: one end at least is no table of the model. A relationship meets the names of its model's tables once, for both ends, unsorted."""
    names = tables.groupBy(*PK).agg(F.collect_set("name").alias("_names"))
    known = lambda end: F.coalesce(F.array_contains("_names", F.col(end)), F.lit(False))
    return rels.join(names.hint("shuffle_hash"), PK, "left").withColumn("dangling", ~(known("from_table") & known("to_table"))).drop("_names")


def table_shape(tables: DataFrame, rels: DataFrame) -> DataFrame:
    """(pk, table_name, role, out_degree, in_degree, degree): many-side ends make facts, one-side ends dimensions, both bridges; dangling relationships count for nothing."""
    ok = known_relationships(rels, tables).filter(~F.col("dangling"))
    own = tables.select(*PK, F.col("name").alias("table_name"), F.lit(0).alias("o"), F.lit(0).alias("i"))  # both ends of what doesn't dangle are among them
    ends = ok.select(*PK, F.col("from_table").alias("table_name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(ok.select(*PK, F.col("to_table").alias("table_name"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    out = own.unionByName(ends).groupBy(*PK, "table_name").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    o, i = F.col("out_degree") > 0, F.col("in_degree") > 0
    role = F.when(o & i, "bridge").when(o, "fact").when(i, "dimension").otherwise("standalone")
    return out.withColumn("role", role).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def shape_counts(tables: DataFrame, rels: DataFrame) -> DataFrame:
    """Per project: tables by role, and bidirectional, inactive and dangling relationships."""
    roles = table_shape(tables, rels).groupBy(*PK).agg(*(F.count_if(F.col("role") == r).alias(r) for r in ROLES))
    k = known_relationships(rels, tables)
    c = k.groupBy(*PK).agg(F.count_if(~F.col("dangling") & (F.col("cross_filter") == "both")).alias("bidirectional"), F.count_if(~F.col("dangling") & ~F.col("is_active")).alias("inactive"), F.count_if("dangling").alias("dangling"))
    return roles.join(c, PK, "left").fillna(0)


def neighbourhood(rels: DataFrame) -> DataFrame:
    """(pk, table_name, no, direction, other): relationships of each table, outgoing first, then by name."""
    d = rels.select(*PK, F.col("from_table").alias("table_name"), F.lit("out").alias("direction"), F.col("to_table").alias("other"), F.lit(0).alias("o"))
    u = rels.select(*PK, F.col("to_table").alias("table_name"), F.lit("in").alias("direction"), F.col("from_table").alias("other"), F.lit(1).alias("o"))
    w = Window.partitionBy(*PK, "table_name").orderBy("o", "other")
    return d.unionByName(u).distinct().withColumn("no", F.row_number().over(w)).drop("o")


def er_edges(rels: DataFrame, tables: DataFrame, max_tables: int = 40) -> DataFrame:
    """(pk, from_table, to_table, from_column, label): edges of a drawing, once each pair of tables and column, labelled with the column; none for models with more connected tables than max_tables."""
    ok = known_relationships(rels, tables).filter(~F.col("dangling"))
    label = F.concat_ws(" ", "from_column", F.when(~F.col("is_active"), "(inactive)").when(F.col("cross_filter") == "both", "(both)"))
    edges = ok.select(*PK, "from_table", "to_table", "from_column", label.alias("label")).groupBy(*PK, "from_table", "to_table", "from_column").agg(F.min("label").alias("label"))
    drawn = table_shape(tables, rels).filter("role <> 'standalone'").groupBy(*PK).agg(F.count("*").alias("n")).filter(F.col("n") <= max_tables)
    return edges.join(drawn.select(*PK), PK, "left_semi")


def node_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project: nodes by type, edges, and measures that nothing points at."""
    types = ["column", "measure", "table", "visual"]
    n = nodes.groupBy(*PK).agg(F.count("*").alias("nodes"), *(F.count_if(F.col("type") == t).alias(f"{t}s") for t in types))
    e = edges.groupBy(*PK).agg(F.count("*").alias("edges"))
    alone = nodes.filter("type = 'measure'").join(edges.select(*PK, F.col("target").alias("id")).distinct(), [*PK, "id"], "left_anti").groupBy(*PK).agg(F.count("*").alias("orphaned_measures"))
    return n.join(e, PK, "left").join(alone, PK, "left").fillna(0)


def observations(projects: DataFrame, parts: list[tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(pk, observation, n): number of rows by project that meet each condition of a part, all of a part in one grouping; zeros are left out."""
    counts = []
    for df, of in parts:
        n = df.groupBy(*PK).agg(*(F.count_if(c).alias(f"n{i}") for i, c in enumerate(of.values())))
        each = F.array(*(F.struct(F.lit(k).alias("observation"), F.col(f"n{i}").alias("n")) for i, k in enumerate(of)))
        counts.append(n.select(*PK, F.explode(each).alias("x")).select(*PK, "x.observation", "x.n"))
    return reduce(DataFrame.unionByName, counts).filter("n > 0").join(projects.select(*PK).distinct(), PK, "left_semi").select(*PK, "observation", "n")
