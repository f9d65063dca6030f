"""The report side: bindings, field parameters, visibility, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import PK, cut

# fixed values: routes of a binding, the most direct first
VIA = ["query", "value", "parameter", "title", "filter", "action", "format"]


def via_rank(via: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, VIA)), via)


def via_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, VIA)), rank)


def best_routes(fields: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per visual and field: the most direct route wins."""
    keys = keys or [*PK, "page_id", "visual_id", "kind", "table_name", "name"]
    return fields.groupBy(*keys).agg(F.min_by("via", via_rank(F.col("via"))).alias("via"))


# fixed values: what the routes that plot nothing are called
_VIA_LABEL = {"value": "dynamic value", "parameter": "field parameter", "title": "dynamic title", "filter": "filter", "action": "link", "format": "conditional formatting"}


def role_labels(visuals: DataFrame, fields: DataFrame) -> DataFrame:
    """visuals (pk, page_id, visual_id, role, bound_fields, …) with ``via``, the most direct route of one that shows data but plots none, and ``role_label``."""
    keys = [*PK, "page_id", "visual_id"]
    best = fields.filter(F.col("via") != "query").groupBy(*keys).agg(F.min_by("via", via_rank(F.col("via"))).alias("_via"))
    unplotted = (F.col("role") == "data") & (F.col("bound_fields") == 0)
    names = F.create_map(*(F.lit(x) for kv in _VIA_LABEL.items() for x in kv))
    said = F.when(F.col("role") == "container", "group container").when(F.col("role") == "decoration", "layout or navigation").when(F.col("bound_fields") > 0, "plots data")
    said = said.when(F.col("via").isNotNull(), F.concat(F.lit("shows data as a "), F.try_element_at(names, F.col("via")))).otherwise("displays data in text")
    return visuals.join(best, keys, "left").withColumn("via", F.when(unplotted, F.col("_via"))).drop("_via").withColumn("role_label", said)


def resolve_offers(offers: DataFrame, measures: DataFrame, columns: DataFrame) -> DataFrame:
    """(pk, parameter_table, ordinal, kind, table_name, name): what parameters offer, in the model's own spelling; case-blind.

    offers: (pk, parameter_table, ordinal, ref_table, ref_name). A measure of the name wins whatever table is written (of several, the first table);
    else the column of that table; the rest is dropped.
    """
    m = measures.groupBy(*PK, F.lower("name").alias("k")).agg(F.min(F.struct("table_name", "name")).alias("m"))
    c = columns.groupBy(*PK, F.lower("name").alias("k"), F.lower("table_name").alias("kt")).agg(F.min(F.struct("table_name", "name")).alias("c"))
    o = offers.withColumn("k", F.lower("ref_name")).withColumn("kt", F.lower("ref_table"))
    j = o.join(m, [*PK, "k"], "left").join(c, [*PK, "k", "kt"], "left").filter("m is not null or c is not null")
    best = F.coalesce("m", "c")
    return j.select(*PK, "parameter_table", "ordinal", F.when(F.col("m").isNotNull(), "measure").otherwise("column").alias("kind"), best.table_name.alias("table_name"), best["name"].alias("name"))


def parameter_sets(bound: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, given): what each visual is bound to, as one sorted JSON array, so that visuals bound alike are answered once."""
    return bound.groupBy(*keys).agg(F.to_json(F.sort_array(F.collect_set("parameter_table"))).alias("given"))


def set_members(sets: DataFrame) -> DataFrame:
    """(pk, given, parameter_table): the parameters of each distinct set."""
    return sets.select(*PK, "given").distinct().withColumn("parameter_table", F.explode(F.from_json("given", "array<string>")))


#: copies of a set's row, so that the visuals of one set are dealt to as many tasks
SALTS = 16


def salted(rows: DataFrame, by: Column) -> DataFrame:
    """The rows of the many side, with the copy that each meets."""
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def copied(rows: DataFrame) -> DataFrame:
    """The rows of the few side, a copy for each salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def blocks(rows: DataFrame, keys: list[str], order: str, item: Column, size: int = 512) -> DataFrame:
    """(keys, items): item of each row, in arrays of at most size: a join moves and buffers an array as one row."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    return rows.withColumn("_block", F.floor(n / size)).groupBy(*keys, "_block").agg(F.collect_list(item).alias("items")).drop("_block")


def expand_parameters(fields: DataFrame, bound: DataFrame, offers: DataFrame) -> DataFrame:
    """fields with what the parameters that a visual binds offer, by route ``parameter``; a more direct route that exists already stays.

    bound: (pk, page_id, visual_id, parameter_table). Names merge case-blind, in the offers' spelling. What a set of parameters offers is made distinct once; of the
    pairs of visuals and offers only those that a visual shows already are joined, the rest are written where they arise.
    """
    of, key = [*PK, "page_id", "visual_id"], ["kind", "kt", "kn"]
    sets = cut(parameter_sets(bound, of))
    lower = {"kt": F.lower("table_name"), "kn": F.lower("name")}
    given = set_members(sets).join(offers.select(*PK, "parameter_table", "kind", "table_name", "name"), [*PK, "parameter_table"]).withColumns(lower)
    given = given.groupBy(*PK, "given", *key).agg(F.min(F.struct("table_name", "name")).alias("o"), F.min("parameter_table").alias("via_parameter"))
    given = cut(given.withColumn("at", F.monotonically_increasing_id()))
    rank = F.struct(via_rank(F.col("via")).alias("rank"), "table_name", "name", "via")
    own = fields.withColumns(lower).groupBy(*of, *key).agg(F.min(rank).alias("f"))
    own = cut(own.join(sets, of, "left").join(given, [*PK, "given", *key], "left"))
    offered = F.struct(F.lit(VIA.index("parameter") + 1).alias("rank"), F.col("o.table_name").alias("table_name"), F.col("o.name").alias("name"), F.lit("parameter").alias("via"))
    best = F.when(F.col("o").isNull(), F.col("f")).otherwise(F.least("f", offered))
    shown = own.select(*of, "kind", best.alias("b"), "via_parameter").select(*of, "kind", "b.table_name", "b.name", "b.via", "via_parameter")
    had = own.filter("at is not null").groupBy(*of).agg(F.collect_set("at").alias("had"))
    few = blocks(given, [*PK, "given"], "at", F.struct("at", "kind", "o.table_name", "o.name", "via_parameter"))
    more = salted(sets.join(had, of, "left"), F.col("visual_id")).join(copied(few), [*PK, "given", "salt"])
    left = F.when(F.col("had").isNull(), F.col("items")).otherwise(F.filter("items", lambda x: ~F.array_contains("had", x["at"])))
    more = more.select(*of, F.explode(left).alias("x")).select(*of, "x.kind", "x.table_name", "x.name", F.lit("parameter").alias("via"), "x.via_parameter")
    return shown.unionByName(more)


def visibility(visuals: DataFrame, states: DataFrame) -> DataFrame:
    """(pk, page_id, visual_id, is_hidden, revealed_by, hidden_by, never_shown).

    states: (pk, bookmark_id, page_id, object_id, state). A bookmark hides a visual if it lists the visual or its group as hidden, else shows it if it
    lists either as shown, else says nothing. Hidden visuals that no bookmark shows are never shown.
    """
    s = states.select(*PK, "page_id", "bookmark_id", F.col("object_id").alias("oid"), (F.col("state") == "hidden").alias("h"))
    v = visuals.select(*PK, "page_id", "visual_id", "parent_group")
    own = v.withColumn("oid", F.col("visual_id"))
    group = v.filter("parent_group is not null").withColumn("oid", F.col("parent_group"))
    said = own.unionByName(group).join(s, [*PK, "page_id", "oid"]).groupBy(*PK, "page_id", "visual_id", "bookmark_id").agg(F.bool_or("h").alias("h"))
    marks = said.groupBy(*PK, "page_id", "visual_id").agg(F.sort_array(F.collect_set(F.when(~F.col("h"), F.col("bookmark_id")))).alias("revealed_by"), F.sort_array(F.collect_set(F.when(F.col("h"), F.col("bookmark_id")))).alias("hidden_by"))
    none = F.array().cast("array<string>")
    out = visuals.select(*PK, "page_id", "visual_id", "is_hidden").join(marks, [*PK, "page_id", "visual_id"], "left").withColumns({c: F.coalesce(c, none) for c in ("revealed_by", "hidden_by")})
    return out.withColumn("never_shown", F.col("is_hidden") & (F.size("revealed_by") == 0))


def overlaps(visuals: DataFrame, share: float = 0.5, first: int | None = None, cell: int = 320) -> DataFrame:
    """(pk, page_id, visual_id, other): visuals of a page that cover each other by more than a share of the smaller one; containers (by ``role``) are left out.

    Rectangles are dealt to grid cells, so that a crowded page does not meet itself whole; a pair counts in the cell of its
    common corner only.
    """
    v = visuals.filter("role is null or role <> 'container'") if "role" in visuals.columns else visuals
    v = v.select(*PK, "page_id", "visual_id", "x", "y", "width", "height")
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(a) + F.col(b)) / cell)))
    g = v.withColumn("cx", cells("x", "width")).withColumn("cy", cells("y", "height"))
    a = g.select(*PK, "page_id", "cx", "cy", *(F.col(c).alias(f"a_{c}") for c in ("visual_id", "x", "y", "width", "height")))
    b = g.select(*PK, "page_id", "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in ("visual_id", "x", "y", "width", "height")))
    j = a.join(b, [*PK, "page_id", "cx", "cy"]).filter("a_visual_id <> b_visual_id")
    left, top = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    w = F.least(F.col("a_x") + F.col("a_width"), F.col("b_x") + F.col("b_width")) - left
    h = F.least(F.col("a_y") + F.col("a_height"), F.col("b_y") + F.col("b_height")) - top
    smaller = F.least(F.col("a_width") * F.col("a_height"), F.col("b_width") * F.col("b_height"))
    out = j.filter((w > 0) & (h > 0) & (w * h > share * smaller) & (F.floor(left / cell) == F.col("cx")) & (F.floor(top / cell) == F.col("cy")))
    out = out.select(*PK, "page_id", F.col("a_visual_id").alias("visual_id"), F.col("b_visual_id").alias("other"))
    if first is None:
        return out
    return out.withColumn("no", F.row_number().over(Window.partitionBy(*PK, "page_id", "visual_id").orderBy("other"))).filter(F.col("no") <= first)


def reading_order(visuals: DataFrame, band: int = 40) -> DataFrame:
    """visuals with ``no``: bands of a page from top to bottom, then from left to right."""
    w = Window.partitionBy(*PK, "page_id").orderBy(F.floor(F.col("y") / band), "x", "visual_id")
    return visuals.withColumn("no", F.row_number().over(w))


def placeholders(fields: DataFrame, objects: DataFrame) -> DataFrame:
    """Bindings (pk, kind, table_name, name) that no object of the model stands behind, once each."""
    return fields.select(*PK, "kind", "table_name", "name").distinct().join(objects.select(*PK, "kind", "table_name", "name").distinct(), [*PK, "kind", "table_name", "name"], "left_anti")


def usage(measures: DataFrame, fields: DataFrame) -> DataFrame:
    """measures with the number of visuals that show each."""
    n = fields.filter("kind = 'measure'").groupBy(*PK, "table_name", "name").agg(F.countDistinct("page_id", "visual_id").alias("n_visuals"))
    return measures.join(n, [*PK, "table_name", "name"], "left").fillna(0, ["n_visuals"])


def label(title: Column, visual_type: Column, visual_id: Column, hidden: Column) -> Column:
    """What to call a visual: title, else type, else id, marked if hidden."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.concat(F.coalesce(filled(title), filled(visual_type), visual_id), F.when(hidden, " (hidden)").otherwise(""))
