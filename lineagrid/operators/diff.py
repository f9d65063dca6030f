"""What changed between two snapshots: one keyed comparison, applied to every kind of object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def normalised(text: Column) -> Column:
    """Text with runs of white space as one space, trimmed; for comparing expressions."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def parameter_like(text: Column) -> Column:
    """Whether an expression is a literal: quoted text, a number, a boolean or null, with or without a meta record."""
    return F.trim(text).rlike(r'(?is)^("(?:[^"]|"")*"|-?\d+(?:\.\d+)?|true|false|null|#date\([^)]*\))(\s+meta\s*\[.*\])?$')


def keyed_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str, scope: str, *, added: bool = True, normalise: bool = False, both_known: bool = False) -> DataFrame:
    """(keys, type, scope, before_value, after_value): objects added, removed and changed.

    keys must be unique on each side. added=False compares only what both sides have. normalise: white space does not count.
    both_known: a change counts only between two non-empty values. Nulls are equal to each other.
    """
    b = before.select(*keys, F.col(value).alias("before_value"), F.lit(True).alias("_b"))
    a = after.select(*keys, F.col(value).alias("after_value"), F.lit(True).alias("_a"))
    j = b.join(a, keys, "full_outer" if added else "inner")
    x, y = F.col("before_value"), F.col("after_value")
    differ = ~(normalised(x).eqNullSafe(normalised(y)) if normalise else x.eqNullSafe(y))
    if both_known:
        differ = differ & (F.coalesce(x.cast("string"), F.lit("")) != "") & (F.coalesce(y.cast("string"), F.lit("")) != "")
    kind = F.when(F.col("_b").isNull(), f"{scope}_added").when(F.col("_a").isNull(), f"{scope}_removed").when(differ, f"{scope}_changed")
    return j.withColumn("type", kind).filter("type is not null").select(*keys, "type", F.lit(scope).alias("scope"), x.cast("string").alias("before_value"), y.cast("string").alias("after_value"))


def set_diff(before: DataFrame, after: DataFrame, keys: list[str], items: str) -> DataFrame:
    """(keys, gained, lost): sorted differences of array values of objects that both sides have; only where there are any."""
    j = before.select(*keys, F.col(items).alias("_b")).join(after.select(*keys, F.col(items).alias("_a")), keys)
    none = F.array().cast("array<string>")
    b, a = F.coalesce("_b", none), F.coalesce("_a", none)
    out = j.select(*keys, F.array_sort(F.array_except(a, b)).alias("gained"), F.array_sort(F.array_except(b, a)).alias("lost"))
    return out.filter((F.size("gained") > 0) | (F.size("lost") > 0))


def json_paths(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, path, value): the leaves of JSON texts, a row each; members by name ($.a.b), elements by number ($.a[0]), empty objects and arrays as {} and [].

    A round opens one level of all texts at once, so there are as many rounds as the deepest text has levels. The order of members and white space don't count.
    Texts that are no JSON have no rows.
    """
    level = texts.select(*keys, F.lit("$").alias("path"), F.try_parse_json(text).alias("v")).filter("v is not null")
    out = None
    while True:
        kind = F.schema_of_variant("v")
        nested = (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (F.to_json("v") != "[]"))
        level = level.withColumn("nested", nested)
        done = cut(level.filter(~F.col("nested")).select(*keys, "path", F.to_json("v").alias("value")))
        out = done if out is None else out.unionByName(done)
        level = level.filter("nested")
        if level.isEmpty():
            return out
        named = ", ".join(f"`{k}`" for k in keys)
        step = texts.sparkSession.sql(f"SELECT {named}, concat(path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path, to_json(e.value) AS j FROM {{level}}, LATERAL variant_explode(v) AS e", level=level)
        level = cut(step).withColumn("v", F.parse_json("j")).drop("j")


def path_diff(before: DataFrame, after: DataFrame, keys: list[str], text: str, scope: str) -> DataFrame:
    """(keys, path, type, before_value, after_value): leaves that JSON texts of the same keys have gained, lost or changed; a null leaf is a value like any other.

    Only objects that both sides have are compared; the others are the business of ``keyed_diff``.
    """
    both = before.select(*keys).intersect(after.select(*keys))
    sides = [json_paths(x.join(both, keys, "left_semi"), keys, text) for x in (before, after)]
    return keyed_diff(*sides, [*keys, "path"], "value", scope).drop("scope")


def bookmark_refs(content: Column) -> Column:
    """Bookmarks that a visual's text names (in the actions of its buttons), once each."""
    return F.array_distinct(F.regexp_extract_all(content, F.lit("Bookmark[a-fA-F0-9]{20,}"), F.lit(0)))


def bookmark_summary(content: Column) -> Column:
    """What of a bookmark counts for a comparison, as JSON: name, active section, targets and filter overrides."""
    at = lambda path, default: F.coalesce(F.get_json_object(content, path), F.lit(default))
    member = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    quoted = lambda path: F.to_json(F.struct(at(path, "").alias("x")))
    inner = lambda path: F.regexp_extract(quoted(path), r'(?s)^\{"x":(.*)\}$', 1)
    parts = [
        member("displayName", inner("$.displayName")), member("activeSection", inner("$.explorationState.activeSection")), member("targetVisuals", at("$.options.targetVisualNames", "[]")),
        member("applyOnlyToTargets", at("$.options.applyOnlyToTargetVisuals", "false")), member("byName", at("$.explorationState.filters.byName", "{}")), member("byExpr", at("$.explorationState.filters.byExpr", "[]")),
    ]
    return F.when(F.get_json_object(content, "$").isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")))


def summary(changes: DataFrame, pk: list[str]) -> DataFrame:
    """Number of changes of each project in all, by type and by scope, in one pass."""
    sets = [[F.col(c) for c in pk], [*(F.col(c) for c in pk), F.col("type")], [*(F.col(c) for c in pk), F.col("scope")]]
    return changes.groupingSets(sets, *pk, "type", "scope").agg(F.count("*").alias("n"))
