"""Pages, visuals, field bindings, bookmarks, report measures and filters out of report JSON.

Known paths are read with JSON functions; only bindings, nested bookmark groups and filters need a walk, done by vectorised helpers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PK = ["project_id", "snapshot_id"]
_DEPTH = 24
#: Routes of formatting objects, by key; the rest is ``format``.
_ROUTE = {"values": "value", "title": "title", "subTitle": "title", "visualLink": "action"}
_RANK = {v: i for i, v in enumerate(["query", "value", "parameter", "title", "filter", "action", "format"])}


def _json(path: str):
    return F.get_json_object("content", path)


def pages(files: DataFrame) -> DataFrame:
    """Pages with defaults; the id falls back to the folder of the path where the JSON is malformed or says none."""
    folder = F.regexp_extract("path", r"pages/([^/]+)/", 1)
    page = F.coalesce(_json("$.name"), folder)
    num = lambda k, d: F.coalesce(_json(f"$.{k}").cast("double"), F.lit(d))
    return files.select(*PK, page.alias("page_id"), F.coalesce(_json("$.displayName"), page).alias("name"), F.coalesce(_json("$.ordinal"), _json("$.order")).cast("int").alias("ordinal"), num("width", 1280.0).alias("width"), num("height", 720.0).alias("height"))


def visuals(files: DataFrame) -> DataFrame:
    """Visuals: the title from the first of five places, groups, hidden flag, position, and the number of fields that are plotted (projections of the query state)."""
    group = _json("$.visualGroup").isNotNull()
    lit = "text.expr.Literal.Value"
    places = ["$.visual.title.text", f"$.visual.objects.title.properties.{lit}", f"$.visual.vcObjects.title[0].properties.{lit}", f"$.visual.visualContainerObjects.title[0].properties.{lit}"]
    title = F.coalesce(F.when(~_json("$.visual.title").startswith("{"), _json("$.visual.title")), *(F.regexp_replace(_json(p), "^'|'$", "") for p in places), F.when(group, _json("$.visualGroup.displayName")), F.lit(""))
    kind = F.when(group, "group").otherwise(F.coalesce(_json("$.visual.visualType"), F.lit("unknown")))
    hidden = F.coalesce(_json("$.isHidden") == "true", F.lit(False)) | F.coalesce(_json("$.visual.isHidden") == "true", F.lit(False))
    state = F.from_json(F.coalesce(_json("$.visual.query.queryState"), _json("$.visual.queryState")), "map<string,struct<projections:array<string>>>")
    bound = F.aggregate(F.coalesce(F.map_values(state), F.array().cast("array<struct<projections:array<string>>>")), F.lit(0), lambda n, r: n + F.coalesce(F.when(r.projections.isNotNull(), F.size(r.projections)), F.lit(0)))
    at = {k: _json(f"$.position.{k}").cast("double").alias(k) for k in ("x", "y", "width", "height")}
    return files.select(*PK, F.regexp_extract("path", r"pages/([^/]+)/", 1).alias("page_id"), _json("$.name").alias("visual_id"), kind.alias("visual_type"), title.alias("title"), hidden.alias("is_hidden"), _json("$.parentGroupName").alias("parent_group"), *at.values(), bound.alias("bound_fields"))


def with_roles(visuals: DataFrame, fields: DataFrame) -> DataFrame:
    """visuals with ``role``: container for groups, data for those that read a field by any route, plotted or not, else decoration."""
    some = fields.select(*PK, "page_id", "visual_id").distinct().withColumn("_reads", F.lit(True))
    role = F.when(F.col("visual_type") == "group", "container").when(F.col("_reads"), "data").otherwise("decoration")
    return visuals.join(some, [*PK, "page_id", "visual_id"], "left").withColumn("role", role).drop("_reads")


def _loads(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def _binding(node, alias: dict):
    """(kind, table, name) of a field node, through aggregations and hierarchies."""
    for kind in ("Measure", "Column"):
        if isinstance(node.get(kind), dict):
            src = ((node[kind].get("Expression") or {}).get("SourceRef")) or {}
            entity = src.get("Entity") or alias.get(src.get("Source")) or src.get("Source")
            return (kind.lower(), entity, node[kind].get("Property")) if node[kind].get("Property") else None
    return None


def _walk(node, alias: dict, via: str, out: list, depth: int = 0) -> None:
    """All bindings below a node, with the alias scope that holds there."""
    if depth > _DEPTH:
        return
    if isinstance(node, list):
        for x in node:
            _walk(x, alias, via, out, depth + 1)
    elif isinstance(node, dict):
        if isinstance(node.get("From"), list):
            alias = alias | {f.get("Name"): f.get("Entity") for f in node["From"] if isinstance(f, dict)}
        if found := _binding(node, alias):
            out.append((*found, via))
        for k, v in node.items():
            if k not in ("From",):
                _walk(v, alias, via, out, depth + 1)


def fields_of(config) -> list[tuple[str, str, str, str]]:
    """(kind, table, name, via) of a visual, once each, by the most direct route."""
    if not isinstance(config, dict):
        return []
    visual, out = config.get("visual") or {}, []
    for key in ("prototypeQuery", "query", "projections", "dataTransforms"):
        _walk(visual.get(key), {}, "query", out)
    for holder in ("objects", "vcObjects", "visualContainerObjects"):
        for k, v in (visual.get(holder) or {}).items():
            _walk(v, {}, _ROUTE.get(k, "format"), out)
    for where in (config, visual):
        _walk(where.get("filterConfig"), {}, "filter", out)
        _walk(where.get("filters"), {}, "filter", out)
    best: dict[tuple, str] = {}
    for *key, via in out:
        if tuple(key) not in best or _RANK[via] < _RANK[best[tuple(key)]]:
            best[tuple(key)] = via
    return [(*k, v) for k, v in best.items()]


def visual_fields(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, s, page, content in zip(b.project_id, b.snapshot_id, b.page_id, b.content):
                c = _loads(content)
                out += [(p, s, page, c.get("name"), *f) for f in fields_of(c)]
            yield pd.DataFrame(out, columns=["project_id", "snapshot_id", "page_id", "visual_id", "kind", "table_name", "name", "via"])

    src = files.select(*PK, F.regexp_extract("path", r"pages/([^/]+)/", 1).alias("page_id"), "content")
    return src.mapInPandas(run, "project_id string, snapshot_id string, page_id string, visual_id string, kind string, table_name string, name string, via string")


def _groups(node, out: list) -> None:
    for k, v in (node or {}).items():
        if isinstance(v, dict):
            if "isHidden" in v:
                out.append((k, "group", "hidden" if v["isHidden"] else "shown"))
            _groups(v.get("children"), out)


def bookmark_states(files: DataFrame) -> DataFrame:
    """(pk, bookmark_id, page_id, object_id, object_kind, state); malformed bookmarks are skipped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, s, content in zip(b.project_id, b.snapshot_id, b.content):
                c = _loads(content)
                sections = ((c or {}).get("explorationState") or {}).get("sections") if isinstance(c, dict) else None
                for page, section in (sections or {}).items():
                    found: list = []
                    for k, v in (section.get("visualContainers") or {}).items():
                        mode = (((v or {}).get("singleVisual") or {}).get("display") or {}).get("mode")
                        found.append((k, "visual", "hidden" if mode == "hidden" else "shown"))
                    _groups(section.get("visualContainerGroups"), found)
                    rows += [(p, s, c.get("name"), page, *f) for f in found]
            yield pd.DataFrame(rows, columns=["project_id", "snapshot_id", "bookmark_id", "page_id", "object_id", "object_kind", "state"])

    return files.select(*PK, "content").mapInPandas(run, "project_id string, snapshot_id string, bookmark_id string, page_id string, object_id string, object_kind string, state string")


def report_measures(files: DataFrame) -> DataFrame:
    schema = "struct<entities:array<struct<name:string,measures:array<struct<name:string,expression:string>>>>>"
    e = files.select(*PK, F.explode(F.from_json("content", schema).entities).alias("e"))
    return e.select(*PK, F.col("e.name").alias("table_name"), F.explode("e.measures").alias("m")).select(*PK, "table_name", "m.name", "m.expression")


_FILTER = "struct<name:string,type:string,isHiddenInViewMode:boolean,field:struct<Column:struct<Expression:struct<SourceRef:struct<Entity:string>>,Property:string>,Measure:struct<Expression:struct<SourceRef:struct<Entity:string>>,Property:string>>,filter:struct<Where:array<struct<Condition:string>>>>"


def filters(files: DataFrame) -> DataFrame:
    """(pk, path, level, name, entity, property, type, is_hidden, values): filters of visuals, pages and reports; values as written, sorted."""
    parsed = F.from_json("content", f"struct<filterConfig:struct<filters:array<{_FILTER}>>,filters:array<{_FILTER}>>")
    level = F.when(F.lower("path").endswith("visual.json"), "visual").when(F.lower("path").endswith("report.json"), "report").otherwise("page")
    f = files.select(*PK, "path", level.alias("level"), F.explode(F.coalesce(parsed.filterConfig.filters, parsed.filters)).alias("f"))
    text = F.array_join(F.transform("f.filter.Where", lambda w: w.Condition), " ")
    values = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r'"Value"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))))
    pick = lambda k: F.coalesce(F.col(f"f.field.Column.{k}"), F.col(f"f.field.Measure.{k}"))
    return f.select(*PK, "path", "level", F.col("f.name").alias("name"), pick("Expression.SourceRef.Entity").alias("entity"), pick("Property").alias("property"), F.col("f.type").alias("type"), F.coalesce("f.isHiddenInViewMode", F.lit(False)).alias("is_hidden"), F.when(text.contains('"Not"'), F.lit("not ")).otherwise(F.lit("")).alias("negated"), F.coalesce(values, F.array().cast("array<string>")).alias("values"))
