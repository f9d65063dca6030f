"""One job from project files to the source map: every model table and column of all projects and snapshots at once.

Stages, each landed once by snapshot: files to objects; bodies (the M text of each table and of each shared expression); chains (the bodies that a
body hands on to); facts read from each body of a chain; steps, with those of shared expressions put in place; then the ladder of
``source_map.resolve_columns`` and the links of derived tables. Tables and expressions are handled alike, as owners, since columns that are joined in need the physical table of an expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import mquery as mq
from ..sources import tmdl
from . import source_map as sm
from .common import PK, cut

_OWNER = [*PK, "kind", "owner"]


def gold(files: DataFrame) -> dict[str, DataFrame]:
    """Objects of all model files as tables; files are (pk, path, content). The rows are landed by snapshot before they are shaped, and so are the bodies, which a source map and a graph both read."""
    objects = cut(tmdl.rows(files.filter(F.lower("path").endswith(".tmdl"))), by="snapshot_id")
    made = {f.__name__: f(objects) for f in (tmdl.columns, tmdl.measures, tmdl.partitions, tmdl.calculation_items, tmdl.expressions, tmdl.relationships)}
    groups = objects.filter("object in ('calculationGroup', 'calculationItem')").select(*PK, "table_name").distinct()
    return made | {"groups": groups, "objects": objects, "bodies": cut(bodies(made))}


def bodies(g: dict[str, DataFrame]) -> DataFrame:
    """(pk, kind, owner, body): the M text of each table (a refresh policy's, else its first partition's) and of each shared expression, without comments."""
    first = F.min_by("m_body", F.struct("ordinal", "name")).alias("body")
    p = g["partitions"].filter("m_body is not null and type = 'm'").groupBy(*PK, F.lit("table").alias("kind"), F.col("table_name").alias("owner")).agg(first)
    e = g["expressions"].filter("kind = 'expression' and body is not null").select(*PK, F.lit("expression").alias("kind"), F.col("name").alias("owner"), "body")
    return p.unionByName(e).withColumn("body", mq.strip_comments(F.col("body")))


def own_steps(b: DataFrame) -> DataFrame:
    """(pk, kind, owner, step_no, name, expression, named): the steps of each body; a body without a let is one step without a name. named: the name that a step consists of, if nothing else."""
    steps = mq.steps(F.col("body"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("name"), F.trim("body").alias("expression")))
    s = b.withColumn("s", steps).select(*_OWNER, F.posexplode(F.when(F.size("s") > 0, F.col("s")).otherwise(whole)).alias("step_no", "s"))
    return s.select(*_OWNER, "step_no", "s.name", "s.expression", mq.bare_name(F.col("s.expression")).alias("named"))


def spliced(steps: DataFrame) -> DataFrame:
    """(pk, kind, owner, position, name, expression, named, via): all steps of each owner in the order in which they run.

    A step that consists of a shared expression's name is replaced by that expression's steps, to any depth. position holds the number of the
    step and those of the steps that it stands in for, so one sort by it gives the order; via is the expression in which a step is written, null for an owner's own. An expression that
    comes up within itself stays a name.
    """
    inner = cut(steps.filter("kind = 'expression'").select(*PK, F.col("owner").alias("named"), F.col("step_no").alias("_no"), F.col("name").alias("_name"), F.col("expression").alias("_expression"), F.col("named").alias("_named")))
    known = inner.select(*PK, "named").distinct().withColumn("known", F.lit(True))
    visited = F.when(F.col("kind") == "expression", F.array("owner")).otherwise(F.array().cast("array<string>"))
    cols = [*_OWNER, "position", "name", "expression", "named", "via"]
    todo = cut(steps.select(*_OWNER, F.array("step_no").alias("position"), "name", "expression", "named", F.lit(None).cast("string").alias("via"), visited.alias("visited")).join(known, [*PK, "named"], "left"))
    out = None
    while True:
        goes_on = F.col("known").isNotNull() & ~F.array_contains("visited", F.col("named"))
        done = todo.filter(~F.coalesce(goes_on, F.lit(False))).filter("name is not null").select(*cols)
        out = done if out is None else out.unionByName(done)
        step = todo.filter(goes_on).drop("known").join(inner, [*PK, "named"])
        step = step.select(*_OWNER, F.concat("position", F.array("_no")).alias("position"), F.col("_name").alias("name"), F.col("_expression").alias("expression"), F.col("_named").alias("_n"), F.col("named").alias("via"), F.concat("visited", F.array("named")).alias("visited")).withColumnRenamed("_n", "named")
        todo = cut(step.join(known, [*PK, "named"], "left"))
        if todo.isEmpty():
            return out


def chains(b: DataFrame, steps: DataFrame) -> DataFrame:
    """(pk, kind, owner, hop, body): the body of each owner (hop 0), that of the expression with whose name it begins, and so on; a circle ends it."""
    head = steps.filter("step_no = 0 and named is not null").select(*_OWNER, "named")
    e = cut(b.filter("kind = 'expression'").select(*PK, F.col("owner").alias("named"), F.col("body").alias("_body")).join(head.filter("kind = 'expression'").select(*PK, F.col("owner").alias("named"), F.col("named").alias("_next")), [*PK, "named"], "left"))
    own = b.join(head, _OWNER, "left").select(*_OWNER, F.lit(0).alias("hop"), "body", "named", F.when(F.col("kind") == "expression", F.array("owner")).otherwise(F.array().cast("array<string>")).alias("visited"))
    out, level, hop = own.select(*_OWNER, "hop", "body"), own, 0
    while True:
        hop += 1
        met = level.filter(F.col("named").isNotNull() & ~F.array_contains("visited", F.col("named")))
        level = cut(met.join(e, [*PK, "named"]).select(*_OWNER, F.lit(hop).alias("hop"), F.col("_body").alias("body"), F.col("_next").alias("_n"), F.concat("visited", F.array("named")).alias("visited")).withColumnRenamed("_n", "named"))
        if level.isEmpty():
            return out
        out = out.unionByName(level.select(*_OWNER, "hop", "body"))


def facts(chain: DataFrame, parameters: DataFrame) -> DataFrame:
    """What each body of a chain says, read in one pass over it: navigation, first source, native query, renames, selected and added columns, joins, expands."""
    values = parameters.groupBy(*PK).agg(F.map_from_entries(F.collect_list(F.struct("parameter", "value"))).alias("values"))
    m = F.col("body")
    f = chain.join(values, PK, "left").select(
        *_OWNER, "hop", mq.navigation(m, F.coalesce("values", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).alias("nav"), F.try_element_at(mq.data_sources(m), F.lit(1)).alias("source"), mq.native_query(m).alias("query"),
        mq.rename_pairs(m).alias("renames"), mq.selected_columns(m).alias("selected"), mq.added_columns(m).alias("added"), mq.nested_joins(m).alias("joins"), mq.expand_pairs(m).alias("expands"), "values",
    )
    value = lambda p, c: F.coalesce(F.try_element_at("values", F.col(f"source.{p}")), F.col(f"source.{c}"))
    filled = F.col("source").withField("server", F.when(F.col("source.server").isNotNull(), value("parameter", "server"))).withField("database", value("database_parameter", "database"))
    return f.withColumn("source", F.when(F.col("source").isNotNull(), filled)).drop("values")


def physical(f: DataFrame) -> DataFrame:
    """(pk, kind, owner, type, server, path, native_kind, query): the physical table of each owner, path null where none is named.

    Navigation is that of the chain's last body; the source and its native query are the first body's that has any.
    """
    last, first = F.max_by("nav", "hop"), F.min_by(F.struct("source", "query"), F.when(F.col("source").isNotNull(), F.col("hop")))
    p = f.groupBy(*_OWNER).agg(last.alias("nav"), first.alias("s")).select(*_OWNER, "nav", "s.source", F.regexp_replace(F.regexp_extract("s.query", r'(?s)^"(.*)"$', 1), '""', '"').alias("query"))
    native = F.col("query").isNotNull() & (F.col("query") != "")
    said = F.split(mq.sql_first_path(F.col("query")), r"\.")
    back = lambda k: F.when(native & F.col("nav.item").isNull(), F.try_element_at(said, F.lit(-k)))
    item = F.coalesce("nav.item", back(1))
    path = mq.physical_path(F.coalesce("nav.project", back(3)), "source.database", "nav.dataset", F.coalesce("nav.schema", back(2)), item)
    listed = mq.sql_select_list(F.col("query"))
    kind = F.when(native & (F.size(listed) > 0), F.when(F.array_contains(listed, "*"), "star").otherwise("list"))
    return p.select(*_OWNER, "source.type", "source.server", F.when(item.isNotNull(), path).alias("path"), kind.alias("native_kind"), F.when(native, listed).alias("listed"))


def _table_kinds(g: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """(pk, table_name, kind, entity_path, dax) of the tables of names: model-defined (a calculation group, or a parameter that lists NAMEOF), direct-lake, m or none."""
    lake = F.regexp_extract("expression_source", r"(?i)^\s*DirectLake\s*-\s*(.+?)\s*$", 1)
    known = g["expressions"].select(*PK, F.col("name").alias("expression_source"), F.lit(True).alias("_known"))
    p = g["partitions"].join(known, [*PK, "expression_source"], "left")
    entity = F.when(F.col("entity_name").isNotNull() & ((F.col("type") == "entity") | (F.col("mode") == "directlake")), mq.physical_path(F.coalesce(F.when(lake != "", lake), F.when(F.col("_known"), F.col("expression_source"))), "schema_name", "entity_name"))
    dax = F.when(F.col("type") == "calculated", F.col("m_body"))
    t = p.groupBy(*PK, "table_name").agg(F.first(entity, True).alias("entity_path"), F.first(dax, True).alias("dax"), F.bool_or(F.col("type") == "m").alias("is_m"))
    t = names.select(*PK, "table_name").distinct().join(t, [*PK, "table_name"], "left").join(g["groups"].withColumn("grouped", F.lit(True)), [*PK, "table_name"], "left")
    made = F.coalesce("grouped", F.lit(False)) | F.coalesce(F.col("dax").rlike(r"(?i)\bNAMEOF\s*\("), F.lit(False))
    kind = F.when(made, "model-defined").when(F.col("entity_path").isNotNull(), "direct-lake").when(F.coalesce("is_m", F.lit(False)), "m").otherwise("none")
    return t.select(*PK, "table_name", kind.alias("kind"), "entity_path", "dax")


def _deepest(f: DataFrame, what: str, key: str, *out: str) -> DataFrame:
    """One row a table and key: of several the one of the last hop, there the last written."""
    each = f.filter("kind = 'table'").select(*PK, F.col("owner").alias("table_name"), "hop", F.posexplode(what).alias("no", "x"))
    rank = F.struct("hop", "no")
    return each.groupBy(*PK, "table_name", F.col(f"x.{key}").alias(key)).agg(*(F.max_by(f"x.{c}", rank).alias(c) for c in out))


def source_map(files: DataFrame | None, g: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """From files (pk, path, content) to ``columns`` (the source map, with also_from), ``steps`` (spliced), ``tables`` (kind, path, upstream, intact) and the gold tables. g: those of the files, where they have been read already."""
    g = gold(files) if g is None else g
    b = g["bodies"]
    own = cut(own_steps(b))
    steps = cut(spliced(own))
    parameters = g["expressions"].filter("kind = 'parameter' and value is not null").select(*PK, F.col("name").alias("parameter"), "value")
    f = cut(facts(chains(b, own), parameters))
    place = cut(physical(f))
    columns = cut(g["columns"])
    kinds = cut(_table_kinds(g, columns))
    of_table = lambda df: df.filter("kind = 'table'").drop("kind").withColumnRenamed("owner", "table_name")

    # a name that no expression has may be another table of the model: the chain goes on there
    expressions = b.filter("kind = 'expression'").select(*PK, F.col("owner").alias("named"))
    tables = kinds.select(*PK, F.col("table_name").alias("named"))
    ts = of_table(steps)
    up = ts.filter("named is not null and named <> table_name").join(expressions, [*PK, "named"], "left_anti").join(tables, [*PK, "named"], "left_semi")
    upstream = cut(up.groupBy(*PK, "table_name").agg(F.min_by("named", "position").alias("upstream")))
    intact = cut(sm.name_chain(ts, upstream))

    tf = of_table(f)
    selected = tf.groupBy(*PK, "table_name").agg(F.min_by("selected", F.when(F.col("selected").isNotNull(), F.col("hop"))).alias("selected"))
    tp = of_table(place)
    t = kinds.join(tp, [*PK, "table_name"], "left").join(selected, [*PK, "table_name"], "left").join(intact, [*PK, "table_name"], "left").join(upstream, [*PK, "table_name"], "left")
    t = cut(t.select(*PK, "table_name", "kind", F.coalesce("entity_path", "path").alias("table_path"), "native_kind", "listed", "selected", F.col("selected").isNotNull().alias("has_projection"), F.coalesce("intact", F.lit(False)).alias("intact"), "upstream", "dax"))
    names = lambda c, name: t.select(*PK, "table_name", F.explode(c).alias(name))
    renames = _deepest(f, "renames", "new", "old").withColumnsRenamed({"new": "new_name", "old": "old_name"})
    added = tf.select(*PK, "table_name", F.explode("added").alias("added")).distinct()
    joins = _deepest(f, "joins", "column", "expression")
    paths = place.filter("kind = 'expression'").select(*PK, F.col("owner").alias("expression"), F.col("path").alias("expanded_path"))
    expands = _deepest(f, "expands", "new_name", "column", "source_name").join(joins, [*PK, "table_name", "column"], "left").join(paths, [*PK, "expression"], "left")
    expanded = expands.select(*PK, "table_name", F.col("new_name").alias("expanded"), "source_name", "expanded_path")
    ladder = t.select(*PK, "table_name", "kind", "table_path", "native_kind", "has_projection", "intact")
    first = cut(sm.resolve_columns(columns, ladder, renames, added, expanded, names("listed", "pq_name"), names("selected", "pq_name")))
    return g | {"columns": sm.link_derived(first, *derived_links(first, t, renames)), "steps": steps, "tables": t}


def derived_links(resolved: DataFrame, tables: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of columns that another table of the model feeds, and the further columns of the same name that a calculated table's DAX reads.

    A calculated table's column says its origin itself ('T'[c] as its source column): a sure hop. A table that reads another one has its columns under that
    table's query names, before its own renames: a sure hop where a rename says so or nothing in between may rename.
    """
    ref = r"^'?([^'\[\]]+?)'?\[([^\]]+)\]$"
    said = resolved.filter(F.col("pq_name").rlike(ref))
    stated = said.select(*PK, "model_table", "model_column", F.regexp_extract("pq_name", ref, 1).alias("from_table"), F.regexp_extract("pq_name", ref, 2).alias("from_column"), F.lit(0).alias("hop"))
    t = tables.filter("upstream is not null").select(*PK, F.col("table_name").alias("model_table"), "upstream", "selected", "intact")
    rn = renames.select(*PK, F.col("table_name").alias("model_table"), F.col("new_name").alias("pq_name"), "old_name")
    u = resolved.filter(~F.col("pq_name").rlike(ref)).join(t, [*PK, "model_table"]).join(rn, [*PK, "model_table", "pq_name"], "left")
    u = u.filter(F.col("selected").isNull() | F.array_contains("selected", F.col("pq_name")) | F.col("old_name").isNotNull())
    u = u.select(*PK, "model_table", "model_column", F.col("upstream").alias("from_table"), F.coalesce("old_name", "pq_name").alias("_name"), F.when(F.col("old_name").isNotNull() | F.col("intact"), 0).otherwise(1).alias("hop"))
    by_name = resolved.select(*PK, F.col("model_table").alias("from_table"), F.col("pq_name").alias("_name"), F.col("model_column").alias("from_column"))
    links = stated.unionByName(u.join(by_name, [*PK, "from_table", "_name"]).drop("_name"))
    dax = tables.filter("dax is not null").select(*PK, F.col("table_name").alias("model_table"), "dax")
    found = lambda k: F.regexp_extract_all("dax", F.lit(r"(?:'([^']+)'|([A-Za-z_]\w*))\[([^\]]+)\]"), F.lit(k)).alias(f"g{k}")
    reads = dax.select(*PK, "model_table", F.posexplode(F.arrays_zip(found(1), found(2), found(3))).alias("no", "x"))
    reads = reads.select(*PK, "model_table", "no", F.when(F.col("x.g1") != "", F.col("x.g1")).otherwise(F.col("x.g2")).alias("also_table"), F.col("x.g3").alias("also_column"))
    also = stated.join(reads, [*PK, "model_table"]).filter((F.lower("also_column") == F.lower("from_column")) & (F.lower("also_table") != F.lower("from_table")))
    return links, also.groupBy(*PK, "model_table", "model_column", "also_table", "also_column").agg(F.min("no").alias("no"))


def coverage(columns: DataFrame) -> DataFrame:
    """Per project and snapshot: columns by confidence and origin, and the share of traceable ones that have a source."""
    n = lambda c: F.count_if(c).alias
    o, c = F.col("origin"), F.col("confidence")
    s = columns.groupBy(*PK).agg(F.count("*").alias("total"), n(c == "exact")("exact"), n(c == "inferred")("inferred"), n(c == "unknown")("unknown"), n(o == "source")("sourced"), n(o == "unresolved")("unresolved"), n(o == "model-defined")("model_defined"), n(o.startswith("computed"))("computed"))
    both = F.col("sourced") + F.col("unresolved")
    return s.withColumn("coverage", F.when(both == 0, 0.0).otherwise(F.round(F.col("sourced") / both, 3)))


def ordered_steps(steps: DataFrame) -> DataFrame:
    """(pk, kind, owner, step_no, …): spliced steps numbered in their order."""
    w = Window.partitionBy(*_OWNER).orderBy("position")
    return steps.withColumn("step_no", F.row_number().over(w) - 1)
