"""The typed graph of a project's model and report: nodes, and edges of fourteen kinds, from the tables that the readers make.

Every edge is a reference that may be written in several forms. A reference offers its forms in order, each with the node that it would mean and the kind of
edge that it would make; the first form whose node exists binds (``bind_forms``), by one equi-join for all projects and snapshots.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dax, mquery as mq
from . import estate
from .binding import bind
from .common import PK, cut, node_id

_EDGE = [*PK, "source", "target", "type"]


def visual_node(page: str | Column = "page_id", visual: str | Column = "visual_id") -> Column:
    return F.concat(F.lit("visual::"), page, F.lit("/"), visual)


def form(target: Column, kind: str) -> Column:
    return F.struct(target.alias("target"), F.lit(kind).alias("type"))


def bind_forms(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pk, source, target, type): of each reference (pk, source, forms) the first form whose target is a node; references to oneself are dropped."""
    each = refs.select(*PK, "source", F.xxhash64("source", "forms").alias("ref"), F.posexplode("forms").alias("no", "f")).select(*PK, "source", "ref", "no", "f.target", "f.type")
    met = each.join(nodes.select(*PK, F.col("id").alias("target")).distinct(), [*PK, "target"], "left_semi")
    best = met.groupBy(*PK, "source", "ref").agg(F.min(F.struct("no", "target", "type")).alias("b")).select(*PK, "source", "b.target", "b.type")
    return best.filter("source <> target").distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def offers(g: dict[str, DataFrame]) -> DataFrame:
    """(pk, parameter_table, display_name, ref_table, ref_name, ordinal): what each field parameter offers."""
    p = g["partitions"].filter("type = 'calculated'").filter(F.col("m_body").rlike(r"(?i)\bNAMEOF\s*\("))
    return p.select(*PK, F.col("table_name").alias("parameter_table"), F.explode(dax.parameter_rows(F.col("m_body"))).alias("o")).select(*PK, "parameter_table", "o.display_name", "o.ref_table", "o.ref_name", "o.ordinal")


def nodes(g: dict[str, DataFrame], pages: DataFrame, visuals: DataFrame) -> DataFrame:
    """(pk, id, type, name): tables, columns, measures, shared expressions, pages and visuals."""
    t = g["objects"].filter("object = 'table'").select(*PK, node_id("table", F.col("name")).alias("id"), F.lit("table").alias("type"), "name")
    c = g["columns"].select(*PK, node_id("column", F.col("table_name"), F.col("name")).alias("id"), F.lit("column").alias("type"), "name")
    m = g["measures"].select(*PK, node_id("measure", F.col("table_name"), F.col("name")).alias("id"), F.lit("measure").alias("type"), "name")
    e = g["expressions"].filter("kind = 'expression'").select(*PK, node_id("expression", F.col("name")).alias("id"), F.lit("expression").alias("type"), "name")
    p = pages.select(*PK, node_id("page", F.col("page_id")).alias("id"), F.lit("page").alias("type"), "name")
    v = visuals.select(*PK, visual_node().alias("id"), F.lit("visual").alias("type"), F.coalesce("title", "visual_type").alias("name"))
    return _union([t, c, m, e, p, v]).distinct()


def _text_edges(g: dict[str, DataFrame], known: DataFrame) -> list[DataFrame]:
    """What DAX names: measures and columns that measures and calculated columns read, and the columns of USERELATIONSHIP."""
    objects = g["measures"].select(*PK, F.lit("measure").alias("kind"), "table_name", "name").unionByName(g["columns"].select(*PK, F.lit("column").alias("kind"), "table_name", "name"))
    of_measures = dax.references(g["measures"]).withColumn("owner_kind", F.lit("measure"))
    of_columns = dax.references(g["columns"].filter("is_calculated")).withColumn("owner_kind", F.lit("column"))
    calc = bind(of_columns, objects).withColumn("type", F.concat(F.lit("calc_"), "type"))
    used = g["measures"].select(*PK, node_id("measure", F.col("table_name"), F.col("name")).alias("source"), F.explode(dax.use_relationships(F.col("expression"))).alias("u"))
    ends = [used.select(*PK, "source", F.array(form(node_id("column", F.col(f"u.{e}_table"), F.col(f"u.{e}_column")), "measure_to_userelationship")).alias("forms")) for e in ("from", "to")]
    return [bind(of_measures, objects), calc, *(bind_forms(e, known) for e in ends)]


def _source_edges(g: dict[str, DataFrame], known: DataFrame) -> list[DataFrame]:
    """What M text names: sources, shared expressions, joined tables. A table whose own text has no source takes that of the expression that it names first."""
    b = g["bodies"]
    parameters = g["expressions"].filter("kind = 'parameter' and value is not null").groupBy(*PK).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("values"))
    s = b.select(*PK, "kind", "owner", F.try_element_at(mq.data_sources(F.col("body")), F.lit(1)).alias("s")).filter("s is not null").join(parameters, PK, "left")
    said = lambda p, c: F.coalesce(F.try_element_at("values", F.col(f"s.{p}")), F.col(f"s.{c}"))
    server, database = F.lower(F.when(F.col("s.server").isNotNull(), said("parameter", "server"))), said("database_parameter", "database")
    key = F.when(database.isNotNull(), F.concat(F.coalesce(server, F.lit("")), F.lit("/"), database)).otherwise(server)
    sources = cut(s.select(*PK, "kind", "owner", F.concat(F.lit("source::"), key).alias("target")).filter("target is not null"))
    names = b.filter("kind = 'table'").select(*PK, "owner", F.posexplode(F.regexp_extract_all("body", F.lit(r'(Source\s*=\s*|^\s*)?(#"[^"]+"|(?<!["\w.])[A-Za-z_]\w*(?!["\w.(]))'), F.lit(0))).alias("no", "x"))
    names = names.select(*PK, "owner", "no", (~F.col("x").rlike(r"^\s*Source\s*=")).alias("later"), F.regexp_replace(F.regexp_replace(F.trim("x"), r"^Source\s*=\s*", ""), r'^#"(.*)"$', "$1").alias("name"))
    linked = names.join(b.filter("kind = 'expression'").select(*PK, F.col("owner").alias("name")), [*PK, "name"]).groupBy(*PK, "owner").agg(F.min(F.struct("later", "no", "name")).alias("b")).select(*PK, "owner", F.col("b.name").alias("expression"))
    linked = cut(linked)
    table, expression = (lambda c: node_id("table", F.col(c))), (lambda c: node_id("expression", F.col(c)))
    own = sources.filter("kind = 'table'")
    through = linked.join(own, [*PK, "owner"], "left_anti").join(sources.filter("kind = 'expression'").select(*PK, F.col("owner").alias("expression"), "target"), [*PK, "expression"])
    joins = b.filter("kind = 'table'").select(*PK, "owner", "body").unionByName(linked.join(b.filter("kind = 'expression'").select(*PK, F.col("owner").alias("expression"), "body"), [*PK, "expression"]).select(*PK, "owner", "body"))
    joined = joins.select(*PK, table("owner").alias("source"), F.explode(mq.nested_joins(F.col("body"))).alias("j"))
    return [
        sources.filter("kind = 'expression'").select(*PK, expression("owner").alias("source"), "target", F.lit("expression_to_source").alias("type")),
        own.select(*PK, table("owner").alias("source"), "target", F.lit("table_to_source").alias("type")),
        through.select(*PK, table("owner").alias("source"), "target", F.lit("table_to_source").alias("type")),
        linked.select(*PK, table("owner").alias("source"), expression("expression").alias("target"), F.lit("table_to_expression").alias("type")),
        bind_forms(joined.select(*PK, "source", F.array(form(node_id("table", F.col("j.expression")), "table_to_table_join")).alias("forms")), known),
    ]


def edges(g: dict[str, DataFrame], pages: DataFrame, visuals: DataFrame, fields: DataFrame) -> DataFrame:
    """(pk, source, target, type) of all kinds. g: gold tables of ``estate.gold``; fields: (pk, page_id, visual_id, kind, table_name, name).

    A field of a visual means a parameter where its table is one, else the measure or column that it names, whether the model has it or not.
    """
    known = cut(nodes(g, pages, visuals))
    offered = cut(offers(g))
    columns = g["columns"].select(*PK, node_id("column", F.col("table_name"), F.col("name")).alias("source"), node_id("table", F.col("table_name")).alias("target"), F.lit("column_to_table").alias("type"))
    r = g["relationships"].select(*PK, node_id("table", F.col("from_table")).alias("source"), F.array(form(node_id("table", F.col("to_table")), "table_relationship")).alias("forms"))
    related = bind_forms(r, known).join(known.select(*PK, F.col("id").alias("source")), [*PK, "source"], "left_semi")
    placed = bind_forms(visuals.select(*PK, visual_node().alias("source"), F.array(form(node_id("page", F.col("page_id")), "visual_to_page")).alias("forms")), known)
    parameter = offered.select(*PK, F.col("parameter_table").alias("table_name"), F.lit(True).alias("is_parameter")).distinct()
    f = fields.join(parameter, [*PK, "table_name"], "left")
    field = F.when(F.col("is_parameter"), node_id("table", F.col("table_name"))).when(F.col("kind") == "measure", node_id("measure", F.col("table_name"), F.col("name"))).otherwise(node_id("column", F.col("table_name"), F.col("name")))
    shown = f.select(*PK, visual_node().alias("source"), field.alias("target"), F.lit("visual_to_field").alias("type")).distinct()
    forms = F.array(form(node_id("measure", F.col("ref_table"), F.col("ref_name")), "field_param_to_field"), form(node_id("column", F.col("ref_table"), F.col("ref_name")), "field_param_to_field"))
    params = bind_forms(offered.filter("ref_table is not null").select(*PK, node_id("table", F.col("parameter_table")).alias("source"), forms.alias("forms")), known)
    return _union([x.select(*_EDGE) for x in [columns, related, placed, shown, params, *_text_edges(g, known), *_source_edges(g, known)]]).distinct()


def display_names(g: dict[str, DataFrame]) -> DataFrame:
    """(pk, parameter, target, display_name): what a parameter calls the measure or column that it offers, by node ids; of repeated offers the last."""
    o = offers(g).filter("ref_table is not null")
    w = Window.partitionBy(*PK, "parameter_table", "ref_table", "ref_name").orderBy(F.desc("ordinal"))
    o = o.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return o.select(*PK, node_id("table", F.col("parameter_table")).alias("parameter"), F.explode(F.array(node_id("measure", F.col("ref_table"), F.col("ref_name")), node_id("column", F.col("ref_table"), F.col("ref_name")))).alias("target"), "display_name")
