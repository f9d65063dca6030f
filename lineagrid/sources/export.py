"""Documentation of each project as ordered lines, and a sink that writes one file a project.

A document is never a row: its lines are rows (section, part, position, line) from the start, sorted where they are written. A file takes one task, as it
is one sequence, but only as a stream.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import mquery as mq
from ..operators.estate import ordered_steps

PK = ["project_id", "snapshot_id"]
_LINE = [*PK, "section", "part", "position", "line"]
#: Marks of how certain a column's source is.
MARKS = {"exact": "●", "inferred": "◐", "unknown": "○"}


def cell(text: Column) -> Column:
    """A text as a cell of a table: pipes escaped, on one line."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\|", "\\\\|"), r"[\r\n]+", " ")


def row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, cells)), F.lit(" |"))


def _lines(df: DataFrame, section: int, part: Column, first: int, *lines: str | Column) -> DataFrame:
    """Lines of fixed places for each row of df."""
    texts = F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))
    return df.select(*PK, F.lit(section).alias("section"), part.alias("part"), F.posexplode(texts).alias("i", "line")).select(*PK, "section", "part", (F.col("i") + first).cast("long").alias("position"), "line").filter("line is not null")


def _numbered(df: DataFrame, section: int, part: Column, first: int, order: list, line: Column) -> DataFrame:
    """A line for each row of df, in an order within its part."""
    w = Window.partitionBy(*PK, "part").orderBy(*order)
    return df.withColumn("part", part).withColumn("line", line).select(*PK, F.lit(section).alias("section"), "part", (F.row_number().over(w) + first).cast("long").alias("position"), "line")


def _head(*names: str) -> tuple[str, str]:
    return "| " + " | ".join(names) + " |", "|" + "-|" * len(names)


def documents(mapped: dict[str, DataFrame], edges: DataFrame, title: str = "Model") -> DataFrame:
    """(pk, section, part, position, line): the documentation of every project. mapped: what ``estate.source_map`` gives; edges: the graph's.

    Overview with counts and coverage, tables with their sources, each table's columns with physical column, type and confidence and its query steps,
    measures with the number of visuals that show them, and their DAX.
    """
    none, mark = F.lit(""), F.coalesce(*(F.when(F.col("confidence") == k, F.lit(f"{v} {k}")) for k, v in MARKS.items()))
    columns = mapped["columns"].join(mapped["objects"].filter("object = 'column'").select(*PK, F.col("table_name").alias("model_table"), F.col("name").alias("model_column"), F.col("props")["dataType"].alias("data_type")), [*PK, "model_table", "model_column"], "left")
    shown = edges.filter("type = 'visual_to_field'").groupBy(*PK, F.col("target").alias("id")).agg(F.countDistinct("source").alias("n"))
    measures = mapped["measures"].withColumn("id", F.concat(F.lit("measure::"), F.concat_ws(".", "table_name", "name"))).join(shown, [*PK, "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tables = mapped["tables"].select(*PK, "table_name", F.when(F.col("kind").isin("m", "direct-lake"), F.col("table_path")).alias("path"))
    count = lambda df, name: df.groupBy(*PK).agg(F.count("*").alias("n")).withColumn("what", F.lit(name))
    counts = reduce(DataFrame.unionByName, [count(tables, "Tables"), count(columns, "Columns"), count(measures, "Measures"), count(mapped["relationships"], "Relationships")])
    projects = tables.select(*PK).distinct()
    o, c = F.col("origin"), F.col("confidence")
    said = columns.groupBy(*PK).agg(F.count_if(o == "source").alias("s"), F.count_if(o == "unresolved").alias("u"), *(F.count_if(c == k).alias(k) for k in MARKS))
    covered = F.format_string("**%d of %d columns** that read from a source are traced to a physical column. Confidence: %d stated, %d assumed, %d unresolved.", "s", F.col("s") + F.col("u"), "exact", "inferred", "unknown")
    per_table = columns.groupBy(*PK, F.col("model_table").alias("table_name")).agg(F.count("*").alias("n_columns")).join(measures.groupBy(*PK, "table_name").agg(F.count("*").alias("n_measures")), [*PK, "table_name"], "left")
    listed = tables.join(per_table, [*PK, "table_name"], "left")
    steps = ordered_steps(mapped["steps"].filter("kind = 'table'")).withColumn("table_name", F.col("owner"))
    stepped = steps.select(*PK, "table_name").distinct()
    name, table = F.col("name"), F.col("table_name")
    far = 1 << 40  # behind a table's columns
    parts = [
        _lines(projects, 10, none, 0, f"# {title}", "", "## Overview", "", *_head("", "Count")),
        _numbered(counts, 11, none, 0, [F.array_position(F.array(*map(F.lit, ["Tables", "Columns", "Measures", "Relationships"])), F.col("what"))], row(F.col("what"), F.col("n"))),
        _lines(said, 12, none, 0, "", covered, "", "## Tables", "", *_head("Table", "Physical source", "Columns", "Measures")),
        _numbered(listed, 13, none, 0, ["table_name"], row(table, F.coalesce("path", F.lit("_unresolved_")), F.coalesce("n_columns", F.lit(0)), F.coalesce("n_measures", F.lit(0)))),
        _lines(tables, 20, table, 0, "", F.concat(F.lit("### "), table), F.when(F.col("path").isNotNull(), ""), F.concat(F.lit("**Source:** `"), F.col("path"), F.lit("`")), "", *_head("Column", "Physical column", "Type", "Confidence")),
        _numbered(columns, 20, F.col("model_table"), 10, ["model_column"], row(F.col("model_column"), F.coalesce("physical_path", F.lit("_unresolved_")), F.col("data_type"), mark)),
        _lines(stepped, 20, table, far, "", *_head("#", "Step", "Kind")),
        _numbered(steps, 20, table, far + 10, ["step_no"], row(F.col("step_no") + 1, name, mq.step_kind(F.col("expression")))),
        _lines(projects, 30, none, 0, "", "## Measures", "", *_head("Measure", "Table", "Shown in")),
        _numbered(measures, 31, none, 0, ["table_name", "name"], row(name, table, F.when(F.col("n") == 0, "_no visual_").otherwise(F.concat(F.col("n").cast("string"), F.lit(" visuals"))))),
    ]
    said_in = F.transform(F.split(F.trim("expression"), r"\r?\n"), lambda x: x)
    dax = F.concat(F.array(F.lit(""), F.concat(F.lit("### "), table, F.lit("["), name, F.lit("]")), F.lit(""), F.lit("```dax")), said_in, F.array(F.lit("```")))
    text = measures.filter("expression is not null").select(*PK, F.lit(40).alias("section"), F.concat_ws("\u0000", "table_name", "name").alias("part"), F.posexplode(dax).alias("i", "line")).select(*PK, "section", "part", F.col("i").cast("long").alias("position"), "line")
    return reduce(DataFrame.unionByName, [p.select(*_LINE) for p in [*parts, text]])


def numbered(lines: DataFrame) -> DataFrame:
    """(pk, line_no, line): lines in the order of their document, from 1."""
    w = Window.partitionBy(*PK).orderBy("section", "part", "position")
    return lines.select(*PK, F.row_number().over(w).alias("line_no"), "line")


def write_documents(lines: DataFrame, path: str) -> None:
    """One text file for each project and snapshot, under path/snapshot_id=…/project_id=…; its lines stream through one task in their order."""
    keys = ["snapshot_id", "project_id"]
    lines.repartition(*keys).sortWithinPartitions(*keys, "section", "part", "position").select(*keys, "line").write.partitionBy(*keys).text(path)


def read_document(spark: SparkSession, path: str, snapshot: str, project: str) -> str:
    """One document as a whole, for a reader of one."""
    return "".join(r.value for r in spark.read.text(f"{path}/snapshot_id={snapshot}/project_id={project}", wholetext=True).collect())
