"""Project trees as DataFrames of (project_id, snapshot_id, path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PK = ["project_id", "snapshot_id"]
# fixed values: folders that hold nothing to read, and the extensions that are read
SKIPPED = [".git", "node_modules", ".vscode", ".idea", ".pbi", "cache"]
EXTENSIONS = ["tmdl", "json", "pbir", "platform"]


def normalised(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^\./", "")


def wanted(path: Column) -> Column:
    """Whether a file is read: one of four extensions, in no skipped folder."""
    folders = "|".join(s.replace(".", r"\.") for s in SKIPPED)
    return F.lower(path).rlike(r"\.(" + "|".join(EXTENSIONS) + ")$") & ~path.rlike(rf"(^|/)({folders})/")


def read_projects(spark: SparkSession, root: str, snapshot: str) -> DataFrame:
    """Files below root/<project>/…, one row each, of one snapshot. Many small files: land the result once as Parquet, by snapshot."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    path = F.regexp_extract(F.col("_metadata.file_path"), r"(?i)" + root.rstrip("/").split(":")[-1].replace(".", r"\.") + "/(.*)$", 1)
    files = raw.select(path.alias("p"), F.col("value").alias("content")).withColumn("p", normalised(F.col("p")))
    out = files.select(F.regexp_extract("p", "^([^/]+)/", 1).alias("project_id"), F.lit(snapshot).alias("snapshot_id"), F.regexp_extract("p", "^[^/]+/(.*)$", 1).alias("path"), "content")
    return out.filter(wanted(F.col("path")))


def write_snapshot(files: DataFrame, root: str) -> None:
    """Land files by snapshot, so that a diff of two reads only these."""
    files.write.mode("append").partitionBy("snapshot_id").parquet(root)


def read_snapshots(spark: SparkSession, root: str, snapshots: list[str]) -> DataFrame:
    return spark.read.parquet(root).filter(F.col("snapshot_id").isin(snapshots))


def kind(path: Column, content: Column) -> Column:
    """Bucket of a file, the first that applies; null for what is not used."""
    p = F.lower(path)
    name = lambda s: (p == s) | p.endswith("/" + s)
    tmdl = F.when(p.contains("relationship"), "relationship").when(name("expressions.tmdl"), "expression").when(content.rlike(r"(?m)^table\s"), "table")
    json = (
        F.when(p.contains("/visuals/") & p.endswith("visual.json"), "visual").when(p.endswith(".bookmark.json") | p.rlike("(^|/)bookmarks/"), "bookmark")
        .when(p.endswith("reportextensions.json"), "extension").when(p.endswith("/page.json") | p.contains("/pages/") | p.endswith("/report.json"), "page")
    )
    return F.when(p.endswith(".tmdl"), tmdl).when(p.endswith(".json"), json).when(p.endswith(".pbir"), "page")


def resolve_relative(base: Column, relative: Column) -> Column:
    """base/relative with . and .. taken out."""
    parts = F.filter(F.split(F.concat(base, F.lit("/"), relative), "/"), lambda x: (x != "") & (x != "."))
    walk = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), walk), "/")


def report_pairs(files: DataFrame) -> DataFrame:
    """(pk, report_root, model_root, exists, visuals, chosen): every report with the model that its pointer names; the pair with most visuals is chosen.

    A pointer that is no JSON or names no path gives no pair.
    """
    root = F.regexp_replace("path", "/[^/]*$", "")
    pointers = files.filter(F.lower("path").endswith("definition.pbir")).select(*PK, root.alias("report_root"), F.get_json_object("content", "$.datasetReference.byPath.path").alias("to"))
    pairs = pointers.filter("to is not null").withColumn("model_root", resolve_relative(F.col("report_root"), F.col("to")))
    models = files.filter(F.lower("path").endswith(".tmdl")).select(*PK, F.regexp_extract("path", r"^(.*?\.SemanticModel)/", 1).alias("model_root")).distinct().withColumn("exists", F.lit(True))
    shown = files.filter(F.lower("path").endswith("visual.json")).groupBy(*PK, F.regexp_extract("path", r"^(.*?\.Report)/", 1).alias("report_root")).agg(F.count("*").alias("visuals"))
    out = pairs.drop("to").join(models, [*PK, "model_root"], "left").join(shown, [*PK, "report_root"], "left").withColumns({"exists": F.coalesce("exists", F.lit(False)), "visuals": F.coalesce("visuals", F.lit(0))})
    w = Window.partitionBy(*PK).orderBy(F.desc("exists"), F.desc("visuals"), "report_root")
    return out.withColumn("chosen", F.col("exists") & (F.row_number().over(w) == 1))
