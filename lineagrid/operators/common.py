"""Keys and materialisation that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every table carries these; names are unique only inside a project's snapshot.
PK = ["project_id", "snapshot_id"]


def shared_folder(spark: SparkSession) -> str:
    """The folder for what is written in between: the session's ``spark.checkpoint.dir``.

    Without that setting a session on one machine (master local) gets a folder of its own, as in tests; any other is refused, as executors can't see the driver's disk.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lineagrid-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df to the shared folder (partitioned by a column, if one is named) and read it again: loops would otherwise grow their plans.

    A written table survives lost executors and brings its size along, by which joins with small rounds turn into broadcasts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def ref(table, name) -> Column:
    """Table[Name]."""
    return F.concat(table, F.lit("["), name, F.lit("]"))


def node_id(kind: str, *parts) -> Column:
    """A graph id: kind::a.b"""
    return F.concat(F.lit(f"{kind}::"), F.concat_ws(".", *parts))
