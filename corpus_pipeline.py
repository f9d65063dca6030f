"""A corpus pipeline: filter by quality, drop near-duplicates, sanitise, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs; all
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lineagrid.llm.common import folder, land, table
from lineagrid.llm.mixing import mix
from lineagrid.llm.near_duplicates import near_duplicates
from lineagrid.llm.private_data import all_spans, find_private, sanitise
from lineagrid.llm.quality import resample
from lineagrid.llm.sentencepiece_codec import encode_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _md5(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))


def _joined(docs: DataFrame, decisions: DataFrame, how: str) -> DataFrame:
    """docs with what was decided about a row of their id and text (null ids count as equal)."""
    d = decisions.withColumnsRenamed({"doc_id": "_id", "text_md5": "_md5"})
    docs = _md5(docs)
    return docs.join(d, docs.doc_id.eqNullSafe(d._id) & (docs.text_md5 == d._md5), how)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws.

    Null and empty texts have weight 0 and stay where that is enough; rows equal in id and text are drawn together, as one decision for both; an
    empty table gives none.
    """
    kept = resample(docs, table(spark, sf_dir, "labels")).select("doc_id", "text_md5").distinct()
    return _joined(docs, kept, "left_semi").select(*COLUMNS)


def _nodes(docs: DataFrame) -> DataFrame:
    """docs with ``node``: doc_id, but for ids that stand for several texts, and rows without an id, a number above 2^62 from id and text."""
    docs = _md5(docs)
    several = land(docs.groupBy("doc_id").agg(F.min("text_md5").alias("lo"), F.max("text_md5").alias("hi")).filter("lo < hi and doc_id is not null").select("doc_id", F.lit(True).alias("several")))
    own = F.lit(2**62) + F.pmod(F.xxhash64("doc_id", "text_md5"), F.lit(2**62))
    return docs.join(several, "doc_id", "left").withColumn("node", F.when(F.col("several") | F.col("doc_id").isNull(), own).otherwise(F.col("doc_id"))).drop("several", "text_md5")


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document: that of the smallest id, or one whose id or text stands alone.

    Rows equal in id and text are one document, of which the row that is least by lang, source and n_chars stays; one id with several texts is as many documents, and so are texts without an id. Null
    and empty texts are like nothing, not even each other; of those without an id one stays.
    """
    rows = _nodes(docs)
    kept = near_duplicates(rows.select(F.col("node").alias("doc_id"), "text")).filter("doc_id = component_id").select(F.col("doc_id").alias("node")).distinct()
    same = rows.join(kept, "node", "left_semi").groupBy("node").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("m"))
    return same.select("doc_id", "text", "m.*").select(*COLUMNS)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose personal data and disclosing terms are replaced by the name of their kind; no row goes.

    Null and empty texts have no spans and stay as they are; rows equal in id and text are changed alike. Terms count from one text on: a document that holds an
    entity loses the words that stand in few texts but its own, about thirty (0.4 % of all words at sf0.1, where 440 of 10,000 documents hold one).
    """
    spans = all_spans(F.col("base"), F.col("terms"))
    found = find_private(docs).select("doc_id", "text_md5", spans.alias("spans")).filter(F.size("spans") > 0).dropDuplicates(["doc_id", "text_md5"])
    text = F.when(F.col("spans").isNotNull(), sanitise(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return _joined(docs, found, "left").select("doc_id", text.alias("text"), "lang", "source").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, in the order of the slots in which they begin; one that the schedule goes through twice stands twice.

    A document that the end of its source's target cuts stays whole if at least half of it is taken, so that a source misses its
    target by half a document at most; one of which nothing is taken, as of a null or empty text, is gone. Rows equal in id and text stand as often as the mix takes them.
    """
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "text_md5", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))).alias("key")
    parts = mix(docs).select(key, "size", F.explode("parts").alias("p")).filter(2 * F.col("p.words") >= F.col("size"))
    taken = parts.groupBy("key").agg(F.collect_list("p.slot").alias("slots"))  # a slot a copy and pass
    once = F.row_number().over(Window.partitionBy("key").orderBy("lang"))
    rows = _md5(docs).select(*COLUMNS, key).withColumn("r", once).filter("r = 1")
    mix_ = rows.join(taken, "key").select(*COLUMNS, F.explode("slots").alias("slot"))
    return mix_.repartitionByRange("slot").sortWithinPartitions("slot", "doc_id").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digests; a null or empty text has the begin and end ids alone, repeated rows the same."""
    return encode_documents(docs, with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", dedupe), ("private_data", sanitised), ("mixing", mixed), ("sentencepiece", encoded)]

#: SQL can express neither the first stage's hashed models nor the last one's encoding; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what lies between them is written to the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
