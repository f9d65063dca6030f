"""Quality filter by importance resampling.

Two generative models over hashed n-grams, one of target text (rows labelled good) and one of all raw text, give every document a
log importance weight: the sum, over its n-grams, of the log of the ratio of their probabilities, tempered so that a long document weighs
as ``length`` of its n-grams would on average (else the sum, and with it the draw, would be a matter of length alone). Adding Gumbel
noise and taking the k largest draws k documents without replacement in proportion to their weights. n-grams are of bytes (3); beside them
stands one event a word, whether it repeats the word before it, as repetition is what byte n-grams can't see.

The raw model counts all documents; the target model counts a bounded sample of labelled rows. k, if not given, is the estimated size of
the target-like part of the corpus: the number of documents whose weight ``recall`` of the labelled good rows reach, each by a
target model without it. The noise then decides which of the documents near that border are drawn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix, table, word_hashes

BUCKETS = 1 << 14
_rng = np.random.default_rng(11)
_BYTES = _rng.integers(1, 2**63, (3, 256), dtype=np.uint64)
_PIECE = 1 << 20


def ngram_counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text, then of words unlike and like the word before; long texts in pieces."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    out = np.zeros(buckets + 2, dtype=np.int64)
    for at in range(0, max(0, len(data) - 2), _PIECE):
        b = data[at : at + _PIECE + 2]
        h = _BYTES[0][b[:-2]] + _BYTES[1][b[1:-1]] + _BYTES[2][b[2:]]
        out[:buckets] += np.bincount((mix(h) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    w = word_hashes(text)
    same = int((w[1:] == w[:-1]).sum())
    out[buckets:] = max(0, len(w) - 1 - same), same
    return out


def _totals(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts over all texts and over those labelled good: each task adds up its own, then a row a bucket is added up over the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, good = np.zeros(buckets + 2, dtype=np.int64), np.zeros(buckets + 2, dtype=np.int64)
        for b in batches:
            for t, label in zip(b.column(0), b.column(1)):
                c = ngram_counts(t.as_py(), buckets)
                total += c
                if label.as_py() == 1:
                    good += c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets + 2)), pa.array(total), pa.array(good)], names=["bucket", "n", "good"])

    found = rows.select("text", "quality").mapInArrow(run, "bucket long, n long, good long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect()
    raw, target = np.zeros(buckets + 2), np.zeros(buckets + 2)
    for r in found:
        raw[r.bucket], target[r.bucket] = r.n, r.good
    return raw, target


def _log_model(counts: np.ndarray, buckets: int) -> np.ndarray:
    grams, words = counts[:buckets] + 1, counts[buckets:] + 1
    return np.concatenate([np.log(grams / grams.sum()), np.log(words / words.sum())])


def tempered(counts: np.ndarray, weights: np.ndarray, length: int) -> float:
    """The sum of the n-grams' log ratios, cut in proportion to ``length`` n-grams where there are more."""
    return float(counts @ weights) * min(1.0, length / max(1, int(counts.sum())))


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise, fixed for each doc_id and seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(-F.log(u))


def _keep_top(scored: DataFrame, k: int, bins: int = 1024, few: int = 10_000) -> DataFrame:
    """The k rows of largest score (ties: smaller doc_id, null ids last, then rid) without sorting them all.

    The bin that holds the k-th row is cut into ``bins`` again, by score and then by id, until it holds at most ``few`` rows;
    only those are sorted. What comes to the driver is a count a bin.
    """
    sure, edge, left = F.lit(False), F.lit(True), k
    order = [-F.col("score"), F.coalesce(F.col("doc_id").cast("double"), F.lit(float(2**63))), F.col("rid").cast("double")]
    for value in order:
        while True:
            s = scored.filter(edge).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
            if s.n <= left:
                return scored.filter(sure | edge)
            if s.n <= few or s.lo == s.hi:
                break
            bin_ = F.least(F.floor((value - F.lit(s.lo)) / F.lit(s.hi - s.lo) * bins), F.lit(bins - 1))
            above = 0
            for b, n in sorted((r.b, r.n) for r in scored.filter(edge).groupBy(bin_.alias("b")).agg(F.count("*").alias("n")).collect()):
                if above + n > left:
                    break
                above += n
            sure, edge, left = sure | (edge & (bin_ < b)), edge & (bin_ == b), left - above
        if s.n <= few:
            break
    return scored.filter(sure).unionByName(scored.filter(edge).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rid").limit(left))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, recall: float = 0.998, seed: int = 5, sample: int = 20_000, buckets: int = BUCKETS, length: int = 100) -> DataFrame:
    """The drawn rows: rid, doc_id, text_md5, log_weight (tempered) and score (with noise); rid is monotonically_increasing_id of docs' rows.

    At most ``sample`` labelled rows are used, the smallest by a hash of doc_id. Null and empty texts have no n-grams, weight
    0; without good labels every weight is 0 and all rows stay. Rows that repeat a doc_id get equal noise and are drawn separately; ties go to the smaller
    doc_id, null ids last. Other columns are ignored. An empty table gives no rows.
    """
    labelled = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = cut(labelled)  # at most ``sample`` rows, so it may be broadcast
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "text")
    rows = rows.join(F.broadcast(labelled), "doc_id", "left").select("rid", "doc_id", "text_md5", "text", "quality")
    raw, target = _totals(rows, buckets)
    log_raw = _log_model(raw, buckets)
    weights = (_log_model(target, buckets) - log_raw) if target.sum() else np.zeros(buckets + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, left_out = [], []
            for t, label in zip(b.column(3), b.column(4)):
                c = ngram_counts(t.as_py(), buckets)
                w.append(tempered(c, weights, length))
                # a labelled good row's weight by a target model without it: what a row like it would get that has no label
                left_out.append(tempered(c, _log_model(target - c, buckets) - log_raw, length) if label.as_py() == 1 else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(w, pa.float64()), pa.array(left_out, pa.float64())], names=["rid", "doc_id", "text_md5", "log_weight", "left_out"])

    scored = rows.mapInArrow(run, "rid long, doc_id long, text_md5 string, log_weight double, left_out double")
    scored = cut(scored.withColumn("score", F.col("log_weight") + gumbel(seed)))
    if k is None:
        edge = scored.agg(F.percentile("left_out", 1 - recall).alias("p")).first().p  # over at most ``sample`` weights
        k = scored.count() if edge is None else scored.filter(F.col("log_weight") >= edge).count()
    return _keep_top(scored.drop("left_out"), k)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "score")


QUERIES = {"op2_quality": op2_quality}
ORACLES: dict[str, str] = {}
