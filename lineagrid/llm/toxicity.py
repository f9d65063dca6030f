"""Toxicity by cumulative-link ordinal regression.

Grades are ordered: 0 not toxic, 1 toxic, 2 toxic and confirmed. Labels say toxic or not; a toxic row is confirmed where a model
fitted on the other half of the labelled rows, which has seen neither its label nor its text, finds it toxic too. A caller whose labels are graded names their column
instead, with any number of grades. With one weight vector w over sparse word features and increasing thresholds, P(grade > j) =
sigmoid(w.x - theta_j); all thresholds share w. The expected severity is the sum of P(grade > j). The model is fitted on a bounded
sample of labelled rows, and scores every document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, cut, table

_WORD = re.compile(WORD)
_LOWER = {c: c + 32 for c in range(65, 91)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(rows: list[list[int]], grades: np.ndarray, features: int, top: int = 2, l2: float = 0.1, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a proportional-odds model on rows of feature numbers, by gradient steps with momentum and adaptive scale."""
    n = max(1, len(rows))
    flat = np.array([f for r in rows for f in r], dtype=np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, first, gap = np.zeros(features), 1.0, np.zeros(top - 1)
    p = np.concatenate([w, [first], gap])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, rounds + 1):
        w, theta = p[:features], p[features] + np.concatenate([[0.0], np.cumsum(np.exp(p[features + 1 :]))])
        x = np.bincount(row, weights=w[flat], minlength=len(rows))
        above = np.concatenate([np.ones((len(rows), 1)), _sigmoid(x[:, None] - theta[None, :]), np.zeros((len(rows), 1))], axis=1)
        at = np.arange(len(rows))
        upper, lower = above[at, grades], above[at, grades + 1]  # P(grade >= y), P(grade > y)
        like = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / like, lower * (1 - lower) / like
        gx = -(du - dl)
        gt = np.zeros(top)
        for j in range(top):
            gt[j] = (du * (grades == j + 1)).sum() - (dl * (grades == j)).sum()
        g = np.concatenate([np.bincount(flat, weights=gx[row], minlength=features) + l2 * w, [gt.sum()], [gt[j + 1 :].sum() * np.exp(p[features + 1 + j]) for j in range(top - 1)]]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return p[:features], p[features] + np.concatenate([[0.0], np.cumsum(np.exp(p[features + 1 :]))])


def sample_labels(docs: DataFrame, labels: DataFrame, sample: int = 20_000, grade: str = "toxic") -> DataFrame:
    """(doc_id, grade, fold, w) of at most ``sample`` labelled ids, the smallest by a hash: w holds the distinct words of the text, fold (0 or 1) is drawn by doc_id.

    An id labelled more than once has the highest of its grades, one that has several texts the least of them in text order; labels without an id or grade don't count.
    """
    chosen = labels.select("doc_id", F.col(grade).cast("int").alias("grade")).filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = cut(chosen)  # at most ``sample`` rows, so it may be broadcast
    words = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    return texts.select("doc_id", "grade", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int").alias("fold"), words.alias("w"))


def telling(words: DataFrame, n: Column, t: Column, total: int, above: int, most: int, least_docs: int, least_z: float) -> list[str]:
    """Words whose log odds between the ``above`` rows over grade 0 and the other ones of ``total`` differ most from 0 against
    their standard error, ties in word order; n and t count a word's rows, all and over grade 0, and half a row is added to each cell."""
    a, b, c, d = t + 0.5, n - t + 0.5, F.lit(float(above)) - t + 0.5, F.lit(float(total - above)) - (n - t) + 0.5
    z = (F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    picked = words.filter(n >= least_docs).withColumn("z", z).filter(F.abs("z") >= least_z).orderBy(F.desc(F.abs("z")), "word").limit(most)
    return [r.word for r in picked.collect()]


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, most_features: int = 2000, least_docs: int = 3, least_z: float = 2.0, cutoff: float = 0.5, grade: str | None = None) -> dict:
    """Fit on at most ``sample`` labelled rows: words, weights, thresholds.

    grade: the labels' column of grades; without it, toxic and confirmed by the other fold. Features are the telling words of at least
    ``least_docs`` sampled documents, ``most_features`` at most and each by ``least_z`` standard errors. Where all rows have one grade, or none is over 0,
    there are no features, and the thresholds alone say how often each grade was seen; without labels no text is toxic.
    """
    rows = cut(sample_labels(docs, labels, sample, grade or "toxic").withColumn("t", (F.col("grade") > 0).cast("int")))
    counts = rows.groupBy("fold", "grade").agg(F.count("*").alias("n")).collect()  # a row a fold and grade
    number = lambda folds, least: sum(r.n for r in counts if r.fold in folds and r.grade >= least)
    total, top = number((0, 1), 0), max([1, *(r.grade for r in counts)])
    if not total:
        return {"words": [], "weights": [], "thresholds": [30.0]}
    if number((0, 1), 1) in (0, total):
        share = [(number((0, 1), j + 1) + 0.5) / (total + 1) for j in range(top)]
        return {"words": [], "weights": [], "thresholds": [float(np.log((1 - p) / p)) + 1e-6 * j for j, p in enumerate(share)]}
    in_fold = lambda c, k: F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0))
    seen = rows.select("t", "fold", F.lit(1).alias("n"), F.explode("w").alias("word")).groupBy("word")
    words = cut(seen.agg(*(in_fold(c, k).alias(f"{c}{k}") for c in "nt" for k in (0, 1))).filter(F.col("n0") + F.col("n1") >= least_docs))

    def picked(*folds: int) -> list[str]:
        n, t = (sum((F.col(f"{c}{k}") for k in folds), F.lit(0)) for c in "nt")
        return telling(words, n, t, number(folds, 0), number(folds, 1), most_features, least_docs, least_z)

    names = {(0, 1): picked(0, 1)} | ({} if grade else {(0,): picked(0), (1,): picked(1)})
    every = sorted(set().union(*names.values()))
    # at most ``sample`` rows, with words of the models only
    held = rows.select("doc_id", "grade", "fold", F.array_intersect("w", F.array(*map(F.lit, every)).cast("array<string>")).alias("w")).orderBy("doc_id").collect()
    grades = np.array([r.grade for r in held])

    def fitted(folds: tuple[int, ...], grades: np.ndarray, top: int) -> tuple[dict[str, float], np.ndarray]:
        at = {w: i for i, w in enumerate(names[folds])}
        own = [i for i, r in enumerate(held) if r.fold in folds]
        weights, thresholds = fit([[at[w] for w in held[i].w if w in at] for i in own], grades[own], len(at), top)
        return dict(zip(at, weights.tolist())), thresholds

    if not grade:
        # each half graded by the model of the other one
        models = {k: fitted((k,), np.minimum(grades, 1), 1) for k in (0, 1)}
        for i, r in enumerate(held):
            weights, thresholds = models[1 - r.fold]
            x = sum(weights.get(w, 0.0) for w in r.w)
            grades[i] = 0 if not r.grade else 1 + int(_sigmoid(np.array(x - thresholds[0])) >= cutoff)
        top = max(1, int(grades.max()))
    weights, thresholds = fitted((0, 1), grades, top)
    return {"words": names[(0, 1)], "weights": list(weights.values()), "thresholds": thresholds.tolist()}


def score(docs: DataFrame, model: dict, cutoff: float = 0.5) -> DataFrame:
    """One row per row of docs: doc_id, severity (expected grade, 0 to the highest), toxic (P(grade > 0) >= cutoff).

    Null and empty texts have no features and get the severity of an average text without any. Repeated rows give repeated results;
    other columns are ignored. No shuffle: rows stay where they are, and the model is as small as its parameters.
    """
    weight = dict(zip(model["words"], model["weights"]))
    theta = np.array(model["thresholds"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = weight.keys()
        for b in batches:
            x = np.array([sum(weight[w] for w in known & set(_WORD.findall((t.as_py() or "").translate(_LOWER)))) for t in b.column(1)], dtype=np.float64)
            p = _sigmoid(x[:, None] - theta[None, :])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(p.sum(axis=1), 6)), pa.array(p[:, 0] >= cutoff)], names=["doc_id", "severity", "toxic"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, severity double, toxic boolean")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLES: dict[str, str] = {}
