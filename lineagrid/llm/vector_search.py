"""Exact top-k inner products by a pivot-distance index.

Vectors become points of a Euclidean space by one more coordinate, sqrt(M - |x|^2) with M the largest squared length (0 for a
query), which makes a larger inner product a smaller distance. Every point is keyed by its nearest pivot and its distance to it;
a pivot's points, sorted by distance, are cut into annuli of about ``block`` points, and each annulus remembers the least and
the largest distance of its points to every pivot. A query first searches the annulus of its own place, which gives its k-th best
score so far. By the triangle inequality a point within that distance r of the query lies, for every pivot p, between d(q, p) - r and
d(q, p) + r from it: an annulus that lies outside for one pivot is never searched for that query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

_SLACK = 1e-6
_FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as double; vectors that are null, empty or hold a null or non-finite component are left out."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    v = v.filter(F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))))
    return v.select("vec_id", F.transform("e", lambda x: F.floor(x * scale)).alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in col), dtype=np.int64).reshape(-1, dim)


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where no sum can leave its exact range."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if most < 2**53 else q @ x.T


def _distances(x: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Distances of rows to pivots, whose last coordinate is 0; a point's is sqrt(top - |x|^2), so the squares add up to top."""
    return np.sqrt(np.maximum(0, top + (pivots**2).sum(axis=1)[None, :] - 2 * (x.astype(np.float64) @ pivots.T)))


def _keyed(points: DataFrame, pivots: np.ndarray, top: float) -> DataFrame:
    """points with nearest pivot, distance to it and the vector as bytes. top: the largest squared length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.asarray(b.column(1).flatten(), dtype=np.int64).reshape(b.num_rows, -1)
            d = _distances(x, pivots, top)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), pa.array([r.tobytes() for r in x], pa.binary())], names=["vec_id", "pivot", "dist", "v"])

    return points.mapInArrow(run, "vec_id long, pivot int, dist double, v binary")


def _annuli(keyed: DataFrame, size: int) -> DataFrame:
    """keyed with ``ring``: the place of a point's distance among about n/size quantiles of its pivot's distances."""
    n = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("dist", [i / 256 for i in range(1, 256)], 2560).alias("q"))
    every = F.greatest(F.lit(1), F.floor(F.lit(256) * size / F.col("n"))).cast("int")  # of 256 quantiles every so many'th is a bound
    bounds = n.select("pivot", F.filter("q", lambda x, i: (i + 1) % every == 0).alias("bounds"))  # a row a pivot
    return keyed.join(F.broadcast(bounds), "pivot").withColumn("ring", F.size(F.filter("bounds", lambda b: b < F.col("dist")))).drop("bounds")


def _blocks(keyed: DataFrame, size: int, dim: int, pivots: np.ndarray, top: float, name: str) -> DataFrame:
    """Blocks of about ``size`` points of one annulus: (name, pivot, ring, n, ids, m, lo, hi), with least and largest distance to each pivot."""
    by = ["pivot", "ring"]
    counts = keyed.groupBy(*by).agg(F.count("*").alias("_n"))
    dealt = keyed.join(counts, by).withColumn("_sub", F.pmod(F.xxhash64("vec_id", "v"), F.ceil(F.col("_n") / size)).cast("int"))
    packed = dealt.groupBy(*by, "_sub").agg(F.collect_list(F.struct("vec_id", "v")).alias("r"))
    ids, rows = F.transform("r", lambda x: x.vec_id), F.transform("r", lambda x: x.v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = [b"".join(r) for r in b.column("rows").to_pylist()]
            d = [_distances(np.frombuffer(x, dtype=np.int64).reshape(-1, dim), pivots, top) for x in m]
            yield pa.RecordBatch.from_arrays([b.column("pivot"), b.column("ring"), b.column("ids"), pa.array(m, pa.binary()), pa.array([x.min(axis=0).tolist() for x in d], pa.list_(pa.float64())), pa.array([x.max(axis=0).tolist() for x in d], pa.list_(pa.float64()))], names=[*by, "ids", "m", "lo", "hi"])

    out = packed.select(*by, ids.alias("ids"), rows.alias("rows")).mapInArrow(run, "pivot int, ring int, ids array<long>, m binary, lo array<double>, hi array<double>")
    return cut(out.select(F.monotonically_increasing_id().alias(name), *by, F.size("ids").alias("n"), "ids", "m", "lo", "hi"))


def _search(pairs: DataFrame, queries: DataFrame, index: DataFrame, dim: int, k: int) -> DataFrame:
    """Best k of each query in each pair of blocks: (query_id, vec_id, score).

    pairs: (qb, xb, at, kth): places in the block of the queries that search the block of points, and the scores that results must reach.
    """
    sides = pairs.join(queries.select("qb", F.col("ids").alias("qids"), F.col("m").alias("qm")), "qb").join(index.select("xb", F.col("ids").alias("xids"), F.col("m").alias("xm")), "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                cell = lambda c, i=i: b.column(c)[i]
                at = np.array(cell("at").as_py(), dtype=np.int64)
                q, x = _matrix([cell("qm")], dim)[at], _matrix([cell("xm")], dim)
                qi, xi = np.array(cell("qids").as_py())[at], np.array(cell("xids").as_py())
                s = _scores(q, x)
                ok = (qi[:, None] != xi[None, :]) & (s >= np.array(cell("kth").as_py())[:, None])
                if s.shape[1] > k:  # the k-th largest of what is left; ties stay in, the smaller ids win later
                    masked = np.where(ok, s, np.iinfo(np.int64).min)
                    edge = np.partition(masked, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                    ok &= s >= edge[:, None]
                r, c = np.nonzero(ok)
                order = np.lexsort((xi[c], -s[r, c], r))
                r, c = r[order], c[order]
                first = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(qi)))])[r]
                best = np.arange(len(r)) - first < k
                yield pa.RecordBatch.from_arrays([pa.array(qi[r[best]]), pa.array(xi[c[best]]), pa.array(s[r[best], c[best]])], names=["query_id", "vec_id", "score"])

    return sides.mapInArrow(run, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


class _Index:
    """Blocks of points and of queries of one length, with pivots from a bounded sample."""

    def __init__(self, points: DataFrame, dim: int, k: int, every: int, pivots: int, sample: int, block: int, query_block: int):
        self.dim, self.k = dim, k
        few = np.array([r.v for r in points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()], dtype=np.float64)
        self.top = float(points.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0])
        # pivots far from each other: each next one is the sample point farthest from those before it
        chosen = [0]
        gap = ((few - few[0]) ** 2).sum(axis=1)
        while len(chosen) < min(pivots, len(few)) and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((few - few[chosen[-1]]) ** 2).sum(axis=1))
        self.pivots = few[chosen]
        keyed = cut(_annuli(_keyed(points, self.pivots, self.top), block))
        self.points = _blocks(keyed, block, dim, self.pivots, self.top, "xb")
        self.queries = _blocks(keyed.filter(F.col("vec_id") % every == 0), query_block, dim, self.pivots, self.top, "qb")
        self.where = cut(self.points.select("xb", "pivot", "n", "lo", "hi"))

    def nearest(self) -> DataFrame:
        """Each block of queries with the blocks of points of its own annulus and, where that holds fewer than k + 1, of its pivot: (qb, xb, at, kth)."""
        none = F.lit(np.iinfo(np.int64).min)
        rings = self.points.groupBy("pivot", "ring").agg(F.sum("n").alias("held"))
        q = self.queries.join(rings, ["pivot", "ring"]).select("qb", "pivot", "ring", "held", F.size("ids").alias("m"))
        x = self.points.select("xb", "pivot", F.col("ring").alias("xring"))
        pairs = q.join(x, "pivot").filter((F.col("ring") == F.col("xring")) | (F.col("held") <= self.k))
        return cut(pairs.select("qb", "xb", F.sequence(F.lit(0), F.col("m") - 1).alias("at"), F.array_repeat(none, F.col("m")).alias("kth")))

    def within(self, kth: DataFrame, done: DataFrame) -> DataFrame:
        """Pairs that the bounds leave: (qb, xb, at, kth); kth: (query_id, s), none for a query of fewer than k results."""
        none = int(np.iinfo(np.int64).min)
        members = self.queries.select("qb", F.posexplode("ids").alias("i", "query_id"))
        bound = members.join(kth, "query_id", "left").groupBy("qb").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("s", F.lit(none)).alias("s")))), lambda x: x.s).alias("kth"))
        pivots, top, dim = self.pivots, self.top, self.dim
        # a pivot's annuli in one row: a few numbers for each block of points
        annuli = self.where.groupBy("pivot").agg(F.collect_list(F.struct("xb", "lo", "hi")).alias("a"))
        each = self.queries.select("qb", "m").join(bound, "qb").select("*", F.explode(F.sequence(F.lit(0), F.lit(len(pivots) - 1))).alias("pivot")).join(annuli, "pivot")

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    q, s = _matrix([b.column("m")[i]], dim), np.array(b.column("kth")[i].as_py(), dtype=np.int64)
                    own = (q.astype(np.float64) ** 2).sum(axis=1)
                    r = np.where(s == none, np.inf, np.sqrt(np.maximum(0, own + top - 2 * s.astype(np.float64))))  # farthest that a result can be
                    # the query's last coordinate is 0, as the pivots'
                    d = np.sqrt(np.maximum(0, own[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (q.astype(np.float64) @ pivots.T)))
                    low, high = (d - r[:, None]) * (1 - _SLACK) - _SLACK, (d + r[:, None]) * (1 + _SLACK) + _SLACK
                    for a in b.column("a")[i].as_py():
                        lo, hi = np.array(a["lo"]), np.array(a["hi"])
                        at = np.flatnonzero(((lo[None, :] <= high) & (hi[None, :] >= low)).all(axis=1))
                        if len(at):
                            yield pa.RecordBatch.from_arrays([pa.array([b.column("qb")[i].as_py()]), pa.array([a["xb"]]), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([s[at].tolist()], pa.list_(pa.int64()))], names=["qb", "xb", "at", "kth"])

        found = each.select("qb", "m", "kth", "a").mapInArrow(reach, "qb long, xb long, at array<int>, kth array<long>")
        return cut(found.join(done.select("qb", "xb"), ["qb", "xb"], "left_anti"))

    def search(self) -> tuple[DataFrame, list[DataFrame]]:
        """(query_id, vec_id, score, rank) of the k best, and the pairs that each step searched."""
        near = self.nearest()
        first = cut(_top(_search(near, self.queries, self.points, self.dim, self.k), self.k))
        rest = self.within(first.filter(F.col("rank") == self.k).groupBy("query_id").agg(F.max("score").alias("s")), near)
        more = _search(rest, self.queries, self.points, self.dim, self.k)
        return _top(first.select("query_id", "vec_id", "score").unionByName(more), self.k), [near, rest]

    def searched(self) -> tuple[int, int]:
        """Pairs of query and point whose product is taken, and all pairs."""
        _, steps = self.search()
        n = F.coalesce(F.sum(F.size("at") * F.col("n")), F.lit(0)).alias("n")
        taken = sum(s.join(self.where.select("xb", "n"), "xb").agg(n).first().n for s in steps)
        count = lambda df: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        return taken, count(self.points) * count(self.queries)


def _indexes(vectors: DataFrame, k: int, every: int, **sizes: int) -> list[_Index]:
    """An index for each length of vectors, as products of different lengths have no meaning."""
    ints = cut(quantised(vectors).distinct())
    lengths = [r.d for r in ints.groupBy(F.size("v").alias("d")).agg(F.max((F.col("vec_id") % every == 0).cast("int")).alias("asked")).filter("asked = 1").orderBy("d").collect()]
    return [_Index(ints.filter(F.size("v") == d), d, k, every, **sizes) for d in lengths]


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = 16, sample: int = 4096, block: int = 2048, query_block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products; ties go to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the query's own (rows that repeat a vec_id are
    candidates once each distinct vector, and a repeated query counts once each distinct vector). Vectors that are null or hold null or non-finite
    components take no part; vectors of different lengths are searched among their own length. Fewer than k candidates give
    fewer rows, an empty table none. Other columns are ignored. Pivots come from at most ``sample`` rows, the smallest by a hash of
    vec_id; they and the sizes of blocks steer cost alone.
    """
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    for x in _indexes(vectors, k, every, pivots=pivots, sample=sample, block=block, query_block=query_block):
        best, _ = x.search()
        out = out.unionByName(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    return out


def pairs_searched(vectors: DataFrame, k: int = 20, every: int = 20, pivots: int = 16, sample: int = 4096, block: int = 2048, query_block: int = 256) -> tuple[int, int]:
    """How many pairs of a query and a vector ``top_k`` multiplies, and how many there are."""
    each = [x.searched() for x in _indexes(vectors, k, every, pivots=pivots, sample=sample, block=block, query_block=query_block)]
    return sum(a for a, _ in each), sum(b for _, b in each)


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    return """
WITH v AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
w AS (SELECT vec_id, list(CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) ORDER BY i) AS v FROM v GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score FROM w q JOIN w c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""


QUERIES = {"op5_top_k": op5_top_k}
ORACLES = {"op5_top_k": _oracle()}
