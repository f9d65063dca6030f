"""N-gram Jaccard self-join by PartEnum signatures, and the groups that its links form.

A document's set holds the hashes of its distinct word shingles. Sizes fall into bands; a set belongs to its own band and, if it
can link to a smaller set of the band below, visits that one too. Linked sets of a band differ in at most k features, k from
the band's sizes. The feature domain is cut into n1 first-level partitions of n2 cells each. As k differences can put two or
more of them into at most floor(k/2) partitions, some partition has one at most, and there two sets agree on a subset of all cells
but one: each such subset of cells gives a signature, the hash of the features that fall into it. Sets of one signature are
candidates, and are verified on their features.

n1 has spare partitions, so that linked sets agree on more than ``spare`` of them. A signature that says little (no feature in
it, or more than ``most`` sets share it) therefore costs a set one spare only; a link can get lost only between two sets that both run
out. Those sets, and they alone, are joined again by a prefix filter over their own features, rarest first. So no bucket is
cut and the join stays exact.

Within a signature the sets are first compared with its smallest id alone, which collapses groups of copies; then only sets that are
still in different groups meet. Groups are found by repeated star contraction of the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import among, cut, land, mix, table, word_hashes

_OUT = -32_768
_CHUNK = 512  # sets of a key that meet each other in one group
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], dtype=np.uint64)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; a shorter text's whole sequence counts as one, no words as none."""
    w = word_hashes(text)
    if not len(w):
        return w
    m = min(n, len(w))
    h = np.full(len(w) - m + 1, np.uint64(m), dtype=np.uint64)
    for j in range(m):
        h += w[j : len(w) - m + 1 + j] * _STEP[j % 8] * np.uint64(2 * (j // 8) + 1)
    return np.unique(mix(h))


@lru_cache(maxsize=4096)
def band(i: int) -> tuple[int, int]:
    """Smallest and largest size of band i; a band is half as wide again as its smallest size."""
    lo = 1
    for _ in range(i):
        lo = lo * 3 // 2 + 1
    return lo, lo * 3 // 2


def band_of(n: int) -> int:
    i = 0
    while band(i)[1] < n:
        i += 1
    return i


@lru_cache(maxsize=4096)
def plan(i: int, percent: int) -> tuple[int, int]:
    """Of band i: first-level partitions (with spare ones) and cells in each."""
    hi = band(i)[1]
    # sizes a <= hi and b <= a / t: the symmetric difference is at most (a + b) * (1 - t) / (1 + t)
    k = (hi + hi * 100 // percent) * (100 - percent) // (100 + percent)
    spare = 0 if k < 2 else 1 + k // 12
    return k // 2 + 1 + spare, 3 if k < 12 else 2


def signatures(f: np.ndarray, percent: int) -> tuple[list[np.ndarray], int]:
    """Signatures of a set in its band and the one below, and how many spare partitions it has left (-1: it ran out)."""
    n, out, slack = len(f), [], 1 << 20
    own = band_of(n)
    for i in (own, own - 1):
        if i < 0 or i < own and n * percent > 100 * band(i)[1]:
            continue
        n1, n2 = plan(i, percent)
        m = mix(f + np.uint64((i + 1) * int(_STEP[1]) % 2**64))
        cell = (m % np.uint64(n1 * n2)).astype(np.int64)
        value = mix(m ^ _STEP[3])
        lo = np.bincount(cell, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n1 * n2)
        hi = np.bincount(cell, weights=(value >> np.uint64(32)).astype(np.float64), minlength=n1 * n2)
        sums = (lo.astype(np.uint64) * _STEP[2] + hi.astype(np.uint64) * _STEP[4]).reshape(n1, n2)
        count = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
        # every subset of n2 - 1 cells: all of a partition's cells but one
        part, left = sums.sum(axis=1, keepdims=True) - sums, count.sum(axis=1, keepdims=True) - count
        place = np.arange(n1 * n2, dtype=np.uint64).reshape(n1, n2) + np.uint64((i + 1) << 40)
        sig = mix(mix(part) + place * _STEP[0])
        out.append(sig[left > 0])
        # what a link of this very set can spoil, from its own size and the largest that it can link to here
        other = n * 100 // percent if i == own else band(i)[1]
        spoilt = (n + other) * (100 - percent) // (100 + percent) // 2
        slack = min(slack, n1 - spoilt - 1 - int((left == 0).any(axis=1).sum()))
    return out, slack


def _sizes(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, key = [], []
            for t in b.column(1):
                f = shingles(t.as_py(), n)
                size.append(len(f))
                key.append((mix(f).sum(dtype=np.uint64).tobytes() + mix(f ^ _STEP[5]).sum(dtype=np.uint64).tobytes()) if len(f) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary())], names=["doc_id", "n", "key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key binary")


def _signature_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                ids, sigs, slacks = [], [], []
                for d, t in zip(b.column(0)[at : at + 64], b.column(1)[at : at + 64]):
                    found, slack = signatures(shingles(t.as_py(), n), percent)
                    # a set that has run out by empty partitions alone says so in a row of its own, at a place of its own
                    own = mix(np.array([d.as_py()], dtype=np.int64).view(np.uint64))[: int(slack < 0)]
                    rows = np.concatenate([*found, own])
                    ids.append(np.full(len(rows), d.as_py(), dtype=np.int64))
                    sigs.append(rows.view(np.int64))
                    slacks.append(np.concatenate([np.full(len(rows) - len(own), min(slack, 30_000), dtype=np.int16), np.full(len(own), _OUT, dtype=np.int16)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, sigs, slacks)], names=["doc_id", "sig", "slack"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sig long, slack short")


def _features(docs: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                f = [shingles(t.as_py(), n).view(np.int64) for t in b.column(1)[at : at + 256]]
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + 256], pa.array(f, pa.list_(pa.int64()))], names=["doc_id", "f"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, f array<long>")


def verify(pairs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    fa, fb = features.select(F.col("doc_id").alias("a"), F.col("f").alias("fa")), features.select(F.col("doc_id").alias("b"), F.col("f").alias("fb"))
    both = pairs.join(fa, "a").join(fb, "b")
    na, nb = F.size("fa"), F.size("fb")
    close = (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
    common = F.when(close, F.size(F.array_intersect("fa", "fb"))).otherwise(0)
    return both.filter((100 + percent) * common >= percent * (na + nb)).filter(common > 0).select("a", "b").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether edges (u, v) with u > v are stars: each u has one v, and no v is a u. Counts are summed up where the edges stand."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).filter("out + into > 1 and out > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) for the ends of links (a, b): the smallest id that links reach. Contraction until all edges are stars."""
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not _stars(e):
        # large star: a node's larger neighbours move to the smallest of its neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        e = cut(small.distinct())
    return e.select(F.col("u").alias("doc_id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("doc_id"), F.col("v").alias("component")).distinct())


def _resolve(groups: DataFrame, features: DataFrame, links: DataFrame | None, percent: int) -> DataFrame:
    """All links among sets that share a key, as links between sets enough to form the same groups.

    groups: (key, doc_id, pivot); every set is compared with its key's pivot, then sets still in different groups with each other. Where groups also say
    a set's size n and the key's place i in the order of its features, pairs whose first common key comes too late for the overlap are left out.
    """
    place = ["i", "n"] if "i" in groups.columns else []
    star = groups.filter("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    found = cut(verify(star, features, percent))
    links = found if links is None else links.unionByName(found)
    comp = components(links)
    rest = groups.filter("doc_id <> pivot").select("key", "doc_id", *place).join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    # a key's sets in chunks; each chunk meets each in a group of its own, so no key has to be one task
    chunks = F.ceil(F.count("*") / _CHUNK).cast("long").alias("chunks")
    mixed = rest.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), chunks).filter("lo < hi").select("key", "chunks")
    rest = cut(rest.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("chunks"))))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    side = lambda x, own, other: rest.select("key", F.col("own").alias(own), each.alias(other), F.col("doc_id").alias(x), F.col("component").alias(f"c{x}"), *(F.col(c).alias(c + x) for c in place))
    a, b = side("a", "chunk_a", "chunk_b"), side("b", "chunk_b", "chunk_a")
    meet = "a < b and ca <> cb" + (f" and {100 + percent} * (1 + least(na - ia, nb - ib)) >= {percent} * (na + nb)" if place else "")
    pairs = a.join(b, ["key", "chunk_a", "chunk_b"]).filter(meet).select("a", "b").distinct()
    return links.unionByName(cut(verify(pairs, features, percent)))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, most: int = 24, broadcast_rows: int = 500_000) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest id linked with it, directly or not, or its own).

    Sets link at a Jaccard similarity of percent/100 or more. Null and empty texts have no shingles and link with nothing, not
    even with each other. Rows that repeat a doc_id are one node; n_shingles is then each row's own. Null ids get a null component. Other columns are
    ignored. Equal sets count as links and are joined by key, so copies cost one row each and never meet in pairs. ``most`` decides which
    signatures are left to the second join, and up to ``broadcast_rows`` candidate ids are broadcast (more are shuffled); both change cost, not results.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = cut(_sizes(docs, n))
    known = sized.filter("key is not null and doc_id is not null")
    classes = known.groupBy("key").agg(F.min("doc_id").alias("rep"))
    same = known.join(classes, "key").filter("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    moved = cut(known.join(classes, "key").filter("doc_id <> rep").groupBy("doc_id").agg(F.min("rep").alias("rep")))
    # signatures of all rows: copies are folded into their smallest id afterwards, so that no text has to be moved before
    rows = land(_signature_rows(docs.filter("doc_id is not null"), n, percent))
    fold = lambda df: df.join(moved, "doc_id", "left").withColumn("doc_id", F.coalesce("rep", "doc_id")).drop("rep")
    out = cut(fold(rows.filter(F.col("slack") == _OUT).select("doc_id")).distinct())
    real = rows.filter(F.col("slack") != _OUT)
    # a signature is counted where it stands before it moves, and joined back by its count: a hot one is a row a task, not a group in one
    met = land(real.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1").select("sig"))
    shared = land(fold(among(real, met, "sig").join(met, "sig")).groupBy("sig", "doc_id").agg(F.min("slack").alias("slack")))
    # a link needs more common signatures than either set has partitions to spare
    shared = shared.join(shared.groupBy("sig").agg(F.count("*").alias("c")).filter("c > 1").select("sig"), "sig")
    hopeful = shared.groupBy("doc_id").agg(F.count("*").alias("m"), F.min("slack").alias("slack")).filter("m > slack").select("doc_id")
    shared = land(shared.join(hopeful.unionByName(out).distinct(), "doc_id", "left_semi"))
    stats = shared.groupBy("sig").agg(F.count("*").alias("c"), F.min("doc_id").alias("pivot")).filter("c > 1")
    shared = land(shared.join(stats, "sig"))
    # sets that have no spare partitions left
    hot = shared.groupBy("doc_id").agg(F.count_if(F.col("c") > most).alias("hot"), F.min("slack").alias("slack")).filter("hot > slack").select("doc_id")
    weak = cut(hot.unionByName(out).distinct())
    candidates = cut(shared.select("doc_id").unionByName(out).distinct())
    few = candidates.count() <= broadcast_rows
    features = cut(_features(docs.join(F.broadcast(candidates) if few else candidates, "doc_id", "left_semi"), n).filter(F.size("f") > 0))
    cold = shared.filter(F.col("c") <= most).select(F.col("sig").alias("key"), "doc_id", "pivot")
    hot = shared.filter((F.col("c") > most) & (F.col("doc_id") != F.col("pivot"))).select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _resolve(cold, features, cut(verify(hot, features, percent)), percent)

    if weak.isEmpty():
        return _classes(sized, links.unionByName(same))
    # second join: sets that ran out of spare partitions, on the rarest of their own features
    each = features.join(weak, "doc_id", "left_semi").select("doc_id", F.size("f").alias("n"), F.explode("f").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    ranked = each.join(often, "key", "left").select("doc_id", "n", "key", F.coalesce("c", F.lit(1)).alias("c"))
    order = Window.partitionBy("doc_id", "n").orderBy("c", "key")
    prefix = ranked.withColumn("i", F.row_number().over(order)).filter((F.col("c") > 1) & (F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    # a feature and a range of sizes make a key: sets that can link are of one range or of neighbouring ones
    size = F.floor(F.log(F.col("n")) / F.log(F.lit(101.0 / percent)))
    banded = cut(prefix.select(F.explode(F.array(size, size - 1)).alias("band"), "key", "doc_id", "i", "n").select(F.xxhash64("key", "band").alias("key"), "doc_id", "i", "n"))
    groups = cut(banded.join(banded.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last")).filter("pivot < last").drop("last"), "key"))
    links = _resolve(groups, features, links, percent)

    return _classes(sized, links.unionByName(same))


def _classes(sized: DataFrame, links: DataFrame) -> DataFrame:
    return sized.join(components(links), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)),
r AS (SELECT doc_id, doc_id AS to_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.to_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce((SELECT min(to_id) FROM r WHERE r.doc_id = d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""


QUERIES = {"op4_near_duplicates": op4_near_duplicates}
ORACLES = {"op4_near_duplicates": _oracle()}
