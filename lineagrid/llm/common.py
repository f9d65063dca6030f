"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a text whose A-Z are lower-cased already: digits, a-z and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """The shared folder for what is written in between: the session's ``spark.checkpoint.dir``.

    Without that setting a session on one machine (master local) gets a folder of its own, as in tests; any other is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lineagrid-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage."""
    folder(df.sparkSession)
    return df.checkpoint(eager=True)


def land(df: DataFrame) -> DataFrame:
    """The same as a Parquet table, which takes less room for many narrow rows."""
    path = f"{folder(df.sparkSession)}/land-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z for comparisons with ASCII words.

    ``lower`` also changes letters beyond ASCII, which stay beyond ASCII: only the Kelvin sign and the dotted capital I
    would turn into ASCII letters, so they are taken out first. Words of ASCII letters, and the number and places of all
    words, come out as if A-Z alone had been lowered.
    """
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ÿ")), F.lit("İ"), F.lit("ÿ")))


def among(df: DataFrame, wanted: DataFrame, column: str, bits: int = 24) -> DataFrame:
    """Rows of df whose value is one of the wanted ones, and some others.

    A table of 2**bits marks (2 MB) is all that is broadcast, whatever the number of values: few rows are left over where that is small,
    all rows where it is beyond the marks. A join that follows makes the result exact; this only spares it rows.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    low = lambda p: p.bitwiseAND(F.lit(63))
    at = wanted.select(place(column).alias("p")).select(F.shiftright("p", 12).alias("_page"), low(F.shiftright("p", 6)).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), low(F.col("p")).cast("int")).alias("mark"))
    words = at.groupBy("_page", "i").agg(F.bit_or("mark").alias("m"))
    pages = words.groupBy("_page").agg(F.map_from_entries(F.collect_list(F.struct("i", "m"))).alias("m"))  # 64 words a page
    pages = pages.select("_page", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("_marks"))
    met = df.withColumn("_p", place(column)).withColumn("_page", F.shiftright("_p", 12)).join(F.broadcast(pages), "_page")
    word = F.get("_marks", low(F.shiftright("_p", 6)).cast("int"))
    return met.filter(F.call_function("shiftright", word, low(F.col("_p")).cast("int")).bitwiseAND(F.lit(1)) == 1).select(*df.columns)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row (a plain alias could be inlined again by the optimizer)."""
    return F.element_at(F.transform(F.array(value), body), 1)


_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE[_SPACE] = 0
_POWER = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _POWER, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the white-space words of a text, in order, A-Z lower-cased; long texts in pieces of about 1 MB."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_hash_words(np.frombuffer(data, dtype=np.uint8, count=end - at, offset=at)))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def _hash_words(raw: np.ndarray) -> np.ndarray:
    space = _SPACE[raw]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    raw = raw[starts[0] :]
    starts = starts - starts[0]
    within = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    longest = int(within.max()) + 1
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    return mix(np.add.reduceat(_BYTE[raw] * powers[within], starts))
