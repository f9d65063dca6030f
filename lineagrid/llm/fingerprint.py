"""Homomorphic multiset fingerprints of documents.

A text is cut into units (paragraph lines, and within them sentences); SHA-256 maps each unit to a wide vector, and the
fingerprint is the sum of the vectors modulo powers of two. The sum does not depend on the order of the units, and units
can be added to or taken from it without the rest of the text. A unit's vector has

* ``eq``: 8 lanes of 32 bits, summed modulo 2**32, for equality;
* ``sk``: 120 one-bit lanes (two to a packed number, 31 bits apart), each summed modulo 2**31. A lane's count of ones, set
  against the number of units, is a sum of random signs, so the cosine of two such vectors estimates how much of the two
  multisets of units is common. A text can't hold 2**31 units, so its own counts never wrap and no sum leaves a long; only
  sums of many fingerprints can, and there equality still holds and likeness alone suffers.

Everything is built-in expressions; no Python runs on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

UNIT = r"[^\n.!?]*[\n.!?]|[^\n.!?]+"
_UNIT = r"[^\n.!?]*+[\n.!?]|[^\n.!?]++"
EQ, PACKED, GAP = 8, 60, 31
#: Bits of the hash that feed the lanes: four groups of 15 hexadecimal digits, of which 30 bits each are used, 15 bits apart.
GROUPS, WIDTH = 4, 15
LANE = (1 << GAP) - 1


def units(text: Column) -> Column:
    """The units of a text, with the character that ends each; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_UNIT), F.lit(0))


def _hex(h: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(h, start, n), 16, 10).cast("long")


def _sums(unit: Column) -> list[Column]:
    h = F.col("h")
    eq = [F.coalesce(F.sum(_hex(h, 8 * i + 1, 8)), F.lit(0)).alias(f"e{i}") for i in range(EQ)]
    bit = lambda i, at: F.shiftright(F.col(f"g{i // WIDTH}"), i % WIDTH + at).bitwiseAND(F.lit(1))
    sk = [F.coalesce(F.sum(bit(i, 0) + F.shiftleft(bit(i, WIDTH), GAP)), F.lit(0)).alias(f"s{i}") for i in range(PACKED)]
    return [F.count(unit).alias("n"), *eq, *sk]


def _with_hash(df: DataFrame, unit: str) -> DataFrame:
    df = df.withColumn("h", F.sha2(F.col(unit), 256))
    return df.withColumns({f"g{k}": _hex(F.col("h"), 1 + WIDTH * k, WIDTH) for k in range(GROUPS)})


def _state() -> Column:
    eq = F.array(*(F.col(f"e{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(EQ)))
    return F.struct(F.col("n"), eq.alias("eq"), F.array(*(F.col(f"s{i}") for i in range(PACKED))).alias("sk"))


def empty_state() -> Column:
    return F.struct(F.lit(0).cast("long").alias("n"), F.array(*[F.lit(0).cast("long")] * EQ).alias("eq"), F.array(*[F.lit(0).cast("long")] * PACKED).alias("sk"))


def _lane(x: Column, field: int) -> Column:
    return F.shiftrightunsigned(x, field * GAP).bitwiseAND(F.lit(LANE))


def _combine(a: Column, b: Column, op) -> Column:
    lanes = lambda x, y: op(_lane(x, 0), _lane(y, 0)).bitwiseAND(F.lit(LANE)) + F.shiftleft(op(_lane(x, 1), _lane(y, 1)).bitwiseAND(F.lit(LANE)), GAP)
    return F.struct(op(a.n, b.n).alias("n"), F.zip_with(a.eq, b.eq, lambda x, y: op(x, y).bitwiseAND(F.lit(0xFFFFFFFF))).alias("eq"), F.zip_with(a.sk, b.sk, lanes).alias("sk"))


def add(a: Column, b: Column) -> Column:
    """The fingerprint of the two multisets together."""
    return _combine(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    """The fingerprint of a without the units of b."""
    return _combine(a, b, lambda x, y: x - y)


def digest(state: Column) -> Column:
    """A fingerprint as text: 8 hexadecimal digits a lane, then the number of units."""
    return F.concat(F.array_join(F.transform(state.eq, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), ""), F.lit("-"), state.n.cast("string"))


def _dot(a: Column, b: Column) -> Column:
    signed = lambda x, field, n: (2 * _lane(x, field) - n).cast("double")
    lanes = F.zip_with(a.sk, b.sk, lambda x, y: signed(x, 0, a.n) * signed(y, 0, b.n) + signed(x, 1, a.n) * signed(y, 1, b.n))
    return F.aggregate(lanes, F.lit(0.0), lambda acc, v: acc + v)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal multisets, otherwise the cosine of the signed lanes; a text without units is like only another such."""

    def of(s: Column) -> Column:
        lengths = F.sqrt(_dot(s.a, s.a) * _dot(s.b, s.b))
        equal = (s.a.n == s.b.n) & (s.a.eq == s.b.eq)
        return F.when(equal, 1.0).when((s.a.n == 0) | (s.b.n == 0) | (lengths == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(s.a, s.b) / lengths)))

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def fingerprints(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per row of df (keys must tell rows apart): keys and ``state``; one shuffle of the partial sums.

    A null or empty text has no units and gets the empty fingerprint; repeated units count as often as they stand.
    """
    rows = _with_hash(df.select(*keys, F.explode_outer(units(F.col(text))).alias("unit")), "unit")
    return rows.groupBy(*keys).agg(*_sums(F.col("unit"))).select(*keys, _state().alias("state"))


def _cuts(spread: list, value: Column, salt: Column) -> Column:
    """Number of the range of ``value`` between ascending bounds; rows that equal a bound given several times are dealt over its ranges by ``salt``."""
    bounds = F.array(*map(F.lit, spread)) if spread else F.array().cast("array<long>")
    under, upto = F.size(F.filter(bounds, lambda b: b < value)), F.size(F.filter(bounds, lambda b: b <= value))
    return (under + F.pmod(salt, upto - under + 1)).cast("int")


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """rows with ``block`` and ``sub``: about n ranges of doc_id that hold equally many rows (null ids last), and ranges of the
    text's hash where one id (or none) fills more than two of them, so that no range holds much more than the others."""
    q = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n).alias("q")).first().q or []
    bounds = sorted(set(q))
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    doc = F.col("doc_id")
    block = F.lit(0)
    if groups:
        heads = F.array(*(F.lit(g[0]) for g in groups))
        nested = F.array(*(F.array(*(F.lit(x) for x in g)) for g in groups))
        g = F.size(F.filter(heads, lambda b: b <= doc))
        block = let(g, lambda k: F.when(k == 0, 0).otherwise((k - 1) * step + F.size(F.filter(F.get(nested, k - 1), lambda b: b <= doc))))
    rows = rows.withColumn("block", F.when(doc.isNull(), len(bounds) + 1).otherwise(block).cast("int"))
    counts = rows.groupBy("block").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()  # a row a range
    even = max(1, sum(r.n for r in counts) // n)
    sub = F.lit(0)
    for r in counts:
        parts = r.n // even
        if parts > 2 and r.lo == r.hi:
            inside = rows.filter(F.col("block") == r.block).select(F.percentile_approx("h", [i / parts for i in range(1, parts)], 20 * parts).alias("q"))
            sub = F.when(F.col("block") == r.block, _cuts(sorted(inside.first().q), F.col("h"), F.xxhash64("rid"))).otherwise(sub)
    return rows.withColumn("sub", sub.cast("int"))


def fingerprint_pairs(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, with likenesses to that and to the next document.

    The edited text: the last floor(n/2) code points give way to the first as many of the next document (ascending doc_id;
    after the last comes the first). Texts cross the network once: rows are dealt by ranges of doc_id, each range also gets a
    copy of the first document of the range after it, and all later steps keep that partitioning. A null text counts as
    empty, rows that repeat a doc_id follow each other in the order of their texts' hashes, null ids come last, and other columns are
    ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the bounds and the first row of each range: a few numbers a range, whatever the number of documents
    rows = _blocks(docs, blocks)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("m")
    firsts = sorted((r.block, r.sub, r.m.doc_id, r.m.h) for r in rows.groupBy("block", "sub").agg(least).collect())
    if not firsts:
        firsts = [(0, 0, None, 0)]
    to = [(m, h, *firsts[i - 1][:2]) for i, (_, _, m, h) in enumerate(firsts)]
    targets = F.broadcast(spark.createDataFrame(to, "m long, mh long, block int, sub int"))
    hashes = sorted({h for _, h, _, _ in to})
    heads = docs.filter(F.col("h").isin(hashes)).join(targets, F.col("doc_id").eqNullSafe(F.col("m")) & (F.col("h") == F.col("mh"))).select("rid", "doc_id", "text", "h", "block", "sub", F.lit(1).alias("extra"))
    both = rows.select("rid", "doc_id", "text", "h", "block", "sub", F.lit(0).alias("extra")).unionByName(heads)
    w = Window.partitionBy("block", "sub").orderBy("extra", F.asc_nulls_last("doc_id"), "h", "rid")
    seq = both.withColumns({"rn": F.row_number().over(w), "next": F.lead("text").over(w), "n_chars": F.length("text").cast("long")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half))
    seq = seq.withColumn("edited", F.when(F.col("extra") == 0, edited))
    keys = ["block", "sub", "rn", "doc_id", "extra", "n_chars", "edited_sha256"]
    pair = F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("edited").alias("t")))
    each = seq.select(*keys[:6], F.sha2("edited", 256).alias("edited_sha256"), F.explode(pair).alias("x")).select(*keys, "x.k", F.explode_outer(units(F.col("x.t"))).alias("unit"))
    states = _with_hash(each, "unit").groupBy(*keys, "k").agg(*_sums(F.col("unit"))).select(*keys, "k", _state().alias("state"))
    pick = lambda k: F.coalesce(F.first(F.when(F.col("k") == k, F.col("state")), ignorenulls=True), empty_state())
    per_doc = states.groupBy(*keys).agg(pick(0).alias("own"), pick(1).alias("other"))
    out = per_doc.withColumn("after", F.lead("own").over(Window.partitionBy("block", "sub").orderBy("rn"))).filter("extra = 0")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("own")).alias("fingerprint"), digest(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    eq = ", ".join(f"CAST(coalesce(sum(CAST(('0x' || substr(h, {8 * i + 1}, 8)) AS BIGINT)), 0) AS BIGINT) & 4294967295 AS e{i}" for i in range(EQ))
    bit = lambda i, at: f"((g{i // WIDTH} >> {i % WIDTH + at}) & 1)"
    sk = ", ".join(f"CAST(coalesce(sum({bit(i, f * WIDTH)}), 0) AS BIGINT) AS s{i}_{f}" for i in range(PACKED) for f in range(2))
    lane = lambda p, i, f: f"(2 * {p}.s{i}_{f} - {p}.n)"
    dot = lambda p, q: "CAST(" + " + ".join(f"{lane(p, i, f)} * {lane(q, i, f)}" for i in range(PACKED) for f in range(2)) + " AS DOUBLE)"
    fp = lambda p: " || ".join(f"lpad(lower(hex({p}.e{i})), 8, '0')" for i in range(EQ)) + f" || '-' || {p}.n"

    def like(p: str, q: str) -> str:
        equal = " AND ".join(f"{p}.{c} = {q}.{c}" for c in ["n", *(f"e{i}" for i in range(EQ))])
        length = f"sqrt({p}.ll * {q}.ll)"
        return f"CASE WHEN {equal} THEN 1.0 WHEN {p}.n = 0 OR {q}.n = 0 OR {length} = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, {dot(p, q)} / {length})) END"

    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
nx AS (SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next_id FROM d),
e AS (SELECT nx.doc_id, nx.next_id, nx.n_chars, nx.text,
  substr(nx.text, 1, nx.n_chars - nx.n_chars // 2) || substr(b.text, 1, nx.n_chars // 2) AS edited FROM nx JOIN d b ON b.doc_id = nx.next_id),
t AS (SELECT doc_id, 0 AS k, text FROM e UNION ALL SELECT doc_id, 1, edited FROM e),
u AS (SELECT doc_id, k, sha256(unnest(regexp_extract_all(text, '[^\\n.!?]*[\\n.!?]|[^\\n.!?]+'))) AS h FROM t),
g AS (SELECT *, {", ".join(f"CAST(('0x' || substr(h, {1 + WIDTH * k}, {WIDTH})) AS BIGINT) AS g{k}" for k in range(GROUPS))} FROM u),
s AS (SELECT t.doc_id, t.k, count(h) AS n, {eq}, {sk} FROM t LEFT JOIN g USING (doc_id, k) GROUP BY t.doc_id, t.k),
l AS (SELECT s.*, {dot("s", "s")} AS ll FROM s)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, {fp("a")} AS fingerprint, {fp("b")} AS edited_fingerprint,
  {like("a", "b")} AS near_edited, {like("a", "c")} AS near_next
FROM e JOIN l a ON a.doc_id = e.doc_id AND a.k = 0 JOIN l b ON b.doc_id = e.doc_id AND b.k = 1 JOIN l c ON c.doc_id = e.next_id AND c.k = 0
"""


QUERIES = {"op8_fingerprints": op8_fingerprints}
ORACLES = {"op8_fingerprints": _oracle()}
