"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of equal-token blocks. Slot i of the schedule takes the van der Corput point of i (its bits reversed),
mapped through the sources' cumulative block counts; so each source gets exactly the blocks that its target needs, spread as
evenly as the sequence allows. Each source's documents are put in a fixed random order and their tokens cut into equal
blocks, running through the source again where the target is larger than the source. The r-th slot of a source is joined
with its r-th block; a source's last block is cut at its target.

Ranks and running sums are taken in two steps, over chunks and within a chunk, so that no source is gathered in one task;
what is handled in one place is one row per source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TOKEN, cut, table

WEIGHTS = (3, 1, 2)
_SPAN = 1 << 14


def sizes(docs: DataFrame) -> DataFrame:
    """docs with ``size``: the words of the whole text, 0 for null."""
    return docs.withColumn("size", F.coalesce(F.size(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))), F.lit(0)).cast("long"))


def targets(per_source: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """A row per source (source, source_size) with ``no`` (from 0, by code point, null last) and ``target``.

    Targets are proportional to the weights and stop at cap times a source's size; the excess goes to the others by weight.
    Sources in ascending order of cap/weight are full until the level that the rest would get is within their caps.
    """
    one = F.lit(0)  # all sources together: a row each
    by_name = Window.partitionBy(one).orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int")).cast("double")
    t = per_source.withColumn("no", F.row_number().over(by_name) - 1).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(cap))
    by_ratio = Window.partitionBy(one).orderBy(F.col("cap") / F.col("w"), "no")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(one)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    t = t.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    t = t.withColumn("at", F.row_number().over(by_ratio))
    settled = F.min(F.when(F.col("fits"), F.struct("at", "level"))).over(everything)
    return t.select("source", "source_size", "no", F.when(F.col("at") < F.coalesce(settled["at"], F.lit(2**31 - 1)), F.col("cap")).otherwise(settled["level"] * F.col("w")).alias("target"))


def _running(df: DataFrame, part: str, chunk: str, order: list, value, name: str) -> DataFrame:
    """df with ``name``: the sum of ``value`` over the rows of the same part before a row, by chunk and then order."""
    sums = df.groupBy(part, chunk).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(part).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(part, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [part, chunk]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """Slots of the mix: (no, rank, slot); sources has no and target (whole words)."""
    blocks = sources.select("no", F.ceil(F.col("quota") / block).cast("long").alias("blocks"))
    w = Window.partitionBy(F.lit(0)).orderBy("no")
    blocks = blocks.withColumn("start", F.sum("blocks").over(w) - F.col("blocks")).withColumn("total", F.sum("blocks").over(Window.partitionBy(F.lit(0)))).filter("blocks > 0")
    bits = F.length(F.bin(F.greatest(F.col("total") - 1, F.lit(1))))
    end = F.col("start") + F.col("blocks") - 1
    pieces = blocks.withColumn("bits", bits).select("no", "start", end.alias("end"), "bits", F.explode(F.sequence(F.floor(F.col("start") / _SPAN), F.floor(end / _SPAN))).alias("c"))
    points = pieces.repartition("no", "c").select("no", "bits", F.explode(F.sequence(F.greatest(F.col("start"), F.col("c") * _SPAN), F.least(F.col("end"), F.col("c") * _SPAN + _SPAN - 1))).alias("j"))
    slot = F.conv(F.reverse(F.lpad(F.bin("j"), F.col("bits"), F.lit("0"))), 2, 10).cast("long")
    slots = points.select("no", slot.alias("slot")).withColumn("chunk", F.floor(F.col("slot") / _SPAN))
    return _running(slots, "no", "chunk", ["slot"], F.lit(1), "rank").select("no", F.col("rank").cast("long").alias("rank"), "slot")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 7, block: int = 512, least_slots: int = 65536, per_chunk: int = 4096) -> DataFrame:
    """One row per row of docs: doc_id, text_md5, source, size, source_size, target, taken, first_slot, slots and parts.

    ``taken`` counts words of the document in the mix, repeats included, never above cap times its size; ``slots`` counts the slots of the
    schedule that hold some of them, ``first_slot`` is the least (null if nothing is taken), and ``parts`` gives, for each pass
    through the source, the slot in which the document begins and the words taken of it. The order within
    a source is that of md5(seed:doc_id:md5 of the text), so reruns agree; rows that repeat a doc_id count as documents of
    their own, and rows equal in id, text and source follow each other. Empty texts have size 0 and nothing is taken of them; a null source is a source of its own,
    null ids are ordered by their texts. A block has ``block`` words,
    fewer (one at least) where the mix would have under ``least_slots`` blocks: a small mix is as finely dealt as a large one.
    Other columns are ignored. What one task handles whole is a row per source, and a source's chunks of about ``per_chunk`` rows.
    """
    rows = sizes(docs.select("doc_id", "source", "text", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")))
    # equal rows are one with a number of copies, so that no id and no group of copies fills a chunk
    rows = cut(rows.groupBy("doc_id", "text_md5", "source", "size").agg(F.count("*").alias("copies")))
    held = rows.agg(F.count("*").alias("n"), F.coalesce(F.max("copies"), F.lit(0)).alias("most")).first()
    n = max(1, held.n)
    digits = next(d for d in range(1, 9) if 16**d * per_chunk >= n or d == 8)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_md5"))
    per_source = cut(targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, share, cap).withColumn("quota", F.floor(F.col("target") + 0.5).cast("long")))
    total = per_source.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("q")).first().q
    block = max(1, min(block, total // least_slots))

    named = rows.join(per_source, rows.source.eqNullSafe(per_source.source)).select("doc_id", "text_md5", rows.source, "size", "copies", "no", "source_size", "target", "quota", h.alias("h"))
    placed = _running(named.withColumn("chunk", F.substring("h", 1, digits)), "no", "chunk", ["h", "doc_id"], F.col("size") * F.col("copies"), "start")
    own = ["doc_id", "text_md5", "no"]
    # copies in runs of at most per_chunk, which are dealt out where a row has many
    runs = placed.select(*own, "source", "size", "source_size", "target", "quota", "start", "copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(per_chunk).cast("long"))).alias("c"))
    if held.most > per_chunk:
        runs = runs.repartition("doc_id", "text_md5", "c")
    each = runs.select(*own, "source", "size", "source_size", "target", "quota", "start", F.explode(F.sequence(F.col("c"), F.least(F.col("copies"), F.col("c") + per_chunk) - 1)).alias("copy"))
    each = each.withColumn("start", F.col("start") + F.col("copy") * F.col("size"))
    passes = F.explode(F.sequence(F.lit(0), F.floor((F.col("quota") - 1) / F.col("source_size")).cast("int")))
    spans = each.filter("quota > 0 and size > 0").withColumn("pass", passes).withColumn("a", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("quota"))).filter("a < b")
    pieces = spans.select(*own, "copy", "pass", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))).alias("rank"))
    pieces = pieces.select(*own, "copy", "pass", "rank", (F.least("b", (F.col("rank") + 1) * block) - F.greatest("a", F.col("rank") * block)).alias("words"))
    slotted = pieces.join(schedule(per_source, block), ["no", "rank"])
    by_pass = slotted.groupBy(*own, "copy", "pass").agg(F.sum("words").alias("words"), F.count("*").alias("n"), F.min("slot").alias("least"), F.min_by("slot", "rank").alias("slot"))
    mixed = by_pass.groupBy(*own, "copy").agg(F.sum("words").alias("taken"), F.min("least").alias("first_slot"), F.sum("n").alias("slots"), F.array_sort(F.collect_list(F.struct("pass", "slot", "words"))).alias("parts"))  # a pass a part
    keyed = mixed.select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5"), F.col("no").alias("_no"), F.col("copy").alias("_copy"), "taken", "first_slot", "slots", "parts")
    out = each.join(keyed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5")) & (F.col("no") == F.col("_no")) & (F.col("copy") == F.col("_copy")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "text_md5", "source", "size", "source_size", "target", zero("taken"), "first_slot", zero("slots"), "parts")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "slots")


QUERIES = {"op10_mixing": op10_mixing}
_ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('7:' || doc_id || ':' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
w AS (SELECT *, CAST([3, 1, 2][no % 3 + 1] AS DOUBLE) AS w, 2.0 * CAST(source_size AS DOUBLE) AS cap FROM s),
r AS (SELECT *, row_number() OVER o AS pos, (1.5 * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM w WINDOW o AS (ORDER BY cap / w, no)),
f AS (SELECT pos AS edge, level AS lv FROM r WHERE level * w <= cap ORDER BY pos LIMIT 1),
t AS (SELECT r.source, no, CAST(source_size AS BIGINT) AS source_size, CASE WHEN edge IS NULL OR pos < edge THEN cap ELSE lv * w END AS target FROM r LEFT JOIN f ON true),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
z AS (SELECT CAST(greatest(1, least(512, sum(quota) // 65536)) AS BIGINT) AS block FROM q),
k AS (SELECT no, blocks, CAST(sum(blocks) OVER (ORDER BY no) - blocks AS BIGINT) AS start, CAST(sum(blocks) OVER () AS BIGINT) AS total FROM (SELECT no, CAST(ceil(quota / block) AS BIGINT) AS blocks FROM q, z) WHERE blocks > 0),
v AS (SELECT no, CAST(('0b' || reverse(lpad(bin(j), CAST(length(bin(greatest(total - 1, 1))) AS INTEGER), '0'))) AS BIGINT) AS slot FROM (SELECT no, total, unnest(range(start, start + blocks)) AS j FROM k)),
g AS (SELECT no, slot, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank FROM v),
p AS (SELECT d.*, q.no, q.source_size, q.target, q.quota, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id) - size AS BIGINT) AS a FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
e AS (SELECT doc_id, no, a + i * source_size AS a, least(a + i * source_size + size, quota) AS b FROM p, (VALUES (0), (1)) c(i) WHERE size > 0),
x AS (SELECT doc_id, no, a, b, block, unnest(range(a // block, (b - 1) // block + 1)) AS rank FROM e, z WHERE a < b),
m AS (SELECT doc_id, CAST(sum(least(b, (rank + 1) * block) - greatest(a, rank * block)) AS BIGINT) AS taken, min(slot) AS first_slot, count(*) AS slots FROM x JOIN g USING (no, rank) GROUP BY doc_id)
SELECT p.doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(slots, 0) AS slots FROM p LEFT JOIN m USING (doc_id)
"""

ORACLES = {"op10_mixing": _ORACLE}
