"""The trie of conversation prefixes, from sorted neighbours.

Conversations become keys, 16 bytes for each turn, and are sorted by ranges of keys. Within a range the trie is built by union-find
over the edges between sorted neighbours, each as deep as the prefix that both share, taken in descending depth: a merge makes a branching node at
that depth or adds to one that is there. Nodes that hold neither the first nor the last key of their range have all their
members and are final. The others lie on the two paths from the root to these keys; each path node, together with its final children,
is contracted to one item. Items of neighbouring ranges are put side by side and merged by the same union-find, 64 ranges at a
time, until one forest is left. Its root is the trie's.

What a range, or 64 contracted ones, has to hold at once is a key, counts and a few numbers for each distinct sequence in it; the rows of
equal conversations are folded while they stream by, wherever a large group of them is cut. No text goes further than its first task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import land, table

_W = 16  # bytes of a turn in a key
_BLOCK = 1 << 16  # characters of a block of ids
_BATCH = 8192  # rows
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_SCHEMA = "kind string, part long, seq long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, up binary, own binary, prefix binary, sums array<long>, digits string"
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (c.strip().split(" ", 1) for c in _SCHEMA.split(","))])


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, n_chars): each conversation's turns from 1, by turn (nulls first, ties by digest); null roles and texts are empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    t = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"), F.length(text).cast("long").alias("n_chars"))
    return t.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")).cast("long").alias("pos"), "digest", "n_chars")


def rebuilt(t: DataFrame, heads: int = 6, family: int = 100) -> DataFrame:
    """Turns of conversations of which each begins with the first h turns of its family's first one and goes on with its own after h.

    h is the checksum of the conversation's number modulo ``heads``. A conversation that keeps no turn has one row with pos 0.
    """
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads))
    ids = t.filter("pos = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    base = t.filter(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "digest", "n_chars")
    shared = ids.join(base, "base").filter("pos <= h").select("conv_id", "pos", "digest", "n_chars")
    none = ids.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("n_chars"))
    return t.filter(F.col("pos") > h).unionByName(shared).unionByName(none)


class _Node:
    """A node with what lies below it; an item until it has been merged. first and last: the sorted items that it spans."""

    __slots__ = ("below", "children", "depth", "ends", "first", "kids", "last", "leaves", "lo", "n", "own_lo", "prefix", "sums")

    def __init__(self, depth, n, lo, leaves, kids, below, ends, prefix, sums, at, own_lo):
        self.depth, self.n, self.lo, self.leaves, self.kids, self.below, self.ends = depth, n, lo, leaves, kids, below, ends
        self.prefix, self.sums, self.first, self.last, self.own_lo, self.children = prefix, sums, at, at, own_lo, []

    def all_leaves(self) -> int:
        return self.leaves if self.kids else 1

    def saved(self, above: int) -> int:
        """Saved in the subtree of the node that the chain over this one begins with, right under depth ``above``."""
        return self.below + (self.n - 1) * (self.sums[self.depth] - self.sums[above])


def _least(a: int | None, b: int | None) -> int | None:
    return b if a is None else a if b is None else min(a, b)


def _under(c: _Node, depth: int) -> _Node:
    """c, or a new node over it where c lies deeper."""
    if c.depth == depth:
        return c
    p = _Node(depth, c.n, c.lo, c.all_leaves(), 1, c.saved(depth), None, c.prefix, c.sums, c.first, None)
    p.last, p.children = c.last, [c]
    return p


def _joined(a: _Node, b: _Node) -> _Node:
    """Two parts of one node; a's items come first."""
    if len(a.children) < len(b.children):
        a.children, b.children = b.children, a.children
    a.children += b.children
    a.n, a.lo, a.own_lo, a.leaves, a.kids, a.below = a.n + b.n, _least(a.lo, b.lo), _least(a.own_lo, b.own_lo), a.leaves + b.leaves, a.kids + b.kids, a.below + b.below
    a.ends, a.last = b.ends if a.ends is None else a.ends, b.last
    return a


def _common(a: bytes, b: bytes) -> int:
    """Number of leading turns that two keys share."""
    lo, hi = 0, min(len(a), len(b)) // _W
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[: mid * _W] == b[: mid * _W]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _merge(items: list[_Node], joints: list[int]) -> _Node:
    """Union-find over the edges between neighbours, deepest first; the node that holds all items."""
    root, comp = list(range(len(items))), list(items)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for e in sorted(range(len(joints)), key=lambda i: -joints[i]):
        a, b = find(e), find(e + 1)
        big, small = (a, b) if comp[a].last - comp[a].first >= comp[b].last - comp[b].first else (b, a)
        comp[big] = _joined(_under(comp[a], joints[e]), _under(comp[b], joints[e]))
        root[small] = big
        if small != big:
            comp[small] = None
    return comp[find(0)]


def _id(c: _Node) -> bytes:
    return hashlib.md5(c.prefix[: c.depth * _W]).digest()


def _rows(c: _Node, above: int, parent: int | None, up: bytes | None, part: int, keyed: bool) -> Iterator[dict]:
    """The nodes of the chain from below depth ``above`` down to c. keyed: others may ask for c by its id."""
    for depth in range(max(above + 1, 0), c.depth + 1):
        top, end = depth == above + 1, depth == c.depth
        yield {
            "kind": "node", "part": part, "conv_id": c.lo, "depth": depth, "parent_conv_id": (parent if top else c.lo), "n_convs": c.n, "n_children": c.kids if end else 1, "n_leaves": c.all_leaves(),
            "saved_tokens": c.saved(depth - 1) if depth else c.below, "ends_sha256": EMPTY if not end or c.ends is None else c.ends or None, "up": up if top else None, "own": _id(c) if end and (keyed or c.ends == "") else None,
        }


def _final(c: _Node, above: int, parent: int | None, up: bytes | None, part: int, keyed: bool) -> Iterator[dict]:
    """All nodes of a subtree that has all its members."""
    todo = [(c, above, parent, up)]
    while todo:
        c, above, parent, up = todo.pop()
        yield from _rows(c, above, parent, up, part, keyed)
        todo += [(x, c.depth, c.lo, None) for x in c.children]


def _forest(items: list[_Node], joints: list[int], part: int, top: bool, keyed: bool) -> Iterator[dict]:
    """Rows of final nodes, and the items to which the rest is contracted, in order; top: nothing else is to come."""
    c = _merge(items, joints)
    if top:
        yield from _final(_under(c, 0), -1, None, None, part, keyed)
        return
    end = len(items) - 1
    left, right, x = [], [], c
    for path, on in ((left, lambda y: y.first == 0), (right, lambda y: y.last == end)):
        x = c
        while x := next((y for y in x.children if on(y)), None):
            path.append(x)
    for seq, x in enumerate([*reversed(left), c, *right]):
        open_ = [y for y in x.children if y.first == 0 or y.last == end]
        final = [y for y in x.children if not (y.first == 0 or y.last == end)]
        key = _id(x)
        yield {
            "kind": "item", "part": part, "seq": seq, "conv_id": min((y.lo for y in final), default=x.own_lo) if x.own_lo is None else min([x.own_lo, *(y.lo for y in final)]), "depth": x.depth, "n_convs": x.n - sum(y.n for y in open_), "n_children": x.kids - len(open_),
            "n_leaves": x.leaves - sum(y.all_leaves() for y in open_), "saved_tokens": x.below - sum(y.saved(x.depth) for y in open_), "ends_sha256": x.ends, "own": key, "prefix": x.prefix[: x.depth * _W], "sums": x.sums[: x.depth + 1],
        }
        for y in final:
            yield from _final(y, x.depth, None, key, part, keyed)


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for r in rows:
        held.append(r)
        if len(held) == _BATCH:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_ARROW)


def _range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of sorted keys: blocks of ids of its first, last and largest groups of equal keys, final nodes and items."""
    part, items = TaskContext.get().partitionId(), []
    key, n, lo, ids, size, sums, cut = None, 0, None, [], 0, None, False

    def block(ids: list[int]) -> dict:
        return {"kind": "ids", "own": hashlib.md5(key).digest(), "conv_id": ids[0], "digits": ",".join(map(str, ids))}

    def closed(last: bool) -> Iterator[dict]:
        sha = ""
        if cut or last or not items:
            if ids:
                yield block(ids)
        else:
            sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        items.append(_Node(len(key) // _W, n, lo, 0, 0, 0, sha, key, sums, len(items), lo))

    def rows() -> Iterator[dict]:
        nonlocal key, n, lo, ids, size, sums, cut
        for batch in batches:
            lens = batch.column("lens")
            for i, (k, c) in enumerate(zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)):
                if k != key:
                    if key is not None:
                        yield from closed(False)
                    key, n, lo, ids, size, cut, sums = k, 0, c, [], 0, False, [0, *accumulate(lens[i].as_py())]
                n += 1
                ids.append(c)
                size += len(str(c)) + 1
                if size >= _BLOCK:
                    yield block(ids)
                    ids, size, cut = [], 0, True
        if key is not None:
            yield from closed(True)
            yield from _forest(items, [_common(a.prefix, b.prefix) for a, b in zip(items, items[1:], strict=False)], part, False, False)

    yield from _batches(rows())


def _group(top: bool):
    def merge(held: pa.Table) -> pa.Table:
        """Items of neighbouring ranges, in order, merged."""
        rows = held.sort_by([("part", "ascending"), ("seq", "ascending")]).to_pylist()
        items = [_Node(r["depth"], r["n_convs"], r["conv_id"], r["n_leaves"], r["n_children"], r["saved_tokens"], r["ends_sha256"], r["prefix"], r["sums"], i, r["conv_id"]) for i, r in enumerate(rows)]
        same = [p["part"] == q["part"] for p, q in zip(rows, rows[1:], strict=False)]
        joints = [min(a.depth, b.depth) if s else _common(a.prefix, b.prefix) for a, b, s in zip(items, items[1:], same, strict=False)]
        return pa.Table.from_batches(_batches(_forest(items, joints, rows[0]["into"], top, True)), schema=_ARROW)

    return merge


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's blocks, joined by commas, as they come in order."""
    own, sha = None, None
    for batch in batches:
        out = []
        for o, digits in zip(batch.column("own").to_pylist(), batch.column("digits").to_pylist(), strict=True):
            if o == own:
                sha.update(b",")
            else:
                if own is not None:
                    out.append((own, sha.hexdigest()))
                own, sha = o, hashlib.sha256()
            sha.update(digits.encode())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["own", "sha"])
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["own", "sha"])


def prefix_trie(t: DataFrame, fan: int = 64) -> DataFrame:
    """A row for each node of the trie of turn sequences: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    t: (conv_id, pos, digest, n_chars), as of ``turns``; a row with pos 0 stands for a conversation without turns. Sequences are equal where the digests of all
    turns are. A conversation without turns is a member of the root alone; an empty table has no node, as a root without members has no smallest one. The
    digests of one conversation (24 bytes a turn) are one row. ends_sha256 is sequential by its definition: the ids of a large group of equal conversations are
    sorted in pieces and hashed in blocks as they stream through one task.
    """
    at = F.sort_array(F.collect_list(F.when(F.col("pos") > 0, F.struct("pos", "digest", "n_chars"))))
    seqs = t.groupBy("conv_id").agg(at.alias("t"))
    seqs = seqs.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x.digest), "")).alias("key"), F.transform("t", lambda x: x.n_chars).alias("lens"))
    made = land(seqs.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_range, _SCHEMA))
    levels, items = [made.filter("kind = 'node'")], made.filter("kind = 'item'")
    opened, resolved = [items], []
    parts = items.agg(F.max("part")).first()[0]
    while parts is not None:
        into = F.expr(f"part div {fan}")
        top = parts < fan
        made_ = land(items.withColumn("into", into).groupBy("into").applyInArrow(_group(top), _SCHEMA))
        nodes, items = made_.filter("kind = 'node'"), made_.filter("kind = 'item'")
        levels.append(nodes)
        resolved.append(nodes.filter("own is not null").select("own", F.col("conv_id").alias("resolved")))
        if top:
            break
        opened.append(items)
        parts //= fan
    sha = made.filter("kind = 'ids'").select("own", "conv_id", "digits").repartition("own").sortWithinPartitions("own", "conv_id").select("own", "digits").mapInArrow(_digests, "own binary, sha string")
    done = [n.filter("up is null and own is null").select(*NODE) for n in levels]
    found = None
    for r in resolved:
        found = r if found is None else found.unionByName(r)
    for level, (nodes, items) in enumerate(zip(levels, [*opened, None], strict=False)):
        rest = nodes.filter("up is not null or own is not null")
        if items is not None and found is not None:  # parents by range and id, so that a parent of very many children is no hot key
            known = items.select("part", F.col("own").alias("up")).join(found.withColumnRenamed("own", "up"), "up")
            rest = rest.join(known, ["part", "up"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "resolved"))
        ends = F.when(F.col("ends_sha256").isNull(), F.col("own"))
        rest = rest.withColumn("own", ends).join(sha, "own", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "sha"))
        done.append(rest.select(*NODE))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(land(turns(table(spark, sf_dir, "conversations")))))


#: SQL for the table of the CRC-32's 256 steps, and for the checksum of an ASCII text over it.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n::UBIGINT] || range(8)::UBIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc)"


def crc32_sql(text: str) -> str:
    return f"xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split({text}, ''), lambda ch: ascii(ch)::UBIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)"


ORACLES = {
    "op11_prefix_trie": f"""WITH {CRC_TABLE},
o AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM o),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), crc_table),
r AS (SELECT conv_id, pos, g, chars FROM t JOIN ids USING (conv_id) WHERE pos > h UNION ALL SELECT ids.conv_id, pos, g, chars FROM ids JOIN t ON t.conv_id = ids.base AND t.pos <= ids.h),
s AS (SELECT conv_id, string_agg(g, '' ORDER BY pos) AS k, list(chars ORDER BY pos) AS chars FROM r GROUP BY conv_id UNION ALL SELECT conv_id, '', [] FROM ids WHERE conv_id NOT IN (SELECT conv_id FROM r)),
p AS (SELECT conv_id, k, chars, unnest(range(0, len(chars) + 1)) AS d FROM s),
n AS (SELECT substr(k, 1, 32 * d) AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(chars[d]), 0) AS chars FROM p GROUP BY ALL),
e AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM s GROUP BY k),
c AS (SELECT substr(k, 1, 32 * (d - 1)) AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(kids, 0) AS kids FROM n LEFT JOIN c USING (k)),
a AS (SELECT substr(k, 1, 32 * x) AS k, count(*) FILTER (kids = 0) AS leaves, sum((n_convs - 1) * chars) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS x FROM m) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM m JOIN a USING (k) LEFT JOIN e USING (k) LEFT JOIN n u ON m.d > 0 AND u.k = substr(m.k, 1, 32 * (m.d - 1))"""
}
QUERIES = {"op11_prefix_trie": op11_prefix_trie}
