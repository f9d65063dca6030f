"""Repair of damaged conversations by alignment with the grammar of roles: an optional system turn, then user and assistant in turn.

The strings of the grammar are (ua)^r and s(ua)^r, one of each feasible length. Wagner-Fischer aligns a conversation's rows with them
from the end, where the strings of all lengths are the same: cell (row i, k) is the least cost to make the last k letters of rows i and on, so
one table serves every length; a system turn can only be the first that is kept. Ukkonen's band: what may come before a cell depends
on k's parity alone (and on k being 0, which nothing but a system turn forbids), so a row's incumbents are the least costs of k = 0, of odd and of other
even k, and a cell above its incumbent lies on no cheapest repair and is outside the band. Every length of least cost is backtraced, forward
from the first row and by the least letter, and the audits are compared as they come.

Rows are sorted by conversation and stream through, in two passes: the first sees a code a row and keeps one byte of it, the second
sees the texts after the audit of their conversation and hashes them one by one. So a conversation takes a few bytes a row at a time,
however long it is, though all of it takes one task, as its alignment and its hash are sequential.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import land, table
from .prefix_trie import CRC_TABLE, crc32_sql

RULE = {"rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
#: Codes of a row: role letter (x: any other) in the order of "suax", and 4 times its fault (0 none, 1 blank, 2 duplicate, 3 truncated).
_LETTER, _BLANK, _DUPLICATE, _TRUNCATED = "suax", 1, 2, 3
EMPTY = hashlib.sha256(b"").hexdigest()


class _Table:
    """Costs of aligning rows i and on with the last k letters of uaua...ua: for each row the k of its band, ascending."""

    def __init__(self, codes: bytes, rule: dict[str, int]):
        self.codes, self.rule, self.k, self.c, self.at = codes, rule, array("q"), array("q"), array("q", [0])
        cells = self._keep({0: 0})
        for i in range(len(codes) - 1, -1, -1):
            cells = self._keep(self._before(codes[i], cells))

    def _before(self, code: int, cells: dict[int, int]) -> dict[int, int]:
        """Cells with one more row in front: it is deleted, or matched with the letter that comes k from the end."""
        out = {k: c + self.rule["delete"] for k, c in cells.items()}
        fault, letter = code >> 2, _LETTER[code & 3]
        if fault not in (_BLANK, _DUPLICATE):
            more = self.rule["truncated"] if fault == _TRUNCATED else 0
            for k, c in cells.items():
                cost = c + more + (0 if letter == _at(k + 1) else self.rule["rerole"])
                if cost < out.get(k + 1, cost + 1):
                    out[k + 1] = cost
        return out

    def _keep(self, cells: dict[int, int]) -> dict[int, int]:
        """Insertions (a third one would only come back to a parity at more cost), then the cells that are incumbents; these are noted."""
        for _ in range(2):
            for k in sorted(cells):
                cost = cells[k] + self.rule["insert"]
                if cost < cells.get(k + 1, cost + 1):
                    cells[k + 1] = cost
        best: dict[int, int] = {}
        for k, c in cells.items():
            best[_kind(k)] = min(c, best.get(_kind(k), c))
        cells = {k: cells[k] for k in sorted(cells) if cells[k] == best[_kind(k)]}
        self.k.extend(cells)
        self.c.extend(cells.values())
        self.at.append(len(self.k))
        return cells

    def band(self, i: int) -> list[tuple[int, int]]:
        """(k, cost) of row i."""
        r = len(self.codes) - i
        return list(zip(self.k[self.at[r] : self.at[r + 1]], self.c[self.at[r] : self.at[r + 1]], strict=True))

    def cost(self, i: int, k: int) -> int | None:
        r = len(self.codes) - i
        j = bisect_left(self.k, k, self.at[r], self.at[r + 1])
        return self.c[j] if j < self.at[r + 1] and self.k[j] == k else None

    def edit(self, i: int, k: int) -> str:
        """The ASCII-least edit with which a cheapest alignment of a cell begins."""
        c = self.cost(i, k)
        if i < len(self.codes) and self.cost(i + 1, k) == c - self.rule["delete"]:
            return "D"
        if k and self.cost(i, k - 1) == c - self.rule["insert"]:
            return "I"
        return "K" if _LETTER[self.codes[i] & 3] == _at(k) else "R"

    def audit(self, i: int, lengths: list[int]) -> str:
        """The ASCII-least of the cheapest edits of rows i and on for any of these lengths, which cost the same.

        All lengths are traced in step; where their audits part, those that are behind are given up, and those that meet in a cell are one.
        """
        out, cells = [], {(i, k) for k in lengths}
        while (len(self.codes), 0) not in cells:
            said = {x: self.edit(*x) for x in cells}
            least = min(said.values())
            out.append(least)
            cells = {(i + (least != "I"), k - (least != "D")) for (i, k), e in said.items() if e == least}
        return "".join(out)


def _at(k: int) -> str:
    """The letter that is k from the end of uaua...ua, counted from 1."""
    return "ua"[k & 1]


def _kind(k: int) -> int:
    return 2 if k and k % 2 == 0 else k & 1


def align(codes: bytes, rule: dict[str, int] = RULE) -> tuple[int, str]:
    """(cost, audit) of a cheapest repair of a conversation's rows, of equal ones the one whose audit is ASCII-least."""
    t = _Table(codes, rule)
    # (cost, row of the system turn that is kept or -1, letters of the rest)
    ways = [(c, -1, k) for k, c in t.band(0) if k % 2 == 0]
    for i, code in enumerate(codes):
        if code & 3 == 0 and code >> 2 not in (_BLANK, _DUPLICATE):
            own = rule["delete"] * i + (rule["truncated"] if code >> 2 == _TRUNCATED else 0)
            ways += [(own + c, i, k) for k, c in t.band(i + 1) if _kind(k) == 2]
    best = min(w[0] for w in ways)
    system = max(i for c, i, _ in ways if c == best)  # of system turns the last: D comes before K
    of = {i: [k for c, j, k in ways if c == best and j == i] for i in {-1, system}}
    return best, min(("D" * i + "K" if i >= 0 else "") + t.audit(i + 1, ks) for i, ks in of.items() if ks)


def damaged(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows with the damage that the checksum of conv_id:turn deals them; a dropped one is marked gone."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(kinds)).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return d.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), twice.alias("copy")).drop("copy")


_FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _order() -> list:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, {"long": pa.int64(), "string": pa.string()}[t]) for n, t in (c.strip().split(" ") for c in ddl.split(","))])


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Faults, cost and audit of each conversation from its rows' codes (-1: gone), which come in order."""
    schema, conv, held, out = _schema(_FOUND), None, None, []

    def end() -> None:
        codes, legal, low, high, distinct = held[0], held[1], held[2], held[3], held[4]
        faults = [sum(c >> 2 == f for c in codes) for f in (_BLANK, _DUPLICATE, _TRUNCATED)]
        cost, audit = align(bytes(codes))
        out.append((conv[0], 0 if low is None else high - low + 1 - distinct, *faults, max(len(codes) - 1, 0) - legal, cost, audit))

    def batch() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    for b in batches:
        out.clear()
        for c, turn, code in zip(*(b.column(n).to_pylist() for n in ("conv_id", "turn", "code")), strict=True):
            if conv is None or conv[0] != c:
                if conv is not None:
                    end()
                conv, held = (c,), [bytearray(), 0, None, None, 0]
            if code < 0:
                continue
            codes = held[0]
            if codes and (codes[-1] & 3, code & 3) in ((0, 1), (1, 2), (2, 1)):
                held[1] += 1
            codes.append(code)
            if turn is not None and turn != held[3]:
                held[2], held[3], held[4] = turn if held[2] is None else held[2], turn, held[4] + 1
        yield batch()
    out.clear()
    if conv is not None:
        end()
    yield batch()


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each repaired conversation: its audit comes first, then its rows, in the same order as before."""
    schema = _schema(_FOUND + ", repaired_sha256 string")
    found, audit, at, sha, some, turn = None, "", 0, None, False, "user"

    def say(role: bytes, text: bytes) -> None:
        nonlocal some, turn
        sha.update((b"\n" if some else b"") + role + b":")
        sha.update(text)
        turn = "assistant" if role[:1] == b"u" else "user"
        some = True

    def insertions() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            at += 1
            say(turn.encode(), b"")

    def end() -> tuple:
        insertions()
        return (*found, sha.hexdigest())

    for b in batches:
        out = []
        cols = {n: b.column(n).to_pylist() for n in b.schema.names}
        for i, audit_ in enumerate(cols["audit"]):
            if audit_ is not None:
                if found is not None:
                    out.append(end())
                found, audit, at, sha, some, turn = tuple(cols[f.name][i] for f in schema if f.name != "repaired_sha256"), audit_, 0, hashlib.sha256(), False, "user"
                continue
            insertions()
            edit, at = audit[at], at + 1
            if edit != "D":
                say(turn.encode() if edit == "R" else cols["role"][i], cols["text"][i])
        yield _of(out, schema)
    yield _of([end()] if found is not None else [], schema)


def _of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id (rows without one are a conversation of their own): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: (conv_id, turn, role, text, gone), as of ``damaged``; rows that are gone only say that their conversation exists. Rows of one turn come in the order of role and
    text's digest, so equal ones stand together and the first of them is no duplicate. A conversation all of whose rows are gone has zeros, an empty audit
    and the hash of an empty text. Letters of roles other than system, user and assistant are judged by their first character too.
    """
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    r = rows.withColumns({"digest": F.unhex(F.md5("text")), "last": last})
    letter = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(F.col("last") == "", _BLANK).when(again, _DUPLICATE).when(~F.col("last").isin(".", "!", "?"), _TRUNCATED).otherwise(0)
    own = r.select("conv_id", "turn", "role", "digest", "last", "gone").repartition("conv_id")  # rows of a conversation are together from here on
    coded = own.select("conv_id", "turn", "role", "digest", again.alias("again"), F.when(F.col("gone"), -1).otherwise(letter + 4 * fault).alias("code"))
    found = land(coded.sortWithinPartitions("conv_id", *_order(), "again").select("conv_id", F.col("turn").cast("long").alias("turn"), "code").mapInArrow(_audits, _FOUND))
    nothing = {"turn": F.lit(None).cast(rows.schema["turn"].dataType), "role": F.lit(None).cast("string"), "digest": F.lit(None).cast("binary"), "text": F.lit(None).cast("string")}
    texts = r.filter("not gone").select("conv_id", *nothing)
    both = found.withColumns(nothing).unionByName(texts, allowMissingColumns=True).repartition("conv_id")
    both = both.sortWithinPartitions("conv_id", F.desc_nulls_last("cost"), *_order())
    return both.select(*found.columns, F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text")).mapInArrow(_hashes, _FOUND + ", repaired_sha256 string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


ORACLES = {
    # the automaton of the grammar (n: nothing yet, s, u, a: the last letter) over each conversation's rows; of each state the cheapest edits, of equal ones the ASCII-least
    "op12_conversation_repair": f"""WITH RECURSIVE {CRC_TABLE},
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM k),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ending FROM d),
f AS (SELECT *, CASE WHEN ending = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN ending NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault, left(role, 1) AS x, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
c AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
tr(st, q, edit) AS (VALUES ('n', 'n', 'D'), ('s', 's', 'D'), ('u', 'u', 'D'), ('a', 'a', 'D'), ('n', 's', 'S'), ('n', 'u', 'M'), ('s', 'u', 'M'), ('a', 'u', 'M'), ('u', 'a', 'M')),
ins(q, st, more, edits) AS (VALUES ('n', 'n', 0, ''), ('s', 's', 0, ''), ('u', 'u', 0, ''), ('a', 'a', 0, ''), ('n', 'u', 5, 'I'), ('n', 'a', 10, 'II'), ('s', 'u', 5, 'I'), ('s', 'a', 10, 'II'), ('u', 'a', 5, 'I'), ('a', 'u', 5, 'I')),
w AS (SELECT conv_id, 0::BIGINT AS i, st, {{'cost': more, 'audit': edits}} AS v FROM c, ins WHERE q = 'n'
UNION ALL SELECT w.conv_id, f.i, ins.st, min({{'cost': v.cost + more + CASE WHEN edit = 'D' THEN 2 ELSE CASE WHEN f.x = tr.q THEN 0 ELSE 1 END + CASE WHEN fault = 't' THEN 5 ELSE 0 END END, 'audit': v.audit || CASE WHEN edit = 'D' THEN 'D' WHEN f.x = tr.q THEN 'K' ELSE 'R' END || edits}})
FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN tr ON tr.st = w.st AND (edit = 'D' OR fault NOT IN ('b', 'd') AND (edit = 'M' OR f.x = 's')) JOIN ins ON ins.q = tr.q GROUP BY w.conv_id, f.i, ins.st),
b AS (SELECT w.conv_id, min(v) AS v FROM w JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i WHERE st IN ('n', 'a') GROUP BY w.conv_id),
e AS (SELECT conv_id, p, v.audit[p] AS edit, p - len(replace(left(v.audit, p), 'I', '')) AS inserted FROM (SELECT conv_id, v, unnest(range(1, len(v.audit) + 1)) AS p FROM b)),
g AS (SELECT e.conv_id, p, edit, f.role, f.text, f.x, row_number() OVER (PARTITION BY e.conv_id ORDER BY p) AS j, first_value(edit = 'K' AND f.x = 's') OVER (PARTITION BY e.conv_id ORDER BY p) AS sys FROM e LEFT JOIN f ON edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = p - inserted WHERE edit <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j + CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM g GROUP BY conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.v.cost, 0)::BIGINT AS cost, coalesce(b.v.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM z.conv_id"""
}
QUERIES = {"op12_conversation_repair": op12_conversation_repair}
