"""The conversation operators against brute force on small fixtures with nulls, ties, repeated rows, long conversations, empty tables and extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from lineagrid.llm import conversation_repair as cr, prefix_trie as pt

ROWS = "conv_id long, turn long, role string, text string, pos int, digest string, key string, kind int, gone string, part int"


def frame(spark, rows):
    """conversations with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(*r, 1, "d", "k", 3, "g", 2) for r in rows], ROWS)


def talk(seed, n):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), 100, 101, 137, 199, 250, -7, 305]:
        for t in range(r.choice([0, 1, 1, 2, 3, 4, 7])):
            rows.append((c, r.choice([t, t, t, t + 1, None]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(["Hi.", "Yes", "no! ", "", " ", None, "Why?", "😀 so.\n"])))
    rows += [(5, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(40, 400)]
    rows += [(c, 9, "user", "same.") for c in range(60, 60 + n)] + rows[:10]
    r.shuffle(rows)
    return rows


def trie(seqs, chars):
    """{(prefix): row} from {conv_id: sequence} by enumerating prefixes."""
    members, ends, out = {}, {}, {}
    for c, s in seqs.items():
        ends.setdefault(s, []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * chars(p[-1]) if p else 0
    for p, m in members.items():
        out[p] = (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
    return Counter(out.values())


def brute_rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        own.setdefault(c, []).append((t is not None, t or 0, hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items() if c is not None}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = tuple(own.get(base, [])[:h] + v[h:])
    return out


def nodes(df):
    return Counter(tuple(r[c] for c in pt.NODE) for r in df.collect())


@pytest.mark.parametrize("fan", [64, 2])
def test_prefix_trie(spark, fan):
    """Ranges are merged in one round and, two at a time, in several."""
    rows = [*talk(3, 40), (None, 1, "user", "no id")]
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = nodes(pt.prefix_trie(pt.rebuilt(pt.turns(frame(spark, rows))), fan=fan))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == trie(brute_rebuilt(rows), lambda x: len(x[1]))


def test_prefix_trie_of_copies_and_of_nothing(spark, monkeypatch):
    """A group of copies that fills several ranges, its ids hashed in blocks; no conversation; one without turns."""
    rows = [(c, t, "user", f"x{t}") for c in range(900) for t in range(3)] + [(c, 0, "user", "x0") for c in range(900, 950)]
    seqs = {}
    for c, t, role, text in rows:
        seqs.setdefault(c, []).append((role, text))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "5")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = nodes(pt.prefix_trie(pt.turns(frame(spark, rows))))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == trie({c: tuple(s) for c, s in seqs.items()}, lambda x: len(x[1]))
    assert pt.prefix_trie(pt.rebuilt(pt.turns(frame(spark, [])))).count() == 0
    one = [(101, 0, "user", "Hi.")]
    assert nodes(pt.prefix_trie(pt.rebuilt(pt.turns(frame(spark, one))))) == trie(brute_rebuilt(one), lambda x: len(x[1]))


def test_forests_of_any_cut():
    """The rows of all cuts of a sorted list of sequences into ranges are those of one range."""
    r = random.Random(5)
    for _ in range(60):
        seqs = sorted(tuple(r.choice("ab") for _ in range(r.randint(0, 5))) for _ in range(r.randint(1, 12)))
        keys = [b"".join(x.encode() * pt._W for x in s) for s in seqs]
        own = lambda i: pt._Node(len(seqs[i]), 1, i, 0, 0, 0, "" if seqs.count(seqs[i]) > 1 else "e", keys[i], list(range(len(seqs[i]) + 1)), 0, i)  # noqa: E731, B023

        def forest(ids, part):
            items = [own(i) for i in ids]
            for at, x in enumerate(items):
                x.first = x.last = at
            return list(pt._forest(items, [pt._common(keys[a], keys[b]) for a, b in itertools.pairwise(ids)], part, False, False))

        cuts = sorted(r.sample(range(1, len(seqs)), min(len(seqs) - 1, r.randint(0, 3))))
        parts = [list(range(a, b)) for a, b in itertools.pairwise([0, *cuts, len(seqs)])]
        rows = [x for no, ids in enumerate(parts) for x in forest(ids, no)]
        import pyarrow as pa

        items = pa.Table.from_pylist([x | {"into": 0} for x in rows if x["kind"] == "item"], schema=pt._ARROW.append(pa.field("into", pa.int64())))
        up = pt._group(True)(items).to_pylist()
        want = trie({i: s for i, s in enumerate(seqs)}, lambda x: 1)
        got = Counter((x["conv_id"], x["depth"], x["n_convs"], x["n_children"], x["n_leaves"], x["saved_tokens"]) for x in [*rows, *up] if x["kind"] == "node")
        assert got == Counter((c, d, n, k, lv, s) for (c, d, _, n, k, lv, s, _), m in want.items() for _ in range(m))


def cheapest(codes):
    """(cost, audit) over the automaton of the grammar, each state with its cheapest edits."""

    def inserted(b):
        for _ in range(3):
            for st, (c, a) in list(b.items()):
                q = "a" if st == "u" else "u"
                b[q] = min(b.get(q, (c + 5, a + "I")), (c + 5, a + "I"))
        return b

    best = inserted({"n": (0, "")})
    for code in codes:
        fault, x, nxt = code >> 2, "suax"[code & 3], {}
        for st, (c, a) in best.items():
            ways = [(st, c + 2, a + "D")]
            if fault not in (1, 2):
                more, q = (5 if fault == 3 else 0), "a" if st == "u" else "u"
                ways += [("s", c + more, a + "K")] * (st == "n" and x == "s") + [(q, c + more + (x != q), a + ("K" if x == q else "R"))]
            for q, *v in ways:
                nxt[q] = min(nxt.get(q, tuple(v)), tuple(v))
        best = inserted(nxt)
    return min(v for st, v in best.items() if st in "na")


def every(codes, most):
    """The cheapest audit of all sequences of edits that cost at most ``most``."""
    out = []

    def go(i, st, c, a):
        if c > most:
            return
        if i == len(codes) and st in "na":
            out.append((c, a))
        q = "a" if st == "u" else "u"
        go(i, q, c + 5, a + "I")
        if i < len(codes):
            fault, x = codes[i] >> 2, "suax"[codes[i] & 3]
            go(i + 1, st, c + 2, a + "D")
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                if st == "n" and x == "s":
                    go(i + 1, "s", c + more, a + "K")
                go(i + 1, q, c + more + (x != q), a + ("K" if x == q else "R"))

    go(0, "n", 0, "")
    return min(out)


def test_alignment():
    r = random.Random(1)
    deal = lambda n: bytes(r.choice([0, 1, 2, 3]) + 4 * r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
    for n in (*range(7), *[r.randint(0, 16) for _ in range(2000)], 300):
        codes = deal(n)
        assert cr.align(codes) == cheapest(codes)
    for _ in range(150):
        codes = deal(r.randint(0, 6))
        assert cr.align(codes) == every(codes, cheapest(codes)[0])
    assert cr.align(bytes([0] * 50 + [1, 2])) == cheapest(bytes([0] * 50 + [1, 2]))


def brute_repair(rows):
    said = lambda x: " " if x is None else str(x)
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, [])
        role, text, kind = said(role), said(text), zlib.crc32(f"{said(c)}:{said(t)}".encode()) % 20
        text, role = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text), "user" if kind == 4 else role
        by[c] += [(t is not None, t or 0, role, hashlib.md5(text.encode()).digest(), text, t)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for c, own in by.items():
        own.sort(key=lambda x: x[:4])
        codes, seen = [], set()
        for _, _, role, _, text, _ in own:
            last = text.rstrip(" \t\n\v\f\r")[-1:]
            fault = 1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0
            seen.add((role, text))
            codes.append(("sua".find(role[:1]) if role[:1] and role[:1] in "sua" else 3) + 4 * fault)
        cost, audit = cheapest(codes)
        turns = [x[5] for x in own if x[5] is not None]
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        made, it, nxt = [], iter(own), "user"
        for e in audit:
            role, text = (nxt, "") if e == "I" else (lambda x: (x[2], x[4]))(next(it))
            if e != "D":
                role = nxt if e == "R" else role
                made.append(f"{role}:{text}")
                nxt = "assistant" if role[0] == "u" else "user"
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(sum(x >> 2 == f for x in codes) for f in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()))
    return Counter(out)


def test_conversation_repair(spark):
    rows = [*talk(8, 120), (None, 1, "user", "No id."), (None, None, None, None), (700, 0, "user", "word " * 60_000 + ".")]
    out = cr.repair(cr.damaged(frame(spark, rows)))
    cols = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert Counter(tuple(r[c] for c in cols) for r in out.collect()) == brute_repair(rows)
    assert cr.repair(cr.damaged(frame(spark, []))).count() == 0


def test_all_rows_dropped(spark):
    c = next(c for c in itertools.count() if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    r = cr.repair(cr.damaged(frame(spark, [(c, 0, "user", "Hi.")]))).collect()
    assert [tuple(x) for x in r] == [(c, 0, 0, 0, 0, 0, 0, "", cr.EMPTY)]
