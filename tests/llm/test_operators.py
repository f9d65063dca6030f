"""Each operator against a brute-force version on small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagrid.llm import fingerprint, license_scan, mixing, near_duplicates, private_data, quality, sentencepiece_codec, token_counts, toxicity, vector_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, score double, size long, rid long, c int"


def docs(spark, rows):
    """documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None, 1, "k", 0.5, 3, 7, 1) for i, t, s in rows], DOCS)


EDGE = [
    (0, None, "a"), (1, "", "a"), (2, "one", None), (3, "All  Rights\nReserved. CC BY x", "b"), (4, "a b c d e f g", "b"), (4, "a b c d e f g", "b"),
    (5, "A b C d e f g", "a"), (6, "Released under the MIT License.", "c"), (7, "word " * 30_000, "c"), (8, "x" * 70_000, "c"), (9, "İ K é ▁ \x00 ퟿ 😀", "b"),
]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def found_templates(w):
    """(labels, best share) of templates in any run of words of their own length and a half."""
    labels, best = set(), 0.0
    for label, said, need in license_scan.wordings(license_scan.TEMPLATES):
        n, distinct = license_scan.run_length(said), set(need)
        if not distinct & set(w):
            continue
        share = max((len(distinct & set(w[k : k + n])) / len(distinct) for k in range(len(w)) if w[k] in distinct), default=0)
        if share >= 0.9:
            labels.add(label)
            best = max(best, share)
    return labels, best


def test_license_scan(spark):
    out = license_scan.license_scan(docs(spark, EDGE))
    words = lambda t: re.findall(license_scan.WORD, low(t))
    want = []
    for i, t, _ in EDGE:
        w, at, base = words(t), [], set()
        for p, label in license_scan.PHRASES.items():
            q = p.split()
            hits = [k for k in range(len(w)) if w[k : k + len(q)] == q]
            at += hits
            base |= {label} if hits else set()
        labels, best = found_templates(w)
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), best))
    assert rows(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == sorted(want, key=repr)
    assert license_scan.license_scan(docs(spark, [])).count() == 0


def test_license_scan_across_line_breaks(spark):
    """Hard-wrapped templates are found, scattered words of one long line are not; against all runs of words."""
    block = max(license_scan.run_length(w) for _, w, _ in license_scan.wordings(license_scan.TEMPLATES))
    r = random.Random(11)
    texts = []
    for label in ("bsd", "isc", "mpl-2.0", "cc0-1.0", "mit"):
        w = license_scan.TEMPLATES[label]
        w = (w if isinstance(w, str) else w[-1]).split()
        for before in (0, 1, block - 5, block, 2 * block - 1, 700):
            texts.append(" ".join(f"q{k}" for k in range(before)) + "\n * " + " ".join(w[: len(w) // 2]) + "\n * " + " ".join(w[len(w) // 2 :]) + " tail" * r.choice([0, 1, 300]))
    texts += [" ".join(["copyright"] + ["filler"] * 60), ("filler " * 60).join(["copyright ", "all ", "rights ", "reserved "])]
    texts += ["copyright" + " f" * n + " all rights reserved" for n in range(6)]
    # the words of a template near each other, but not as a license
    texts += ["The MIT professor spoke at length. He said that under the new rules the data was released to the public and that every visitor needs a license.", "Copyright law protects all books. The author reserved two copies and kept the rights."]
    none = range(len(texts) - 2, len(texts))
    vocab = sorted({x for _, _, words in license_scan.wordings(license_scan.TEMPLATES) for x in words})
    texts += [" ".join(r.choice(vocab[:40]) for _ in range(r.randint(1, 300))) for _ in range(30)]
    want = [found_templates(license_scan.words_of(t)) for t in texts]
    assert {"bsd"} <= want[0][0] and {"isc"} <= want[6][0] and {"mit"} <= want[24][0] and not want[31][0] and not any(want[i][0] for i in none)
    got = {x.doc_id: x for x in license_scan.license_scan(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, (labels, best) in enumerate(want):
        assert {x.label for x in got[i].templates or []} == labels and got[i].score == best, texts[i][:200]


def test_fingerprints_add_up(spark):
    d = spark.createDataFrame([(1, "A. B.\nC"), (2, "C\nB.A."), (3, "A. B."), (4, "C"), (5, None)], "doc_id long, text string")
    fp = fingerprint.fingerprints(spark.createDataFrame([(1, "A.\nB.\nC"), (2, "B.\nA.\nC"), (3, "A.\nB.\n"), (4, "C"), (5, None)], "doc_id long, text string"), ["doc_id"])
    got = {r.doc_id: r for r in fp.select("doc_id", "state", fingerprint.digest(F.col("state")).alias("d")).collect()}
    assert got[1].d != got[3].d and got[5].d.endswith("-0")
    a, b, c = (fp.filter(f"doc_id = {i}").select(F.col("state").alias(f"s{i}")) for i in (1, 3, 4))
    both = a.crossJoin(b).crossJoin(c).select(fingerprint.digest(fingerprint.add(F.col("s3"), F.col("s4"))).alias("sum"), fingerprint.digest(fingerprint.subtract(F.col("s1"), F.col("s4"))).alias("rest")).first()
    assert both["sum"] == got[1].d and both["rest"] == got[3].d
    assert d.count() == 5


def test_fingerprint_pairs(spark):
    data = [(10 * i, t, s) for i, (_, t, s) in enumerate(EDGE)]
    out = {r.doc_id: r for r in fingerprint.fingerprint_pairs(docs(spark, data), blocks=3).collect()}
    for k, (i, t, _) in enumerate(data):
        t, nxt = t or "", data[(k + 1) % len(data)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
        if edited == t:
            assert out[i].near_edited == 1 and out[i].fingerprint == out[i].edited_fingerprint
    assert out[40].fingerprint == out[50].fingerprint and out[40].near_next == 1
    assert fingerprint.fingerprint_pairs(docs(spark, [])).count() == 0
    assert fingerprint.fingerprint_pairs(docs(spark, [(None, "a", "s"), (3, "b", "s")])).count() == 2


def test_fingerprints_of_more_units_than_counters_of_20_bits_hold(spark):
    n = (1 << 20) + 50
    d = spark.createDataFrame([(1, "\n" * n), (2, "\n" * (n // 2) + "a." * (n // 2)), (3, "b.")], "doc_id long, text string")
    got = {r.doc_id: r.state for r in fingerprint.fingerprints(d, ["doc_id"]).collect()}
    assert got[1].n == n and got[2].n == n // 2 * 2
    one = hashlib.sha256(b"\n").hexdigest()
    assert got[1].eq == [int(one[8 * k : 8 * k + 8], 16) * n % 2**32 for k in range(8)]
    for k, packed in enumerate(got[1].sk):
        group = int(one[15 * (k // 15) + 1 - 1 : 15 * (k // 15) + 15], 16)
        bits = [group >> (k % 15) & 1, group >> (k % 15 + 15) & 1]
        assert packed == n * bits[0] + (n * bits[1] << 31)
    near = {r.doc_id: r for r in fingerprint.fingerprint_pairs(d, blocks=2).collect()}
    assert 0.4 < near[1].near_next < 0.95 and near[3].near_next == pytest.approx(0, abs=0.4)
    # sums of many fingerprints wrap within their own lane
    big = fingerprint.fingerprints(d.filter("doc_id = 1"), ["doc_id"])
    state = F.col("state")
    for _ in range(12):
        big = big.select("doc_id", fingerprint.add(state, state).alias("state"))
    s, m = big.first().state, 4096 * n
    assert s.n == m and s.eq == [int(one[8 * k : 8 * k + 8], 16) * m % 2**32 for k in range(8)]
    assert all(x & (2**31 - 1) in (0, m % 2**31) and x >> 31 in (0, m % 2**31) for x in s.sk)


def test_fingerprints_of_rows_that_share_an_id(spark):
    """One id, and none, on many rows: dealt over several ranges, each row still followed by the next in the order of id and hash."""
    data = [(7 if i % 3 else None, f"text {i % 40}. of {i % 7}", "s") for i in range(300)] + [(i, f"t{i}", "s") for i in range(20, 40)] + [(7, "same", "s")] * 60
    d = docs(spark, data)
    h = {r.text: r.h for r in d.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0, h[r[1]]))
    want = []
    for k, (i, t, _) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        want.append((i, hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()))
    for blocks in (1, 12):
        assert rows(fingerprint.fingerprint_pairs(d, blocks=blocks), "doc_id", "edited_sha256") == sorted(want, key=repr)


def brute_components(data):
    sets = {}
    for i, t, *_ in data:
        w = low(t).split() if t else []
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids, up = sorted(sets), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[x] for b in sets[y]):
                p, q = root(x), root(y)
                up[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("most", [1, 2, 24])
def test_near_duplicates_is_exact(spark, most, monkeypatch):
    monkeypatch.setattr(near_duplicates, "_CHUNK", 3)  # keys meet in chunks
    r = random.Random(most)
    common = [f"boiler{k}" for k in range(12)]
    data = [(i, t, s) for i, t, s in EDGE]
    for i in range(100, 330):
        base = random.Random(r.randint(0, 60))
        words = [f"w{base.randint(0, 500)}" for _ in range(base.choice([3, 8, 14, 30, 60, 140, 300]))]
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            words[r.randrange(len(words))] = f"new{r.randint(0, 9)}"
        data.append((i, " ".join(common * r.choice([0, 1, 2]) + words), "s"))
    got = {x.doc_id: x for x in near_duplicates.near_duplicates(docs(spark, data), most=most).collect()}
    assert {i: x.component_id for i, x in got.items()} == brute_components(data)
    assert got[0].n_shingles == 0 and got[2].n_shingles == 1 and got[4].n_shingles == 3
    assert got[0].component_id == 0 and got[1].component_id == 1 and got[5].component_id == 4


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates.near_duplicates(docs(spark, [])).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(4)
    v = [(i, [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(300)] + [(1000 + i, [0.5] * 6) for i in range(90)]
    v += [(20_000, None), (20_020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (20_040, [float("nan")] * 6), (20_060, [float("inf")] * 6), (20_080, [])]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in v], "vec_id long, embedding array<float>, label int, m string")
    got = rows(vector_search.top_k(df, pivots=5, block=16, query_block=4), "query_id", "rank", "vec_id", "score")
    q = {i: [math.floor(64 * float(np.float32(x))) for x in e] for i, e in v if e and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for i in q:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i)[:20]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want, key=repr)
    assert vector_search.top_k(df.limit(0)).count() == 0
    assert vector_search.top_k(df.filter("vec_id in (0, 1, 2)")).count() == 2


def test_top_k_of_several_lengths_and_repeated_ids(spark):
    r = np.random.default_rng(5)
    v = [(i, [float(x) for x in r.integers(-3, 4, size=4)]) for i in range(120)] + [(i, [float(x) for x in r.integers(-3, 4, size=2)]) for i in range(200, 230)] + [(500, [1.0])]
    v += [(40, [1.0, 2.0, 3.0, 1.0]), (41, [1.0, 2.0, 3.0, 1.0]), (41, [1.0, 2.0, 3.0, 1.0])]
    got = rows(vector_search.top_k(spark.createDataFrame(v, "vec_id long, embedding array<double>"), pivots=3, block=8, query_block=2), "query_id", "rank", "vec_id", "score")
    points = sorted({(i, tuple(math.floor(64 * x) for x in e)) for i, e in v})
    want = {}
    for i, q in points:
        if i % 20 == 0:
            want.setdefault(i, []).extend((-sum(a * b for a, b in zip(q, x)), j) for j, x in points if j != i and len(x) == len(q))
    want = [(i, k + 1, j, -s) for i, found in want.items() for k, (s, j) in enumerate(sorted(found)[:20])]
    assert got == sorted(want, key=repr)


def test_top_k_leaves_out_what_bounds_exclude(spark):
    """On clustered vectors of one length most products are never taken, and the result is that of a search of everything."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16))
    x = np.repeat(centres, 100, axis=0) / np.linalg.norm(centres, axis=1).repeat(100)[:, None] + 0.01 * r.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    searched, every = vector_search.pairs_searched(df, pivots=24, block=64, query_block=8)
    assert every == 2000 * 100 and searched < 0.15 * every
    q = np.floor(64 * x).astype(np.int64)
    got = {(a, b): (c, s) for a, b, c, s in rows(vector_search.top_k(df, pivots=24, block=64, query_block=8), "query_id", "rank", "vec_id", "score")}
    for i in range(0, 2000, 20):
        s = q @ q[i]
        best = [j for j in np.lexsort((np.arange(2000), -s)) if j != i][:20]
        assert [got[i, k + 1] for k in range(20)] == [(j, s[j]) for j in best]


def test_sentencepiece_matches_the_library(spark):
    import sentencepiece as sp

    lib = sp.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    r = random.Random(2)
    texts = [t for _, t, _ in EDGE] + ["".join(r.choice("abcdethinors   \n▁é😀.,!AB012<>s/") for _ in range(r.randint(1, 80))) for _ in range(400)] + [" " * k + "a" for k in range(40)]
    vocab = [lib.id_to_piece(i) for i in range(300, 32000)]
    texts += ["".join(r.choice(vocab) for _ in range(9)).replace("▁", " ") for _ in range(400)]
    got = {x.doc_id: x for x in sentencepiece_codec.encode_documents(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    assert sentencepiece_codec.encode_documents(docs(spark, [])).count() == 0


def greedy(pieces, word):
    first, more = {p[1:] for p in pieces if p[0] == "▁"}, {p for p in pieces if p[0] != "▁"}
    at = n = 0
    longest = max(map(len, pieces))
    while at < len(word):
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in (more if at else first)), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_token_counts(spark):
    r = random.Random(3)
    for _ in range(150):
        pieces = [r.choice(["▁", ""]) + "".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 12))]
        a = token_counts.Automaton(pieces)
        for _ in range(40):
            w = "".join(r.choice("abc") for _ in range(r.randint(1, 12)))
            assert a.count(w) == greedy(pieces, w)
    v = set(token_counts.vocabulary(sentencepiece_codec.model_path()))
    got = rows(token_counts.token_counts(docs(spark, EDGE)), "doc_id", "n_words", "n_tokens")
    want = []
    for i, t, _ in EDGE:
        words = token_counts._WORD.findall(t or "")
        each = {w: greedy(v, w) for w in set(words)}
        want.append((i, len(words), sum(each[w] for w in words)))
    assert got == sorted(want, key=repr)
    assert token_counts.token_counts(docs(spark, [])).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_private_data(spark):
    r = random.Random(5)
    alphabet = ["a", "b", "@", ".", "x.y", "1", "23", "255", "256", "-", " ", "+", "(", ")", "é", "😀", "\n", "4111111111111111", "79927398713", "1.2.3.4"]
    texts = [t for _, t, _ in EDGE] + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(400)] + ["1" * 20_000, "1 " * 3000, ("a@b.cd " * 1200), "a" * 20_000 + "@b.c", "1." * 3000]
    got = private_data.find_private(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    for x in got.collect():
        assert [(s.s, s.k, s.e) for s in x.base] == brute_spans(texts[x.doc_id]), texts[x.doc_id][:80]
    assert private_data.find_private(docs(spark, [])).count() == 0


def test_disclosing_terms(spark):
    near = [(i, f"filler{i} words Zaphod wrote from a1@b.com on day{i} and left", "s") for i in range(4)]
    far = [(10 + i, f"and then filler words {i} on left from wrote", "s") for i in range(30)]
    copies = [(50 + i, "quiet unusual remark c9@d.org made once", "s") for i in range(5)]
    found = {x.doc_id: x for x in private_data.find_private(docs(spark, near + far + copies), support=3).collect()}
    for i, t, _ in near:
        assert {t[x.s : x.e] for x in found[i].terms} == {"Zaphod"}
    assert not any(found[i].terms for i, _, _ in far + copies)
    import duckdb

    duck = duckdb.connect()
    documents = docs(spark, near + far + copies).toPandas()  # noqa: F841  read by name below
    duck.register("documents", documents)
    spans = dict(duck.sql(f"SELECT doc_id, spans FROM ({private_data._oracle(support=3)})").fetchall())
    for i, x in found.items():
        text = ",".join(f"{private_data.KINDS[y.k]}:{y.s}:{y.e}" for y in sorted([*x.base, *x.terms], key=lambda y: (y.s, y.k)))
        assert spans[i] == text
    d = spark.createDataFrame([("call +1 234 567 8901 now, a@b.co",)], "text string")
    assert d.select(private_data.sanitise(F.col("text"), private_data.base_spans(F.col("text"))).alias("x")).first().x == "call [PHONE] now, [EMAIL]"


def test_disclosing_terms_anywhere_in_the_document(spark):
    """A name far from the address, in other places of its documents too, and in documents without it; against brute force."""
    gap = " ".join(f"gap{k % 3}" for k in range(60))
    data = [(i, f"Zaphod said{i} {gap} mail to a1@b.com {gap} then zaphod left{i}", "s") for i in range(4)]
    data += [(4, "Zaphod beside a1@b.com only here", "s"), (5, "Trillian x1 1.2.3.4 y1", "s"), (5, "Trillian x1 1.2.3.4 y1", "s"), (6, f"Trillian x2 {gap} 1.2.3.4", "s")]
    data += [(20 + i, f"{gap} other{i} Trillian words", "s") for i in range(30)] + [(60 + i, "quiet unusual remark c9@d.org made once", "s") for i in range(5)] + [(70, None, "s")]
    r = random.Random(9)
    people = [(f"name{k}", f"p{k}@x.org") for k in range(6)]
    for i in range(100, 160):
        who = r.sample(people, 2)
        data.append((i, " ".join(r.sample([f"w{r.randint(0, 30)}" for _ in range(20)] + [who[0][0], who[0][1], r.choice(who)[1], r.choice(people)[0]], 24)), "s"))
    data += data[-3:] + [(200, "", "s")]
    for support in (1, 2, 3):
        want = brute_terms([t or "" for _, t, _ in data], support)
        assert support < 3 or (len(want[0]) >= 2 and want[4])
        got = private_data.find_private(docs(spark, data), support=support).collect()
        assert sorted((x.doc_id, [(y.s, y.e) for y in x.terms]) for x in got) == sorted((i, sorted(w)) for (i, _, _), w in zip(data, want))


def fold(w):
    """Terms are compared in lower case, beyond ASCII too; two signs that would turn into ASCII letters stay outside."""
    return w.replace("\u212a", "\u00ff").replace("\u0130", "\u00ff").lower()


def brute_terms(texts, support=1, threshold=0.9):
    """Places of the disclosing terms of each text, by the definition."""
    base = [[(s, e, f"{k}:{t[s:e].lower() if k < 2 else re.sub('[^0-9]', '', t[s:e])}") for s, k, e in brute_spans(t)] for t in texts]
    words = [{fold(w) for w in re.findall(private_data.WORDS, t)} for t in texts]
    seen, want = {}, [set() for _ in texts]
    for w in words:
        for t in w:
            seen[t] = seen.get(t, 0) + 1
    for ent in {x[2] for b in base for x in b}:
        e = {i for i, b in enumerate(base) if any(x[2] == ent for x in b)}
        if len(e) == len(texts):
            continue
        for t in set().union(*(words[i] for i in e)):
            te = {i for i in e if t in words[i]}
            if len(t) < 3 or t.isdigit() or len({texts[i] for i in te}) < support or math.log2(len(texts) * len(te) / (seen[t] * len(e))) < threshold * math.log2(len(texts) / len(e)):
                continue
            for i in te:
                want[i] |= {(m.start(), m.end()) for m in re.finditer(private_data.WORDS, texts[i]) if fold(m[0]) == t and not any(s < m.end() and m.start() < e_ for s, e_, _ in base[i])}
    return want


def test_terms_at_the_threshold(spark):
    """With 1,024 texts and an entity in one, slack is exactly 2: a word of two texts discloses, one of three does not."""
    data = [(i, f"filler{i} common words", "s") for i in range(1021)] + [(2000, "alpha beta a1@b.com", "s"), (2001, "alpha beta", "s"), (2002, "beta", "s")]
    got = {x.doc_id: x for x in private_data.find_private(docs(spark, data)).collect()}
    assert [(y.s, y.e) for y in got[2000].terms] == [(0, 5)] and not got[2001].terms and not got[5].terms


def test_mixing(spark):
    r = random.Random(6)
    data = [(i, " ".join("w" * r.choice([0, 1, 3, 40])), r.choice("aaaaab") if i % 9 else None) for i in range(400)] + EDGE[:2]
    out = mixing.mix(docs(spark, data)).collect()
    assert len(out) == len(data) and all(x.taken <= 2 * x.size for x in out)
    names = sorted({x.source for x in out} - {None}) + [None]
    size = {s: sum(x.size for x in out if x.source == s) for s in names}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        target = {s: 2 * size[s] if s in full else left * weight[s] / sum(weight[u] for u in names if u not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for s in names:
        assert {round(x.target, 6) for x in out if x.source == s} == {round(target[s], 6)}
        assert abs(sum(x.taken for x in out if x.source == s) - target[s]) <= 0.5
    for x in out:
        parts = x.parts or []
        assert sum(y.words for y in parts) == x.taken and x.slots >= len(parts) and (x.first_slot is None) == (x.taken == 0)
        assert x.taken == 0 or x.first_slot == min(y.slot for y in parts) or x.slots > len(parts)
    assert {x.doc_id for x in out if x.taken} <= {x.doc_id for x in out if x.size}
    again = mixing.mix(docs(spark, data[::-1]))
    assert rows(again, "doc_id", "taken") == sorted(((x.doc_id, x.taken) for x in out), key=repr)
    assert mixing.mix(docs(spark, [])).count() == 0


def test_mixing_of_rows_without_an_id_and_of_repeats(spark):
    data = [(None, f"w{k} " * (k % 5), "a") for k in range(60)] + [(1, "one two three", "a")] * 40 + [(2, "x " * 50_000, "b"), (3, None, None)]
    out = mixing.mix(docs(spark, data), per_chunk=4).collect()
    assert len(out) == len(data)
    by = {}
    for x in out:
        by.setdefault(x.source, []).append(x)
    for s, found in by.items():
        assert abs(sum(x.taken for x in found) - found[0].target) <= 0.5 and all(x.taken <= 2 * x.size for x in found)
    again = mixing.mix(docs(spark, data[::-1]), per_chunk=4).collect()
    key = lambda rs: sorted((repr(x.doc_id), x.text_md5, x.taken, x.first_slot or 0) for x in rs)
    assert key(again) == key(out)


def test_a_small_mix_is_dealt_as_finely_as_a_large_one(spark):
    """Blocks of 512 words whatever the corpus left 1,000 documents about a thousand slots; at least 65,536 are dealt, a word each if there are fewer words."""
    data = [(i, "w " * (i % 9), "abc"[i % 3]) for i in range(300)]
    out = mixing.mix(docs(spark, data)).collect()
    assert all(x.slots == x.taken for x in out) and sum(x.slots for x in out) > 1000
    total = sum(x.taken for x in out)
    for least, block in ((100, total // 100), (1, 512)):
        parts = mixing.mix(docs(spark, data), least_slots=least).collect()
        assert [sum(x.taken for x in parts if x.source == s) for s in "abc"] == [sum(x.taken for x in out if x.source == s) for s in "abc"]
        held = {(x.source, y.slot) for x in parts for y in x.parts or []}
        assert max(x.slots for x in parts) <= 4 and len(held) <= total // block + 3


def test_schedule_is_even(spark):
    """Every stretch of the mix holds each source in proportion to its target, within the discrepancy of van der Corput points."""
    quota = [500, 3, 120, 0, 977]
    sources = spark.createDataFrame([(k, q) for k, q in enumerate(quota)], "no int, quota long")
    got = sorted(rows(mixing.schedule(sources, 1), "slot", "no", "rank"))
    assert [sum(1 for x in got if x[1] == k) for k in range(5)] == quota and len({x[0] for x in got}) == sum(quota)
    bound = math.log2(sum(quota)) + 2
    count, total = [0] * 5, sum(quota)
    size = 1 << (total - 1).bit_length()
    for slot, no, rank in got:
        assert rank == count[no]
        count[no] += 1
        # slots are points of [0, size); those without a source fall away
        for k, q in enumerate(quota):
            assert abs(count[k] - q * (slot + 1) / size) <= bound


def test_quality(spark):
    r = random.Random(7)
    good = lambda: " ".join(r.choice(["the", "house", "stands", "near", "a", "river", "and", "trees"]) for _ in range(60)) + "."
    bad = lambda: " ".join(r.choice(["$$$", "###", "CLICK", "!!!", "%%%"]) for _ in range(60))
    data = [(i, bad() if i % 5 == 0 else good(), "s") for i in range(400)] + [(1000, None, "s"), (1001, "", "s")]
    d = docs(spark, data)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 400, 3)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    drawn = quality.resample(d, labels)
    kept = {x.doc_id for x in drawn.collect()}
    assert len([i for i in range(400) if i % 5 and i not in kept]) <= 4
    assert not any(i in kept for i in range(0, 400, 5))
    # Gumbel top-k against its definition
    scores = {x.rid: x for x in quality.resample(d, labels, k=10**6).collect()}
    best = sorted(scores.values(), key=lambda x: (-x.score, x.doc_id, x.rid))[:37]
    assert {x.rid for x in quality.resample(d, labels, k=37).collect()} == {x.rid for x in best}
    counts = lambda ts: sum(quality.ngram_counts(t) for t in ts)
    w = quality._log_model(counts(t for i, t, _ in data if i % 3 == 0 and i % 5 and i < 400).astype(float), quality.BUCKETS) - quality._log_model(counts(t for _, t, _ in data).astype(float), quality.BUCKETS)
    for x in list(scores.values())[::40]:
        c = quality.ngram_counts(dict((i, t) for i, t, _ in data)[x.doc_id])
        assert x.log_weight == pytest.approx(float(c @ w) * min(1, 100 / max(1, c.sum())))
    assert quality.resample(docs(spark, []), labels).count() == 0
    assert quality.resample(d, labels.limit(0)).count() == len(data)


def test_quality_draw(spark):
    """Ties, repeated rows, null ids and a very long text; every size of the draw against a plain sort; other seeds draw other rows."""
    r = random.Random(3)
    good = ["the house stands near a river and trees grow", "a river runs near the house and the trees"]
    data = [(i, " ".join(r.choice(good) for _ in range(r.randint(1, 4))), "s") for i in range(200)] + [(7, good[0], "s")] * 30 + [(None, good[1], "s")] * 20 + [(900, "the trees " * 300_000, "s"), (901, "$$$ ### " * 40, "s"), (902, None, "s")]
    d = docs(spark, data)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(901, 0, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    scored = quality.resample(d, labels, k=10**6).cache()
    order = sorted(scored.collect(), key=lambda x: (-x.score, x.doc_id is None, x.doc_id or 0, x.rid))
    assert len(order) == len(data) and abs(next(x for x in order if x.doc_id == 900).log_weight) < 1000
    for k in (0, 1, 57, 120, 252):
        for few in (1, 10, 10_000):
            assert {x.rid for x in quality._keep_top(scored, k, bins=4, few=few).collect()} == {x.rid for x in order[:k]}
    assert {x.rid for x in quality.resample(d, labels, k=100).collect()} != {x.rid for x in quality.resample(d, labels, k=100, seed=6).collect()}


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(8)
    words = [f"word{i}" for i in range(300)]

    def text(toxic):
        w = [r.choice(words) for _ in range(50)]
        for _ in range(r.choice([1, 2, 3]) * toxic):
            w[r.randrange(50)] = r.choice(["Vile", "nasty", "awful"])
        return " ".join(w)

    flag = [int(r.random() < 0.2) for _ in range(900)]
    data = [(i, text(flag[i]), "s") for i in range(900)] + [(2000, None, "s"), (2001, "", "s")]
    labels = spark.createDataFrame([(i, 1, flag[i]) for i in range(600)] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, data)
    model = toxicity.train(d, labels)
    assert model["thresholds"] == sorted(model["thresholds"])
    got = {x.doc_id: x for x in toxicity.score(d, model).collect()}
    held = [got[i].toxic == bool(flag[i]) for i in range(600, 900)]
    assert np.mean(held) > 0.98 and not got[2000].toxic and got[2000].severity == got[2001].severity
    assert np.mean([got[i].severity for i in range(600, 900) if flag[i]]) > 10 * np.mean([got[i].severity for i in range(600, 900) if not flag[i]])
    assert not any(x.toxic for x in toxicity.score(d, toxicity.train(d, labels.limit(0))).collect())
    assert toxicity.score(docs(spark, []), model).count() == 0
    assert toxicity.train(docs(spark, []), labels)["words"] == []


def brute_telling(texts, flags, least_docs, least_z, most):
    found = []
    total, above = len(texts), sum(flags)
    sets = [set(re.findall(toxicity.WORD, low(t))) for t in texts]
    for w in set().union(*sets):
        n, t = sum(w in s for s in sets), sum(f for s, f in zip(sets, flags) if w in s)
        a, b, c, d = t + 0.5, n - t + 0.5, above - t + 0.5, total - above - (n - t) + 0.5
        z = (math.log(a / c) - math.log(b / d)) / math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
        if n >= least_docs and abs(z) >= least_z:
            found.append((-abs(z), w))
    return [w for _, w in sorted(found)[:most]]


def test_toxicity_against_a_plain_version(spark):
    """Graded labels of four grades, ids that repeat, nulls and long texts: features, sample, model and scores done again in plain Python."""
    r = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    data = []
    for i in range(300):
        g = r.choice([0, 0, 0, 1, 2, 3])
        data.append((i, " ".join(r.choices(words, k=25) + r.choices(["Vile", "nasty", "awful"], k=g)), g))
    d = docs(spark, [(i, t, "s") for i, t, _ in data] + [(3, "a different and earlier text", "s"), (3, data[3][1], "s"), (400, None, "s"), (401, "", "s"), (402, "vile " * 60_000, "s")])
    labels = spark.createDataFrame([(i, g) for i, _, g in data] + [(9, 0), (None, 1), (10, None), (401, 0), (402, 3)], "doc_id long, severity int")
    model = toxicity.train(d, labels, least_z=1.5, most_features=40, grade="severity")
    known = {i: t for i, t, _ in data} | {401: "", 402: "vile"}
    known[3] = min("a different and earlier text", data[3][1])
    grades = {i: g for i, _, g in data} | {401: 0, 402: 3}
    ids = sorted(known)
    names = brute_telling([known[i] for i in ids], [int(grades[i] > 0) for i in ids], 3, 1.5, 40)
    assert model["words"] == names
    at = {w: k for k, w in enumerate(names)}
    features = [[at[w] for w in set(re.findall(toxicity.WORD, low(known[i]))) if w in at] for i in ids]
    w, theta = toxicity.fit(features, np.array([grades[i] for i in ids]), len(names), 3)
    assert np.allclose(model["weights"], w, atol=1e-4) and np.allclose(model["thresholds"], theta, atol=1e-4)
    for x in toxicity.score(d, model).collect():
        t = "" if x.doc_id == 400 else "vile" if x.doc_id == 402 else known[x.doc_id]
        options = [t, data[3][1]] if x.doc_id == 3 else [t]
        p = [[1 / (1 + math.exp(b - sum(model["weights"][at[v]] for v in set(re.findall(toxicity.WORD, low(o))) if v in at))) for b in model["thresholds"]] for o in options]
        assert any(abs(x.severity - sum(q)) < 1e-5 and x.toxic == (q[0] >= 0.5) for q in p)


def test_toxicity_of_confirmed_grades_against_a_plain_version(spark):
    """The registered query's own way: toxic rows graded by the model of the other half of the labels, then one model of all, done again in plain Python."""
    r = random.Random(21)
    words = [f"w{i}" for i in range(60)]
    flag = {i: int(r.random() < 0.4) for i in range(400)}
    texts = {i: " ".join(r.choices(words, k=25) + r.choices(["Vile", "nasty", "awful"], k=r.choice([0, 1, 3]) if f else 0)) for i, f in flag.items()}
    d = docs(spark, [(i, t, "s") for i, t in texts.items()])
    model = toxicity.train(d, spark.createDataFrame([(i, 1, f) for i, f in flag.items()], "doc_id long, quality int, toxic int"), least_z=1.5, most_features=40)
    fold = {x.doc_id: x.fold for x in d.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).alias("fold")).collect()}
    sets = {i: set(re.findall(toxicity.WORD, low(t))) for i, t in texts.items()}

    def fitted(ids, grades, top):
        names = brute_telling([texts[i] for i in ids], [flag[i] for i in ids], 3, 1.5, 40)
        at = {w: k for k, w in enumerate(names)}
        w, theta = toxicity.fit([[at[v] for v in sets[i] if v in at] for i in ids], np.array([grades[i] for i in ids]), len(names), top)
        return names, dict(zip(names, w)), theta

    halves = {k: fitted([i for i in sorted(texts) if fold[i] == k], flag, 1) for k in (0, 1)}
    grades = {}
    for i, f in flag.items():
        _, w, theta = halves[1 - fold[i]]
        grades[i] = f and 1 + int(1 / (1 + math.exp(theta[0] - sum(w.get(v, 0.0) for v in sets[i]))) >= 0.5)
    names, w, theta = fitted(sorted(texts), grades, 2)
    assert set(grades.values()) == {0, 1, 2} and model["words"] == names
    assert np.allclose(model["weights"], [w[v] for v in names], atol=1e-3) and np.allclose(model["thresholds"], theta, atol=1e-3)
    for x in toxicity.score(d, model).collect():
        p = [1 / (1 + math.exp(b - sum(w.get(v, 0.0) for v in sets[x.doc_id]))) for b in theta]
        assert abs(x.severity - sum(p)) < 1e-2


def test_toxicity_of_labels_of_one_class(spark):
    d = docs(spark, [(i, f"word{i} text", "s") for i in range(40)])
    labels = lambda flag: spark.createDataFrame([(i, 1, flag) for i in range(20)], "doc_id long, quality int, toxic int")
    assert all(x.toxic and x.severity > 0.9 for x in toxicity.score(d, toxicity.train(d, labels(1))).collect())
    assert not any(x.toxic for x in toxicity.score(d, toxicity.train(d, labels(0))).collect())


def test_ordinal_gradient():
    x = [[0], [0, 1], [1], [2], [0, 2], [1, 2], [2], []]
    y = np.array([0, 1, 0, 2, 2, 1, 2, 0])
    w, theta = toxicity.fit(x, y, 3, l2=0.5, rounds=3000)

    def loss(w, theta):
        s = np.array([sum(w[f] for f in r) for r in x])
        above = np.concatenate([np.ones((8, 1)), 1 / (1 + np.exp(theta[None, :] - s[:, None])), np.zeros((8, 1))], axis=1)
        return -np.log(above[np.arange(8), y] - above[np.arange(8), y + 1]).sum() + 0.25 * (w**2).sum()

    best = loss(w, theta)
    for k in range(3):
        for e in (-0.05, 0.05):
            v = w.copy()
            v[k] += e
            assert loss(v, theta) > best
    assert theta[0] < theta[1] and loss(w, theta + 0.05) > best


def test_license_words_are_counted_over_all_rows(spark):
    rows = [(i, "common") for i in range(3000)] + [(3000 + i, "common rare rare") for i in range(7)] + [(4000, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert license_scan._counts(d, F.array(F.lit("common"), F.lit("rare"))) == {"common": 3007, "rare": 7}
