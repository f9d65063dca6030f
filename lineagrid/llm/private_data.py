"""Personal data: patterns, and information-theoretic sanitisation of what gives the found entities away.

Base spans come from four patterns. Beyond them, corpus co-occurrence tells how far a word discloses a protected entity e (one
kind and value): with N documents, PMI(t; e) = log2(N * n_te / (n_t * n_e)) sets the documents that hold both t and e, anywhere,
against those that hold each at all, and IC(e) = log2(N / n_e) is all the information there is about e. A word whose PMI reaches
``threshold`` * IC(e), held with e by ``support`` different texts at least, is a disclosing term: who looks it up finds little but the
documents of e. All its places in every document that holds e become spans of kind ``term``, but for those inside base spans. All
counts cover all documents. ``sanitise`` generalises spans to the name of their kind.

Places are found by cutting the text at a pattern's matches and adding up lengths, in code points. Everything is built-in
expressions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import among, ascii_lower, land, let, table

KINDS = ["email", "ip", "card", "phone", "term"]
#: The contract's patterns. Possessive quantifiers and the look-behinds only keep long runs from being tried again and again
#: (\G: right after the match before).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text with a match passes.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][0-9 -][0-9 -]?[0-9]", "phone": r"\+[0-9]"}
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SPAN = "array<struct<s:int,e:int,m:string>>"
_CHUNK = 512


def matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern in a text, as an array of (start, end, match), in code points, end exclusive.

    Lengths are added up in chunks of 512 matches, then over the chunks, as an array that grows match by match is copied each time.
    """

    def chunk(pm: Column) -> Column:
        step = lambda acc, x: F.struct((acc.pos + F.length(x.p) + F.length(x.m)).alias("pos"), F.concat(acc.out, F.array(F.struct((acc.pos + F.length(x.p)).alias("s"), (acc.pos + F.length(x.p) + F.length(x.m)).alias("e"), x.m.alias("m")))).alias("out"))
        start = F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out"))
        return F.aggregate(F.zip_with(pm.p, pm.m, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), start, step)

    def join(chunks: Column) -> Column:
        step = lambda acc, c: F.struct((acc.base + c.pos).alias("base"), F.concat(acc.out, F.array(F.transform(c.out, lambda x: F.struct((x.s + acc.base).alias("s"), (x.e + acc.base).alias("e"), x.m.alias("m"))))).alias("out"))
        return F.flatten(F.aggregate(chunks, F.struct(F.lit(0).alias("base"), F.array().cast(f"array<{_SPAN}>").alias("out")), step).out)

    def of(v: Column) -> Column:
        n = F.size(v.m)
        chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _CHUNK).cast("int")), lambda c: chunk(F.struct(F.slice(v.p, c * _CHUNK + 1, F.least(F.lit(_CHUNK), n - c * _CHUNK)).alias("p"), F.slice(v.m, c * _CHUNK + 1, F.lit(_CHUNK)).alias("m"))))
        return F.when(n > 0, join(chunks)).otherwise(F.array().cast(_SPAN))

    return let(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), of)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    double = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 1, double(d)).otherwise(d)))
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    if kind == "card":
        return let(_digits(m), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans as an array of (start, kind number, end, value), by start, then kind."""

    def of(k: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda x: _valid(kind, x.m))
        found = F.transform(found, lambda x: F.struct(x.s.alias("s"), F.lit(k).alias("k"), x.e.alias("e"), x.m.alias("m")))
        return F.when(text.rlike(GUARDS[kind]), found).otherwise(F.array().cast("array<struct<s:int,k:int,e:int,m:string>>"))

    return F.array_sort(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS[:4]))))


def entity(k: Column, m: Column) -> Column:
    """The value that two spellings of one entity share: e-mail addresses in lower case, numbers without punctuation."""
    return F.concat(k.cast("string"), F.lit(":"), F.when(k == 0, ascii_lower(m)).when(k == 1, m).otherwise(_digits(m)))


def find_private(docs: DataFrame, threshold: float = 0.9, support: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, text_md5, ``base`` and ``terms`` as arrays of (start, kind number, end).

    A null or empty text has no spans. Repeated rows count as documents of their own, but equal texts count once towards
    ``support``. Entities held by the very same texts disclose the same and are counted as one, so a document with many of them costs no more
    than one with one. Terms are words of three characters at least that aren't digits alone. Other columns are ignored.
    """
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text"), F.md5(text).alias("text_md5"))
    spans = src.select("rid", "doc_id", "text_md5", let(F.struct(base_spans(F.col("text")).alias("base"), F.col("text").alias("text")), lambda v: F.struct(v.base.alias("base"), F.when(F.size(v.base) > 0, v.text).alias("text"))).alias("x"))
    spans = land(spans.select("rid", "doc_id", "text_md5", "x.base", "x.text"))

    total = F.lit(float(spans.count()))
    # equal texts are one, with the number of their rows; its id is the least of theirs
    rows = spans.filter(F.size("base") > 0).select("rid", "text_md5")
    texts = land(rows.groupBy("text_md5").agg(F.min("rid").alias("rid"), F.count("*").alias("n")))
    held = spans.join(texts.select("rid", "n"), "rid")
    each = held.select("rid", "n", F.explode(F.array_distinct(F.transform("base", lambda x: entity(x.k, x.m)))).alias("entity"))
    # an entity by the texts that hold it: their number, rows and two sums of their hashes
    holders = each.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts"), *(F.sum(F.xxhash64(F.lit(i), "rid").cast("decimal(38,0)")).alias(f"h{i}") for i in (0, 1)))
    holders = holders.filter((F.col("texts") >= support) & (F.col("n_e") < total)).select("entity", "n_e", F.md5(F.concat_ws(":", "n_e", "texts", "h0", "h1")).alias("group"))
    holds = land(each.join(holders, "entity").select("rid", "group", "n_e").distinct())
    # PMI >= threshold * IC solved for n_t: a word of more than n_te * slack documents discloses nothing, and n_te is at most n_e
    slack = F.pow(total / F.col("n_e"), F.lit(1.0 - threshold)) * (1 + 1e-9)
    bounds = holds.groupBy("rid").agg(F.max(F.col("n_e") * slack).alias("most"))
    words = F.filter(F.array_distinct(_words(F.col("text"))), lambda w: w.rlike("[^0-9]") & (F.length(w) >= 3))
    each = land(held.join(bounds, "rid").select("rid", "n", "most", F.explode(words).alias("term")))
    # a word stands in at least as many documents as hold it and an entity: what is too common even so needs no count
    wanted = land(each.groupBy("term").agg(F.sum("n").alias("n_held"), F.max("most").alias("most")).filter("n_held <= most").select("term"))
    everywhere = among(docs.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")), wanted, "term")
    counts = everywhere.groupBy("term").agg(F.count("*").alias("n_t"))
    rare = land(among(each, wanted, "term").join(counts, "term").filter("n_t <= most").select("rid", "n", "term", "n_t"))
    pairs = rare.join(holds, "rid")
    joint = pairs.groupBy("group", "term", "n_e", "n_t").agg(F.sum("n").alias("n_te"), F.count("*").alias("texts"))
    pmi = F.log2(total * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    known = joint.filter((F.col("texts") >= support) & (pmi >= threshold * F.log2(total / F.col("n_e")))).select("group", "term")
    marked = pairs.select("rid", "group", "term").join(known, ["group", "term"], "left_semi").groupBy("rid").agg(F.collect_set("term").alias("marked"))  # words of one text
    place = lambda w: F.struct(w.s.alias("s"), F.lit(4).alias("k"), w.e.alias("e"))
    free = lambda v, w: ~F.exists(v.base, lambda y: (y.s < w.e) & (w.s < y.e))
    places = lambda v: F.transform(F.filter(matches(v.text, WORDS), lambda w: F.array_contains(v.marked, ascii_lower(w.m)) & free(v, w)), place)
    terms = held.join(marked, "rid").select("rid", let(F.struct("text", "base", "marked"), places).alias("terms"))
    terms = rows.join(texts.select("text_md5", F.col("rid").alias("least")), "text_md5").join(terms.withColumnRenamed("rid", "least"), "least").select("rid", "terms")
    return spans.join(terms, "rid", "left").select("doc_id", "text_md5", "base", F.coalesce("terms", none).alias("terms"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORDS), F.lit(0))


def spans_text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.k), x.s.cast("string"), x.e.cast("string"))), ",")


def all_spans(base: Column, terms: Column) -> Column:
    return F.array_sort(F.concat(F.transform(base, lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"))), terms))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span replaced by [KIND]; spans that overlap become one, named by the first."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(acc: Column, x: Column) -> Column:
        new = F.struct(x.e.alias("at"), F.concat(acc.parts, F.array(F.substring(text, acc["at"] + 1, x.s - acc["at"]), F.get(kinds, x.k))).alias("parts"))
        return F.when(x.s >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], x.e).alias("at"), acc.parts.alias("parts")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    end = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc.parts, ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, end).otherwise(text)


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return found.select("doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(all_spans(F.col("base"), F.col("terms"))).alias("spans"))


QUERIES = {"op9_private_data": op9_private_data}


def _oracle(threshold: float = 0.9, support: int = 1) -> str:
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    # matches with their places: lengths of pieces and matches up to each, added up
    def places(table: str, pattern: str) -> str:
        parts = f"SELECT doc_id, string_split_regex(t, '{pattern}') AS ps, regexp_extract_all(t, '{pattern}') AS ms FROM {table}"
        each = f"SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ps[1:len(ms)]) AS p, unnest(ms) AS m FROM ({parts})"
        return f"SELECT doc_id, m, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS s FROM ({each})"

    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, s, m FROM ({places('d', p)})" for k, p in enumerate(patterns.values()))
    digit = "CAST(substr(reverse(g), i, 1) AS INTEGER)"
    luhn = f"list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0"
    valid = f"CASE k WHEN 0 THEN true WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda z: CAST(z AS HUGEINT) > 255)) = 0 WHEN 2 THEN length(g) BETWEEN 14 AND 19 AND {luhn} ELSE length(g) BETWEEN 10 AND 15 END"
    low = lambda x: f"lower(replace(replace({x}, '\u212a', '\u00ff'), '\u0130', '\u00ff'))"
    kinds = "['email', 'ip', 'card', 'phone', 'term']"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS g FROM ({found})),
b AS (SELECT doc_id, k, s, s + length(m) AS e, k || ':' || CASE k WHEN 0 THEN lower(m) WHEN 1 THEN m ELSE g END AS entity FROM f WHERE {valid}),
h AS (SELECT DISTINCT doc_id, entity FROM b),
o AS (SELECT * FROM d WHERE doc_id IN (SELECT doc_id FROM h)),
w AS (SELECT doc_id, s, s + length(m) AS e, {low('m')} AS term FROM ({places('o', WORDS)})),
v AS (SELECT DISTINCT doc_id, term FROM w WHERE regexp_matches(term, '[^0-9]') AND length(term) >= 3),
n AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM d),
ne AS (SELECT entity, count(*) AS n_e FROM h GROUP BY entity),
te AS (SELECT entity, term, count(*) AS n_te FROM h JOIN v USING (doc_id) JOIN d USING (doc_id) GROUP BY entity, term HAVING count(DISTINCT md5(t)) >= {support}),
u AS (SELECT term, count(*) AS n_t FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all({low('t')}, '{WORDS}'))) AS term FROM d) GROUP BY term),
q AS (SELECT entity, term FROM te JOIN ne USING (entity) JOIN u USING (term), n WHERE n_e < total AND log2(total * n_te / (n_t * n_e)) >= {threshold} * log2(total / n_e)),
x AS (SELECT DISTINCT doc_id, term FROM h JOIN q USING (entity) JOIN v USING (doc_id, term)),
a AS (SELECT doc_id, s, k, e FROM b UNION SELECT doc_id, s, 4, e FROM w JOIN x USING (doc_id, term) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e))
SELECT d.doc_id, count(CASE WHEN k = 0 THEN 1 END) AS n_email, count(CASE WHEN k = 1 THEN 1 END) AS n_ip, count(CASE WHEN k = 2 THEN 1 END) AS n_card, count(CASE WHEN k = 3 THEN 1 END) AS n_phone,
  sha256(coalesce(string_agg(CASE WHEN k < 4 THEN {kinds}[k + 1] || ':' || s || ':' || e END, ',' ORDER BY s, k), '')) AS base_sha256, coalesce(string_agg({kinds}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e), '') AS spans
FROM d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id
"""


ORACLES = {"op9_private_data": _oracle()}
