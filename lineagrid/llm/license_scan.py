"""License scan: exact set-similarity join of text blocks with license templates.

A template is found where some run of consecutive words, one and a half times as long as the template, across line breaks or not, holds at least ``threshold`` of
the template's distinct words. The join is exact: blocks of twice the longest run start every such run, so that each run lies whole in one; they are taken as sets cut to the words of the templates (no
other word can be common). Words are ordered by how many of a few rows hold them, rarest first, and a block and a template meet only
on a word of both prefixes (prefix filter); blocks with fewer common-vocabulary words than needed fall away (length filter),
and so do meetings too late in the order to reach the overlap (positional filter). What is left is verified, run by run.
Phrases of the base list are looked up as runs of consecutive words of the whole text.

Everything is built-in expressions; no Python runs on the executors.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, cut, let, table

#: Fixed values of the contract: phrase and label.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Default templates: label and wordings of common license lines and notices. A caller may give its own.
TEMPLATES: dict[str, str | list[str]] = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "copyright": "Copyright. All rights reserved",
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ],
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "This library is licensed under the GNU Lesser General Public License",
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "public-domain": "This is free and unencumbered software released into the public domain",
}


def words_of(text: str) -> list[str]:
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def wordings(templates: dict[str, str | list[str]]) -> list[tuple[str, list[str], list[str]]]:
    """(label, words, distinct words) of each wording that has words."""
    each = [(label, words_of(t)) for label, ts in templates.items() for t in ([ts] if isinstance(ts, str) else ts)]
    return [(label, w, sorted(set(w))) for label, w in each if w]


def run_length(words: list[str]) -> int:
    """Words of a text in which a template of these words is sought."""
    return len(words) * 3 // 2


def _needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def license_scan(docs: DataFrame, templates: dict[str, str | list[str]] | None = None, threshold: float = 0.9, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per row of docs, with the contract's columns and ``templates`` (label, first word and share of the best run of each block found).

    A null or empty text has no words: n_words 0, no places, empty labels, score 0. Repeated rows give repeated results; other
    columns are ignored. ``score`` is the largest share of a template's words in one run where that reaches the threshold,
    else 0. Counts over all rows show which words are rare; any order of the words gives the same result. Templates are a parameter, so the tables made from them are as small as that parameter.
    """
    spark, templates, phrases = docs.sparkSession, TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    sets = wordings(templates)
    vocabulary = sorted({w for _, _, v in sets for w in v})
    least = min((_needed(len(v), threshold) for _, _, v in sets), default=1)

    low = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", ascii_lower(F.col("text")).alias("low"))
    vocab = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    words = F.regexp_extract_all("low", F.lit(WORD), F.lit(0))
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    any_phrase = "|".join(gap.join(map(re.escape, words_of(p))) for p in phrases)

    def places(w: Column) -> Column:
        found = lambda p, label: F.transform(F.filter(_starts(w, words_of(p)), lambda at: at >= 0), lambda at: F.struct(at.alias("at"), F.lit(label).alias("label")))
        return F.concat(*(found(p, label) for p, label in phrases.items()))

    none = F.array().cast("array<struct<at:int,label:string>>")
    window = max((run_length(w) for _, w, _ in sets), default=1)
    counts = _counts(docs, vocab)
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    # a block that holds enough of a template holds one of the template's rarest words, in whatever order
    scouts = sorted({w for _, _, v in sets for w in sorted(v, key=rank.get)[: len(v) - _needed(len(v), threshold) + 1]})

    def blocks_of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(w) / window).cast("int") - 2))
        runs = F.transform(at, lambda k: F.struct((k * window).alias("at"), F.slice(w, k * window + 1, 2 * window).alias("w")))
        runs = F.filter(runs, lambda b: F.exists(b.w, lambda x: x.isin(scouts)))
        runs = F.transform(runs, lambda b: F.filter(F.transform(b.w, lambda x, i: F.struct((b["at"] + i).alias("at"), x.alias("w"))), lambda x: x.w.isin(vocabulary)))
        return F.filter(runs, lambda b: F.size(F.array_distinct(F.transform(b, lambda x: x.w))) >= least)

    blocks = blocks_of if sets else lambda w: F.array().cast("array<array<struct<at:int,w:string>>>")
    scanned = low.select("rid", "doc_id", let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), (F.when(F.col("low").rlike(any_phrase), places(w)).otherwise(none) if phrases else none).alias("base"), blocks(w).alias("blocks"))).alias("s"))
    scanned = cut(scanned.select("rid", "doc_id", "s.n_words", "s.base", "s.blocks"))

    blocks = scanned.select("rid", F.posexplode("blocks").alias("block", "b"))
    found = scanned.select("rid", F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("double").alias("share")).limit(0)
    if sets:
        rows = []
        for label, said, ws in sets:
            order, need = sorted(rank[w] for w in ws), _needed(len(ws), threshold)
            rows += [(label, r, i, len(order), need, run_length(said), order) for i, r in enumerate(order[: len(order) - need + 1])]
        prefixes = spark.createDataFrame(rows, "label string, r int, i int, size int, need int, run int, ranks array<int>")
        ranks = F.create_map(*(x for w, r in rank.items() for x in (F.lit(w), F.lit(r))))
        ordered = blocks.select("rid", "block", F.transform("b", lambda x: F.struct(x["at"].alias("at"), ranks[x.w].alias("r"))).alias("hits"))
        ordered = ordered.withColumn("own", F.array_sort(F.array_distinct(F.transform("hits", lambda x: x.r))))
        own = ordered.select("rid", "block", "hits", "own", F.size("own").alias("n"), F.posexplode(F.slice("own", F.lit(1), F.size("own") - least + 1)).alias("j", "r"))
        met = own.join(F.broadcast(prefixes), "r").filter("n >= need and j <= n - need and 1 + least(size - i - 1, n - j - 1) >= need")
        met = met.filter(F.size(F.array_intersect("own", "ranks")) >= F.col("need"))
        best = let(F.filter("hits", lambda x: F.array_contains("ranks", x.r)), lambda h: _best_run(h, F.col("run")))
        met = met.select("rid", "label", "need", "size", best.alias("best")).filter("best.o >= need")
        found = met.select("rid", "label", (-F.col("best.at")).alias("at"), (F.col("best.o") / F.col("size")).alias("share")).distinct()
    per_doc = found.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("label", "at", "share"))).alias("templates"), F.max("share").alias("best"))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda x: x.label)))
    starts = F.transform("base", lambda x: x["at"])
    nothing = F.array().cast("array<string>")
    return scanned.join(per_doc, "rid", "left").select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.coalesce(F.transform("templates", lambda t: t.label), nothing))), ",").alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"), "templates",
    )


def _counts(docs: DataFrame, vocab: Column) -> dict[str, int]:
    """How many rows hold each word of the templates."""
    words = F.array_intersect(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(WORD), F.lit(0)), vocab)
    return {r.w: r.n for r in docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}  # a row per word of the templates


def _best_run(hits: Column, window: Column) -> Column:
    """(o, -at): most distinct words in a run of ``window`` words that starts at a hit, and the first such start, negated."""
    inside = lambda x: F.filter(hits, lambda y: (y["at"] >= x["at"]) & (y["at"] < x["at"] + window))
    return F.array_max(F.transform(hits, lambda x: F.struct(F.size(F.array_distinct(F.transform(inside(x), lambda y: y.r))).alias("o"), (-x["at"]).alias("at"))))


def _starts(w: Column, phrase: list[str]) -> Column:
    """Indexes at which the words of the phrase stand one after another, -1 where not."""

    def at(word: Column, i: Column) -> Column:
        hit = word == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.get(w, i + k) == p, F.lit(False))
        return F.when(hit, i).otherwise(-1)

    return F.transform(w, at)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("templates")


def _oracle(threshold: float = 0.9) -> str:
    templates = ", ".join(f"({no}, '{label}', {len(v)}, {_needed(len(v), threshold)}, {run_length(w)}, [{', '.join(repr(x) for x in v)}])" for no, (label, w, v) in enumerate(wordings(TEMPLATES)))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hits = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS pos, '{label}' AS label FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {' AND '.join(f"w[i + {k}] = '{p}'" for k, p in enumerate(words_of(phrase)))}"
        for phrase, label in PHRASES.items()
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({lower}, '{WORD}') AS w FROM documents),
b AS (SELECT rid, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list(DISTINCT label) AS labels FROM ({hits}) GROUP BY rid),
t(no, label, size, need, run, words) AS (VALUES {templates}),
u AS (SELECT no, label, size, need, run, unnest(words) AS word FROM t),
p AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
h AS (SELECT rid, no, label, size, need, run, pos, word FROM p JOIN u USING (word)),
e AS (SELECT rid, no FROM h GROUP BY rid, no, need HAVING count(DISTINCT word) >= need),
g AS (SELECT h.* FROM h JOIN e USING (rid, no)),
r AS (SELECT x.rid, x.no, x.label, x.pos, count(DISTINCT y.word) / x.size AS share FROM g x JOIN g y ON y.rid = x.rid AND y.no = x.no AND y.pos >= x.pos AND y.pos < x.pos + x.run GROUP BY x.rid, x.no, x.label, x.pos, x.size, x.need HAVING count(DISTINCT y.word) >= x.need),
f AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS best FROM r GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.lo AS BIGINT) AS first_word, CAST(b.hi AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels, coalesce(f.best, 0.0) AS score
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES = {"op1_license_scan": _oracle()}
