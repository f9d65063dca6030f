"""Each stage of the pipeline on the smallest tables against a brute-force version, and the whole run against the stages."""

import hashlib
import re

import numpy as np
import pytest
import sentencepiece as sp

import corpus_pipeline
from lineagrid.llm import mixing, quality
from lineagrid.llm.sentencepiece_codec import model_path

from .test_operators import brute_components, brute_spans, brute_terms

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        before = docs
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(spark, staged):
    want = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    for _, after in staged[:-1]:
        assert after.dtypes == want


def test_quality_keeps_what_is_drawn(spark, staged):
    before, after = staged[0]
    drawn = {r.doc_id for r in quality.resample(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert texts(after) == {i: t for i, t in texts(before).items() if i in drawn}


def test_one_document_of_each_group_stays(staged):
    before, after = staged[1]
    comp = brute_components(sorted(texts(before).items()))
    assert set(texts(after)) == {i for i, c in comp.items() if i == c}


def test_private_data_is_replaced(staged):
    before, after = (texts(x) for x in staged[2])
    kinds = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]"]
    ids = sorted(before)
    terms = brute_terms([before[i] or "" for i in ids])
    changed = found = 0
    for i, more in zip(ids, terms):
        t, out, at = before[i], "", 0
        for s, k, e in sorted(brute_spans(t) + [(s, 4, e) for s, e in more]):
            if s >= at:
                out, at = out + t[at:s] + kinds[k], e
            else:
                at = max(at, e)
        out += t[at:]
        changed += out != t
        found += len(more)
        assert after[i] == out
    assert changed and found


def test_mix_repeats_and_drops(staged):
    """Each part of at least half a document stands once, in the order of its slot."""
    before, after = staged[3]
    parts = [(p.slot, x.doc_id) for x in mixing.mix(before).collect() for p in x.parts or [] if 2 * p.words >= x.size]
    assert [x.doc_id for x in after.collect()] == [i for _, i in sorted(parts)]
    assert len({i for _, i in parts}) < before.count() < len(parts)


def test_encoding(staged):
    before, after = staged[4]
    lib = sp.SentencePieceProcessor(model_file=model_path())
    want = []
    for r in before.collect():
        ids = lib.encode(r.text, add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert sorted(want) == sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after.collect())


def test_run_is_the_stages_in_a_row(spark, staged):
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(staged[-1][1])


def test_rows_without_an_id_and_repeats(spark):
    d = spark.createDataFrame([(None, "no id here a1@b.co", "en", "s", 3), (1, "same text of a few words here", "en", "s", 3), (1, "same text of a few words here", "en", "s", 3), (2, "same text of a few words here", "en", None, 3), (3, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.dedupe(spark, d, SF)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 1), (False, 3), (True, 0)]
    clean = corpus_pipeline.sanitised(spark, left, SF)
    assert not any(re.search("a1@b", r.text or "") for r in clean.collect()) and clean.count() == 3
    assert corpus_pipeline.mixed(spark, clean, SF).filter("text is null").count() == 0


def test_one_id_of_several_texts(spark):
    """What stands under one id is judged by its text: unlike texts stay, copies under another id or none go."""
    a, b = "one text of quite a few words that nobody else has", "another text which is not like the first one in any way"
    d = spark.createDataFrame([(1, a, "en", "s", 1), (1, b, "en", "s", 1), (1, a, "de", "s", 1), (2, a, "en", "s", 1), (None, b, "en", "s", 1), (None, b, "en", "t", 1), (None, None, "en", "s", 1), (3, "", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.dedupe(spark, d, SF).collect()
    assert sorted(r.text or "" for r in left) == ["", "", b, a]
    assert [(r.doc_id, r.lang) for r in left if r.text == a] == [(2, "en")]
    assert corpus_pipeline.dedupe(spark, d.filter("doc_id = 1"), SF).count() == 2


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, rid long, sig long, size long, key string, r int, text_md5 string"


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_nothing_and_on_odd_rows(spark, name):
    """An empty table, clashing extra columns, nulls, empty texts and repeated rows."""
    stage = dict(corpus_pipeline.STAGES)[name]
    odd = [(1, "a few words of a text here", "en", "s"), (1, "a few words of a text here", "en", "s"), (2, None, None, None), (3, "", "en", "s"), (None, "another text without an id a1@b.co", "en", "s"), (4, "x " * 40_000, "de", "t")]
    df = spark.createDataFrame([(i, t, lang, s, 1, 7, 7, 7, "k", 7, "m") for i, t, lang, s in odd], CLASHING)
    assert stage(spark, df.limit(0), SF).count() == 0
    out = stage(spark, df, SF)
    if name != "sentencepiece":
        assert out.columns == corpus_pipeline.COLUMNS
    want = {"quality": None, "near_duplicates": 5, "private_data": 6, "mixing": None, "sentencepiece": 6}[name]
    n = out.count()
    assert n == want if want else n > 0
    if name == "quality":  # rows stay or go as they are, repeated ones together
        kept = [(r.doc_id, r.text) for r in out.collect()]
        assert set(kept) <= {(i, t) for i, t, _, _ in odd} and kept.count((1, odd[0][1])) in (0, 2)
    if name == "mixing":  # nothing is taken of texts without words, and no more than twice of any other
        kept = [(r.doc_id, r.text) for r in out.collect()]
        assert {i for i, _ in kept} <= {1, 4, None} and all(t for _, t in kept) and kept.count((4, odd[5][1])) <= 2
