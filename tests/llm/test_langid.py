import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from maskweave.llm import langid
from maskweave.llm.common import fold, held_out, read
from tests.llm.conftest import AWKWARD, SAMPLE, needs_data

PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "é", "aba"]


def plain_sum(word, prob, langs):
    """Sum over every segmentation, one by one."""
    text = langid.WORD_MARK + word

    def rest(at):
        if at == len(text):
            return np.ones(langs)
        total = np.zeros(langs)
        for stop in range(at + 1, len(text) + 1):
            p = np.zeros(langs)
            if text[at:stop] in PIECES:
                p = p + prob[PIECES.index(text[at:stop])]
            if stop == at + 1:
                p = p + langid.UNKNOWN
            if p.any():
                total = total + p * rest(stop)
        return total

    return rest(0)


def model_of(seed, langs=3):
    prob = np.random.default_rng(seed).random((len(PIECES), langs))
    return prob / prob.sum(axis=0)


def test_forward_sums_every_segmentation():
    prob = model_of(1)
    words = ["a", "b", "abab", "babaab", "é", "xyz", "aébaab", "abababababab"]
    got = langid.log_forward(langid.Pieces(PIECES), prob, words)
    for w, row in zip(words, got):
        assert np.allclose(row, np.log(plain_sum(w, prob, 3)))


def test_long_words_do_not_vanish():
    prob = model_of(2)
    got = langid.log_forward(langid.Pieces(PIECES), prob, ["ab" * 3000, "x" * 2000])
    assert np.isfinite(got).all()
    one = langid.log_forward(langid.Pieces(PIECES), prob, ["ab" * 12])[0]
    two = langid.log_forward(langid.Pieces(PIECES), prob, ["ab" * 24])[0]
    assert (two < one).all()
    assert np.ptp(got[1]) < 5  # unknown characters tell nothing; only the word mark does


def test_expected_counts_against_enumeration():
    prob = model_of(3, 2)
    words, langs, weights = ["abab", "ba", "aé"], np.array([0, 1, 0]), np.array([2.0, 3.0, 1.0])
    got = langid.expected_counts(langid.Pieces(PIECES), prob, words, langs, weights)
    want = np.zeros_like(prob)
    for w, lang, n in zip(words, langs, weights):
        text, ways = langid.WORD_MARK + w, []

        def walk(at, used, p):
            if at == len(text):
                ways.append((used, p))
                return
            for stop in range(at + 1, len(text) + 1):
                if text[at:stop] in PIECES:
                    k = PIECES.index(text[at:stop])
                    walk(stop, [*used, k], p * prob[k, lang])
                if stop == at + 1:
                    walk(stop, used, p * langid.UNKNOWN)

        walk(0, [], 1.0)
        total = sum(p for _, p in ways)
        for used, p in ways:
            for k in used:
                want[k, lang] += n * p / total
    assert np.allclose(got, want)


def test_awkward_rows(spark, awkward, nothing):
    pieces = langid.vocabulary_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model = langid.fit(langid.labelled_words(awkward, fold() != 1), pieces, rounds=2)
    sent = spark.sparkContext.broadcast(model)
    rows = langid.identify(awkward.withColumn("lang_found", F.lit("old")), sent).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        found = r["lang_found"]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (found["lang"], found["score"]) == ("und", 0.0)
        else:
            assert found["lang"] in model.langs and 0.0 <= found["score"] <= 1.0
    assert langid.identify(nothing, sent).collect() == []
    empty = langid.fit(langid.labelled_words(nothing, fold() != 1), pieces)
    none = langid.identify(awkward, spark.sparkContext.broadcast(empty))
    assert {r["lang_found"]["lang"] for r in none.collect()} == {"und"}


@needs_data
def test_held_out_accuracy(spark):
    from maskweave.llm.queries import op2_language_id

    docs = read(spark, SAMPLE, "documents").select("doc_id", "lang")
    got = op2_language_id(spark, SAMPLE)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    held = got.join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert got.count() == docs.count()


def test_fold_of_null(make_docs):
    docs = make_docs([(None, "a", "en", "s"), (5, "b", "en", "s")])
    assert {r["h"] for r in docs.where("doc_id IS NULL").select(held_out().alias("h")).collect()} == {False}
    assert docs.where(fold() != 1).where("doc_id IS NULL").count() == 0
    assert math.isclose(langid.UNKNOWN, 1e-7)
    assert pytest
