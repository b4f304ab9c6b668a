"""The forward algorithm against all segmentations, and predictions."""

import base64
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixloom.llm import langid
from mixloom.llm.common import tokenizer_path

PIECES = [bytes([b]) for b in range(256)] + [b"th", b"he", b"the", b" t", b"ab", b"aba"]


def segmentations(word):
    """All ways to cut a word into known pieces."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in PIECES:
            for rest in segmentations(word[n:]):
                yield [word[:n], *rest]


def test_forward_and_counts_equal_all_segmentations():
    segmenter = langid.Segmenter(PIECES)
    rnd = np.random.default_rng(0)
    chance = rnd.random((len(PIECES), 2))
    chance /= chance.sum(axis=0)
    words = [b"the", b"abab", b" the", b"x", b"thabaheab"]
    logs = segmenter.log_chance(words, np.vstack([chance, np.zeros(2)]))
    counts = segmenter.expected_counts(words, np.ones(len(words)), np.append(chance[:, 0], 0.0))
    want = np.zeros(len(PIECES))
    for word, row in zip(words, logs):
        ways = [[PIECES.index(p) for p in cut] for cut in segmentations(word)]
        each = np.array([[np.prod(chance[w, lang]) for lang in (0, 1)] for w in ways])
        assert np.allclose(row, np.log(each.sum(axis=0)))
        for way, share in zip(ways, each[:, 0] / each[:, 0].sum()):
            for piece in way:
                want[piece] += share
    assert np.allclose(counts, want)


def test_vocabulary_covers_every_byte():
    pieces = langid.read_pieces(tokenizer_path(langid.VOCABULARY))
    assert {bytes([b]) for b in range(256)} <= set(pieces) and max(map(len, pieces)) <= langid.PIECE_BYTES


def test_languages(spark):
    texts = {"en": "the house of the king and the other one", "de": "das haus der könig und ein anderer schön",
             "fr": "la maison du roi et les autres étés là"}
    rows = [(i, t + f" {i}", lang if i % 5 else None, "s") for i, (lang, t) in enumerate(itertools.chain(*[texts.items()] * 12))]
    rows += [(900, None, "en", "s"), (901, "", None, "s"), (902, "12 %% ..", "de", "s"), (905, "½ ² ³ Ⅷ ٣", "de", "s"), (None, "the king", "en", "s"),
             (903, "wort" * 5000, "de", "s"), (904, "the other house " * 3000, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    languages, chance = langid.train(docs, F.lit(True))
    assert languages == ["de", "en", "fr"] and np.allclose(chance.sum(axis=0), 1)
    predicted = langid.predict_language(docs, languages, chance)
    assert predicted.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    for r in predicted.collect():
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (900, 901, 902, 905):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["lang"] and r["doc_id"] != 903:
            assert r["lang_pred"] == r["lang"]
    nothing, empty = langid.train(docs.filter("lang is null"), F.lit(True))
    assert nothing == []
    assert {r["lang_pred"] for r in langid.predict_language(docs, nothing, empty).collect()} == {"und"}
    assert langid.predict_language(docs.limit(0), languages, chance).collect() == []


def test_forgetting_changes_nothing(monkeypatch):
    pieces = langid.read_pieces(tokenizer_path(langid.VOCABULARY))
    rnd = np.random.default_rng(1)
    chance = np.vstack([rnd.random((len(pieces), 2)) / len(pieces), np.zeros(2)])
    texts = [f"word{i} other{i % 7} end" for i in range(600)]
    want = langid.Scorer(pieces, ["a", "b"], chance).predict(texts)
    monkeypatch.setattr(langid, "REMEMBERED", 50)
    assert langid.Scorer(pieces, ["a", "b"], chance).predict(texts) == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    languages, chance = langid.train(docs, ~langid.held_out())
    tested = langid.predict_language(docs, languages, chance).filter(langid.held_out())
    assert tested.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95


def test_every_piece_of_the_vocabulary_is_used():
    path = tokenizer_path(langid.VOCABULARY)
    with open(path, "rb") as file:
        whole = {base64.b64decode(line.split()[0]) for line in file if line.strip()}
    assert whole <= set(langid.read_pieces(path)) and max(map(len, whole)) == langid.PIECE_BYTES


def test_long_words_are_summed_whole():
    """Words of several stretches, and pieces across their bounds, against the plain recurrence."""
    pieces = PIECES + [b"ab" * 8, b"ba" * 16 + b"b"]
    rnd = np.random.default_rng(2)
    chance = rnd.random((len(pieces), 2))
    chance /= chance.sum(axis=0)
    words = [b"ab" * 60, b"xab" * 11, b" the" * 500, b"ba" * 300, b"a", bytes(range(256)), b"the" * 16]
    segmenter = langid.Segmenter(pieces)
    logs = segmenter.log_chance(words, np.vstack([chance, np.zeros(2)]))
    want = np.array([[plain_log_sum(word, pieces, chance[:, lang]) for lang in (0, 1)] for word in words])
    assert np.allclose(logs, want, rtol=1e-10)
    # Each byte of a word lies in one piece of any segmentation.
    weights = np.arange(1.0, len(words) + 1)
    counts = segmenter.expected_counts(words, weights, np.append(chance[:, 0], 0.0))
    assert np.isclose(counts @ [len(p) for p in pieces], weights @ [len(w) for w in words])
    assert langid._as_bytes("\u0e01" * 100) == (" " + "\u0e01" * 100).encode()


def plain_log_sum(word, pieces, chance):
    known, sums = dict(zip(pieces, np.log(chance))), [0.0]
    for t in range(1, len(word) + 1):
        cuts = [n for n in range(1, t + 1) if word[t - n : t] in known]
        sums.append(np.logaddexp.reduce([sums[t - n] + known[word[t - n : t]] for n in cuts]))
    return sums[-1]
