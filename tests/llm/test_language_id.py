import math

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tandem.llm import language_id as L

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def brute_force(word, pieces, p):
    """Sum over all segmentations, by recursion."""
    marked = "▁" + word

    def total(i):
        if i == len(marked):
            return 1.0
        found = 0.0
        for j in range(i + 1, len(marked) + 1):
            if marked[i:j] in pieces:
                found += p[pieces[marked[i:j]]] * total(j)
            elif j == i + 1:
                found += p[-1] * total(j)
        return found

    return math.log(total(0))


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁t", "▁th", "t", "h", "e", "he", "the", "er", "r", "é"])
    rng = np.random.default_rng(2)
    p = rng.random((len(pieces) + 1, 3)) / 20
    words = ["the", "there", "x", "thé", "hhhh", "etherxe", "t"]
    got = L.Lattice(pieces).log_probabilities(words, p)
    for w, row in zip(words, got):
        for k in range(3):
            assert row[k] == pytest.approx(brute_force(w, {x: i for i, x in enumerate(pieces)}, p[:, k]))


def summed(word, pieces, p):
    """The same by one sum per end, in logarithms."""
    marked, logs = "▁" + word, [0.0]
    longest = max(map(len, pieces))
    for end in range(1, len(marked) + 1):
        ways = [logs[i] + math.log(p[pieces.get(marked[i:end], -1)]) for i in range(max(0, end - longest), end) if marked[i:end] in pieces or i == end - 1]
        logs.append(max(ways) + math.log(sum(math.exp(x - max(ways)) for x in ways)))
    return logs[-1]


def test_long_runs_sum_all_segmentations():
    pieces = sorted(["▁", "▁t", "▁th", "t", "h", "e", "he", "the", "er", "r", "é", "therethe"])
    p = np.random.default_rng(6).random((len(pieces) + 1, 3)) / 20
    p[-1] = 1e-7
    words = ["there" * n + "x" * (n % 3) for n in (12, 13, 40, 1_000)] + ["t" * n for n in (62, 63, 64, 65, 95, 96, 97)] + ["日本" * 300, "the"]
    got = L.Lattice(pieces).log_probabilities(words, p)
    for w, row in zip(words, got):
        for k in range(3):
            assert row[k] == pytest.approx(summed(w, {x: i for i, x in enumerate(pieces)}, p[:, k]), rel=1e-9), w[:20]


def test_long_runs_are_fitted_like_short_ones(monkeypatch):
    pieces = sorted(["▁", "▁t", "▁th", "t", "h", "e", "he", "the", "er", "r", "é", "therethe"])
    p = np.random.default_rng(7).random((len(pieces) + 1, 2)) / 10
    words, counts = ["there" * n + "xé" * (n % 2) for n in range(1, 30)], np.random.default_rng(8).integers(0, 3, (29, 2)).astype(float)
    monkeypatch.setattr(L, "SCALE", 5.0)
    monkeypatch.setattr(L, "WORD_CHARS", 10_000)
    want = L.Lattice(pieces).expected(words, counts, p)
    monkeypatch.setattr(L, "WORD_CHARS", 3)
    assert L.Lattice(pieces).expected(words, counts, p) == pytest.approx(want)


def segmentations(marked, pieces):
    """All ways to cut a word into pieces or single unknown characters (number -1)."""
    if not marked:
        return [[]]
    return [[pieces.get(marked[:j], -1), *rest] for j in range(1, len(marked) + 1) if marked[:j] in pieces or j == 1 for rest in segmentations(marked[j:], pieces)]


def test_expected_uses_equal_brute_force():
    """One step of the fit: every piece is used as often as the segmentations that hold it are likely."""
    pieces = sorted(["▁", "▁t", "▁th", "t", "h", "e", "he", "the", "er", "r", "é"])
    number, rng = {x: i for i, x in enumerate(pieces)}, np.random.default_rng(4)
    p = rng.random((len(pieces) + 1, 2)) / 10
    words, counts = ["the", "there", "thxé", "here"], np.array([[1.0, 3.0], [2.0, 0.0], [5.0, 1.0], [1.0, 1.0]])
    want = np.zeros_like(p)
    for w, own in zip(words, counts):
        ways = segmentations("▁" + w, number)
        likely = np.array([[np.prod(p[way, k]) for k in range(2)] for way in ways])
        for way, share in zip(ways, likely / likely.sum(0)):
            for piece in way:
                want[piece] += own * share
    assert L.Lattice(pieces).expected(words, counts, p) == pytest.approx(want)


def test_posterior_equals_brute_force(spark, model):
    text = "The house, und Hund"
    rows = np.array([[brute_force(w, {x: i for i, x in enumerate(model[0].pieces)}, model[0].p[:, k]) for k in range(2)] for w in ("the", "house", "und", "hund")])
    z = rows.sum(0) / 2  # the root of four words
    want = np.exp(z) / np.exp(z).sum()
    got = L.predict_documents(spark.createDataFrame([(text,)], "text string"), model).first().language
    assert got.lang == ["de", "en"][int(want.argmax())] and got.score == pytest.approx(want.max())


def test_languages_in_several_models(spark, model, monkeypatch):
    monkeypatch.setattr(L, "LANGUAGES_TOGETHER", 1)
    rows = [(i, "the cat and the dog of the house this is", "en") for i in range(30)] + [(100 + i, "der hund und die katze in dem haus ist", "de") for i in range(30)]
    apart = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True), VOCABULARY)
    assert [m.languages for m in apart] == [["de"], ["en"]]
    texts = spark.createDataFrame([("the house",), ("und die katze",), ("",), ("xqz the",)], "text string")
    one, two = (sorted((r.text, r.language.lang, round(r.language.score, 9)) for r in L.predict_documents(texts, m).collect()) for m in (model, apart))
    assert one == two


def test_vocabulary_lookup_is_exact():
    pieces = L.pieces_of(VOCABULARY)
    lattice = L.Lattice(pieces)
    assert len(pieces) > 10_000
    assert (lattice._find(lattice.keys) == np.arange(len(pieces))).all()


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "the cat and the dog of the house this is", "en") for i in range(30)] + [(100 + i, "der hund und die katze in dem haus ist", "de") for i in range(30)]
    docs = spark.createDataFrame(rows + [(None, "the", "xx"), (7, None, None), (9, None, "en")], "doc_id long, text string, lang string")
    return L.train(docs, F.lit(True), VOCABULARY)


def test_hard_rows(spark, model):
    assert [m.languages for m in model] == [["de", "en"]]
    rows = [(1, "the house", 1), (2, "UND DIE KATZE!", 1), (3, None, 1), (4, "", 1), (5, "12 $$ 3_", None), (8, "² ½ Ⅷ", None), (9, "x²the½dog", 1), (6, "the" * 50_000, 1), (None, "the dog", 1), (1, "the house", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang int")
    got = L.predict_documents(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "language"]
    found = {r.text: (r.language.lang, r.language.score) for r in got.collect()}
    assert got.count() == 10
    assert found["the house"][0] == found["the dog"][0] == "en" and found["UND DIE KATZE!"][0] == "de"
    lang, score = found["the" * 50_000]
    number = {x: i for i, x in enumerate(model[0].pieces)}
    de, en = (summed("the" * 50_000, number, model[0].p[:, k]) / math.sqrt(-(-150_000 // L.WORD_CHARS)) for k in range(2))
    assert lang == "en" and score == pytest.approx(1 / (1 + math.exp(de - en)))
    assert found[None] == found[""] == found["12 $$ 3_"] == found["² ½ Ⅷ"] == ("und", 0.0)
    assert L.letters("x²the½dog Ⅷ é") == ["x", "the", "dog", "é"]
    assert L.predict_documents(docs.limit(0), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "the", None)], "doc_id long, text string, lang string")
    got = L.predict_documents(docs, L.train(docs, F.lit(True), VOCABULARY)).collect()
    assert got[0].language.lang == "und"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    r = L.op6_segmentation_marginalised_language(spark, sf).join(docs, "doc_id").filter("held_out and lang is not null").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.97
    assert r.score.between(0, 1).all()
