import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tandem.llm import jaccard_join, language_id, toxicity
from tandem.llm._shared import Memo, written
from tests.llm.test_jaccard_join import brute_force

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").collect()}

    first = written(P.drop_toxic(spark, docs, SF), "test")
    assert first.columns == docs.columns
    ids = {r.doc_id for r in first.collect()}
    assert len(ids & toxic) < 0.2 * len(toxic) and clean <= ids

    second = written(P.keep_told_languages(spark, first, SF), "test")
    assert second.columns == docs.columns and second.count() >= 0.99 * first.count()

    third = written(P.one_of_each_group(spark, second, SF), "test")
    rows = [(r.doc_id, r.text) for r in second.collect()]
    want = {d for d, _, c in brute_force_fast(rows) if d == c}
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == want

    pieces = P.pack(spark, third, SF).toPandas()
    assert set(pieces.doc_id) == want
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    assert texts.keys() >= want


def brute_force_fast(rows):
    """Brute force within pairs that share a shingle at all."""
    from collections import defaultdict

    by, sets = defaultdict(list), {}
    for d, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ")
        w = [x for x in w if x]
        sets[d] = {tuple(w)} if w and len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for s in sets[d]:
            by[s].append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in {(a, b) for own in by.values() for a in own for b in own if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    return [(d, len(sets[d]), root(d)) for d in sets]


def test_a_text_without_letters_goes(spark):
    docs = spark.createDataFrame([(1, "the house of the dog", "en", "s", 1), (2, "123 $$", "en", "s", 1), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in P.keep_told_languages(spark, docs, SF).collect()] == [1]
    assert brute_force([(1, "a b c d e")], 5, 80) == [(1, 1, 1)] and language_id and jaccard_join


def test_run(spark):
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


#: Rows with nulls, empty and long texts, repeats, ids that clash, and columns that the stages use names of themselves.
HARD = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, language string, text_hash int, place string, node long, extra map<string,int>"
TEXT = "the house of the dog and the garden of the cat in the sun"


def hard(spark):
    rows = [(1, TEXT, "en"), (1, TEXT, "en"), (2, TEXT.upper(), "en"), (3, None, None), (None, TEXT, "en"), (None, None, None), (4, "", "en"), (5, "short", "en"), (5, "other short text here", "en"), (6, "le chat et la maison " * 5_000, "fr"), (7, "12 $$", None)]
    return spark.createDataFrame([(i, t, lang, "s", 1, "mine", "mine", 7, "mine", 8, {"k": 1}) for i, t, lang in rows], HARD)


def told(df):
    return sorted(((r.doc_id, r.text, r.toxicity, r.language, r.text_hash, r.place, r.node, r.extra["k"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES[:-1]])
def test_hard_rows_and_clashing_columns(spark, stage):
    docs = hard(spark)
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    every = told(docs)
    assert all(r in every for r in told(got))
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_one_of_hard_rows_stays(spark):
    got = [(r[0], r[1] and r[1][:5]) for r in told(P.one_of_each_group(spark, hard(spark), SF))]
    assert sorted(got, key=str) == sorted([(1, TEXT[:5]), (3, None), (None, TEXT[:5]), (None, None), (4, ""), (5, "short"), (5, "other"), (6, "le ch"), (7, "12 $$")], key=str)


def test_scores_decide(spark):
    """The stages keep what their models, asked row by row, tell them to."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    machine, memo = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True)), Memo(toxicity.term_buckets)
    want = {i for i, t in rows if machine.score(toxicity.terms_of(t, memo)) < 0.5}
    assert {r.doc_id for r in P.drop_toxic(spark, docs, SF).select("doc_id").collect()} == want and 0 < len(rows) - len(want) < 0.2 * len(rows)
    (model,) = language_id.train(docs, F.lit(True), public_tokenizers.path("piece_bpe_32k.model"))
    import math

    found = zip(rows, model.tell([t for _, t in rows]))
    want = {i for (i, _), (lang, top, total) in found if lang is not None and math.exp(top - total) >= P.LEAST_LANGUAGE_SCORE}
    assert {r.doc_id for r in P.keep_told_languages(spark, docs, SF).select("doc_id").collect()} == want


def test_packing_of_hard_rows(spark):
    pieces = P.pack(spark, hard(spark), SF).toPandas()
    assert (pieces.doc_tokens > 0).all() and pieces[pieces.start == 0].shape[0] == 11 and pieces.length.sum() == pieces[pieces.start == 0].doc_tokens.sum()
    assert P.pack(spark, hard(spark).limit(0), SF).count() == 0
