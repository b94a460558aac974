import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.llm import toxicity as X

SCHEMA = "doc_id long, text string, toxic string, lang string"


def test_interaction_that_linear_weights_miss():
    """Toxic only with an insult and a mention of a group together."""
    rng = random.Random(3)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"w{rng.randrange(60)}" for _ in range(20)] + ["insult"] * a + ["group"] * b
        rows.append(np.array(sorted({t for w in words for t in X.term_buckets(w)})))
        y.append(float(a != b))  # exclusive or: no linear score separates it
    machine = X.fit_machine(rows[:2400], np.array(y[:2400]))
    right = np.mean([(machine.score(r) >= 0.5) == t for r, t in zip(rows[2400:], y[2400:])])
    assert right > 0.95


def test_interaction_among_commoner_words():
    """Exclusive or of two words that say nothing alone, among 200 words that are more frequent."""
    rng = np.random.default_rng(3)
    has = rng.random((6000, 202)) < np.r_[np.full(200, 0.7), 0.5, 0.5]
    rows, y = [np.flatnonzero(r) for r in has], (has[:, -1] != has[:, -2]).astype(float)
    machine = X.fit_machine(rows[:4800], y[:4800])
    assert {200, 201} <= set(machine.buckets.tolist())
    assert np.mean([(machine.score(r) >= 0.5) == t for r, t in zip(rows[4800:], y[4800:])]) > 0.95


def test_telling_pairs_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(9)
    has = rng.random((900, 40)) < 0.4
    toxic = (has[:, 3] & has[:, 7] | (rng.random(900) < 0.1)).astype(float)
    share, rates = toxic.mean(), (toxic @ has + toxic.mean()) / (has.sum(0) + 1)
    monkeypatch.setattr(X, "PAIR_COUNTERS", 300)
    monkeypatch.setattr(X, "PAIRS_TOGETHER", 500)
    monkeypatch.setattr(X, "NATS", 4.0)
    want = set()
    odds = np.log(rates / (1 - rates))
    for a in range(40):
        for b in range(a + 1, 40):
            both = has[:, a] & has[:, b]
            expected = 1 / (1 + np.exp(-(odds[a] + odds[b] - np.log(share / (1 - share)))))
            if both.sum() >= X.PAIR_ROWS and X.nats(toxic[both].sum(), both.sum(), expected) >= 4.0:
                want |= {a, b}
    found = X.telling_pairs(np.concatenate([np.flatnonzero(r) for r in has]), has.sum(1), toxic, rates, share)
    assert set(found.tolist()) == want and {3, 7} <= want


def test_score_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    machine = X.Machine(np.arange(10) * 3, 0.2, rng.normal(0, 1, 10), rng.normal(0, 1, (10, X.FACTORS)))
    terms = [0, 6, 9, 27, 1, 500]
    own = [0, 2, 3, 9]
    z = 0.2 + sum(machine.w[i] for i in own) + sum(float(machine.v[i] @ machine.v[j]) for i in own for j in own if i < j)
    assert machine.score(terms) == pytest.approx(1 / (1 + np.exp(-z)))
    assert machine.score([]) == pytest.approx(1 / (1 + np.exp(-0.2)))


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        words = [f"w{rng.randrange(300)}" for _ in range(30)] + ["scoundrel"] * (i % 8 == 0)
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x", None))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(600)] + [(7, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    return docs, X.train(docs, labels, F.lit(True))


def test_rows_stay_and_hard_texts_score(spark, small):
    docs, machine = small
    hard = [(1, None, "a", "b"), (None, "", "a", None), (2, "SCOUNDREL! " * 20_000, None, None), (2, "SCOUNDREL!", None, None), (2, "SCOUNDREL!", None, None)]
    got = X.score_documents(spark.createDataFrame(hard, SCHEMA), machine)
    assert got.columns == [*docs.columns, "toxicity"]
    scores = {(r.doc_id, r.text): r.toxicity for r in got.collect()}
    assert got.count() == 5 and scores[(2, "SCOUNDREL!")] > 0.5 > scores[(1, None)] == scores[(None, "")]
    assert X.score_documents(spark.createDataFrame([], SCHEMA), machine).count() == 0
    clash = spark.createDataFrame(hard, SCHEMA).withColumn("toxicity", F.lit("mine"))
    assert X.score_documents(clash, machine, "score").select("toxicity").distinct().collect()[0][0] == "mine"


def test_without_labels_nothing_is_toxic(spark, small):
    docs, _ = small
    none = spark.createDataFrame([], "doc_id long, toxic int")
    scored = X.score_documents(docs, X.train(docs, none, F.lit(True)))
    assert scored.filter("toxicity >= 0.5").count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = X.op5_factorization_machine(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    r = got.filter("held_out").join(labels, "doc_id").filter("toxic is not null").toPandas()
    assert (r.predicted == r.toxic).mean() > 0.96
    assert r[r.toxic == 0].predicted.mean() < 0.01
    assert got.filter("score is null or score < 0 or score > 1").count() == 0
