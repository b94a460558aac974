"""Small cases of labels, linkage and scoring."""

import pytest
from pyspark.sql import functions as F

from tandem.functions import labels as L
from tandem.functions import text as X
from tandem.operators import linkage as K

Q = "session_id long, question_id string, ordinal long, label string, marks long, low_confidence boolean, text string"
A = "session_id long, answer_id string, seq long, raw_label string, text string, crossed_out boolean, low_confidence boolean, has_diagram boolean"
LONG = "a long answer text of many words"


def questions(spark, labels, texts=None):
    return spark.createDataFrame([(1, f"q{i + 1}", i, x, 5, False, (texts or {}).get(i, "")) for i, x in enumerate(labels)], Q)


def answers(spark, rows):
    return spark.createDataFrame([(1, i, seq, label, text, False, False, False) for i, seq, label, text in rows], A)


def run(spark, q, a):
    m = K.link(q, a)
    rows = {r.question_id: r for r in m.collect()}
    return rows, {r.answer_id: r for r in K.orphans(m, a).collect()}


def test_labels(spark):
    # Labels and what they must become.
    want = {"Ans 5": "5", "Ans. 5": "5", "Q.5": "5", "Q5": "5", "Question 5": "5", "5.": "5", "5)": "5", "5 -": "5", "4(a)": "4(a)", "4a": "4(a)", "4.a": "4(a)", "4-a": "4(a)", "11.b": "11(b)", "": None, None: None, " ": None, "15": "1(5)", "Answer 5": "wer 5", "-": "", "4(ii)": "4(ii"}
    df = spark.createDataFrame([(k,) for k in want], "raw string")
    assert {r.raw: r.c for r in df.select("raw", L.canonical(F.col("raw")).alias("c")).collect()} == want
    keys = {r.raw: r.k for r in df.select("raw", L.sort_key(F.col("raw")).alias("k")).collect()}
    assert keys["4(a)"] < keys["Q5"] and keys["15"] == 203 and keys[None] == L.NO_NUMBER


def test_similarity(spark):
    df = spark.createDataFrame([("4(a)", "4(o)"), ("Ans 5", "Q.5")], "a string, b string")
    assert [r.s for r in df.select(L.similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [0.75, 1.0]


def test_exact_in_any_order_and_unanswered(spark):
    q = questions(spark, ["1", "2", "3", "4", "5"])
    rows, left = run(spark, q, answers(spark, [(f"a{n}", i, f"Ans {n}", LONG) for i, n in enumerate((5, 2, 1))]))
    assert {k: r.answer_id for k, r in rows.items()} == {"q1": "a1", "q2": "a2", "q3": None, "q4": None, "q5": "a5"} and not left
    assert rows["q1"].method == "number-exact" and rows["q1"].confidence == pytest.approx(0.95)


def test_pages_merge_and_duplicates_stay_out(spark):
    q = questions(spark, ["1", "2"])
    rows, left = run(spark, q, answers(spark, [("s", 0, "1", "x"), ("a2a", 1, "2", LONG), ("a2b", 2, "2", LONG), ("l", 10, "1", LONG)]))
    assert rows["q2"].merged_ids == ["a2a", "a2b"] and rows["q2"].n_additional == 1
    assert rows["q1"].answer_id == "l" and left["s"].reason == "duplicate-of-mapped" and left["s"].guess_question_id == "q1"


def test_near_label(spark):
    rows, _ = run(spark, questions(spark, ["4(a)"]), answers(spark, [("a", 0, "4(q)", LONG)]))
    assert rows["q1"].method == "number-fuzzy" and rows["q1"].confidence == pytest.approx(0.825)


def test_content_then_residual(spark):
    q = questions(spark, ["1", "2"], {0: "explain photosynthesis in green plants", 1: "name capital cities"})
    rows, left = run(spark, q, answers(spark, [("a", 0, None, "green plants use photosynthesis"), ("b", 1, None, "zzz yyy")]))
    assert (rows["q1"].answer_id, rows["q1"].method) == ("a", "semantic") and (rows["q2"].answer_id, rows["q2"].method, rows["q2"].needs_review) == ("b", "sequence-fallback", True) and not left


def test_one_side_empty(spark):
    rows, left = run(spark, questions(spark, ["1", "2"]), answers(spark, []))
    assert all(r.answer_id is None for r in rows.values()) and not left
    rows, left = run(spark, questions(spark, []), answers(spark, [("a", 0, "1", LONG)]))
    assert not rows and left["a"].reason == "no-question-match"


def test_tokens(spark):
    r = spark.createDataFrame([("The cat-cat, an OX and 12 dogs!",)], "t string").select(X.tokens(F.col("t")).alias("w")).first()
    assert r.w == ["cat", "dogs"]


def test_near_labels_that_a_second_normalization_shortens(spark):
    """The length bound looks at what is compared, so that no link is lost."""
    for written in ("Q Ans 5", "5 ) )", "Question Q. 5"):
        rows, left = run(spark, questions(spark, ["5"]), answers(spark, [("a", 0, written, LONG)]))
        assert rows["q1"].answer_id == "a" and rows["q1"].method in ("number-exact", "number-fuzzy") and not left
    rows, _ = run(spark, questions(spark, ["5"]), answers(spark, [("a", 0, "Q Ans 5", LONG)]))
    assert rows["q1"].similarity == 1.0


def brute_force_greedy(q, a):
    """Questions in order take the free answer with the largest overlap."""
    stop, free, picks = set(X.STOP_WORDS), list(a), {}
    words = lambda t: {w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split() if len(w) > 2} - stop
    for q_id, text in q:
        best = max(free, key=lambda x: len(words(text) & words(x[1])) / max(len(words(text)), 1), default=None)
        ratio = len(words(text) & words(best[1])) / max(len(words(text)), 1) if best else 0
        if ratio > 0.08 and min(ratio * 1.5, 0.6) > 0.25:
            picks[q_id] = best[0]
            free.remove(best)
    return picks


def test_content_in_rounds_equals_one_question_after_another(spark):
    import random

    rng, q, a, want = random.Random(6), [], [], {}
    vocabulary = [f"word{i}" for i in range(9)]
    for s in range(30):
        own_q = [(f"{s}-q{i}", " ".join(rng.sample(vocabulary, rng.randrange(1, 5)))) for i in range(rng.randrange(1, 9))]
        own_a = [(f"{s}-a{i}", " ".join(rng.sample(vocabulary, rng.randrange(0, 6)))) for i in range(rng.randrange(0, 9))]
        q += [(s, i, n, t) for n, (i, t) in enumerate(own_q)]
        a += [(s, i, n, t) for n, (i, t) in enumerate(own_a)]
        want |= brute_force_greedy(own_q, own_a)
    picks = K.by_content(spark.createDataFrame(q, "session_id long, question_id string, ordinal long, text string"), spark.createDataFrame(a, "session_id long, answer_id string, seq long, text string"))
    assert {r.question_id: r.answer_id for r in picks.collect()} == want


def test_captions(spark):
    q = questions(spark, ["1"])
    a = answers(spark, [("s", 0, "1", "x"), ("l", 9, "1", LONG), ("m", 10, "9 z", "y"), ("n", 11, None, "y")]).withColumn("page", F.col("seq") + 1)
    got = {r.answer_id: r.caption for r in K.captions(K.orphans(K.link(q, a), a), a, q).collect()}
    assert got == {"s": "Page 1 • Looks like a duplicate/extra attempt at Q1", "m": 'Page 11 • Student wrote "9 z" but no matching question was found', "n": "Page 12 • No question number could be identified"}


def test_labels_that_begin_alike_claim_the_next_run(spark):
    from tandem.operators import geometry as G

    runs = spark.createDataFrame([(1, 1, 0, 0.0, 0.1, 0.2, 0.01, "Ans 10. x"), (1, 1, 1, 0.0, 0.3, 0.2, 0.01, "ANS  1. y"), (1, 2, 2, 0.0, 0.1, 0.2, 0.01, "ans 1. z"), (1, 1, 3, 0.0, 0.2, 0.2, 0.01, "  ")], "session_id long, page long, run long, x double, y double, w double, h double, text string")
    blocks = spark.createDataFrame([(1, "a", 0, "Ans 1"), (1, "b", 1, "ans 1"), (1, "c", 2, "Ans 1."), (1, "d", 3, None), (1, "e", 4, "Ans 7")], "session_id long, answer_id string, seq long, label string")
    got = G.anchors(blocks, G.ordered_runs(runs)).collect()
    assert {r.answer_id: r.place for r in got} == {"a": 0, "b": 1, "c": 2}
