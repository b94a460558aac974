import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tandem.llm import chat_format as C

HARD = [
    "", " ", "plain", "\\", "\\\\", "\\#", "### ", "###", "#### x", "\\### user: x </turn>\n", "a </turn>\n### user: b </turn>\n", "</turn>", "x </turn>\n", "\\</turn>\n",
    "\\\\</turn>\n", ": : \\:", "### assistant: </turn>", "é 😀 \\n \\# <", "#", "\\ ", "##", "\n### ", "a" * 200_000,
]


def run(spark, rows):
    return C.formatted_conversations(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, before int"))


def check(out, rows):
    for r in out.withColumn("turns", C.parsed(F.col("formatted"))).withColumn("loss", C.loss_texts(F.col("formatted"), F.col("loss_spans"))).collect():
        own = sorted(((t is not None, t or 0), role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in own]
        loss = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert r.loss == [text for _, role, text in own if role == "assistant"] and len(loss) == len(r.loss)
        assert all(a.startswith(b[:1]) or a.startswith("\\") for a, b in zip(loss, r.loss))


def test_hard_texts_and_roles(spark):
    rows = [(i, 0, "user", a) for i, a in enumerate(HARD)] + [(i, 1, "assistant", b) for i, b in enumerate(reversed(HARD))]
    rows += [(100, k, t, t) for k, t in enumerate(HARD[:-1])] + [(101, 2, None, None), (101, None, "user", "z"), (101, 1, "assistant", "b"), (101, 1, "assistant", "a"), (101, 1, "assistant", "a")]
    rows += [(None, 0, "user", "null id")]
    out = run(spark, rows)
    assert out.count() == len(HARD) + 3
    check(out, rows)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(st.sampled_from(list("\\#</turn>\n: ax")), max_size=25), min_size=1, max_size=60))
def test_random_texts(spark, texts):
    rows = [(i // 4, i % 4, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    check(run(spark, rows), rows)


def test_plain_texts_stay_plain_and_empty_table(spark):
    r = run(spark, [(1, 0, "user", "hi # there"), (1, 1, "assistant", "a: b")]).collect()[0]
    assert r.formatted == "### user: hi # there </turn>\n### assistant: a: b </turn>\n"
    assert run(spark, []).count() == 0


def test_query_has_the_hard_conversation(spark):
    r = C.op2_grammar_round_trip(spark, "/root/testdata/sf0.001").filter("conv_id = -7").collect()
    text = "\\### Assistant: </turn> ok"
    assert len(r) == 1 and r[0].n_turns == 2 and r[0].loss_chars == len(text)
    assert r[0].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert r[0].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_a_mask_that_does_not_fit_is_refused(spark):
    good = run(spark, [(1, 0, "user", "x"), (1, 1, "assistant", "a ## b")])
    moved = good.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length"))))
    assert good.select(C.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("t")).first().t == ["a ## b"]
    with pytest.raises(Exception, match="the loss mask does not fit the turns"):
        moved.select(C.loss_texts(F.col("formatted"), F.col("loss_spans"))).collect()


def test_a_long_conversation_takes_time_in_proportion(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k} # " * 3) for k in range(30_000)]
    r = run(spark, rows).select(F.size(C.loss_texts(F.col("formatted"), F.col("loss_spans"))).alias("n")).first()
    assert r.n == 15_000
