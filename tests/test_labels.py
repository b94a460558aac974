"""Labels with white space of any kind."""

import pytest
from pyspark.sql import functions as F

from tandem.functions import labels as L
from tandem.operators import geometry, linkage

NBSP, THIN, BOM, IDEOGRAPHIC, LINE = " ", " ", "﻿", "　", " "


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (f"Ans{NBSP}5", "5"), (f"5{NBSP}", "5"), (f"Q.{THIN}5", "5"), (f"{BOM}4(a)", "4(a)"), (f"4{IDEOGRAPHIC}(a)", "4(a)"), (f"4 .{NBSP}a{LINE}", "4(a)"), (f"{NBSP}", None), (f"{BOM}{THIN}\v", None), (f"Q{LINE}7.", "7"),
        (f"5{NBSP})", "5"), ("Ans 5", "5"), ("4a", "4(a)"), ("", None), (None, None), ("​5", "​5"), ("\u00855", "\u00855"),
    ],
)
def test_canonical(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "raw string").select(L.canonical(F.col("raw")).alias("c")).first().c == want


def test_run_labels(spark):
    texts = [f"{NBSP}Ans{THIN}{NBSP}3.{BOM}", "  ", f"{NBSP}{BOM}"]
    df = spark.createDataFrame([(1, 1, float(i), i, t) for i, t in enumerate(texts)], "session_id long, page long, y double, run long, text string")
    assert [r.x for r in geometry.ordered_runs(df).select(geometry.run_label(F.col("text")).alias("x")).collect()] == ["ans 3."]


def test_lengths_leave_white_space_out(spark):
    rows = [(1, f"a{i}", i, "Q1", t, False, False, False) for i, t in ((0, f"{NBSP * 9}four{IDEOGRAPHIC * 9}"), (9, "longer"))]
    df = spark.createDataFrame(rows, "session_id long, answer_id string, seq long, raw_label string, text string, crossed_out boolean, low_confidence boolean, has_diagram boolean")
    assert {r.answer_id: r.role for r in linkage.resolved(df).collect()} == {"a0": "duplicate", "a9": "primary"}


def test_anchors_with_nested_labels(spark):
    """Blocks claim one after the other; sessions without nested labels go without Python."""
    import random

    rnd = random.Random(5)
    blocks, runs = [], []
    for s in range(40):
        names = ["ans 1", "ans 10", "ans 1.", "q2"] if s % 2 else ["ans 1.", "ans 2.", "q3"]
        blocks += [(s, f"b{i}", i, rnd.choice([*names, None, " "])) for i in range(rnd.randint(0, 9))]
        runs += [(s, i, rnd.choice(["Ans  1 x", "ans 10. y", "ans 1. z", "Q2 w", "q3", "other", "ans 2. v"])) for i in range(rnd.randint(0, 14))]
    want = set()
    for s in range(40):
        free = {p: " ".join(t.lower().split()) for x, p, t in runs if x == s}
        for _, b, _, label in sorted((r for r in blocks if r[0] == s), key=lambda r: r[2]):
            label = " ".join((label or "").lower().split())
            place = next((p for p in sorted(free) if label and free[p].startswith(label)), None)
            if place is not None:
                del free[place]
                want.add((s, b, place))
    got = geometry.anchors(spark.createDataFrame(blocks, "session_id long, answer_id string, seq long, label string"), spark.createDataFrame(runs, "session_id long, place long, text string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 60
