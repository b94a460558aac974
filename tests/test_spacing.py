"""Scans over pieces, and spacing of calls, against loops."""

import random

import pytest
from pyspark.sql import functions as F

from tandem.operators import spacing
from tandem.operators.scans import Layout

CALLS = "caller long, at_ms long, call long, failed boolean, limited boolean"


def generated(seed):
    """A caller with most of the calls, a null caller, and small ones; times tie and are crowded."""
    rnd = random.Random(seed)
    callers = [1] * 300 + [None] * 60 + [rnd.randint(2, 30) for _ in range(120)]
    return [(c, rnd.randint(0, 200) * 5_000 if c == 1 else rnd.randint(0, 40) * 1_000, i, rnd.random() < 0.6, rnd.random() < 0.5) for i, c in enumerate(callers)]


def looped(rows, gap=spacing.GAP):
    """Row by row: when each call starts with a fixed gap, and with back-off."""
    out = {}
    for caller in {r[0] for r in rows}:
        free = free_backed = -(10**18)
        failures = 0
        for _, at, call, failed, limited in sorted((r for r in rows if r[0] == caller), key=lambda r: r[1:3]):
            start, backed = max(at, free), max(at, free_backed)
            free = start + gap
            attempt = failures % 3 + 1
            wait = attempt * (2_000 if limited else 500) if failed else 0
            free_backed = backed + max(gap, wait)
            failures = failures + 1 if failed else 0
            out[call] = (start, start - at, attempt, wait, backed)
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_spacing_equals_a_loop(spark, partitions):
    rows = generated(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        calls = spark.createDataFrame(rows, CALLS)
        want = looped(rows)
        a = {r.call: (r.start_ms, r.wait_ms) for r in spacing.spaced(calls, ["caller"], ["at_ms", "call"]).collect()}
        assert a == {k: v[:2] for k, v in want.items()}
        b = {r.call: (r.attempt, r.backoff_ms, r.start_ms) for r in spacing.retried(calls, ["caller"], ["at_ms", "call"]).collect()}
        assert b == {k: v[2:] for k, v in want.items()}
        pieces = Layout(calls, ["caller"], ["at_ms", "call"]).rows.filter("caller = 1").select("piece").distinct().count()
        assert pieces > 1 or partitions == "1"  # the large key lies in several tasks
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, None), (1, 3, 2), (2, 1, None), (2, 2, -4)], "k long, o long, x long")
    laid = Layout(rows, ["k"], ["o"]).sums("s", F.col("x")).maxima("m", F.col("x")).sums("before", F.col("x"), before=True)
    got = sorted(tuple(r) for r in laid.result().select("k", "o", "s", "m", "before").collect())
    assert got == [(1, 1, 5, 5, 0), (1, 2, 5, 5, 5), (1, 3, 7, 5, 5), (2, 1, 0, None, 0), (2, 2, -4, -4, 0)]
    with pytest.raises(ValueError, match="layout"):
        Layout(rows.withColumn("pos", F.lit(1)), ["k"], ["o"])


def test_no_calls(spark):
    assert spacing.spaced(spark.createDataFrame([], CALLS), ["caller"], ["at_ms", "call"]).collect() == []
