"""Spacing of calls to a limited service: when each of a caller's calls can start, with back-off after failures.

A call starts at the later of its own time and the start of the call before it plus
that call's gap: s(i) = max(t(i), s(i-1) + g(i-1)). With the running sum G of the
gaps before a call, s(i) = G(i) + max over j <= i of (t(j) - G(j)): a running sum
and a running maximum instead of a loop over calls.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.scans import Layout

# Fixed values, in milliseconds: least time between calls, and waits after the k-th failure of a request, by kind; tries of a request.
GAP, BACK_OFF, BACK_OFF_LIMITED, TRIES = 4_000, 500, 2_000, 3


def _started(calls: Layout, gap: Column) -> DataFrame:
    laid = calls.sums("gaps", gap, before=True).maxima("free", F.col("at_ms") - F.col("gaps"))
    start = F.col("gaps") + F.col("free")
    return laid.result().withColumn("start_ms", start).withColumn("wait_ms", start - F.col("at_ms")).drop("gaps", "free")


def spaced(calls: DataFrame, key: list[str], order: list, gap_ms: int = GAP) -> DataFrame:
    """``calls`` (key, order columns, at_ms) with start_ms and wait_ms: calls of a key start at least ``gap_ms`` apart, in order.

    ``order`` begins with at_ms, or is otherwise the order in which the calls are made; at_ms is not null.
    """
    return _started(Layout(calls, key, order), F.lit(gap_ms).cast("long"))


def retried(calls: DataFrame, key: list[str], order: list, gap_ms: int = GAP, tries: int = TRIES) -> DataFrame:
    """``calls`` with failed and limited (booleans) also: attempt (1 to ``tries``, of the request), backoff_ms, start_ms and wait_ms.

    Failures in a row are tries of one request, which is given up after
    ``tries`` of them; a success ends it. After a failure the caller waits
    attempt * BACK_OFF, or * BACK_OFF_LIMITED if it was refused for too many
    calls, and the next call comes no sooner than that and the gap.
    """
    failed = F.col("failed").cast("long")
    laid = Layout(calls, key, order).sums("failures", failed)
    # Failures up to the latest success: what came after are the failures in a row.
    laid = laid.maxima("settled", F.when(~F.col("failed"), F.col("failures")))
    row = F.col("failures") - F.coalesce("settled", F.lit(0))
    # A success is the try after the failures before it.
    before = laid.maxima("settled_before", F.when(~F.col("failed"), F.col("failures")), before=True)
    after = F.col("failures") - F.coalesce("settled_before", F.lit(0))
    attempt = F.when(F.col("failed"), (row - 1) % tries + 1).otherwise(after % tries + 1)
    backoff = F.when(F.col("failed"), F.col("attempt") * F.when(F.col("limited"), BACK_OFF_LIMITED).otherwise(BACK_OFF)).otherwise(0)
    told = before.with_column("attempt", attempt).with_column("backoff_ms", backoff.cast("long"))
    return _started(told, F.greatest(F.lit(gap_ms).cast("long"), F.col("backoff_ms"))).drop("failures", "settled", "settled_before")
