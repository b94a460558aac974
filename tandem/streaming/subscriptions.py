"""Events to those who have subscribed to their session at that time.

Subscriptions are a log that grows while the stream runs: subscriber, session_id,
action (``subscribe`` or ``unsubscribe``), at, seq. Each batch reads the log as it
is then. What counts is the time of the event: a batch that is done again delivers
the same, if actions are in the log before the events that they are to hold for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.streaming.sink import once

ACTIONS = "subscriber long, session_id long, action string, at timestamp_ntz, seq long"


def terms(log: DataFrame) -> DataFrame:
    """subscriber, session_id, since, until (null: still on): the times that a subscription holds, ends left out.

    Actions of a pair go by at and seq; one that changes nothing is passed over.
    """
    order = Window.partitionBy("subscriber", "session_id").orderBy("at", "seq")
    on = log.select("subscriber", "session_id", "at", "seq", (F.col("action") == "subscribe").alias("on"))
    changes = on.withColumn("was", F.coalesce(F.lag("on").over(order), F.lit(False))).filter("on <> was")
    ended = changes.withColumn("until", F.lead("at").over(order))
    return ended.filter("on").select("subscriber", "session_id", F.col("at").alias("since"), "until").filter("until is null or since < until")


def delivered(events: DataFrame, log: DataFrame) -> DataFrame:
    """subscriber and the columns of ``events`` (session_id, ts, ...) for every subscription that holds at the event's time."""
    t = terms(log).withColumnRenamed("session_id", "to")
    held = (F.col("ts") >= F.col("since")) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))
    return events.join(t, (F.col("session_id") == F.col("to")) & held).select("subscriber", *[events[c] for c in events.columns])


def delivery(path: str, log_path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes what each batch delivers by the log as it is then, each batch once."""

    def log(spark: SparkSession) -> DataFrame:
        return spark.read.schema(ACTIONS).parquet(log_path)

    return once(path, lambda batch: delivered(batch, log(batch.sparkSession)))
