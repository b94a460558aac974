"""A sink for event streams: server-sent event frames in files, each batch once, and streams that can be stopped and taken up again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FRAMES = "session_id long, seq long, ts timestamp, chunk string, batch long"


def frame(*payload) -> Column:
    """The frame of an event with these columns: ``data: `` and its JSON, and a blank line. Null columns are left out."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*payload)), F.lit("\n\n"))


def once(path: str, make: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: writes each batch, or what ``make`` makes of it, to a folder of its own below ``path``.

    A batch that comes again, after a failure between its write and its commit,
    replaces its folder, so nothing is there twice. Empty batches leave nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = make(batch) if make else batch
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def started(stream: DataFrame, path: str, checkpoint: str, make=None, sink=None, available_now: bool = True) -> StreamingQuery:
    """A query that writes ``stream`` by ``once`` (or ``sink``), with its progress in ``checkpoint``."""
    writer = stream.writeStream.foreachBatch(sink or once(path, make)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="0 seconds")).start()


def cancelled(query: StreamingQuery) -> int:
    """Stops a query between or inside batches; number of its last batch that was committed, -1 if none was.

    A batch that was not committed is done again, under the same number, by the
    next query with that checkpoint.
    """
    last = query.lastProgress
    query.stop()
    return -1 if last is None else last["batchId"]


def frames_of(events: DataFrame, payload: list) -> DataFrame:
    """session_id, seq, ts, chunk of events (session_id, event_id, ts and the payload's columns)."""
    return events.select("session_id", F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), frame(*payload).alias("chunk"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """All frames that a sink has written, as rows of ``frames_of`` and the batch."""
    return spark.read.schema(FRAMES).option("basePath", path).parquet(path)
