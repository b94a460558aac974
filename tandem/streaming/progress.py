"""Progress events, batch or stream: frames, the latest state of each session, with expiry."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Minutes after its first chunk that a session is followed.
FOLLOWED_MINUTES = 120


def latest(events: DataFrame) -> DataFrame:
    """Latest stage and percent of each session of ``session_id, ts, event_id, stage, percent``: batch, or a stream in update mode.

    As a stream it keeps a row for every session; ``followed`` lets sessions go.
    """
    state = F.max_by(F.struct("stage", "percent", "event_id"), F.struct("ts", "event_id")).alias("e")
    return events.groupBy("session_id").agg(state).select("session_id", "e.*")


def active_counts(events: DataFrame, width: str = "10 minutes", late: str = "120 minutes") -> DataFrame:
    """Events per stage and window of event time; state of windows older than ``late`` is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "stage").agg(F.count("*").alias("n")).select("window.start", "stage", "n")


def parse_frames(chunks: DataFrame) -> DataFrame:
    """Events of ``session_id, chunk`` (server-sent event frames): frames end at a blank line, others than data frames are skipped, and so is an unfinished tail."""
    frames = F.split("chunk", "\n\n")
    whole = chunks.select("session_id", F.posexplode(F.slice(frames, 1, F.size(frames) - 1)).alias("pos", "frame"))
    payload = F.regexp_extract("frame", r"(?s)\A\s*data:\s*(.*?)\s*\z", 1)
    parsed = whole.select("session_id", F.col("pos").cast("long").alias("pos"), F.from_json(payload, "event_id long, stage string, percent long").alias("e"))
    return parsed.filter("e is not null and (e.event_id is not null or e.stage is not null or e.percent is not null)").select("session_id", "pos", "e.*")


def followed(chunks: DataFrame, late: str = "10 minutes", minutes: int = FOLLOWED_MINUTES) -> DataFrame:
    """Events of a stream of ``session_id, seq, ts, chunk``: session_id, stage, percent, snapshot, in the order of ``seq``.

    What a chunk ends with before a blank line is carried to the session's next
    chunk. ``snapshot`` is the last ``session`` object that an event brought, also
    with later events that bring none. Frames that are no data frames, or no JSON
    objects, are skipped. A session's state goes ``minutes`` after its first chunk.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("seq")
        tail, snapshot, ends = state.get if state.exists else ("", None, int(rows.ts.min().timestamp() * 1000) + minutes * 60_000)
        *whole, tail = (tail + "".join(rows.chunk.dropna())).split("\n\n")
        out = []
        for payload in (frame.strip().removeprefix("data:") for frame in whole if frame.strip().startswith("data:")):
            try:
                event = json.loads(payload)
            except ValueError:
                continue
            if isinstance(event, dict):
                snapshot = json.dumps(event["session"], separators=(",", ":")) if event.get("session") else snapshot
                out.append((key[0], event.get("stage"), event.get("percent"), snapshot))
        if ends > state.getCurrentWatermarkMs():
            state.update((tail, snapshot, ends))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["session_id", "stage", "percent", "snapshot"])

    watched = chunks.withWatermark("ts", late).groupBy("session_id")
    return watched.applyInPandasWithState(follow, "session_id long, stage string, percent long, snapshot string", "tail string, snapshot string, ends long", "append", GroupStateTimeout.EventTimeTimeout)
