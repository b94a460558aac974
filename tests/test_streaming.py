"""Streams of progress events."""

import datetime
import os

from tandem.streaming import progress

T = datetime.datetime(2024, 1, 1, 12)
CHUNKS = "session_id long, seq long, ts timestamp, chunk string"


def at(minutes):
    return T + datetime.timedelta(minutes=minutes)


def run(spark, path, batches, name, **options):
    """Rows that the batches, one micro-batch each, lead to."""
    os.makedirs(path)
    stream = spark.readStream.schema(CHUNKS).option("maxFilesPerTrigger", 1).parquet(path)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, CHUNKS).coalesce(1).write.mode("append").parquet(path)
        if not i:
            q = progress.followed(stream, **options).writeStream.outputMode("append").format("memory").queryName(name).start()
        q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.table(name).collect()]


def test_tail_and_snapshot_are_carried(spark, tmp_path):
    one = [(1, 1, at(0), 'data: {"stage": "a", "percent": 5, "session": {"k": 1}}\n\nevent: x\ndata: {}\n\nda'), (2, 1, at(0), "data: {\"stage\"")]
    two = [(1, 3, at(2), ' 9}\n\ndata: broken\n\ndata: [1]\n\ndata:\n\n'), (1, 2, at(1), 'ta:\n{"stage": "b", "percent":'), (2, 2, at(1), ': "z", "percent": 1}\n\n')]
    got = run(spark, str(tmp_path / "in"), [one, two], "carried")
    assert [r for r in got if r[0] == 1] == [(1, "a", 5, '{"k":1}'), (1, "b", 9, '{"k":1}')] and [r for r in got if r[0] == 2] == [(2, "z", 1, None)]


def test_sessions_are_let_go(spark, tmp_path):
    first = [(1, 1, at(0), 'data: {"stage": "a", "session": {"k": 1}}\n\n')]
    late = [(9, 1, at(300), "x")]
    again = [(1, 2, at(301), 'data: {"stage": "b"}\n\n')]
    got = run(spark, str(tmp_path / "in"), [first, late, late, again], "let_go", late="1 minute")
    assert got == [(1, "a", None, '{"k":1}'), (1, "b", None, None)]


def test_windows_count_events(spark):
    rows = [(at(1), "a"), (at(2), "a"), (at(11), "a"), (at(3), "b")]
    got = progress.active_counts(spark.createDataFrame(rows, "ts timestamp, stage string")).collect()
    assert sorted((r.stage, r.n) for r in got) == [("a", 1), ("a", 2), ("b", 1)]


def test_frames(spark):
    chunk = 'data: {"event_id": 1, "stage": "a", "percent": 3}\n\n: comment\n\nevent: x\n\n \ndata:{"event_id": 2,\n"stage": "b"}\n\ndata: cut'
    got = progress.parse_frames(spark.createDataFrame([(1, chunk), (2, ""), (3, None)], "session_id long, chunk string")).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, "a", 3), (1, 3, 2, "b", None)]
