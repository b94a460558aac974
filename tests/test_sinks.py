"""Sinks of streams: frames written once, streams that stop and go on, subscriptions that change, landing."""

import datetime
import random
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tandem.streaming import landing, progress, sink, subscriptions

T = datetime.datetime(2024, 1, 1)
EVENTS = "session_id long, event_id long, ts timestamp_ntz, stage string, percent long"


def generated(n, seed=1):
    rnd = random.Random(seed)
    return [(rnd.choice([1, 1, 2, 3]), i, T + datetime.timedelta(minutes=i), rnd.choice(["a", "b", None]), rnd.choice([None, rnd.randint(0, 100)])) for i in range(n)]


def put(spark, path, rows, schema=EVENTS, files=1):
    spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(path)


def as_frames(events):
    return sink.frames_of(events, ["event_id", "stage", "percent"])


def once_failing(path, number, make=None):
    """A sink that writes batch ``number`` and then fails, the first time."""
    write, failed = sink.once(path, make), []

    def run(batch, n):
        write(batch, n)
        if n == number and not failed:
            failed.append(n)
            raise RuntimeError("lost after writing")

    return run


def events_read_back(spark, path):
    """(session_id, event_id, stage, percent) of the frames in files."""
    parsed = progress.parse_frames(sink.read_frames(spark, path))
    return sorted((tuple(r) for r in parsed.select("session_id", "event_id", "stage", "percent").collect()), key=str)


def expected(rows):
    return sorted(((r[0], r[1], r[3], r[4]) for r in rows), key=str)


def test_frames_are_written_once_and_followed(spark, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = generated(120)
    put(spark, inbox, rows, files=4)
    run = once_failing(out, 1)
    with pytest.raises(StreamingQueryException, match="lost after writing"):
        sink.started(as_frames(stream(spark, inbox)), out, state, sink=run).awaitTermination()
    sink.started(as_frames(stream(spark, inbox)), out, state, sink=run).awaitTermination()
    assert events_read_back(spark, out) == expected(rows)
    assert sink.read_frames(spark, out).select("batch").distinct().count() == 4
    chunks = spark.readStream.schema(sink.FRAMES).option("basePath", out).parquet(out)
    q = progress.followed(chunks).writeStream.outputMode("append").format("memory").queryName("sunk").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(((r.session_id, r.stage, r.percent) for r in spark.table("sunk").collect()), key=str)
    assert got == sorted(((r[0], r[3], r[4]) for r in rows), key=str)


def test_a_cancelled_stream_goes_on(spark, tmp_path):
    inbox, out, state, whole = (str(tmp_path / x) for x in ("in", "out", "state", "whole"))
    rows = generated(90, 2)
    put(spark, inbox, rows[:60], files=3)

    def slow(batch, number, write=sink.once(out)):
        write(batch, number)
        time.sleep(1)

    q = sink.started(as_frames(stream(spark, inbox)), out, state, sink=slow, available_now=False)
    while q.lastProgress is None and q.isActive:
        time.sleep(0.05)
    last = sink.cancelled(q)
    assert 0 <= last < 2 and not q.isActive
    put(spark, inbox, rows[60:], files=2)
    sink.started(as_frames(stream(spark, inbox)), out, state).awaitTermination()
    sink.started(as_frames(stream(spark, inbox)), whole, str(tmp_path / "other")).awaitTermination()
    assert events_read_back(spark, out) == events_read_back(spark, whole) == expected(rows)


def test_a_batch_inside_which_a_stream_stops_is_done_again(spark, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = generated(60, 3)
    put(spark, inbox, rows, files=3)
    started = []

    def hung(batch, number, write=sink.once(out)):
        write(batch, number)
        if number == 1:
            started.append(number)
            time.sleep(30)

    q = sink.started(as_frames(stream(spark, inbox)), out, state, sink=hung, available_now=False)
    while not started:
        time.sleep(0.05)
    assert sink.cancelled(q) == 0
    sink.started(as_frames(stream(spark, inbox)), out, state).awaitTermination()
    assert events_read_back(spark, out) == expected(rows)


def brute_delivery(events, log):
    out = []
    for subscriber, session in {r[:2] for r in log}:
        on = sorted((r[3], r[4], r[2]) for r in log if r[:2] == (subscriber, session))
        for e in events:
            before = [a for at, _, a in on if at <= e[2]]
            if e[0] == session and before and before[-1] == "subscribe":
                out.append((subscriber, *e))
    return sorted(out, key=str)


def test_subscriptions_change_while_the_stream_runs(spark, tmp_path):
    inbox, log, out, state = (str(tmp_path / x) for x in ("in", "log", "out", "state"))
    rnd = random.Random(4)
    events = generated(200, 5)
    actions = [(rnd.randint(1, 6), rnd.randint(1, 3), rnd.choice(["subscribe", "unsubscribe"]), T + datetime.timedelta(minutes=rnd.randint(0, 200), seconds=30 * (i % 2)), i) for i in range(60)]
    cut = T + datetime.timedelta(minutes=100)
    put(spark, log, [a for a in actions if a[3] < cut], subscriptions.ACTIONS)
    put(spark, inbox, [e for e in events if e[2] < cut], files=2)
    q = sink.started(stream(spark, inbox), out, state, sink=subscriptions.delivery(out, log), available_now=False)
    q.processAllAvailable()
    put(spark, log, [a for a in actions if a[3] >= cut], subscriptions.ACTIONS)
    put(spark, inbox, [e for e in events if e[2] >= cut], files=2)
    q.processAllAvailable()
    sink.cancelled(q)
    got = sorted((tuple(r) for r in spark.read.parquet(out).select("subscriber", "session_id", "event_id", "ts", "stage", "percent").collect()), key=str)
    want = brute_delivery(events, actions)
    assert got == want and len({r[0] for r in want}) == 6


def test_no_subscriptions(spark):
    events = spark.createDataFrame(generated(5), EVENTS)
    log = spark.createDataFrame([(1, 1, "unsubscribe", T, 1), (1, 1, "subscribe", T, 2), (1, 1, "unsubscribe", T, 3)], subscriptions.ACTIONS)
    assert subscriptions.delivered(events, log).collect() == [] and subscriptions.terms(log).collect() == []


def test_uploads_land_once(spark, tmp_path):
    inbox, store, state = (str(tmp_path / x) for x in ("in", "store", "state"))
    pdf = "application/pdf"
    first = [("s1", "questionPaper", "a.pdf", pdf, b"%PDF"), ("s1", "answerSheet", "b.PNG", None, b"png"), ("s2", "answerSheet", "c.txt", "text/plain", b"x"), ("s2", "answerSheet", "d.jpeg", "image/jpeg", b"")]
    more = [("s3", "other", "e.pdf", pdf, b"x"), ("", "answerSheet", "f.pdf", pdf, b"x"), (None, None, None, None, None), ("s3", "answerSheet", "big.pdf", pdf, b"x" * 50), ("s3", "answerSheet", "noname", pdf, bytes(range(20)))]
    put(spark, inbox, first, landing.UPLOADS, 2)
    landing.land(spark, inbox, store, state, files_per_batch=1, most=40)
    assert landing.landed(spark, store).count() == 4
    put(spark, inbox, more, landing.UPLOADS, 3)
    for _ in range(2):
        landing.land(spark, inbox, store, state, files_per_batch=1, most=40)
    got = {r.name: r for r in landing.landed(spark, store).collect()}
    assert len(got) == 9 and landing.landed(spark, store).count() == 9
    assert {n: r.error for n, r in got.items()} == {"a.pdf": None, "b.PNG": None, "c.txt": "type", "d.jpeg": "empty", "e.pdf": "request", "f.pdf": "request", None: "request", "big.pdf": "too-large", "noname": None}
    assert {n: bytes(r.content) for n, r in got.items() if r.accepted} == {"a.pdf": b"%PDF", "b.PNG": b"png", "noname": bytes(range(20))}
    assert all(r.content is None and r.stored_path is None for r in got.values() if not r.accepted)
    assert got["b.PNG"].mime == "image/png" and got["b.PNG"].stored_path == f"s1/answerSheet/{got['b.PNG'].file_id}.png"
    plan = landing.landed(spark, store).filter("accepted")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(accepted" in plan


def test_a_landing_that_failed_is_done_again(spark, tmp_path, monkeypatch):
    inbox, store, state = (str(tmp_path / x) for x in ("in", "store", "state"))
    put(spark, inbox, [("s", "answerSheet", f"{i}.pdf", None, b"x") for i in range(6)], landing.UPLOADS, 3)
    judged, calls = landing.judged, []

    def failing(batch, most):
        calls.append(1)
        if len(calls) == 2:
            return judged(batch, most).withColumn("size", F.raise_error(F.lit("lost")).cast("long"))
        return judged(batch, most)

    monkeypatch.setattr(landing, "judged", failing)
    with pytest.raises(StreamingQueryException, match="lost"):
        landing.land(spark, inbox, store, state, files_per_batch=1)
    landing.land(spark, inbox, store, state, files_per_batch=1)
    assert sorted(r.name for r in landing.landed(spark, store).collect()) == [f"{i}.pdf" for i in range(6)]
