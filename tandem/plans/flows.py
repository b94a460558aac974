"""Queries of stores, streams and files: name -> (spark, sf_dir) -> DataFrame. Each works on a given table or what Spark makes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandem.functions.wrapping import wrapped
from tandem.operators import extraction, geometry, history, lookup, scoring, snapshots, spacing
from tandem.sources import blobs, nested
from tandem.sources import fixtures as D
from tandem.sources.tables import ALL_KEYS, dealt_by, shared_dir
from tandem.streaming import landing, progress, sink, subscriptions

CALL_ORDER = ["at_ms", "event_id"]


def call_spacing(spark, d):
    """When each user's calls start, four seconds apart."""
    return spacing.spaced(D.calls(spark, d), ["session_id"], CALL_ORDER).select("session_id", "event_id", "start_ms", "wait_ms")


def call_backoff(spark, d):
    """The same with failures, which are tried again after longer and longer waits."""
    return spacing.retried(D.calls(spark, d), ["session_id"], CALL_ORDER).select("session_id", "event_id", "attempt", "backoff_ms", "start_ms")


FIELDS = {"stage": "string", "percent": "long", "error": "string", "questions": "long", "answers": "long"}
DEFAULTS = {"stage": "idle"}


def session_snapshots(spark, d):
    """Every user's snapshot: the value last given of each column, explicit nulls kept."""
    return snapshots.snapshots(snapshots.entries(D.patches(spark, d)), FIELDS, DEFAULTS)


def snapshot_store(spark, d):
    """The same from a store to which the patches were applied in batches that are out of order, one of them twice."""
    path, patches = shared_dir(spark, "snapshot-store"), D.patches(spark, d)
    for part in (1, 0, 2, 1):
        snapshots.apply(patches.filter(F.col("seq") % 3 == part), path)
    return snapshots.snapshots(snapshots.read(spark, path), FIELDS, DEFAULTS)


def _staged(df: DataFrame, name: str, files: int = 4) -> str:
    """A folder with the rows in about so many files, by time: an inbox for a stream."""
    path = shared_dir(df.sparkSession, name)
    df.repartitionByRange(files, "ts", "event_id").write.parquet(path)
    return path


def _frames(spark, inbox: str) -> DataFrame:
    events = spark.readStream.schema("session_id long, event_id long, ts timestamp_ntz, stage string, percent long").option("maxFilesPerTrigger", 1).parquet(inbox)
    return sink.frames_of(events, ["event_id", "stage", "percent"])


def _events(spark, d) -> DataFrame:
    return D.progress(spark, d).select("session_id", "event_id", "ts", "stage", "percent")


def _read_back(spark, path: str) -> DataFrame:
    return progress.parse_frames(sink.read_frames(spark, path)).select("session_id", "event_id", "stage", "percent")


def event_sink(spark, d):
    """All events, streamed into files of frames and parsed back."""
    inbox, out = _staged(_events(spark, d), "events"), shared_dir(spark, "frames")
    sink.started(_frames(spark, inbox), out, shared_dir(spark, "progress")).awaitTermination()
    return _read_back(spark, out)


def resumed_sink(spark, d):
    """The same by a stream that was stopped inside its second batch, after the write, and taken up again."""
    inbox, out, state = _staged(_events(spark, d), "events"), shared_dir(spark, "frames"), shared_dir(spark, "progress")
    write = sink.once(out)

    def lost(batch: DataFrame, number: int) -> None:
        write(batch, number)
        if number == 1:
            raise InterruptedError("stopped before the commit")

    first = sink.started(_frames(spark, inbox), out, state, sink=lost)
    try:
        first.awaitTermination()
    except Exception as e:
        if "stopped before the commit" not in str(e):
            raise
    sink.started(_frames(spark, inbox), out, state).awaitTermination()
    return _read_back(spark, out)


#: When subscriptions that the stream does not know at first come in.
TURN = "2024-01-16 00:00:00"


def delivered_events(spark, d):
    """The events that subscribers get, streamed in two parts; the second part's subscriptions come in between."""
    actions, events = D.subscriptions(spark, d), _events(spark, d)
    log, inbox, out, state = (shared_dir(spark, x) for x in ("actions", "events", "delivered", "progress"))
    early = lambda c: F.col(c) < F.lit(TURN).cast("timestamp_ntz")
    for part in (lambda c: early(c), lambda c: ~early(c)):
        actions.filter(part("at")).write.mode("append").parquet(log)
        events.filter(part("ts")).repartitionByRange(2, "ts", "event_id").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        sink.started(stream, out, state, sink=subscriptions.delivery(out, log)).awaitTermination()
    kept = "subscriber long, session_id long, event_id long, ts timestamp_ntz, stage string, percent long, batch long"
    return spark.read.schema(kept).option("basePath", out).parquet(out).select("subscriber", "session_id", "event_id", "stage")


def landed_uploads(spark, d):
    """The pages as uploads, landed from files in two goes: what was refused and why, and where the others are."""
    inbox, store, state = (shared_dir(spark, x) for x in ("inbox", "store", "progress"))
    uploads = D.uploads(spark, d)
    for part in (0, 1):
        uploads.filter(F.col("page_id") % 2 == part).drop("page_id").write.mode("append").parquet(inbox)
        landing.land(spark, inbox, store, state, files_per_batch=8, most=D.MOST_UPLOAD)
    return landing.landed(spark, store).select("session_id", "kind", "name", "error", "mime", "size", "stored_path", F.sha2("content", 256).alias("content_sha256"))


def page_lookup(spark, d):
    """What requests for pages are answered with, through the three stores."""
    pages, sessions, patches, requests = D.page_stores(spark, d)
    paths = [shared_dir(spark, x) for x in ("pages", "sessions", "snapshots")]
    lookup.stored(pages, paths[0])
    lookup.stored(sessions, paths[1])
    snapshots.apply(patches, paths[2])
    return lookup.found_pages(requests, *paths).select("session_id", "kind", "page", "status", "location", "error").distinct()


def blob_files(spark, d):
    """The pages as files below ten sessions; two sessions are deleted, the others read back."""
    root = shared_dir(spark, "blobs")
    pages = D.table(spark, d, "pages")
    blobs.write_texts(pages.select((F.col("page_id") % 10).cast("string").alias("session_id"), F.concat(F.lit("p "), F.col("page_id").cast("string")).alias("file_id"), F.col("html").alias("text")), root)
    for gone in (3, 7):
        blobs.delete_prefix(spark, root, gone)
    return blobs.read_blobs(spark, root, "session_id", "file_id", "length", F.sha2("content", 256).alias("content_sha256"))


def wrapped_text(spark, d):
    """The lines that every document's text is broken into."""
    lines = D.table(spark, d, "documents").select("doc_id", wrapped(F.col("text")).alias("lines"))
    return lines.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.array_max(F.transform("lines", F.length)).cast("long").alias("longest"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha256"))


#: Orders of a file, and every how many-th file breaks off.
ORDERS_OF_FILE, BROKEN = 500, 7


def nested_orders(spark, d):
    """Orders with their lines as indented JSON lists, read with a schema and made flat; files that break off are left out."""
    path, parts = shared_dir(spark, "nested"), D.parts(spark, d)
    # Both sides are dealt by file, once; a session is in one file.
    spark.conf.set(ALL_KEYS, "false")
    of_file = lambda key: F.floor(F.col(key) / ORDERS_OF_FILE).alias("file")
    lines = D.table(spark, d, "lineitem").select(of_file("l_orderkey"), F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("long").alias("number"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("label"))
    placed = D.table(spark, d, "orders").select(of_file("o_orderkey"), F.col("o_orderkey").alias("session_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"))
    placed = dealt_by(placed, "file", parts).hint("merge")
    records = nested.records(nested.numbered(dealt_by(lines, "file", parts)).join(placed, ["file", "session_id"]))
    nested.write_lists(records, path, F.col("file"), F.col("file") % BROKEN == 3)
    return nested.flat(nested.read_lists(spark, path))


def question_records(spark, d):
    """The questions that readers of pages returned."""
    q = extraction.questions_of(D.question_documents(spark, d))
    return q.select("session_id", "question_id", "place", F.col("order").alias("sort_key"), "label", "text", "page", "marks", F.col("region")["page"].alias("region_page"), F.col("region")["y"].alias("region_y"), "low_confidence")


def answer_records(spark, d):
    """The answers that readers of pages returned."""
    a = extraction.answers_of(D.answer_documents(spark, d))
    return a.select("session_id", "answer_id", "sequence_index", "canonical", "text", "page", F.size("boxes").cast("long").alias("n_boxes"), F.get("boxes", F.lit(0))["page"].alias("box_page"), "contains_diagram", "contains_table", "crossed_out", "low_confidence")


def run_fractions(spark, d):
    """Text runs as fractions of their page."""
    r = geometry.run_fractions(D.placed_runs(spark, d))
    e9 = lambda c: F.floor(F.col(c) * 1_000_000_000 + 0.5).cast("long").alias(f"{c}_e9")
    return r.select("l_orderkey", "l_linenumber", "l_suppkey", "text", e9("x"), e9("y_top"), e9("y_bottom"), e9("width"))


def word_fractions(spark, d):
    """Boxes of words in pixels as fractions of their image."""
    s, n = F.col("l_suppkey") % 100, F.col("l_linenumber")
    words = D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", s.alias("x0"), (n * 10).alias("y0"), (s + F.floor("l_quantity")).alias("x1"), (n * 10 + 8).alias("y1"), F.lit(256).alias("image_width"), F.lit(128).alias("image_height"))
    return geometry.word_fractions(words)


def box_style(spark, d):
    """Boxes as a style sheet has them."""
    a = D.answers(spark, d).withColumn("w", F.lit(0.5))
    x, y, w, h = (F.floor(F.col(c) * 64) / 64.0 for c in "xywh")
    return a.select("session_id", "answer_id", *geometry.css(x, y, w, h))


def file_pages(spark, d):
    """Pages of each session's sheet, by its file and by its answers."""
    files = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") % 4).alias("page_count"))
    return geometry.page_counts(D.answers(spark, d), files)


def history_showing(spark, d):
    """What the second page of each owner's history says that it shows."""
    return history.showing(D.history(spark, d), 2)


def guarded_matches(spark, d):
    """What a matcher said, guarded: its index among seven candidates, and its confidence."""
    k = F.get_json_object("props", "$.k").cast("double") / 4
    said = F.when(F.col("event_id") % 9 != 0, F.col("value") / 100 - 0.25)
    return D.table(spark, d, "events").select("event_id", scoring.guarded_index(k, F.lit(7)).alias("index"), scoring.clamp01(said).alias("confidence"))


QUERIES = {f.__name__: f for f in (question_records, answer_records, run_fractions, word_fractions, box_style, file_pages, history_showing, guarded_matches, call_spacing, call_backoff, session_snapshots, snapshot_store, event_sink, resumed_sink, delivered_events, landed_uploads, page_lookup, blob_files, wrapped_text, nested_orders)}
