"""Lookups with fallbacks, blobs in a folder, nested JSON."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tandem.operators import lookup, snapshots
from tandem.sources import blobs, nested

REQUESTS = "request_id long, session_id long, kind string, page string"


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("stores"))
    lookup.stored(spark.createDataFrame([(s, k, p, f"img/{s}/{k}/{p}") for s in range(0, 60, 3) for k in lookup.KINDS for p in (1, 2)], "session_id long, kind string, page long, url string"), f"{root}/pages")
    sessions = [(s, "answerSheet", f"mem/{s}") for s in range(0, 60, 2)] + [(s, "questionPaper", None) for s in range(0, 60, 4)]
    lookup.stored(spark.createDataFrame(sessions, "session_id long, kind string, stored_path string"), f"{root}/sessions")
    patches = [(s, None, s, json.dumps({"answerSheet": {"storedPath": f"blob/{s}"}, "questionPaper": None if s % 5 == 0 else {"storedPath": f"paper/{s}"}})) for s in range(60) if s % 7]
    snapshots.apply(spark.createDataFrame(patches, "session_id long, at timestamp_ntz, seq long, patch string"), f"{root}/snapshots")
    return root


def looked_up(s, kind, page):
    if kind not in lookup.KINDS:
        return 400, None, lookup.BAD_KIND
    try:
        n = float(int(page, 16)) if page.strip().lower().startswith("0x") else float(page)
    except (TypeError, ValueError, AttributeError):
        n = 0
    if n < 1 or n != int(n):
        return 400, None, lookup.BAD_PAGE
    if s is not None and s < 60:
        if s % 3 == 0 and n in (1, 2):
            return 302, f"img/{s}/{kind}/{int(n)}", None
        if s % 2 == 0:
            found = f"mem/{s}" if kind == "answerSheet" else None
        else:
            found = (f"blob/{s}" if kind == "answerSheet" else None if s % 5 == 0 else f"paper/{s}") if s % 7 else None
        if found:
            return 302, found, None
    return 404, None, lookup.NOT_FOUND


def test_chain(spark, stores):
    pages = ["1", "2", "3", " 2.0 ", "1e0", "0x2", "1.5", "0", "-1", "", "x", None]
    rows = [(i, s, k, p) for i, (s, k, p) in enumerate((s, k, p) for s in (*range(62), None) for k in ("questionPaper", "answerSheet", "cover", None) for p in pages)]
    out = lookup.found_pages(spark.createDataFrame(rows, REQUESTS), *(f"{stores}/{x}" for x in ("pages", "sessions", "snapshots")))
    got = {r.request_id: (r.status, r.location, r.error) for r in out.collect()}
    assert got == {i: looked_up(s, k, p) for i, s, k, p in rows} and len({v[:1] for v in got.values()}) == 3


def test_only_partitions_of_open_keys_are_read(spark, tmp_path):
    path = str(tmp_path / "pages")
    lookup.stored(spark.createDataFrame([(s, "answerSheet", 1, f"img/{s}") for s in range(60)], "session_id long, kind string, page long, url string"), path)
    keys = spark.createDataFrame([(6, "answerSheet"), (9, "answerSheet")], "session_id long, kind string")
    wanted = {r.b for r in keys.select(snapshots.bucket(F.col("session_id")).alias("b")).collect()}
    files = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")]
    others = [f for f in files if int(f.split("bucket=")[1].split("/")[0]) not in wanted]
    for f in others:
        with open(f, "wb") as out:
            out.write(b"not to be read")
    rows = lookup.of_open(spark, path, lookup.PAGES, keys)
    assert {6, 9} <= {r.session_id for r in rows.collect()} and len(others) > 10
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # Without open keys a store is not read at all.
    assert lookup.of_open(spark, path, lookup.PAGES, keys.limit(0)).collect() == []


def test_no_requests(spark, stores):
    out = lookup.found_pages(spark.createDataFrame([], REQUESTS), *(f"{stores}/{x}" for x in ("pages", "sessions", "snapshots")))
    assert out.collect() == []


def test_blobs_come_back_and_go_by_prefix(spark, tmp_path):
    root = str(tmp_path / "blobs")
    texts = {(s, f"{f}.html"): f"<p>é {s}\n{f}</p>\r\n" * (f + 1) for s in ("a", "a b", "c=d") for f in range(7)}
    texts["a", "empty"] = ""
    blobs.write_texts(spark.createDataFrame([(*k, v) for k, v in texts.items()], "session_id string, file_id string, text string"), root)
    read = lambda: {(r.session_id, r.file_id): (r.length, bytes(r.content)) for r in blobs.read_blobs(spark, root).collect()}
    assert read() == {k: (len(v.encode()), v.encode()) for k, v in texts.items()}
    assert blobs.delete_prefix(spark, root, "a", most=3) == 8
    assert read() == {k: (len(v.encode()), v.encode()) for k, v in texts.items() if k[0] != "a"}
    assert blobs.delete_prefix(spark, root, "a", most=3) == 0 and blobs.delete_prefix(spark, root, "none") == 0
    blobs.write_texts(spark.createDataFrame([("a b", "1.html", "new")], "session_id string, file_id string, text string"), root)
    assert read()["a b", "1.html"] == (3, b"new") and len(read()) == 14


def test_deletion_lists_pages_of_keys(spark, tmp_path):
    root = str(tmp_path / "blobs")
    blobs.write_texts(spark.createDataFrame([("s", f"{i}", "x") for i in range(10)], "session_id string, file_id string, text string"), root)
    first = blobs.keys_below(spark, f"{root}/session_id=s", None, 4)
    second = blobs.keys_below(spark, f"{root}/session_id=s", first[-1], 4)
    assert len(first) == 4 and first == sorted(first) and second[0] > first[-1] and not set(first) & set(second)


def test_nested_lists(spark, tmp_path):
    path = str(tmp_path / "json")
    rows = [(s, p, f"d{s}", n, n / 2, None if n == 2 else f'l"{n}\n') for s in range(9) for p in (0, 1) for n in range(3)]
    lines = spark.createDataFrame(rows, "session_id long, part long, placed string, number long, quantity double, label string")
    nested.write_lists(nested.records(lines), path, F.floor(F.col("session_id") / 3), F.col("file") == 1)
    name = next(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-") and "file=0" in d)
    with open(name, encoding="utf-8") as f:
        text = f.read()
    assert len(json.loads(text)) == 6 and text.count("\n") > 20
    read = nested.read_lists(spark, path)
    assert sum(r._corrupt_record is not None for r in read.select("session_id", "_corrupt_record").collect()) == 1
    got = sorted((tuple(r) for r in nested.flat(read).collect()), key=str)
    assert got == sorted(((s, d, n, q, x) for s, _, d, n, q, x in rows if s // 3 != 1), key=str)


def test_lines_of_large_sessions_are_numbered_into_parts(spark):
    rows = [(0, s, n, 1.0, "a") for s, size in ((1, 2 * nested.MOST_LINES + 3), (2, nested.MOST_LINES), (3, 1)) for n in range(size)]
    got = nested.numbered(spark.createDataFrame(rows, "file long, session_id long, number long, quantity double, label string").orderBy("label", F.desc("number")))
    assert {(r.session_id, r.number): r.part for r in got.collect()} == {(s, n): n // nested.MOST_LINES for _, s, n, _, _ in rows}


def test_folders_are_listed_some_to_a_task(spark, tmp_path):
    lines = spark.range(50).selectExpr("id as session_id", "0L as part", "'d' as placed", "1L as number", "1D as quantity", "'a' as label")
    nested.write_lists(nested.records(lines), str(tmp_path / "json"), F.col("session_id"))
    before = spark.conf.get(nested.LISTING)
    spark.sparkContext.setJobGroup("listing", "")
    assert nested.read_lists(spark, str(tmp_path / "json")).count() == 50 and spark.conf.get(nested.LISTING) == before
    status = spark.sparkContext.statusTracker()
    listing = min(status.getJobIdsForGroup("listing"))
    assert status.getStageInfo(status.getJobInfo(listing).stageIds[0]).numTasks <= 4 * spark.sparkContext.defaultParallelism < 50


def test_deletion_lists_keys_once(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "blobs")
    blobs.write_texts(spark.createDataFrame([("s", f"{i}", "x") for i in range(5)] + [("t", "0", "x")], "session_id string, file_id string, text string"), root)
    monkeypatch.setattr(blobs, "keys_below", lambda *_: pytest.fail("keys are listed page by page"))
    assert blobs.delete_prefix(spark, root, "s", most=2) == 5
    assert [(r.session_id, r.file_id) for r in blobs.read_blobs(spark, root).collect()] == [("t", "0")]


def test_files_pass_the_driver_a_bounded_number_at_a_time(spark, tmp_path, monkeypatch):
    """No write and no listing has more keys than a pass, whatever the number of files; the rest is as in one pass."""
    root, most = str(tmp_path / "blobs"), 16
    texts = {(s, f"{f} é"): f"{s}\n{f}" for s in ("a", "b c") for f in range(40)}
    wrote, listed, write, listing = [], [], blobs._write, blobs._listed
    monkeypatch.setattr(blobs, "KEYS_OF_PASS", most)
    monkeypatch.setattr(blobs, "_write", lambda files, path: wrote.append(files.count()) or write(files, path))
    monkeypatch.setattr(blobs, "_listed", lambda *a: listed.append(len(listing(*a).inputFiles())) or listing(*a))
    blobs.write_texts(spark.createDataFrame([(*k, v) for k, v in texts.items()], "session_id string, file_id string, text string"), root)
    assert len(wrote) > 1 and sum(wrote) == 80 and max(wrote) < 2 * most
    got = blobs.read_blobs(spark, root, "session_id", "file_id", "length", F.sha2("content", 256).alias("sha256"))
    want = spark.createDataFrame([(*k, len(v.encode()), v.encode()) for k, v in texts.items()], "session_id string, file_id string, length long, content binary")
    assert sorted(got.collect()) == sorted(want.select("session_id", "file_id", "length", F.sha2("content", 256).alias("sha256")).collect())
    assert len(listed) > 4 and sum(listed) == 80 and max(listed) <= most
    monkeypatch.setattr(spark.read.__class__, "load", lambda *_: pytest.fail("files are listed for a deletion"))
    assert blobs.delete_prefix(spark, root, "a") == 40
    monkeypatch.undo()
    assert {r.session_id for r in blobs.read_blobs(spark, root).collect()} == {"b c"}
    assert blobs.delete_prefix(spark, root, "b c") == 40 and blobs.read_blobs(spark, root).collect() == []
