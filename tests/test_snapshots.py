"""The snapshot store against dictionaries."""

import datetime
import json
import os
import random

from tandem.operators import snapshots

T = datetime.datetime(2024, 1, 1)
PATCHES = "session_id long, at timestamp_ntz, seq long, patch string"
FIELDS = {"stage": "string", "percent": "long", "error": "string", "parts": "string"}
DEFAULTS = {"stage": "idle"}


def generated(seed, n):
    rnd = random.Random(seed)
    value = {"stage": lambda: rnd.choice(["a", "b", None]), "percent": lambda: rnd.choice([1, 50, None]), "error": lambda: rnd.choice(["x", None, ""]), "parts": lambda: [rnd.randint(0, 9)]}
    rows = []
    for i in range(n):
        patch = {f: v() for f, v in value.items() if rnd.random() < 0.4}
        rows.append((rnd.choice([1, 1, 1, rnd.randint(2, 40)]), T + datetime.timedelta(minutes=rnd.randint(0, 30)), i, json.dumps(patch, separators=(",", ":"))))
    return rows


def updated(rows):
    """One patch after the other on a dictionary."""
    out = {}
    for session, at, _, patch in sorted(rows, key=lambda r: r[1:3]):
        own = out.setdefault(session, {"stage": "idle", "percent": None, "error": None, "parts": None, "created_at": at})
        try:
            given = json.loads(patch or "")
        except ValueError:
            continue
        own.update({k: json.dumps(v, separators=(",", ":")) if isinstance(v, list) else v for k, v in given.items()} if isinstance(given, dict) else {})
    return {s: (v["created_at"], v["stage"], v["percent"], v["error"], v["parts"]) for s, v in out.items()}


def shown(spark, path):
    return {r.session_id: (r.created_at, r.stage, r.percent, r.error, r.parts) for r in snapshots.snapshots(snapshots.read(spark, path), FIELDS, DEFAULTS).collect()}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_batches_in_any_order_and_again(spark, tmp_path):
    rows = [*generated(1, 300), (50, T, 1, "bad"), (51, T, 1, None), (52, T, 1, "[1]")]
    random.Random(2).shuffle(rows)
    path = str(tmp_path / "store")
    batches = [spark.createDataFrame(rows[i::3], PATCHES) for i in range(3)]
    for b in (0, 1, 0, 2, 1):
        snapshots.apply(batches[b], path)
    assert shown(spark, path) == updated(rows)
    once = sorted(map(tuple, snapshots.read(spark, path).collect()), key=str)
    snapshots.apply(batches[2], path)
    assert sorted(map(tuple, snapshots.read(spark, path).collect()), key=str) == once


def test_other_partitions_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "store")
    snapshots.apply(spark.createDataFrame(generated(3, 200), PATCHES), path)
    before = files(path)
    snapshots.apply(spark.createDataFrame([(1, T + datetime.timedelta(days=1), 999, '{"percent": 7}')], PATCHES), path)
    after = files(path)
    gone = {os.path.dirname(f) for f in before.keys() - after.keys()}
    assert len(gone) == 1 and len({os.path.dirname(f) for f in before}) > 10
    assert all(after[f] == before[f] for f in before if os.path.dirname(f) not in gone)
    assert shown(spark, path)[1][2] == 7


def test_a_batch_reads_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    snapshots.apply(spark.createDataFrame(generated(4, 50), PATCHES), path)
    plan = snapshots.read(spark, path).filter("bucket in (1, 2)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_explicit_null_and_later_null_id(spark, tmp_path):
    rows = [(1, T, 1, '{"error": "x", "stage": "a"}'), (1, T, 2, '{"error": null}'), (None, T, 3, '{"stage": "z"}'), (2, T, 4, "{}"), (2, T, 5, '{"": 1}')]
    path = str(tmp_path / "store")
    snapshots.apply(spark.createDataFrame(rows, PATCHES), path)
    assert shown(spark, path) == {1: (T, "a", None, None, None), 2: (T, "idle", None, None, None)}
