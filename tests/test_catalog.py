"""Each catalogue query against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tandem.operators import geometry, history
from tandem.plans import catalog, oracles
from tandem.streaming import progress

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, decimal.Decimal) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    want = sql.sql(oracles.ORACLES[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    a = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    b = sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())
    assert a == b


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(oracles.ORACLES)


def test_clipping_and_padding_by_hand(spark):
    boxes = spark.createDataFrame([(1, 1, "a", 0, 0.1, 0.10, 0.5, 0.20), (1, 1, "b", 1, 0.1, 0.25, 0.5, 0.10), (1, 1, "c", 2, 0.0, 0.36, 1.0, 0.64)], "session_id long, page long, answer_id string, seq long, x double, y double, w double, h double")
    h = {r.answer_id: round(r.h, 6) for r in geometry.clipped(boxes).collect()}
    assert h == {"a": 0.15, "b": 0.1, "c": 0.64}
    p = {r.answer_id: (round(r.left, 6), round(r.top, 6), round(r.bottom, 6)) for r in geometry.padded(geometry.clipped(boxes)).collect()}
    assert p["a"] == (0.09, 0.088, 0.25) and p["b"] == (0.09, 0.25, 0.355) and p["c"] == (0.0, 0.355, 1.0)


def test_boxes_without_height_are_padded_by_the_others(spark):
    boxes = spark.createDataFrame([(1, 1, "a", 0, 0.1, 0.1, 0.5, 0.1), (1, 1, "flat", 1, 0.1, 0.206, 0.5, 0.0), (2, 1, "alone", 0, 0.1, 0.5, 0.5, 0.0)], "session_id long, page long, answer_id string, seq long, x double, y double, w double, h double")
    p = {r.answer_id: (round(r.top, 6), round(r.bottom, 6)) for r in geometry.padded(boxes).collect()}
    assert p == {"a": (0.088, 0.203), "flat": (0.203, 0.218), "alone": (0.488, 0.512)}


def test_page_and_image_pixels(spark):
    df = spark.createDataFrame([(612.0, 792.0, 800, 1000), (595.2, 1684.0, 900, 950), (10.0, 20.0, 300, 1000)], "w double, h double, iw long, ih long")
    got = [(r.p.width, r.p.height, r.i) for r in df.select(geometry.page_pixels(df.w, df.h).alias("p"), geometry.image_pixels(df.iw, df.ih).alias("i")).collect()]
    assert got == [(1700, 2200, 1200), (778, 2200, 900), (28, 56, 1200)]


def test_history_keeps_the_newest(spark):
    rows = [(1, i, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), i) for i in range(25)]
    got = history.newest(spark.createDataFrame(rows, "owner long, session_id long, saved_at timestamp, percent long")).collect()
    assert sorted(r.session_id for r in got) == list(range(5, 25))


def test_progress_stream_equals_batch(spark, tmp_path):
    from tandem.sources import fixtures

    path = str(tmp_path / "events")
    events = fixtures.progress(spark, SF).drop("props")
    events.write.parquet(path)
    stream = spark.readStream.schema(events.schema).parquet(path)
    q = progress.latest(stream).writeStream.outputMode("complete").format("memory").queryName("latest_progress").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("latest_progress").collect())) == sorted(map(tuple, progress.latest(events).collect()))
