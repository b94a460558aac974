"""Hard negatives against brute force."""

import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

from tandem.llm import hard_negatives as H

ROWS = "vec_id long, embedding array<float>, label int"
LOW, HIGH = -(2**63), 2**63 - 1


def brute(rows, is_anchor):
    rows = [(i, [math.floor(256 * float(x)) for x in e], l) for i, e, l in rows if i is not None and e is not None and l is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a_id, a, a_label in {(i, tuple(e), l) for i, e, l in rows if is_anchor(i)}:
        scored = [(-min(max(sum(x * y for x, y in zip(a, e)), LOW), HIGH), i, l) for i, e, l in rows if len(e) == len(a)]
        for p, p_id, _ in sorted(x for x in scored if x[2] == a_label and x[1] != a_id)[:5]:
            near = sorted(x for x in scored if x[2] != a_label and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(a_id, p_id, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(near)]
    return sorted(out)


def generated(seed, n, dim=6, labels=4, copies=0.2):
    rnd = np.random.default_rng(seed)
    vectors = [np.float32(rnd.normal(size=dim)).tolist() for _ in range(n)]
    for i in range(n):
        if rnd.random() < copies:
            vectors[i] = vectors[0]
    return [(i, v, int(rnd.integers(labels))) for i, v in enumerate(vectors)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LEAF", 8), ("ANCHOR_LEAF", 4), ("LEAST_GROUP", 50), ("CHUNK", 10)):
        monkeypatch.setattr(H, name, value)


def mined(spark, rows, schema=ROWS):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(tuple(r) for r in H.mined(df, df.filter("vec_id % 10 = 0")).collect())


@pytest.mark.parametrize("labels", [2, 40])
def test_equals_brute_force(spark, small, labels):
    rows = generated(labels, 400, labels=labels)
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0) and len(got) > 100


def test_hard_rows(spark, small):
    nan, inf = float("nan"), float("inf")
    rows = [*generated(5, 120), (None, [1.0] * 6, 1), (200, None, 1), (210, [1.0] * 5 + [None], 1), (220, [nan] * 6, 1), (230, [inf] * 6, 1), (240, [1.0] * 6, None), (250, [], 1), (251, [], 1), (252, [], 2), (260, [1.0, 2.0], 1), (261, [2.0, 1.0], 1), (262, [1.0, 0.5], 3)]
    rows += [(20, [0.5] * 6, 1)] * 15 + [(7, [0.25] * 6, 2)] * 15 + [(30, [0.75] * 6, 3), (31, [1e12] * 6, 3), (32, [-3e9] * 6, 2), (33, [9e37] * 6, 1), (40, [5e37] * 6, 1), (41, [1e-30] * 6, 0)]
    got = mined(spark, rows)
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert {r[0] for r in got} >= {20, 30, 40, 250}


def test_other_columns_and_empty_tables(spark):
    schema = ROWS + ", part int, v string, n long"
    rows = [(*r, 1, "x", 2) for r in generated(1, 60)]
    assert mined(spark, rows, schema) == brute([r[:3] for r in rows], lambda i: i % 10 == 0)
    assert mined(spark, [], ROWS) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(10, [1.0], 1)]) == []


def tree(rows, leaf):
    ids, labels, m = np.array([r[0] for r in rows]), np.array([r[2] for r in rows]), np.floor(256 * np.array([r[1] for r in rows], dtype=float))
    parts = H.leaves(ids, labels, m, leaf)
    return H.Tree(pd.DataFrame({"leaf": range(len(parts)), "dim": m.shape[1], "ids": [ids[p] for p in parts], "labels": [labels[p] for p in parts], "v": [m[p].ravel() for p in parts]}))


def test_clusters_are_pruned():
    rnd = random.Random(1)
    centres = [[rnd.gauss(0, 10) for _ in range(8)] for _ in range(20)]
    rows = [(i, [x + rnd.gauss(0, 0.05) for x in centres[i % 20]], i % 4) for i in range(2_000)]
    a, c = tree(rows[:200], 10), tree(rows, 20)
    best, scored = H.positives_of_cell(a, c)
    pairs = len(a.leaf) * len(c.leaf)
    assert scored < pairs / 4
    ranges = []
    for leaf, b in enumerate(best):
        found = list(b.found())
        ranges.append((np.array([x[0] for x in found]), np.array([-(-3 * x[2] // 10) for x in found]), np.array([9 * x[2] // 10 for x in found])))
    _, scored = H.negatives_of_cell(a, c, ranges)
    assert scored < pairs / 3


def test_intervals_hold_all_products():
    rnd = np.random.default_rng(4)
    for scale in (1, 1e9, 1e30):
        a, c = (tree([(i, (rnd.normal(size=5) * scale).tolist(), 0) for i in range(40)], 10) for _ in range(2))
        for x in a.nodes:
            for y in c.nodes:
                low, high = H.interval(x, y)
                products = np.vstack(a.m[x[0] : x[1]]) @ np.vstack(c.m[y[0] : y[1]]).T
                assert low <= products.min() and products.max() <= high


def test_whole_table_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    table = con.sql("FROM embeddings").fetchall()
    got = sorted(tuple(r) for r in H.op13_dual_tree_negatives(spark, sf).collect())
    assert got == sorted(con.sql(H.ORACLE).fetchall())
    assert got == brute([(i, e, (l + 1) % 10 if i % 7 == 0 else l) for i, e, l in table], lambda i: i % 100 == 0) and got
