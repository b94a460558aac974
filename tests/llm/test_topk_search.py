import math
import random

from tandem.llm import topk_search as S


def brute_force(rows, asked, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(256 * x) for x in v]

    rows = [(i, w) for i, v in rows if i is not None and (w := whole(v))]
    out = []
    for q_id, v in asked:
        if (q := whole(v)) is None:
            continue
        scores = sorted((-sum(a * b for a, b in zip(q, w)), i) for i, w in rows if i != q_id and len(w) == len(q))
        out += [(q_id, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, asked, k=5):
    schema = "vec_id long, embedding array<double>, label int"
    make = lambda x: spark.createDataFrame([(*r, 1) for r in x], schema)
    return sorted(map(tuple, S.top_k(make(rows), make(asked), k).collect()))


def test_ties_nulls_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP", 60)
    monkeypatch.setattr(S, "CHUNK", 10)
    rng = random.Random(1)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(301, None), (302, [1.0, None, 1.0, 1.0]), (303, [float("nan")] * 4), (304, [float("inf")] * 4), (305, []), (306, [1.0, 2.0]), (307, [2.0, 2.0]), (None, [1.0] * 4)]
    rows += [(400 + i, [0.7, 0.7, 0.7, 0.7]) for i in range(100)]
    asked = [r for r in rows if r[0] is not None and (r[0] % 10 == 0 or r[0] > 300)]
    assert run(spark, rows, asked) == brute_force(rows, asked, 5)


def test_numbers_beyond_doubles(spark):
    rows = [(i, [3e6 + i, 3.0, -1e5 * i]) for i in range(20)]
    assert run(spark, rows, rows[:3], 4) == brute_force(rows, rows[:3], 4)


def test_pruning_skips_blocks_and_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 50)
    monkeypatch.setattr(S, "GROUP", 200)
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.1) + 4 * (j == i // 250) for j in range(8)]) for i in range(2000)]
    asked = rows[::100]
    assert run(spark, rows, asked) == brute_force(rows, asked, 5)
    make = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>")
    told = S.pruning(make(rows), make(asked)).first()
    assert told.pairs >= 20 * 40 and told.scored < 0.3 * told.pairs


def test_rows_that_share_an_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, []), (5, [])]
    got = run(spark, rows, [(2, [0.5, 0.5]), (4, [])], 3)
    assert got == [(2, 1, 3, 256 * 256), (2, 2, 3, 256 * 256), (2, 3, 1, 128 * 256), (4, 1, 5, 0)]


def test_empty(spark):
    assert run(spark, [], []) == [] and run(spark, [(1, [1.0])], [(1, [1.0])]) == []
