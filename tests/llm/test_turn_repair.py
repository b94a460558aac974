"""Turn repair against a search over whole edit sequences."""

import hashlib
import heapq
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tandem.llm import turn_repair

SPACE = " \t\n\x0b\x0c\r"
LEGAL = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
TURNS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, letters, faults, repaired rows): the first complete sequence in order of cost and letters."""
    seen, faults = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, before, out = heapq.heappop(heap)
        if (i, before) in done:
            continue
        if i == len(rows) and before in ("", "a"):
            return cost, letters, faults, out
        done.add((i, before))
        for initial, name in (("u", "user"), ("a", "assistant")):
            if (before, initial) in LEGAL:
                heapq.heappush(heap, (cost + 3, letters + "I", i, initial, (*out, (name, ""))))
        if i == len(rows):
            continue
        (role, text), more = rows[i], 3 * (faults[i] == "truncated")
        heapq.heappush(heap, (cost + 4, letters + "D", i + 1, before, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        if (before, role[:1]) in LEGAL:
            heapq.heappush(heap, (cost + more, letters + "K", i + 1, role[0], (*out, (role, text))))
        for initial, name in (("u", "user"), ("a", "assistant")):
            if (before, initial) in LEGAL:
                heapq.heappush(heap, (cost + 3 + more, letters + "R", i + 1, initial, (*out, (name, text))))


def expected(conv_id, rows):
    """The result row of (turn, role, text) rows without nulls but of turns."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32], hashlib.sha256(r[2].encode()).digest()))
    cost, letters, faults, out = cheapest([r[1:] for r in rows])
    known = [r[0] for r in rows if r[0] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (conv_id, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, digest)


def hurt(rows):
    """Rows after the damage that the query does."""
    for conv_id, turn, role, text in rows:
        shown = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{shown(conv_id)}:{shown(turn)}".encode()) % 20, shown(role), shown(text)
        if kind:
            row = (conv_id, turn, "user" if kind == 4 else role, "" if kind == 1 else text.translate({46: None, 33: None, 63: None}) if kind == 2 else text)
            yield from [row] * (2 if kind == 3 else 1)


def results(turns):
    conversations, rows = turn_repair.repaired(turns)
    a = {r[0]: tuple(r) for r in conversations.collect()}
    b = {r[0]: r[1] for r in turn_repair.digests(rows, "d").collect()}
    return {k: (*v, b.get(k, hashlib.sha256().hexdigest())) for k, v in a.items()}


def by_conversation(rows):
    out = {}
    for conv_id, *row in rows:
        out.setdefault(conv_id, []).append(tuple(row))
    return {k: expected(k, v) for k, v in out.items()}


def generated(seed, conversations, most):
    rnd = random.Random(seed)
    texts = ["a.", "b!", "c?", "", " \t", "open", "x" * 40 + ".", "x" * 40 + "y."]
    return [
        (c, rnd.choice([None, *range(6)]), rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "umpire"]), rnd.choice([*texts, f"{rnd.random()}."]))
        for c in [None, *range(conversations)]
        for _ in range(rnd.randint(1, most))
    ]


def test_walks_equal_the_search(spark):
    rows = generated(1, 150, 9)
    assert results(spark.createDataFrame(rows, TURNS)) == by_conversation(rows)


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", 2)
    rows = generated(2, 30, 25)
    assert results(spark.createDataFrame(rows, TURNS).repartition(5)) == by_conversation(rows)


def test_a_long_conversation_goes_through_many_blocks(spark):
    rows = [(1, i, "system" if i % 977 == 0 else "user" if i % 2 else "assistant", f"{i}{'.' if i % 5 else ''}") for i in range(15_000)] + [(2, 0, "user", "hi."), (2, 1, "assistant", "yes.")]
    df = spark.createDataFrame(rows, TURNS)
    blocks = turn_repair.blocks_of(turn_repair.placed_rows(df)).filter("conv_id = 1").collect()
    assert len(blocks) >= 4 and max(len(b.codes) for b in blocks) <= 1 << turn_repair.BLOCK_BITS
    got = results(df)
    assert got == by_conversation(rows) and got[2][6:8] == (0, "KK")


def test_whole_table_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = list(zip(*[pq.read_table(f"{sf}/conversations.parquet")[c].to_pylist() for c in ("conv_id", "turn", "role", "text")]))
    want = by_conversation(hurt(rows))
    for c in {r[0] for r in rows} - want.keys():
        want[c] = (c, *[0] * 6, "", hashlib.sha256().hexdigest())
    got = {r[0]: tuple(r) for r in turn_repair.op12_tight_arc_repair(spark, sf).collect()}
    assert got == want and sum(r[6] > 0 for r in got.values()) > 20


def test_nulls_and_other_columns(spark, tmp_path):
    rows = [(None, None, None, None, "x"), (None, 1, "user", "a.", "x"), (5, None, "user", None, "y"), (7, 3, "assistant", "b.", "y")]
    df = spark.createDataFrame(rows, TURNS + ", pos string").withColumn("code", F.lit(1)).withColumn("block", F.lit(2))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    plain = [tuple(r[:4]) for r in rows]
    want = by_conversation(hurt(plain))
    got = {r[0]: tuple(r) for r in turn_repair.op12_tight_arc_repair(spark, str(tmp_path)).collect()}
    assert got == {k: want.get(k, (k, *[0] * 6, "", hashlib.sha256().hexdigest())) for k in (None, 5, 7)}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert turn_repair.op12_tight_arc_repair(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("codes", ["", "AB", "DEFG"])
def test_edges_of_blocks(codes):
    m = turn_repair.matrix(codes)
    assert all(m[5 * s] >= 0 for s in range(4)) and len(m) == 16


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "user", "q."), (1, 2, "user", "again."), (1, 3, "assistant", "yes.")]
    _, out = turn_repair.repaired(spark.createDataFrame(rows, TURNS))
    got = [(r.role, r.text, r.edit) for r in out.orderBy("pos", "sub").collect()]
    assert got == [("user", "", "I"), ("assistant", "hello.", "K"), ("user", "q.", "K"), ("assistant", "", "I"), ("user", "again.", "K"), ("assistant", "yes.", "K")]


def test_sql_gives_the_same(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{sf}/conversations.parquet'")
    want = con.sql(turn_repair.ORACLE)
    got = turn_repair.op12_tight_arc_repair(spark, sf).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
