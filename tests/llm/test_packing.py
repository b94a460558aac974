import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tandem.llm import packing as P

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, doc_tokens, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset, capacity in pieces:
        by_doc[doc].append((start, n))
        by_sequence[sequence].append((offset, n, capacity))
    for doc, n in enumerate(doc_tokens):
        at = 0
        for start, own in sorted(by_doc[doc]):
            assert start == at
            at += own
        assert at == n
    for own in by_sequence.values():
        at = 0
        for offset, n, capacity in sorted(own):
            assert offset == at
            at += n
        assert at == own[0][2] <= length and capacity & (capacity - 1) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60))
def test_each_id_once_and_no_padding(doc_tokens):
    check(P.pack(doc_tokens), doc_tokens, P.LENGTH)


def test_costs_are_balanced():
    rng = np.random.default_rng(1)
    doc_tokens = rng.integers(1, 700, 2000).tolist()
    cost = defaultdict(float)
    for _, _, n, sequence, _, capacity in P.pack(doc_tokens):
        if capacity == P.LENGTH:
            cost[sequence] += P.LINEAR * n + P.QUADRATIC * n * n
    values = np.array(list(cost.values()))
    order = rng.permutation(2000)
    serial, row = [], []
    for n in np.array(doc_tokens)[order]:  # documents end to end, as they come
        while n:
            take = min(n, P.LENGTH - sum(row))
            row.append(take)
            n -= take
            if sum(row) == P.LENGTH:
                serial.append(sum(P.LINEAR * x + P.QUADRATIC * x * x for x in row))
                row = []
    assert values.std() < 0.5 * np.std(serial)


def test_pieces_are_the_librarys_ids(spark):
    t = Tokenizer.from_file(VOCABULARY)
    base = "The cat's hat,\nthe  cat <|endoftext|>\n\n Éàß\t\x1c \x0b 12 34　x \r\n!?"
    rows = [(1, base), (2, ""), (3, None), (None, "no id"), (4, "plain words\nof a text. Then more' s"), (5, "x" * 9000), (6, base * 300), (6, "same id"), (7, " lead"), (8, "\nlead\n"), (9, "é ́a ü\ńb")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, length long, ids string")
    found = defaultdict(list)
    for r in P.pack_documents(docs, VOCABULARY, unit_tokens=3000).collect():
        found[(r.doc_id, r.doc_tokens)].append((r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()))
    want = {}
    for doc_id, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want[(doc_id, len(ids))] = ids
    assert {k: [i for _, _, ids in sorted(v) for i in ids] for k, v in found.items()} == want


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = P.op7_cost_balanced_packing(spark, sf).toPandas()
    t = Tokenizer.from_file(VOCABULARY)
    ids = {r.doc_id: np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(got.doc_id) == set(ids)
    for r in got.itertuples():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    filled = got.groupby("sequence_id").agg(n=("length", "sum"), c=("capacity", "first"))
    assert (filled.n == filled.c).all()


def test_empty_table(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
