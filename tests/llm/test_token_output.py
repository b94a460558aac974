import random
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tandem.llm import token_output as T
from tandem.llm import vocabularies as V
from tandem.llm._shared import shared_dir

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start long, n_tokens long"


def reference(rows):
    t = Tokenizer.from_file(VOCABULARY)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, ids))
        start += len(ids)
    return out


def written(spark, rows, block_ids=200):
    docs = spark.createDataFrame([(*r, 7, 7) for r in rows], SCHEMA)
    path = shared_dir(spark, "test")
    T.write_token_shards(docs, path, VOCABULARY, block_ids=block_ids)
    return path


def test_round_trip_with_hard_cases(spark):
    base = "The cat, the cat and\nthe dog's <|endoftext|> Éàß  \t\x1c 1234 !\n\n"
    rows = [(3, base * 30), (1, ""), (2, None), (None, "null id"), (5, "same"), (5, "same"), (9, "a" * 5000), (4, " \n "), (8, "é x y")]
    path = written(spark, rows)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in T.read_token_shards(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == reference(rows)


def test_random_access_and_savings(spark):
    rows = [(i, f"word{i % 3} and the common phrase of these pages " * 40) for i in range(12)]
    path = written(spark, rows, block_ids=10_000)
    want = {d: ids for d, _, ids in reference(rows)}
    seen = 0
    for b in spark.read.parquet(path).collect():
        block = b.asDict()
        assert len(block["symbols"]) // 4 < block["n_tokens"] // 4
        for k, doc_id in enumerate(block["doc_ids"]):
            for start, length in ((0, 5), (17, 40), (len(want[doc_id]) - 3, 3), (0, len(want[doc_id]))):
                assert T.decode_range(block, k, start, length).tolist() == want[doc_id][start : start + length]
                seen += 1
    assert seen == 48


def test_empty_table(spark):
    path = written(spark, [])
    assert T.read_token_shards(spark, path).count() == 0


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    import zlib

    want = [(d, s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, s, i in reference(rows)]
    assert sorted(map(tuple, T.op1_grammar_token_output(spark, sf).collect())) == want


#: Letters of either case, composed and not, marks that compose with one case only, contractions, control strings, runs of punctuation, white space.
PARTS = [*"aJzKHTWYAéÉßÿŸÀ×÷ÞñÑİıſKÅΣς中한1٣²", *"\u0301\u030c\u0331\u0308\u0338\u0591\u0327\u0345", *".,'’-_(&~<>|=\"ªº\u200d\x00", *" \n\t\r\x1c\x85\xa0\u2028", "  ", "word", "Word", "'s", "'RE", "'ll", "''", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "</w>", "\U0001f600"]


def test_finer_chunks_against_the_library():
    library, encoder, rng = Tokenizer.from_file(VOCABULARY), V.ChunkEncoder(V.load(VOCABULARY)[1], True, 1 << 16), random.Random(5)
    assert encoder.words
    for _ in range(30):
        texts = [None if rng.random() < 0.02 else "".join(rng.choices(PARTS, k=rng.randrange(0, 14))) for _ in range(300)]
        ids, lengths = encoder.ids(V.pc.fill_null(pa.array(texts, pa.string()).slice(rng.randrange(3)), ""))
        own = np.split(ids, np.cumsum(lengths)[:-1])
        for text, got in zip(texts[-len(own) :], own):
            assert got.tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_capitals_of_finer_chunks_compose_with_combining_marks_alone():
    small = [*map(chr, range(0xC0, 0x100)), *map(chr, range(128))]
    for c in map(chr, range(0x110000)):
        pair = unicodedata.decomposition(c).split()
        if len(pair) == 2 and pair[0][0] != "<" and chr(int(pair[0], 16)) in small:
            assert 0x300 <= int(pair[1], 16) < 0x370


def test_spellings_of_a_word_are_one_chunk():
    encoder = V.ChunkEncoder(V.load(VOCABULARY)[1], True)
    words = [a + b + c for a in ("ker", "mél", "sto") for b in "aeiou" for c in ("", "nd", "ß")]
    encoder.ids(pa.array([" ".join(["so", *(x for w in words for x in (w, w.capitalize(), w.upper().replace("SS", "ß"), w + ",", w + ".\n", w + "-", f"{w}'s"))])]))
    assert len(encoder.young.number) < 2 * len(words) + 10


def test_expansion_of_every_rule_and_of_copies():
    rng = np.random.default_rng(3)
    for n, kinds in ((1, 1), (2, 1), (700, 1), (900, 2), (5000, 9), (4000, 4000), (300, 40)):
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        lengths = np.diff([0, *np.unique(rng.integers(1, n, 5) if n > 1 else []).astype(int), n])
        s, left, right, size, doc_symbols = T.compress(ids, lengths)
        assert T.expand(s, left, right, size).tolist() == ids.tolist() == T._opened(s, left, right).tolist()
        assert len(doc_symbols) == len(lengths)
        # More than one rule holds: they are opened for themselves; each rule twice: they are copied.
        every = np.arange(T.BASE, T.BASE + len(left), dtype=np.uint32)
        assert len(T.expand(every[:1], left, right, size)) == size[:1].sum()
        assert T.expand(np.tile(every, 2), left, right, size).tolist() == 2 * T._opened(every, left, right).tolist()
