import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tandem.llm import byte_bpe as B
from tandem.llm.vocabularies import load

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TREE, WHOLE = (B.TreeBpe(load(PATH)[1], P.PATTERN, cut) for cut in (True, False))


def ids(text):
    return np.frombuffer(TREE.encode_many([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abeinrst  \n\n\t'sAÉéßü१ж中😀\xa0\x1c.!1 ")), max_size=60))
def test_same_as_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert TREE.decode(TREE.encode_many([text])[0]) == text.encode()
    assert WHOLE.encode_many([text]) == TREE.encode_many([text])


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("theinaroust")), max_size=120), st.integers(0, 120))
def test_join_at_any_place(word, cut):
    a, b = TREE.tree(word[:cut].encode()), TREE.tree(word[cut:].encode())
    assert [RANKS[t] for t in TREE.join(a, b)] == LIBRARY.encode_ordinary(word) or word.encode() in RANKS


def test_long_match_without_blanks():
    text = "thequickbrownfox" * 3000 + " " * 5000 + "ab" * 2000
    assert ids(text) == LIBRARY.encode_ordinary(text)


def test_rows(spark):
    rows = [(1, "A cat's\n\n hat"), (2, None), (3, ""), (None, "x"), (1, "A cat's\n\n hat")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n_tokens long")
    got = B.encode_documents(docs, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, bytes(r.decoded)) for r in got) == sorted((d or 0, len(LIBRARY.encode_ordinary(t or "")), (t or "").encode()) for d, t in rows)
    assert B.encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        i = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, B.op4_tree_bpe(spark, sf).collect())) == sorted(want)
