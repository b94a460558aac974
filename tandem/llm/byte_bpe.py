"""Byte-level BPE by a monoid tree: encode halves, join neighbours.

The ids of a byte string form a monoid: the ids of a concatenation follow from
the ids of its two parts. A string is halved down to single bytes; neighbours
are joined by re-encoding a window of tokens around the boundary, which grows
on a side until that side is stable. A sequence of tokens is what BPE makes of
its bytes exactly if each two neighbours, encoded together, stay the same two
tokens (a merge across a boundary would have to show between them first). So a
window is right as soon as its outer tokens are stable beside the tokens that
were left outside. Decoding concatenates the tokens' bytes up the same tree.

Merging follows ranks: of all adjacent pairs whose concatenation has a rank, the
lowest rank merges first, the leftmost on ties; a match of the pattern that is a
token as a whole is that token.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm._shared import BatchMemo, batches, per_worker, sliced, texts_of
from tandem.llm.vocabularies import load, spaced_chunks


#: Ids that a leaf of the decoding tree holds.
LEAF = 256


class TreeBpe:
    """Encoder and decoder for a file of ranks and a pattern of matches that are encoded separately.

    ``cut_at_blanks`` says that no match of the pattern reaches across the place
    before a single blank between other characters, nor depends on what is on
    the other side; texts are then encoded by such chunks, which repeat.
    """

    def __init__(self, content: bytes, pattern: str, cut_at_blanks: bool = False):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.pattern = regex.compile(pattern)
        self.cut_at_blanks = cut_at_blanks
        self.stable_pairs: dict = {}
        self.subtrees: dict = {}
        self.memo = BatchMemo(lambda chunks: [self._chunk(c) for c in chunks])

    # The monoid, on tuples of byte strings (tokens).

    def _merged(self, parts: list[bytes]) -> list[bytes]:
        """Merges by rank, for a window of few bytes."""
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stable(self, a: bytes, b: bytes) -> bool:
        """Whether tokens a, b stay as they are when their bytes are encoded together."""
        key = (a, b)
        found = self.stable_pairs.get(key)
        if found is None:
            if len(self.stable_pairs) > 500_000:
                self.stable_pairs.clear()
            whole = a + b
            found = self.stable_pairs[key] = self._merged([whole[i : i + 1] for i in range(len(whole))]) == [a, b]
        return found

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the concatenation of two encoded strings."""
        if not left or not right:
            return left or right
        if self._stable(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            window = b"".join(left[len(left) - i :] + right[:j])
            middle = self._merged([window[k : k + 1] for k in range(len(window))])
            left_ok = i == len(left) or self._stable(left[-i - 1], middle[0])
            right_ok = j == len(right) or self._stable(middle[-1], right[j])
            if left_ok and right_ok:
                return left[: len(left) - i] + middle + right[j:]
            i += not left_ok
            j += not right_ok

    def tree(self, match: bytes) -> list[bytes]:
        """Tokens of one match of the pattern; short subtrees are kept, as words share syllables."""
        if len(match) <= 1:
            return [match] if match else []
        found = self.subtrees.get(match)
        if found is None:
            half = len(match) // 2
            found = self.join(self.tree(match[:half]), self.tree(match[half:]))
            if len(match) <= 10:
                if len(self.subtrees) > 300_000:
                    self.subtrees.clear()
                self.subtrees[match] = found
        return found

    def match_ids(self, match: bytes) -> list[int]:
        whole = self.ranks.get(match)
        if whole is not None:
            return [whole]
        return [self.ranks[t] for t in self.tree(match)]

    def _chunk(self, chunk: str) -> bytes:
        return np.array([i for m in self.pattern.findall(chunk) for i in self.match_ids(m.encode())], "<u4").tobytes()

    # Texts: matches end before a single blank or line break between other characters.

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [spaced_chunks(text) if self.cut_at_blanks else [text] for text in texts]
        values = self.memo.values([c for own in split for c in own])
        out, at = [], 0
        for own in split:
            out.append(b"".join(values[at : at + len(own)]))
            at += len(own)
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids, concatenated up the tree of halves."""
        return self._concatenated(np.frombuffer(ids, "<u4").tolist())

    def _concatenated(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return b"".join(map(self.table.__getitem__, ids))
        half = len(ids) // 2
        return self._concatenated(ids[:half]) + self._concatenated(ids[half:])


def encoder(broadcast, pattern: str, cut_at_blanks: bool) -> TreeBpe:
    """The worker's encoder for a broadcast of ``load()``."""
    name, content = broadcast.value
    return per_worker(("tree", name, pattern, cut_at_blanks), lambda: TreeBpe(content, pattern, cut_at_blanks))


CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, cut_at_blanks: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian u32) and decoded (binary) of every row of ``docs``.

    A null or empty text has no ids; rows are independent, so repeated rows,
    null ids and other columns change nothing; an empty table stays empty.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def rows(arrow):
        bpe = encoder(vocab, pattern, cut_at_blanks)
        for part in sliced(row for batch in arrow for row in texts_of(batch)):
            for (doc_id, _), ids in zip(part, bpe.encode_many([text for _, text in part])):
                yield doc_id, len(ids) // 4, ids, bpe.decode(ids)

    ddl = "doc_id long, n_tokens long, ids binary, decoded binary"
    return docs.select("doc_id", "text").mapInArrow(lambda arrow: batches(CODED, rows(arrow), most=500), ddl)


def op4_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes decoded from them."""
    import public_tokenizers as P

    coded = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, cut_at_blanks=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
