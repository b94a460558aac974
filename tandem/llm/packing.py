"""Cost-balanced packing of documents into training sequences.

Each packing unit (at most ``UNIT_TOKENS`` tokens of neighbouring rows of one
task) is packed by itself, so the work needs no shuffle and a lost task is
simply run again. A unit of T tokens gets T // length full sequences, and the
rest of T is laid out in sequences whose capacities are the powers of two that
add up to it, which need no padding. Documents of a whole sequence or more fill
sequences of their own first; what is left of them and all shorter documents go,
in descending order, to the sequence of least estimated cost (linear plus
quadratic in each piece's length) that still has room. A piece that fits
nowhere is cut to fill the sequence with the most room.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.vocabularies import chunk_encoder, gathered, load

LENGTH = 1024
END_ID = 0
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
UNIT_TOKENS = 1 << 20
#: Pieces in one Arrow batch.
PIECES_TOGETHER = 5_000

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("capacity", pa.int64()), ("ids", pa.binary()),
    ]
)
PIECES_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, capacity long, ids binary"


def pack(doc_tokens: list[int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """(document index, start, piece length, sequence, offset, capacity) of every piece; sequences count from 0."""
    full, rest = divmod(sum(doc_tokens), length)
    capacities = [length] * full + [1 << k for k in range(length.bit_length() - 1, -1, -1) if rest >> k & 1]
    pieces, sequence, left = [], 0, []
    for doc, n in enumerate(doc_tokens):
        whole = n // length
        for k in range(whole):
            pieces.append((doc, k * length, length, sequence, 0, length))
            sequence += 1
        if n % length:
            left.append((n % length, doc, whole * length))
    room = np.array(capacities[sequence:], np.int64)
    cost, used = np.zeros(len(room)), np.zeros(len(room), np.int64)

    def put(doc, start, n, s):
        pieces.append((doc, start, n, sequence + s, int(used[s]), capacities[sequence + s]))
        used[s] += n
        room[s] -= n
        cost[s] += LINEAR * n + QUADRATIC * n * n

    for n, doc, start in sorted(left, key=lambda x: (-x[0], x[1])):
        while n:
            s = int(np.argmin(np.where(room >= n, cost, np.inf)))
            if room[s] < n:
                s = int(np.argmax(room))
            take = min(n, int(room[s]))
            put(doc, start, take, s)
            start, n = start + take, n - take
    return pieces


def pack_documents(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, unit_tokens: int = UNIT_TOKENS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, capacity, ids.

    Each row of ``docs`` is a document (also rows that share a doc_id, or have
    none); a null or empty text is the end id alone; an empty table has no
    pieces; other columns are ignored. ``sequence_id`` is unique: it holds the
    task's partition and a count.
    """
    vocab = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def rows(arrow):
        encoder = chunk_encoder(vocab, drops_space=False)
        first, doc_ids, lengths, ids = TaskContext.get().partitionId() << 40, [], np.zeros(0, np.int64), np.zeros(0, np.uint32)

        def packed(n):
            """The pieces of a unit of the first ``n`` documents held."""
            nonlocal first, doc_ids, lengths, ids
            own = int(lengths[:n].sum())
            doc, start, size, sequence, offset, capacity = np.array(pack(lengths[:n].tolist(), length), np.int64).T
            begin = (np.cumsum(lengths[:n]) - lengths[:n])[doc] + start
            for a in range(0, len(doc), PIECES_TOGETHER):
                at = slice(a, a + PIECES_TOGETHER)
                stops = pa.array(np.concatenate([[0], 4 * np.cumsum(size[at])]), pa.int32())
                content = gathered(ids[:own], begin[at], size[at]).astype("<u4").tobytes()
                binaries = pa.BinaryArray.from_buffers(pa.binary(), len(doc[at]), [None, stops.buffers()[1], pa.py_buffer(content)])
                columns = [pa.array(doc_ids[:n], pa.int64()).take(pa.array(doc[at])), *map(pa.array, (start[at], size[at], lengths[doc[at]], first + sequence[at], offset[at], capacity[at]))]
                yield pa.RecordBatch.from_arrays([*columns, binaries], schema=PIECES)
            first += int(sequence.max()) + 1
            doc_ids, lengths, ids = doc_ids[n:], lengths[n:], ids[own:]

        for more, more_ids, more_lengths in encoder.encoded(arrow, end_id):
            doc_ids, lengths, ids = doc_ids + more, np.concatenate([lengths, more_lengths]), np.concatenate([ids, more_ids])
            while int(lengths.sum()) >= unit_tokens:
                yield from packed(int(np.searchsorted(np.cumsum(lengths), unit_tokens)) + 1)
        if doc_ids:
            yield from packed(len(doc_ids))

    return docs.select("doc_id", "text").mapInArrow(rows, PIECES_DDL)


def op7_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every piece of all documents."""
    import public_tokenizers

    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "capacity")
