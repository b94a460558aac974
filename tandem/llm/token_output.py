"""Token ids as grammar-compressed shards (Re-Pair) with random access.

File format: a Parquet dataset with one row per block of whole documents in
ascending order of ``doc_id`` (columns ``part``, ``block`` give the order;
``block_start`` counts the ids of its part's blocks before it). A block holds its documents' ids as a grammar:

* ``doc_ids``, ``doc_tokens``, ``doc_symbols``: per document its id, its number
  of token ids and its number of grammar symbols;
* ``rule_left``, ``rule_right``: little-endian u32; rule k rewrites symbol
  ``base + k`` as two symbols, each below ``base + k``;
* ``rule_tokens``: u32, the number of token ids that a rule expands to;
* ``symbols``: u32, the start strings of all documents, end to end.

No rule crosses the end of a document, so one document, or a range in it, is
decoded from its own symbols alone: expansion lengths say which symbols to open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm._shared import per_worker, shared_dir
from tandem.llm.vocabularies import chunk_encoder, load

END_ID = 1
#: Characters of a text that tell tasks apart where rows share an id.
ORDER_CHARS = 256
#: A block is closed by the document that brings it to this many ids.
BLOCK_IDS = 1 << 20
#: A pair that is used less often in a block gets no rule.
LEAST_USES = 2
#: The floor of a round is the one before divided by this.
STEP = 16
#: Binary logarithm of the number of hash buckets that count pairs, at most.
MOST_BITS = 20
#: Bytes of either generation of the encoder's memo.
MEMO_BYTES = 96 << 20
#: Nonterminals are numbered from here on; token ids are below.
BASE = 1 << 24
#: Parts (tasks that wrote blocks) whose first ids are broadcast at most; their number is that of shuffle partitions.
MOST_PARTS = 1 << 20

BLOCKS = pa.schema(
    [
        ("part", pa.int32()), ("block", pa.int32()), ("block_start", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int64())),
        ("rule_left", pa.binary()), ("rule_right", pa.binary()), ("rule_tokens", pa.binary()), ("symbols", pa.binary()),
    ]
)
BLOCKS_DDL = (
    "part int, block int, block_start long, n_docs long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, doc_symbols array<long>, "
    "rule_left binary, rule_right binary, rule_tokens binary, symbols binary"
)


def _buckets(left: np.ndarray, right: np.ndarray, bits: int, turn: int) -> np.ndarray:
    """Hash buckets of pairs; every turn has another hash."""
    mixed = left * np.uint32(2654435761 + 2 * turn)
    mixed ^= right * np.uint32(2246822519 + 6 * turn)
    mixed *= np.uint32(0x9E3779B1)
    mixed >>= np.uint32(32 - bits)
    return mixed.astype(np.intp)


def _where(mask: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """What the arrays hold where the mask is set: by place, as irregular masks are slow."""
    at = np.flatnonzero(mask)
    return [x[at] for x in arrays]


def _first_alike(s: np.ndarray, at: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Whether each place has the pair that stands first in its bucket, of n buckets."""
    stands = np.empty(n, np.intp)
    stands[h[::-1]] = at[::-1]
    first = stands[h]
    return (s[at] == s[first]) & (s[at + 1] == s[first + 1])


def compress(ids: np.ndarray, doc_tokens: np.ndarray, least: int = LEAST_USES, step: int = STEP):
    """Re-Pair over one block: (symbols, rule_left, rule_right, rule_tokens, doc_symbols).

    Pairs are replaced in rounds of falling frequency. A turn replaces the pairs
    that stand at ``floor`` places or more, all at once; where two of them
    overlap the more frequent one is replaced and the other is counted anew. It
    is repeated for the places that changed until little is left to replace;
    then the floor falls, down to ``least``, where turns go on until no pair can
    be used ``least`` times any more. Pairs are counted by hash bucket; of pairs
    that share one, the first counts and the others wait for the next turn,
    which has another hash. A pair whose left symbol ends a document is never
    replaced, so documents stay apart.
    """
    s = ids.astype(np.uint32)
    ends = np.zeros(len(s), bool)
    ends[np.cumsum(doc_tokens) - 1] = True
    lefts, rights, sizes, made = [], [], np.ones(1 << 12, np.uint32), 0
    floor, at, turn, last = None, None, 0, False
    while len(s):
        turn += 1
        every = at is None
        at = np.flatnonzero(~ends[:-1]) if every else at
        bits = min(MOST_BITS, max(8, int(4 * len(at)).bit_length()))
        h = _buckets(s[at], s[at + 1], bits, turn)
        counts = np.bincount(h, minlength=1 << bits)
        if floor is None:
            floor = max(least, int(counts.max()) // step)
        frequent = counts >= floor
        may = frequent[h]
        # From here on only the frequent buckets are numbered.
        at, h = _where(may, at, h)
        h, n = (np.cumsum(frequent, dtype=np.int32) - 1)[h].astype(np.intp), int(frequent.sum())
        alike = _first_alike(s, at, h, n)
        (waiting,) = _where(~alike, at)
        at, h = _where(alike, at, h)
        # Of a pair's overlapping places (as in a a a) every second one goes, from the left.
        run = np.zeros(len(at), bool)
        run[1:] = (np.diff(at) == 1) & (h[1:] == h[:-1])
        if run.any():
            place = np.arange(len(at))
            odd = (place - np.maximum.accumulate(np.where(run, 0, place))) & 1 == 1
            waiting = np.concatenate([waiting, *_where(odd, at)])
            at, h = _where(~odd, at, h)
        uses = np.bincount(h, minlength=n)
        enough = (uses >= (least if last else floor))[h]
        at, h = _where(enough, at, h)
        # Of overlapping pairs the more frequent one goes.
        worth = uses[h] << np.int64(32) | h
        beside = np.diff(at) == 1
        lower = np.zeros(len(at), bool)
        lower[1:] = beside & (worth[1:] < worth[:-1])
        lower[:-1] |= beside & (worth[:-1] < worth[1:])
        waiting = np.concatenate([waiting, *_where(lower, at)])
        at, h = _where(~lower, at, h)
        uses = np.bincount(h, minlength=n)
        used = np.flatnonzero(uses >= least)
        good = (uses >= least)[h]
        waiting = np.concatenate([waiting, *_where(~good, at)])
        at, h = _where(good, at, h)
        if len(at):
            number = np.empty(n, np.intp)
            number[used] = np.arange(len(used))
            rule = number[h]
            first = np.empty(len(used), np.intp)
            first[rule[::-1]] = at[::-1]
            left, right = s[first], s[first + 1]
            if made + len(used) > len(sizes):
                sizes = np.concatenate([sizes, np.ones(max(len(sizes), len(used)), np.uint32)])
            size_of = lambda x: np.where(x >= BASE, sizes[np.where(x >= BASE, x - np.uint32(BASE), 0)], 1)
            sizes[made : made + len(used)] = size_of(left) + size_of(right)
            lefts.append(left), rights.append(right)
            s[at] = (BASE + made + rule).astype(np.uint32)
            ends[at] = ends[at + 1]
            made += len(used)
        elif not len(waiting) and floor == least:
            if last:
                break
            last = True
        # Places to look at again: those that wait and those beside a new symbol.
        if floor > least and len(at) <= len(s) >> 7:
            floor, again = max(least, floor // step), None
        elif last and not len(at) and not len(waiting):
            again = None
        else:
            again = np.zeros(len(s), bool)
            again[waiting] = again[at] = again[np.maximum(at - 1, 0)] = True
            again &= ~ends
        if len(at):
            stay = np.ones(len(s), bool)
            stay[at + 1] = False
            # A mask that is set almost everywhere is fast.
            few = len(at) < len(s) >> 5
            s, ends = (s[stay], ends[stay]) if few else _where(stay, s, ends)
            if again is not None:
                (again,) = [again[stay]] if few else _where(stay, again)
        at = None if again is None else np.flatnonzero(again[:-1])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    doc_symbols = np.diff(np.r_[0, np.flatnonzero(ends) + 1])
    return s, cat(lefts), cat(rights), sizes[:made].copy(), doc_symbols


def _opened(s: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The token ids of symbols, by opening every rule level by level."""
    while True:
        nonterminal = s >= BASE
        at = np.flatnonzero(nonterminal)
        if not len(at):
            return s
        k = s[at] - np.uint32(BASE)
        s = np.repeat(s, nonterminal + np.int8(1))
        at += np.arange(len(at))
        s[at], s[at + 1] = left[k], right[k]


def _copied(s: np.ndarray, held: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The token ids of symbols, given those of the rules that they name: ``size`` from ``starts`` on in ``held``."""
    big = np.flatnonzero(s >= BASE)
    k = s[big] - np.uint32(BASE)
    lengths, own = np.ones(len(s), np.int64), size[k].astype(np.int64)
    lengths[big] = own
    stops = np.cumsum(lengths)
    out = np.empty(int(stops[-1]) if len(s) else 0, np.uint32)
    first = stops - lengths
    out[first] = s
    inside = np.arange(int(own.sum()))
    shift = np.cumsum(own) - own
    out[np.repeat(first[big] - shift, own) + inside] = held[np.repeat(starts[k] - shift, own) + inside]
    return out


def expand(symbols: np.ndarray, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The token ids of ``symbols``: every rule is opened once and then copied, unless that is more than the symbols hold.

    Rules in a row that name none of each other are opened together, as those of one turn of ``compress``.
    """
    total = int(size.sum(dtype=np.int64))
    if total > len(symbols) + int((size[symbols[symbols >= BASE] - BASE].astype(np.int64) - 1).sum()):
        return _opened(symbols, left, right)
    starts, held = np.cumsum(size, dtype=np.int64) - size, np.empty(total, np.uint32)
    highest, a = np.maximum.accumulate(np.maximum(left, right)), 0
    while a < len(left):
        b = int(np.searchsorted(highest, np.uint32(BASE + a)))
        ids = _copied(np.stack([left[a:b], right[a:b]], 1).ravel(), held, starts, size)
        held[starts[a] : starts[a] + len(ids)] = ids
        a = b
    return _copied(symbols, held, starts, size)


def decode_range(block: dict, doc_index: int, start: int, length: int) -> np.ndarray:
    """Ids ``start`` to ``start + length`` of one document of a block: only the symbols that cover them are opened."""
    left, right, size, symbols = (np.frombuffer(block[c], "<u4") for c in ("rule_left", "rule_right", "rule_tokens", "symbols"))
    first = int(np.sum(block["doc_symbols"][:doc_index]))
    own = symbols[first : first + int(block["doc_symbols"][doc_index])]
    nonterminal = own >= BASE
    lengths = np.ones(len(own), np.int64)
    lengths[nonterminal] = size[own[nonterminal] - BASE]
    stop = np.cumsum(lengths)
    a, b = np.searchsorted(stop, start, "right"), np.searchsorted(stop, start + length, "left") + 1
    ids = _opened(own[a:b], left, right)
    skip = start - int(stop[a - 1] if a else 0)
    return ids[skip : skip + length]


def write_token_shards(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text of ``docs`` (doc_id, text; others are ignored) and write the blocks under ``path``.

    Order: ascending doc_id, null ids first; rows of one id by text. Rows that
    share the id and the first ORDER_CHARS characters go to one task. A null or
    empty text is the end id alone. An empty table writes no block.
    """
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(load(vocabulary))
    n = min(MOST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("begins", F.substring("text", 1, ORDER_CHARS))
    ordered = rows.repartitionByRange(n, "doc_id", "begins").sortWithinPartitions("doc_id", "text").select("doc_id", "text")

    def encode(arrow):
        encoder, part = chunk_encoder(vocab, drops_space=True, most_bytes=MEMO_BYTES), TaskContext.get().partitionId()
        ids, lengths, doc_ids, start, block = np.zeros(0, np.uint32), np.zeros(0, np.int64), [], 0, 0

        def packed(n):
            """A block of the first ``n`` documents held."""
            nonlocal ids, lengths, doc_ids, start, block
            own = int(lengths[:n].sum())
            s, left, right, size, doc_symbols = compress(ids[:own], lengths[:n])
            row = (part, block, start, n, own, doc_ids[:n], lengths[:n], doc_symbols, *(x.astype("<u4").tobytes() for x in (left, right, size, s)))
            ids, lengths, doc_ids, start, block = ids[own:], lengths[n:], doc_ids[n:], start + own, block + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, BLOCKS.types)], schema=BLOCKS)

        for more, more_ids, more_lengths in encoder.encoded(arrow, end_id):
            ids, lengths, doc_ids = np.concatenate([ids, more_ids]), np.concatenate([lengths, more_lengths]), doc_ids + more
            while int(lengths.sum()) >= block_ids:
                yield packed(int(np.searchsorted(np.cumsum(lengths), block_ids)) + 1)
        if doc_ids:
            yield packed(len(doc_ids))

    ordered.mapInArrow(encode, BLOCKS_DDL).write.parquet(path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a dataset of blocks: doc_id, start, n_tokens, ids (binary, little-endian u32).

    ``start`` counts the ids of all documents before. Blocks know their place
    within their part; the parts' first ids, at most MOST_PARTS rows, are
    broadcast, so the blocks are not shuffled.
    """
    blocks = spark.read.schema(BLOCKS_DDL).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def decode(arrow):
        per_worker("token-shards", dict)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in arrow:
            for k in range(len(batch)):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                left, right, size, symbols = (np.frombuffer(row[c].as_buffer(), "<u4") for c in ("rule_left", "rule_right", "rule_tokens", "symbols"))
                ids, n = expand(symbols, left, right, size).astype("<u4"), row["doc_tokens"].values.to_numpy()
                stops = np.cumsum(n)
                at = 0
                while at < len(n):  # some documents at a time, as an array of binaries holds less than 2 GB
                    end = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + (1 << 22), "right")))
                    first = int(stops[at - 1]) if at else 0
                    offsets = pa.array(np.concatenate([[0], stops[at:end] - first]) * 4, pa.int32())
                    binaries = pa.BinaryArray.from_buffers(pa.binary(), end - at, [None, offsets.buffers()[1], pa.py_buffer(ids[first : stops[end - 1]].tobytes())])
                    starts = row["block_start"].as_py() + stops[at:end] - n[at:end]
                    yield pa.RecordBatch.from_arrays([row["doc_ids"].values.slice(at, end - at), pa.array(starts), pa.array(n[at:end]), binaries], schema=schema)
                    at = end

    columns = ["doc_ids", "doc_tokens", "rule_left", "rule_right", "rule_tokens", "symbols"]
    placed = blocks.join(F.broadcast(parts), "part").select((F.col("part_start") + F.col("block_start")).alias("block_start"), *columns)
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op1_grammar_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document as read back from the written blocks."""
    import public_tokenizers

    path = shared_dir(spark, "token-shards")
    write_token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_shards(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
