"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import re
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``, which driver and executors share.

    Only in local mode, where there are no other machines, may it be unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/tandem/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    ``small`` says that the rows are few for the tasks that make them; they are
    then gathered in as few files as their size asks for.
    """
    spark = df.sparkSession
    if small:
        df = df.hint("rebalance")
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc32_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Memo(dict):
    """A bounded memo of ``make(key)`` for the keys of one Python worker.

    ``map(memo.__getitem__, keys)`` runs at dict speed; call ``trim()`` between
    documents so that the memo never holds more than ``most_bytes`` (about) for long.
    """

    def __init__(self, make, most_bytes: int = 32 << 20):
        super().__init__()
        self.make, self.most_bytes, self.bytes = make, most_bytes, 0

    def __missing__(self, key):
        self[key] = value = self.make(key)
        self.bytes += 2 * ENTRY + sys.getsizeof(key)
        return value

    def trim(self) -> None:
        if self.bytes > self.most_bytes:
            self.clear()
            self.bytes = 0


#: Bytes of a dict's entry besides its key and value, about.
ENTRY = 100


class BatchMemo:
    """A bounded memo whose missing keys are made many at a time by ``make(list of keys)``.

    Two generations of about ``most_bytes``, keys and values counted: when the
    young one is full it becomes the old one, and keys that are met again move
    back. So frequent keys stay and rare ones go.
    """

    def __init__(self, make, most_bytes: int = 40 << 20):
        self.young: dict = {}
        self.old: dict = {}
        self.make, self.most_bytes, self.bytes = make, most_bytes, 0

    def values(self, keys: list) -> list:
        """The value of each key, in order."""
        if self.bytes > self.most_bytes:
            self.old, self.young, self.bytes = self.young, {}, 0
        found = list(map(self.young.get, keys))
        gaps, at = [], -1
        for _ in range(found.count(None)):
            gaps.append(at := found.index(None, at + 1))
        if gaps:
            new = {keys[i] for i in gaps}
            added = {k: self.old[k] for k in new if k in self.old}
            missing = list(new - added.keys())
            added.update(zip(missing, self.make(missing)))
            self.bytes += ENTRY * len(added) + sum(map(sys.getsizeof, added)) + sum(map(sys.getsizeof, added.values()))
            self.young.update(added)
            for i in gaps:
                found[i] = added[keys[i]]
        return found


_PER_WORKER: dict = {}


def per_worker(key, make):
    """The Python worker's object of this key, kept between tasks until an operator asks for another one.

    Every operator of this subpackage that runs Python asks for one, so a worker
    that runs stage after stage holds one model or tokenizer with its memos.
    """
    if key not in _PER_WORKER:
        _PER_WORKER.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _PER_WORKER[key] = make()
    return _PER_WORKER[key]


def batches(schema: pa.Schema, rows, most: int = 2_000):
    """Arrow batches of at most ``most`` of the tuples that ``rows`` yields."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def texts_of(batch: pa.RecordBatch):
    """(doc_id, text) of each row; a null text is empty."""
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        yield doc_id, text or ""


def sliced(rows, most_chars: int = 300_000):
    """Lists of (key, text) pairs with about ``most_chars`` characters each."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[1])
        if chars >= most_chars:
            yield held
            held, chars = [], 0
    if held:
        yield held
