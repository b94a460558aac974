"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms (lower-case runs of letters, digits
and underscores). Besides a weight for each term, the machine has a short vector
for each, and every two terms of a document add the product of their vectors:
so an insult next to a mention of a group can count for more than both alone.

The machine is fitted on the driver from a bounded sample of labelled rows
(``SAMPLE_ROWS``). It keeps the buckets for which the sample has evidence: terms
that are toxic or clean by themselves, both terms of pairs that are so together
although their terms do not say it, and the most frequent terms. There are at
most BUCKETS of them, which bounds the broadcast. Scoring is a map over all rows
without a shuffle.
"""

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm._shared import Memo, batches, crc32_mod, per_worker, texts_of
from tandem.llm.vocabularies import gathered

#: Labelled rows that a machine is fitted on, at most; those of lowest xxhash64(doc_id) are taken.
SAMPLE_ROWS = 12_000
BUCKETS = 1 << 20
#: Evidence for a term: rows that have it, how many of them at least are no copies, and standard deviations that its share of
#: toxic rows is off.
LEAST_ROWS, LEAST_EVIDENCE, Z = 3, 2, 4.0
FREQUENT_TERMS = 128
#: Evidence for a pair: rows that have both terms, and nats by which its share of toxic rows contradicts its terms' shares.
#: (Chance reaches NATS with a probability of exp(-NATS) at most, so hardly ever in all pairs of a sample.)
PAIR_ROWS, NATS = 12, 25.0
#: Counters of pairs in memory at a time, and pairs that are counted together.
PAIR_COUNTERS, PAIRS_TOGETHER = 1 << 20, 1 << 18
FACTORS, EPOCHS, BATCH, RATE = 4, 20, 256, 0.05
WORD = re.compile(r"\w+")


def term_buckets(chunk: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in WORD.findall(chunk.lower()))


def terms_of(text: str, memo: Memo) -> set[int]:
    """Distinct hashed terms of a whole text."""
    memo.trim()
    return set().union(*map(memo.__getitem__, set(text.split())))


class Machine:
    """w0 + sum of w + half of (squared sum of v - sum of squared v), through a sigmoid."""

    def __init__(self, buckets: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.buckets, self.w0, self.w, self.v = buckets, w0, w, v
        self.at = {int(b): i for i, b in enumerate(buckets)}

    def score(self, terms) -> float:
        own = sorted(self.at[t] for t in terms if t in self.at)
        v = self.v[own]
        z = self.w0 + self.w[own].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def nats(hits, n, expected):
    """What it tells against a share ``expected`` that of n rows so many are toxic (Chernoff's bound)."""
    q = hits / np.maximum(n, 1)
    part = lambda x, y: np.where(x > 0, x * np.log(np.maximum(x, 1e-300) / y), 0.0)
    return n * (part(q, expected) + part(1 - q, 1 - expected))


def telling_pairs(flat: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, rates: np.ndarray, share: float) -> np.ndarray:
    """Terms of the pairs whose rows are toxic more or less often than their terms' rates, added as log-odds, let expect.

    ``flat``: the numbers of the terms of every row in ascending order, end to
    end. All pairs of terms with PAIR_ROWS rows or more in common are counted, a
    block of first terms at a time.
    """
    m, odds = len(rates), np.log(rates / (1 - rates))
    partners = (np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat)) - 1).astype(np.int32)
    label, order = np.repeat(toxic > 0, lengths), np.argsort(flat, kind="stable").astype(np.int32)
    block, found = max(1, PAIR_COUNTERS // max(1, m)), [np.zeros(0, np.int64)]
    for low in range(0, m, block):
        own = order[np.searchsorted(flat, low, sorter=order) : np.searchsorted(flat, low + block, sorter=order)]
        counts = []
        for places in (own[label[own]], own[~label[own]]):
            count, n = np.zeros(block * m, np.int64), partners[places]
            for part in np.split(np.arange(len(places)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS_TOGETHER)) + 1):
                second = gathered(flat, places[part] + 1, n[part])
                count += np.bincount(np.repeat(flat[places[part]].astype(np.int64) - low, n[part]) * m + second, minlength=block * m)
            counts.append(count)
        hits, total = counts[0], counts[0] + counts[1]
        at = np.flatnonzero(total >= PAIR_ROWS)
        a, b = at // m + low, at % m
        expected = 1 / (1 + np.exp(-np.clip(odds[a] + odds[b] - np.log(share / (1 - share)), -9, 9)))
        told = nats(hits[at], total[at], expected) >= NATS
        found += [a[told], b[told]]
    return np.unique(np.concatenate(found))


def fit_machine(rows: list[np.ndarray], toxic: np.ndarray, seed: int = 7) -> Machine:
    """A machine from the term sets of the sample; without rows of both labels it scores the share of toxic rows."""
    n, share = len(rows), float(np.mean(toxic)) if len(toxic) else 0.0
    if not n or share in (0.0, 1.0):
        return Machine(np.zeros(0, np.int64), 9.0 if share == 1.0 else -9.0, np.zeros(0), np.zeros((0, FACTORS)))
    lengths = np.array([len(r) for r in rows])
    buckets, column = np.unique(np.concatenate(rows).astype(np.int32), return_inverse=True)
    column, of = column.astype(np.int32), np.repeat(np.arange(n, dtype=np.int32), lengths)
    df = np.bincount(column, minlength=len(buckets))
    # Copies and near copies tell nothing new: of rows whose rarer terms have the same least hash one is evidence.
    rare = np.where(df > n / 20, 1 << 32, np.random.default_rng(5).integers(0, 1 << 32, len(df)))
    least = np.full(n, 1 << 32)
    some = lengths > 0
    least[some] = np.minimum.reduceat(rare[column], (np.cumsum(lengths) - lengths)[some]) if some.any() else 0
    evidence = least == 1 << 32
    evidence[np.unique(least, return_index=True)[1]] = True
    told = evidence[of]
    seen = np.bincount(column[told], minlength=len(buckets))
    hits = np.bincount(column, weights=toxic[of], minlength=len(buckets))
    off = np.abs(hits - df * share) / np.sqrt(df * share * (1 - share))
    strong = np.flatnonzero((df >= LEAST_ROWS) & (seen >= LEAST_EVIDENCE) & (off >= Z))
    frequent = np.argsort(-df, kind="stable")[:FREQUENT_TERMS]
    # Only terms with enough rows can be in a pair with enough rows.
    common = seen >= PAIR_ROWS
    told &= common[column]
    number = (np.cumsum(common) - 1).astype(np.int32)[column[told]]
    hits = np.bincount(number, weights=toxic[of[told]], minlength=int(common.sum()))
    rates = (hits + share) / (np.bincount(number, minlength=int(common.sum())) + 1)
    paired = np.flatnonzero(common)[telling_pairs(number, np.bincount(of[told], minlength=n), toxic, rates, share)]
    kept = np.unique(np.r_[strong, frequent, paired])
    # Terms that say little by themselves get a firm penalty, so that they act in pairs and don't take over the bias.
    penalty = np.where(np.isin(kept, strong), 1e-5, 3e-2).astype(np.float32)
    place = np.full(len(buckets), -1)
    place[kept] = np.arange(len(kept))
    use = place[column] >= 0
    terms, n_terms = place[column[use]], np.bincount(of[use], minlength=n)
    starts = np.cumsum(n_terms) - n_terms
    # Adam on the logistic loss, with L2 on both parts.
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(share / (1 - share))]), np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), FACTORS))]
    params = [p.astype(np.float32) for p in params]
    m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    y = toxic.astype(np.float32)
    for _ in range(max(EPOCHS, min(200, 60_000 // max(1, n)))):
        order = rng.permutation(n)
        for a in range(0, n, BATCH):
            own = order[a : a + BATCH]
            xb, step = np.zeros((len(own), len(kept)), np.float32), step + 1
            xb[np.repeat(np.arange(len(own)), n_terms[own]), gathered(terms, starts[own], n_terms[own])] = 1
            w0, w, v = params
            xv = xb @ v
            z = w0 + xb @ w + 0.5 * ((xv**2).sum(1) - (xb @ (v**2)).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
            gx = xb * g[:, None]
            grads = [np.array([g.sum()]), gx.sum(0) + penalty * w, gx.T @ xv - gx.sum(0)[:, None] * v + 1e-2 * v]
            for p, d, a1, a2 in zip(params, grads, m, s):
                a1 *= 0.9
                a1 += 0.1 * d
                a2 *= 0.999
                a2 += 0.001 * d * d
                p -= RATE * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.999**step)) + 1e-8)
    return Machine(buckets[kept], float(params[0][0]), params[1].astype(float), params[2].astype(float))


def train(docs: DataFrame, labels: DataFrame, usable: Column) -> Machine:
    """A machine from the labelled rows of ``docs`` (doc_id, text) that ``usable`` (on doc_id) admits.

    Rows without doc_id or without label 0 or 1 are not used; a doc_id that is
    labelled twice takes its higher label, one that several rows share their least text.
    """
    labelled = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)

    def terms(arrow):
        memo = per_worker("terms", lambda: Memo(term_buckets))
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("terms", pa.list_(pa.int32()))])
        for batch in arrow:
            toxic = batch.column("toxic").to_pylist()
            yield from batches(schema, ((d, t, sorted(terms_of(text, memo))) for (d, text), t in zip(texts_of(batch), toxic)))

    # SAMPLE_ROWS bounds the broadcast side and what the driver gets.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic"))
    got = rows.mapInArrow(terms, "doc_id long, toxic int, terms array<int>").toPandas().sort_values("doc_id", kind="stable")
    return fit_machine([np.asarray(t, np.int32) for t in got.terms], got.toxic.to_numpy(dtype=float))


def score_documents(docs: DataFrame, machine: Machine, column: str = "toxicity") -> DataFrame:
    """``docs`` with a further ``column`` (double, 0 to 1), in place of one of that name; other columns and all rows stay.

    A null or empty text has no terms and gets the score of the bias alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast((machine.buckets, machine.w0, machine.w, machine.v))

    def scores(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        per_worker("toxicity", dict)
        machine = Machine(*shared.value)
        kept = machine.at
        memo = Memo(lambda chunk: tuple(b for b in term_buckets(chunk) if b in kept))
        for own in texts:
            yield pd.Series([machine.score(terms_of(text or "", memo)) for text in own], dtype="float64")

    score = F.pandas_udf(scores, "double")

    return docs.withColumn(column, score("text"))


def op5_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a machine that saw no label of a held-out row."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = train(docs, labels, crc32_mod(F.col("doc_id"), 5) != 0)
    scored = score_documents(docs.select("doc_id", "text"), machine)
    return scored.select(
        "doc_id",
        F.coalesce(crc32_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
