"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary
(fitted by expectation maximisation; the vocabulary itself is never trained). A
word's probability in a language is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words. The
score of the best language is its posterior with the log-likelihoods divided by
the root of the number of words, as neighbouring words are not independent.

A word is a run of letters of the lower-cased text, of any length. All pieces that
can stand in such a word take part: pieces with capitals or other characters
than letters never can. Words of more than ``WORD_CHARS`` letters (scripts without
blanks) are summed over all their segmentations too, in blocks of ends whose sums
are brought back to one at each block's start; only for the root above such a word
counts as one for every ``WORD_CHARS`` letters.
"""

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tandem.llm._shared import BatchMemo, batches, crc32_mod, per_worker, sliced, texts_of, unused

#: Longer words are summed in blocks of ends, of so many ends each.
WORD_CHARS, BLOCK_ENDS = 64, 32
#: The sample that a language is learned from: about so many documents, those of lowest hashed doc_id, and so many words of
#: them at most, the most frequent ones.
SAMPLE_ROWS, SAMPLE_WORDS = 400, 20_000
ROUNDS = 3
#: Languages that are fitted and scored together; a broadcast holds no more.
LANGUAGES_TOGETHER = 256
#: Share of a language's probability that is spread evenly over all pieces.
SPREAD = 0.05
#: Factor per character that keeps products of probabilities within range.
SCALE = 1_000.0
UNDETERMINED = "und"

#: Runs of letters and of numerals such as ² or Ⅷ, which letters() takes out.
RUNS = re.compile(r"[^\W\d_]+")


def letters(text: str) -> list[str]:
    """Runs of letters of a text."""
    return [w for run in RUNS.findall(text) for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


def pieces_of(path: str) -> list[str]:
    """The lower-case letter pieces of a sentencepiece vocabulary; a leading mark stands for the start of a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return sorted({p for p in every if (rest := p.removeprefix("▁")) == rest.lower() and (rest.isalpha() or p == "▁")})


class Lattice:
    """The segmentations of words into pieces, many words at a time."""

    BASE, SLOT_BITS = np.uint64(0x9E3779B97F4A7C15), 22

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        self.powers = np.cumprod(np.r_[np.uint64(1), np.full(max(WORD_CHARS, *map(len, pieces), 0) + 2, self.BASE)], dtype=np.uint64)
        self.lengths = sorted({1, *map(len, pieces)})
        self.reach = self.lengths[-1]
        self.keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.table = np.full(1 << self.SLOT_BITS, -1, np.int32)
        self.more: dict[int, int] = {}
        slots = self._slot(self.keys)
        for i, s in enumerate(slots.tolist()):
            if self.table[s] < 0:
                self.table[s] = i
            else:
                self.more[int(self.keys[i])] = i
        self.crowded = np.zeros(1 << self.SLOT_BITS, bool)
        self.crowded[self._slot(np.array(list(self.more), np.uint64))] = True

    def _key(self, piece: str) -> np.uint64:
        key = 0
        for c in piece:
            key = (key * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return np.uint64(key)

    def _slot(self, keys):
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key's piece, -1 if none."""
        slots = self._slot(keys)
        found = self.table[slots]
        found = np.where((found >= 0) & (self.keys[found] == keys), found, -1)
        for i in np.flatnonzero(self.crowded[slots] & (found < 0)).tolist():
            found[i] = self.more.get(int(keys[i]), -1)
        return found

    def edges(self, words: list[str]):
        """Characters of the longest word (with its start mark), lengths, and per (end, piece length): words and pieces."""
        marked = ["▁" + w for w in words]
        lengths = np.array(list(map(len, marked)))
        width = int(lengths.max())
        codes = np.frombuffer("".join(w.ljust(width, "\0") for w in marked).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), width).astype(np.uint64)
        prefix = np.zeros((len(words), width + 1), np.uint64)
        for i in range(width):
            prefix[:, i + 1] = prefix[:, i] * self.BASE + codes[:, i] + np.uint64(1)
        steps = []
        for end in range(1, width + 1):
            live = np.flatnonzero(lengths >= end)
            for n in self.lengths:
                if n > end:
                    break
                found = self._find(prefix[live, end] - prefix[live, end - n] * self.powers[n])
                hit = found >= 0
                if n == 1:
                    steps.append((end, 1, live, np.where(hit, found, self.size)))
                elif hit.any():
                    steps.append((end, n, live[hit], found[hit]))
        return lengths, width, steps

    def forward(self, words: list[str], p: np.ndarray):
        """alpha (word, end, language), scaled; p has one row per piece and a last one for unknown characters."""
        lengths, width, steps = self.edges(words)
        alpha = np.zeros((len(words), width + 1, p.shape[1]))
        alpha[:, 0] = 1
        for end, n, at, piece in steps:
            alpha[at, end] += alpha[at, end - n] * (p[piece] * SCALE**n)
        return alpha, lengths, width, steps

    def log_probabilities(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log-probability of each word in each language, summed over its segmentations."""
        out = np.zeros((len(words), p.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= WORD_CHARS]
        if short:
            alpha, lengths, _, _ = self.forward([words[i] for i in short], p)
            out[short] = np.log(alpha[np.arange(len(short)), lengths]) - (lengths * np.log(SCALE))[:, None]
        for i in set(range(len(words))) - set(short):
            *_, (_, alpha, offset) = self.long_forward(words[i], p)
            out[i] = np.log(alpha[self.reach + len(words[i]) % BLOCK_ENDS]) + offset - (len(words[i]) + 1) * np.log(SCALE)
        return out

    def _block(self, word: str, start: int, p: np.ndarray):
        """Pieces (end, length) that end in a block of a marked word, none as size + 1, and their scaled probabilities."""
        text = word[max(0, start - self.reach) : start + BLOCK_ENDS]
        before = min(start, self.reach)
        prefix = [0]
        for c in text:
            prefix.append((prefix[-1] * int(self.BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF)
        prefix, n = np.array(prefix, np.uint64), np.array(self.lengths)
        ends = np.arange(before + 1, len(text) + 1)[:, None]
        keys = prefix[ends] - prefix[np.maximum(ends - n, 0)] * self.powers[n]
        found = self._find(keys.ravel()).reshape(keys.shape)
        found[(found < 0) | (ends < n)] = self.size + 1
        found[:, 0] = np.minimum(found[:, 0], self.size)
        return found, np.vstack([p, np.zeros(p.shape[1])])[found] * (SCALE**n)[:, None]

    def long_forward(self, word: str, p: np.ndarray):
        """Per block of ends of a long word: its start, alpha of the ``reach`` ends up to there and of its own, and the logarithm they are divided by."""
        marked, n = "▁" + word, np.array(self.lengths)
        alpha, offset = np.zeros((self.reach + BLOCK_ENDS, p.shape[1])), np.zeros(p.shape[1])
        alpha[self.reach - 1] = 1
        for start in range(0, len(marked), BLOCK_ENDS):
            _, weight = self._block(marked, start, p)
            alpha[self.reach :] = 0
            for i, w in enumerate(weight, self.reach):
                alpha[i] = (alpha[i - n] * w).sum(0)
            yield start, alpha.copy(), offset
            alpha[: self.reach] = alpha[BLOCK_ENDS:].copy()
            top = alpha[: self.reach].max(0)
            top[top == 0] = 1
            alpha[: self.reach] /= top
            offset = offset + np.log(top)

    def long_expected(self, word: str, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in a long word that is met ``counts`` (language) times."""
        marked, n = "▁" + word, np.array(self.lengths)
        blocks = list(self.long_forward(word, p))
        beta, back = np.zeros((self.reach + BLOCK_ENDS, p.shape[1])), np.zeros(p.shape[1])
        last = self.reach + len(word) % BLOCK_ENDS
        beta[last] = 1
        total = np.log(blocks[-1][1][last]) + blocks[-1][2]
        uses = np.zeros((len(p) + 1, p.shape[1]))
        for start, alpha, offset in reversed(blocks):
            found, weight = self._block(marked, start, p)
            for i in range(self.reach + len(found) - 1, self.reach - 1, -1):
                beta[i - n] += weight[i - self.reach] * beta[i]
            at = np.arange(self.reach, self.reach + len(found))[:, None]
            np.add.at(uses, found, counts * alpha[at - n] * weight * beta[at] * np.exp(offset + back - total))
            beta[BLOCK_ENDS:] = beta[: self.reach].copy()
            beta[:BLOCK_ENDS] = 0
            top = beta.max(0)
            top[top == 0] = 1
            beta /= top
            back = back + np.log(top)
        return uses[:-1]

    def expected(self, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece; counts (word, language) says how often each word is met."""
        uses = np.zeros_like(p)
        for w, own in zip(words, counts):
            if len(w) > WORD_CHARS:
                met = np.flatnonzero(own)
                uses[:, met] += self.long_expected(w, own[met], p[:, met])
        short = [i for i, w in enumerate(words) if len(w) <= WORD_CHARS]
        if not short:
            return uses
        words, counts = [words[i] for i in short], counts[short]
        alpha, lengths, width, steps = self.forward(words, p)
        beta = np.zeros_like(alpha)
        beta[np.arange(len(words)), lengths] = 1
        total = alpha[np.arange(len(words)), lengths]
        for end, n, at, piece in reversed(steps):
            weight = p[piece] * SCALE**n
            np.add.at(uses, piece, counts[at] * alpha[at, end - n] * weight * beta[at, end] / total[at])
            beta[at, end - n] += weight * beta[at, end]
        return uses


def _by_length(words: list[str], most: int = 4_000):
    """Lists of positions of words of like length."""
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    return [order[i : i + most] for i in range(0, len(order), most)]


def fit_pieces(lattice: Lattice, counts: dict[str, dict[str, int]], languages: list[str]) -> np.ndarray:
    """Piece probabilities (piece, language) from word counts by language."""
    words = sorted({w for own in counts.values() for w in own})
    table = np.array([[counts[lang].get(w, 0) for lang in languages] for w in words], float).reshape(len(words), len(languages))
    p = np.full((lattice.size + 1, len(languages)), 1 / (lattice.size + 1))
    groups = _by_length(words)
    for _ in range(ROUNDS):
        uses = np.zeros_like(p)
        for own in groups:
            uses += lattice.expected([words[i] for i in own], table[own], p)
        uses[-1] = 0
        total = uses.sum(0)
        p = np.where(total > 0, (1 - SPREAD) * uses / np.maximum(total, 1e-300), 0) + SPREAD / (lattice.size + 1)
        p[-1] = 1e-7
    return p


def words_of(text: str) -> list[str]:
    return letters(text.lower())


class Model:
    """Languages in order of name, and what tells them apart."""

    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p
        self.lattice = Lattice(pieces)
        self.words = BatchMemo(self._words, most_bytes=16 << 20)
        self.chunks = BatchMemo(self._chunks, most_bytes=40 << 20)

    def _words(self, words: list[str]) -> list[bytes]:
        out: list = [None] * len(words)
        for own in _by_length(words):
            for i, row in zip(own, self.lattice.log_probabilities([words[i] for i in own], self.p)):
                out[i] = row.tobytes()
        return out

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """The sum over a chunk's words and, last, their number (long words count more than once)."""
        own = [words_of(c) for c in chunks]
        rows = np.frombuffer(b"".join(self.words.values([w for x in own for w in x])), float).reshape(-1, len(self.languages))
        stops = np.cumsum([0, *map(len, own)])
        sums = np.vstack([np.zeros((1, len(self.languages))), np.cumsum(rows, 0)])[stops]
        numbers = [sum(-(-len(w) // WORD_CHARS) for w in x) for x in own]
        return [np.r_[a, n].tobytes() for a, n in zip(np.diff(sums, axis=0), numbers)]

    def tell(self, texts: list[str]) -> list[tuple[str | None, float, float]]:
        """(best language, its scaled log-likelihood, log of the sum over languages) of each text; null without a word."""
        split = [t.split() for t in texts]
        values = self.chunks.values([c for own in split for c in own])
        out, at = [], 0
        for own in split:
            rows = np.frombuffer(b"".join(values[at : at + len(own)]), float).reshape(-1, len(self.languages) + 1)
            at += len(own)
            sums = rows.sum(0)
            if not sums[-1]:
                out.append((None, 0.0, 0.0))
                continue
            z = sums[:-1] / np.sqrt(sums[-1])
            best = int(z.argmax())
            out.append((self.languages[best], float(z[best]), float(z[best] + np.log(np.exp(z - z[best]).sum()))))
        return out


def train(docs: DataFrame, usable: Column, vocabulary: str) -> list[Model]:
    """Models from doc_id, text and lang of the rows that ``usable`` admits; rows without doc_id or lang are left out.

    Each holds up to LANGUAGES_TOGETHER languages; languages are fitted on their
    own, so it makes no difference which ones are together. Two passes: rows per
    language (a column scan), then the word counts of each language's sample,
    which are what the driver gets, some languages at a time.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & usable)
    sizes = known.groupBy("lang").count().orderBy("lang").collect()
    pieces = pieces_of(vocabulary)

    def count(arrow):
        per_worker("language-count", dict)
        found: Counter = Counter()
        for batch in arrow:
            for lang, (_, text) in zip(batch.column("lang").to_pylist(), texts_of(batch)):
                found.update((lang, w) for w in words_of(text))
        yield from batches(pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]), ((*k, n) for k, n in found.items()), 20_000)

    models = []
    for at in range(0, len(sizes), LANGUAGES_TOGETHER):
        own = sizes[at : at + LANGUAGES_TOGETHER]
        share = F.create_map(*[F.lit(x) for r in own for x in (r["lang"], min(1.0, SAMPLE_ROWS / r["count"]))])
        drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
        words = drawn.select("doc_id", "text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
        got = words.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= SAMPLE_WORDS).select("lang", "word", "n").toPandas()
        languages = [r["lang"] for r in own]
        counts: dict = {lang: {} for lang in languages}
        for lang, rows in got.groupby("lang"):
            counts[lang] = dict(zip(rows.word, rows.n.tolist()))
        models.append(Model(languages, pieces, fit_pieces(Lattice(pieces), counts, languages)))
    return models


def _teller(shared):
    """What a broadcast model tells of texts."""

    def tell(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        name, *content = shared.value
        model = per_worker(("language", name), lambda: Model(*content))
        for own in texts:
            rows = [r for part in sliced((i, t or "") for i, t in enumerate(own)) for r in model.tell([t for _, t in part])]
            yield pd.DataFrame(rows, columns=["lang", "top", "total"])

    return tell


def predict_documents(docs: DataFrame, models: list[Model], column: str = "language") -> DataFrame:
    """``docs`` with a further ``column`` (struct of lang and score), in place of one of that name; other columns and all rows stay.

    A null or empty text, or one without a letter, is ``und`` with score 0; so is
    every text where no language was learned.
    """
    told = []
    for model in models:
        name = hash((tuple(model.languages), model.p.tobytes()))
        shared = docs.sparkSession.sparkContext.broadcast((name, model.languages, model.pieces, model.p))

        told.append(F.pandas_udf(_teller(shared), "lang string, top double, total double")("text"))
    if len(told) < 2:
        found = told[0] if told else F.struct(F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("top"), F.lit(0.0).alias("total"))
    else:
        # The best of the models' best; their totals add up.
        best = F.array_max(F.array(*[F.struct(t["top"].alias("top"), t["lang"].alias("lang")) for t in told]))
        most = F.greatest(*[t["total"] for t in told])
        total = most + F.log(sum((F.exp(t["total"] - most) for t in told), F.lit(0.0)))
        found = F.struct(best["lang"].alias("lang"), best["top"].alias("top"), total.alias("total"))
    name = unused(docs, "told")
    t = F.col(name)
    language = F.struct(F.coalesce(t["lang"], F.lit(UNDETERMINED)).alias("lang"), F.when(t["lang"].isNotNull(), F.least(F.lit(1.0), F.exp(t["top"] - t["total"]))).otherwise(0.0).alias("score"))
    return docs.withColumn(name, found).withColumn(column, language).drop(name)


def op6_segmentation_marginalised_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a model that saw no held-out document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = train(docs, crc32_mod(F.col("doc_id"), 4) != 2, public_tokenizers.path("piece_bpe_32k.model"))
    found = predict_documents(docs.select("doc_id", "text"), models)
    return found.select(
        "doc_id",
        F.coalesce(crc32_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"),
    )
