"""Encoding with public tokenizer files, memoised by white-space chunk.

The vocabulary files are read on the driver and sent to the executors as
broadcasts (each is under 2 MB); a path is always a parameter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tandem.llm._shared import ENTRY, per_worker

#: A character that is one token by itself in the vocabulary that drops white space.
MARK = "~"
#: Chunks that the library encodes in one call.
TOGETHER = 1_000
#: Plain words that the library encodes in one call.
WORDS_TOGETHER = 10_000
#: Bytes of the texts that are cut together, about: in general, and where chunks are few for their texts.
SLICE_BYTES, FINE_BYTES = 1 << 21, 1 << 22
#: A chunk that these rules of a file leave as it is, whole and without a change.
PLAIN_WORD = re.compile(r"[ \n]?[a-zß-öø-ÿ]+")
FOLDING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTING = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
#: What every control token of such a file begins with; texts that hold it are cut at white space alone.
CONTROL = "<|"
#: A single blank between other characters: byte-level patterns never match across the place before it.
SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)")
#: White space that is anything but a single blank or line break between other characters.
OTHER_SPACE = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _bytes_of(*characters: str) -> np.ndarray:
    """For each byte the number, from 1, of the group of ASCII characters that it is in; else 0."""
    kinds = np.zeros(256, np.uint8)
    for k, own in enumerate(characters, 1):
        kinds[np.frombuffer(own.encode(), np.uint8)] = k
    return kinds


LETTER, MARKS, APOSTROPHE, BLANK = 1, 2, 3, 4
KINDS = _bytes_of(string.ascii_lowercase, string.punctuation.replace("'", ""), "'", " \n")
#: Where a chunk begins, by the kinds of the byte before (times 8) and of its own first one. An apostrophe may belong to the letters behind it.
BEGINS = np.zeros(64, bool)
BEGINS[[8 * before + BLANK for before in range(5)] + [8 * LETTER + MARKS, 8 * LETTER + APOSTROPHE, 8 * MARKS + LETTER]] = True
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: The first byte of the characters from À to ÿ, and the second ones of × and ÷, which are no letters, of the last capital and of the first small letter.
LATIN, TIMES, DIVIDED, LAST_CAPITAL, FIRST_SMALL = 0xC3, 0x97, 0xB7, 0x9E, 0x9F


def load(path: str) -> tuple[str, bytes]:
    """Name (a digest) and content of a vocabulary file."""
    with open(path, "rb") as f:
        content = f.read()
    return hashlib.sha1(content).hexdigest(), content


def spaced_chunks(text: str) -> list[str]:
    """The text cut before each single blank that stands between other characters."""
    first, *rest = SINGLE_BLANK.split(text)
    return [first, *[" " + x for x in rest]]


def gathered(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, end to end."""
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    return values[np.repeat(starts - (stops - lengths), lengths) + np.arange(total)]


def text_slices(texts: pa.Array, most_bytes: int = SLICE_BYTES):
    """Slices of a string array with about ``most_bytes`` each; null texts become empty."""
    texts = pc.fill_null(texts, "")
    stops, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(stops, (stops[at - 1] if at else 0) + most_bytes, "right")))
        yield texts.slice(at, end - at)
        at = end


class _Held:
    """Ids of chunks, end to end, and where each chunk's ids are."""

    def __init__(self):
        self.number: dict = {}
        self.ids, self.starts, self.lengths = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64)
        self.n_ids = self.bytes = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype)])

    def add(self, chunks: list, ids: np.ndarray, lengths: np.ndarray) -> None:
        n, end = len(self.number), self.n_ids + len(ids)
        self.ids, self.starts, self.lengths = self._room(self.ids, end), self._room(self.starts, n + len(chunks)), self._room(self.lengths, n + len(chunks))
        self.ids[self.n_ids : end] = ids
        self.lengths[n : n + len(chunks)] = lengths
        self.starts[n : n + len(chunks)] = self.n_ids + np.cumsum(lengths) - lengths
        self.number.update(zip(chunks, range(n, n + len(chunks))))
        self.n_ids = end
        self.bytes += sum(map(sys.getsizeof, chunks)) + ENTRY * len(chunks) + 4 * len(ids)


class ChunkEncoder:
    """Ids of texts by a file of the tokenizers library.

    The library encodes chunks that no token can cross, so each distinct chunk
    is encoded once, many chunks in one call; ids are kept in two generations of
    about ``most_bytes``. ``drops_space`` is for vocabularies that discard white
    space: every blank or line break separates chunks. If such a file also
    has the rules FOLDING and SPLITTING, chunks end between letters and
    punctuation too and capitals are made small first (letters of ASCII and
    Latin-1), so there are fewer distinct ones; those of small letters alone,
    which both rules leave as they are, skip the rules. Otherwise (byte level) a
    chunk begins before a single blank or line break that stands between other
    characters; in texts with any other white space only blanks cut.

    Keys: a str is a chunk inside a text, without the blank it begins with; a
    tuple of one str is the first chunk of a text.
    """

    def __init__(self, content: bytes, drops_space: bool, most_bytes: int = 28 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_str(content.decode())
        self.tokenizer.no_truncation()
        self.drops_space, self.most_bytes = drops_space, most_bytes
        self.young, self.old = _Held(), _Held()
        tokens = self.tokenizer.get_vocab()
        (self.mark,) = self._library([MARK])[0].tolist() if drops_space else (None,)
        # A byte-level token stands for as many bytes as its entry has characters.
        self.sizes = np.zeros(max(tokens.values()) + 1, np.int64)
        self.sizes[list(tokens.values())] = [len(t) for t in tokens]
        self.words = None
        if drops_space and self._folds(json.loads(content)):
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends_word = np.zeros(len(self.sizes), bool)
            self.ends_word[[i for t, i in tokens.items() if t.endswith(self.tokenizer.model.end_of_word_suffix)]] = True

    @staticmethod
    def _folds(rules: dict) -> bool:
        """Whether a file has the rules that the finer chunks rest on."""
        folding, (split, *rest) = rules["normalizer"] or {}, (rules["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        return (
            folding.get("normalizers") == FOLDING
            and (split.get("type"), split.get("pattern"), split.get("behavior"), split.get("invert")) == ("Split", SPLITTING, "Removed", True)
            and [(r["type"], r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
            and (rules["model"]["type"], bool(rules["model"].get("end_of_word_suffix"))) == ("BPE", True)
            and all(t["content"].startswith(CONTROL) for t in rules["added_tokens"])
        )

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, chunks: list) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks end to end, and how many each has."""
        plain = [i for i, c in enumerate(chunks) if PLAIN_WORD.fullmatch(c)] if self.words else []
        parts = [self._plain_words([chunks[i] for i in plain[a : a + WORDS_TOGETHER]]) for a in range(0, len(plain), WORDS_TOGETHER)]
        done = set(plain)
        inner = [i for i, c in enumerate(chunks) if type(c) is str and i not in done]
        parts += [self._together([chunks[i] for i in inner[a : a + TOGETHER]]) for a in range(0, len(inner), TOGETHER)]
        lengths = np.zeros(len(chunks), np.int64)
        # A text's first chunk would grow together with what stands before it.
        alone = [i for i, c in enumerate(chunks) if type(c) is tuple]
        own = self._library([chunks[i][0] for i in alone])
        order = np.array(plain + inner + alone, np.int64)
        found = [x for _, own_lengths in parts for x in own_lengths] + [len(x) for x in own]
        ids = np.concatenate([np.zeros(0, np.uint32), *[x for x, _ in parts], *own])
        lengths[order] = found
        if not alone and not (plain and inner):
            return ids, lengths
        starts = np.empty(len(chunks), np.int64)
        starts[order] = np.cumsum(found) - found
        return gathered(ids, starts, lengths), lengths

    def _plain_words(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of plain words, whose last tokens alone have the suffix that ends a word."""
        ids = np.array(self.words.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends_word[ids])
        if len(stops) != len(chunks) or stops[-1] != len(ids) - 1:
            return self._together(chunks)
        return ids, np.diff(stops, prepend=-1)

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.drops_space:
            # A mark, which is one token, ends each chunk; chunks that have it themselves go alone.
            (ids,) = self._library([f" {MARK} ".join(chunks) + f" {MARK}"])
            stops = np.flatnonzero(ids == self.mark)
            if len(stops) != len(chunks):
                own = self._library(chunks)
                return np.concatenate(own), np.array(list(map(len, own)))
            return np.delete(ids, stops), np.diff(stops, prepend=-1) - 1
        marked = [c if c[:1] == "\n" else " " + c for c in chunks]
        (ids,) = self._library(["".join(marked)])
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(c.encode()) for c in marked])) + 1
        return ids, np.diff(stops, prepend=0)

    def _numbers(self, chunks: list) -> np.ndarray:
        """The places of distinct chunks among the young ones, after encoding what is missing."""
        if self.young.bytes > self.most_bytes:
            self.young, self.old = _Held(), self.young
        young, old = self.young, self.old
        found = list(map(young.number.get, chunks))
        if None in found:
            gaps = [i for i, number in enumerate(found) if number is None]
            missing = [chunks[i] for i in gaps]
            again = [c for c in missing if c in old.number]
            if again:
                at = np.array([old.number[c] for c in again])
                young.add(again, gathered(old.ids, old.starts[at], old.lengths[at]), old.lengths[at])
                missing = [c for c in missing if c not in old.number]
            young.add(missing, *self._encode(missing))
            for i in gaps:
                found[i] = young.number[chunks[i]]
        return np.array(found, np.int64)

    def _assembled(self, codes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given the places of their chunks and how many chunks each has."""
        lengths = self.young.lengths[codes]
        ids = gathered(self.young.ids, self.young.starts[codes], lengths)
        stops = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(per_text)])]
        return ids, np.diff(stops)

    def _split(self, texts: pa.Array, line_break: str, first_alone: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of texts that blanks and line breaks cut."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", line_break), " ")
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten()
        distinct = words.dictionary_encode()
        chunks, at = distinct.dictionary.to_pylist(), distinct.indices.to_numpy(zero_copy_only=False)
        if not first_alone:
            return self._assembled(self._numbers(chunks)[at], per_text)
        first = np.cumsum(per_text) - per_text
        firsts = words.take(pa.array(first)).dictionary_encode()
        numbers = self._numbers(chunks + [(w,) for w in firsts.dictionary.to_pylist()])
        codes = numbers[at]
        codes[first] = numbers[len(chunks) :][firsts.indices.to_numpy(zero_copy_only=False)]
        return self._assembled(codes, per_text)

    def _split_finely(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of texts without control tokens that blanks, line breaks and the places between letters and punctuation cut.

        A capital stays unless ASCII or Latin-1 letters follow it: with a combining mark, its composition may depend on its case.
        """
        offsets, raw = np.zeros(1, np.int32), np.zeros(0, np.uint8)
        if (texts := texts.cast(pa.string())).buffers()[2]:
            offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
            raw = np.frombuffer(texts.buffers()[2], np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        small = LOWER[raw]
        beside = np.flatnonzero((raw[1:] > 127) & (raw[1:] != LATIN))
        small[beside] = raw[beside]
        kinds, begins = KINDS[small], np.zeros(len(small) + 1, bool)
        second = np.flatnonzero(raw[:-2] == LATIN) + 1
        of, behind = raw[second], raw[second + 1]
        small[second[(of <= LAST_CAPITAL) & (of != TIMES) & ((behind < 128) | (behind == LATIN))]] += 32
        second = second[(small[second] >= FIRST_SMALL) & (of != TIMES) & (of != DIVIDED)]
        kinds[second - 1] = kinds[second] = LETTER
        begins[1:-1] = BEGINS[kinds[:-1] << 3 | kinds[1:]]
        begins[offsets - offsets[0]] = True
        stops = np.flatnonzero(begins).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(stops) - 1, pa.py_buffer(stops), pa.py_buffer(small))
        distinct = pieces.dictionary_encode()
        numbers = self._numbers(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        return self._assembled(numbers[distinct.indices.to_numpy(zero_copy_only=False)], np.diff(np.searchsorted(stops, offsets - offsets[0])))

    def _cut_at_blanks(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers of texts with any white space."""
        split = [[(first,), *rest] for first, *rest in map(SINGLE_BLANK.split, texts)]
        flat = [c for own in split for c in own]
        distinct = list(dict.fromkeys(flat))
        place = dict(zip(distinct, self._numbers(distinct).tolist()))
        return self._assembled(np.fromiter(map(place.__getitem__, flat), np.int64, len(flat)), np.array(list(map(len, split))))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a string array end to end, and how many each has."""
        if not self.drops_space:
            other, usual, rest = pc.match_substring_regex(texts, OTHER_SPACE), lambda x: self._split(x, " \n", True), lambda x: self._cut_at_blanks(x.to_pylist())
        elif self.words:
            other, usual, rest = pc.match_substring(texts, CONTROL), self._split_finely, lambda x: self._split(x, " ", False)
        else:
            return self._split(texts, " ", False)
        other = other.to_numpy(zero_copy_only=False)
        if not other.any():
            return usual(texts)
        plain, (more, n_more) = texts.filter(pa.array(~other)), rest(texts.filter(pa.array(other)))
        ids, n_ids = usual(plain) if len(plain) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        lengths, starts = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
        lengths[~other], lengths[other] = n_ids, n_more
        starts[~other], starts[other] = np.cumsum(n_ids) - n_ids, len(ids) + np.cumsum(n_more) - n_more
        return gathered(np.concatenate([ids, more]), starts, lengths), lengths

    def encoded(self, arrow, end_id: int):
        """(doc_ids, ids end to end, ids of each document) for batches of doc_id and text, some documents at a time.

        ``end_id`` is appended to every document; a null text is empty.
        """
        for batch in arrow:
            doc_ids, at = batch.column("doc_id").to_pylist(), 0
            for texts in text_slices(batch.column("text"), FINE_BYTES if self.words else SLICE_BYTES):
                ids, lengths = self.ids(texts)
                out = np.full(len(ids) + len(texts), end_id, np.uint32)
                inside = np.ones(len(out), bool)
                inside[np.cumsum(lengths + 1) - 1] = False
                out[inside] = ids
                yield doc_ids[at : at + len(texts)], out, lengths + 1
                at += len(texts)


def chunk_encoder(broadcast, drops_space: bool, most_bytes: int = 28 << 20) -> ChunkEncoder:
    """The worker's encoder for a broadcast of ``load()``."""
    name, content = broadcast.value
    return per_worker(("chunks", name, drops_space), lambda: ChunkEncoder(content, drops_space, most_bytes))
