"""Repair of malformed JSON text: candidate texts from the least to the most changed; the first that parses wins."""

import json
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.fixed import SPACE
from tandem.functions.labels import trimmed

#: A string (also one that is cut off), a bracket or a comma.
TOKEN = re.compile(r'"(?:[^"\\]|\\.?)*+"?|[{}\[\],]', re.S)
CLOSER = {"{": "}", "[": "]"}


def without_fences(text: Column) -> Column:
    """Without a code fence at the very start and the end, and then without white space at both ends."""
    return trimmed(unfenced(text))


def unfenced(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"(?i)^```(?:json)?{SPACE}*", ""), f"```{SPACE}*\\z", "")


def plain_quotes_no_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "“”‘’", "\"\"''"), f",{SPACE}*([}}\\]])", "$1")


def widest_span(text: Column) -> Column:
    """From the first opening bracket to the last closing one; empty where none follows."""
    return F.regexp_extract(text, r"(?s)[{\[].*[}\]]", 0)


def closed(text: str) -> str:
    """A text that ends inside a bracket or string, cut at its last comma inside brackets, with those brackets closed.

    The state after each token is the text that would close what is open there,
    so the closing text of the cut is the state at its comma. Texts that are
    whole, or have no such comma, stay as they are.
    """
    tokens = [(m.start(), m[0]) for m in TOKEN.finditer(text)]
    closing = list(accumulate((t for _, t in tokens), lambda rest, t: CLOSER[t] + rest if t in CLOSER else rest[1:] if t in "}]" else rest, initial=""))
    cut_off = tokens and tokens[-1][1][0] == '"' and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', tokens[-1][1], re.S)
    commas = [(at, rest) for (at, t), rest in zip(tokens, closing) if t == "," and rest]
    if not commas or not (closing[-1] or cut_off):
        return text
    at, rest = commas[-1]
    return text[:at] + rest


def _refused(constant: str):
    raise ValueError(constant)


#: Half of a pair of code units: no text by itself, so it stays escaped.
LONE = re.compile("[\ud800-\udfff]")


def _float(digits: str) -> float | None:
    """A number, null if it is beyond the range of doubles."""
    x = float(digits)
    return x if math.isfinite(x) else None


def _int(digits: str) -> int | None:
    return int(digits) if _float(digits) is not None else None


def _parsed(text: str) -> str | None:
    """Compact JSON of a strict JSON text (no NaN, no Infinity), null for others; numbers beyond doubles are null in it."""
    try:
        value = json.loads(text, parse_constant=_refused, parse_float=_float, parse_int=_int)
        return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, separators=(",", ":"), ensure_ascii=False))
    except (ValueError, RecursionError):
        return None


def _repaired(candidates: list[str | None]) -> str | None:
    raw, open_, bare, plain, span = candidates
    if raw is None:
        return None
    tries = (lambda: raw, lambda: open_, lambda: bare, lambda: plain, lambda: closed(plain), lambda: span, lambda: closed(span))
    return next((found for t in tries if (found := _parsed(t())) is not None), None)


def _batches(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for own in columns:
        yield pd.Series(list(map(_repaired, zip(*own))), dtype="object")


def repaired(text: Column) -> Column:
    """Compact JSON of the first repair that parses; null if none does.

    In order: the text, without fences, without outer white space, with plain
    quotes and no trailing commas, that one closed, the widest bracketed span
    (of the text before quotes were touched), and that one closed. Only parsing
    and closing are in Python.
    """
    bare = without_fences(text)
    return F.pandas_udf(_batches, "string")(text, unfenced(text), bare, plain_quotes_no_trailing_commas(bare), widest_span(bare))
