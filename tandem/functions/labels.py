"""Label normalization and similarity as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.fixed import SPACE, SPACE_CHARS, SPACES

# What counts as a prefix, as punctuation around a label, and as a label with a sub-part.
PREFIX = rf"(?i)^(ans|answer|question|qn|q)\.?{SPACE}*"
SECOND_PREFIX = rf"(?i)^q\.?{SPACE}*"
LEADING, TRAILING = r"^[.\-:]+", r"[.\-:)]+$"
SUB_PART = rf"^(\d+){SPACE}*[.(\-{SPACES}]*\(?{SPACE}*([a-zA-Z0-9])\)?{SPACE}*$"
NO_NUMBER = 9007199254740991


def let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once: a nested expression would be copied into every use."""
    return F.transform(F.array(value), use)[0]


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def _bare(raw: Column) -> Column:
    s = trimmed(F.regexp_replace(F.regexp_replace(trimmed(raw), PREFIX, ""), SECOND_PREFIX, ""))
    return trimmed(F.regexp_replace(F.regexp_replace(s, LEADING, ""), TRAILING, ""))


def canonical(raw: Column) -> Column:
    """The label that equal labels share: ``5``, ``4(a)``, or the lower-cased rest; null for a null or blank label."""
    return F.when(raw.rlike(f"[^{SPACES}]"), F.lower(F.regexp_replace(_bare(raw), SUB_PART, "$1($2)")))


def order_of(canonical: Column) -> Column:
    """Order of canonical labels: number * 100 plus the sub-part; labels without a number, and null ones, come last."""
    part = F.regexp_extract(canonical, r"^\d+\((.)\)$", 1)
    number = F.regexp_extract(canonical, r"^(\d+)", 1).try_cast("long") * 100
    offset = F.when(part.rlike("[a-z]"), F.ascii(part) - 96).otherwise(50 + F.ascii(part))
    return F.coalesce(F.when(canonical.rlike(r"^\d+\(.\)$"), number + offset).when(canonical.rlike(r"^\d+$"), number), F.lit(NO_NUMBER)).cast("long")


def sort_key(raw: Column) -> Column:
    """Order of raw labels."""
    return let(canonical(raw), order_of)


def same_label(a: Column, b: Column) -> Column:
    """Whether both labels are present and normalize alike."""
    return F.coalesce(canonical(a) == canonical(b), F.lit(False))


def compared(label: Column) -> Column:
    """What of a label is compared: it, normalized (once more, if it is canonical already)."""
    return F.coalesce(canonical(label), label)


def closeness(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of two labels as they are compared."""
    longer = F.greatest(F.length(a), F.length(b), F.lit(1)).cast("double")
    return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def similarity(a: Column, b: Column) -> Column:
    """Closeness of two labels, which are normalized first."""
    return let(F.struct(compared(a).alias("x"), compared(b).alias("y")), lambda p: closeness(p["x"], p["y"]))


def digits(label: Column) -> Column:
    return F.regexp_replace(F.coalesce(label, F.lit("")), r"[^0-9]", "")
