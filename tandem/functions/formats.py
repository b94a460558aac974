"""Display formats and upload checks as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted types and names, and the largest upload.
ACCEPTED_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/jpg")
ACCEPTED_NAME = r"(?i)\.(pdf|png|jpe?g)$"
MOST_BYTES = 10 * 1024 * 1024


def one_decimal(x: Column) -> Column:
    """Half-up to one decimal, always with the decimal."""
    tenths = F.floor(x * 10 + 0.5)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def bytes_text(n: Column) -> Column:
    kb = n / 1024.0
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit("B"))).when(kb < 1024, F.concat(F.floor(kb + 0.5).cast("string"), F.lit("KB"))).otherwise(F.concat(one_decimal(kb / 1024), F.lit("MB")))


def marks_text(x: Column) -> Column:
    """A whole number as it is, others with one decimal."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(one_decimal(x))


def mime_type(declared: Column, name: Column) -> Column:
    """The declared type if known, else by the name's ending, else the declared one or a general one."""
    by_name = F.when(F.lower(name).rlike(r"\.pdf$"), "application/pdf").when(F.lower(name).rlike(r"\.png$"), "image/png").when(F.lower(name).rlike(r"\.jpe?g$"), "image/jpeg")
    return F.when(declared.isin(*ACCEPTED_TYPES), declared).otherwise(F.coalesce(by_name, declared, F.lit("application/octet-stream")))


def upload_error(declared: Column, name: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """What is wrong with an upload: type, then too large, then empty; null if nothing is."""
    accepted = F.coalesce(declared.isin(*ACCEPTED_TYPES), F.lit(False)) | name.rlike(ACCEPTED_NAME)
    return F.when(~accepted, "type").when(size > most, "too-large").when(size == 0, "empty")


def confidence_text(confidence: Column) -> Column:
    return F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("%"))


def score_text(awarded: Column, possible: Column) -> Column:
    """``a/b``, a dash without either."""
    return F.coalesce(F.concat(marks_text(awarded), F.lit("/"), marks_text(possible)), F.lit("—"))


def entry_date(saved_at: Column) -> Column:
    return F.date_format(saved_at, "d MMM yyyy, hh:mm a")


def ring_offset(percent: Column) -> Column:
    """What is left of a ring, with the percent held between 0 and 100."""
    return 100 - F.greatest(F.lit(0), F.least(F.lit(100), percent))


def display_label(linked: Column, label: Column) -> Column:
    """``Q`` and the label of a linked question, empty for one without a label, ``Unmapped`` otherwise."""
    return F.when(~linked, "Unmapped").otherwise(F.coalesce(F.concat(F.lit("Q"), label), F.lit("")))


def opened_later(created_at: Column, saved_at: Column, seconds: int = 60) -> Column:
    """Whether an entry was opened again more than so many seconds after it was made."""
    return saved_at - created_at > F.make_dt_interval(secs=F.lit(seconds))
