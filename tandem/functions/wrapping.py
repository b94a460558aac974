"""Greedy line breaking of whole texts as a Column expression."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tandem.functions.fixed import BLANKS

# Fixed value: the widest line of a page in characters.
WIDTH = 82


def wrapped(text: Column, width: int = WIDTH) -> Column:
    """The lines (array of strings) of a text: words joined by one blank, as many as fit in ``width`` characters; a longer word has a line of its own.

    A line is the longest stretch from a word's start that ends before a blank or
    the end and is no longer than the width; where there is none, the word. That
    is a pattern, whose matches jump from line to line: each character is read
    about once, and no word becomes a row. Null stays null; a text without a word
    has no lines.
    """
    bare = F.btrim(F.regexp_replace(text, BLANKS, " "), F.lit(" "))
    return F.regexp_extract_all(bare, F.lit(f"[^ ](?:.{{0,{width - 1}}})(?= |\\z)|[^ ]+"), F.lit(0))
