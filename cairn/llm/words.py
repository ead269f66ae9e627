"""Words of texts in DataFrame expressions: runs of characters other than space and \\x09 to \\x0D."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words, and the pattern of a run of it.
SPACES = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Array of words; empty for null texts and ones of white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, GAP)).otherwise(F.array().cast("array<string>"))


def count_words(text: Column) -> Column:
    """Number of words; 0 for null texts."""
    return F.size(words_of(text)).cast("long")
