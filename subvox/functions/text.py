"""Text scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column, max_len: int = 48) -> Column:
    """Lower case, runs of other characters to ``_``, no ``_`` at the ends, ``unknown`` when empty."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")
    bare = F.regexp_replace(plain, "^_+|_+$", "")
    return F.substring(F.when(bare == "", "unknown").otherwise(bare), 1, max_len)


def first_word(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", 2)[0]


def normalize_word(text: Column) -> Column:
    """Lower case, single spaces, ``_`` to ``-``: the lookup form of a word."""
    bare = F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")
    return F.replace(F.regexp_replace(bare, r"\s+", " "), F.lit("_"), F.lit("-"))
