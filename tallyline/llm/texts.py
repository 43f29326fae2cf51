"""Small column helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing entry.
MISSING_WORDS = ("na", "none", "unknown", "null")


def missing(c: Column) -> Column:
    """Null, no letter or digit at all, or letters and digits that are just a word for a missing entry."""
    bare = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
    return c.isNull() | (bare == "") | bare.isin(*MISSING_WORDS)
