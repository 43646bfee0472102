"""Column expressions for text: whitespace, labels, normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(column: Column) -> Column:
    """Strip every kind of white space (``trim`` strips blanks only)."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def fold(column: Column) -> Column:
    return F.lower(strip(column))


def title_case(column: Column) -> Column:
    """Capital after every non-letter, small letters elsewhere."""
    pieces = F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(p.substr(1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def label(column: Column) -> Column:
    """Trim, collapse inner white space, title case."""
    return title_case(F.regexp_replace(strip(column.cast("string")), r"\s+", " "))
