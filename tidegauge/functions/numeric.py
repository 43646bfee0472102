"""Column expressions for numbers: formatted text, safe ratios, rounding, day differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that are not part of a number, and the comma-decimal shape
NOT_NUMERIC_CHARS = r"[^\d,.\-]"
COMMA_DECIMAL = r"^-?\d{1,3}(\.\d{3})*,\d+$"

MICROS_PER_DAY = 86_400_000_000


def as_column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def number_from_text(column: Column | str) -> Column:
    """``$1,234.56``, ``1.234,56``, ``2.3%``, ``10 000`` -> double; anything else -> NULL."""
    bare = F.regexp_replace(as_column(column).cast("string"), NOT_NUMERIC_CHARS, "")
    comma_decimal = F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")
    plain = F.regexp_replace(bare, ",", "")
    return F.when(bare.rlike(COMMA_DECIMAL), comma_decimal).otherwise(plain).try_cast("double")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL for a zero or missing denominator, never infinity."""
    return F.try_divide(as_column(numerator).cast("double"), F.nullif(as_column(denominator).cast("double"), F.lit(0.0)))


def half_even(column: Column | str, places: int = 6) -> Column:
    return F.bround(as_column(column).cast("double"), places)


def micros(column: Column | str) -> Column:
    """Microseconds since the epoch for DATE, TIMESTAMP and TIMESTAMP_NTZ alike."""
    return F.unix_micros(as_column(column).cast("timestamp"))


def whole_days(later: Column, earlier: Column) -> Column:
    """Complete 24-hour units between two instants."""
    return F.floor((micros(later) - micros(earlier)) / F.lit(MICROS_PER_DAY))


def elapsed_days(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS_PER_DAY))
