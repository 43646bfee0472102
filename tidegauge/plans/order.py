"""Global order, ranks, running totals and exact quantiles without a one-task window.

A window without PARTITION BY, and an exact ``percentile`` over many distinct values, both end in one
task. Here rows are range-partitioned on the full ordering (so a hot value is split by the columns that
follow it), numbered inside their partition, and shifted by per-partition offsets. The offsets hold one
row per partition and group, so they stay small whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import settle

_PART, _LOCAL, _BASE = "__part", "__local", "__base"
# monotonically_increasing_id keeps the partition number above bit 33 and the row position below it
_POSITION_BITS = 33
BLOCK_ROWS = 65_536


def _numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    keys = [F.col(c).asc_nulls_first() for c in by] + list(order)
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    position = F.monotonically_increasing_id()
    return settle(ranged.withColumn("__pos", position)).select(
        *df.columns,
        F.shiftright("__pos", _POSITION_BITS).alias(_PART),
        F.col("__pos").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias(_LOCAL),
    )


def _renamed(prefix: str, columns: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(f"{prefix}{i}") for i, c in enumerate(columns)]


def _same_group(prefix: str, columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for i, c in enumerate(columns):
        condition &= F.col(c).eqNullSafe(F.col(f"{prefix}{i}"))
    return condition


def _with_offsets(numbered: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    per_part = numbered.groupBy(_PART, *by).agg(F.count("*").alias("__n"), F.min(_LOCAL).alias("__first"))
    # one row per (partition, group); the window is over that summary, not over the data
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select(
        F.col(_PART).alias("__at"),
        *_renamed("__o", by),
        (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias(_BASE),
    )
    kept = [c for c in numbered.columns if c not in (_PART, _LOCAL)]
    return numbered.join(offsets, (F.col(_PART) == F.col("__at")) & _same_group("__o", by)).select(
        *kept, (F.col(_LOCAL) + F.col(_BASE)).alias(name)
    )


def global_index(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """Add the 0-based position of each row in ``order`` (within each ``by`` group)."""
    return _with_offsets(_numbered(df, order, by), by, name)


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    totals: dict[str, str],
    by: Sequence[str] = (),
    name: str = "idx",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``name`` (position) and, per ``{column: alias}``, the inclusive running sum in ``order``.

    Sums run inside blocks of ``block_rows`` consecutive positions; the block sums (n / block_rows rows)
    are then accumulated on their own.
    """
    indexed = global_index(df, order, by, name).withColumn("__block", F.floor(F.col(name) / block_rows))
    inside = Window.partitionBy(*by, "__block").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    blocks = indexed.groupBy(*by, "__block").agg(*[F.sum(c).alias(f"__sum_{i}") for i, c in enumerate(totals)])
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *_renamed("__b", by),
        F.col("__block").alias("__block_at"),
        *[F.coalesce(F.sum(f"__sum_{i}").over(before), F.lit(0)).alias(f"__off_{i}") for i in range(len(totals))],
    )
    local = indexed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__run_{i}") for i, c in enumerate(totals)]
    )
    return local.join(offsets, (F.col("__block") == F.col("__block_at")) & _same_group("__b", by)).select(
        *df.columns,
        name,
        *[(F.col(f"__run_{i}") + F.col(f"__off_{i}")).alias(alias) for i, alias in enumerate(totals.values())],
    )


def with_earlier(
    df: DataFrame, order: Sequence[Column], value: str, lags: Sequence[int], name: str = "idx", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``lag_k``: the ``value`` found ``k`` rows earlier in ``order``, for each k, in one shuffle.

    Rows are cut into blocks by position; each block also receives the rows just before it (as many as
    the longest lag), so every pair of rows meets in exactly one block.
    """
    indexed = global_index(df, order, (), name)
    home, reach = F.floor(F.col(name) / block_rows), F.floor((F.col(name) + max(lags)) / block_rows)
    placed = indexed.withColumn("__home", home).withColumn("__block", F.explode(F.sequence(home, reach)))
    window = Window.partitionBy("__block").orderBy(name)
    return (
        placed.withColumns({f"lag_{k}": F.lag(value, k).over(window) for k in lags})
        .where("__block = __home")
        .drop("__home", "__block")
    )


def cumulative_counts(counts: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """(by…, value, n) -> plus ``upto``, the number of rows with a value <= this one in its group."""
    return running_totals(counts, [F.col("value").asc()], {"n": "upto"}, by).drop("idx")


def average_rank() -> Column:
    """1-based rank of a value from its cumulative count, ties sharing their mean rank."""
    return F.col("upto") - (F.col("n") - 1) / F.lit(2.0)


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], by: Sequence[str] = ("column",)) -> DataFrame:
    """Exact linearly interpolated quantiles from (by…, value, n): one row per group, columns q0, q1, …

    Each probability needs the values at two neighbouring positions; both are found by comparing
    positions with the cumulative counts, so no group is gathered anywhere.
    """
    return quantiles_of_cumulative(cumulative_counts(counts, by), probs, by)


def quantiles_of_cumulative(cumulative: DataFrame, probs: Sequence[float], by: Sequence[str] = ("column",)) -> DataFrame:
    totals = cumulative.groupBy(*by).agg(F.sum("n").alias("__total"))
    if by:
        sized = cumulative.join(totals.select(*_renamed("__t", by), "__total"), _same_group("__t", by))
    else:
        sized = cumulative.withColumn("__total", totals.scalar())

    start, end = F.col("upto") - F.col("n"), F.col("upto")
    picks = []
    for i, p in enumerate(probs):
        exact = F.lit(float(p)) * (F.col("__total") - 1)
        for side, position in (("lo", F.floor(exact)), ("hi", F.ceil(exact))):
            inside = (position >= start) & (position < end)
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"__{side}_{i}"))
    found = sized.groupBy(*by).agg(F.first("__total").alias("__total"), *picks)
    quantiles = []
    for i, p in enumerate(probs):
        exact = F.lit(float(p)) * (F.col("__total") - 1)
        weight = exact - F.floor(exact)
        low, high = F.col(f"__lo_{i}"), F.col(f"__hi_{i}")
        quantiles.append((low + (high - low) * weight).alias(f"q{i}"))
    return found.select(*by, *quantiles)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of one column, optionally per group."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("value"))
        .agg(F.count("*").alias("n"))
    )
    return quantiles_of_counts(counts, probs, by)
