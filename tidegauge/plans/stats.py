"""Many columns, one scan: wide aggregations turned into one row per column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.kinds import CATEGORICAL, NUMERIC, columns_of, kinds, text_of
from tidegauge.session import rows

# columns per aggregation: wider plans leave whole-stage code generation
COLUMNS_PER_PASS = 50


def per_column(df: DataFrame, columns: Sequence[str], measures: Callable[[str], dict[str, Column]]) -> DataFrame:
    """Aggregate every column with ``measures(column)`` and return (column, measure…) rows."""
    parts = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        chunk = columns[start : start + COLUMNS_PER_PASS]
        named = {c: measures(c) for c in chunk}
        wide = df.agg(
            *[e.alias(f"m{i}_{m}") for i, c in enumerate(chunk) for m, e in named[c].items()]
        )
        rows = F.array(*[
            F.struct(F.lit(c).alias("column"), *[F.col(f"m{i}_{m}").alias(m) for m in named[c]])
            for i, c in enumerate(chunk)
        ])
        parts.append(wide.select(F.inline(rows)))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def declared_columns(df: DataFrame) -> DataFrame:
    """(position, column, dtype, kind) from the schema."""
    by_kind = kinds(df)
    described = [(i, name, dtype, by_kind[name]) for i, (name, dtype) in enumerate(df.dtypes)]
    return rows(df.sparkSession, described, "position int, column string, dtype string, kind string")


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value double), missing values left out."""
    return df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "column", "value").where(
        F.col("value").isNotNull()
    )


def long_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.unpivot([], [text_of(df, c).alias(c) for c in columns], "column", "value").where(
        F.col("value").isNotNull()
    )


def counts_of(long: DataFrame) -> DataFrame:
    """(column, value, n): the distinct values, pre-aggregated on the map side."""
    return long.groupBy("column", "value").agg(F.count("*").alias("n"))


def number_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return counts_of(long_numbers(df, columns if columns is not None else columns_of(df, NUMERIC)))


def text_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return counts_of(long_texts(df, columns if columns is not None else columns_of(df, CATEGORICAL)))


def distinct_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("column").agg(F.count("*").alias("cardinality"), F.sum("n").alias("non_null"))


def fingerprint(*columns: Column) -> Column:
    """128 bits standing for a value, for counting distinct ones without moving long texts about."""
    a, b = prints(*columns)
    return F.struct(a.alias("a"), b.alias("b"))


def prints(*columns: Column) -> tuple[Column, Column]:
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def distinct_per_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, distinct) without the values themselves."""
    # numbers instead of names and flat longs instead of structs: keys of a fixed width are counted without copying them about
    cells = F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), *[F.when(F.col(c).isNotNull(), p).alias(n) for n, p in zip("ab", prints(hashable(df, c)))]) for i, c in enumerate(columns)
    ]))
    long = df.select(cells).where(F.col("a").isNotNull()).distinct()
    names = rows(df.sparkSession, list(enumerate(columns)), "c int, column string")
    return long.groupBy("c").agg(F.count("*").alias("distinct")).join(F.broadcast(names), "c").select("column", "distinct")


def hashable(df: DataFrame, column: str) -> Column:
    return F.col(column) if df.schema[column].dataType.typeName() != "map" else F.to_json(column)


def top_values(counts: DataFrame, k: int = 10, by: Sequence[str] = ("column",)) -> DataFrame:
    """The k most frequent values per column; equal counts in value order.

    The rank filter is applied before the shuffle as well, so a column with millions of distinct
    values sends only k rows per task.
    """
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin 0..bins-1, the last one closed; a constant column is widened by one half each way."""
    lo = F.when(low == high, low - 0.5).otherwise(low)
    hi = F.when(low == high, high + 0.5).otherwise(high)
    raw = F.floor((value - lo) * F.lit(float(bins)) / (hi - lo)).cast("int")
    return F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))


def histogram(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """(column, bin, low_edge, high_edge, n) with empty bins kept."""
    limits = per_column(
        df, columns, lambda c: {"low": F.min(F.col(c).cast("double")), "high": F.max(F.col(c).cast("double"))}
    ).where(F.col("low").isNotNull())
    limits = F.broadcast(limits)  # one row per column of the schema
    binned = (
        long_numbers(df, columns)
        .join(limits, "column")
        .groupBy("column", bin_of(F.col("value"), F.col("low"), F.col("high"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    lo = F.when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low"))
    hi = F.when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high"))
    width = (hi - lo) / F.lit(float(bins))
    grid = limits.select("column", lo.alias("lo"), hi.alias("hi"), width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    last = F.col("bin") == bins - 1
    return grid.join(binned, ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("lo") + F.col("bin") * F.col("width")).alias("low_edge"),
        F.when(last, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def corrected_skewness(column: str) -> Column:
    """Bias-corrected sample skewness; NULL below three values, 0 for a constant column."""
    n = F.count(column).cast("double")
    corrected = F.skewness(column) * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n < 3, F.lit(None)).when(F.min(column) == F.max(column), F.lit(0.0)).otherwise(corrected)




def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's r over the rows where both are present; NULL, not an error, when either does not vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    both = a.isNotNull() & b.isNotNull()
    spread = F.stddev_pop(F.when(both, a)) * F.stddev_pop(F.when(both, b))
    return F.try_divide(F.covar_pop(a, b), spread)
