"""Exact quantiles of many columns at once, by narrowing histograms instead of sorting.

Every wanted position starts in the interval from its column's minimum to its maximum. A scan counts the rows of each open interval by bucket (with
map-side partial sums, so a task sends at most ``BUCKETS`` counts an interval), the bucket that holds the position becomes its interval, and
so on until an interval is one value or holds few rows; those are then read out exactly. The first buckets are spaced by magnitude, so a few
huge values do not crowd the rest into one; later ones evenly. No row is moved, whatever the size of the table, and the number of scans is bounded by
the bits of a double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import hold

BUCKETS = 2048
#: Rows of an interval that are read out instead of being counted by bucket again.
FEW = 1 << 15
LARGEST = 1.7976931348623157e308
#: Powers of two below the largest magnitude that the first buckets tell apart.
BINADES = 40


def _finite(value: Column) -> Column:
    return F.greatest(F.least(value, F.lit(LARGEST)), F.lit(-LARGEST))


def _share(value: Column, low: Column, high: Column) -> Column:
    # halves, so that the width of an interval is a double too
    width = _finite(high) * 0.5 - _finite(low) * 0.5
    return F.coalesce(F.try_divide(_finite(value) * 0.5 - _finite(low) * 0.5, width), F.lit(0.0))


def _magnitude(value: Column, low: Column, high: Column) -> Column:
    """A rising function of the value that spreads magnitudes: every step of it is monotone in doubles."""
    unit = F.greatest(F.abs(_finite(low)), F.abs(_finite(high))) * F.lit(2.0**-BINADES)
    return F.signum(value) * F.coalesce(F.log1p(F.abs(_finite(value)) / F.when(unit > 0, unit)), F.lit(0.0))


def _bucket(value: Column, low: Column, high: Column, first: bool, buckets: int) -> Column:
    spread = _share(*(_magnitude(x, low, high) for x in (value, low, high))) if first else _share(value, low, high)
    return F.greatest(F.least(F.floor(spread * buckets), F.lit(buckets - 1)), F.lit(0)).cast("int")


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), few: int = FEW, buckets: int = BUCKETS) -> DataFrame:
    """(by…, column, q0, q1, …): linearly interpolated quantiles of the values present, one row per column (and group) with any.

    ``by`` are columns of few distinct values, such as folds. NaN counts as missing.
    """
    spark, group = df.sparkSession, [*by, "column"]
    if not columns or not probs:
        return spark.createDataFrame([], ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "column string", *(f"q{i} double" for i in range(len(probs)))]))
    long = df.unpivot([F.col(c) for c in by], [F.col(c).cast("double").alias(c) for c in columns], "column", "v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    facts = long.groupBy(*group).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    exact = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    wanted = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(s).alias("side"), end(exact(p)).cast("long").alias("at"), (exact(p) - F.floor(exact(p))).alias("weight"))
        for i, p in enumerate(probs) for s, end in enumerate((F.floor, F.ceil))
    ]))
    # from here on at most two rows a quantile, column and group
    state = hold(facts.select(*group, "lo", "hi", "n", wanted.alias("w")).select(*group, "lo", "hi", "n", "w.*"))
    first = True
    while True:
        wide = (F.col("lo") < F.col("hi")) & (F.col("n") > few)
        asked = hold(state.where(wide))
        if asked.isEmpty():
            break
        place = _bucket(F.col("v"), F.col("lo"), F.col("hi"), first, buckets).alias("bucket")
        counted = _inside(long, asked, group).groupBy(*group, "lo", "hi", place).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        found = _positions(asked.drop("n"), counted, group, ["bucket"])
        narrowed = found.select(*group, F.col("a").alias("lo"), F.col("b").alias("hi"), F.col("c").alias("n"), "i", "side", (F.col("at") - F.col("before")).alias("at"), "weight")
        state = hold(state.where(~wide).unionByName(narrowed))
        first = False
    done = state.where(F.col("lo") == F.col("hi")).select(*group, "i", "side", "weight", F.col("lo").alias("value"))
    rest = hold(state.where(F.col("lo") < F.col("hi")))
    if not rest.isEmpty():
        read = _inside(long, rest, group).groupBy(*group, "lo", "hi", "v").agg(F.count("*").alias("c"))
        done = done.unionByName(_positions(rest.drop("n"), read, group, ["v"]).select(*group, "i", "side", "weight", F.col("v").alias("value")))
    picked = done.groupBy(*group).agg(*[
        F.max(F.when((F.col("i") == i) & (F.col("side") == s), F.col(c))).alias(f"{c}_{i}_{s}") for i in range(len(probs)) for s in (0, 1) for c in ("value", "weight")
    ])
    ends = lambda i: (F.col(f"value_{i}_0"), F.col(f"value_{i}_1"), F.col(f"weight_{i}_0"))
    return picked.select(*group, *[F.when(lo == hi, lo).otherwise(lo + (hi - lo) * w).alias(f"q{i}") for i in range(len(probs)) for lo, hi, w in (ends(i),)])


def _inside(long: DataFrame, intervals: DataFrame, group: list[str]) -> DataFrame:
    """The values of each interval; intervals are a few rows a column."""
    return long.join(F.broadcast(intervals.select(*group, "lo", "hi").distinct()), group).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))


def _positions(asked: DataFrame, counts: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The counted entry of its interval that holds each asked position, and how many rows come ``before`` it."""
    running = Window.partitionBy(*group, "lo", "hi").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = counts.withColumn("before", F.coalesce(F.sum("c").over(running), F.lit(0)))
    return summed.join(F.broadcast(asked), [*group, "lo", "hi"]).where((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("c")))


def medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, median)."""
    return quantiles(df, columns, [0.5], by).withColumnRenamed("q0", "median")


