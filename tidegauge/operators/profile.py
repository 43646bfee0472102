"""Baseline profile of a table: one row per column, plus histogram, top values and a seeded sample."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.kinds import CATEGORICAL, DATETIME, NUMERIC, columns_of, kinds, nan_to_null
from tidegauge.functions.numeric import elapsed_days
from tidegauge.plans import stats
from tidegauge.session import hold, rows

# Fixed values
NUMERIC_BINS = 10
TOP_N = 10
SAMPLE_VALUES = 1000
SAMPLE_SEED = 0
NULL_RATE_FLOOR = 0.95
MIN_ROWS_FOR_IDENTIFIER = 10


@dataclass(frozen=True)
class Baseline:
    """The frames describing what a table normally looks like. All hold a few rows per column."""

    row_count: int
    columns: DataFrame  # column, dtype, kind, null_rate, minimum…std, cardinality, first/last/span
    histogram: DataFrame  # column, bin, low_edge, high_edge, n
    top_values: DataFrame  # column, value, n, position
    sample: DataFrame  # column, value
    excluded: DataFrame  # column, reason


def column_summary(df: DataFrame) -> DataFrame:
    """Null rate and kind-specific scalars for every column, in one scan."""
    by_kind = kinds(df)
    null_double, null_string = F.lit(None).cast("double"), F.lit(None).cast("string")

    def measures(c: str) -> dict:
        numeric, moment = by_kind[c] == NUMERIC, by_kind[c] == DATETIME
        value = F.col(c).cast("double")
        return {
            "rows": F.count(F.lit(1)),
            "nulls": F.count_if(F.col(c).isNull()),
            "minimum": F.min(value) if numeric else null_double,
            "maximum": F.max(value) if numeric else null_double,
            "mean": F.avg(value) if numeric else null_double,
            "std": F.stddev_pop(value) if numeric else null_double,
            "first_at": F.min(c).cast("string") if moment else null_string,
            "last_at": F.max(c).cast("string") if moment else null_string,
            "span_days": elapsed_days(F.max(c), F.min(c)) if moment else null_double,
        }

    summary = stats.per_column(df, df.columns, measures)
    declared = F.broadcast(stats.declared_columns(df))  # one row per column of the schema
    return declared.join(summary, "column").withColumn(
        "null_rate", F.when(F.col("rows") > 0, F.col("nulls") / F.col("rows")).otherwise(F.lit(0.0))
    )


def seeded_sample(df: DataFrame, columns: list[str], size: int = SAMPLE_VALUES, seed: int = SAMPLE_SEED) -> DataFrame:
    """Up to ``size`` values per numeric column; the same ones whatever the partitioning.

    A row's place in a column's order is a hash of the row, the column and the seed. Every task keeps the ``size`` smallest of each column while it reads, so
    no more than that leaves it, and of all these the smallest are kept again. Rows of one hash are equal rows, whose values are equal too.
    """
    if not columns:
        return rows(df.sparkSession, [], "column string, value double")
    whole = F.xxhash64(F.lit(seed), *[stats.hashable(df, c) for c in df.columns])
    numbers = df.select(whole.alias("h"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.uint64), np.zeros(0)) for _ in columns]
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            for i in range(len(columns)):
                v = batch.column(i + 1).to_numpy(zero_copy_only=False)
                there = ~np.isnan(v)
                own = (h[there] ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
                own ^= own >> np.uint64(29)
                own, v = np.concatenate([held[i][0], own]), np.concatenate([held[i][1], v[there]])
                first = np.lexsort((v, own))[:size]
                held[i] = own[first], v[first]
        for i, (own, v) in enumerate(held):
            if len(v):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i, np.int32)), pa.array(own.view(np.int64)), pa.array(v)], ["i", "h", "value"])

    found = numbers.mapInArrow(smallest, "i int, h long, value double")
    # unsigned order, as in the tasks
    order = Window.partitionBy("i").orderBy(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), "value")
    names = F.array(*[F.lit(c) for c in columns])
    kept = found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= size)
    return kept.select(F.get(names, F.col("i")).alias("column"), "value")


def looks_like_identifier(rows, distinct):
    return (rows >= MIN_ROWS_FOR_IDENTIFIER) & (distinct == rows)


def profile(df: DataFrame) -> Baseline:
    df = nan_to_null(df)
    texts, numbers = columns_of(df, CATEGORICAL), columns_of(df, NUMERIC)
    summary = column_summary(df)
    if texts:
        counts = stats.text_counts(df, texts)
        distinct = stats.distinct_counts(counts).select("column", "cardinality")
        summary = summary.join(distinct, "column", "left").withColumn(
            "cardinality", F.when(F.col("kind") == CATEGORICAL, F.coalesce("cardinality", F.lit(0)))
        )
        top = stats.top_values(counts, TOP_N).select("column", "value", "n", "position")
    else:
        summary = summary.withColumn("cardinality", F.lit(None).cast("bigint"))
        top = rows(df.sparkSession, [], "column string, value string, n bigint, position int")
    # one row per column of the schema: small by construction, and every later step reads it
    summary = hold(summary)
    identifier = (F.col("kind") == CATEGORICAL) & looks_like_identifier(F.col("rows"), F.col("cardinality"))
    kept = summary.where(~F.coalesce(identifier, F.lit(False)))
    excluded = summary.where(identifier).select(
        "column", F.lit("every row holds its own value, as an identifier does").alias("reason")
    )
    row_count = summary.agg(F.max("rows")).first()[0] or 0
    names = [r["column"] for r in excluded.collect()]
    top = top.where(~F.col("column").isin(names)) if names else top
    empty_hist = "column string, bin int, low_edge double, high_edge double, n bigint"
    return Baseline(
        row_count,
        kept.drop("rows", "nulls"),
        hold(stats.histogram(df, numbers, NUMERIC_BINS)) if numbers else rows(df.sparkSession, [], empty_hist),
        hold(top),
        hold(seeded_sample(df, numbers)) if numbers else rows(df.sparkSession, [], "column string, value double"),
        excluded,
    )


def sanity_floors(baseline: Baseline, null_rate_floor: float = NULL_RATE_FLOOR) -> DataFrame:
    """Reasons a profile must not become a baseline (no rows: it may)."""
    mostly_null = baseline.columns.where(F.col("null_rate") > null_rate_floor).select(
        "column", F.format_string("%.1f%% null, above the %.0f%% floor", F.col("null_rate") * 100, F.lit(null_rate_floor * 100)).alias("reason")
    )
    constant = baseline.columns.where((F.col("kind") == NUMERIC) & (F.col("std") == 0.0)).select(
        "column", F.lit("zero variance").alias("reason")
    )
    left, gone = baseline.columns.count(), baseline.excluded.count()
    result = mostly_null.unionByName(constant)
    if not left and gone:
        nothing = baseline.excluded.agg(F.lit(None).cast("string").alias("column"), F.lit("every column was excluded as an identifier").alias("reason"))
        result = result.unionByName(nothing)
    return result
