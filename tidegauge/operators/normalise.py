"""Settle column types and values once, before anything is computed from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.numeric import number_from_text
from tidegauge.functions.text import fold, label
from tidegauge.operators import business
from tidegauge.plans import order, stats
from tidegauge.session import hold

# Accepted date notations besides ISO 8601
DATE_FORMATS = (
    "MM/dd/yyyy", "M/d/yyyy", "yyyy/MM/dd", "yyyy/M/d", "dd-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy",
    "yyyyMMdd", "MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "MM-dd-yyyy",
)
MIN_PARSEABLE = 0.99
TEMPORAL_MARKERS = ("DATE", "TIME")


def parsed_moment(column: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text to timestamp: ISO first, then the listed notations; a year is required, a bare time is not a date."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    attempts = [F.try_to_timestamp(text), *[F.try_to_timestamp(text, F.lit(f)) for f in formats]]
    return F.when(text.rlike(r"\d{4}"), F.coalesce(*attempts))


@dataclass(frozen=True)
class Normalised:
    data: DataFrame
    attempts: DataFrame  # column, parse_rate, coerced


def datetimes(df: DataFrame, declared: dict[str, str] | None = None, min_parseable: float = MIN_PARSEABLE, formats: Sequence[str] = DATE_FORMATS) -> Normalised:
    """Turn text columns into timestamps where nearly all values parse; report the partial ones.

    Columns declared DATE or TIME by their source are converted whatever the share.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    forced = [c for c in texts if any(m in (declared or {}).get(c, "").upper() for m in TEMPORAL_MARKERS)]
    if not texts:
        return Normalised(df, _attempts(df, []))
    measured = _attempts(df, texts, formats)
    tried = hold(measured.where("parse_rate > 0").withColumn("coerced", (F.col("parse_rate") >= min_parseable) | F.col("column").isin(forced)))
    convert = sorted({r["column"] for r in tried.where("coerced").collect()} | set(forced))
    data = df.withColumns({c: parsed_moment(c, formats) for c in convert}) if convert else df
    return Normalised(data, tried)


def _attempts(df: DataFrame, texts: Sequence[str], formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    if not texts:
        from tidegauge.session import rows

        return rows(df.sparkSession, [], "column string, parse_rate double, coerced boolean")
    return stats.per_column(df, list(texts), lambda c: {
        "parse_rate": F.try_divide(F.count_if(F.col(c).rlike(r"\d") & parsed_moment(c, formats).isNotNull()), F.count(c)),
    })


def numeric_text_share(df: DataFrame, columns: Sequence[str] | None = None, minimum: float = 0.9) -> DataFrame:
    """(column, parse_rate, looks_numeric) for text columns."""
    texts = list(columns) if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    rated = stats.per_column(df, texts, lambda c: {"parse_rate": F.try_divide(F.count(number_from_text(c)), F.count(c))})
    return rated.withColumn("looks_numeric", F.coalesce(F.col("parse_rate") >= minimum, F.lit(False)))


def money(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Currency text to double, with a one-row note: an example in and out, and how many did not parse."""
    if isinstance(df.schema[column].dataType, T.NumericType):
        return df, df.sparkSession.createDataFrame([], "column string, example_in string, example_out double, unparsed bigint")
    raw, parsed = F.col(column), number_from_text(column)
    example = F.min_by(F.struct(raw.alias("i"), parsed.alias("o")), F.when(parsed.isNotNull(), raw))
    note = df.agg(example.alias("e"), F.count_if(raw.isNotNull() & parsed.isNull()).alias("unparsed")).select(
        F.lit(column).alias("column"), F.col("e.i").alias("example_in"), F.col("e.o").alias("example_out"), "unparsed"
    )
    return df.withColumn(column, parsed), note


def ratio_column(df: DataFrame, column: str, percent_threshold: float = 1.0) -> tuple[DataFrame, bool]:
    """One convention per column: percentage points (a % sign, or a median above the threshold) become fractions."""
    numeric = isinstance(df.schema[column].dataType, T.NumericType)
    value = F.col(column).cast("double") if numeric else number_from_text(column)
    signed = False if numeric else bool(df.agg(F.bool_or(F.trim(column).endswith("%"))).first()[0])
    points = signed
    if not signed:
        middle = order.quantiles(df.withColumn("__ratio", value), "__ratio", [0.5]).first()
        points = middle is not None and middle["q0"] is not None and middle["q0"] > percent_threshold
    return df.withColumn(column, value / 100.0 if points else value), points


def labels(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Trim, collapse white space and title-case a label column; report which spellings were merged."""
    merged = (
        df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("raw")).distinct()
        .withColumn("normalised_to", label(F.col("raw")))
        .groupBy("normalised_to").agg(F.array_sort(F.collect_set("raw")).alias("from"))
        .where((F.size("from") > 1) | (F.col("from")[0] != F.col("normalised_to")))
    )
    return df.withColumn(column, label(F.col(column))), merged.select(F.lit(column).alias("column"), "normalised_to", "from")


# Labels an ad platform gives its total rows
SUMMARY_LABELS = ("total", "totals", "grand total", "summary", "all campaigns", "account total")


def drop_summary_rows(df: DataFrame, column: str, names: Sequence[str] = SUMMARY_LABELS) -> tuple[DataFrame, DataFrame]:
    """Without the platform's total rows; and (label, dropped) for what was left out."""
    is_total = F.coalesce(fold(F.col(column)).isin(*[n.lower() for n in names]), F.lit(False))
    report = df.where(is_total).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("dropped"))
    return df.where(~is_total), report


def with_value(df: DataFrame, basis: business.ValueBasis, name: str = "__value__") -> DataFrame:
    return df.withColumn(name, basis.column())
