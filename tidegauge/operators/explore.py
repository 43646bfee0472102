"""Exploration statistics: summaries, missingness, correlation, outliers, trend, shape.

Each function returns one row per finding. Scans are shared: scalars of all columns come from one wide
aggregation, quantiles from narrowing histograms, ranks of all columns from one sort.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.kinds import CATEGORICAL, DATETIME, NUMERIC, columns_of, nan_to_null
from tidegauge.functions.numeric import micros
from tidegauge.functions.pvalues import correlation_p, k_squared
from tidegauge.plans import order, ranks, select, stats
from tidegauge.plans.skew import BROADCAST_ROWS
from tidegauge.session import hold, rows, settle


@dataclass(frozen=True)
class Settings:
    top_n: int = 10
    correlation_floor: float = 0.3
    correlation_min_n: int = 30
    correlation_columns: int | None = None
    spearman_margin: float = 0.1
    outlier_examples: int = 10
    trend_floor: float = 0.3
    seasonality_floor: float = 0.5
    seasonality_lags: tuple[int, ...] = (7, 12, 24, 30, 52, 365)
    normality_min_rows: int = 8
    modality_min_rows: int = 20
    modality_bins: int = 12
    missing_min_support: int = 5
    missing_floor: float = 0.95
    high_cardinality: float = 0.9
    near_unique: float = 0.99
    cardinality_min_rows: int = 10


# Fixed values
IQR_FACTOR = 1.5
NORMAL_P = 0.05
PEAK_SHARE, VALLEY_SHARE = 0.05, 0.4
PAIRS_PER_PASS = 40
#: Columns of many distinct values whose ranks are looked up by shuffling the rows.
LOOKED_UP = 8


# -- summaries ---------------------------------------------------------------------------------------

def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    df = nan_to_null(df)
    columns = list(columns) if columns is not None else columns_of(df, NUMERIC)
    scalars = stats.per_column(df, columns, lambda c: {
        "count": F.count(F.lit(1)),
        "null_count": F.count_if(F.col(c).isNull()),
        "minimum": F.min(F.col(c).cast("double")),
        "maximum": F.max(F.col(c).cast("double")),
        "mean": F.avg(F.col(c).cast("double")),
        "std": F.stddev_pop(F.col(c).cast("double")),
        "skew": stats.corrected_skewness(c),
    })
    probs = [0.25, 0.5, 0.75]
    quartiles = select.quantiles(df, columns, probs)
    return scalars.join(
        quartiles.select("column", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3")),
        "column", "left",
    ).withColumn("null_rate", F.try_divide(F.col("null_count"), F.col("count")))


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns) if columns is not None else columns_of(df, CATEGORICAL)
    counts = stats.text_counts(df, columns)
    mode = counts.groupBy("column").agg(
        F.count("*").alias("cardinality"),
        # most frequent, the first in value order among equals
        F.max_by("value", F.struct("n")).alias("any_mode"), F.max("n").alias("mode_count"),
    )
    first = counts.join(mode.select("column", "mode_count"), "column").where("n = mode_count").groupBy("column").agg(
        F.min("value").alias("mode")
    )
    scalars = stats.per_column(df, columns, lambda c: {
        "count": F.count(F.lit(1)), "null_count": F.count_if(F.col(c).isNull()),
    })
    return (
        scalars.join(mode.drop("any_mode"), "column", "left").join(first, "column", "left")
        .withColumn("cardinality", F.coalesce("cardinality", F.lit(0)))
        .withColumn("null_rate", F.try_divide(F.col("null_count"), F.col("count")))
    )


def top_frequencies(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    return stats.top_values(stats.text_counts(df, columns), k).select("column", "position", "value", "n")


def datetime_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns) if columns is not None else columns_of(df, DATETIME)
    scalars = stats.per_column(df, columns, lambda c: {
        "count": F.count(F.lit(1)),
        "null_count": F.count_if(F.col(c).isNull()),
        "first_at": F.min(c).cast("timestamp"),
        "last_at": F.max(c).cast("timestamp"),
        "span_days": (micros(F.max(c)) - micros(F.min(c))) / F.lit(86_400_000_000.0),
    })
    return scalars.join(frequencies(df, columns), "column", "left")


def frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, frequency): the regular spacing of the distinct instants, NULL when irregular.

    n distinct instants between a minimum and a maximum are evenly spaced exactly when each lies a whole
    number of steps (max - min) / (n - 1) above the minimum, so nothing needs sorting. Months are tested
    the same way on the month number.
    """
    instants = (
        df.unpivot([], [F.col(c).cast("timestamp").alias(c) for c in columns], "column", "at")
        .where("at is not null").distinct()
        .select("column", "at", F.unix_micros("at").alias("us"),
                (F.year("at") * 12 + F.month("at")).alias("m"))
    )
    limits = instants.groupBy("column").agg(
        F.count("*").alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"),
        F.countDistinct("m").alias("months"), (F.max("m") - F.min("m") + 1).alias("month_span"),
        F.min("at").alias("at0"),
        F.bool_and((F.dayofmonth("at") == 1) & (F.date_trunc("day", "at") == F.col("at"))).alias("starts"),
        F.bool_and((F.last_day("at") == F.to_date("at")) & (F.date_trunc("day", "at") == F.col("at"))).alias("ends"),
    ).where("n >= 3")
    limits = hold(limits)  # one row per column of the schema
    step = (F.col("hi") - F.col("lo")) / (F.col("n") - 1)
    whole = (F.col("hi") - F.col("lo")) % (F.col("n") - 1) == 0
    spaced = instants.select("column", "us").join(F.broadcast(limits.withColumn("step", step.cast("bigint")).withColumn("whole", whole)), "column")
    even = spaced.groupBy("column").agg(F.bool_and(F.col("whole") & ((F.col("us") - F.col("lo")) % F.greatest(F.col("step"), F.lit(1)) == 0)).alias("even"))
    every_month = (F.col("months") == F.col("n")) & (F.col("month_span") == F.col("n"))
    second, minute, hour, day, week = 1_000_000, 60_000_000, 3_600_000_000, 86_400_000_000, 604_800_000_000

    def times(unit: int, code: str):
        k = (F.col("step") / unit).cast("bigint")
        return F.concat(F.when(k > 1, k.cast("string")).otherwise(""), F.lit(code))

    named = (
        F.when(F.col("even") & (F.col("step") % week == 0), F.concat(times(week, "W-"), F.upper(F.date_format("at0", "EEE"))))
        .when(F.col("even") & (F.col("step") % day == 0), times(day, "D"))
        .when(F.col("even") & (F.col("step") % hour == 0), times(hour, "h"))
        .when(F.col("even") & (F.col("step") % minute == 0), times(minute, "min"))
        .when(F.col("even") & (F.col("step") % second == 0), times(second, "s"))
        .when(every_month & F.col("starts"), "MS")
        .when(every_month & F.col("ends"), "ME")
    )
    return limits.withColumn("step", step.cast("bigint")).join(even, "column").select("column", named.alias("frequency"))


def cardinality_notes(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Text columns whose values are nearly all different. Values are counted by their prints, so no text is moved."""
    texts = columns_of(df, CATEGORICAL)
    if not texts:
        return rows(df.sparkSession, [], "column string, cardinality bigint, row_count bigint, unique_ratio double, note string")
    present = stats.per_column(df, texts, lambda c: {"non_null": F.count(c)})
    distinct = present.join(stats.distinct_per_column(df, texts).withColumnRenamed("distinct", "cardinality"), "column")
    ratio = F.col("cardinality") / F.col("non_null")
    return distinct.where((F.col("non_null") >= settings.cardinality_min_rows) & (ratio >= settings.high_cardinality)).select(
        "column", "cardinality", F.col("non_null").alias("row_count"), ratio.alias("unique_ratio"),
        F.when(ratio >= settings.near_unique, "near_unique").otherwise("high_cardinality").alias("note"),
    )


# -- missingness -------------------------------------------------------------------------------------

def missing_patterns(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pairs of columns that are null together, from joint null counts (upper triangle only)."""
    df = nan_to_null(df)
    per_column = stats.per_column(df, df.columns, lambda c: {"nulls": F.count_if(F.col(c).isNull()), "rows": F.count(F.lit(1))})
    nulls = {r["column"]: (r["nulls"], r["rows"]) for r in per_column.where("nulls > 0").collect()}
    pairs = list(itertools.combinations(sorted(nulls), 2))
    found = []
    if pairs:
        # the table is read once; pairs are counted over its distinct null patterns
        flags = df.select(*[F.col(c).isNull().alias(c) for c in sorted(nulls)])
        patterns = settle(flags.groupBy(*flags.columns).agg(F.count("*").alias("__n")))
    for chunk in _chunks(pairs, PAIRS_PER_PASS):
        together = patterns.agg(*[F.coalesce(F.sum(F.when(F.col(a) & F.col(b), F.col("__n"))), F.lit(0)) for a, b in chunk]).first()
        found += [(a, b, together[i], nulls[a][0], nulls[b][0], nulls[a][1]) for i, (a, b) in enumerate(chunk)]
    joint = rows(df.sparkSession, found, "column_a string, column_b string, support bigint, nulls_a bigint, nulls_b bigint, sample_size bigint")
    b_given_a, a_given_b = F.col("support") / F.col("nulls_a"), F.col("support") / F.col("nulls_b")
    floor = settings.missing_floor
    both, forward, backward = (b_given_a >= floor) & (a_given_b >= floor), b_given_a >= floor, a_given_b >= floor
    return joint.where((F.col("support") >= settings.missing_min_support) & (forward | backward)).select(
        F.when(forward, F.col("column_a")).otherwise(F.col("column_b")).alias("narrower"),
        F.when(forward, F.col("column_b")).otherwise(F.col("column_a")).alias("broader"),
        F.when(both, "co_occurring").otherwise("one_directional").alias("relationship"),
        "support",
        F.when(both, F.least(b_given_a, a_given_b)).when(forward, b_given_a).otherwise(a_given_b).alias("confidence"),
        "sample_size",
    )


def _chunks(items: list, size: int):
    for start in range(0, len(items), size):
        yield items[start : start + size]


# -- correlation -------------------------------------------------------------------------------------

CORRELATION = "column_a string, column_b string, method string, coefficient double, n bigint, p_value double"
SKIPPED = "subject string, reason string"


def within_column_cap(df: DataFrame, columns: Sequence[str], cap: int | None) -> tuple[list[str], list[tuple[str, str]]]:
    """The ``cap`` columns of highest variance (None: all); the others with the reason they were left out."""
    if cap is None or len(columns) <= cap:
        return list(columns), []
    variance = stats.per_column(df, list(columns), lambda c: {"v": F.var_pop(F.col(c).cast("double"))}).collect()
    ranked = sorted(variance, key=lambda r: (-(r["v"] or 0.0), r["column"]))
    kept = {r["column"] for r in ranked[:cap]}
    out = [(c, f"not among the {cap} columns of highest variance") for c in sorted(columns) if c not in kept]
    return [c for c in columns if c in kept], out


def correlations(df: DataFrame, columns: Sequence[str] | None = None, settings: Settings = Settings(), all_pairs: bool = False, methods: Sequence[str] = ("pearson", "spearman")) -> tuple[DataFrame, DataFrame]:
    """Pearson above the floor, and Spearman where it is clearly stronger; plus what was skipped. Ranks are taken only where Spearman is among ``methods``."""
    spark = df.sparkSession
    df = nan_to_null(df)
    columns, skipped = within_column_cap(df, columns if columns is not None else columns_of(df, NUMERIC), settings.correlation_columns)
    columns = sorted(columns)
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = list(itertools.combinations(columns, 2))
    measured, found = pair_figures(numbers, pairs), []
    eligible = []
    for (a, b), m in measured:
        if m["n"] < settings.correlation_min_n:
            skipped.append((f"{a},{b}", f"too few complete rows: n={m['n']}, needs {settings.correlation_min_n}"))
        elif m["a_varies"] and m["b_varies"]:
            eligible.append((a, b, m["n"], m["r"]))
            if "pearson" in methods and (all_pairs or abs(m["r"]) >= settings.correlation_floor):
                found.append((a, b, "pearson", m["r"], m["n"], correlation_p(m["r"], m["n"])))
    ranked = rank_correlations(numbers, [(a, b) for a, b, _, _ in eligible]) if "spearman" in methods else {}
    for a, b, n, r in eligible:
        rho = ranked.get((a, b))
        if rho is not None and (all_pairs or (abs(rho) >= settings.correlation_floor and abs(rho) - abs(r) > settings.spearman_margin)):
            found.append((a, b, "spearman", rho, n, correlation_p(rho, n)))
    return rows(spark, found, CORRELATION), rows(spark, skipped, SKIPPED)


def pearson_matrix(numbers: DataFrame, columns: Sequence[str]) -> dict[tuple[str, str], float]:
    """All coefficients between columns without nulls, in one pass over the rows."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(numbers).select("v")
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    return {(a, b): float(matrix[i][j]) for i, a in enumerate(columns) for j, b in enumerate(columns) if i < j}


def pair_figures(numbers: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[tuple[str, str], dict]]:
    """Per pair: n, r, and whether either side varies, over the rows where both are present.

    Columns without nulls share one pass however many pairs they form; only pairs with nulls, whose rows
    differ from pair to pair, are aggregated one by one.
    """
    if not pairs:
        return []
    used = sorted({c for p in pairs for c in p})
    facts = {r["column"]: r for r in stats.per_column(numbers, used, lambda c: {
        "rows": F.count(F.lit(1)), "nulls": F.count_if(F.col(c).isNull()), "varies": F.coalesce(F.min(c) < F.max(c), F.lit(False)),
    }).collect()}
    steady = [c for c in used if not facts[c]["nulls"] and facts[c]["varies"]]
    matrix = pearson_matrix(numbers, steady) if len(steady) > 1 else {}
    figures: dict[tuple[str, str], dict] = {}
    for a, b in pairs:
        if not facts[a]["nulls"] and not facts[b]["nulls"]:
            figures[a, b] = {"n": facts[a]["rows"], "r": matrix.get((a, b)), "a_varies": facts[a]["varies"], "b_varies": facts[b]["varies"]}
    for chunk in _chunks([p for p in pairs if p not in figures], PAIRS_PER_PASS):
        exprs = []
        for a, b in chunk:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            exprs.append(F.struct(
                F.count_if(both).alias("n"), stats.correlation(a, b).alias("r"),
                (F.min(F.when(both, F.col(a))) < F.max(F.when(both, F.col(a)))).alias("a_varies"),
                (F.min(F.when(both, F.col(b))) < F.max(F.when(both, F.col(b)))).alias("b_varies"),
            ))
        figures.update({p: m.asDict() for p, m in zip(chunk, numbers.agg(*exprs).first())})
    return [(p, figures[p]) for p in pairs]


def _whole_rank_correlations(numbers: DataFrame, pairs: list[tuple[str, str]], n: int) -> dict[tuple[str, str], float]:
    """Spearman coefficients of columns without holes in a table of ``n`` rows."""
    used = sorted({c for p in pairs for c in p})
    by_value, middle = ranks.value_ranks(numbers, used), F.lit((n + 1) / 2)
    spread = F.sum(F.col("n") * F.pow(F.col("rank") - middle, F.lit(2.0)))
    known = {r["column"]: r for r in by_value.groupBy("column").agg(F.count("*").alias("size"), spread.alias("spread")).collect()}
    sizes = {c: known[c]["size"] for c in used}
    if sum(size > BROADCAST_ROWS for size in sizes.values()) > LOOKED_UP:
        # each lookup moves whole rows: for a wide table it is cheaper to move cells
        ranked = ranks.average_ranks(numbers, used).select(*[F.col(f"r{i}")[0].alias(c) for i, c in enumerate(used)])
    else:
        ranked = ranks.with_value_ranks(numbers, used, by_value, sizes)
    chunks = list(_chunks(pairs, PAIRS_PER_PASS))
    ranked = ranked if len(chunks) == 1 else settle(ranked)
    result: dict[tuple[str, str], float] = {}
    for chunk in chunks:
        # ranks are centred before they are multiplied, as their mean is known
        together = ranked.agg(*[F.sum((F.col(a) - middle) * (F.col(b) - middle)).alias(f"p{i}") for i, (a, b) in enumerate(chunk)]).first()
        for (a, b), s in zip(chunk, together):
            scale = math.sqrt(known[a]["spread"]) * math.sqrt(known[b]["spread"])
            result[a, b] = s / scale if scale else math.nan
    return result


def rank_correlations(numbers: DataFrame, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Spearman coefficients over the rows where both columns are present.

    Columns without holes are ranked by their distinct values, and the ranks are looked up by value. Pairs with holes (and tables of many columns with many distinct
    values) are ranked in one pass over their cells, and once more for each column with holes among the rows where that one is present, so a
    pair with holes takes its two ranks from there. The number of jobs does not depend on the number of pairs but for passes of ``PAIRS_PER_PASS``.
    """
    if not pairs:
        return {}
    used = sorted({c for p in pairs for c in p})
    facts = stats.per_column(numbers, used, lambda c: {"n": F.count(c), "nulls": F.count_if(F.col(c).isNull())}).collect()
    holes = sorted(r["column"] for r in facts if r["nulls"])
    result: dict[tuple[str, str], float] = {}
    whole = [p for p in pairs if not set(holes) & set(p)]
    if whole:
        result = _whole_rank_correlations(numbers, whole, max(r["n"] for r in facts))
    rest = [p for p in pairs if set(holes) & set(p)]
    if rest:
        used = sorted({c for p in rest for c in p})
        ranked = settle(ranks.average_ranks(numbers, used, holes))
        at, among = {c: F.col(f"r{i}") for i, c in enumerate(used)}, {c: i + 1 for i, c in enumerate(holes)}
    for chunk in _chunks(rest, PAIRS_PER_PASS):
        found = ranked.agg(*[stats.correlation(at[a][among.get(b, 0)], at[b][among.get(a, 0)]).alias(f"p{i}") for i, (a, b) in enumerate(chunk)]).first()
        result.update(dict(zip(chunk, found)))
    return result


# -- outliers ----------------------------------------------------------------------------------------

def outlier_fences(quartiles: DataFrame) -> DataFrame:
    """Fences from (column, q0, q1), the outer quartiles."""
    spread = F.col("q1") - F.col("q0")
    return quartiles.where(spread != 0).select(
        "column", (F.col("q0") - IQR_FACTOR * spread).alias("lower"), (F.col("q1") + IQR_FACTOR * spread).alias("upper")
    )


def outlier_clusters(df: DataFrame, columns: Sequence[str] | None = None, key: str | None = None, settings: Settings = Settings()) -> DataFrame:
    """Values beyond the IQR fences per column, with up to ten example keys (smallest first)."""
    df = nan_to_null(df)
    columns = sorted(columns if columns is not None else columns_of(df, NUMERIC))
    probs = [0.25, 0.75]
    quartiles = select.quantiles(df, columns, probs)
    fences = hold(outlier_fences(quartiles).where(F.col("column").isin(columns)))  # one row per column of the schema
    known = {r["column"]: (r["lower"], r["upper"]) for r in fences.collect()}
    if not known:
        return rows(df.sparkSession, [], "column string, lower double, upper double, count bigint, sample_size bigint, examples array<string>")
    outside = {c: (F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in known.items()}
    counted = stats.per_column(df, list(known), lambda c: {"count": F.count_if(outside[c]), "sample_size": F.count(c)})
    result = fences.join(counted, "column").where("count > 0")
    if key is None:
        return result.withColumn("examples", F.array().cast("array<string>"))
    hits = df.unpivot([F.col(key).alias("__key")], [outside[c].alias(c) for c in known], "column", "hit").where("hit")
    first = Window.partitionBy("column").orderBy("__key")
    examples = (
        hits.withColumn("i", F.row_number().over(first)).where(F.col("i") <= settings.outlier_examples)
        .groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("__key").cast("string").alias("k")))), lambda s: s["k"]).alias("examples"))
    )
    return result.join(examples, "column", "left")


# -- trend and seasonality ---------------------------------------------------------------------------

TREND = (
    "numeric_column string, datetime_column string, slope double, intercept double, r_squared double, p_value double,"
    " n bigint, start_at timestamp, end_at timestamp, seasonality_period int, frequency string"
)


def trends(
    df: DataFrame, moments: Sequence[str] | None = None, columns: Sequence[str] | None = None,
    settings: Settings = Settings(), seasonality: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Straight-line fit of each numeric column over each datetime column, all pairs in shared scans."""
    df = nan_to_null(df)
    moments = sorted(moments if moments is not None else columns_of(df, DATETIME))
    columns = sorted(columns if columns is not None else columns_of(df, NUMERIC))
    start = df.agg(*[F.min(micros(c)).alias(c) for c in moments]).first() if moments else {}
    found, skipped = [], []
    for chunk in _chunks([(t, y) for t in moments for y in columns], PAIRS_PER_PASS):
        exprs = []
        for t, y in chunk:
            both = F.col(t).isNotNull() & F.col(y).isNotNull()
            x, v = _seconds(t, start[t]), F.col(y).cast("double")
            exprs.append(F.struct(
                F.count_if(both).alias("n"), F.regr_slope(v, x).alias("slope"), F.regr_intercept(v, x).alias("intercept"),
                stats.correlation(v, x).alias("r"), F.min(F.when(both, F.col(t).cast("timestamp"))).alias("lo"),
                F.max(F.when(both, F.col(t).cast("timestamp"))).alias("hi"),
            ))
        for (t, y), m in zip(chunk, df.agg(*exprs).first()):
            label = f"{y}@{t}"
            r2 = m["r"] ** 2 if m["r"] is not None and m["r"] == m["r"] else 0.0
            if m["n"] < 3:
                skipped.append((label, f"no line through {m['n']} complete row(s), needs 3"))
            elif m["lo"] == m["hi"]:
                skipped.append((label, "no line: one instant only"))
            elif r2 < settings.trend_floor:
                skipped.append((label, f"weak line: r2 {r2:.3f} < {settings.trend_floor}"))
            else:
                found.append((y, t, m["slope"], m["intercept"], r2, correlation_p(m["r"], m["n"]), m["n"], m["lo"], m["hi"]))
    spacing = {}
    if found:
        spacing = {r["column"]: r["frequency"] for r in frequencies(df, sorted({f[1] for f in found})).collect()}
    complete = [
        (*f, season_of(df, f[1], f[0], start[f[1]], f[2], f[3], settings) if seasonality else None, spacing.get(f[1])) for f in found
    ]
    return rows(df.sparkSession, complete, TREND), rows(df.sparkSession, skipped, SKIPPED)


def _seconds(moment: str, start: int):
    return (micros(moment) - F.lit(start)) / F.lit(1_000_000.0)


def season_of(df: DataFrame, moment: str, column: str, start: int, slope: float, intercept: float, settings: Settings) -> int | None:
    """The row lag at which the residuals of the fit repeat most, if they do."""
    x, y = _seconds(moment, start), F.col(column).cast("double")
    pair = df.where(F.col(moment).isNotNull() & F.col(column).isNotNull()).select(
        F.col(moment).alias("t"), y.alias("y"), (y - (F.lit(intercept) + F.lit(slope) * x)).alias("e")
    )
    spread = pair.agg(F.stddev_pop("y").alias("y"), F.stddev_pop("e").alias("e"), F.count("*").alias("n")).first()
    if not spread["y"] or spread["e"] < 1e-6 * spread["y"]:
        return None
    lags = [k for k in settings.seasonality_lags if 1 <= k < spread["n"] // 2]
    if not lags:
        return None
    scores = lag_correlations(pair, "e", [F.asc("t"), F.asc("y")], lags)
    best = max(lags, key=lambda k: abs(scores.get(k) or 0.0))
    return best if abs(scores.get(best) or 0.0) >= settings.seasonality_floor else None


def lag_correlations(df: DataFrame, value: str, ordering, lags: Sequence[int], block_rows: int = order.BLOCK_ROWS) -> dict[int, float]:
    """Correlation of a series with itself ``lag`` rows earlier."""
    shifted = order.with_earlier(df, ordering, value, lags, block_rows=block_rows)
    return dict(zip(lags, shifted.agg(*[stats.correlation(value, f"lag_{k}") for k in lags]).first()))


# -- shape -------------------------------------------------------------------------------------------

SHAPE = "column string, skew double, normality string, modality string, n bigint, p_value double"


def distribution_shape(df: DataFrame, columns: Sequence[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    df = nan_to_null(df)
    columns = sorted(columns if columns is not None else columns_of(df, NUMERIC))
    moments = stats.per_column(df, columns, lambda c: {
        "n": F.count(c), "g1": F.skewness(c), "g2": F.kurtosis(c), "skew": stats.corrected_skewness(c),
    }).where("n > 0").collect()
    bins = stats.histogram(df, columns, settings.modality_bins).groupBy("column").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("bin", "n"))), lambda s: s["n"]).alias("counts")
    )
    shapes = {r["column"]: r["shape"] for r in bins.select("column", modality_hint(F.col("counts")).alias("shape")).collect()}
    found = []
    for m in moments:
        test = k_squared(_number(m["g1"]), _number(m["g2"]), m["n"]) if m["n"] >= settings.normality_min_rows else None
        normality = "insufficient_data" if test is None else "likely_normal" if test[1] >= NORMAL_P else "likely_non_normal"
        modality = "insufficient_data" if m["n"] < settings.modality_min_rows else shapes[m["column"]]
        found.append((m["column"], _number(m["skew"]), normality, modality, m["n"], test[1] if test else None))
    return rows(df.sparkSession, found, SHAPE)


def _number(value):
    return None if value is None or value != value else float(value)


def modality_hint(counts: Column) -> Column:
    """``unimodal``, or ``multimodal_suspected`` where two summits of the histogram have a valley between them.

    A summit is higher than both neighbours and holds at least ``PEAK_SHARE`` of the highest bin. It counts as a hump of its own if the
    lowest bin since the highest summit before it is at most ``VALLEY_SHARE`` of the smaller of the two.
    """

    def height(i):
        return F.get(counts, i)

    places = F.sequence(F.lit(0), F.size(counts) - 1)
    beside = lambda i: F.greatest(F.coalesce(height(i - 1), F.lit(-1)), F.coalesce(height(i + 1), F.lit(-1)))
    summits = F.filter(places, lambda i: (height(i) > beside(i)) & (height(i) >= F.array_max(counts) * PEAK_SHARE))
    # each summit with the highest one before it, the first of several equals
    steps = F.transform(summits, lambda j: F.struct(j.alias("at"), F.array_max(F.transform(F.filter(summits, lambda i: i < j), lambda i: F.struct(height(i).alias("n"), (-i).alias("back")))).alias("top")))
    parted = F.exists(steps, lambda s: F.coalesce(
        F.array_min(F.slice(counts, 1 - s["top"]["back"], s["at"] + s["top"]["back"])) <= F.least(s["top"]["n"], height(s["at"])) * VALLEY_SHARE, F.lit(False),
    ))
    return F.when(parted, "multimodal_suspected").otherwise("unimodal")


# -- everything --------------------------------------------------------------------------------------

def seeded_rows(df: DataFrame, key: str, cap: int, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows, chosen by a hash of the key, the same ones for any partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(cap)


FINDING = ["finding_type", "columns", "metrics", "attrs", "sample_size", "p_value", "r_squared"]


def _finding(frame: DataFrame, kind: str, columns, metrics: Sequence[str], attrs: Sequence[str] = (), n="sample_size", p=None, r2=None) -> DataFrame:
    def as_map(names, kind_name):
        if not names:
            return F.lit(None).cast(f"map<string,{kind_name}>")
        pairs = F.array(*[F.struct(F.lit(m).alias("k"), F.col(m).cast(kind_name).alias("v")) for m in names])
        return F.map_from_entries(F.filter(pairs, lambda s: s["v"].isNotNull()))

    return frame.select(
        F.lit(kind).alias("finding_type"), F.array(*columns).alias("columns"), as_map(metrics, "double").alias("metrics"),
        as_map(attrs, "string").alias("attrs"), F.col(n).cast("bigint").alias("sample_size"),
        (F.col(p) if p else F.lit(None).cast("double")).alias("p_value"),
        (F.col(r2) if r2 else F.lit(None).cast("double")).alias("r_squared"),
    )


def explore(
    df: DataFrame, exclusions: dict[str, str] | None = None, key: str | None = None, settings: Settings = Settings(),
    row_cap: int | None = None, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """All findings with stable ids ``{type}-{position}``, and everything skipped with its reason."""
    df = nan_to_null(df)
    exclusions = exclusions or {}
    numbers, texts, moments = (columns_of(df, k) for k in (NUMERIC, CATEGORICAL, DATETIME))
    measured = [c for c in numbers if c not in exclusions]
    parts: list[DataFrame] = []
    if numbers:
        parts.append(_finding(numeric_summary(df, numbers), "summary_stat", [F.col("column")],
                              ["count", "null_count", "null_rate", "minimum", "maximum", "mean", "median", "std", "q1", "q3", "skew"], n="count"))
    if texts:
        parts.append(_finding(categorical_summary(df, texts), "summary_stat", [F.col("column")],
                              ["count", "null_count", "null_rate", "cardinality", "mode_count"], ["mode"], n="count"))
        parts.append(_finding(cardinality_notes(df, settings), "cardinality_note", [F.col("column")], ["cardinality", "unique_ratio"], ["note"], n="row_count"))
    if moments:
        parts.append(_finding(datetime_summary(df, moments), "summary_stat", [F.col("column")],
                              ["count", "null_count", "span_days"], ["first_at", "last_at", "frequency"], n="count"))
    parts.append(_finding(missing_patterns(df, settings), "missing_pattern", [F.col("narrower"), F.col("broader")], ["support", "confidence"], ["relationship"]))
    skipped = [rows(df.sparkSession, [(c, exclusions[c]) for c in numbers if c in exclusions], SKIPPED)]
    if row_cap and not key:
        raise ValueError("a row cap needs a key to choose the rows by")
    capped = bool(row_cap)
    work = seeded_rows(df, key, row_cap, seed) if capped else df
    if measured:
        related, left_out = correlations(work, measured, settings)
        parts.append(_finding(related, "correlation", [F.col("column_a"), F.col("column_b")], ["coefficient"], ["method"], n="n", p="p_value"))
        skipped.append(left_out)
        parts.append(_finding(outlier_clusters(work, measured, key, settings), "outlier_cluster", [F.col("column")], ["lower", "upper", "count"]))
        if moments:
            moving, left_out = trends(work, moments, measured, settings)
            parts.append(_finding(moving, "trend", [F.col("numeric_column"), F.col("datetime_column")], ["slope", "seasonality_period"],
                                  ["frequency", "start_at", "end_at"], n="n", p="p_value", r2="r_squared"))
            skipped.append(left_out)
        parts.append(_finding(distribution_shape(work, measured, settings), "distribution_shape", [F.col("column")], ["skew"], ["normality", "modality"], n="n", p="p_value"))
    # findings number a few per column pair, so ids may be given in one ordered pass
    everything = None
    for i, part in enumerate(parts):
        part = part.withColumn("module", F.lit(i))
        everything = part if everything is None else everything.unionByName(part)
    everything = hold(everything)
    place = Window.orderBy("module", F.to_json("columns"), F.to_json("attrs"))
    numbered = everything.withColumn("position", F.row_number().over(place) - 1)
    findings = numbered.withColumn("finding_id", F.concat_ws("-", "finding_type", "position")).withColumn(
        "seed", F.lit(seed if row_cap else None).cast("int")
    ).drop("module")
    reasons = skipped[0]
    for part in skipped[1:]:
        reasons = reasons.unionByName(part)
    return findings, reasons


def quality_context(events: DataFrame) -> DataFrame:
    """How the validation events of a run were resolved."""
    return events.where("action_taken is not null").groupBy("action_taken").agg(F.count("*").alias("n"))


# -- chart data --------------------------------------------------------------------------------------

HISTOGRAM_BINS = 50
SCATTER_POINTS = 5000
IDENTIFIER_RATIO = 0.9


def histogram_bars(df: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    return stats.histogram(df, list(columns), bins).select(
        "column", "bin", ((F.col("low_edge") + F.col("high_edge")) / 2).alias("centre"), "n"
    )


def integer_bars(df: DataFrame, column: str, limit: int = 12) -> DataFrame:
    """Count per value of an integer column, empty when it has more than ``limit`` values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    few = counts.limit(limit + 1).agg(F.count("*")).scalar()
    return counts.where(few <= limit)


def category_bars(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Top categories, without columns whose values are almost all different."""
    counts = stats.text_counts(df, columns)
    usable = stats.distinct_counts(counts).where(F.col("cardinality") / F.col("non_null") < IDENTIFIER_RATIO)
    return stats.top_values(counts, k).join(usable.select("column"), "column", "left_semi")


def scatter_points(df: DataFrame, a: str, b: str, keys: Sequence[str], cap: int = SCATTER_POINTS) -> DataFrame:
    """Every k-th complete row in the order of ``keys``, at most ``cap`` of them."""
    pair = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*dict.fromkeys([*keys, a, b]))
    stride = F.greatest(F.floor(pair.agg(F.count("*")).scalar() / cap), F.lit(1))
    indexed = order.global_index(pair, [F.asc(k) for k in keys])
    return indexed.where((F.col("idx") % stride == 0) & (F.col("idx") / stride < cap)).select("idx", a, b)


def line_points(df: DataFrame, moment: str, column: str) -> DataFrame:
    return df.select(moment, column).dropna().orderBy(moment, column)
