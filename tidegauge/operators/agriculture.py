"""Crop-production rule pack: preparation to district x crop x season x year, threshold rules, chart data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numeric import half_even
from tidegauge.operators import normalise
from tidegauge.operators.packs import finding, none_skipped, nothing, run_rules, skipped
from tidegauge.operators.roles import Detection, Qualification, qualifies
from tidegauge.plans import order, stats
from tidegauge.session import hold, rows, settle

# Fixed values
REQUIRED = ("district", "crop", "production_quantity")
ANY_OF = ("season", "crop_year", "area_cultivated")
SOURCE_ROLE = {
    "district": "district", "crop": "crop", "season": "season", "year": "crop_year", "area": "area_cultivated",
    "production": "production_quantity", "rainfall": "rainfall", "price": "market_price", "given_yield": "crop_yield",
}
GRAIN = ("district", "crop", "season", "year")
SUMMED, AVERAGED = ("area", "production"), ("rainfall", "price", "given_yield")
WARNING, IMPROVEMENT, KEY_VALUE = "warning", "improvement", "key_value"


@dataclass(frozen=True)
class Config:
    yield_collapse: float = 0.6
    production_drop: float = 0.3
    rainfall_sigma: float = 2.0
    area_fall: float = 0.25
    below_median: float = 0.8
    high_variance: float = 0.5
    min_history: int = 3
    top_crops: int = 5
    normalise_labels: bool = True


@dataclass(frozen=True)
class Prepared:
    frame: DataFrame  # grain columns, area, production, rainfall, price, yield - whichever exist
    merged_labels: DataFrame  # column, normalised_to, from
    undefined: DataFrame  # reason, n


def qualification(detection: Detection) -> Qualification:
    return qualifies(detection, REQUIRED, ANY_OF)


def prepare(df: DataFrame, roles: dict[str, str], config: Config = Config()) -> Prepared:
    present = {name: roles[role] for name, role in SOURCE_ROLE.items() if roles.get(role) in df.columns}
    keys = [k for k in GRAIN if k in present]
    narrow = df.select(*[F.col(c).alias(n) if n in GRAIN else F.col(c).try_cast("double").alias(n) for n, c in present.items()])
    merged = rows(df.sparkSession, [], "column string, normalised_to string, from array<string>")
    summed, averaged = [c for c in SUMMED if c in present], [c for c in AVERAGED if c in present]
    if keys and (summed or averaged):
        # sums and counts per label as written; only then are the (far fewer) labels cleaned and merged
        raw = narrow.groupBy(*keys).agg(
            *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in summed], *[F.sum(c).alias(c) for c in averaged], *[F.count(c).alias(f"n_{c}") for c in averaged]
        )
    else:
        raw = narrow
    if config.normalise_labels:
        raw = settle(raw)
        for name in ("district", "crop", "season"):
            if name in keys:
                raw, found = normalise.labels(raw, name)
                merged = merged.unionByName(found.withColumn("column", F.lit(present[name])))
    frame = raw
    if keys and (summed or averaged):
        frame = raw.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in summed], *[F.try_divide(F.sum(c), F.sum(f"n_{c}")).alias(c) for c in averaged]
        )
    reasons = []
    if "given_yield" in present:
        frame = frame.withColumnRenamed("given_yield", "yield")
        reasons = [("no yield supplied", F.col("yield").isNull())]
    elif "area" in present and "production" in present:
        frame = frame.withColumn("yield", F.try_divide(F.col("production"), F.when(F.col("area") > 0, F.col("area"))))
        reasons = [("zero area cultivated", F.col("area") == 0), ("no area value", F.col("area").isNull())]
    frame = settle(frame)
    undefined = rows(df.sparkSession, [], "reason string, n bigint")
    for text, condition in reasons:
        undefined = undefined.unionByName(frame.agg(F.lit(text).alias("reason"), F.count_if(condition).alias("n")))
    return Prepared(frame, merged, undefined)


def _has(frame: DataFrame, *names: str) -> bool:
    return all(n in frame.columns for n in names)


def _series(frame: DataFrame, value: str) -> DataFrame:
    """Each district-crop's values in (year, season) order: the value before, the mean before, and which is last.

    The frame already holds one row per district, crop, season and year, so a series has as many rows as
    there are seasons on record.
    """
    keys = ("district", "crop")
    stamp = [c for c in ("year", "season") if _has(frame, c)]
    forward = Window.partitionBy(*keys).orderBy(*stamp)
    history = forward.rowsBetween(Window.unboundedPreceding, -1)
    return (
        frame.where(F.col(value).isNotNull() & F.col("district").isNotNull() & F.col("crop").isNotNull())
        .withColumns({
            "previous": F.lag(value).over(forward), "history": F.avg(value).over(history), "before": F.count(value).over(history),
            "back": F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in stamp])),
        })
        .where("back = 1")
        .withColumn("scope", F.concat_ws(" / ", "district", "crop"))
        .withColumn("n", F.col("before") + 1)
    )


def _need(frame: DataFrame, rule: str, *names: str):
    missing = [n for n in names if not _has(frame, n)]
    return (nothing(frame), skipped(frame, rule, f"needs {', '.join(missing)}")) if missing else None


def season_totals(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    figures = {}
    for name, column, what in (
        ("total_area", "area", F.sum), ("total_production", "production", F.sum), ("average_yield", "yield", F.avg),
        ("rainfall_mean", "rainfall", F.avg), ("rainfall_min", "rainfall", F.min), ("rainfall_max", "rainfall", F.max),
    ):
        if _has(frame, column):
            figures[name] = what(column).cast("double")
    counts = {f"{c}s": c for c in ("district", "crop", "season") if _has(frame, c)}
    wide = frame.agg(F.count("*").alias("n"), *[e.alias(k) for k, e in figures.items()])
    for name, column in counts.items():
        wide = wide.withColumn(name, frame.select(column).where(F.col(column).isNotNull()).distinct().agg(F.count("*").cast("double")).scalar())
    names = [*figures, *counts]
    long = hold(wide.unpivot(["n"], names, "metric", "figure"))
    found = finding(long.where("figure is not null"), "season_totals", KEY_VALUE, F.col("metric"), F.col("figure"), F.lit(None).cast("double"), "all rows", F.col("n"))
    if _has(frame, "crop", "production"):
        top = top_crops(frame, config.top_crops)
        found = found.unionByName(finding(top, "season_totals", KEY_VALUE, "crop_production", F.col("production"), F.lit(None).cast("double"), "all rows", F.col("n"), F.col("crop")))
    absent = none_skipped(frame)
    for name, column in (("total_area", "area"), ("total_production", "production"), ("average_yield", "yield"), ("rainfall", "rainfall")):
        if not _has(frame, column):
            absent = absent.unionByName(skipped(frame, "season_totals", f"{name}: this source has no {column}"))
    return found, absent


def top_crops(frame: DataFrame, k: int) -> DataFrame:
    sums = frame.where("crop is not null").groupBy("crop").agg(half_even(F.sum("production")).alias("production"), F.count("*").alias("n"))
    return sums.orderBy(F.desc("production"), "crop").limit(k)


def yield_collapse(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    lacking = _need(frame, "yield_collapse", "district", "crop", "yield", "year")
    if lacking:
        return lacking
    floor = F.col("history") * config.yield_collapse
    fell = _series(frame, "yield").where((F.col("before") >= config.min_history) & (F.col("history") > 0) & (F.col("yield") < floor))
    return finding(
        fell, "yield_collapse", WARNING, "yield", F.col("yield"), floor, "the district-crop's own mean over its earlier seasons",
        F.col("n"), F.col("scope"), historical_mean=F.col("history"),
    ), none_skipped(frame)


def _fall(frame: DataFrame, rule: str, column: str, metric: str, tolerated: float) -> tuple[DataFrame, DataFrame]:
    lacking = _need(frame, rule, "district", "crop", column, "year")
    if lacking:
        return lacking
    fall = (F.col("previous") - F.col(column)) / F.col("previous")
    fell = _series(frame, column).where((F.col("previous") > 0) & (fall > tolerated))
    return finding(
        fell, rule, WARNING, metric, F.col(column), F.col("previous") * (1 - tolerated), "the district-crop's own previous period",
        F.col("n"), F.col("scope"), previous=F.col("previous"), fall_fraction=fall,
    ), none_skipped(frame)


def production_drop(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    return _fall(frame, "production_drop", "production", "production", config.production_drop)


def area_fall(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    return _fall(frame, "area_fall", "area", "area cultivated", config.area_fall)


def rainfall_outside_range(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    lacking = _need(frame, "rainfall_outside_range", "rainfall", "season", "year")
    if lacking:
        return lacking
    latest = F.struct(*[F.col(c) for c in ("year", "district", "crop") if _has(frame, c)])
    seasons = frame.where("season is not null and rainfall is not null").groupBy("season").agg(
        F.avg("rainfall").alias("mean"), F.stddev_pop("rainfall").alias("std"), F.count("*").alias("n"), F.max_by("rainfall", latest).alias("latest")
    )
    deviations = F.abs(F.col("latest") - F.col("mean")) / F.col("std")
    odd = seasons.where((F.col("n") >= config.min_history + 1) & (F.col("std") > 0)).where(deviations > config.rainfall_sigma)
    side = F.when(F.col("latest") > F.col("mean"), 1).otherwise(-1)
    return finding(
        odd, "rainfall_outside_range", WARNING, "rainfall", F.col("latest"), F.col("mean") + F.col("std") * config.rainfall_sigma * side,
        "the season's own range over the years", F.col("n"), F.col("season"), mean=F.col("mean"), std=F.col("std"), deviations=deviations,
    ), none_skipped(frame)


def below_median_yield(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    lacking = _need(frame, "below_median_yield", "district", "crop", "yield")
    if lacking:
        return lacking
    means = settle(
        frame.where("crop is not null and district is not null").groupBy("crop", "district").agg(F.avg("yield").alias("mean")).where("mean is not null")
    )
    medians = order.quantiles(means, "mean", [0.5], by=["crop"]).withColumnRenamed("q0", "median")
    sizes = means.groupBy("crop").agg(F.count("*").alias("n"))
    floor = F.col("median") * config.below_median
    low = means.join(sizes, "crop").join(medians, "crop").where((F.col("n") >= 3) & (F.col("median") > 0) & (F.col("mean") < floor))
    return finding(
        low, "below_median_yield", IMPROVEMENT, "yield", F.col("mean"), floor, "the median of the same crop over all districts", F.col("n"),
        F.concat_ws(" / ", "district", "crop"), crop_median=F.col("median"),
    ), none_skipped(frame)


def high_yield_variance(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    lacking = _need(frame, "high_yield_variance", "district", "crop", "yield")
    if lacking:
        return lacking
    spread = frame.where("district is not null and crop is not null").groupBy("district", "crop").agg(
        F.avg("yield").alias("mean"), F.stddev_pop("yield").alias("std"), F.count("yield").alias("n")
    )
    variation = F.col("std") / F.col("mean")
    return finding(
        spread.where((F.col("n") >= config.min_history) & (F.col("mean") > 0)).where(variation > config.high_variance), "high_yield_variance", IMPROVEMENT,
        "yield coefficient of variation", variation, F.lit(config.high_variance), "the district-crop's own observations", F.col("n"),
        F.concat_ws(" / ", "district", "crop"), mean=F.col("mean"),
    ), none_skipped(frame)


RULES = (season_totals, yield_collapse, production_drop, rainfall_outside_range, area_fall, below_median_yield, high_yield_variance)


def run(frame: DataFrame, config: Config = Config(), rules: Sequence = RULES) -> tuple[DataFrame, DataFrame]:
    return run_rules(rules, frame, config)


# -- chart data --------------------------------------------------------------------------------------

CHARTED_DISTRICTS = 15
YIELD_BINS = 30


def yield_by_year(frame: DataFrame) -> DataFrame:
    return frame.where("year is not null").groupBy("year").agg(half_even(F.avg("yield")).alias("yield")).where("yield is not null").orderBy("year")


def yield_by_district(frame: DataFrame, k: int = CHARTED_DISTRICTS) -> DataFrame:
    means = frame.where("district is not null").groupBy("district").agg(half_even(F.avg("yield")).alias("yield")).where("yield is not null")
    return means.orderBy(F.desc("yield"), "district").limit(k)


def yield_bars(frame: DataFrame) -> DataFrame:
    return stats.histogram(frame, ["yield"], YIELD_BINS)
