"""Advertising rule pack: campaign-by-day preparation, derived ratios, threshold rules, chart data."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.numeric import half_even, ratio
from tidegauge.operators import business, normalise
from tidegauge.operators.packs import finding, none_skipped, nothing, run_rules, skipped
from tidegauge.operators.roles import Detection, Qualification, qualifies
from tidegauge.plans import order, stats
from tidegauge.session import hold, settle

# Fixed values
REQUIRED = ("spend",)
ANY_OF = ("impressions", "clicks", "ctr", "frequency")
ADDITIVE = ("spend", "impressions", "clicks", "conversions", "value")
SOURCE_ROLE = {
    "campaign": "campaign_id", "day": "event_date", "spend": "spend", "impressions": "impressions", "clicks": "clicks",
    "conversions": "conversions", "value": "conversion_value", "frequency": "frequency", "given_ctr": "ctr",
}
RATIOS = {"cpa": ("spend", "conversions"), "roas": ("value", "spend"), "ctr": ("clicks", "impressions")}
WARNING, IMPROVEMENT, KEY_VALUE = "warning", "improvement", "key_value"


@dataclass(frozen=True)
class Config:
    cpa_spike_multiple: float = 1.3
    frequency_fatigue: float = 3.5
    ctr_decline: float = 0.3
    pacing_tolerance: float = 0.25
    daily_budget: float | None = None
    roas_target: float = 2.0
    underperformance: float = 1.5
    window_days: int = 7
    band_cutoff: float = 0.8
    min_campaigns: int = 3
    min_movement: float = 0.05
    min_rows: int = 3
    percent_threshold: float = 1.0
    summary_labels: tuple[str, ...] = normalise.SUMMARY_LABELS


@dataclass(frozen=True)
class Prepared:
    frame: DataFrame  # campaign, day, additive measures, frequency, cpa, roas, ctr - whichever exist
    notes: DataFrame  # note, subject, value
    grain: str


def qualification(detection: Detection) -> Qualification:
    return qualifies(detection, REQUIRED, ANY_OF)


def prepare(df: DataFrame, roles: dict[str, str], config: Config = Config()) -> Prepared:
    """``roles`` maps role names to columns (as ``Detection.assigned`` does).

    Total rows out, formatted numbers in, one row per campaign and day, then the ratios.
    """
    present = {name: roles[role] for name, role in SOURCE_ROLE.items() if roles.get(role) in df.columns}
    rows_in = df
    totals = none_skipped(df).limit(0).select(F.lit(None).cast("string").alias("label"), F.lit(0).cast("bigint").alias("dropped"))
    work = df
    if "campaign" in present:
        work, totals = normalise.drop_summary_rows(df, present["campaign"], config.summary_labels)
    if "given_ctr" in present:
        work, _ = normalise.ratio_column(work, present["given_ctr"], config.percent_threshold)
    numeric = {f.name: isinstance(f.dataType, T.NumericType) for f in df.schema.fields}
    unparsed: list[Column] = []
    selected = []
    for name, column in present.items():
        if name == "campaign":
            selected.append(F.col(column).alias(name))
        elif name == "day":
            selected.append(F.to_date(column).alias(name))
        elif numeric.get(column) or name == "given_ctr":
            selected.append(F.col(column).cast("double").alias(name))
        else:
            parsed = normalise.number_from_text(column)
            selected.append(parsed.alias(name))
            unparsed.append(F.count_if(F.col(column).isNotNull() & parsed.isNull()).alias(name))
    narrow = work.select(*selected)
    if "day" in present:
        keys = [k for k in ("campaign", "day") if k in present]
        sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ADDITIVE if c in present]
        means = [F.avg("frequency").alias("frequency")] if "frequency" in present else []
        narrow = narrow.groupBy(*keys).agg(*sums, *means) if sums or means else narrow
        grain = "campaign_day"
    else:
        grain = "as exported"
    frame = settle(with_ratios(narrow))
    counted = [("rows_in", rows_in.agg(F.count("*").alias("v"))), ("rows_out", frame.agg(F.count("*").alias("v")))]
    notes = totals.select(F.lit("summary_row_excluded").alias("note"), F.col("label").alias("subject"), F.col("dropped").cast("double").alias("value"))
    for note, count in counted:
        notes = notes.unionByName(count.select(F.lit(note).alias("note"), F.lit(None).cast("string").alias("subject"), F.col("v").cast("double").alias("value")))
    if unparsed:
        names = [n for n, c in present.items() if n not in ("campaign", "day", "given_ctr") and not numeric.get(c)]
        long = work.agg(*unparsed).unpivot([], names, "subject", "value")
        notes = notes.unionByName(long.select(F.lit("unparsed").alias("note"), "subject", F.col("value").cast("double").alias("value")))
    derived = [r for r in RATIOS if r in frame.columns]
    if derived:
        undefined = frame.agg(*[F.count_if(F.col(r).isNull()).alias(r) for r in derived]).unpivot([], derived, "subject", "value")
        notes = notes.unionByName(undefined.select(F.lit("undefined").alias("note"), "subject", F.col("value").cast("double").alias("value")))
    return Prepared(frame, notes, grain)


def with_ratios(frame: DataFrame) -> DataFrame:
    for name, (top, bottom) in RATIOS.items():
        if top in frame.columns and bottom in frame.columns:
            frame = frame.withColumn(name, ratio(top, bottom))
    return frame


def _has(frame: DataFrame, *names: str) -> bool:
    return all(n in frame.columns for n in names)


def _windows(frame: DataFrame, days: int) -> tuple[Column, Column]:
    """(recent, prior): two windows of equal length, the recent one ending on the data's last day."""
    latest = frame.agg(F.max("day")).scalar()
    recent = F.col("day") >= F.date_sub(latest, days - 1)
    prior = (F.col("day") >= F.date_sub(latest, 2 * days - 1)) & ~recent
    return recent, prior


def account_totals(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """One finding per total or blended ratio; absent ratios are skipped with the reason."""
    sums = [c for c in ADDITIVE if _has(frame, c)]
    wide = frame.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])
    blended = {f"blended_{r}": ratio(a, b) for r, (a, b) in RATIOS.items() if a in sums and b in sums}
    wide = hold(wide.withColumns(blended) if blended else wide)
    names = [*sums, *blended]
    long = wide.unpivot(["n"], [F.col(c).cast("double").alias(c) for c in names], "metric", "figure")
    found = finding(
        long.where("figure is not null"), "account_totals", KEY_VALUE, F.col("metric"), F.col("figure"), F.lit(None).cast("double"),
        "all rows", F.col("n"),
    )
    absent = none_skipped(frame)
    for r, (a, b) in RATIOS.items():
        if f"blended_{r}" not in blended:
            absent = absent.unionByName(skipped(frame, "account_totals", f"blended_{r}: needs {a} and {b}"))
    undefined = long.where("figure is null").select(
        F.lit("account_totals").alias("rule"), F.concat("metric", F.lit(": the denominator is zero, so it is undefined")).alias("reason")
    )
    return found, absent.unionByName(undefined)


def _recent_against_prior(frame: DataFrame, metric: str, days: int) -> DataFrame:
    recent, prior = _windows(frame, days)
    return frame.agg(
        F.avg(F.when(recent, F.col(metric))).alias("recent"), F.avg(F.when(prior, F.col(metric))).alias("prior"),
        F.count(F.when(recent, F.col(metric))).alias("n_recent"), F.count(F.when(prior, F.col(metric))).alias("n_prior"),
        F.count_if(recent).alias("rows_recent"),
    )


def _short(both: DataFrame, rule: str, metric: str, config: Config) -> DataFrame:
    least = config.min_rows
    return both.where((F.col("n_recent") < least) | (F.col("n_prior") < least)).select(
        F.lit(rule).alias("rule"),
        F.format_string(f"needs at least {least} rows with a defined {metric} in each window; found %d recent and %d prior", "n_recent", "n_prior").alias("reason"),
    )


def cpa_above_baseline(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    if not _has(frame, "cpa", "day"):
        return nothing(frame), skipped(frame, "cpa_above_baseline", "needs a derived CPA and a reporting date")
    both = hold(_recent_against_prior(frame, "cpa", config.window_days))
    limit = F.col("prior") * config.cpa_spike_multiple
    enough = (F.col("n_recent") >= config.min_rows) & (F.col("n_prior") >= config.min_rows)
    found = finding(
        both.where(enough & (F.col("recent") > limit)), "cpa_above_baseline", WARNING, "cpa", F.col("recent"), limit,
        "mean of the prior window times the spike multiple", F.col("rows_recent"), prior_mean=F.col("prior"),
        undefined_rows=F.col("rows_recent") - F.col("n_recent"),
    )
    return found, _short(both, "cpa_above_baseline", "cpa", config)


def ctr_decline(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    if not _has(frame, "ctr", "day"):
        return nothing(frame), skipped(frame, "ctr_decline", "needs a derived CTR and a reporting date")
    both = hold(_recent_against_prior(frame, "ctr", config.window_days))
    enough = (F.col("n_recent") >= config.min_rows) & (F.col("n_prior") >= config.min_rows)
    decline = (F.col("prior") - F.col("recent")) / F.col("prior")
    found = finding(
        both.where(enough & (F.col("prior") > 0) & (decline >= config.ctr_decline)), "ctr_decline", WARNING, "ctr", F.col("recent"),
        F.col("prior") * (1 - config.ctr_decline), "mean of the prior window less the tolerated decline", F.col("rows_recent"),
        prior_mean=F.col("prior"), decline=decline,
    )
    no_clicks = both.where(enough & (F.col("prior") <= 0)).select(
        F.lit("ctr_decline").alias("rule"), F.lit("the prior window recorded no clicks").alias("reason")
    )
    return found, _short(both, "ctr_decline", "ctr", config).unionByName(no_clicks)


def frequency_fatigue(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    if not _has(frame, "frequency"):
        return nothing(frame), skipped(frame, "frequency_fatigue", "needs a frequency column")
    scope = ["campaign"] if _has(frame, "campaign") else []
    means = frame.groupBy(*scope).agg(F.avg("frequency").alias("mean"), F.count("*").alias("n"))
    return finding(
        means.where(F.col("mean") > config.frequency_fatigue), "frequency_fatigue", WARNING, "frequency", F.col("mean"),
        F.lit(config.frequency_fatigue), "the configured fatigue threshold", F.col("n"), F.col("campaign") if scope else None,
    ), none_skipped(frame)


def budget_mispacing(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    if not _has(frame, "spend", "day"):
        return nothing(frame), skipped(frame, "budget_mispacing", "needs a spend column and a reporting date")
    if config.daily_budget is None:
        return nothing(frame), skipped(frame, "budget_mispacing", "no daily budget target is configured")
    low, high = config.daily_budget * (1 - config.pacing_tolerance), config.daily_budget * (1 + config.pacing_tolerance)
    pace = frame.where("day is not null").groupBy("day").agg(F.sum("spend").alias("spend")).agg(F.avg("spend").alias("mean"), F.count("*").alias("n"))
    return finding(
        pace.where(~F.col("mean").between(low, high)), "budget_mispacing", WARNING, "daily_spend", F.col("mean"),
        F.when(F.col("mean") > high, high).otherwise(low), "the configured daily budget and its tolerance band", F.col("n"),
    ), none_skipped(frame)


def roas_below_target(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    if not _has(frame, "spend", "value"):
        return nothing(frame), skipped(frame, "roas_below_target", "needs spend and conversion-value columns")
    total = hold(frame.agg(F.sum("spend").alias("spend"), F.sum("value").alias("value"), F.count("*").alias("n")))
    figure = F.col("value") / F.col("spend")
    found = finding(
        total.where((F.col("spend") > 0) & (figure < config.roas_target)), "roas_below_target", IMPROVEMENT, "roas", figure,
        F.lit(config.roas_target), "the configured target", F.col("n"), total_spend=F.col("spend"),
    )
    return found, total.where("spend <= 0").select(F.lit("roas_below_target").alias("rule"), F.lit("no spend recorded").alias("reason"))


def _campaign_means(frame: DataFrame, metric: str) -> DataFrame:
    return settle(frame.groupBy("campaign").agg(F.avg(metric).alias("mean"), F.count("*").alias("n")).where("mean is not null"))


def _median(means: DataFrame) -> tuple[int, float | None]:
    n = means.count()
    return n, order.quantiles(means, "mean", [0.5]).first()["q0"] if n else None


def adset_underperforming(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    if not _has(frame, "cpa", "campaign"):
        return nothing(frame), skipped(frame, "adset_underperforming", "needs a derived CPA and a campaign column")
    means = _campaign_means(frame, "cpa")
    n, median = _median(means)
    if n < 2:
        return nothing(frame), skipped(frame, "adset_underperforming", "needs at least two campaigns with a defined CPA")
    limit = F.lit(median * config.underperformance)
    return finding(
        means.where(F.col("mean") > limit), "adset_underperforming", IMPROVEMENT, "cpa", F.col("mean"), limit,
        "the median of all campaigns times the underperformance multiple", F.col("n"), F.col("campaign"),
        median=F.lit(median), campaigns=F.lit(n),
    ), none_skipped(frame)


def adset_period_movement(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    rule = "adset_period_movement"
    metrics = [m for m in ("cpa", "roas", "ctr") if _has(frame, m)]
    if not _has(frame, "day", "campaign") or not metrics:
        return nothing(frame), skipped(frame, rule, "needs a reporting date, a campaign and a derived metric")
    recent, prior = _windows(frame, config.window_days)
    flagged = frame.where(F.col("campaign").isNotNull()).withColumns({"is_recent": recent, "is_prior": prior}).where("is_recent or is_prior")
    size = hold(flagged.agg(F.count_if("is_recent").alias("recent"), F.count_if("is_prior").alias("prior")))
    short = size.where("recent = 0 or prior = 0").select(
        F.lit(rule).alias("rule"), F.format_string("needs two windows; found %d recent and %d prior rows", "recent", "prior").alias("reason")
    )
    means = flagged.groupBy("campaign").agg(
        F.count_if("is_recent").alias("n"),
        *[F.avg(F.when(F.col("is_recent"), F.col(m))).alias(f"after_{m}") for m in metrics],
        *[F.avg(F.when(F.col("is_prior"), F.col(m))).alias(f"before_{m}") for m in metrics],
    )
    moved = means.select("campaign", "n", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"before_{m}").alias("before"), F.col(f"after_{m}").alias("after")) for m in metrics
    ])))
    change = F.col("after") - F.col("before")
    relative = F.try_divide(change, F.abs("before"))
    kept = moved.where((change != 0) & (relative.isNull() | (F.abs(relative) >= config.min_movement)))
    return finding(
        kept, rule, IMPROVEMENT, F.col("metric"), F.col("after"), F.col("before"), "the same campaign's mean over the prior window",
        F.col("n"), F.col("campaign"), absolute_change=change, relative_change=relative,
    ), short


def adset_fatigue_trend(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    rule = "adset_fatigue_trend"
    performance = next((m for m in ("ctr", "roas") if _has(frame, m)), None)
    if not _has(frame, "frequency", "day", "campaign") or performance is None:
        return nothing(frame), skipped(frame, rule, "needs frequency, a reporting date, a campaign and a derived ctr or roas")
    daily = frame.where("campaign is not null and day is not null").groupBy("campaign", "day").agg(
        F.avg("frequency").alias("f"), F.avg(performance).alias("p")
    )

    def slope(c: str) -> Column:
        on = F.when(F.col(c).isNotNull(), F.col("day"))
        return F.when(F.count(c) >= 2, (F.max_by(c, on) - F.min_by(c, on)) / (F.count(c) - 1))

    ends = daily.groupBy("campaign").agg(slope("f").alias("rise"), slope("p").alias("fall"), F.count("*").alias("n"))
    return finding(
        ends.where("rise > 0 and fall < 0"), rule, WARNING, f"frequency vs {performance}", F.col("rise"), F.lit(0.0),
        f"the same campaign's own {performance} over the same days", F.col("n"), F.col("campaign"), performance_change_per_day=F.col("fall"),
    ), none_skipped(frame)


def spend_concentration(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    rule = "spend_concentration"
    if not _has(frame, "campaign", "spend"):
        return nothing(frame), skipped(frame, rule, "needs a spend column and a campaign")
    found, left_out = nothing(frame), none_skipped(frame)
    for label, column in (("spend", "spend"), ("return", "value")):
        if not _has(frame, column):
            left_out = left_out.unionByName(skipped(frame, rule, f"no {column} column, so {label} concentration is not measured"))
            continue
        totals = settle(business.entity_totals(frame, "campaign", F.col(column)))
        if not totals.where("total > 0").limit(1).count():
            left_out = left_out.unionByName(skipped(frame, rule, f"{label} concentration: no campaign has a positive total"))
            continue
        pareto = business.abc_pareto(totals, (config.band_cutoff, max(0.95, (1 + config.band_cutoff) / 2)))
        found = found.unionByName(finding(
            pareto.bands.where("band = 'A'"), rule, KEY_VALUE, f"{label} share of band A", F.col("value_share"), F.lit(config.band_cutoff),
            f"the smallest set of campaigns holding that share of {label}", F.col("entity_count"), F.array_join("top_entities", ", "),
        ))
    return found, left_out


def adset_efficiency_rank(frame: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    rule = "adset_efficiency_rank"
    metrics = [m for m in ("cpa", "roas") if _has(frame, m)]
    if not _has(frame, "campaign") or not metrics:
        return nothing(frame), skipped(frame, rule, "needs a campaign and a derived cpa or roas")
    found = nothing(frame)
    for metric in metrics:
        means = _campaign_means(frame.where("campaign is not null"), metric)
        n, median = _median(means)
        if n < config.min_campaigns or not median:
            continue
        worse = F.col("mean") > median if metric == "cpa" else F.col("mean") < median
        found = found.unionByName(finding(
            means.where(worse), rule, IMPROVEMENT, metric, F.col("mean"), F.lit(median), "the median of all campaigns", F.col("n"),
            F.col("campaign"), campaigns=F.lit(n),
        ))
    return found, none_skipped(frame)


RULES = (
    account_totals, cpa_above_baseline, frequency_fatigue, ctr_decline, budget_mispacing, roas_below_target, adset_underperforming,
    adset_period_movement, adset_fatigue_trend, spend_concentration, adset_efficiency_rank,
)


def run(frame: DataFrame, config: Config = Config(), rules: Sequence = RULES) -> tuple[DataFrame, DataFrame]:
    return run_rules(rules, frame, config)


# -- chart data --------------------------------------------------------------------------------------

CHARTED = 12
CTR_BINS = 30


def daily(frame: DataFrame, column: str, how: str = "sum") -> DataFrame:
    figure = F.sum(column) if how == "sum" else F.avg(column)
    return frame.where("day is not null").groupBy("day").agg(half_even(figure).alias("figure")).where("figure is not null").orderBy("day")


def top_campaigns(frame: DataFrame, metric: str, k: int = CHARTED) -> DataFrame:
    """Best campaigns by mean cpa (lowest) or roas (highest)."""
    means = frame.where("campaign is not null").groupBy("campaign").agg(F.avg(metric).alias("mean")).where("mean is not null")
    best = F.col("mean").asc() if metric == "cpa" else F.col("mean").desc()
    return means.orderBy(best, "campaign").limit(k)


def spend_and_return(frame: DataFrame, k: int = CHARTED) -> DataFrame:
    totals = frame.where("campaign is not null").groupBy("campaign").agg(half_even(F.sum("spend")).alias("spend"), half_even(F.sum("value")).alias("value"))
    return totals.orderBy(F.desc("spend"), "campaign").limit(k)


def ctr_bars(frame: DataFrame) -> DataFrame:
    return stats.histogram(frame, ["ctr"], CTR_BINS)
