"""Customer and product analyses on one transactional table.

All of them first reduce the table to one row per entity, item or (entity, period) with map-side partial
aggregation; what follows works on that reduced frame, without one-task windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numeric import MICROS_PER_DAY, half_even, micros, whole_days
from tidegauge.operators import kmeans
from tidegauge.plans import order, stats
from tidegauge.session import hold, rows, settle

# -- value basis -------------------------------------------------------------------------------------

# Names that read as a line total, and as a price per unit
TOTAL_NAME = re.compile(
    r"(^|_)(total|totals|amount|amt|revenue|sales|turnover|gmv|subtotal|linetotal|line_total|net|gross|spend|value|income|charge|paid|payment)($|_)",
    re.I,
)
UNIT_PRICE_NAME = re.compile(r"(^|_)(price|unitprice|unit_price|rate|tariff|fare|each|per_unit|unitcost|unit_cost)($|_)", re.I)


@dataclass(frozen=True)
class ValueBasis:
    """What "value" means for a table: a column as it stands, or unit price times quantity."""

    monetary: str
    quantity: str | None = None

    @property
    def label(self) -> str:
        return f"{self.monetary} x {self.quantity}" if self.quantity else self.monetary

    def column(self) -> Column:
        value = F.col(self.monetary).try_cast("double")
        return value * F.col(self.quantity).try_cast("double") if self.quantity else value


def monetary_shape(name: str) -> str:
    if TOTAL_NAME.search(name):
        return "total"
    return "unit_price" if UNIT_PRICE_NAME.search(name) else "unknown"


def value_basis(monetary: str | None, quantity: str | None) -> ValueBasis | None:
    if monetary is None:
        return None
    return ValueBasis(monetary, quantity if quantity and monetary_shape(monetary) == "unit_price" else None)


# -- entities ----------------------------------------------------------------------------------------

def entity_features(df: DataFrame, entity: str, date: str, value: Column | None = None) -> DataFrame:
    """Recency (from the latest event in the data), frequency, first/last seen, monetary, lifespan."""
    events = df.where(F.col(entity).isNotNull() & F.col(date).isNotNull())
    latest = events.agg(F.max(date)).scalar()
    summed = F.coalesce(F.sum(value), F.lit(0.0)) if value is not None else F.lit(0.0)
    return (
        events.groupBy(F.col(entity).alias("entity"))
        .agg(F.count("*").alias("frequency"), F.min(date).alias("first_seen"), F.max(date).alias("last_seen"), summed.alias("monetary"))
        .withColumn("recency_days", whole_days(latest, F.col("last_seen")).cast("double"))
        .withColumn("lifespan_days", whole_days(F.col("last_seen"), F.col("first_seen")).cast("double"))
        .withColumn("frequency", F.col("frequency").cast("double"))
    )


# Fixed values: (segment, recency range, frequency range, monetary range), first match wins
SEGMENT_RULES = (
    ("champions", (4, 5), (4, 5), (4, 5)),
    ("loyal", (3, 5), (3, 5), (3, 5)),
    ("promising", (4, 5), (1, 2), (1, 3)),
    ("at_risk", (1, 2), (3, 5), (3, 5)),
    ("hibernating", (1, 2), (2, 3), (1, 3)),
    ("lost", (1, 1), (1, 2), (1, 2)),
)
SCORE_LEVELS = 5


def score_cuts(features: DataFrame, measures: dict[str, Column], n: int) -> dict[str, list[tuple]]:
    """The (value, entity) pairs that close each score bin, per measure.

    A score depends on the rank alone, and ranks fall into at most five bins, so the four boundary rows
    of each measure say everything. They are read off one range-partitioned (measure, value, entity)
    frame; the ranks themselves are never joined back.
    """
    levels = min(SCORE_LEVELS, n)
    closing = [(b + 1) * (n - 1) // levels for b in range(levels - 1)]
    if not closing:
        return {m: [] for m in measures}
    long = features.unpivot(["entity"], [e.alias(m) for m, e in measures.items()], "measure", "value")
    placed = order.global_index(long, [F.asc("value"), F.asc("entity")], by=["measure"])
    found = placed.where(F.col("idx").isin(closing)).orderBy("measure", "idx").collect()
    return {m: [(r["value"], r["entity"]) for r in found if r["measure"] == m] for m in measures}


def score_of(value: Column, cuts: list[tuple], levels: int) -> Column:
    if levels == 1:
        return F.lit(SCORE_LEVELS)
    bin_ = sum(
        (F.when((value > v) | ((value == v) & (F.col("entity") > F.lit(e))), 1).otherwise(0) for v, e in cuts), F.lit(0)
    )
    return F.bround(1 + bin_ / F.lit(levels - 1) * (SCORE_LEVELS - 1), 0).cast("int")


def segment_of(rules=SEGMENT_RULES) -> Column:
    named = None
    for name, r, f, m in rules:
        fits = F.col("r_score").between(*r) & F.col("f_score").between(*f) & F.col("m_score").between(*m)
        named = F.when(fits, name) if named is None else named.when(fits, name)
    return named.otherwise("unsegmented")


def rfm_scores(features: DataFrame, rules=SEGMENT_RULES) -> DataFrame:
    """Scores 1..5 by rank (ties in entity order) and the segment each entity falls into."""
    features = settle(features)
    n = features.count()
    oriented = {"r": -F.col("recency_days"), "f": F.col("frequency"), "m": F.col("monetary")}
    cuts = score_cuts(features, oriented, n)
    levels = min(SCORE_LEVELS, max(1, n))
    scored = features.withColumns({f"{k}_score": score_of(v, cuts[k], levels) for k, v in oriented.items()})
    return scored.withColumn("segment", segment_of(rules))


def rfm_segments(scored: DataFrame) -> DataFrame:
    """One row per segment: size, value and mean position."""
    totals = scored.agg(F.count("*").alias("n"), F.sum("monetary").alias("value"))
    n, value = totals.select("n").scalar(), totals.select("value").scalar()
    share = F.when(value > 0, F.col("value_total") / value).otherwise(F.lit(0.0))
    means = ["recency_days", "frequency", "monetary", "r_score", "f_score", "m_score"]
    return (
        scored.groupBy("segment")
        .agg(F.count("*").alias("entity_count"), F.sum("monetary").alias("value_total"), *[F.avg(c).alias(f"mean_{c}") for c in means])
        .select(
            "segment", "entity_count", half_even(F.col("entity_count") / n).alias("entity_share"),
            half_even("value_total").alias("value_total"), half_even(share).alias("value_share"),
            *[half_even(f"mean_{c}", 3).alias(f"mean_{c}") for c in means],
        )
    )


def historical_value(scored: DataFrame, margin_rate: float | None = None) -> DataFrame:
    """Average order value x purchase frequency per segment, from what was observed."""
    if margin_rate is not None and not 0 < margin_rate <= 1:
        raise ValueError(f"margin_rate {margin_rate} is no share of one")
    factor = 1.0 if margin_rate is None else margin_rate
    sums = scored.groupBy("segment").agg(
        F.count("*").alias("entity_count"), F.sum("frequency").alias("orders"),
        (F.sum("monetary") * factor).alias("value"), F.avg("lifespan_days").alias("lifespan"),
    )
    average = F.coalesce(F.try_divide("value", "orders"), F.lit(0.0))
    often = F.col("orders") / F.col("entity_count")
    return sums.select(
        "segment", "entity_count", half_even(average).alias("average_order_value"), half_even(often).alias("purchase_frequency"),
        half_even("lifespan", 3).alias("observed_lifespan_days"), half_even(average * often).alias("historical_value_per_entity"),
        F.lit("revenue" if margin_rate is None else "margin").alias("value_basis"),
    )


# -- concentration -----------------------------------------------------------------------------------

BAND_CUTOFFS = (0.8, 0.95)
CONCENTRATION_FLOOR = 0.5
CURVE_POINTS = 500
TOP_SHARE = 0.2
EXAMPLES = 10


@dataclass(frozen=True)
class Pareto:
    ranked: DataFrame  # entity, total, idx, cum, cum_share, band
    bands: DataFrame
    curve: DataFrame
    summary: DataFrame
    non_contributing: DataFrame
    reason: str | None = None


def entity_totals(df: DataFrame, group: str, value: Column) -> DataFrame:
    return (
        df.select(F.col(group).alias("entity"), value.cast("double").alias("v")).dropna()
        .groupBy("entity").agg(F.sum("v").alias("total"))
    )


def row_totals(df: DataFrame, value: Column, ordering: Sequence[Column]) -> DataFrame:
    """Every row its own entity, for tables without an identifier."""
    valued = df.withColumn("total", value.cast("double")).where("total is not null")
    indexed = order.global_index(valued, ordering, name="row")
    return indexed.select(F.concat(F.lit("row "), F.col("row")).alias("entity"), "total")


def abc_pareto(totals: DataFrame, cutoffs: tuple[float, float] = BAND_CUTOFFS, floor: float = CONCENTRATION_FLOOR) -> Pareto:
    """A/B/C bands over entities of positive net value, largest first; the others are reported apart."""
    lower, upper = cutoffs
    if not 0 < lower < upper < 1:
        raise ValueError(f"cutoffs {cutoffs} do not rise within 0 and 1")
    totals = settle(totals)
    positive = totals.where("total > 0")
    whole = positive.agg(F.sum("total").alias("value"), F.count("*").alias("n")).first()
    value, n = whole["value"], whole["n"]
    ranked = order.running_totals(positive, [F.desc("total"), F.asc("entity")], {"total": "cum"})
    ranked = ranked.withColumn("cum_share", F.col("cum") / F.lit(value)).withColumn(
        "band",
        F.when((F.col("idx") == 0) | (F.col("cum_share") <= lower), "A").when(F.col("cum_share") <= upper, "B").otherwise("C"),
    )
    sums = ranked.groupBy("band").agg(F.count("*").alias("entity_count"), F.sum("total").alias("value_total"))
    upto = Window.orderBy("band").rowsBetween(Window.unboundedPreceding, 0)  # three rows
    share = F.col("value_total") / F.lit(value)
    bands = sums.select(
        "band", "entity_count", half_even(F.col("entity_count") / F.lit(n)).alias("entity_share"),
        half_even("value_total").alias("value_total"), half_even(share).alias("value_share"),
        half_even(F.least(F.sum(share).over(upto), F.lit(1.0))).alias("cumulative_value_share"),
    )
    top = ranked.withColumn("i", F.row_number().over(Window.partitionBy("band").orderBy("idx"))).where(F.col("i") <= EXAMPLES)
    examples = top.groupBy("band").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("entity").cast("string").alias("e")))), lambda s: s["e"]).alias("top_entities")
    )
    stride = max(1, (n or 0) // CURVE_POINTS)
    curve = ranked.where((F.col("idx") % stride == 0) | (F.col("idx") == (n or 0) - 1)).select(
        (F.col("idx") + 1).alias("entity_rank"), half_even((F.col("idx") + 1) / F.lit(n)).alias("cumulative_entity_share"),
        half_even("cum_share").alias("cumulative_value_share"),
    )
    taken = min(n, max(1, round(n * TOP_SHARE))) if n else 0
    summary = ranked.where(F.col("idx") == taken - 1).select(
        F.lit(n).cast("bigint").alias("entity_count"), half_even(F.lit(value)).alias("total_value"), F.lit(taken).cast("bigint").alias("top_entity_count"),
        half_even("cum_share").alias("top_value_share"), (F.col("cum_share") < floor).alias("concentration_is_weak"),
    )
    reason = None if n else "no entity with a net value above 0"
    return Pareto(ranked, bands.join(examples, "band"), curve, summary, non_contributing(totals), reason)


def non_contributing(totals: DataFrame) -> DataFrame:
    """Entities whose values net to zero or below: how many, how much, the worst ten."""
    combined = totals.agg(F.sum("total")).scalar()
    held_out = totals.where("total <= 0")
    worst = held_out.orderBy("total", "entity").limit(EXAMPLES).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("total", "entity"))), lambda s: s["entity"].cast("string"))
    ).scalar()
    return held_out.agg(
        F.count("*").alias("entity_count"), F.count_if(F.col("total") == 0).alias("zero_net_count"),
        F.count_if(F.col("total") < 0).alias("negative_net_count"), half_even(F.sum("total")).alias("net_value_total"),
    ).select("*", half_even(combined).alias("combined_value_total"), worst.alias("examples"))


# -- cohorts -----------------------------------------------------------------------------------------

def period_number(date: str, granularity: str) -> Column:
    """Consecutive whole numbers for months, Monday-to-Sunday weeks, or days."""
    if granularity == "month":
        return F.year(date) * 12 + F.month(date) - 1
    if granularity == "week":
        return F.floor((F.unix_date(F.to_date(date)) + 3) / 7).cast("int")
    if granularity == "day":
        return F.unix_date(F.to_date(date))
    raise ValueError(f"granularity must be month, week or day, got {granularity!r}")


def period_label(number: Column, granularity: str) -> Column:
    if granularity == "month":
        return F.date_format(F.make_date(F.floor(number / 12).cast("int"), (number % 12 + 1).cast("int"), F.lit(1)), "yyyy-MM")
    if granularity == "week":
        monday = F.date_from_unix_date((number * 7 - 3).cast("int"))
        return F.concat_ws("/", monday.cast("string"), F.date_add(monday, 6).cast("string"))
    return F.date_from_unix_date(number).cast("string")


@dataclass(frozen=True)
class Cohorts:
    matrix: DataFrame  # cohort, cohort_label, cohort_size, offset, retained_share (NULL: not yet observed)
    mean_curve: DataFrame  # offset, mean_retained_share
    reason: str | None = None
    scope: DataFrame | None = None  # cohort_count, shown_cohorts, offset_count, shown_offsets


def cohort_retention(df: DataFrame, entity: str, date: str, granularity: str = "month", max_cohorts: int | None = None, max_offsets: int | None = None) -> Cohorts:
    """Share of each first-period cohort seen again k periods later; ``scope`` tells what a limit leaves out."""
    seen = df.where(F.col(entity).isNotNull() & F.col(date).isNotNull()).select(
        F.col(entity).alias("entity"), period_number(date, granularity).alias("period")
    ).distinct()
    # after the distinct an entity has at most one row per period, however many events it had
    first = Window.partitionBy("entity")
    counts = (
        seen.withColumn("cohort", F.min("period").over(first))
        .groupBy("cohort", (F.col("period") - F.col("cohort")).alias("offset"))
        .agg(F.count("*").alias("active"))
    )
    counts = settle(counts)
    sizes = counts.where("offset = 0").select("cohort", F.col("active").alias("cohort_size"))
    latest = counts.agg(F.max(F.col("cohort") + F.col("offset")).alias("last"), F.countDistinct("cohort").alias("n")).first()
    reason = f"cohorts by {granularity}: {latest['n']}, needs 2" if latest["n"] < 2 else None
    kept = sizes if max_cohorts is None else sizes.orderBy(F.desc("cohort")).limit(max_cohorts)
    cells = settle(counts.join(kept.select("cohort"), "cohort").where(F.lit(True) if max_offsets is None else F.col("offset") < max_offsets))
    # one offset a period at most
    grid = kept.withColumn("offset", F.explode(cells.agg(F.collect_set("offset")).scalar()))
    future = F.col("cohort") + F.col("offset") > latest["last"]
    share = half_even(F.coalesce("active", F.lit(0)) / F.col("cohort_size"))
    matrix = grid.join(cells, ["cohort", "offset"], "left").select(
        "cohort", period_label(F.col("cohort"), granularity).alias("cohort_label"), "cohort_size", "offset",
        F.when(~future, share).alias("retained_share"),
    )
    # shares have six digits, so their exact sum does not depend on an order
    mean = matrix.groupBy("offset").agg(half_even(F.avg(F.col("retained_share").cast("decimal(18,6)")).cast("double")).alias("mean_retained_share"))
    every, shown = counts.agg(F.count_distinct("cohort").alias("cohort_count"), F.count_distinct("offset").alias("offset_count")), cells.agg(F.count_distinct("cohort").alias("c"), F.count_distinct("offset").alias("o"))
    scope = every.select("cohort_count", shown.select("c").scalar().alias("shown_cohorts"), "offset_count", shown.select("o").scalar().alias("shown_offsets"))
    return Cohorts(matrix, mean, reason, scope)


def repeat_behaviour(df: DataFrame, entity: str, date: str, window_days: int = 90) -> DataFrame:
    """Repeat rate, inactivity, and the quartiles of the days between an entity's events."""
    if window_days <= 0:
        raise ValueError(f"window_days {window_days} is not above 0")
    features = entity_features(df, entity, date)
    summary = features.agg(
        F.count("*").alias("entity_count"), F.count_if(F.col("frequency") >= 2).alias("repeat_entity_count"),
        F.count_if(F.col("recency_days") > window_days).alias("inactive_entity_count"), F.max("last_seen").alias("observation_end"),
    )
    gaps = gap_counts(df, entity, date)
    quartiles = F.percentile("gap", [0.25, 0.5, 0.75], F.col("n"))  # at most one row per day of the data's span
    found = gaps.agg(quartiles.alias("q"))
    q = found.select("q").scalar()
    return summary.select(
        "entity_count", "repeat_entity_count", half_even(F.col("repeat_entity_count") / F.col("entity_count")).alias("repeat_rate"),
        F.lit(window_days).alias("inactivity_window_days"), "inactive_entity_count",
        half_even(F.col("inactive_entity_count") / F.col("entity_count")).alias("inactive_share"),
        half_even(q[0], 3).alias("gap_days_p25"), half_even(q[1], 3).alias("gap_days_median"), half_even(q[2], 3).alias("gap_days_p75"),
        "observation_end",
    )


def gap_counts(df: DataFrame, entity: str, date: str) -> DataFrame:
    """(gap, n): whole days between consecutive events of the same entity.

    Events in the same 24 hours of a fixed grid are less than a whole day apart, so all gaps between them are zero: only how many they are and the first and
    the last instant are kept. The last is compared with the first of the entity's next such cell. After the grouping an entity has at most one
    row a day, however many events it had.
    """
    cells = (
        df.select(F.col(entity).alias("entity"), F.col(date).alias("at")).dropna().select("entity", micros("at").alias("at"))
        .groupBy("entity", F.col("at") - F.pmod("at", F.lit(MICROS_PER_DAY)))
        .agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    ).select("entity", "n", "first", "last")
    before = F.lag("last").over(Window.partitionBy("entity").orderBy("first"))
    moved = F.floor((F.col("first") - F.col("before")) / F.lit(MICROS_PER_DAY))
    # a row for every whole number of days from here on
    between = cells.withColumn("before", before).groupBy(moved.alias("gap")).agg(F.count("*").alias("n"), F.sum(F.col("n") - 1).alias("inside"))
    steps = F.array(F.struct("gap", "n"), F.struct(F.lit(0).cast("bigint").alias("gap"), F.col("inside").alias("n")))
    return between.select(F.inline(steps)).where("gap is not null and n > 0").groupBy("gap").agg(F.sum("n").alias("n"))


# -- behavioural segments ----------------------------------------------------------------------------

BEHAVIOUR = ("recency_days", "frequency", "monetary")
MIN_ENTITIES = 20


@dataclass(frozen=True)
class Segmentation:
    profile: DataFrame | None
    silhouettes: dict[int, float]
    chosen: int | None
    reason: str | None


def behavioural_segments(
    features: DataFrame, ks: Sequence[int] = (2, 3, 4, 5), floor: float = 0.25, seed: int = 42, starts: int = 10
) -> Segmentation:
    """k-means on standardised recency, frequency and monetary value; k by silhouette over squared distances.

    All starts of all k are iterated together (``kmeans.fit``). Clusters are numbered by their centres, the smallest recency first.
    """
    features = settle(features)
    n = features.count()
    if n < MIN_ENTITIES:
        return Segmentation(None, {}, None, f"entities: {n}, needs {MIN_ENTITIES}")
    spread = features.agg(*[F.struct(F.avg(c).alias("m"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("s")).alias(c) for c in BEHAVIOUR]).first()
    axes = [f"z_{c}" for c in BEHAVIOUR]
    scaled = settle(features.withColumns({
        z: (F.col(c).cast("double") - F.lit(float(spread[c]["m"]))) / F.lit(float(spread[c]["s"])) if spread[c]["s"] else F.lit(0.0) for z, c in zip(axes, BEHAVIOUR)
    }))
    found = kmeans.fit(scaled, axes, [k for k in ks if k < n], starts, seed)
    scores = kmeans.silhouettes(scaled, axes, found)
    if not scores:
        return Segmentation(None, {}, None, "all entities fall into one cluster")
    best = max(sorted(scores), key=scores.get)
    if scores[best] < floor:
        return Segmentation(None, scores, best, f"silhouette {scores[best]:.3f} (k={best}) < {floor}")
    labelled = kmeans.assign(scaled, axes, found[best])
    value, count = labelled.agg(F.sum("monetary")).scalar(), F.lit(n)
    profile = labelled.groupBy("prediction").agg(
        F.count("*").alias("entity_count"), F.sum("monetary").alias("value"), *[half_even(F.avg(c), 3).alias(f"mean_{c}") for c in BEHAVIOUR]
    ).select(
        F.concat(F.lit("cluster "), F.col("prediction")).alias("segment"), "entity_count", half_even(F.col("entity_count") / count).alias("entity_share"),
        half_even("value").alias("value_total"), half_even(F.coalesce(F.try_divide(F.col("value"), value), F.lit(0.0))).alias("value_share"),
        *[f"mean_{c}" for c in BEHAVIOUR], F.lit(round(scores[best], 6)).alias("silhouette"),
    )
    return Segmentation(profile, scores, best, None)


# -- market baskets ----------------------------------------------------------------------------------

WORD_BITS = 62
MIN_MEAN_BASKET = 1.2
RULE = "antecedent array<string>, consequent array<string>, support double, confidence double, lift double"
#: Frequent pairs that one pass over the patterns extends to triples, and cells of a pass' temporary matrix.
PAIRS_A_PASS = 4096
#: So many different items and their baskets are packed before anything is counted: a few words a transaction are less than its pairs.
FEW_ITEMS = 4 * WORD_BITS
CELLS = 1 << 22


@dataclass(frozen=True)
class Baskets:
    rules: DataFrame | None
    reason: str | None
    transactions: int = 0
    mean_size: float = 0.0
    items: int = 0  # items there are
    dropped: int = 0  # frequent items that ``max_items`` leaves out


def basket_patterns(df: DataFrame, transaction: str, item: str, max_items: int | None = None, least: float = 0) -> tuple[DataFrame, list[str]]:
    """Distinct baskets of the items in ``least`` transactions or more as bit words, with how often each occurs.

    A basket is a few 62-bit words combined with ``bit_or``, so a transaction of any length is a
    fixed-size aggregation buffer, and equal baskets collapse before any counting.
    """
    return _patterns(distinct_pairs(df, transaction, item), max_items, least)


def distinct_pairs(df: DataFrame, transaction: str, item: str) -> DataFrame:
    return _all_pairs(df, transaction, item).distinct()


def _all_pairs(df: DataFrame, transaction: str, item: str) -> DataFrame:
    return df.select(F.col(transaction).alias("t"), F.col(item).cast("string").alias("item")).dropna()


def _patterns(pairs: DataFrame, max_items: int | None, least: float) -> tuple[DataFrame, list[str]]:
    held = pairs.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    if max_items is not None:
        held = held.orderBy(F.desc("n"), F.asc("item")).limit(max_items)
    items = sorted(r["item"] for r in held.collect())  # with a support floor, at most mean basket size / min_support of them
    return _packed(pairs, items), items


def _packed(pairs: DataFrame, items: list[str]) -> DataFrame:
    places = rows(pairs.sparkSession, [(name, i) for i, name in enumerate(items)], "item string, place int")
    words = range((len(items) + WORD_BITS - 1) // WORD_BITS)
    placed = pairs.join(F.broadcast(places), "item")
    bit = F.expr(f"shiftleft(1L, place % {WORD_BITS})")
    baskets = placed.groupBy("t").agg(*[
        F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / WORD_BITS) == w, bit)), F.lit(0).cast("bigint")).alias(f"w{w}") for w in words
    ])
    return baskets.groupBy(*[f"w{w}" for w in words]).agg(F.count("*").alias("n"))


def _kept(patterns: DataFrame, items: int, kept: Sequence[int]) -> DataFrame:
    """Patterns of ``items`` without the places that are not ``kept``."""
    if len(kept) == items:
        return patterns
    masks = [sum(1 << i % WORD_BITS for i in kept if i // WORD_BITS == w) for w in range((items + WORD_BITS - 1) // WORD_BITS)]
    words = [F.col(f"w{w}").bitwiseAND(F.lit(mask).cast("bigint")).alias(f"w{w}") for w, mask in enumerate(masks)]
    return patterns.select(*words, "n").groupBy(*[f"w{w}" for w in range(len(masks))]).agg(F.sum("n").alias("n"))


def _reader(items: int):
    """A function of a batch of patterns to its membership matrix. It is a closure, so it travels with the job: executors need not have this package."""
    bits = WORD_BITS

    def members(batch: pd.DataFrame) -> np.ndarray:
        words = batch[[c for c in batch.columns if c != "n"]].to_numpy(dtype=np.int64)
        return ((words[:, :, None] >> np.arange(bits)) & 1).reshape(len(batch), -1)[:, :items].astype(np.float64)

    return members


def pair_support(patterns: DataFrame, items: int) -> DataFrame:
    """(a, b, n) with a <= b: weighted co-occurrence, summed as one item-by-item matrix per task."""
    members = _reader(items)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = np.zeros((items, items))
        for batch in batches:
            member = members(batch)
            gram += (member * batch["n"].to_numpy()[:, None]).T @ member
        a, b = np.nonzero(np.triu(gram))
        yield pd.DataFrame({"a": a.astype("int32"), "b": b.astype("int32"), "n": gram[a, b].astype("int64")})

    return patterns.mapInPandas(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def triple_support(patterns: DataFrame, items: int, frequent: list[tuple[int, int]]) -> DataFrame:
    """(a, b, c, n) with a < b < c, only for pairs that are frequent themselves; a pass of its own for every few thousand pairs."""
    members, cells = _reader(items), CELLS

    def over(some: list[tuple[int, int]]):
        left, right = (np.array([p[i] for p in some]) for i in (0, 1))

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held, step = np.zeros((len(some), items)), max(1, cells // len(some))
            for batch in batches:
                member, n = members(batch), batch["n"].to_numpy()
                for start in range(0, len(member), step):
                    part, weight = member[start : start + step], n[start : start + step]
                    held += (part[:, left] * part[:, right] * weight[:, None]).T @ part
            p, c = np.nonzero(held)
            keep = c > right[p]
            p, c = p[keep], c[keep]
            yield pd.DataFrame({"a": left[p].astype("int32"), "b": right[p].astype("int32"), "c": c.astype("int32"), "n": held[p, c].astype("int64")})

        return patterns.mapInPandas(count, "a int, b int, c int, n bigint")

    found = [over(frequent[at : at + PAIRS_A_PASS]) for at in range(0, len(frequent), PAIRS_A_PASS)]
    return reduce(DataFrame.unionByName, found).groupBy("a", "b", "c").agg(F.sum("n").alias("n"))


def market_basket(
    df: DataFrame, transaction: str, item: str, min_support: float = 0.02, min_confidence: float = 0.2,
    max_items: int | None = None, cap: int | None = None,
) -> Baskets:
    """Association rules over itemsets of two or three, lift above one.

    An item below the support floor is in no itemset, so leaving it out first loses nothing. Limits are the caller's: ``max_items`` keeps the
    most frequent (``dropped`` tells how many it leaves out), ``cap`` the rules of best lift.
    """
    if not 0 < min_support < 1 or not 0 < min_confidence <= 1:
        raise ValueError(f"min_support {min_support} and min_confidence {min_confidence} must be shares of one")
    pairs = _all_pairs(df, transaction, item)
    items = sorted(r["item"] for r in pairs.select("item").distinct().limit(FEW_ITEMS + 1).collect())
    if not items:
        return Baskets(None, "no complete row: transaction and item")
    few = len(items) <= FEW_ITEMS
    if few:
        # one shuffle of the transactions; sizes, items and baskets follow from the distinct baskets
        patterns = settle(_packed(pairs, items))
        size = sum((F.bit_count(c) for c in patterns.columns if c != "n"), F.lit(0))
        held = [F.sum(F.getbit(f"w{i // WORD_BITS}", F.lit(i % WORD_BITS)) * F.col("n")) for i in range(len(items))]
        overall = patterns.agg(F.sum("n").alias("n"), F.sum(size * F.col("n")).alias("k"), F.sum(F.when(size > 1, F.col("n")).otherwise(0)).alias("multi"), F.array(*held).alias("held")).first()
        total, mean = overall["n"], overall["k"] / overall["n"]
        floor = min_support * total
        every, frequent_items = len(items), sum(n >= floor for n in overall["held"])
    else:
        # read three times below: sizes, items, baskets
        pairs = settle(pairs.distinct())
        sizes = pairs.groupBy("t").agg(F.count("*").alias("k"))
        overall = sizes.agg(F.count("*").alias("n"), F.avg("k").alias("mean"), F.count_if(F.col("k") > 1).alias("multi")).first()
        total, mean = overall["n"], overall["mean"]
        floor = min_support * total
        seen = pairs.groupBy("item").agg(F.count("*").alias("n")).agg(F.count("*").alias("every"), F.count_if(F.col("n") >= floor).alias("frequent")).first()
        every, frequent_items = seen["every"], seen["frequent"]
    told = (total, mean, every, max(0, frequent_items - (frequent_items if max_items is None else max_items)))
    if mean < MIN_MEAN_BASKET:
        return Baskets(None, f"single-item baskets: mean size {mean:.2f} < {MIN_MEAN_BASKET}, {overall['multi']} of {total} hold several items", *told)
    if not frequent_items:
        return Baskets(None, f"no itemset at support {min_support}", *told)
    if few:
        common = sorted((i for i, n in enumerate(overall["held"]) if n >= floor), key=lambda i: (-overall["held"][i], i))
        patterns = _kept(patterns, len(items), common[:max_items])
    else:
        patterns, items = _patterns(pairs, max_items, floor)
        patterns = settle(patterns)
    counted = [tuple(r) for r in pair_support(patterns, len(items)).where(F.col("n") >= floor).collect()]  # frequent itemsets of one or two
    support: dict[tuple[int, ...], int] = {((a,) if a == b else (a, b)): n for a, b, n in counted}
    frequent = sorted(k for k in support if len(k) == 2)
    if not frequent:
        return Baskets(None, f"no rule at confidence {min_confidence}", *told)
    spark = df.sparkSession
    triples = triple_support(patterns, len(items), frequent).where(F.col("n") >= floor)
    single = rows(spark, [([a], n) for (a, *rest), n in support.items() if not rest], "items array<int>, n bigint")
    double = rows(spark, [(list(k), support[k]) for k in frequent], "items array<int>, n bigint")
    triple = triples.select(F.array("a", "b", "c").alias("items"), "n")
    rules = settle(_rules(single.unionByName(double).unionByName(triple), items, total, min_confidence))
    kinds = rules.agg(F.count("*").alias("confident"), F.count_if("above_chance").alias("lifted")).first()
    if not kinds["lifted"]:
        return Baskets(None, "every rule has lift <= 1" if kinds["confident"] else f"no rule at confidence {min_confidence}", *told)
    rules = rules.where("above_chance").drop("above_chance")
    if cap is not None:
        rules = rules.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedent", "consequent").limit(cap)
    return Baskets(rules, None, *told)


def _rules(itemsets: DataFrame, items: list[str], total: int, min_confidence: float) -> DataFrame:
    """Rules of enough confidence, and whether their lift is above one."""
    itemsets = settle(itemsets)
    names = F.array(*[F.lit(i) for i in items])
    # each item alone, and each pair of a triple, may stand on the left
    i = F.col("items")
    lefts = F.when(F.size(i) == 2, F.transform(i, lambda x: F.array(x))).otherwise(
        F.concat(F.transform(i, lambda x: F.array(x)), F.transform(i, lambda x: F.array_except(i, F.array(x))))
    )
    split = itemsets.where(F.size("items") > 1).select("items", "n", F.explode(lefts).alias("left"))
    split = split.withColumn("right", F.array_except("items", "left"))
    known = itemsets.select(F.col("items").alias("k"), F.col("n").alias("kn"))
    both = (
        split.join(known.select(F.col("k").alias("left"), F.col("kn").alias("n_left")), "left")
        .join(known.select(F.col("k").alias("right"), F.col("kn").alias("n_right")), "right")
    )
    confidence = F.col("n") / F.col("n_left")
    lift = F.col("n") * F.lit(total) / (F.col("n_left") * F.col("n_right"))

    def named(c):
        return F.transform(F.col(c), lambda x: F.element_at(names, x + 1))

    return both.where(confidence >= min_confidence).select(
        F.array_sort(named("left")).alias("antecedent"), F.array_sort(named("right")).alias("consequent"),
        half_even(F.col("n") / F.lit(total)).alias("support"), half_even(confidence).alias("confidence"), half_even(lift).alias("lift"),
        (F.col("n") * F.lit(total) > F.col("n_left") * F.col("n_right")).alias("above_chance"),
    )


# -- chart data --------------------------------------------------------------------------------------

def pareto_curve_points(pareto: Pareto) -> DataFrame:
    return pareto.curve.select((F.col("cumulative_entity_share") * 100).alias("x"), (F.col("cumulative_value_share") * 100).alias("y"))


def cohort_heatmap(cohorts: Cohorts) -> tuple[DataFrame, DataFrame]:
    """Cells in percent, and the colour range fitted without the trivial first period."""
    cells = cohorts.matrix.select("cohort_label", "offset", (F.col("retained_share") * 100).alias("percent"))
    seen = cells.where("offset != 0 and percent is not null").agg(F.min("percent").alias("lo"), F.max("percent").alias("hi"))
    pad = F.greatest((F.col("hi") - F.col("lo")) * 0.05, F.lit(0.5))
    return cells, seen.select(
        half_even(F.greatest(F.lit(0.0), F.col("lo") - pad), 2).alias("low"), half_even(F.least(F.lit(100.0), F.col("hi") + pad), 2).alias("high")
    )


def segment_bars(segments: DataFrame) -> DataFrame:
    return segments.select("segment", (F.col("value_share") * 100).alias("percent")).orderBy(F.desc("percent"), "segment")


def cluster_centres(segmentation: Segmentation) -> DataFrame | None:
    if segmentation.profile is None:
        return None
    size = F.greatest(F.lit(12.0), F.least(F.lit(48.0), F.col("mean_frequency") * 8))
    return segmentation.profile.select("segment", F.col("mean_recency_days").alias("x"), F.col("mean_monetary").alias("y"), size.alias("size"))
