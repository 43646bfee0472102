"""Three-state validation of a table against a baseline.

Every rule instance yields one row: passed, failed or not_applicable. The table is scanned for three
small frames (column summary, histogram on the baseline's edges, distinct values of the low-cardinality
columns); everything after that works on a few rows per column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.kinds import CATEGORICAL, NUMERIC, kinds, nan_to_null, text_of
from tidegauge.functions.text import fold
from tidegauge.operators.profile import Baseline, column_summary
from tidegauge.plans import stats
from tidegauge.session import hold, rows

# Fixed values
SCHEMA, NULLS, DRIFT, CATEGORY = "schema_conformance", "null_threshold", "distribution_drift", "categorical_drift"
ENCODING, FALLBACK = "low_confidence_encoding", "encoding_fallback_overruled"
WARNING, PARTIAL_DATES = "connector_warning", "datetime_partial_parse"
PASSED, FAILED, NOT_APPLICABLE = "passed", "failed", "not_applicable"
PSI_EPSILON = 1e-4
OUTCOME = "rule_id string, family string, column string, status string, detail map<string,string>"


@dataclass(frozen=True)
class Rules:
    null_tolerance: float = 0.05
    drift_threshold: float = 0.2
    row_count_drop: float = 0.1
    encoding_confidence: float = 0.5
    drift_test: str = "psi"
    category_ceiling: int = 10


@dataclass(frozen=True)
class Arrival:
    """What the reader knows about a batch besides its rows."""

    detected_encoding: str | None = None
    encoding_confidence: float | None = None
    encoding_used: str | None = None
    warnings: tuple[str, ...] = ()
    date_attempts: DataFrame | None = None  # column, parse_rate, coerced


def _detail(**entries: Column) -> Column:
    pairs = [part for key, value in entries.items() for part in (F.lit(key), value.cast("string"))]
    return F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")


def _outcome(rule: Column, family: str, column: Column, status: Column, detail: Column) -> list[Column]:
    return [rule.alias("rule_id"), F.lit(family).alias("family"), column.alias("column"), status.alias("status"), detail.alias("detail")]


def _reason(text: str) -> Column:
    return _detail(reason=F.lit(text))


def _paired(df: DataFrame, baseline: Baseline) -> DataFrame:
    """Baseline and current column descriptions side by side (full outer join of two schemas)."""
    current = column_summary(df).select(
        "column",
        F.col("dtype").alias("now_dtype"),
        F.col("kind").alias("now_kind"),
        F.col("null_rate").alias("now_null_rate"),
        F.col("rows").alias("now_rows"),
        F.col("nulls").alias("now_nulls"),
    )
    known = baseline.columns.withColumn("known", F.lit(True))
    return known.join(current, "column", "full_outer")


def _not_excluded(frame: DataFrame, baseline: Baseline) -> DataFrame:
    return frame.join(baseline.excluded.select("column"), "column", "left_anti")


def schema_rules(pair: DataFrame, baseline: Baseline, row_count: Column, rules: Rules) -> DataFrame:
    known, present = F.col("known").isNotNull(), F.col("now_dtype").isNotNull()
    missing = pair.where(known).select(*_outcome(
        F.concat(F.lit(f"{SCHEMA}:missing_column:"), F.col("column")), SCHEMA, F.col("column"),
        F.when(present, PASSED).otherwise(FAILED),
        F.when(~present, _detail(expected_dtype=F.col("dtype"))),
    ))
    unexpected = _not_excluded(pair.where(~known), baseline).select(*_outcome(
        F.concat(F.lit(f"{SCHEMA}:unexpected_column:"), F.col("column")), SCHEMA, F.col("column"),
        F.lit(FAILED), _detail(actual_dtype=F.col("now_dtype")),
    ))
    types = pair.where(known).select(*_outcome(
        F.concat(F.lit(f"{SCHEMA}:dtype_mismatch:"), F.col("column")), SCHEMA, F.col("column"),
        F.when(~present, NOT_APPLICABLE).when(F.col("dtype") == F.col("now_dtype"), PASSED).otherwise(FAILED),
        F.when(~present, _reason("column not present")).otherwise(
            _detail(expected_dtype=F.col("dtype"), actual_dtype=F.col("now_dtype"))
        ),
    ))
    before = F.lit(baseline.row_count)
    fraction = F.try_divide(before - F.col("now"), before)
    drop = pair.agg(row_count.alias("now")).select(*_outcome(
        F.lit(f"{SCHEMA}:row_count_drop"), SCHEMA, F.lit(None).cast("string"),
        F.when(before == 0, NOT_APPLICABLE).when(fraction > rules.row_count_drop, FAILED).otherwise(PASSED),
        F.when(before == 0, _reason("baseline row_count is 0")).otherwise(_detail(
            baseline_row_count=before, current_row_count=F.col("now"), drop_fraction=fraction,
            tolerance=F.lit(rules.row_count_drop),
        )),
    ))
    return missing.unionByName(unexpected).unionByName(types).unionByName(drop)


def null_rules(pair: DataFrame, rules: Rules) -> DataFrame:
    present = F.col("now_dtype").isNotNull()
    return pair.where("known").select(*_outcome(
        F.concat(F.lit(f"{NULLS}:"), F.col("column")), NULLS, F.col("column"),
        F.when(~present, NOT_APPLICABLE)
        .when(F.col("now_null_rate") > F.col("null_rate") + rules.null_tolerance, FAILED)
        .otherwise(PASSED),
        F.when(~present, _reason("column not present")).otherwise(_detail(
            baseline_null_rate=F.col("null_rate"), current_null_rate=F.col("now_null_rate"),
            tolerance=F.lit(rules.null_tolerance),
        )),
    ))


def psi_scores(df: DataFrame, baseline: Baseline, columns: list[str]) -> DataFrame:
    """(column, score): population stability index on the baseline's bins, outer edges open.

    The bin of a value is the number of inner edges at or below it; the edges are literals (a dozen per
    column), so the whole table costs one scan and one small shuffle.
    """
    edges: dict[str, list[float]] = {c: [] for c in columns}
    for row in baseline.histogram.where(F.col("bin") > 0).orderBy("column", "bin").collect():
        if row["column"] in edges:
            edges[row["column"]].append(row["low_edge"])
    binned = []
    for c in columns:
        value = F.col(c).cast("double")
        at = sum((F.when(value >= e, 1).otherwise(0) for e in edges[c]), F.lit(0))
        binned.append(F.when(value.isNotNull(), at).alias(c))
    now = (
        df.select(*binned).unpivot([], columns, "column", "bin").where("bin is not null")
        .groupBy("column", "bin").agg(F.count("*").alias("now"))
    )
    totals = now.groupBy("column").agg(F.sum("now").alias("now_total"))
    before = baseline.histogram.where(F.col("column").isin(columns))
    before = before.join(before.groupBy("column").agg(F.sum("n").alias("total")), "column")
    share_before = F.when(F.col("n") == 0, PSI_EPSILON).otherwise(F.col("n") / F.col("total"))
    share_now = F.when(F.coalesce("now", F.lit(0)) == 0, PSI_EPSILON).otherwise(F.col("now") / F.col("now_total"))
    return (
        before.join(totals, "column")
        .join(now, ["column", "bin"], "left")
        .select("column", ((share_now - share_before) * F.ln(share_now / share_before)).alias("term"))
        .groupBy("column")
        .agg(F.sum("term").alias("score"))
    )


def ks_scores(df: DataFrame, baseline: Baseline, columns: list[str]) -> DataFrame:
    """(column, score): two-sample Kolmogorov-Smirnov statistic against the stored sample.

    Only the share of current values below, and at or below, each sample point matters. A task places each value among the (at most 1000) sorted sample points of
    its column by bisection, for all columns in one reading, and gives out one count per place.
    """
    points = (
        baseline.sample.where(F.col("column").isin(columns))
        .groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("s"))
    )
    sample = {r["column"]: r["s"] for r in points.collect()}  # at most a thousand values a column
    counted = _places(df, sample).groupBy("column", "place").agg(F.sum("n").alias("n"))
    steps = []
    for c, values in sample.items():
        distinct = sorted(set(values))
        running = 0
        for i, v in enumerate(distinct):
            first = running
            running += values.count(v)
            steps.append((c, i, first / len(values), running / len(values)))
    grid = rows(df.sparkSession, steps, "column string, i bigint, share_before double, share_upto double")
    # at most 1000 sample points and 2001 places per column
    joined = grid.join(counted, "column").groupBy("column", "i", "share_before", "share_upto").agg(
        F.sum(F.when(F.col("place") < 2 * F.col("i") + 1, F.col("n")).otherwise(0)).alias("lt"),
        F.sum(F.when(F.col("place") <= 2 * F.col("i") + 1, F.col("n")).otherwise(0)).alias("le"),
        F.sum("n").alias("total"),
    )
    gap = F.greatest(
        F.abs(F.col("share_upto") - F.col("le") / F.col("total")),
        F.abs(F.col("share_before") - F.col("lt") / F.col("total")),
    )
    return joined.groupBy("column").agg(F.max(gap).alias("score"))


def _places(df: DataFrame, sample: dict[str, list[float]]) -> DataFrame:
    """(column, place, n): 2 * i for a value strictly before sample point i, 2 * i + 1 for a value equal to it; one row a task, column and place."""
    columns = list(sample)
    grids = [np.unique(np.array(sample[c], float)) for c in columns]
    numbers = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2 * len(g) + 1, np.int64) for g in grids]
        for batch in batches:
            for i, grid in enumerate(grids):
                v = batch.column(i).to_numpy(zero_copy_only=False)
                v = v[~np.isnan(v)]
                low = np.searchsorted(grid, v, "left")
                equal = np.append(grid, np.nan)[low] == v
                counts[i] += np.bincount(2 * low + equal, minlength=len(counts[i]))
        for i, held in enumerate(counts):
            at = np.flatnonzero(held)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([columns[i]] * len(at)), pa.array(at), pa.array(held[at])], ["column", "place", "n"])

    return numbers.mapInArrow(place, "column string, place long, n long")


def drift_rules(df: DataFrame, pair: DataFrame, baseline: Baseline, rules: Rules) -> DataFrame:
    now_kinds = kinds(df)
    numeric_before = [r["column"] for r in baseline.columns.where(F.col("kind") == NUMERIC).select("column").collect()]
    columns = [c for c in numeric_before if now_kinds.get(c) == NUMERIC]
    scorer, method = (ks_scores, "ks_statistic") if rules.drift_test == "ks" else (psi_scores, "psi")
    scores = scorer(df, baseline, columns) if columns else rows(df.sparkSession, [], "column string, score double")
    scored = pair.where("known").join(scores, "column", "left")
    why = (
        F.when(F.col("kind") != NUMERIC, "baseline column is not numeric")
        .when(F.col("now_dtype").isNull(), "column not present")
        .when(F.col("now_kind") != NUMERIC, "column is not numeric in the current data")
        .when(F.col("now_nulls") == F.col("now_rows"), "no non-null values to compare")
        .when(F.col("score").isNull(), f"{method} could not be computed")
    )
    return scored.select(*_outcome(
        F.concat(F.lit(f"{DRIFT}:"), F.col("column")), DRIFT, F.col("column"),
        F.when(why.isNotNull(), NOT_APPLICABLE).when(F.col("score") > rules.drift_threshold, FAILED).otherwise(PASSED),
        F.when(why.isNotNull(), _detail(reason=why)).otherwise(_detail(
            method=F.lit(method), score=F.col("score"), threshold=F.lit(rules.drift_threshold),
        )),
    ))


def category_rules(df: DataFrame, pair: DataFrame, baseline: Baseline, rules: Rules) -> DataFrame:
    """Same categories up to case and white space, but written differently."""
    before = (
        baseline.top_values.groupBy("column")
        .agg(F.array_sort(F.collect_set("value")).alias("before"), F.array_sort(F.collect_set(fold(F.col("value")))).alias("before_folded"))
    )
    now_kinds = kinds(df)
    comparable = baseline.columns.where((F.col("kind") == CATEGORICAL) & (F.col("cardinality") <= rules.category_ceiling))
    columns = [r["column"] for r in comparable.select("column").collect() if now_kinds.get(r["column"], NUMERIC) != NUMERIC]
    schema = "column string, now array<string>, now_count bigint, now_folded array<string>"
    if columns:
        # a column can only match if its folded set has at most `ceiling` members, so keep ceiling + 1
        raw = stats.text_counts(df, columns).withColumn("folded", fold(F.col("value")))
        folded = raw.groupBy("column", "folded").agg(F.count("*").alias("spellings"))
        few = folded.groupBy("column").agg(F.count("*").alias("k")).where(F.col("k") <= rules.category_ceiling)
        # one spelling more than the baseline stores is enough to tell the sets apart; the detail also counts them all
        spellings = raw.join(few, "column").groupBy("column").agg(F.count("*").alias("now_count"))
        shown = stats.top_values(raw.drop("folded").join(few, "column"), rules.category_ceiling * 20)
        names = shown.groupBy("column").agg(F.array_sort(F.collect_set("value")).alias("now")).join(spellings, "column")
        normal = folded.join(few, "column").groupBy("column").agg(F.array_sort(F.collect_set("folded")).alias("now_folded"))
        now = names.join(normal, "column")
    else:
        now = rows(df.sparkSession, [], schema)
    compared = pair.where("known").join(before, "column", "left").join(now, "column", "left")
    why = (
        F.when(F.col("kind") != CATEGORICAL, "baseline column is not categorical")
        .when(F.col("now_dtype").isNull(), "column not present")
        .when(F.col("now_kind") == NUMERIC, "column is numeric in the current data")
        .when(F.col("cardinality") > rules.category_ceiling, "baseline has more categories than it stores")
        .when(F.col("before").isNull(), "no baseline categories recorded")
    )
    drifted = (F.col("now") != F.col("before")) & (F.col("now_folded") == F.col("before_folded"))
    drifted = F.coalesce(drifted, F.lit(False))
    return compared.select(*_outcome(
        F.concat(F.lit(f"{CATEGORY}:"), F.col("column")), CATEGORY, F.col("column"),
        F.when(why.isNotNull(), NOT_APPLICABLE).when(drifted, FAILED).otherwise(PASSED),
        F.when(why.isNotNull(), _detail(reason=why)).when(drifted, _detail(
            drift_kind=F.lit("whitespace_or_case"), baseline_values=F.to_json("before"), current_values=F.to_json("now"),
            current_value_count=F.col("now_count"),
        )),
    ))


def excluded_rules(baseline: Baseline) -> DataFrame:
    """Columns left out of the baseline are not_applicable in every family, and say so."""
    prefixes = F.array(
        *[F.struct(F.lit(f).alias("family"), F.lit(p).alias("prefix")) for f, p in (
            (SCHEMA, f"{SCHEMA}:missing_column:"), (SCHEMA, f"{SCHEMA}:dtype_mismatch:"), (NULLS, f"{NULLS}:"),
            (DRIFT, f"{DRIFT}:"), (CATEGORY, f"{CATEGORY}:"),
        )]
    )
    return baseline.excluded.select("column", F.explode(prefixes).alias("p")).select(
        F.concat("p.prefix", "column").alias("rule_id"), F.col("p.family").alias("family"), "column",
        F.lit(NOT_APPLICABLE).alias("status"),
        _reason("column excluded from baseline profiling (identifier-shaped)").alias("detail"),
    )


def encodings_equivalent(detected: str | None, used: str | None) -> bool:
    def plain(name):
        return name.lower().replace("_", "-") if name else None

    detected, used = plain(detected), plain(used)
    if detected is None or used is None:
        return False
    return detected == used or (detected in ("ascii", "us-ascii") and used == "utf-8")


def arrival_rules(df: DataFrame, arrival: Arrival, rules: Rules) -> DataFrame:
    """Encoding and partial-date outcomes; facts about the file, not about its rows."""
    seen, used, sure = arrival.detected_encoding, arrival.encoding_used, arrival.encoding_confidence
    known = []
    rule = f"{ENCODING}:{seen or 'unknown'}"
    if seen is None or sure is None:
        known.append((rule, ENCODING, None, NOT_APPLICABLE, {"reason": "no detected encoding or confidence"}))
    else:
        status = FAILED if sure < rules.encoding_confidence else PASSED
        known.append((rule, ENCODING, None, status, {"detected_encoding": seen, "confidence": str(sure)}))
    rule = f"{FALLBACK}:{seen or 'unknown'}->{used or 'unknown'}"
    if seen is None or used is None:
        known.append((rule, FALLBACK, None, NOT_APPLICABLE, {"reason": "no detected or used encoding"}))
    else:
        status = PASSED if encodings_equivalent(seen, used) else FAILED
        known.append((rule, FALLBACK, None, status, {"detected_encoding": seen, "encoding_used": used}))
    outcomes = rows(df.sparkSession, known, OUTCOME)
    if arrival.date_attempts is not None:
        outcomes = outcomes.unionByName(arrival.date_attempts.select(*_outcome(
            F.concat(F.lit(f"{PARTIAL_DATES}:"), F.col("column")), PARTIAL_DATES, F.col("column"),
            F.when(F.col("coerced"), PASSED).otherwise(FAILED),
            _detail(parse_rate=F.col("parse_rate"), coerced=F.col("coerced")),
        )))
    return outcomes


def connector_warnings(df: DataFrame, arrival: Arrival) -> DataFrame:
    events = [(f"{WARNING}:{i}", WARNING, None, FAILED, {"message": m}) for i, m in enumerate(arrival.warnings)]
    return rows(df.sparkSession, events, OUTCOME)


def fold_derived_type_changes(outcomes: DataFrame) -> DataFrame:
    """An integer column read as double because of nulls or a scale change is one failure, not two."""
    type_change = (
        (F.col("status") == FAILED)
        & F.col("rule_id").startswith(f"{SCHEMA}:dtype_mismatch:")
        & F.col("detail")["expected_dtype"].rlike("^(tinyint|smallint|int|bigint|byte|short|integer|long)$")
        & (F.col("detail")["actual_dtype"] == "double")
    )
    candidates = outcomes.where(type_change).select(
        "column", F.col("rule_id").alias("type_rule"), F.col("detail").alias("type_detail")
    )
    hosts = (
        outcomes.where((F.col("status") == FAILED) & F.col("family").isin(NULLS, DRIFT))
        .groupBy("column").agg(F.max("family").alias("host"))  # null_threshold sorts after distribution_drift
    )
    folds = candidates.join(hosts, "column")
    dropped = outcomes.join(folds.select(F.col("type_rule").alias("rule_id")), "rule_id", "left_anti")
    note = F.create_map(
        F.lit("dtype_change_expected"), F.col("type_detail")["expected_dtype"],
        F.lit("dtype_change_actual"), F.col("type_detail")["actual_dtype"],
    )
    keyed = folds.select(F.col("column").alias("__c"), F.col("host").alias("__host"), "type_detail")
    on = (F.col("column") == F.col("__c")) & (F.col("family") == F.col("__host")) & (F.col("status") == FAILED)
    return dropped.join(keyed, on, "left").select(
        "rule_id", "family", "column", "status",
        F.when(F.col("__c").isNotNull(), F.map_concat("detail", note)).otherwise(F.col("detail")).alias("detail"),
    )


def evaluate(df: DataFrame, baseline: Baseline, rules: Rules = Rules(), arrival: Arrival = Arrival()) -> DataFrame:
    """All rule outcomes as (rule_id, family, column, status, detail)."""
    df = nan_to_null(df)
    pair = hold(_paired(df, baseline))
    outcomes = schema_rules(pair, baseline, F.coalesce(F.max("now_rows"), F.lit(0)), rules)
    for part in (
        null_rules(pair, rules),
        drift_rules(df, pair, baseline, rules),
        category_rules(df, pair, baseline, rules),
        excluded_rules(baseline),
        arrival_rules(df, arrival, rules),
    ):
        outcomes = outcomes.unionByName(part)
    return hold(fold_derived_type_changes(hold(outcomes)))


def failures(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("status") == FAILED)


def cardinalities(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        return rows(df.sparkSession, [], "column string, now_cardinality bigint")
    long = df.unpivot([], [text_of(df, c).alias(c) for c in columns], "column", "value").where("value is not null")
    return stats.distinct_counts(stats.counts_of(long)).select("column", F.col("cardinality").alias("now_cardinality"))
