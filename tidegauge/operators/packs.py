"""What the domain rule packs share: the shape of a finding, and running rules one by one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.numeric import half_even
from tidegauge.session import hold, rows, settle

FINDING = (
    "rule string, severity string, metric string, scope string, observed double, threshold double,"
    " compared_against string, observations bigint, parameters map<string,double>"
)
SKIPPED = "rule string, reason string"


def finding(
    frame: DataFrame, rule: str, severity: str, metric: Column | str, observed: Column, threshold: Column, against: str,
    observations: Column, scope: Column | None = None, **parameters: Column,
) -> DataFrame:
    """One finding per row of ``frame``."""
    pairs = [part for k, v in parameters.items() for part in (F.lit(k), v.cast("double"))]
    return frame.select(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"),
        (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"),
        (scope.cast("string") if scope is not None else F.lit(None).cast("string")).alias("scope"),
        half_even(observed).alias("observed"), half_even(threshold).alias("threshold"), F.lit(against).alias("compared_against"),
        observations.cast("bigint").alias("observations"),
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")).alias("parameters"),
    )


def nothing(df: DataFrame) -> DataFrame:
    return rows(df.sparkSession, [], FINDING)


def skipped(df: DataFrame, rule: str, reason: str) -> DataFrame:
    return rows(df.sparkSession, [(rule, reason)], SKIPPED)


def none_skipped(df: DataFrame) -> DataFrame:
    return rows(df.sparkSession, [], SKIPPED)


Rule = Callable[..., tuple[DataFrame, DataFrame]]


def run_rules(rules: Sequence[Rule], frame: DataFrame, config) -> tuple[DataFrame, DataFrame]:
    """All rules; one that fails becomes a skipped row. Ids are ``{rule}-{position}``.

    Findings number at most a few per campaign or series, skipped rows a few per rule.
    """
    found, left_out = nothing(frame), none_skipped(frame)
    for i, rule in enumerate(rules):
        try:
            findings, reasons = rule(frame, config)
            # computed here, so that a rule failing while it runs is caught as well
            findings, reasons = settle(findings.withColumn("order", F.lit(i))), hold(reasons)
        except Exception as error:  # noqa: BLE001 - a failing rule must not hide the others
            findings = nothing(frame).withColumn("order", F.lit(i))
            reasons = skipped(frame, rule.__name__, f"rule raised {type(error).__name__}: {error}")
        found = findings if i == 0 else found.unionByName(findings)
        left_out = left_out.unionByName(reasons)
    within = Window.partitionBy("rule").orderBy("metric", "scope")
    numbered = found.withColumn("finding_id", F.concat_ws("-", "rule", F.row_number().over(within) - 1))
    return numbered.drop("order"), left_out
