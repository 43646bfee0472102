"""Run every business analysis a table supports; the others say why they did not run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.operators import business, roles
from tidegauge.operators.roles import REQUIREMENTS, Detection
from tidegauge.session import hold, rows, shelve

FINDING = "analysis string, finding_type string, scope string, metrics map<string,double>"
STATUS = "analysis string, ran boolean, reason string"


def _findings(frame: DataFrame, analysis: str, finding_type: str, scope, metrics: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("k"), F.col(m).cast("double").alias("v")) for m in metrics])
    return frame.select(
        F.lit(analysis).alias("analysis"), F.lit(finding_type).alias("finding_type"), scope.cast("string").alias("scope"),
        F.map_from_entries(F.filter(pairs, lambda s: s["v"].isNotNull())).alias("metrics"),
    )


def run_all(df: DataFrame, confirmed: dict[str, str] | None = None, detection: Detection | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings with ids, status per analysis). An analysis that fails becomes a not-run row."""
    spark = df.sparkSession
    # read about ten times below; whatever join it comes from is done once
    df = shelve(df)
    found_roles = detection or roles.detect(df, confirmed, dealt=True)
    part = found_roles.assigned
    basis = business.value_basis(part.get("monetary"), part.get("quantity"))
    shared: dict[str, DataFrame] = {}

    def dated() -> DataFrame:
        return df.where(F.col(part["entity_id"]).isNotNull() & F.col(part["event_date"]).isNotNull())

    def scored() -> DataFrame:
        if "scored" not in shared:
            if not dated().limit(1).count():
                raise ValueError("no complete row: entity, date and value")
            features = business.entity_features(df, part["entity_id"], part["event_date"], basis.column())
            shared["scored"] = business.rfm_scores(features)
        return shared["scored"]

    def pareto():
        group = part.get("item_id") or part.get("entity_id") or part.get("transaction_id")
        if group:
            totals = business.entity_totals(df, group, basis.column())
        else:
            totals = business.row_totals(df, basis.column(), [F.asc(c) for c in df.columns])
        result = business.abc_pareto(totals)
        if result.reason:
            raise ValueError(result.reason)
        yield _findings(result.bands, "abc_pareto", "concentration_band", F.col("band"), ["entity_count", "entity_share", "value_total", "value_share", "cumulative_value_share"])
        yield _findings(result.summary, "abc_pareto", "concentration_curve", F.lit(None), ["entity_count", "total_value", "top_entity_count", "top_value_share"])
        held_out = result.non_contributing.where("entity_count > 0")
        yield _findings(held_out, "abc_pareto", "non_contributing_entities", F.lit(None), ["entity_count", "zero_net_count", "negative_net_count", "net_value_total"])

    def rfm():
        yield _findings(business.rfm_segments(scored()), "rfm", "segment_profile", F.col("segment"), ["entity_count", "entity_share", "value_total", "value_share"])

    def cohorts():
        result = business.cohort_retention(df, part["entity_id"], part["event_date"])
        if result.reason:
            raise ValueError(result.reason)
        yield _findings(result.mean_curve, "cohort_retention", "retention_matrix", F.col("offset"), ["mean_retained_share"])

    def clusters():
        result = business.behavioural_segments(scored().select("entity", *business.BEHAVIOUR))
        if result.reason:
            raise ValueError(result.reason)
        yield _findings(result.profile, "behavioural_segmentation", "segment_profile", F.col("segment"), ["entity_count", "value_share", "silhouette"])

    def baskets():
        result = business.market_basket(df, part["transaction_id"], part["item_id"])
        if result.reason:
            raise ValueError(result.reason)
        sides = F.concat(F.array_join("antecedent", ","), F.lit(" -> "), F.array_join("consequent", ","))
        yield _findings(result.rules, "market_basket", "association_rule", sides, ["support", "confidence", "lift"])

    def churn():
        if not dated().limit(1).count():
            raise ValueError("no complete row: entity and date")
        result = business.repeat_behaviour(df, part["entity_id"], part["event_date"])
        yield _findings(result, "retention_churn", "repeat_behaviour", F.lit(None), ["entity_count", "repeat_rate", "inactive_share", "gap_days_median"])

    def lifetime():
        result = business.historical_value(scored())
        yield _findings(result, "historical_clv", "lifetime_value", F.col("segment"), ["average_order_value", "purchase_frequency", "historical_value_per_entity"])

    analyses: dict[str, Callable] = {
        "abc_pareto": pareto, "rfm": rfm, "cohort_retention": cohorts, "behavioural_segmentation": clusters, "market_basket": baskets,
        "retention_churn": churn, "historical_clv": lifetime,
    }
    findings, status = rows(spark, [], FINDING), []
    for name, run in analyses.items():
        missing = [r for r in REQUIREMENTS[name][0] if r not in part]
        if missing:
            status.append((name, False, f"needs {', '.join(missing)}; not detected"))
            continue
        try:
            # a handful of rows per analysis (bands, segments, offsets, rules between frequent items)
            produced = [hold(frame) for frame in run()]
        except Exception as error:  # noqa: BLE001 - one failing analysis must not hide the others
            status.append((name, False, str(error)))
            continue
        for frame in produced:
            findings = findings.unionByName(frame)
        status.append((name, True, None))
    order = Window.partitionBy("analysis").orderBy("finding_type", "scope")
    numbered = findings.withColumn("finding_id", F.concat_ws("-", "analysis", "finding_type", F.row_number().over(order) - 1))
    return numbered, rows(spark, status, STATUS)
