"""What changed between two runs of the same source, from their stored artifacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import rows

COMPARABLE, ONE_SIDED, NOT_COMPARABLE, ABSENT = "comparable", "one_sided", "not_comparable", "absent"
DELTA = "section string, label string, side string, before double, after double, absolute double, relative double, changed boolean"


def delta(before: Column | str, after: Column | str) -> dict[str, Column]:
    """absolute, relative (to the size of the earlier figure; undefined from zero) and changed."""
    before, after = (F.col(c) if isinstance(c, str) else c for c in (before, after))
    absolute = after - before
    return {
        "absolute": absolute,
        "relative": F.try_divide(absolute, F.abs(before)),
        "changed": F.coalesce(absolute != 0, F.lit(False)),
    }


def _long(frame: DataFrame, section: str, label: Column, side: Column, before: Column, after: Column) -> DataFrame:
    base = frame.select(
        F.lit(section).alias("section"), label.alias("label"), side.alias("side"), before.cast("double").alias("before"), after.cast("double").alias("after")
    )
    return base.withColumns(delta("before", "after"))


def diff(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, section: str, label: Column) -> DataFrame:
    """Full outer join of two (keys…, value) tables: a_only, b_only or both, with the change."""
    on = [F.col(f"__a_{k}").eqNullSafe(F.col(f"__b_{k}")) for k in keys]
    left = a.select(*[F.col(k).alias(f"__a_{k}") for k in keys], F.col(value).alias("__before"), F.lit(True).alias("__in_a"))
    right = b.select(*[F.col(k).alias(f"__b_{k}") for k in keys], F.col(value).alias("__after"), F.lit(True).alias("__in_b"))
    condition = on[0]
    for part in on[1:]:
        condition &= part
    both = left.join(right, condition, "full_outer").withColumns({
        k: F.when(F.col("__in_a").isNotNull(), F.col(f"__a_{k}")).otherwise(F.col(f"__b_{k}")) for k in keys
    })
    side = F.when(F.col("__in_b").isNull(), "a_only").when(F.col("__in_a").isNull(), "b_only").otherwise("both")
    return _long(both, section, label, side, F.col("__before"), F.col("__after"))


# -- preconditions -----------------------------------------------------------------------------------

def blocked_reason(runs: DataFrame, run_a: str, run_b: str) -> str | None:
    if run_a == run_b:
        return "a run cannot be compared with itself"
    found = {r["run_id"]: r for r in runs.where(F.col("run_id").isin(run_a, run_b)).collect()}
    missing = [r for r in (run_a, run_b) if r not in found]
    if missing:
        return f"no such run: {missing}"
    if found[run_a]["source_id"] != found[run_b]["source_id"]:
        return "these runs are of different sources"
    unfinished = [r for r in (run_a, run_b) if found[r]["status"] != "completed"]
    return f"run(s) {unfinished} did not complete" if unfinished else None


# -- sections ----------------------------------------------------------------------------------------

def schema_diff(columns: DataFrame, runs: DataFrame, run_a: str, run_b: str) -> DataFrame:
    """Added, removed and retyped columns; row and column count changes."""
    a, b = (columns.where(F.col("run_id") == r).select("column", "dtype") for r in (run_a, run_b))
    joined = a.withColumnRenamed("dtype", "da").join(b.withColumnRenamed("dtype", "db"), "column", "full_outer")
    side = F.when(F.col("db").isNull(), "a_only").when(F.col("da").isNull(), "b_only").otherwise("type_changed")
    members = _long(
        joined.where(~F.col("da").eqNullSafe(F.col("db"))), "schema",
        F.concat_ws(" ", "column", F.concat_ws(" -> ", "da", "db")), side, F.lit(None), F.lit(None),
    )
    size = runs.where(F.col("run_id").isin(run_a, run_b)).agg(
        F.max(F.when(F.col("run_id") == run_a, F.col("row_count"))).alias("a"), F.max(F.when(F.col("run_id") == run_b, F.col("row_count"))).alias("b")
    )
    width = joined.agg(F.count("da").alias("a"), F.count("db").alias("b"))
    result = members
    for name, frame in (("row count", size), ("column count", width)):
        result = result.unionByName(_long(frame, "schema", F.lit(name), F.lit("both"), F.col("a"), F.col("b")))
    return result


def quality_counts(events: DataFrame) -> DataFrame:
    """(run_id, label, n): events by rule family, automatically fixed, escalated."""
    action = F.coalesce(F.col("action_taken"), F.lit(""))
    fixed = action.startswith("auto_fix") & ~action.contains("reverted")
    escalated = F.col("state").isin("awaiting_approval", "escalated")
    labels = F.array_compact(F.array(
        F.lit("rules fired"), F.concat(F.lit("rule "), F.split("rule_id", ":")[0]), F.when(fixed, F.lit("auto-fixed")), F.when(escalated, F.lit("escalated")),
    ))
    return events.select("run_id", F.explode(labels).alias("label")).groupBy("run_id", "label").agg(F.count("*").alias("n"))


def quality_diff(events: DataFrame, run_a: str, run_b: str) -> DataFrame:
    counts = quality_counts(events)
    a, b = (counts.where(F.col("run_id") == r) for r in (run_a, run_b))
    return diff(a, b, ["label"], "n", "data_quality", F.col("label"))


def finding_metrics(findings: DataFrame, run_id: str, section: str) -> DataFrame:
    """(key, kind, metric, value): one row per figure of each finding.

    A finding is known by its section, type, columns and scope (segment, band, rule scope or the two
    sides of an association rule), so two rules on the same columns stay apart.
    """
    mine = findings.where((F.col("run_id") == run_id) & (F.col("section") == section))
    key = F.concat_ws(" ", "finding_type", F.concat_ws(",", F.array_sort("columns")), "scope")
    return mine.select(key.alias("key"), "kind", F.explode("metrics").alias("metric", "value"))


def findings_diff(findings: DataFrame, run_a: str, run_b: str, section: str) -> DataFrame:
    """Findings that appeared or went, and the change of every figure of the others.

    A finding whose kind changed (a column that became text, say) is named, not subtracted.
    """
    a, b = (finding_metrics(findings, r, section) for r in (run_a, run_b))
    kinds_a = a.select("key", F.col("kind").alias("ka")).distinct()
    kinds_b = b.select("key", F.col("kind").alias("kb")).distinct()
    changed = kinds_a.join(kinds_b, "key").where(~F.col("ka").eqNullSafe(F.col("kb")))
    named = _long(changed, section, F.concat_ws(" ", "key", F.concat_ws(" -> ", "ka", "kb")), F.lit("kind_changed"), F.lit(None), F.lit(None))
    a, b = (frame.join(changed.select("key"), "key", "left_anti") for frame in (a, b))
    return diff(a, b, ["key", "metric"], "value", section, F.concat_ws(" - ", "key", "metric")).unionByName(named)


def comparability(findings: DataFrame, run_a: str, run_b: str, section: str) -> tuple[str, str]:
    present = {r["run_id"] for r in findings.where((F.col("section") == section) & F.col("run_id").isin(run_a, run_b)).select("run_id").distinct().collect()}
    if not present:
        return ABSENT, f"neither run has {section} findings"
    if len(present) == 1:
        return ONE_SIDED, f"only run {next(iter(present))} has {section} findings"
    return COMPARABLE, ""


def analytics_comparability(findings: DataFrame, runs: DataFrame, baselines: DataFrame, run_a: str, run_b: str, section: str = "analytics") -> tuple[str, str]:
    """Value figures are only comparable on one value basis and against one baseline."""
    status = comparability(findings, run_a, run_b, section)
    if status[0] != COMPARABLE:
        return status
    pair = {r["run_id"]: r for r in runs.where(F.col("run_id").isin(run_a, run_b)).collect()}
    basis_a, basis_b = pair[run_a]["value_basis"], pair[run_b]["value_basis"]
    if basis_a != basis_b:
        return NOT_COMPARABLE, f"value was summed over {basis_a!r} and {basis_b!r}"
    started = sorted(r["started_at"] for r in pair.values())
    between = baselines.where(
        (F.col("source_id") == pair[run_a]["source_id"]) & (F.col("created_at") > F.lit(started[0])) & (F.col("created_at") < F.lit(started[1]))
    ).orderBy("created_at").first()
    if between is not None:
        return NOT_COMPARABLE, f"baseline {between['baseline_id']} was superseded between these runs"
    return COMPARABLE, ""


def latest_model(models: DataFrame, run_id: str) -> DataFrame:
    return models.where((F.col("run_id") == run_id) & F.col("score").isNotNull()).orderBy(F.desc("at")).limit(1)


def model_diff(models: DataFrame, run_a: str, run_b: str) -> tuple[DataFrame, str, str]:
    """Score and best baseline of each run's latest model; only for the same target and metric."""
    a, b = latest_model(models, run_a).first(), latest_model(models, run_b).first()
    none = rows(models.sparkSession, [], DELTA)
    if a is None and b is None:
        return none, ABSENT, "neither run has a scored model"
    if a is None or b is None:
        return none, ONE_SIDED, "only one run has a scored model"
    if (a["target"], a["metric"]) != (b["target"], b["metric"]):
        return none, NOT_COMPARABLE, f"{a['target']} by {a['metric']} and {b['target']} by {b['metric']} are different measurements"
    figures = rows(models.sparkSession, [(f"out-of-sample {a['metric']}", a["score"], b["score"]), ("best baseline score", a["baseline_score"], b["baseline_score"])],
                   "label string, before double, after double")
    return _long(figures, "model", F.col("label"), F.lit("both"), F.col("before"), F.col("after")), COMPARABLE, ""


def compare_runs(store, run_a: str, run_b: str, sections: Sequence[str] = ("exploration", "analytics", "marketing", "agriculture")) -> tuple[DataFrame, DataFrame]:
    """(deltas, section status) of two runs; blocked comparisons yield no deltas and say why."""
    runs, findings = store.read("runs"), store.read("findings")
    spark = runs.sparkSession
    blocked = blocked_reason(runs, run_a, run_b)
    status = "section string, comparability string, reason string"
    if blocked:
        return rows(spark, [], DELTA), rows(spark, [("all", NOT_COMPARABLE, blocked)], status)
    deltas = schema_diff(store.read("columns"), runs, run_a, run_b).unionByName(quality_diff(store.read("events"), run_a, run_b))
    told = [("schema", COMPARABLE, ""), ("data_quality", COMPARABLE, "")]
    for section in sections:
        if section == "analytics":
            verdict, reason = analytics_comparability(findings, runs, store.read("baselines"), run_a, run_b)
        else:
            verdict, reason = comparability(findings, run_a, run_b, section)
        told.append((section, verdict, reason))
        if verdict == COMPARABLE:
            deltas = deltas.unionByName(findings_diff(findings, run_a, run_b, section))
    models, verdict, reason = model_diff(store.read("models"), run_a, run_b)
    told.append(("model", verdict, reason))
    return deltas.unionByName(models), rows(spark, told, status)
