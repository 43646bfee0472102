"""Runs, their order, their audit trail, and the few facts worth telling about one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def find_run(runs: DataFrame, id_or_number: str) -> DataFrame:
    """By id, or by number with or without a leading ``#``."""
    text = id_or_number.strip()
    number = text.removeprefix("#")
    wanted = F.col("run_id") == text
    if number.isdigit():
        wanted = wanted | (F.col("run_number") == int(number))
    return runs.where(wanted).orderBy((F.col("run_id") != text).cast("int")).limit(1)


def list_runs(runs: DataFrame, sources: DataFrame, limit: int = 50, completed_only: bool = True) -> DataFrame:
    """Newest first, with the label of the source."""
    chosen = runs.where("status = 'completed'") if completed_only else runs
    newest = chosen.orderBy(F.col("completed_at").desc_nulls_last(), F.desc("run_number")).limit(limit)
    return newest.join(sources.select("source_id", F.col("name").alias("source")), "source_id", "left").orderBy(
        F.col("completed_at").desc_nulls_last(), F.desc("run_number")
    )


def latest_completed(runs: DataFrame, per_source: int = 2) -> DataFrame:
    newest = Window.partitionBy("source_id").orderBy(F.desc("started_at"), F.desc("run_number"))
    return runs.where("status = 'completed'").withColumn("age", F.row_number().over(newest)).where(F.col("age") <= per_source)


def previous_runs(runs: DataFrame) -> DataFrame:
    """(run_id, previous_run_id) over completed runs of each source."""
    in_time = Window.partitionBy("source_id").orderBy("started_at", "run_number")
    return runs.where("status = 'completed'").select("source_id", "run_id", F.lag("run_id").over(in_time).alias("previous_run_id"))


def audit(store, run_id: str) -> DataFrame:
    """Everything recorded about a run in time order: (at, kind, what, detail)."""
    parts = {
        "trace": ("traces", F.col("agent"), F.col("summary")),
        "event": ("events", F.col("rule_id"), F.concat_ws(" ", "state", "action_taken")),
        "query": ("queries", F.col("question"), F.col("state")),
        "model": ("models", F.concat_ws(" ", "target", "family"), F.concat_ws(" ", "metric", F.col("score").cast("string"))),
        "egress": ("egress", F.col("consumer"), F.concat_ws(" ", "policy", F.col("row_count").cast("string"))),
    }
    trail = None
    for kind, (table, what, detail) in parts.items():
        rows_of_run = store.read(table).where(F.col("run_id") == run_id).select("at", F.lit(kind).alias("kind"), what.alias("what"), detail.alias("detail"))
        trail = rows_of_run if trail is None else trail.unionByName(rows_of_run)
    return trail.orderBy("at", "kind", "what")


# How many facts per group, and which exploration findings come first
FACTS_PER_GROUP = {"quality": 5, "exploration": 4, "analytics": 4, "pack": 3, "model": 1, "change": 4}
EXPLORATION_PRIORITY = {"correlation": 0, "trend": 1, "missing_pattern": 2, "outlier_cluster": 3, "distribution_shape": 4}


def top_facts(events: DataFrame, findings: DataFrame, models: DataFrame, deltas: DataFrame | None = None) -> DataFrame:
    """Per run, the most telling rows of each group: (run_id, section, position, label, figure).

    The rank filter cuts each task's rows to the few that can win before anything is shuffled.
    """
    action = F.coalesce(F.col("action_taken"), F.lit(""))
    quality = events.select("run_id", F.inline(F.array_compact(F.array(
        F.struct(F.lit(0).alias("rank"), F.lit("issues detected").alias("label")),
        F.when(action.startswith("auto_fix") & ~action.contains("reverted"), F.struct(F.lit(1).alias("rank"), F.lit("fixed automatically").alias("label"))),
        F.when(action.contains("reverted"), F.struct(F.lit(2).alias("rank"), F.lit("reverted").alias("label"))),
        F.when(F.col("state").isin("awaiting_approval", "escalated"), F.struct(F.lit(3).alias("rank"), F.lit("waiting for a decision").alias("label"))),
    )))).groupBy("run_id", "rank", "label").agg(F.count("*").cast("double").alias("figure")).withColumn("section", F.lit("quality"))
    priority = F.create_map(*[F.lit(x) for pair in EXPLORATION_PRIORITY.items() for x in pair])
    label = F.concat_ws(" ", "finding_type", F.concat_ws(",", "columns"), "scope")
    figure = F.coalesce(*[F.try_element_at("metrics", F.lit(m)) for m in ("coefficient", "slope", "value_share", "observed", "entity_count", "support", "skew", "count")])
    explored = findings.where("section = 'exploration'").withColumn("rank", F.try_element_at(priority, F.col("finding_type"))).where("rank is not null")
    analysed = findings.where("section = 'analytics'").withColumn("rank", F.lit(0))
    packs = findings.where("section not in ('exploration', 'analytics')").withColumn("rank", F.when(F.col("attrs")["severity"] == "warning", 0).otherwise(1))
    facts = quality.select("run_id", "section", "rank", "label", "figure")
    for section, frame in (("exploration", explored), ("analytics", analysed), ("pack", packs)):
        facts = facts.unionByName(frame.select("run_id", F.lit(section).alias("section"), "rank", label.alias("label"), figure.alias("figure")))
    scored = models.where("score is not null").select(
        "run_id", F.lit("model").alias("section"), F.lit(0).alias("rank"), F.concat_ws(" ", "target", "metric").alias("label"), F.col("score").alias("figure"), "at"
    )
    newest = Window.partitionBy("run_id").orderBy(F.desc("at"))
    facts = facts.unionByName(scored.withColumn("i", F.row_number().over(newest)).where("i = 1").drop("i", "at"))
    if deltas is not None:
        facts = facts.unionByName(deltas.where("changed").select(
            "run_id", F.lit("change").alias("section"), F.lit(0).alias("rank"), "label", F.col("absolute").alias("figure")
        ))
    order = Window.partitionBy("run_id", "section").orderBy("rank", "label")
    most = max(FACTS_PER_GROUP.values())
    cap = F.create_map(*[F.lit(x) for pair in FACTS_PER_GROUP.items() for x in pair])
    ranked = facts.withColumn("position", F.row_number().over(order)).where(F.col("position") <= most)
    return ranked.where(F.col("position") <= cap[F.col("section")]).drop("rank")
