"""Runs compared and remembered: each month of orders is read as a run of the same source."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import compare, explore, history
from tidegauge.session import rows
from tidegauge.sources.store import SCHEMAS, Store
from tidegauge.workload.shaping import landing
from tidegauge.workload.tables import Registry, earlier_orders, filled, later_orders, read, rounded

R = Registry()


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A completed run per month and order status; 'P' months did not complete."""
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    groups = read(spark, sf_dir, "orders").groupBy(month.alias("started_at"), "o_orderstatus").agg(F.count("*").alias("row_count"))
    return groups.select(
        F.concat_ws("-", "o_orderstatus", F.date_format("started_at", "yyyyMM")).alias("run_id"),
        F.date_format("started_at", "yyyyMM").cast("bigint").alias("run_number"), F.col("o_orderstatus").alias("source_id"),
        F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), "started_at",
        F.when(F.col("o_orderstatus") != "P", F.col("started_at") + F.expr("interval 1 hour")).alias("completed_at"), "row_count",
        F.lit("o_totalprice").alias("value_basis"),
    )


RUNS_SQL = """WITH r AS (SELECT o_orderstatus || '-' || strftime(date_trunc('month', o_orderdate), '%Y%m') AS run_id, CAST(strftime(date_trunc('month', o_orderdate), '%Y%m') AS BIGINT) AS run_number,
  o_orderstatus AS source_id, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, count(*) AS row_count FROM orders GROUP BY ALL)"""


@R.add(RUNS_SQL + " SELECT run_id, run_number, 'source ' || source_id AS source, row_count FROM r WHERE status = 'completed' ORDER BY run_number DESC, run_id LIMIT 50")
def listed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty newest completed runs with their source. (Two sources share every month.)"""
    found = runs(spark, sf_dir)
    sources = found.select("source_id").distinct().select("source_id", F.concat(F.lit("source "), F.col("source_id")).alias("name"))
    return history.list_runs(found, sources).select("run_id", "run_number", "source", "row_count")


@R.add(RUNS_SQL + " SELECT run_id, coalesce(lag(run_id) OVER (PARTITION BY source_id ORDER BY run_number), '') AS previous_run_id FROM r WHERE status = 'completed'")
def previous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(history.previous_runs(runs(spark, sf_dir)).select("run_id", "previous_run_id"), previous_run_id="")


@R.add(RUNS_SQL + ", o AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY run_number DESC) AS INTEGER) AS age FROM r WHERE status = 'completed') SELECT source_id, run_id, age FROM o WHERE age <= 2")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.latest_completed(runs(spark, sf_dir)).select("source_id", "run_id", "age")


@R.add(RUNS_SQL + " SELECT run_id, row_count FROM r WHERE run_id = 'F-199801' UNION ALL (SELECT run_id, row_count FROM r WHERE run_number = 199802 ORDER BY run_id LIMIT 1)")
def found_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run by id, and one by its number."""
    all_runs = runs(spark, sf_dir)
    by_number = history.find_run(all_runs.where("source_id = 'F'"), "#199802")
    return history.find_run(all_runs, "F-199801").unionByName(by_number).select("run_id", "row_count")


# -- two stored runs: orders before and after the split ---------------------------------------------------

def stored(spark: SparkSession, sf_dir: str) -> Store:
    kept = Store(spark, landing(spark, "runs"))
    before = earlier_orders(spark, sf_dir).drop("o_orderkey")
    after = later_orders(spark, sf_dir).drop("o_orderkey", "o_orderpriority").withColumn("o_totalprice", F.col("o_totalprice") * 2).withColumn("clerk", F.lit("x"))
    for number, (run_id, table) in enumerate((("before", before), ("after", after)), 1):
        at = datetime(2024, 1, number)
        numbers = explore.numeric_summary(table)
        measures = ["count", "null_count", "minimum", "maximum", "mean", "median", "std", "q1", "q3"]
        pairs = F.array(*[F.struct(F.lit(m).alias("k"), F.col(m).cast("double").alias("v")) for m in measures])
        kept.append("findings", numbers.select(
            F.lit(run_id).alias("run_id"), F.lit("orders").alias("source_id"), F.lit("exploration").alias("section"), F.col("column").alias("finding_id"),
            F.lit("summary_stat").alias("finding_type"), F.array("column").alias("columns"), F.lit("numeric").alias("kind"), F.lit(None).cast("string").alias("scope"),
            F.map_from_entries(pairs).alias("metrics"), F.lit(None).cast("map<string,string>").alias("attrs"),
        ))
        kept.append("runs", table.agg(F.count("*").alias("row_count")).select(
            F.lit(run_id).alias("run_id"), F.lit(number).cast("bigint").alias("run_number"), F.lit("orders").alias("source_id"), F.lit("completed").alias("status"),
            F.lit(at).alias("started_at"), F.lit(at).alias("completed_at"), "row_count", F.lit("o_totalprice").alias("value_basis"),
        ))
        kept.append("columns", rows(spark, [(run_id, "orders", i, c, t) for i, (c, t) in enumerate(table.dtypes)], SCHEMAS["columns"]))
        # urgent orders stand for rule events, their status for what became of them
        events = read(spark, sf_dir, "orders").where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != ("P" if number == 1 else "F")))
        kept.append("events", events.select(
            F.lit(run_id).alias("run_id"), F.lit("orders").alias("source_id"), F.concat(F.lit("rule"), F.col("o_orderstatus"), F.lit(":"), F.col("o_orderkey")).alias("rule_id"),
            F.lit("f").alias("family"), F.lit("o_totalprice").alias("column"), F.when(F.col("o_orderstatus") == "O", "awaiting_approval").otherwise("auto_fixed").alias("state"),
            F.when(F.col("o_orderstatus") != "O", "auto_fixed").alias("action_taken"), F.lit(None).cast("map<string,string>").alias("detail"), F.lit(at).alias("at"),
        ))
    return kept


HALVES_SQL = """WITH b AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), a AS (SELECT o_custkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"""


def _summary_union(table: str) -> str:
    parts = []
    for c in ("o_custkey", "o_totalprice"):
        x = f"CAST({c} AS DOUBLE)"
        for name, e in (("count", f"CAST(count(*) AS DOUBLE)"), ("null_count", f"CAST(count(*) - count({c}) AS DOUBLE)"), ("minimum", f"min({x})"), ("maximum", f"max({x})"), ("mean", f"avg({x})"),
                        ("median", f"quantile_cont({x}, 0.5)"), ("std", f"stddev_pop({x})"), ("q1", f"quantile_cont({x}, 0.25)"), ("q3", f"quantile_cont({x}, 0.75)")):
            parts.append(f"SELECT 'summary_stat {c} - {name}' AS label, {e} AS v FROM {table}")
    return " UNION ALL ".join(parts)


@R.add(HALVES_SQL + f", mb AS ({_summary_union('b')}), ma AS ({_summary_union('a')}) SELECT label, 'both' AS side, round_even(mb.v, 3) AS before, round_even(ma.v, 3) AS after, round_even(ma.v - mb.v, 3) AS absolute, coalesce(round_even((ma.v - mb.v) / nullif(abs(mb.v), 0), 5), -99) AS relative, ma.v <> mb.v AS changed FROM mb JOIN ma USING (label)")
def finding_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure of both runs' summaries side by side."""
    found = compare.findings_diff(stored(spark, sf_dir).read("findings"), "before", "after", "exploration")
    shown = found.select("label", "side", *[rounded(c, 3).alias(c) for c in ("before", "after", "absolute")], rounded("relative", 5).alias("relative"), "changed")
    return filled(shown, relative=-99.0)


@R.add("""SELECT 'o_orderpriority string' AS label, 'a_only' AS side, CAST(-1 AS DOUBLE) AS before, CAST(-1 AS DOUBLE) AS after UNION ALL SELECT 'clerk string', 'b_only', -1, -1
UNION ALL SELECT 'column count', 'both', 5, 5 UNION ALL SELECT 'row count', 'both', count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01'), count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') FROM orders""")
def schema_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stored(spark, sf_dir)
    found = compare.schema_diff(kept.read("columns"), kept.read("runs"), "before", "after")
    return filled(found.select("label", "side", "before", "after"), before=-1.0, after=-1.0)


@R.add("""WITH e AS (SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), v AS (SELECT (SELECT n FROM e WHERE s = 'F') AS f, (SELECT n FROM e WHERE s = 'O') AS o, (SELECT n FROM e WHERE s = 'P') AS p)
SELECT 'rules fired' AS label, 'both' AS side, f + o AS before, o + p AS after FROM v UNION ALL SELECT 'auto-fixed', 'both', f, p FROM v UNION ALL SELECT 'escalated', 'both', o, o FROM v
UNION ALL SELECT 'rule ruleO', 'both', o, o FROM v UNION ALL SELECT 'rule ruleF', 'a_only', f, -1 FROM v UNION ALL SELECT 'rule ruleP', 'b_only', -1, p FROM v""")
def quality_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.quality_diff(stored(spark, sf_dir).read("events"), "before", "after")
    return filled(found.select("label", "side", "before", "after"), before=-1.0, after=-1.0)


@R.add("""SELECT * FROM (VALUES ('schema', 'comparable'), ('data_quality', 'comparable'), ('exploration', 'comparable'), ('analytics', 'absent'), ('marketing', 'absent'), ('agriculture', 'absent'), ('model', 'absent')) t(section, comparability)""")
def comparability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.compare_runs(stored(spark, sf_dir), "before", "after")[1].select("section", "comparability")


@R.add("""SELECT 'event' AS kind, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'""")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.audit(stored(spark, sf_dir), "before").groupBy("kind").agg(F.count("*").alias("n"))


@R.add("""WITH e AS (SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1), v AS (SELECT (SELECT n FROM e WHERE s = 'F') AS f, (SELECT n FROM e WHERE s = 'O') AS o, (SELECT n FROM e WHERE s = 'P') AS p)
SELECT 'before' AS run_id, 'issues detected' AS label, f + o AS figure FROM v UNION ALL SELECT 'before', 'fixed automatically', f FROM v UNION ALL SELECT 'before', 'waiting for a decision', o FROM v
UNION ALL SELECT 'after', 'issues detected', o + p FROM v UNION ALL SELECT 'after', 'fixed automatically', p FROM v UNION ALL SELECT 'after', 'waiting for a decision', o FROM v""")
def run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts worth telling about each run."""
    kept = stored(spark, sf_dir)
    return history.top_facts(kept.read("events"), kept.read("findings"), kept.read("models")).select("run_id", "label", "figure")


QUERIES, ORACLES = R.queries, R.oracles
