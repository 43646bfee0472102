"""Run artifacts as append-only Parquet tables, partitioned by source.

Nothing is updated in place: the latest row per key wins, and a cleared decision is a row of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.operators.profile import Baseline, sanity_floors
from tidegauge.session import rows

SCHEMAS = {
    "runs": "run_id string, run_number bigint, source_id string, status string, started_at timestamp, completed_at timestamp, row_count bigint, value_basis string",
    "sources": "source_id string, name string, type string",
    "columns": "run_id string, source_id string, position int, column string, dtype string",
    "events": "run_id string, source_id string, rule_id string, family string, column string, state string, action_taken string, detail map<string,string>, at timestamp",
    "findings": "run_id string, source_id string, section string, finding_id string, finding_type string, columns array<string>, kind string, scope string, metrics map<string,double>, attrs map<string,string>",
    "models": "run_id string, source_id string, target string, family string, metric string, score double, baseline_score double, state string, at timestamp",
    "traces": "run_id string, source_id string, agent string, summary string, at timestamp",
    "queries": "run_id string, source_id string, question string, state string, at timestamp",
    "egress": "run_id string, source_id string, consumer string, policy string, columns array<string>, row_count bigint, at timestamp",
    "decisions": "source_id string, subject string, key string, decision string, decided_by string, at timestamp",
    "baseline_columns": (
        "column string, position int, dtype string, kind string, minimum double, maximum double, mean double, std double, first_at string,"
        " last_at string, span_days double, null_rate double, cardinality bigint, baseline_id string, source_id string"
    ),
    "baseline_histogram": "column string, bin int, low_edge double, high_edge double, n bigint, baseline_id string, source_id string",
    "baseline_top_values": "column string, value string, n bigint, position int, baseline_id string, source_id string",
    "baseline_sample": "column string, value double, baseline_id string, source_id string",
    "baseline_excluded": "column string, reason string, baseline_id string, source_id string",
    "baselines": "baseline_id string, source_id string, is_provisional boolean, row_count bigint, created_at timestamp",
}


class BaselineRefused(ValueError):
    pass


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def append(self, table: str, frame: DataFrame) -> None:
        writer = frame.write.mode("append")
        (writer.partitionBy("source_id") if "source_id" in frame.columns else writer).parquet(self.path(table))

    def read(self, table: str) -> DataFrame:
        schema = SCHEMAS.get(table)
        try:
            reader = self.spark.read
            return (reader.schema(schema) if schema else reader).parquet(self.path(table))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error) or not schema:
                raise
            return rows(self.spark, [], schema)

    # -- snapshots ---------------------------------------------------------------------------------

    def save_snapshot(self, run_id: str, df: DataFrame) -> str:
        """The table as it was read, for sources that may change under us."""
        path = f"{self.path('snapshots')}/{run_id}"
        df.write.mode("overwrite").parquet(path)
        return path

    def load_snapshot(self, run_id: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path('snapshots')}/{run_id}")

    # -- decisions ---------------------------------------------------------------------------------

    def decide(self, source_id: str, subject: str, key: str, decision: str | None, by: str, at) -> None:
        """Record a confirmed role or privacy decision; ``None`` clears it."""
        self.append("decisions", rows(self.spark, [(source_id, subject, key, decision, by, at)], SCHEMAS["decisions"]))

    def decisions(self, source_id: str, subject: str) -> DataFrame:
        return latest_decisions(self.read("decisions").where((F.col("source_id") == source_id) & (F.col("subject") == subject)))

    # -- baselines ---------------------------------------------------------------------------------

    def save_baseline(self, source_id: str, baseline_id: str, baseline: Baseline, at, provisional: bool = False) -> None:
        """Append a new version, which becomes the active one; refused when the profile is not sane."""
        reasons = [r["reason"] for r in sanity_floors(baseline).collect()]
        if reasons and not provisional:
            raise BaselineRefused("; ".join(reasons))
        for part in ("columns", "histogram", "top_values", "sample", "excluded"):
            frame = getattr(baseline, part).withColumns({"baseline_id": F.lit(baseline_id), "source_id": F.lit(source_id)})
            self.append(f"baseline_{part}", frame)
        self.append("baselines", rows(self.spark, [(baseline_id, source_id, provisional, baseline.row_count, at)], SCHEMAS["baselines"]))

    def active_baselines(self) -> DataFrame:
        return active_baselines(self.read("baselines"))

    def load_baseline(self, source_id: str) -> Baseline | None:
        active = self.active_baselines().where(F.col("source_id") == source_id).first()
        if active is None:
            return None

        def part(name: str) -> DataFrame:
            mine = (F.col("baseline_id") == active["baseline_id"]) & (F.col("source_id") == source_id)
            return self.read(f"baseline_{name}").where(mine).drop("baseline_id", "source_id")

        return Baseline(active["row_count"], part("columns"), part("histogram"), part("top_values"), part("sample"), part("excluded"))


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """(source_id, subject, key, decision, decided_by): the last word on each key, cleared ones left out."""
    last = decisions.groupBy("source_id", "subject", "key").agg(F.max_by(F.struct("decision", "decided_by"), "at").alias("d"))
    return last.select("source_id", "subject", "key", "d.decision", "d.decided_by").where("decision is not null")


def active_baselines(baselines: DataFrame) -> DataFrame:
    newest = Window.partitionBy("source_id").orderBy(F.desc("created_at"), F.desc("baseline_id"))
    return baselines.withColumn("i", F.row_number().over(newest)).where("i = 1").drop("i")
