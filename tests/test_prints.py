"""Distinct texts are counted by prints: what crosses an exchange holds no text of the table."""

import re

from tidegauge.operators import explore, modelling
from tidegauge.plans import stats


def exchanged(df):
    """The aggregations, whose keys cross an exchange."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if re.search(r"Aggregate \[", line)]


def test_notes_and_features(spark):
    df = spark.createDataFrame([(f"text {i}", "same", float(i), float(i % 7)) for i in range(300)], "long_text string, few string, x double, y double").repartition(4)
    notes = explore.cardinality_notes(df)
    assert [(r["column"], r.cardinality, r.note) for r in notes.collect()] == [("long_text", 300, "near_unique")]
    counted = stats.distinct_per_column(df, ["long_text", "few"])
    assert not [line for line in exchanged(counted) if "long_text" in line]
    found = {r["column"]: r.reason for r in modelling.select_features(df, "y").collect()}
    assert found["long_text"] == "high cardinality, looks like an identifier" and found["few"] == "constant column" and found["x"] is None


def test_no_text_columns(spark):
    assert explore.cardinality_notes(spark.range(5)).collect() == []
