"""Labelled corruptions: each must be found, and only it."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import repair, validate
from tidegauge.operators.profile import profile, sanity_floors
from tidegauge.operators.validate import FAILED, NOT_APPLICABLE, Arrival, Rules

CITIES = ["Oslo", "Rome", "Lima", "Kyiv"]


@pytest.fixture(scope="module")
def clean(spark):
    rows = [(i, 10.0 + i * 990 / 299, CITIES[i % 4]) for i in range(300)]
    return spark.createDataFrame(rows, "id long, amount double, city string").repartition(5)


@pytest.fixture(scope="module")
def baseline(clean):
    return profile(clean)


def failed(df, baseline, **kw):
    return {r["rule_id"] for r in validate.failures(validate.evaluate(df, baseline, **kw)).collect()}


def test_clean_batch_passes(clean, baseline):
    assert failed(clean, baseline) == set()


def test_rename(clean, baseline):
    df = clean.withColumnRenamed("city", "town")
    assert failed(df, baseline) == {"schema_conformance:missing_column:city", "schema_conformance:unexpected_column:town"}
    groups = repair.correlate(validate.evaluate(df, baseline), baseline, df)
    assert groups.where(F.col("correlation_rule") == repair.RENAME_PAIR).count() == 2


def test_drop_with_an_unrelated_new_column_is_no_rename(clean, baseline):
    df = clean.drop("city").withColumn("flag", F.lit(1))
    groups = repair.correlate(validate.evaluate(df, baseline), baseline, df)
    assert groups.where(F.col("correlation_rule").isNotNull()).count() == 0


def test_nulls(clean, baseline):
    df = clean.withColumn("amount", F.when(F.col("id") % 10 < 7, F.col("amount")))
    assert "null_threshold:amount" in failed(df, baseline)
    few = clean.withColumn("amount", F.when(F.col("id") % 30 != 0, F.col("amount")))
    assert "null_threshold:amount" not in failed(few, baseline)


@pytest.mark.parametrize("test", ["psi", "ks"])
def test_shift(clean, baseline, test):
    df = clean.withColumn("amount", F.col("amount") * 5)
    assert "distribution_drift:amount" in failed(df, baseline, rules=Rules(drift_test=test))


def test_whitespace_and_case(clean, baseline):
    df = clean.withColumn("city", F.when(F.col("id") % 2 == 0, F.upper("city")).otherwise(F.concat(F.lit("\t"), F.col("city"))))
    assert failed(df, baseline) == {"categorical_drift:city"}
    new = clean.withColumn("city", F.when(F.col("id") == 0, "Paris").otherwise(F.col("city")))
    assert failed(new, baseline) == set()


def test_row_loss(clean, baseline):
    assert "schema_conformance:row_count_drop" in failed(clean.where("id % 10 < 6"), baseline)


def test_type_change_is_folded_into_the_nulls_that_caused_it(spark, clean):
    before = profile(clean.withColumn("amount", F.col("amount").cast("int")))
    df = clean.withColumn("amount", F.when(F.col("id") % 10 < 5, F.col("amount")))
    assert "schema_conformance:dtype_mismatch:amount" not in failed(df, before)
    detail = validate.evaluate(df, before).where("rule_id = 'null_threshold:amount'").first()["detail"]
    assert detail["dtype_change_actual"] == "double"


def test_nan_counts_as_null(spark, clean, baseline):
    df = clean.withColumn("amount", F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(F.col("amount")))
    assert "null_threshold:amount" in failed(df, baseline)


def test_identifier_is_excluded_and_says_so(spark):
    df = spark.createDataFrame([(f"u{i}", "x" if i % 2 else "y") for i in range(40)], "uid string, status string")
    found = profile(df)
    assert [r["column"] for r in found.excluded.collect()] == ["uid"]
    outcomes = validate.evaluate(df, found).where("column = 'uid'").collect()
    assert len(outcomes) == 5 and {r["status"] for r in outcomes} == {NOT_APPLICABLE}


def test_pathological_baseline_is_named(spark):
    df = spark.createDataFrame([(1.0 if i < 2 else None, 3.0) for i in range(100)], "a double, b double")
    assert {r["column"] for r in sanity_floors(profile(df)).collect()} == {"a", "b"}


def test_encoding_rules(clean, baseline):
    arrival = Arrival("ascii", 0.3, "utf-8")
    found = {r["rule_id"]: r["status"] for r in validate.evaluate(clean, baseline, arrival=arrival).where("column is null").collect()}
    assert found["low_confidence_encoding:ascii"] == FAILED
    assert found["encoding_fallback_overruled:ascii->utf-8"] == "passed"


def test_sample_and_profile_do_not_depend_on_partitioning(clean):
    samples = [sorted(r["value"] for r in profile(clean.repartition(n)).sample.where("column = 'amount'").collect()) for n in (1, 6)]
    assert samples[0] == samples[1]


# -- repair ------------------------------------------------------------------------------------------

def test_cast_refuses_a_lost_value(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    with pytest.raises(repair.FixRefused):
        repair.safe_type_cast(df, "v", "int")


def test_fix_is_kept_only_when_its_rule_stops_failing(clean, baseline):
    df = clean.withColumn("city", F.lower("city"))
    wrong = repair.attempt(df, ["categorical_drift:city"], repair.STRIP, {"column": "city"}, baseline)
    assert not wrong.verified and wrong.data is df and wrong.unresolved == ["categorical_drift:city"]
    right = repair.attempt(df, ["categorical_drift:city"], repair.CASE, {"column": "city"}, baseline)
    assert right.verified and {r["city"] for r in right.data.select("city").distinct().collect()} == set(CITIES)


def test_a_fix_may_reveal_a_failure_without_causing_it(clean, baseline):
    df = clean.withColumnRenamed("amount", "sum").withColumn("sum", F.col("sum") * 5)
    targeted = ["schema_conformance:missing_column:amount", "schema_conformance:unexpected_column:sum"]
    done = repair.attempt(df, targeted, repair.RENAME, {"current_name": "sum", "target_name": "amount"}, baseline)
    assert done.verified and [r["rule_id"] for r in done.revealed.collect()] == ["distribution_drift:amount"]


def test_gate_gives_every_reason(spark):
    groups = spark.createDataFrame([(0, None, "null_threshold:a", "a", {"x": "y"})], repair.GROUP)
    proposals = spark.createDataFrame([(0, repair.CAST, "high", 0.8)], "group_id int, action string, risk_level string, confidence double")
    row = repair.gate(groups, proposals).first()
    assert row["decision"] == "escalate" and len(row["reasons"]) == 3


def test_replay_names_the_broken_entry(clean, baseline):
    with pytest.raises(ValueError, match="replay failed"):
        repair.replay(clean, [{"action": repair.RENAME, "spec": {"current_name": "nope", "target_name": "x"}}], baseline)
