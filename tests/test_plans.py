"""Order, ranks, quantiles and joins give the same answer for any partitioning."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.functions.pvalues import correlation_p, k_squared
from tidegauge.plans import order, skew, stats


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(3)
    # a third of the rows share one value
    values = np.where(rng.random(900) < 0.34, 7.0, rng.integers(0, 50, 900).astype(float))
    return pd.DataFrame({"k": np.arange(900), "g": rng.choice(["a", "b", None], 900), "v": values})


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_global_index_and_running_total(spark, numbers, parts):
    df = spark.createDataFrame(numbers).repartition(parts)
    got = order.running_totals(df, [F.desc("v"), F.asc("k")], {"v": "cum"}, block_rows=50).toPandas().sort_values("idx")
    want = numbers.sort_values(["v", "k"], ascending=[False, True])
    assert got["idx"].tolist() == list(range(900))
    assert got["k"].tolist() == want["k"].tolist()
    assert np.allclose(got["cum"], want["v"].cumsum())


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_index_within_groups_counts_nulls_as_a_group(spark, numbers, parts):
    df = spark.createDataFrame(numbers).repartition(parts)
    got = order.global_index(df, [F.asc("v"), F.asc("k")], by=["g"]).toPandas()
    for _, part in got.groupby(got["g"].fillna("-")):
        part = part.sort_values("idx")
        assert part["idx"].tolist() == list(range(len(part)))
        assert part[["v", "k"]].values.tolist() == part.sort_values(["v", "k"])[["v", "k"]].values.tolist()


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_quantiles_equal_numpy(spark, numbers, parts):
    df = spark.createDataFrame(numbers).repartition(parts)
    got = order.quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    assert list(got) == pytest.approx(np.quantile(numbers["v"], [0, 0.25, 0.5, 0.9, 1]).tolist())
    by = {r["g"]: r["q0"] for r in order.quantiles(df, "v", [0.5], by=["g"]).collect()}
    assert by["a"] == pytest.approx(numbers[numbers.g == "a"]["v"].median())


def test_average_ranks(spark, numbers):
    counts = stats.number_counts(spark.createDataFrame(numbers), ["v"])
    got = {r["value"]: r["rank"] for r in order.cumulative_counts(counts).withColumn("rank", order.average_rank()).collect()}
    want = numbers["v"].rank(method="average")
    assert all(got[v] == pytest.approx(r) for v, r in zip(numbers["v"], want))


@pytest.mark.parametrize("block", [10, 64, 1000])
def test_earlier_rows_across_blocks(spark, numbers, block):
    df = spark.createDataFrame(numbers).repartition(7)
    got = order.with_earlier(df, [F.asc("k")], "v", [1, 30], block_rows=block).toPandas().sort_values("k")
    for lag in (1, 30):
        assert np.allclose(got[f"lag_{lag}"].to_numpy(dtype=float), numbers["v"].shift(lag), equal_nan=True)


def test_hot_key_is_salted_and_nothing_is_lost(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"))
    lookup = df.groupBy("k").agg(F.count("*").alias("n")).withColumn("label", F.concat(F.lit("x"), F.col("k")))
    joined = skew.salted_lookup(df, "k", lookup, "n")
    assert joined.count() == 3000
    assert joined.where(F.col("label") != F.concat(F.lit("x"), F.col("k"))).count() == 0


def test_histogram_closes_last_bin_and_widens_constants(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(11)], "x double, c double")
    rows = {(r["column"], r["bin"]): r for r in stats.histogram(df, ["x", "c"], 10).collect()}
    want, edges = np.histogram(range(11), bins=10)
    assert [rows["x", i]["n"] for i in range(10)] == want.tolist()
    assert [rows["x", i]["low_edge"] for i in range(10)] == pytest.approx(edges[:-1].tolist())
    want, edges = np.histogram([5.0] * 11, bins=10)
    assert [rows["c", i]["n"] for i in range(10)] == want.tolist()


def test_rank_filter_runs_before_the_shuffle(spark, capsys):
    df = spark.range(100).select(F.col("id").cast("string").alias("t"))
    stats.top_values(stats.text_counts(df, ["t"])).explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") == 2


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (1.0, 3.0, 2.0), (1.0, 5.0, None)], "c double, x double, y double")
    row = df.agg(stats.correlation("c", "x").alias("a"), stats.correlation("x", "y").alias("b")).first()
    assert row["a"] is None and row["b"] == pytest.approx(1.0)


def test_p_values():
    # against the t density integrated numerically
    freedom, t = 28, 0.5 * np.sqrt(28 / 0.75)
    x = np.linspace(t, 400, 2_000_001)
    density = np.exp(math.lgamma(14.5) - math.lgamma(14)) / np.sqrt(freedom * np.pi) * (1 + x * x / freedom) ** -14.5
    assert correlation_p(0.5, 30) == pytest.approx(2 * np.trapezoid(density, x), rel=1e-4)
    assert correlation_p(0.0, 30) == pytest.approx(1.0)
    assert correlation_p(1.0, 30) == 0.0
    statistic, p = k_squared(0.0, 0.0, 1000)
    assert p > 0.8
    assert k_squared(2.0, 6.0, 1000)[1] < 1e-10
