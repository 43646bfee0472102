"""Quantiles by narrowing histograms against numpy."""

import math

import numpy as np
import pytest

from tidegauge.plans import select


def columns(seed, n):
    draw = np.random.default_rng(seed)
    return {
        "even": draw.uniform(-5, 5, n), "wild": draw.standard_cauchy(n) * 10.0 ** draw.integers(-200, 200, n), "few": draw.integers(0, 3, n).astype(float), "one": np.full(n, -0.25),
        "holes": np.where(draw.random(n) < 0.4, np.nan, draw.normal(1e9, 1e-3, n)), "tied": np.where(draw.random(n) < 0.6, 7.0, draw.normal(0, 1, n)), "tiny": draw.uniform(0, 5e-324 * 1000, n),
    }


@pytest.mark.parametrize("n,few,buckets", [(3000, 1 << 15, 2048), (900, 50, 256)])
def test_equal_numpy(spark, n, few, buckets):
    data = columns(n, n)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    rows = [tuple(None if math.isnan(x) else float(x) for x in row) for row in zip(*data.values())]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(4)
    got = {r["column"]: [r[f"q{i}"] for i in range(len(probs))] for r in select.quantiles(frame, list(data), probs, few=few, buckets=buckets).collect()}
    for c, x in data.items():
        held = np.sort(x[~np.isnan(x)])
        for p, value in zip(probs, got[c]):
            at = p * (len(held) - 1)
            low, high, w = held[math.floor(at)], held[math.ceil(at)], at - math.floor(at)
            assert value == (low if low == high else low + (high - low) * w), (c, p)


def test_groups_extremes_and_empty(spark):
    frame = spark.createDataFrame([(0, 1.0, None), (0, float("inf"), None), (0, -float("inf"), float("nan")), (1, 4.0, None), (1, 5.0, None)], "g int, x double, y double")
    got = {(r.g, r.column): r.median for r in select.medians(frame, ["x", "y"], ["g"]).collect()}
    assert got == {(0, "x"): 1.0, (1, "x"): 4.5}
    assert select.quantiles(frame.limit(0), ["x"], [0.5]).collect() == [] and select.quantiles(frame, [], [0.5]).collect() == []


def test_no_row_is_moved(spark):
    frame = spark.range(0, 200_000, 1, 4).selectExpr("id * 1.0 AS a", "id % 7 * 1.0 AS b")
    text = select.quantiles(frame, ["a", "b"], [0.5])._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text
