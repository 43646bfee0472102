"""Clusterings of many starts against plain computations."""

import numpy as np
import pytest

from tidegauge.operators import kmeans


def planted(seed, n=600):
    draw = np.random.default_rng(seed)
    centres = np.array([[0, 0], [10, 0], [0, 10], [10, 10.0]])
    own = draw.integers(0, 4, n)
    return centres[own] + draw.normal(0, 0.5, (n, 2)), own


def frame(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double").repartition(5)


def silhouette_by_hand(x, own):
    far = np.square(x[:, None] - x[None]).sum(axis=2)
    out = []
    for i in range(len(x)):
        inside = (own == own[i]) & (np.arange(len(x)) != i)
        if not inside.any():
            out.append(0.0)
            continue
        a, b = far[i][inside].mean(), min(far[i][own == c].mean() for c in set(own) - {own[i]})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def test_planted_clusters(spark):
    x, own = planted(1)
    rows = frame(spark, x)
    found = kmeans.fit(rows, ["a", "b"], [2, 3, 4, 5], 6, 7)
    four = found[4]
    assert sorted(four.sizes.tolist()) == sorted(np.bincount(own).tolist())
    means = np.array([x[own == c].mean(axis=0) for c in range(4)])
    assert four.cost == pytest.approx(sum(np.square(x[own == c] - means[c]).sum() for c in range(4)))
    assert found[2].cost > found[3].cost > four.cost > found[5].cost
    scores = kmeans.silhouettes(rows, ["a", "b"], found)
    assert max(scores, key=scores.get) == 4
    labelled = kmeans.assign(rows, ["a", "b"], four).toPandas()
    points, group = labelled[["a", "b"]].to_numpy(), labelled["prediction"].to_numpy()
    assert scores[4] == pytest.approx(silhouette_by_hand(points, group))
    two = kmeans.assign(rows, ["a", "b"], found[2]).toPandas()
    assert scores[2] == pytest.approx(silhouette_by_hand(two[["a", "b"]].to_numpy(), two["prediction"].to_numpy()))


def test_equal_rows_and_empty(spark):
    same = frame(spark, np.ones((30, 2)))
    found = kmeans.fit(same, ["a", "b"], [2], 3)
    assert found[2].cost == 0 and found[2].sizes.sum() == 30 and kmeans.silhouettes(same, ["a", "b"], found) == {}
    assert kmeans.fit(same.limit(0), ["a", "b"], [2], 3) == {}
