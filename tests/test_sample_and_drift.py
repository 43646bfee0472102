"""The seeded sample and the Kolmogorov-Smirnov score against plain computations."""

import numpy as np

from tidegauge.operators import profile, validate


def frame(spark, data, parts):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values())]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(parts)


def table(seed, n, shift=0.0):
    draw = np.random.default_rng(seed)
    return {"even": draw.normal(shift, 1, n), "tied": draw.integers(0, 5, n) + shift, "holes": np.where(draw.random(n) < 0.6, np.nan, draw.normal(shift, 2, n)), "none": np.full(n, np.nan)}


def test_sample_does_not_hang_on_the_partitioning(spark):
    data = table(1, 3000)
    one, two = ({c: sorted(r.value for r in got if r["column"] == c) for c in data} for got in (profile.seeded_sample(frame(spark, data, p), list(data), 500, 3).collect() for p in (1, 6)))
    assert one == two and {c: len(v) for c, v in one.items()} == {"even": 500, "tied": 500, "holes": 500, "none": 0}
    held = set(data["even"])
    assert set(one["even"]) <= held and abs(np.mean(one["even"]) - np.mean(data["even"])) < 0.2
    other = sorted(r.value for r in profile.seeded_sample(frame(spark, data, 2), ["even"], 500, 4).collect())
    assert other != one["even"]


def test_small_columns_are_whole(spark):
    data = table(2, 40)
    got = profile.seeded_sample(frame(spark, data, 3), ["tied"], 100).collect()
    assert sorted(r.value for r in got) == sorted(data["tied"])


def test_ks_equals_the_largest_gap_of_both_shares(spark):
    before, after = table(3, 4000), table(4, 2500, 0.3)
    after["tied"] = np.where(after["tied"] > 3, 9.0, np.floor(after["tied"]))
    baseline = profile.profile(frame(spark, before, 4))
    sample = {c: np.sort([r.value for r in baseline.sample.collect() if r["column"] == c]) for c in ("even", "tied", "holes")}
    got = {r["column"]: r.score for r in validate.ks_scores(frame(spark, after, 3), baseline, list(sample)).collect()}
    for c, s in sample.items():
        assert len(s) == 1000
        now = np.sort(after[c][~np.isnan(after[c])])
        at = np.concatenate([s, now])
        gaps = [abs(np.searchsorted(s, x, side) / len(s) - np.searchsorted(now, x, side) / len(now)) for x in at for side in ("left", "right")]
        assert abs(got[c] - max(gaps)) < 1e-12, c
