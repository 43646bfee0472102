"""Ranks of many columns at once against a plain ranking."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import explore
from tidegauge.plans import ranks


def table(seed, n):
    draw = np.random.default_rng(seed)
    return pd.DataFrame({
        "even": draw.normal(size=n), "tied": draw.integers(0, 4, n).astype(float), "hot": np.where(draw.random(n) < 0.7, 5.0, draw.normal(size=n)), "one": np.full(n, 2.0),
        "holes": np.where(draw.random(n) < 0.3, np.nan, draw.integers(0, 9, n)), "gaps": np.where(draw.random(n) < 0.6, np.nan, draw.normal(size=n)), "none": np.full(n, np.nan),
    })


def frame(spark, data):
    rows = [tuple(None if pd.isna(x) else float(x) for x in r) for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data.columns)).repartition(5)


def test_average_ranks(spark):
    data = table(1, 800)
    holed = ["holes", "gaps", "none"]
    got = ranks.average_ranks(frame(spark, data), list(data.columns), holed).toPandas()
    assert len(got) == len(data)
    want = {i: sorted(data[c].rank().dropna()) for i, c in enumerate(data.columns)}
    for i, c in enumerate(data.columns):
        held = [r for r in got[f"r{i}"] if r is not None]
        assert sorted(r[0] for r in held) == want[i]
        for k, h in enumerate(holed):  # among the rows where h is present too
            both = data[data[c].notna() & data[h].notna()][c].rank()
            present = [r[k + 1] for r, other in zip(got[f"r{i}"], got[f"r{list(data.columns).index(h)}"]) if r is not None and other is not None]
            assert sorted(present) == sorted(both)


def test_spearman_of_every_pair(spark):
    data = table(2, 700)
    found, _ = explore.correlations(frame(spark, data), all_pairs=True)
    got = {(r.column_a, r.column_b): r.coefficient for r in found.where("method = 'spearman'").collect()}
    columns = sorted(c for c in data.columns if c not in ("one", "none"))
    assert set(got) == {(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]}
    for (a, b), r in got.items():
        both = data[[a, b]].dropna()
        assert abs(r - both[a].rank().corr(both[b].rank())) < 1e-9


def test_empty(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert ranks.average_ranks(empty, ["a", "b"]).collect() == []


def test_whole_columns_are_ranked_by_value(spark, monkeypatch):
    from tidegauge.operators import explore
    from tidegauge.plans import skew

    draw = np.random.default_rng(5)
    data = pd.DataFrame({"a": draw.integers(0, 7, 500).astype(float), "b": draw.normal(size=500), "c": [0.0, -0.0] * 250})
    data["d"], data["e"] = data["a"] * 2 + data["b"], np.where(draw.random(500) < 0.5, 3.0, data["b"])
    data["f"] = data["e"].where(draw.random(500) < 0.8)
    df = spark.createDataFrame(data).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in data]).repartition(3)
    pairs = [("a", "b"), ("a", "d"), ("a", "e"), ("b", "e"), ("d", "e"), ("b", "f"), ("e", "f"), ("a", "c")]
    asked = []
    cells = ranks.average_ranks
    monkeypatch.setattr(ranks, "average_ranks", lambda df, columns, holed=(): asked.append(list(columns)) or cells(df, columns, holed))
    for broadcast, looked_up in ((200_000, 8), (10, 8), (10, 0)):
        for module in (skew, ranks, explore):
            monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast)
        monkeypatch.setattr(explore, "LOOKED_UP", looked_up)
        got = explore.rank_correlations(df, pairs)
        for x, y in pairs[:-1]:
            assert got[x, y] == pytest.approx(data[[x, y]].dropna().corr(method="spearman").iloc[0, 1], abs=1e-12)
        assert np.isnan(got["a", "c"])
    # only pairs with holes, or many wide columns, are ranked cell by cell
    assert asked == [["b", "e", "f"], ["b", "e", "f"], ["a", "b", "c", "d", "e"], ["b", "e", "f"]]
