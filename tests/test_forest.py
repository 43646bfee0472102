"""Label dictionary, trees and models against plain computations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import encoding, forest, modelling


def table(seed, n, labels=30):
    draw = np.random.default_rng(seed)
    kind = draw.integers(0, labels, n)
    effect = draw.normal(0, 3, labels)
    x = draw.normal(size=n)
    return pd.DataFrame({"x": np.where(draw.random(n) < 0.1, np.nan, x), "kind": [f"k{k}" if k else None for k in kind], "noise": draw.normal(size=n), "y": effect[kind] + np.where(x > 0.3, 4.0, 0.0) + draw.normal(0, 0.2, n)})


def frame(spark, data):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in data.itertuples(index=False)]
    return spark.createDataFrame(rows, "x double, kind string, noise double, y double").repartition(4)


def encoded(spark, data, folds=3):
    df = frame(spark, data)
    enc = encoding.Encoding(["x", "noise"], ["kind"])
    named = encoding.typed(df.withColumn("label", F.col("y")), enc, "label")
    return encoding.encode(modelling.with_folds(named, folds), enc, folds)


def test_label_means_come_from_other_rows(spark):
    data = table(1, 400)
    e = encoded(spark, data)
    held = e.rows.toPandas()
    held["own"] = held["c0"]
    assert held["c0"].nunique() == 30 and set(held["c0"]) == set(map(float, range(30)))
    for fit in (0, 3):
        got = encoding.tree_rows(e, [fit]).toPandas().set_index("row")
        train = held[held.fold != fit]
        prior, middle = train.label.mean(), train.n0.median()
        for r in held.itertuples():
            others = train[(train.c0 == r.c0) & (train.fold != r.fold)]
            x = got.loc[r.row, "x"]
            assert x[0] == pytest.approx(middle if np.isnan(r.n0) else r.n0)
            assert x[2] == pytest.approx((others.label.sum() + 10 * prior) / (len(others) + 10))
            assert got.loc[r.row, "train"] == (r.fold != fit)


def test_one_hot_rows(spark):
    e = encoded(spark, table(2, 300))
    train, test, widths = encoding.one_hot(e, 1)
    assert widths[0] == ("x", 1) and widths[2][0] == "kind" and widths[2][1] <= 31
    assert train.count() + test.count() == 300 and {r.features.size for r in train.collect()} == {sum(w for _, w in widths)}
    assert all(r.features.toArray()[2:].sum() == 1 for r in test.collect())


def best_cut(x, y):
    """Feature and cut of the largest fall in squared error, by trying all."""
    found = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values[:-1], values[1:]):
            left = x[:, f] <= (a + b) / 2
            found.append((round(((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum(), 9), f, (a + b) / 2))
    return min(found)


def grow_by_hand(x, y, asked, depth):
    """A tree without bootstrap that tries every cut."""
    if depth == 0 or len(np.unique(y)) == 1 or all(len(np.unique(c)) == 1 for c in x.T):
        return np.full(len(asked), y.mean())
    error, f, cut = best_cut(x, y)
    left, out = x[:, f] <= cut, np.zeros(len(asked))
    out[asked[:, f] <= cut] = grow_by_hand(x[left], y[left], asked[asked[:, f] <= cut], depth - 1)
    out[asked[:, f] > cut] = grow_by_hand(x[~left], y[~left], asked[asked[:, f] > cut], depth - 1)
    return out


@pytest.mark.parametrize("depth,features", [(1, 3), (3, 3), (30, 1)])  # down to pairs of rows, features tie
def test_tree_equals_trying_every_cut(depth, features):
    draw = np.random.default_rng(depth)
    x, y = np.round(draw.normal(size=(120, features)), 1), np.round(draw.normal(size=120), 3)
    grower = forest.Grower(x, y[:, None], features, depth)
    weight = np.r_[np.ones(80), np.zeros(40)]
    got, gains = grower.tree(weight, weight == 0, np.random.default_rng(0))
    assert got[:, 0] == pytest.approx(grow_by_hand(x[:80], y[:80], x[80:], depth))
    assert (gains >= 0).all() and gains.sum() > 0


@pytest.mark.parametrize("classes", [0, 2, 4])
@pytest.mark.parametrize("held,counted", [(2000, 40), (100, 1 << 16), (100, 3)])
def test_columns_in_files_give_the_same_trees(monkeypatch, classes, held, counted):
    """Labels whose sums are exact, so that no tie is broken by rounding; chunks end within runs of equal values."""
    draw = np.random.default_rng(classes)
    n = 1500
    x = np.column_stack([draw.permutation(n), draw.integers(0, 5, n), np.where(draw.random(n) < 0.1, np.nan, np.round(draw.normal(size=n), 1)), np.zeros(n)])
    y = draw.integers(0, classes, n).astype(float) if classes else np.round((x[:, 1] + draw.normal(size=n)) * 64) / 64
    train = draw.random(n) < 0.8
    weight = np.where(train, forest.bootstrap(np.arange(n), 0, 1), 0)
    want, gains = forest.Grower(x, forest._targets(y, classes), 4, 12).tree(weight, ~train, np.random.default_rng(0))
    for name, value in (("HELD_CELLS", held), ("COUNTED", counted), ("CHUNK", 61), ("SUMMED_CELLS", 20)):
        monkeypatch.setattr(forest, name, value)
    stored = forest.Stored(iter(np.ascontiguousarray(x.T)), y, classes, 4, 12)
    got, found = stored.tree(weight.astype(np.uint8), ~train, np.random.default_rng(0))
    assert got == pytest.approx(want, abs=1e-12) and found == pytest.approx(gains)
    again, _ = stored.tree(weight.astype(np.uint8), ~train, np.random.default_rng(0))
    assert (again == got).all()


def test_a_batch_of_trees_holds_few_bytes_a_row():
    import tracemalloc

    import pyarrow as pa

    n, part, draw = 600_000, 10_000, np.random.default_rng(8)

    def batches():
        for at in draw.permutation(range(0, n, part)):
            rows = np.arange(at, at + part)
            x = np.column_stack([rows, draw.integers(0, 320, part), draw.integers(0, 50, part), draw.random(part), rows % 7]).astype(float)
            lists = pa.ListArray.from_arrays(np.arange(part + 1, dtype=np.int32) * 5, x.ravel())
            yield pa.RecordBatch.from_pydict({"fit": pa.array(np.zeros(part, np.int32)), "batch": pa.array(np.zeros(part, np.int32)), "row": rows, "train": pa.array(rows % 5 != 0), "label": x[:, 4] + x[:, 2], "x": lists})

    tracemalloc.start()
    answers = list(forest._batch(batches(), forest.Plan(trees=1, depth=8, batches=1)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(a.num_rows for a in answers) == n // 5 + 1
    assert peak < 100 * n  # it was 171


def test_bootstrap_is_poisson():
    w = forest.bootstrap(np.arange(200_000), 3, 5)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and (w == forest.bootstrap(np.arange(200_000), 3, 5)).all()


@pytest.mark.parametrize("task_rows", [1 << 18, 60])
def test_forest_predicts_held_out_rows(spark, task_rows):
    """The same job with trees grown whole in tasks, and with their upper levels counted by Spark."""
    data = table(4, 600, 8)
    e = encoded(spark, data)
    rows = encoding.tree_rows(e, [0, 1, 2])
    values, gains = forest.forest(rows, [0, 1, 2], forest.Plan(trees=12, depth=12, task_rows=task_rows))
    got = values.join(e.rows.select("row", "label"), "row").toPandas()
    assert len(got) == 600
    error = np.sqrt(np.mean([(v[0] - y) ** 2 for v, y in zip(got.value, got.label)]))
    assert error < 0.35 * data.y.std()
    shares = gains.toPandas().pivot(index="fit", columns="feature", values="importance")
    assert shares.sum(axis=1).tolist() == pytest.approx([1, 1, 1]) and (shares[1] < 0.1).all()


def test_a_large_table_of_few_columns_grows_whole_in_tasks(spark, monkeypatch):
    """Rows beyond 2^18 with one feature; cuts lie between the values that training holds."""
    monkeypatch.setattr(forest, "_grown_apart", None)
    turn = F.col("id") % 7
    rows = spark.range(0, 280_000, 1, 4).select(
        F.lit(3).alias("fit"), F.col("id").alias("row"), (F.col("id") % 5 != 0).alias("train"), F.when(turn > 3, 5.0).otherwise(-5.0).alias("label"),
        F.array(F.when(F.col("id") % 5 != 0, turn.cast("double")).otherwise(turn + 0.4)).alias("x"),
    )
    values, gains = forest.forest(rows, [3], forest.Plan(trees=3, depth=2, batches=3))
    seen = values.join(rows.select("row", "label"), "row").groupBy((F.col("value")[0] - F.col("label")).alias("off"), "label").count()
    assert {(r["off"], r["label"]): r["count"] for r in seen.collect()} == {(0.0, 5.0): 24_000, (0.0, -5.0): 32_000}
    assert [tuple(r) for r in gains.collect()] == [(3, 0, 1.0)]


def test_batches_of_trees_are_tasks_of_their_own(spark):
    from pyspark import TaskContext

    found = []
    whole = forest._batch
    try:
        # the worker's partition stands in for the number of trees
        def told(group, plan):
            list(group)
            yield from forest._answer(0, np.zeros(0, np.int64), np.zeros((0, 1)), TaskContext.get().partitionId(), np.zeros(1))

        forest._batch = told
        rows = spark.range(400).select(F.explode(F.array(F.lit(0), F.lit(2))).alias("fit"), F.col("id").alias("row"), F.lit(True).alias("train"), F.lit(1.0).alias("label"), F.array(F.lit(1.0)).alias("x"))
        held = forest.settle
        forest.settle = lambda df: found.append(df) or held(df)
        forest.forest(rows, [0, 2], forest.Plan(trees=10))
    finally:
        forest._batch, forest.settle = whole, held
    places = [r["trees"] for r in found[0].collect()]
    assert len(places) == 20 == len(set(places))


def test_forest_does_not_hang_on_the_dealing(spark):
    e = encoded(spark, table(5, 200))
    rows = encoding.tree_rows(e, [0])
    plan = forest.Plan(trees=4, depth=6)
    one, two = ({r.row: round(r.value[0], 9) for r in forest.forest(d, [0], plan)[0].collect()} for d in (rows.repartition(1), rows.repartition(7, "row")))
    assert one == two


def test_classes(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(500, 2))
    label = np.where(x[:, 0] > 0.5, "a", np.where(x[:, 1] > 0, "b", "c"))
    df = spark.createDataFrame([(float(a), float(b), str(c)) for (a, b), c in zip(x, label)], "x double, z double, y string")
    outcome = modelling.predict(df, "y", config=modelling.Config(trees=10, depth=8, splits=3))
    scores = {r.model: r.score for r in outcome.scores.collect()}
    assert outcome.status == "answered" and outcome.winner == "random_forest" and scores["random_forest"] > 0.9 > scores["majority_class"]
    assert {r.column for r in outcome.associations.collect()} == {"x", "z"}


def test_many_labels_keep_their_columns_apart(spark):
    draw = np.random.default_rng(7)
    rows = [(f"u{draw.integers(0, 1500)}", f"v{i % 3}", float(i % 3) + draw.normal(0, 0.05)) for i in range(2000)]
    outcome = modelling.predict(spark.createDataFrame(rows, "u string, v string, y double"), "y", config=modelling.Config(trees=6, depth=8, splits=2))
    assert outcome.status == "answered" and outcome.associations.first()["column"] == "v"
    assert {r.column for r in outcome.associations.collect()} == {"u", "v"}
