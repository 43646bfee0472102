"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Each text becomes a few statistics (shares of character kinds, repetition, lengths). Random cosines of the standardised statistics
approximate a Gaussian kernel; the normal equations are summed per task, then per slot, so that a bounded number of matrices reaches the driver,
whatever the number of rows. All labelled training rows are used. Two folds give scores of rows that a model has not seen; isotonic regression over bins
of these turns scores into probabilities.

A null or empty text has statistics of zero and gets a score like any other; without labels of both kinds every text gets the share of good
labels (0.5 if there are none); null ids are never training rows; repeated rows are scored as they come; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import batches as B
from tidegauge.llm import calibrate
from tidegauge.session import settle

COSINES = 256
RIDGE = 1e-3
SLOTS = 16
BINS = 2000
CLIP = 4.0
SEED = 20240607

_KINDS = 16
_KIND = np.zeros(256, np.int64)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[128:] = 4
_KIND[[9, 11, 12, 13, 32]] = 5
_KIND[10] = 6
for _at, _chars in ((7, ".?"), (8, ",;:"), (9, "!"), (10, "|"), (11, "#$%&*@^~+=<>\\/_"), (12, "\"'`"), (13, "()[]{}"), (14, "-")):
    for _c in _chars:
        _KIND[ord(_c)] = _at
STATISTICS = _KINDS + 8


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes per row."""
    both = B.mix(hashes ^ (rows.astype(B.U) * B.U(0x9E3779B97F4A7C15)))
    _, first = np.unique(both, return_index=True)
    return np.bincount(rows[first], minlength=n)


def statistics(offsets: np.ndarray, data: np.ndarray, first: int, last: int) -> np.ndarray:
    """One row of statistics per text."""
    n = last - first
    sizes = np.diff(offsets[first : last + 1]).astype(float)
    kinds = np.zeros((n, _KINDS))
    for low in range(int(offsets[first]), int(offsets[last]), B.GROUP):
        part = data[low : min(low + B.GROUP, int(offsets[last]))]
        row = np.searchsorted(offsets[first : last + 1], np.arange(low, low + len(part)), "right") - 1
        kinds += np.bincount(row * _KINDS + _KIND[part], minlength=n * _KINDS).reshape(n, _KINDS)
    rows, words = B.words(offsets, data, first, last, B.NON_SPACE)
    count = B.per_row(rows, n)
    grams, whole = B.grams(rows, words, 3)
    of = rows[: len(grams)][whole]
    safe, some = np.maximum(sizes, 1), np.maximum(count, 1)
    letters = np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    marks = kinds[:, 9] + kinds[:, 10] + kinds[:, 11]
    more = np.column_stack([
        np.log1p(sizes), np.log1p(count), kinds[:, 2] / letters, (sizes - kinds[:, 5] - kinds[:, 6]) / some, _distinct(rows, words, n) / some,
        _distinct(of, grams[whole], n) / np.maximum(np.bincount(of, minlength=n), 1), count / np.maximum(kinds[:, 7], 1) / 50.0, marks / some,
    ])
    return np.column_stack([kinds / safe[:, None], more])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) for every row."""

    def work(batch: pa.RecordBatch):
        offsets, data = B.texts(batch.column(1))
        for first, last in B.groups(offsets):
            stats = statistics(offsets, data, first, last)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), B.lists(stats.ravel(), np.full(last - first, STATISTICS))], ["id", "stats"])

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return B.over_text(source, "text", f"id {source.schema['id'].dataType.simpleString()}, stats array<double>", work)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Cosines:
    """Random Fourier features of standardised statistics, with a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, n: int = COSINES, seed: int = SEED) -> None:
        draw = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, np.inf)
        self.weights, self.shift = draw.normal(size=(len(mean), n)) / np.sqrt(len(mean)), draw.uniform(0, 2 * np.pi, n)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        out = np.empty((len(x), len(self.shift) + 1))
        out[:, :-1] = np.sqrt(2 / len(self.shift)) * np.cos(x @ self.weights + self.shift)
        out[:, -1] = 1.0
        return out


def _normal_equations(rows: DataFrame, cosines: Cosines) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fold, the sums of z z' and z y over (stats, label, fold)."""
    size = len(cosines.shift) + 1

    def partial(batches):
        sums = np.zeros((2, size, size + 1))
        seen = False
        for batch in batches:
            seen = True
            label, fold = batch.column("label").to_numpy().astype(float), batch.column("fold").to_numpy()
            for low in range(0, batch.num_rows, 8192):
                z = cosines(_matrix(batch.column("stats").slice(low, 8192)))
                for f in (0, 1):
                    here = fold[low : low + 8192] == f
                    sums[f] += z[here].T @ np.column_stack([z[here], label[low : low + 8192][here]])
        if seen:
            slot = TaskContext.get().partitionId() % SLOTS  # a task that runs again adds to the same slot
            yield pa.RecordBatch.from_arrays([pa.array([slot] * 2, pa.int32()), pa.array([0, 1], pa.int32()), pa.array([sums[0].tobytes(), sums[1].tobytes()], pa.binary())], ["slot", "fold", "sums"])

    def total(batches):
        sums = np.zeros((2, size, size + 1))
        for batch in batches:
            for f, held in zip(batch.column("fold").to_pylist(), batch.column("sums").to_pylist()):
                sums[f] += np.frombuffer(held).reshape(size, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array([0, 0], pa.int32()), pa.array([0, 1], pa.int32()), pa.array([sums[0].tobytes(), sums[1].tobytes()], pa.binary())], ["slot", "fold", "sums"])

    schema = "slot int, fold int, sums binary"
    summed = rows.mapInArrow(partial, schema).repartition(SLOTS, "slot").mapInArrow(total, schema)
    out = {0: np.zeros((size, size + 1)), 1: np.zeros((size, size + 1))}
    for row in summed.collect():  # two matrices a slot
        out[row["fold"]] += np.frombuffer(bytes(row["sums"])).reshape(size, size + 1)
    return {f: (m[:, :-1], m[:, -1]) for f, m in out.items()}


def _solve(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.linalg.solve(gram + RIDGE * max(gram[-1, -1], 1.0) * np.eye(len(gram)), target)


def train(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> dict:
    """A model from measured rows and (id, label 0 or 1)."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    rows = settle(measured.join(known, "id").withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(2)).cast("int")))
    each = [F.get("stats", F.lit(i)) for i in range(STATISTICS)]
    first = rows.agg(F.count("*").alias("n"), F.avg("label").alias("p"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(each)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(each)]).head()
    if not first["n"] or first["p"] in (0.0, 1.0):
        return {"prior": 0.5 if not first["n"] else float(first["p"])}
    cosines = Cosines(np.array([first[f"m{i}"] for i in range(STATISTICS)]), np.array([first[f"s{i}"] for i in range(STATISTICS)]))
    sums = _normal_equations(rows, cosines)
    # a fold's rows are scored by the model of the other fold
    folds = [_solve(*sums[1 - f]) for f in (0, 1)]

    def unseen(batches):
        for batch in batches:
            z, fold = cosines(_matrix(batch.column("stats"))), batch.column("fold").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.where(fold == 0, z @ folds[0], z @ folds[1])), batch.column("label")], ["raw", "label"])

    place = F.floor((F.least(F.greatest(F.col("raw"), F.lit(-1.0)), F.lit(2.0)) + 1.0) * (BINS / 3))
    binned = rows.select("stats", "fold", F.col("label").cast("double").alias("label")).mapInArrow(unseen, "raw double, label double").groupBy(place.alias("bin")).agg(
        F.avg("raw").alias("raw"), F.count("*").alias("n"), F.sum("label").alias("p"),
    ).toPandas()  # at most BINS + 1 rows
    both = tuple(sums[0][i] + sums[1][i] for i in (0, 1))
    knots = calibrate.isotonic(binned["raw"].to_numpy(), binned["n"].to_numpy(float), binned["p"].to_numpy())
    return {"prior": float(first["p"]), "cosines": cosines, "weights": _solve(*both), "knots": knots}


def score(measured: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """(id, score) for every measured row."""

    def work(batch: pa.RecordBatch):
        if "knots" in model:
            scores = calibrate.apply(model["knots"], model["cosines"](_matrix(batch.column("stats"))) @ model["weights"])
        else:
            scores = np.full(batch.num_rows, model["prior"])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores)], ["id", "score"])

    kind = measured.schema["id"].dataType.simpleString()
    return B.over_text(measured, "stats", f"id {kind}, score double", work).withColumnRenamed("id", id_col)
