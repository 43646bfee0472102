"""k-means of many starts and many k at once.

An iteration reads the rows once: every task assigns its rows under every model still moving and gives out a count, a cost and a sum per model and cluster. Models that have settled drop
out. Starting centres are spread (each next one drawn by its squared distance from those before) over a seeded sample of bounded size; all iterations, costs and silhouettes read every row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITERATIONS, TOLERANCE = 100, 1e-4
START_ROWS = 1000


@dataclass(frozen=True)
class Clustering:
    """Centres in the order of their coordinates, how many rows each has, and the sum of squared distances to them."""

    centres: np.ndarray
    sizes: np.ndarray
    cost: float


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.square(x[:, None, :] - centres[None]).sum(axis=2)


def _sums(rows: DataFrame, columns: Sequence[str], models: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """model -> (cluster, [rows, cost, sums…]): one job, at most one row a model and cluster comes back."""
    d = len(columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {m: np.zeros((len(c), d + 2)) for m, c in models.items()}
        for batch in batches:
            x = _matrix(batch)
            for m, centres in models.items():
                far = _distances(x, centres)
                own = far.argmin(axis=1)
                np.add.at(held[m], own, np.column_stack([np.ones(len(x)), far[np.arange(len(x)), own], x]))
        for m, table in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(table), m, np.int32)), pa.array(np.arange(len(table), dtype=np.int32)), *[pa.array(c) for c in table.T]], names)

    names = ["model", "cluster", "n", "cost", *[f"s{i}" for i in range(d)]]
    found = rows.select(*columns).mapInArrow(work, "model int, cluster int, " + ", ".join(f"{c} double" for c in names[2:]))
    out = {m: np.zeros((len(c), d + 2)) for m, c in models.items()}
    for r in found.groupBy("model", "cluster").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect():
        out[r["model"]][r["cluster"]] = list(r)[2:]
    return out


def _starts(sample: np.ndarray, k: int, draw: np.random.Generator) -> np.ndarray:
    centres = sample[draw.integers(len(sample))][None]
    while len(centres) < k:
        far = _distances(sample, centres).min(axis=1)
        if not far.sum():
            return np.concatenate([centres, sample[draw.integers(len(sample), size=k - len(centres))]])
        centres = np.concatenate([centres, sample[draw.choice(len(sample), p=far / far.sum())][None]])
    return centres


def fit(rows: DataFrame, columns: Sequence[str], ks: Sequence[int], starts: int, seed: int = 0) -> dict[int, Clustering]:
    """The cheapest of ``starts`` clusterings for each k; ``rows`` should be settled, as every iteration reads it. Columns hold numbers without nulls."""
    # the smallest hashes: a task sends no more rows than are wanted
    first = rows.select(*columns).orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(START_ROWS)
    sample = np.array(sorted({tuple(r) for r in first.collect()}), float)
    if not len(sample):
        return {}
    place = {i * starts + s: k for i, k in enumerate(ks) for s in range(starts)}
    models = {m: _starts(sample, k, np.random.default_rng([seed, m])) for m, k in place.items()}
    moving = dict(models)
    for _ in range(ITERATIONS):
        if not moving:
            break
        for m, table in _sums(rows, columns, moving).items():
            centres = np.where(table[:, :1] > 0, table[:, 2:] / np.maximum(table[:, :1], 1), moving[m])
            moved = np.square(centres - moving[m]).sum(axis=1).max()
            models[m] = moving[m] = centres
            if moved <= TOLERANCE**2:
                del moving[m]
    done = _sums(rows, columns, models)
    best: dict[int, Clustering] = {}
    for m, k in place.items():
        cost = float(done[m][:, 1].sum())
        if k not in best or cost < best[k].cost:
            order = np.lexsort(models[m].T[::-1])
            best[k] = Clustering(models[m][order], done[m][order, 0], cost)
    return best


def assign(rows: DataFrame, columns: Sequence[str], found: Clustering, name: str = "prediction") -> DataFrame:
    """``rows`` with the number of the nearest centre, the first among equally near ones."""
    far = [F.struct(sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, centre)), F.lit(0.0)).alias("far"), F.lit(i).alias("i")) for i, centre in enumerate(found.centres)]
    return rows.withColumn(name, F.array_min(F.array(*far))["i"])


def silhouettes(rows: DataFrame, columns: Sequence[str], found: dict[int, Clustering]) -> dict[int, float]:
    """Mean silhouette by squared distance of each clustering, for all k in one reading.

    The mean squared distance from a row to a cluster follows from the cluster's rows, mean and mean square.
    """
    clusters = {k: c for k, c in found.items() if (c.sizes > 0).sum() > 1}
    if not clusters:
        return {}
    # means of the final assignment, not the last centres
    tables = _sums(rows, columns, {k: c.centres for k, c in clusters.items()})
    means = {k: t[:, 2:] / np.maximum(t[:, :1], 1) for k, t in tables.items()}
    # mean squared distance within a cluster from its cost, moved from the centre to the mean
    inner = {k: t[:, 1] / np.maximum(t[:, 0], 1) - np.square(means[k] - clusters[k].centres).sum(axis=1) for k, t in tables.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(clusters, 0.0)
        for batch in batches:
            x = _matrix(batch)
            for k, c in clusters.items():
                n = tables[k][:, 0]
                own = _distances(x, c.centres).argmin(axis=1)
                to = _distances(x, means[k]) + inner[k]
                at = np.arange(len(x))
                a = to[at, own] * n[own] / np.maximum(n[own] - 1, 1)
                to[at, own] = np.inf
                to[:, n == 0] = np.inf
                b = to.min(axis=1)
                top = np.maximum(a, b)
                total[k] += np.where((n[own] > 1) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0.0).sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()))], ["k", "total"])

    summed = rows.select(*columns).mapInArrow(work, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()
    return {r["k"]: r["total"] / tables[r["k"]][:, 0].sum() for r in summed}
