"""Average ranks of many columns at once, also among the rows where another column is present.

Every present cell becomes one row (column, value, row, which columns with holes are present), dealt by range and sorted once for all columns. Inside a partition ranks
are running sums over runs of equal values; where a run reaches over partitions, or a column does, the driver adds what lies before and behind from
one summary row a partition and column. The ranks go back to their rows in one regrouping.

A rank among the rows where column b is present too is the same running sum with b's missing rows left out, so pairs with holes need no ranking of their own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.plans import order, stats
from tidegauge.plans.skew import BROADCAST_ROWS, salted_lookup
from tidegauge.session import settle

#: (part, column, rows, first value, rows of its run, last value, rows of its run); rows are counted once in all and once for each column with holes.
SEGMENT = "part int, c int, total array<double>, first double, first_run array<double>, last double, last_run array<double>"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, column, values, rows, weights) of each column's stretch in a sorted partition."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    part, column, value, row = (table[c].to_numpy() for c in ("part", "c", "v", "row"))
    weights = np.ones((len(row), 1)) if "present" not in table.column_names else _weights(table["present"].combine_chunks(), len(row))
    cuts = np.flatnonzero((np.diff(column) != 0) | (np.diff(part) != 0)) + 1
    for low, high in zip([0, *cuts], [*cuts, len(row)]):
        yield int(part[low]), int(column[low]), value[low:high], row[low:high], weights[low:high]


def _weights(present: pa.Array, n: int) -> np.ndarray:
    present = present.chunk(0) if isinstance(present, pa.ChunkedArray) else present
    return np.column_stack([np.ones(n), present.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)])


def _starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, column, values, _, weights in _segments(batches):
        at = _starts(values)
        first = weights[: at[1]] if len(at) > 1 else weights
        yield pa.RecordBatch.from_pylist([{
            "part": part, "c": column, "total": weights.sum(axis=0).tolist(), "first": float(values[0]), "first_run": first.sum(axis=0).tolist(),
            "last": float(values[-1]), "last_run": weights[at[-1] :].sum(axis=0).tolist(),
        }], schema=pa.schema([("part", pa.int32()), ("c", pa.int32()), ("total", pa.list_(pa.float64())), ("first", pa.float64()), ("first_run", pa.list_(pa.float64())), ("last", pa.float64()), ("last_run", pa.list_(pa.float64()))]))


def _edges(summaries: list) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each partition and column: rows before it, and start and size of the whole runs that its first and its last value belong to."""
    by_column = defaultdict(list)
    for s in summaries:
        by_column[s["c"]].append(s)
    out = {}
    for column, segments in by_column.items():
        segments.sort(key=lambda s: s["part"])
        base, runs, which = np.zeros(len(segments[0]["total"])), [], []
        for s in segments:
            total, first, last = (np.array(s[k]) for k in ("total", "first_run", "last_run"))
            if runs and runs[-1][0] == s["first"]:
                runs[-1][2] += first
            else:
                runs.append([s["first"], base.copy(), first.copy()])
            head = len(runs) - 1
            if s["last"] != s["first"]:
                runs.append([s["last"], base + total - last, last.copy()])
            which.append((s["part"], base.copy(), head, len(runs) - 1))
            base = base + total
        for part, before, head, tail in which:
            out[part, column] = (before, runs[head][1], runs[head][2], runs[tail][1], runs[tail][2])
    return out


def average_ranks(df: DataFrame, columns: Sequence[str], holed: Sequence[str] = ()) -> DataFrame:
    """(row, r0, r1, …): for each column an array of its rank among all its rows, then among those where each of ``holed`` is present; null where the cell is missing.

    Ranks begin at 1, equal values share their mean rank. At most one row a partition and column reaches the driver.
    """
    numbers = settle(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)], *([F.array(*[F.col(h).isNotNull().cast("tinyint") for h in holed]).alias("present")] if holed else [])).withColumn("row", F.monotonically_increasing_id()))
    extra = ["present"] if holed else []
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"x{i}").alias("v")) for i in range(len(columns))]))
    long = numbers.select("row", *extra, cells).where(F.col("v").isNotNull())
    keys = ["c", "v", "row"]
    dealt = settle(long.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))
    edges = _edges(dealt.mapInArrow(_summaries, SEGMENT).collect())

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column, values, rows, weights in _segments(batches):
            before, head_start, head_size, tail_start, tail_size = edges[part, column]
            at = _starts(values)
            sizes = np.add.reduceat(weights, at, axis=0)
            starts = before + np.cumsum(sizes, axis=0) - sizes
            starts[-1], sizes[-1] = tail_start, tail_size
            starts[0], sizes[0] = head_start, head_size
            rank = np.repeat(starts + (sizes + 1) / 2, np.diff(np.append(at, len(values))), axis=0)
            width = rank.shape[1]
            for low in range(0, len(rows), 1 << 16):
                block = np.ascontiguousarray(rank[low : low + (1 << 16)])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, block.size + 1, width, dtype=np.int32)), pa.array(block.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(rows[low : low + (1 << 16)]), pa.array(np.full(len(block), column, np.int32)), lists], ["row", "c", "r"])

    back = dealt.mapInArrow(ranked, "row long, c int, r array<double>")
    return back.groupBy("row").agg(*[F.any_value(F.when(F.col("c") == i, F.col("r")), ignoreNulls=True).alias(f"r{i}") for i in range(len(columns))])


def value_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n, rank) of every distinct value: its rows, and the mean rank they share. Rows are counted before anything is sorted."""
    counted = order.cumulative_counts(stats.number_counts(df, columns))
    return settle(counted.select("column", "value", "n", order.average_rank().alias("rank")))


def with_value_ranks(df: DataFrame, columns: Sequence[str], ranked: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """``columns`` of ``df``, none with holes, replaced by their ranks. ``sizes`` are the distinct values of each; the smallest columns are looked up without a shuffle."""
    out, room = df.select(*columns), BROADCAST_ROWS
    for c in sorted(columns, key=lambda c: (sizes[c], c)):
        lookup = ranked.where(F.col("column") == c).select(F.col("value").alias(c), F.col("rank").alias("__rank"), F.col("n").alias("__n"))
        room -= sizes[c]
        out = salted_lookup(out, c, lookup, "__n", "inner", sizes[c] if room >= 0 else None).select(*[x for x in columns if x != c], F.col("__rank").alias(c))
    return out
