"""Hard negatives by threshold joins over an inverted index with suffix-norm bounds.

Rows and anchors are dealt into tiles: a slot of rows meets every group of anchors once. Inside a tile the rows are indexed by dimension, strongest
dimension first; of every row the dimensions are left out from where the norm of its rest times the largest rest among the anchors stays below
the threshold. Partial scores are accumulated over the indexed dimensions, a pair goes as soon as its partial score and the remaining norms
cannot reach the anchor's threshold, and what stays is scored in full. Thresholds start high and are lowered for those anchors whose windows
(the best positives, then the negatives under each positive) are not full yet, down to where nothing can be left. A tile gives at most as
many rows as the window is long for each anchor and positive, so ties and copies of any number cost nothing in the shuffle.

Components are floor(256 * x), so scores are whole numbers and exact; beyond 53 bits they are computed with Python integers.

Rows with a null id, label or vector, or with a component that is null or not finite (or leaves the doubles when taken 256 times) take no part. A shorter
vector counts as padded with zeros, an empty one scores 0. Rows with the anchor's own id are neither its positives nor its negatives;
repeated rows of one id and score count once; of an anchor id with different rows the smallest (label, vector) is the anchor. Equal scores go by
the smaller id. An empty table gives an empty result; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import settle

SCALE = 256
SLOT_BYTES, SLOT_ROWS = 1 << 24, 4096
GROUP_ANCHORS = 4096
#: Rows and anchors whose partial scores are held at once.
BLOCK = 1024
#: Dimensions accumulated between two prunings.
STEP = 8
EXACT = float(1 << 53)
#: Thresholds of the search for positives, as parts of the largest possible score; the last finds all.
LEVELS = (0.5, 0.25, 0.0, -np.inf)
#: How far below a window's upper end the search for its negatives begins, and how it is lowered.
DEPTHS = (0.125, 0.5, 1.0)


def matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """floor(256 x) of list values, padded with zeros to one width."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros((0, width or 0))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(SCALE * np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64))
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), width or 0)))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Index:
    """Rows of a tile by dimension, without the dimensions that the norm bounds cover at the threshold ``least``."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, least: float) -> None:
        order = np.argsort(-np.square(rows).sum(axis=0), kind="stable")
        self.rows, self.anchors = rows[:, order], anchors[:, order]
        self.rest, self.anchor_rest = _rests(self.rows), _rests(self.anchors)
        reach = self.rest * self.anchor_rest.max(axis=0, initial=0.0) * (1 + 1e-9)
        # the bound falls along a row: what is indexed is the beginning
        self.indexed = (reach[:, :-1] >= least).sum(axis=1) if least > -np.inf else np.full(len(rows), rows.shape[1])
        self.postings = np.where(np.arange(rows.shape[1]) < self.indexed[:, None], self.rows, 0.0)

    def pairs(self, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of every pair whose score reaches the anchor's threshold."""
        found = [self._block(a, r, thresholds) for a in range(0, len(self.anchors), BLOCK) for r in range(0, len(self.rows), BLOCK)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _block(self, a: int, r: int, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        anchors, rest, least = self.anchors[a : a + BLOCK], self.anchor_rest[a : a + BLOCK], thresholds[a : a + BLOCK]
        # rows without an indexed dimension cannot reach any threshold
        live = r + np.flatnonzero((self.indexed[r : r + BLOCK] > 0) | (self.rest[r : r + BLOCK, 0] * rest[:, 0].max(initial=0.0) * (1 + 1e-9) >= least.min(initial=np.inf)))
        partial, width, at = np.zeros((len(anchors), len(live))), self.rows.shape[1], 0
        alive = np.ones(partial.shape, bool)
        while at < width and alive.size and alive.mean() > 0.05:
            to = min(at + STEP, width)
            partial += anchors[:, at:to] @ self.postings[live, at:to].T
            at = to
            seen = np.minimum(self.indexed[live], at)
            alive = partial + rest[:, seen] * self.rest[live, seen] * (1 + 1e-9) + 1e-6 >= least[:, None]
            held = alive.any(axis=0)
            if held.mean() < 0.7:
                live, partial, alive = live[held], partial[:, held], alive[:, held]
        x, y = np.nonzero(alive)
        out = []
        for i in range(0, len(x), 1 << 17):  # what is left is scored with all dimensions
            p, q = x[i : i + (1 << 17)], live[y[i : i + (1 << 17)]]
            out.append(np.einsum("ij,ij->i", anchors[p], self.rows[q]))
        score = np.concatenate(out) if out else np.zeros(0)
        enough = score >= least[x]
        return x[enough] + a, live[y[enough]], score[enough]


def _rests(rows: np.ndarray) -> np.ndarray:
    """Norm of each row from each dimension on; one more column of zeros."""
    out = np.zeros((rows.shape[0], rows.shape[1] + 1))
    out[:, :-1] = np.sqrt(np.cumsum(np.square(rows[:, ::-1]), axis=1)[:, ::-1])
    return out


def reaching(rows: np.ndarray, anchors: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs at or above the thresholds; the scores as whole numbers."""
    largest = float(np.abs(rows).max(initial=0.0)) * float(np.abs(anchors).max(initial=0.0)) * max(rows.shape[1], 1)
    if largest < EXACT:
        a, r, s = Index(rows, anchors, float(thresholds.min(initial=np.inf))).pairs(thresholds)
        return a, r, s.astype(np.int64)
    whole = [[int(v) for v in row] for row in rows]
    out = [(i, j, sum(x * y for x, y in zip(map(int, anchor), row))) for i, anchor in enumerate(anchors) for j, row in enumerate(whole)]
    out = [x for x in out if x[2] >= thresholds[x[0]]]
    # a score that leaves 64 bits raises here: it could not be returned
    return tuple(np.array([x[i] for x in out], np.int64) for i in range(3))


def _best(a: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` different rows of each anchor: higher score, then smaller id."""
    order = np.lexsort((ids, -scores, a))
    a, ids, scores = a[order], ids[order], scores[order]
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (ids[1:] != ids[:-1]) | (scores[1:] != scores[:-1])
    order, a = order[once], a[once]
    first = np.searchsorted(a, a, "left")
    return order[np.arange(len(a)) - first < k]


def positives_of_tile(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """At most ``k`` best rows of the same label for each anchor of a tile."""
    a_ids, a_labels, r_ids, r_labels = (t[c].to_numpy() for t in (anchors, rows) for c in ("id", "label"))
    width = max((int(pc.max(pc.list_value_length(t["vector"])).as_py() or 0) for t in (anchors, rows)), default=0)
    a_values, r_values = matrix(anchors["vector"], width), matrix(rows["vector"], width)
    out: list[tuple[np.ndarray, ...]] = []
    for label in np.intersect1d(a_labels, r_labels):
        open_, mine = np.flatnonzero(a_labels == label), np.flatnonzero(r_labels == label)
        sub = r_values[mine]
        longest = np.sqrt(np.square(sub).sum(axis=1)).max(initial=0.0)
        for level in LEVELS:
            if not len(open_):
                break
            norms = np.sqrt(np.square(a_values[open_]).sum(axis=1))
            least = level * norms * longest if level > -np.inf else np.full(len(open_), -np.inf)
            a, r, s = reaching(sub, a_values[open_], least)
            other = a_ids[open_][a] != r_ids[mine][r]
            a, r, s = a[other], r[other], s[other]
            best = _best(a, r_ids[mine][r], s, k)
            a, r, s = a[best], r[best], s[best]
            full = np.bincount(a, minlength=len(open_)) >= k
            done = full if level > -np.inf else np.ones(len(open_), bool)
            keep = done[a]
            out.append((a_ids[open_][a[keep]], r_ids[mine][r[keep]], s[keep]))
            open_ = open_[~done]
    columns = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in (zip(*out) if out else ((), (), ()))]
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_id", "positive_score"])


def negatives_of_tile(anchors: pa.Table, rows: pa.Table, k: int, low: int, high: int) -> pa.Table:
    """At most ``k`` best rows of other labels in the window under each positive of each anchor of a tile."""
    a_ids, a_labels, r_ids, r_labels = (t[c].to_numpy() for t in (anchors, rows) for c in ("id", "label"))
    width = max((int(pc.max(pc.list_value_length(t["vector"])).as_py() or 0) for t in (anchors, rows)), default=0)
    a_values, r_values = matrix(anchors["vector"], width), matrix(rows["vector"], width)
    # one line for each window: its anchor, its positive, its ends
    owner, positive, positive_score, top, bottom = [], [], [], [], []
    for i, held in enumerate(anchors["positives"].to_pylist()):
        for p in held:
            s = p["positive_score"]
            ends = -(-low * s // 100), high * s // 100
            if ends[0] <= ends[1]:
                owner.append(i), positive.append(p["positive_id"]), positive_score.append(s), bottom.append(ends[0]), top.append(ends[1])
    owner, positive, positive_score, top, bottom = (np.array(x, np.int64) for x in (owner, positive, positive_score, top, bottom))
    out: list[tuple[np.ndarray, ...]] = []
    open_ = np.arange(len(owner))
    for depth in DEPTHS:
        if not len(open_):
            break
        start = np.maximum(bottom[open_], np.floor(top[open_] - depth * (top[open_] - bottom[open_]))) if depth < 1 else bottom[open_].astype(float)
        wanted, place = np.unique(owner[open_], return_inverse=True)
        least = np.full(len(wanted), np.inf)
        np.minimum.at(least, place, start)
        a, r, s = reaching(r_values, a_values[wanted], least)
        other = (a_labels[wanted][a] != r_labels[r]) & (a_ids[wanted][a] != r_ids[r])
        a, r, s = a[other], r[other], s[other]
        order = np.argsort(a, kind="stable")
        a, r, s = a[order], r[order], s[order]
        first, last = np.searchsorted(a, np.arange(len(wanted)), "left"), np.searchsorted(a, np.arange(len(wanted)), "right")
        still = []
        for w, anchor in zip(open_, place):
            span = slice(first[anchor], last[anchor])
            inside = np.flatnonzero((s[span] <= top[w]) & (s[span] >= least[anchor]) & (s[span] >= bottom[w])) + first[anchor]
            best = inside[_best(np.zeros(len(inside), np.int64), r_ids[r[inside]], s[inside], k)]
            if len(best) < k and depth < 1:
                still.append(w)
                continue
            n = len(best)
            out.append((np.full(n, a_ids[owner[w]]), np.full(n, positive[w]), np.full(n, positive_score[w]), r_ids[r[best]], s[best]))
        open_ = np.array(still, np.int64)
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 5
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])


def usable(rows: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    scaled = F.transform(F.col("vector"), lambda x: x.cast("double") * SCALE)
    fine = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & fine
    )


def _tiles(rows: DataFrame, anchors: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, slots: int, groups: int) -> DataFrame:
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumn("group", F.pmod(F.xxhash64(F.lit("group"), "id"), F.lit(groups)).cast("int")).withColumn("slot", every(slots))
    right = rows.withColumn("slot", F.pmod(F.xxhash64(F.lit("slot"), "id", "vector"), F.lit(slots)).cast("int")).withColumn("group", every(groups))
    return left.groupBy("slot", "group").cogroup(right.groupBy("slot", "group")).applyInArrow(lambda a, r: work(a, r), schema)


def _first(df: DataFrame, by: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "id", label_col: str = "label", vector_col: str = "vector",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, slot_rows: int = SLOT_ROWS, group_anchors: int = GROUP_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``is_anchor`` is a condition on the column ``id``.

    Negatives score between ``low`` and ``high`` hundredths of the positive they belong to.
    """
    taking = usable(rows, id_col, label_col, vector_col)
    anchors = settle(taking.where(is_anchor).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.*"))
    sizes = taking.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width"), F.count_if(is_anchor).alias("anchors")).first()
    # both bounds are on what one task holds
    held = max(1, min(slot_rows, SLOT_BYTES // (8 * max(sizes["width"], 1))))
    slots, groups = max(1, -(-sizes["n"] // held)), max(1, -(-sizes["anchors"] // group_anchors))
    found = _tiles(taking, anchors, lambda a, r: positives_of_tile(a, r, positives), "anchor_id long, positive_id long, positive_score long", slots, groups)
    best = _first(found.dropDuplicates(), ["anchor_id"], [F.desc("positive_score"), F.asc("positive_id")], positives, "place")
    # at most ``positives`` entries an anchor
    windows = best.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = settle(anchors.join(windows, "id"))
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    under = _tiles(taking, asked, lambda a, r: negatives_of_tile(a, r, negatives, low, high), schema, slots, groups)
    ranked = _first(under.dropDuplicates(), ["anchor_id", "positive_id", "positive_score"], [F.desc("negative_score"), F.asc("negative_id")], negatives, "rank")
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
