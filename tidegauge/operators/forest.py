"""Random forests whose trees grow to any depth.

As long as a tree's rows fit a task, a task reads the rows of one fit and grows a batch of its trees, level by level for all nodes at once, with exact cuts. Columns beyond what
a task may hold lie sorted in a file of its own: the upper levels read them in turn, and subtrees small enough are finished in memory, a few at a time. A still larger
table first gets the upper levels of every tree from Spark's own forest, which counts in all tasks; the rows then go to their leaves, and each leaf's
subtree is finished in a task. Held-out rows walk down with the training rows, so what comes back are predictions and importances, and
no forest is ever gathered.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import settle, shelve

#: Cells (rows times features and label) and rows of one fit or one leaf that a task may take; of a row it holds about 30 bytes, the columns lie in a file.
TASK_CELLS = 3 << 24
TASK_ROWS = 1 << 23
#: Cells that a task grows trees of in memory, at about 35 bytes each.
HELD_CELLS = 1 << 19
#: Rows that are read from a file at once.
CHUNK = 1 << 16
#: Distinct values up to which a column in a file is summed by value, and sums held at once for that.
COUNTED = 1 << 16
SUMMED_CELLS = 1 << 20
BATCHES = 10
#: Branches of one partition each would else be put together as one partition.
UNION_BY_PARTITION = "spark.sql.unionOutputPartitioning"


@dataclass(frozen=True)
class Plan:
    trees: int = 100
    depth: int = 30
    seed: int = 0
    classes: int = 0  # 0: numbers
    task_rows: int | None = None  # as many as TASK_CELLS and TASK_ROWS let in
    batches: int = BATCHES


def bootstrap(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is drawn: Poisson(1) from a hash, so that a rerun and any dealing of the rows draw alike."""
    h = rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + tree + 1) * 0xD1342543DE82EF95 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    return np.searchsorted(np.cumsum(np.exp(-1.0) / np.array([1.0, 1, 2, 6, 24, 120, 720, 5040, 40320])), u, "right").astype(float)


def _right(codes: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whether each row lies beyond the cut of its node, which is split."""
    by, bound, right = feature[node], cut[node], np.zeros(len(rows), bool)
    for f in np.unique(by):
        here = by == f
        right[here] = codes[f][rows[here]] > bound[here]
    return right


class _Held:
    """The drawn rows of a tree: weights, weighted targets, codes and node of each, and its places in the order of each column within each node."""

    def __init__(self, weight: np.ndarray, weighted: list[np.ndarray], codes: list[np.ndarray], orders: list[np.ndarray], node: np.ndarray) -> None:
        self.weight, self.weighted, self.codes, self.node = weight, weighted, codes, node
        self.orders = [o[np.argsort(node[o], kind="stable")] for o in orders] if node.any() else orders
        self.alive = np.arange(len(weight))

    def sizes(self, count: int) -> np.ndarray:
        return np.bincount(self.node[self.alive], minlength=count)

    def totals(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        node = self.node[self.alive]
        return np.bincount(node, self.weight[self.alive], count), np.column_stack([np.bincount(node, t[self.alive], count) for t in self.weighted])

    def deal(self, feature: np.ndarray, cut: np.ndarray, child: np.ndarray, count: int) -> None:
        """Each split node's rows give way, in every order, to those of its left and then those of its right child; the others are done."""
        node = self.node[self.alive]
        kept = feature[node] >= 0
        self.node[self.alive[~kept]] = -1
        self.alive, node = self.alive[kept], node[kept]
        self.node[self.alive] = child[node] + _right(self.codes, feature, cut, node, self.alive)
        side = np.repeat(np.arange(count) % 2 == 1, self.sizes(count))
        for f, order in enumerate(self.orders):
            to = self.node[order]
            if not kept.all():
                stays = to >= 0
                order, to = order[stays], to[stays]
            goes = (to & 1).astype(bool)
            dealt = np.empty_like(order)
            dealt[side], dealt[~side] = order[goes], order[~goes]
            self.orders[f] = dealt

    def gather(self) -> None:
        """Rows of a node beside each other again, so that reading a node reads few pages."""
        kept = self.alive[np.argsort(self.node[self.alive], kind="stable")]
        place = np.empty(len(self.node), np.int32)
        place[kept] = np.arange(len(kept), dtype=np.int32)
        self.orders = [place[o] for o in self.orders]
        self.weight, self.node = self.weight[kept], self.node[kept]
        self.weighted, self.codes = [t[kept] for t in self.weighted], [c[kept] for c in self.codes]
        self.alive = np.arange(len(kept))


class Grower:
    """Grows trees over one matrix; ``targets`` has a column per class, or one for numbers.

    The matrix (or its columns, one after the other) is kept as places among each column's distinct values, and its rows in the order of each column. A tree
    takes these orders over and deals them out to the nodes of a level, so no level sorts.
    """

    def __init__(self, x: np.ndarray | Iterator[np.ndarray], targets: np.ndarray, offered: int, depth: int) -> None:
        self.targets, self.offered, self.depth = targets, offered, depth
        self.values, self.sorted, codes = [], [], []
        for column in x.T if isinstance(x, np.ndarray) else x:
            order = np.argsort(column, kind="stable").astype(np.int32)
            column = column[order]
            new = np.ones(len(column), bool)
            new[1:] = (column[1:] != column[:-1]) & ~(np.isnan(column[1:]) & np.isnan(column[:-1]))
            code = np.empty(len(column), np.int32)
            code[order] = np.cumsum(new) - 1
            self.values.append(column[new])
            self.sorted.append(order)
            codes.append(code)
        self.codes = codes

    @classmethod
    def of_sorted(cls, columns: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], targets: np.ndarray, offered: int) -> Grower:
        """From (distinct values, order, codes) of each column."""
        grower = cls(iter(()), targets, offered, 0)
        for values, order, code in columns:
            grower.values.append(values)
            grower.sorted.append(order)
            grower.codes.append(code)
        return grower

    def tree(self, weight: np.ndarray, asked: np.ndarray, draw: np.random.Generator, root: np.ndarray | None = None, depths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(value of each asked row, gain of each feature). ``weight`` is 0 for rows that only walk down.

        Several subtrees grow side by side where ``root`` numbers that of each row and ``depths`` has how deep each may grow.
        """
        root = np.zeros(len(weight), np.int32) if root is None else root
        depths = np.array([self.depth]) if depths is None else depths
        p, sides = len(self.codes), self.targets.shape[1]
        gains = np.zeros(p)
        # training rows by place among those drawn; the others only walk
        drawn, walking = np.flatnonzero(weight > 0), np.flatnonzero(asked)
        place = np.full(len(weight), -1, np.int32)
        place[drawn] = np.arange(len(drawn), dtype=np.int32)
        orders = [place[o] for o in self.sorted]
        own = weight[drawn].astype(float)
        held = _Held(own, [own * self.targets[drawn, s] for s in range(sides)], [c[drawn] for c in self.codes], [o[o >= 0] for o in orders], root[drawn])
        out, row, at = np.zeros((len(walking), sides)), np.arange(len(walking)), root[walking]
        del place, orders
        count, level = len(depths) if len(drawn) + len(walking) else 0, 0
        while count:
            total, sums = held.totals(count)
            value = sums / np.maximum(total, 1e-300)[:, None]
            best, feature, cut = np.zeros(count), np.full(count, -1), np.zeros(count, np.int64)
            deeper = depths > 0
            if p and deeper.any():
                # the nodes lie side by side in every order
                owner = np.repeat(np.arange(count, dtype=np.int32), held.sizes(count))
                # a few features are offered to each node
                chosen = np.argsort(draw.random((count, p)), axis=1) < self.offered if self.offered < p else None
                if not deeper.all():
                    chosen = np.repeat(deeper[:, None], p, axis=1) if chosen is None else chosen & deeper[:, None]
                for f in range(p):
                    order, of = held.orders[f], owner
                    if chosen is not None:
                        offered = chosen[owner, f]
                        order, of = order[offered], owner[offered]
                    if len(order):
                        self._cuts(f, order, of, held, total, sums, best, feature, cut)
            split = feature >= 0
            np.add.at(gains, feature[split], best[split])
            done = ~split[at]
            out[row[done]] = value[at[done]]
            row, at = row[~done], at[~done]
            child = (2 * (np.cumsum(split) - 1)).astype(np.int32)
            at = child[at] + _right(self.codes, feature, cut, at, walking[row])
            depths, count = np.repeat(depths[split] - 1, 2), 2 * int(split.sum())
            if count:
                held.deal(feature, cut, child, count)
                if level % 4 == 3:
                    held.gather()
            level += 1
        return out, gains

    def _cuts(self, f: int, order: np.ndarray, of: np.ndarray, held: _Held, total: np.ndarray, sums: np.ndarray, best: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> None:
        """Put in the best cut of feature ``f`` for every node where it beats what was found before; ``order``: rows by node (``of``) and value."""
        code = held.codes[f][order]
        new = np.empty(len(order), bool)
        new[0] = True
        np.not_equal(code[1:], code[:-1], out=new[1:])
        new[1:] |= of[1:] != of[:-1]
        at = np.flatnonzero(new)
        apart = len(at) == len(order)  # every row has a value of its own
        owner, code = (of, code) if apart else (of[at], code[at])
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        if len(heads) == len(at):
            return  # nothing left to tell apart
        nodes, lengths = owner[heads], np.diff(np.append(heads, len(at)))

        def running(of_row: np.ndarray) -> np.ndarray:
            """Sums up to each value of its node."""
            out = np.cumsum(of_row[order] if apart else np.add.reduceat(of_row[order], at))
            before = out[heads - 1]
            before[0] = 0.0
            out -= np.repeat(before, lengths)
            return out

        left = running(held.weight)
        right = np.repeat(total[nodes], lengths)
        right -= left
        inner = right > 0
        inner[heads[1:] - 1] = inner[-1] = False
        np.maximum(right, 1e-300, out=right)
        square = np.square(sums[nodes]).sum(axis=1) / total[nodes]
        gain = np.repeat(-square, lengths)
        for s, t in enumerate(held.weighted):
            part = running(t)
            rest = np.repeat(sums[nodes, s], lengths)
            rest -= part
            np.square(part, out=part)
            part /= left
            np.square(rest, out=rest)
            rest /= right
            part += rest
            gain += part
        # rounding makes tiny gains out of nothing
        inner &= gain > np.repeat(1e-9 * (square + 1e-12), lengths)
        gain[~inner] = 0.0
        top = np.maximum.reduceat(gain, heads)
        better = top > best[nodes]
        for_node = np.full(len(total), -1)
        hit = np.flatnonzero((gain > 0) & (gain == np.repeat(top, lengths)))
        for_node[owner[hit[::-1]]] = hit[::-1]  # the first of equal cuts
        chosen = nodes[better & (for_node[nodes] >= 0)]
        i = for_node[chosen]
        low, high = self.values[f][code[i]], self.values[f][code[i + 1]]
        best[chosen], feature[chosen] = gain[i], f
        middle = low + (high - low) / 2
        # of two neighbouring doubles the middle is one of them; a value between the two may be held out
        cut[chosen] = np.searchsorted(self.values[f], np.where(middle < high, middle, low), "right") - 1


def _mapped(file, kind: type, mode: str = "r") -> np.ndarray:
    """What was written, read from the file as it is needed; the file is gone with the last use."""
    file.flush()
    return np.asarray(np.memmap(file, kind, mode)) if file.tell() else np.zeros(0, kind)


def _stored(array: np.ndarray) -> np.ndarray:
    file = tempfile.TemporaryFile()
    file.write(array)
    return _mapped(file, array.dtype)


def _chunks(n: int) -> list[slice]:
    return [slice(a, min(a + CHUNK, n)) for a in range(0, n, CHUNK)]


class Stored:
    """Grows trees like ``Grower``, with exact cuts, over columns that lie in files of the task.

    Of a column of few distinct values a node sums the rows by value. Of the others a tree keeps a list (rows, codes, weights, labels) in the order of the values, where the
    rows of a node lie beside each other; it is read chunk by chunk for the best cut and dealt out to the children in place. Either way rows are read one after the other.
    Nodes that are small enough wait, and are finished in memory, as many at a time as it takes.
    """

    def __init__(self, columns: Iterator[np.ndarray], label: np.ndarray, classes: int, offered: int, depth: int) -> None:
        self.label, self.classes, self.offered, self.depth = label, classes, offered, depth
        self.sides, self.orders, self.codes, self.values = max(classes, 1), {}, [], []
        for f, column in enumerate(columns):
            order = np.argsort(column, kind="stable").astype(np.int32)
            code, distinct, last = np.empty(len(column), np.int32), tempfile.TemporaryFile(), None
            for chunk in _chunks(len(order)):
                rows = order[chunk]
                part = column[rows]
                before = np.concatenate([part[:1] if last is None else last[1], part[:-1]])
                new = (part != before) & ~(np.isnan(part) & np.isnan(before))
                new[0] |= last is None
                code[rows] = np.cumsum(new) + (-1 if last is None else last[0])
                distinct.write(part[new])
                last = code[rows[-1]], part[-1:]
            self.codes.append(_stored(code))
            self.values.append(_mapped(distinct, np.float64))
            if len(self.values[f]) > COUNTED:
                self.orders[f] = _stored(order)
            del column, order, code
        self.held_rows = max(1, HELD_CELLS // (len(self.codes) + 1))

    def tree(self, weight: np.ndarray, asked: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """As ``Grower.tree``."""
        p, gains = len(self.codes), np.zeros(len(self.codes))
        drawn, walking = np.flatnonzero(weight > 0).astype(np.int32), np.flatnonzero(asked).astype(np.int32)
        held = _Lists(self, weight, drawn)
        out = np.zeros((len(walking), self.sides))
        # (first and last place in every list, which of the walking rows) of each node
        nodes, waiting = [(0, len(drawn), np.arange(len(walking), dtype=np.int32))], []
        for level in range(self.depth + 1):
            small = [level < self.depth and p and b - a + len(walk) <= self.held_rows for a, b, walk in nodes]
            waiting += [(*node, self.depth - level) for node, s in zip(nodes, small) if s]
            nodes = [node for node, s in zip(nodes, small) if not s]
            chosen = np.ones((len(nodes), p), bool)
            if level < self.depth and self.offered < p:
                chosen = np.argsort(draw.random((len(nodes), p)), axis=1) < self.offered
            children = []
            for (a, b, walk), of_node in zip(nodes, chosen):
                total, sums = held.sums(a, b)
                gain, f, low, high = held.best(a, b, total, sums, np.flatnonzero(of_node)) if level < self.depth else (0.0, -1, 0, 0)
                if f < 0:
                    out[walk] = sums / max(total, 1e-300)
                    continue
                gains[f] += gain
                x, y = self.values[f][low], self.values[f][high]
                middle = x + (y - x) / 2
                cut = int(np.searchsorted(self.values[f], middle if middle < y else x, "right")) - 1
                at = held.deal(a, b, f, cut)
                right = self.codes[f][walking[walk]] > cut
                children += [(a, at, walk[~right]), (at, b, walk[right])]
            nodes = children
        for pack in self._packs(waiting):
            gains += self._finish(pack, held, walking, out, draw)
        return out, gains

    def _packs(self, waiting: list[tuple]) -> Iterator[list[tuple]]:
        """Waiting nodes, as many at a time as memory takes."""
        pack, rows = [], 0
        for node in waiting:
            size = node[1] - node[0] + len(node[2])
            if pack and rows + size > self.held_rows:
                yield pack
                pack, rows = [], 0
            pack.append(node)
            rows += size
        if pack:
            yield pack

    def _finish(self, pack: list[tuple], held: _Lists, walking: np.ndarray, out: np.ndarray, draw: np.random.Generator) -> np.ndarray:
        """Put in the values of the walking rows below some nodes; the gain of each feature there."""
        members = np.concatenate([held.rows[a:b] for a, b, _, _ in pack])
        walk = np.concatenate([w for _, _, w, _ in pack])
        n, sizes = len(members), [b - a for a, b, _, _ in pack]
        root = np.repeat(np.tile(np.arange(len(pack), dtype=np.int32), 2), sizes + [len(w) for _, _, w, _ in pack])
        columns = []
        for f, code in enumerate(held.codes):
            code = code[members]
            if f in held.lists:
                place = np.empty(len(held.weight), np.int32)
                place[members] = np.arange(n, dtype=np.int32)
                order = place[np.concatenate([held.lists[f][0][a:b] for a, b, _, _ in pack])]
                del place
            else:
                order = np.argsort(code.astype(np.uint16) if COUNTED <= 1 << 16 else code, kind="stable").astype(np.int32)
            columns.append((self.values[f], order, np.concatenate([code, self.codes[f][walking[walk]]])))
        targets = _targets(np.concatenate([held.label[members], np.zeros(len(walk))]), self.classes)
        weight = np.concatenate([held.weight[members], np.zeros(len(walk), np.uint8)])
        out[walk], gains = Grower.of_sorted(columns, targets, self.offered).tree(weight, np.arange(len(root)) >= n, draw, root, np.array([d for _, _, _, d in pack]))
        return gains


class _Lists:
    """The drawn rows of a tree of ``Stored``: by node in their own order, and for each column of many values by node and value."""

    def __init__(self, grower: Stored, weight: np.ndarray, drawn: np.ndarray) -> None:
        self.classes, self.sides = grower.classes, grower.sides
        self.weight, self.label = weight[drawn], grower.label[drawn]
        self.rows, self.beyond = np.arange(len(drawn), dtype=np.int32), np.zeros(len(drawn), bool)
        self.codes, self.distinct = [_stored(c[drawn]) for c in grower.codes], [len(v) for v in grower.values]
        place = np.full(len(weight), -1, np.int32)
        place[drawn] = self.rows
        self.lists = {f: self._list(order, place, self.codes[f]) for f, order in grower.orders.items()}

    def _list(self, order: np.ndarray, place: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, ...]:
        files = [tempfile.TemporaryFile() for _ in range(4)]
        for chunk in _chunks(len(order)):
            rows = place[order[chunk]]
            rows = rows[rows >= 0]
            for file, part in zip(files, (rows, code[rows], self.weight[rows], self.label[rows])):
                file.write(part)
        return tuple(_mapped(file, kind, "r+") for file, kind in zip(files, (np.int32, np.int32, np.uint8, self.label.dtype)))

    def _weighted(self, weight: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Weights, and what is summed of the target."""
        w = weight.astype(float)
        return w, [w * (label == s) for s in range(self.classes)] if self.classes else [w * label]

    def sums(self, a: int, b: int) -> tuple[float, np.ndarray]:
        total, sums = 0.0, np.zeros(self.sides)
        for chunk in _chunks(b - a):
            rows = self.rows[a:b][chunk]
            w, targets = self._weighted(self.weight[rows], self.label[rows])
            total += w.sum()
            sums += [t.sum() for t in targets]
        return total, sums

    def best(self, a: int, b: int, total: float, sums: np.ndarray, offered: np.ndarray) -> tuple[float, int, int, int]:
        """(gain, feature, codes of the values on both sides) of the best cut of a node, the feature being -1 where none gains."""
        square = np.square(sums).sum() / total
        found, group, cells = {}, [], 0
        for f in offered:
            if f in self.lists:
                found[f] = self._listed(f, a, b, total, sums, square)
                continue
            size = self.distinct[f] * (1 + self.sides)
            if group and cells + size > SUMMED_CELLS:
                found |= self._counted(group, a, b, total, sums, square)
                group, cells = [], 0
            group.append(f)
            cells += size
        if group:
            found |= self._counted(group, a, b, total, sums, square)
        best = (1e-9 * (square + 1e-12), -1, 0, 0)  # rounding makes tiny gains out of nothing
        for f in offered:
            if found[f][0] > best[0]:
                best = (found[f][0], int(f), *found[f][1:])
        return best

    @staticmethod
    def _gains(left: np.ndarray, parts: Iterable[np.ndarray], total: float, sums: np.ndarray, square: float) -> np.ndarray:
        right = np.maximum(total - left, 1e-300)
        gain = np.full(len(left), -square)
        for s, part in enumerate(parts):
            gain += np.square(part) / left + np.square(sums[s] - part) / right
        return gain

    def _counted(self, group: list[int], a: int, b: int, total: float, sums: np.ndarray, square: float) -> dict[int, tuple[float, int, int]]:
        """(gain, codes on both sides) of the best cut in each of some columns of few values."""
        by_value = {f: np.zeros((1 + self.sides, self.distinct[f])) for f in group}
        for chunk in _chunks(b - a):
            rows = self.rows[a:b][chunk]
            w, targets = self._weighted(self.weight[rows], self.label[rows])
            for f in group:
                code = self.codes[f][rows]
                for sum_of, part in zip(by_value[f], (w, *targets)):
                    sum_of += np.bincount(code, part, len(sum_of))
        found = {}
        for f in group:
            there = np.flatnonzero(by_value[f][0])
            if len(there) < 2:
                found[f] = (0.0, 0, 0)
                continue
            left, *parts = (np.cumsum(v[there])[:-1] for v in by_value[f])
            gain = self._gains(left, parts, total, sums, square)
            i = int(gain.argmax())
            found[f] = (gain[i], int(there[i]), int(there[i + 1]))
        return found

    def _listed(self, f: int, a: int, b: int, total: float, sums: np.ndarray, square: float) -> tuple[float, int, int]:
        """The same in a column of many values, from its list."""
        best, seen, left_of, last = (0.0, 0, 0), 0.0, np.zeros(self.sides), -1
        _, codes, weights, labels = (part[a:b] for part in self.lists[f])
        for chunk in _chunks(b - a):
            code = codes[chunk]
            w, targets = self._weighted(weights[chunk], labels[chunk])
            new = np.empty(len(code), bool)
            new[0] = last not in (-1, code[0])
            np.not_equal(code[1:], code[:-1], out=new[1:])
            at = np.flatnonzero(new)  # a cut lies before each of these
            # sums of the rows before each, from the start of the node
            upto, parts = np.cumsum(w), []
            left, seen = upto[at] - w[at] + seen, seen + upto[-1]
            for s, t in enumerate(targets):
                upto = np.cumsum(t)
                parts.append(upto[at - 1] * (at > 0) + left_of[s])
                left_of[s] += upto[-1]
            if len(at):
                gain = self._gains(left, parts, total, sums, square)
                i = int(gain.argmax())
                if gain[i] > best[0]:
                    best = (gain[i], int(code[at[i] - 1]) if at[i] else last, int(code[at[i]]))
            last = int(code[-1])
        return best

    def deal(self, a: int, b: int, f: int, cut: int) -> int:
        """Rows beyond the cut go behind the others, both staying in order; where they begin."""
        right = np.empty(b - a, bool)
        for chunk in _chunks(b - a):
            rows = self.rows[a:b][chunk]
            self.beyond[rows] = right[chunk] = self.codes[f][rows] > cut
        self._part(self.rows[a:b], right)
        for parts in self.lists.values():
            for chunk in _chunks(b - a):
                right[chunk] = self.beyond[parts[0][a:b][chunk]]
            for part in parts:
                self._part(part[a:b], right)
        return b - int(np.count_nonzero(right))

    @staticmethod
    def _part(of_node: np.ndarray, right: np.ndarray) -> None:
        at, behind = 0, []
        for chunk in _chunks(len(of_node)):
            part, goes = of_node[chunk], right[chunk]
            behind.append(part[goes])
            part = part[~goes]
            of_node[at : at + len(part)] = part
            at += len(part)
        of_node[at:] = np.concatenate(behind)


def _targets(label: np.ndarray, classes: int) -> np.ndarray:
    return (label[:, None] == np.arange(classes)).astype(float) if classes else label[:, None]


def _offered(p: int, classes: int) -> int:
    """Features offered to a node: all for numbers, the square root for classes."""
    return max(1, int(np.sqrt(p))) if classes else p


def _answer(fit: int, rows: np.ndarray, values: np.ndarray, trees: int, gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One record a held-out row, and one (row null) with the gains of each feature."""

    def batch(n: int, row: pa.Array, total: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * total.shape[1], total.ravel())
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, fit, np.int32)), row, pa.array(np.full(n, trees, np.int64)), lists], ["fit", "row", "trees", "total"])

    for at in range(0, len(rows), ANSWER_ROWS):
        part = slice(at, at + ANSWER_ROWS)
        yield batch(len(rows[part]), pa.array(rows[part].astype(np.int64)), np.ascontiguousarray(values[part], np.float64))
    yield batch(1, pa.nulls(1, pa.int64()), np.asarray(gains, np.float64)[None, :])


ANSWER = "fit int, row long, trees long, total array<double>"
ANSWER_ROWS = 1 << 17


class _Columns:
    """The label and the columns of x in the order the rows come, in memory or, beyond HELD_CELLS, in a file of the task."""

    def __init__(self) -> None:
        self.parts: list[list[np.ndarray] | int] = []  # columns of a batch, or where they lie in the file
        self.lengths: list[int] = []
        self.width, self.cells, self.file = 0, 0, None

    def add(self, columns: list[np.ndarray]) -> None:
        self.width = len(columns) - 1
        self.lengths.append(len(columns[0]))
        self.cells += len(columns) * len(columns[0])
        self.parts.append([np.array(c, np.float64) for c in columns] if self.file is None else self._put(columns))
        if self.file is None and self.cells > HELD_CELLS:
            self.file = tempfile.TemporaryFile()
            self.parts = [self._put(part) for part in self.parts]

    def _put(self, columns: list[np.ndarray]) -> int:
        at = self.file.tell()
        for c in columns:
            self.file.write(np.ascontiguousarray(c, np.float64))
        return at

    def taken(self, place: np.ndarray, f: int) -> np.ndarray:
        """One of them, its values at their ``place``; in memory it is let go."""
        column, at = np.empty(len(place)), 0
        for part, n in zip(self.parts, self.lengths):
            if self.file is None:
                column[place[at : at + n]], part[f] = part[f], None
            else:
                self.file.seek(part + 8 * f * n)
                column[place[at : at + n]] = np.frombuffer(self.file.read(8 * n))
            at += n
        return column

    def features(self, place: np.ndarray) -> Iterator[np.ndarray]:
        return (self.taken(place, f) for f in range(1, self.width + 1))


def _read(batches: Iterable[pa.RecordBatch], *names: str) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, _Columns]:
    """(first value of each of ``names``, row, train, label, place of each row as it came, columns of x) of one group, by row: any dealing of the rows gives the same trees."""
    first, rows, train, columns = [], [], [], _Columns()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        first = first or [batch.column(c)[0].as_py() for c in names]
        rows.append(batch.column("row").to_numpy().copy())
        train.append(batch.column("train").to_numpy(zero_copy_only=False).copy())
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        columns.add([batch.column("label").to_numpy(), *x.T])
    if not first:
        return [], np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0), np.zeros(0, np.int32), columns
    rows, train = np.concatenate(rows), np.concatenate(train)
    order = np.argsort(rows, kind="stable").astype(np.int32)
    rows, train = rows[order], train[order]
    place = np.empty_like(order)
    place[order] = np.arange(len(order), dtype=np.int32)
    del order
    if columns.file is not None:
        rows = _stored(rows)
    label = columns.taken(place, 0)
    return first, rows, train, label if columns.file is None else _stored(label), place, columns


def _grower(place: np.ndarray, label: np.ndarray, columns: _Columns, plan: Plan, depth: int) -> Grower | Stored:
    p = columns.width
    if columns.file is None:
        return Grower(columns.features(place), _targets(label, plan.classes), _offered(p, plan.classes), depth)
    return Stored(columns.features(place), label, plan.classes, _offered(p, plan.classes), depth)


def _weights(rows: np.ndarray, train: np.ndarray, plan: Plan, tree: int) -> np.ndarray:
    """How often each row is drawn for a tree, 0 for held-out rows."""
    out = np.zeros(len(rows), np.uint8)
    for a in range(0, len(rows), CHUNK):
        part = slice(a, a + CHUNK)
        out[part] = np.where(train[part], bootstrap(rows[part], plan.seed, tree), 0)
    return out


def _batch(batches: Iterable[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """The trees of one batch of one fit."""
    first, rows, train, label, place, columns = _read(batches, "fit", "batch")
    if not first:
        return
    fit, batch = first
    grower = _grower(place, label, columns, plan, plan.depth)
    del place
    total, gains, trees = np.zeros((int((~train).sum()), plan.classes or 1)), np.zeros(columns.width), 0
    del columns
    for tree in range(batch, plan.trees, plan.batches):
        weight = _weights(rows, train, plan, tree)
        drawn = float(weight.sum())
        if drawn:
            values, found = grower.tree(weight, ~train, np.random.default_rng([plan.seed, fit, tree]))
            total += values
            gains, trees = gains + found / drawn, trees + 1
    yield from _answer(fit, rows[~train], total, trees, gains)


def _leaf(batches: Iterable[pa.RecordBatch], plan: Plan, above: int, n: int) -> Iterator[pa.RecordBatch]:
    """The subtree below one leaf of one tree of ``n`` training rows; a leaf that only held-out rows reach answers with nothing."""
    (fit, tree, leaf), rows, train, label, place, columns = _read(batches, "fit", "tree", "leaf")
    weight = _weights(rows, train, plan, tree)
    if not weight.any():
        weight = train.astype(np.uint8)
    if not weight.any():
        yield from _answer(fit, rows[:0], np.zeros((0, plan.classes or 1)), 0, np.zeros(columns.width))
        return
    grower = _grower(place, label, columns, plan, max(plan.depth - above, 0))
    values, gains = grower.tree(weight, ~train, np.random.default_rng([plan.seed, fit, tree, leaf]))
    yield from _answer(fit, rows[~train], values, 1, gains / n)


def _spread(placed: DataFrame, by: list[str], sides: list[Column]) -> float:
    """Sum of squares around the mean, over groups and sides."""
    groups = placed.where("train").groupBy(*by).agg(sum((F.count("*") * F.var_pop(s) for s in sides), F.lit(0.0)).alias("ss"))
    return groups.agg(F.coalesce(F.sum("ss"), F.lit(0.0))).first()[0]


def _grown_apart(rows: DataFrame, fits: list[int], plan: Plan, task_rows: int) -> DataFrame:
    """Leaves of Spark's forest, deep enough for tasks, finished one by one."""
    answers = []

    def finisher(above: int, n: int):
        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _leaf(batches, plan, above, n)

        return finish

    for fit in fits:
        own = settle(rows.where(F.col("fit") == fit).withColumn("features", array_to_vector("x")))
        above = min(plan.depth, 3)
        while True:
            make = RandomForestClassifier if plan.classes else RandomForestRegressor
            model = make(numTrees=plan.trees, maxDepth=above, seed=plan.seed, leafCol="leaves", featureSubsetStrategy="sqrt" if plan.classes else "all").fit(own.where("train"))
            placed = settle(
                model.transform(own).select("fit", "row", "train", "label", "x", F.posexplode(vector_to_array("leaves")).alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))
            )
            largest = placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
            if largest <= task_rows or above >= min(plan.depth, 30):
                break
            above = min(above + 3, plan.depth, 30)
        sides = [(F.col("label") == c).cast("double") for c in range(plan.classes)] if plan.classes else [F.col("label")]
        n_train = max(own.where("train").count(), 1)
        # what the upper levels explain of the spread, on the scale of the subtrees' gains
        explained = (plan.trees * _spread(own, ["fit"], sides) - _spread(placed, ["tree", "leaf"], sides)) / n_train
        small = placed.join(placed.groupBy("tree", "leaf").agg(F.count("*").alias("n")), ["tree", "leaf"])
        finish = small.where(F.col("n") <= task_rows).drop("n").groupBy("tree", "leaf").applyInArrow(finisher(above, n_train), ANSWER)
        # a leaf at full depth that is still too large for a task is a leaf for good
        wide = small.where(F.col("n") > task_rows)
        means = wide.where("train").groupBy("tree", "leaf").agg(F.array(*[F.avg(s) for s in sides]).alias("total"))
        rest = wide.where(~F.col("train")).join(means, ["tree", "leaf"]).select("fit", "row", F.lit(1).cast("long").alias("trees"), "total")
        top = (model.featureImportances.toArray() * max(explained, 0.0)).tolist()
        answers.append(finish.unionByName(rest).unionByName(rows.sparkSession.createDataFrame([(fit, None, 0, top)], ANSWER)))
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out


def _grown_whole(rows: DataFrame, fits: list[int], plan: Plan) -> DataFrame:
    """Each batch of trees of a fit in a task of its own, which reads the rows of the fit; they are kept once, not dealt out to every batch."""

    def work(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batch(group, plan)

    answers = []
    for fit in fits:
        own = shelve(rows.where(F.col("fit") == fit))
        answers += [own.withColumn("batch", F.lit(batch)).coalesce(1).mapInArrow(work, ANSWER) for batch in range(min(plan.batches, plan.trees))]
    conf = rows.sparkSession.conf
    before = conf.get(UNION_BY_PARTITION, None)
    conf.set(UNION_BY_PARTITION, "false")
    try:
        return settle(reduce(DataFrame.union, answers))
    finally:
        conf.unset(UNION_BY_PARTITION) if before is None else conf.set(UNION_BY_PARTITION, before)


def forest(rows: DataFrame, fits: list[int], plan: Plan) -> tuple[DataFrame, DataFrame]:
    """From (fit, row, train, label, x): (fit, row, value) of the held-out rows, value being the mean of the trees (a share per class), and (fit, feature, importance)."""
    largest, width = rows.groupBy("fit").agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).agg(F.max("n"), F.max("p")).first()
    largest, task_rows = largest or 0, plan.task_rows or min(TASK_ROWS, TASK_CELLS // ((width or 0) + 1))
    if largest <= task_rows:
        answers = _grown_whole(rows, fits, plan)
    else:
        answers = settle(_grown_apart(rows, fits, plan, task_rows))
    cells = answers.where(F.col("row").isNotNull()).select("fit", "row", "trees", F.posexplode("total").alias("side", "v"))
    means = cells.groupBy("fit", "row", "side").agg((F.sum("v") / F.sum("trees")).alias("v"))
    values = means.groupBy("fit", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "v"))), lambda s: s["v"]).alias("value"))
    gains = answers.where(F.col("row").isNull()).select("fit", F.posexplode("total").alias("feature", "gain")).groupBy("fit", "feature").agg(F.sum("gain").alias("gain"))
    per_fit = gains.groupBy("fit").agg(F.sum("gain").alias("all"))
    return values, gains.join(per_fit, "fit").select("fit", "feature", F.coalesce(F.try_divide("gain", "all"), F.lit(0.0)).alias("importance"))


