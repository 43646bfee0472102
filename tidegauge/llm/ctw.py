"""Language-model scores by context-tree weighting over bytes.

A byte is predicted as eight binary decisions. Each decision has a tree of contexts (the last 0 … DEPTH bytes); every context keeps how often it saw
0 and 1, estimates by Krichevsky-Trofimov, and mixes its estimate with those of all longer contexts by the weight that the training text gives them.
Texts are lowered (A-Z) and end with a byte that no UTF-8 text holds, so the scores are probabilities of whole texts.

Training counts every (context, byte) and every word in one pass over all training rows; both tables grow with the corpus. Trees are dealt out by
the two bytes just before the predicted one and weighted where they lie. The weighted table is then worked through in blocks of a bounded number of
entries: each is a bounded broadcast and one narrow pass over the texts, and the parts of a text's score are added. One block after another is kept by the driver,
let go when its pass is through, so that the driver holds two blocks however many there are. Word counts grow with the corpus, so the words of a text
are joined to them in a shuffle; only a fixed number of the most frequent words, which every text holds, is looked up from a bounded broadcast.

Null and empty texts consist of their end alone; a null id counts as empty text when rows are dealt to training; repeated rows are returned as often as
they come; without training rows every probability is the estimators' prior; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import batches as B
from tidegauge.session import settle, shelve

DEPTH = 5
#: Trees are dealt out by so many preceding bytes; shorter contexts are few (65,280 decisions) and weighted on the driver.
SPLIT = 2
#: Counted contexts that one task weights.
PART_ENTRIES = 1 << 19
#: Most frequent words whose counts are broadcast (16 bytes each).
HEAD = 8192
#: Table entries that one pass holds (about 20 bytes each in a task).
BLOCK_ENTRIES = 1 << 21
#: Pairs that training never saw whose logs a worker keeps (16 bytes each).
MET = 1 << 20
END = 0xFF
END_TOKEN = 1
WORD, CONTEXT = 0, 1
_PENDING = 1 << 21


def _slice() -> int:
    """Bytes of text that are worked on at a time: every byte takes about 60 while its contexts are counted or looked up."""
    return max(B.GROUP // 4, 1)


def contexts(offsets: np.ndarray, data: np.ndarray, first: int, last: int, depth: int):
    """(row counted from ``first``, key) of every byte and end: the key's lowest byte is what follows the others, latest lowest."""
    for low in range(first, last):
        if offsets[low + 1] - offsets[low] > _slice():  # one long text, a slice at a time
            begin, end = int(offsets[low]), int(offsets[low + 1])
            for at in range(begin, end + 1, _slice()):
                stop = min(at + _slice(), end + 1)
                body = B.LOWER[data[max(begin, at - depth) : min(stop, end)]]
                lead = np.full(depth - (at - max(begin, at - depth)), END, np.uint8)
                run = np.concatenate([lead, body, np.full(int(stop > end), END, np.uint8)])
                yield np.full(len(run) - depth, low - first), _keys(run, depth)
            return  # such a text is a run of its own
    n, sizes = last - first, np.diff(offsets[first : last + 1])
    run = np.full(int(sizes.sum()) + depth * (n + 1), END, np.uint8)
    begins = np.cumsum(sizes) - sizes + depth * np.arange(1, n + 1)
    owner = np.repeat(np.arange(n), sizes)
    place = np.arange(len(owner)) + depth * (owner + 1)
    run[place] = B.LOWER[data[offsets[first] : offsets[last]]]
    keys = _keys(run, depth)
    # keys[i] belongs to run[i + depth]
    yield np.concatenate([owner, np.arange(n)]), keys[np.concatenate([place, begins + sizes]) - depth]


def _keys(run: np.ndarray, depth: int) -> np.ndarray:
    n = len(run) - depth
    keys = np.zeros(max(n, 0), np.int64)
    for j in range(depth + 1):
        keys = (keys << 8) | run[j : j + n]
    return keys


def _count(values: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if times is None:
        return np.unique(values, return_counts=True)
    keys, where = np.unique(values, return_inverse=True)
    return keys, np.bincount(where, weights=times).astype(np.int64)


class _Counter:
    """Counts of one kind of key, compacted whenever enough are waiting."""

    def __init__(self, kind: int) -> None:
        self.kind, self.waiting, self.size = kind, [], 0

    def add(self, values: np.ndarray):
        self.waiting.append(_count(values))
        self.size += len(self.waiting[-1][0])
        if self.size > _PENDING:
            self._compact()
            if self.size > _PENDING // 2:
                yield from self.flush()

    def _compact(self) -> None:
        if len(self.waiting) > 1:
            merged = _count(np.concatenate([k for k, _ in self.waiting]), np.concatenate([n for _, n in self.waiting]))
            self.waiting = [merged]
        self.size = sum(len(k) for k, _ in self.waiting)

    def flush(self):
        self._compact()
        for keys, times in self.waiting:
            for at in range(0, len(keys), 1 << 17):
                part = keys[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), self.kind, np.int32)), pa.array(part), pa.array(times[at : at + (1 << 17)].astype(np.int64))], ["kind", "key", "n"])
        self.waiting, self.size = [], 0


def _gather(depth: int):
    def work(batch: pa.RecordBatch, state):
        tokens, trees = state
        offsets, data = B.texts(batch.column(0))
        for first, last in B.groups(offsets, _slice()):
            _, hashes = B.words(offsets, data, first, last, B.NON_SPACE)
            yield from tokens.add(np.concatenate([B.signed(hashes), np.full(last - first, END_TOKEN)]))
            for _, keys in contexts(offsets, data, first, last, depth):
                yield from trees.add(keys)

    def finish(state):
        for counter in state:
            yield from counter.flush()

    return work, lambda: (_Counter(WORD), _Counter(CONTEXT)), finish


def corpus_counts(training: DataFrame, text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): how often each word and each context with its next byte stands in the training rows."""
    work, begin, finish = _gather(depth)
    found = B.over_text(training.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "kind int, key long, n long", work, begin, finish)
    return settle(found.groupBy("kind", "key").agg(F.sum("n").alias("n")))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument up by eight."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _nodes(byte: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight decisions: the node (the bits decided before, after a leading 1), and the bit."""
    return [((1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1) for k in range(8)]


def _levels(keys: np.ndarray, times: np.ndarray, depth: int) -> list[dict]:
    """Per context length from SPLIT on: id (context, node), counts, log block probability, weighted probability. Before them: sums for the next shorter contexts."""
    byte, context = keys & 255, keys >> 8
    node = np.concatenate([v for v, _ in _nodes(byte)])
    bit = np.concatenate([b for _, b in _nodes(byte)])
    ident, weight = (np.tile(context, 8) << 8) | node, np.tile(times, 8).astype(float)
    levels: list[dict] = [{} for _ in range(depth + 1)]
    ids, where = np.unique(ident, return_inverse=True)
    ones = np.bincount(where, weights=weight * bit, minlength=len(ids))
    zeros = np.bincount(where, weights=weight * (1 - bit), minlength=len(ids))
    below = np.zeros(len(ids))
    for d in range(depth, SPLIT - 1, -1):
        level = levels[d] = _mixed(zeros, ones, below, d == depth)
        # the parent forgets the earliest byte
        level["id"], level["parent"] = ids, (((ids >> 8) & ((1 << (8 * (d - 1))) - 1)) << 8) | (ids & 255)
        ids, where = np.unique(level["parent"], return_inverse=True)
        zeros, ones, below = (np.bincount(where, weights=x, minlength=len(ids)) for x in (zeros, ones, level["weighted"]))
    levels[SPLIT - 1] = {"id": ids, "zeros": zeros, "ones": ones, "below": below}
    return levels


def _mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray, deepest: bool = False) -> dict:
    """A level's weighted block probability, the share of its own estimate in it, and its own estimate of a 1."""
    block = _log_kt(zeros, ones)
    weighted = block if deepest else np.logaddexp(block, below) + math.log(0.5)
    share = np.ones(len(block)) if deepest else np.exp(np.minimum(math.log(0.5) + block - weighted, 0.0))
    return {"weighted": weighted, "share": share, "one": (ones + 0.5) / (zeros + ones + 1.0)}


def _all(batches, *names: str) -> list[np.ndarray]:
    """Whole columns of one partition, whose size the caller bounds by the number of partitions."""
    parts = list(batches)
    return [np.concatenate([p.column(n).to_numpy() for p in parts]) if parts else np.zeros(0, np.int64) for n in names]


def _shallow(trees: DataFrame, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each decision after one byte (65,536 places: byte, node): the mass of a 1 from the two shortest contexts, and the share left to longer ones."""

    def work(batches):
        keys, times = _all(batches, "key", "n")
        if len(keys):
            top = _levels(keys, times, depth)[SPLIT - 1]
            yield pa.RecordBatch.from_arrays([pa.array(top["id"], pa.int64()), pa.array(top["zeros"]), pa.array(top["ones"]), pa.array(top["below"])], ["id", "zeros", "ones", "below"])

    parts = trees.mapInArrow(work, "id long, zeros double, ones double, below double")
    # one row per preceding byte and decision, 65,280 at most
    rows = parts.groupBy("id").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).toArrow()
    ids, zeros, ones, below = (c.to_numpy() for c in rows.columns)
    level = _mixed(zeros, ones, below)
    node = ids & 255
    counts = [np.bincount(node, weights=x, minlength=256) for x in (zeros, ones, level["weighted"])] if len(ids) else [np.zeros(256)] * 3
    root = _mixed(*counts)
    own, rest = root["share"] * root["one"], 1 - root["share"]
    own, rest = np.tile(own, 256), np.tile(rest, 256)
    own[ids] += rest[ids] * level["share"] * level["one"]
    rest[ids] *= 1 - level["share"]
    return own, rest


def _weigh(own1: np.ndarray, rest1: np.ndarray, depth: int):
    """Predictions of whole trees: log10 p and count of every counted (context, byte); of every decision after fewer bytes, the mass of a 1 and the share left."""

    def work(batches):
        keys, times = _all(batches, "key", "n")
        if not len(keys):
            return
        levels = _levels(keys, times, depth)
        own = rest = None
        for d in range(SPLIT, depth + 1):
            level = levels[d]
            up = level["parent"] if d == SPLIT else np.searchsorted(levels[d - 1]["id"], level["parent"])
            before, left = (own1, rest1) if d == SPLIT else (own, rest)
            own, rest = before[up] + left[up] * level["share"] * level["one"], left[up] * (1 - level["share"])
            if d < depth:
                yield from _entries(d, level["id"], own, rest)
        log = np.zeros(len(keys))
        for node, bit in _nodes(keys & 255):
            one = own[np.searchsorted(levels[depth]["id"], ((keys >> 8) << 8) | node)]
            log += np.log10(np.where(bit == 1, one, 1 - one))
        yield from _entries(0, keys, log, times)

    return work


def _entries(level: int, keys: np.ndarray, values: np.ndarray, more: np.ndarray):
    for at in range(0, len(keys), 1 << 17):
        part = slice(at, at + (1 << 17))
        latest = (keys[part] >> 8) & 0xFFFF
        yield pa.RecordBatch.from_arrays(
            [pa.array(latest.astype(np.int32)), pa.array(np.full(len(latest), level, np.int32)), pa.array(keys[part]), pa.array(values[part].astype(np.float32)), pa.array(more[part].astype(np.float32))],
            ["latest", "level", "key", "value", "more"],
        )


def train(counts: DataFrame, depth: int = DEPTH, part_entries: int = PART_ENTRIES) -> tuple[np.ndarray, DataFrame]:
    """(mass and share of each decision after one byte, (latest, level, key, value, more) table as ``_weigh`` says; level 0 holds the counted bytes)."""
    contexts_only = counts.where(F.col("kind") == CONTEXT)
    latest = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    # trees of the same two preceding bytes lie in one partition, so everything longer is weighted there
    parts = contexts_only.count() // part_entries + 1
    trees = contexts_only.select("key", "n", latest.alias("latest")).repartition(max(parts, 8), "latest").select("key", "n")
    own, rest = _shallow(trees, depth)
    table = settle(trees.mapInArrow(_weigh(own, rest, depth), "latest int, level int, key long, value float, more float"))
    return np.array([own, rest]), table


def block_of(latest, blocks: int):
    """The block of a pair of preceding bytes, for numbers and columns alike."""
    return latest * 40_503 % 65_521 % blocks


def _held(table: DataFrame, block: int, blocks: int, depth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries of one block, about ``BLOCK_ENTRIES``: per level, sorted keys and the two values."""
    mine = table.where(block_of(F.col("latest").cast("long"), blocks) == block) if blocks > 1 else table
    held = mine.select("level", "key", "value", "more").toArrow()
    level = held["level"].to_numpy()
    out = []
    for d in (0, *range(SPLIT, depth)):
        at = np.flatnonzero(level == d)
        keys = held["key"].to_numpy()[at]
        order = np.argsort(keys)
        at = at[order]
        out.append((keys[order], *(held[name].to_numpy()[at] for name in ("value", "more"))))
    return out


class Predictor:
    """One block of the table, ready for lookups."""

    def __init__(self, shallow: np.ndarray, block: int, blocks: int, levels: list, depth: int) -> None:
        self.shallow, self.depth, self.levels = shallow, depth, levels[1:]
        self.here = block_of(np.arange(1 << 16), blocks) == block
        self.keys, self.logs, times = levels[0]
        self.index = pd.Index(self.keys)
        self.met = np.zeros(0, np.int64), np.zeros(0)
        self.upto = np.concatenate([[0.0], np.cumsum(times, dtype=np.float64)])

    def _times(self, low: np.ndarray, n: int) -> np.ndarray:
        """How often training saw the ``n`` keys from ``low`` on."""
        return self.upto[np.searchsorted(self.keys, low + n)] - self.upto[np.searchsorted(self.keys, low)]

    def _unseen(self, keys: np.ndarray) -> np.ndarray:
        """log10 p of (context, byte) pairs that training never saw: each decision by its longest counted context."""
        log = np.zeros(len(keys))
        for k, (node, bit) in enumerate(_nodes(keys & 255)):
            at = (((keys >> 8) & 255) << 8) | node
            own, rest = self.shallow[0][at], self.shallow[1][at]
            for d, (ids, mass, share) in zip(range(SPLIT, self.depth), self.levels):
                wanted = (((keys >> 8) & ((1 << (8 * d)) - 1)) << 8) | node
                at = np.minimum(np.searchsorted(ids, wanted), max(len(ids) - 1, 0))
                known = ids[at] == wanted if len(ids) else np.zeros(len(keys), bool)
                if known.any():
                    own, rest = np.where(known, mass[at], own), np.where(known, share[at], rest)
            # the longest context's counts lie side by side among the sorted keys
            half = 1 << (7 - k)
            low = ((keys >> 8) << 8) | ((keys & 255) >> (8 - k) << (8 - k))
            zeros, ones = self._times(low, half), self._times(low + half, half)
            one = own + rest * np.where(zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1.0), 0.5)
            log += np.log10(np.where(bit == 1, one, 1 - one))
        return log

    def _remembered(self, odd: np.ndarray) -> np.ndarray:
        """``_unseen`` of distinct sorted pairs; those of earlier slices, up to ``MET`` of them, are kept."""
        keys, logs = self.met
        at = np.minimum(np.searchsorted(keys, odd), max(len(keys) - 1, 0))
        old = keys[at] == odd if len(keys) else np.zeros(len(odd), bool)
        out, new = np.zeros(len(odd)), odd[~old]
        out[old], out[~old] = logs[at[old]], self._unseen(new)
        if len(keys) + len(new) > MET:
            self.met = odd[:MET], out[:MET]
        elif len(new):
            keys, logs = np.concatenate([keys, new]), np.concatenate([logs, out[~old]])
            order = np.argsort(keys, kind="stable")
            self.met = keys[order], logs[order]
        return out

    def log10(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        mine = self.here[(keys >> 8) & 0xFFFF]
        wanted = keys if mine.all() else keys[mine]
        got = np.zeros(len(wanted))
        at = self.index.get_indexer(wanted)
        known = at >= 0
        if known.any():
            got[known] = self.logs[at[known]]
        if not known.all():
            odd, back = np.unique(wanted[~known], return_inverse=True)
            got[~known] = self._remembered(odd)[back]
        out[mine] = got
        return out


#: The block that this Python worker holds, for the tasks that follow in it.
_loaded: dict = {}


def _predictor(model, name: str, depth: int) -> Predictor:
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Predictor(*model.value, depth)
    return _loaded[name]


def _score(model, head, depth: int):
    ready: list = []
    name = uuid.uuid4().hex

    def work(batch: pa.RecordBatch):
        if not ready:
            ready.append(_predictor(model, name, depth))
            ready.append(head.value if head is not None else None)
        offsets, data = B.texts(batch.column("text"))
        for first, last in B.groups(offsets, _slice()):
            n = last - first
            logs = np.zeros(n)
            for rows, keys in contexts(offsets, data, first, last, depth):
                logs += np.bincount(rows, weights=ready[0].log10(keys), minlength=n)
            part = batch.slice(first, n)
            columns = [part.column("id"), part.column("key"), pa.array(logs)]
            names = ["id", "key", "score"]
            if ready[1] is not None:
                keys, times = ready[1]
                rows, hashes = B.words(offsets, data, first, last, B.NON_SPACE)
                hashes = B.signed(hashes)
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                common = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                logs = np.bincount(rows[common], weights=np.log10(times[at[common]] + 0.5), minlength=n) if common.any() else np.zeros(n)
                known = np.bincount(rows[common], minlength=n)
                r, h = rows[~common], hashes[~common]
                order = np.lexsort((h, r))
                r, h = r[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                starts = np.flatnonzero(new)
                counts = np.bincount(r[starts], minlength=n) if len(starts) else np.zeros(n, np.int64)
                begins = np.cumsum(counts) - counts
                # the end stands first in every list, so each text keeps a row
                words = pa.StructArray.from_arrays(
                    [pa.array(np.insert(h[starts], begins, END_TOKEN), pa.int64()), pa.array(np.insert(np.diff(np.append(starts, len(h))), begins, 1), pa.int64())], ["word", "times"],
                )
                columns += [pa.array(B.per_row(rows, n) + 1), pa.array(known, pa.int64()), pa.array(logs), B.lists(words, counts + 1)]
                names += ["n_tokens", "known", "logs", "words"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return work


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, head: int = HEAD, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs``, learning from ``training`` (rows with the same text column)."""
    if not SPLIT <= depth <= 6:
        raise ValueError("depth must be 2 … 6")
    spark = docs.sparkSession
    context = spark.sparkContext
    counts = corpus_counts(training, text_col, depth)
    shallow, table = train(counts, depth)
    words = counts.where(F.col("kind") == WORD).select(F.col("key").alias("word"), F.col("n").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).head()
    top = sorted(words.where(F.col("word") != END_TOKEN).orderBy(F.col("c").desc(), "word").limit(head).collect())
    common = context.broadcast((np.array([r["word"] for r in top], np.int64), np.array([r["c"] for r in top], float)))

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text, F.length(text)).alias("key"), text.alias("text"), F.octet_length(text).alias("n_bytes"))
    kind = source.schema["id"].dataType.simpleString()
    blocks = table.count() // block_entries + 1
    first = context.broadcast((shallow, 0, blocks, _held(table, 0, blocks, depth)))
    scored = B.over_text(source, "text", f"id {kind}, key long, score double, n_tokens long, known long, logs double, words array<struct<word: long, times: long>>", _score(first, common, depth))
    each = scored.select("id", "key", "score", "n_tokens", "known", "logs", F.posexplode("words").alias("pos", "entry")).select(
        "id", "key", F.when(F.col("pos") == 0, F.struct("score", "n_tokens", "known", "logs")).alias("own"), F.col("entry.word").alias("word"), F.col("entry.times").alias("times"),
    )
    joined = each.join(words, "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    summed = joined.groupBy("id", "key").agg(
        F.max("own").alias("own"), F.count("own").alias("copies"), F.sum(F.log10(c + 0.5) * F.col("times")).alias("rare"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"),
    )
    if blocks > 1:
        parts = None
        for i in range(1, blocks):
            model = context.broadcast((shallow, i, blocks, _held(table, i, blocks, depth)))
            part = shelve(B.over_text(source, "text", f"id {kind}, key long, score double", _score(model, None, depth)))
            # the driver keeps a copy of what it broadcasts
            model.destroy()
            parts = part if parts is None else parts.unionByName(part)
        # equal rows have equal parts, and as many of them as ``copies`` says
        parts = parts.groupBy("id", "key").agg(F.sum("score").alias("more")).withColumnsRenamed({"id": "id2", "key": "key2"})
        summed = summed.join(parts, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))).withColumn("more", F.col("more") / F.col("copies"))
    else:
        summed = summed.withColumn("more", F.lit(0.0))
    norm = math.log10(total + 0.5 * (distinct + 1)) if total else math.log10(0.5)
    return summed.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select(
        F.col("id").alias(id_col), F.col("own.n_tokens").alias("n_tokens"), (F.col("own.known") + (F.col("rare_known") / F.col("copies")).cast("long")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("own.logs") + F.col("rare") / F.col("copies") - F.col("own.n_tokens") * F.lit(norm)).alias("base_score"),
        (F.col("own.score") + F.col("more")).alias("score"),
    )
