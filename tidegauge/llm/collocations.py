"""Phrase collocations by weighted acyclic automata.

Every task cuts its texts into shards of a bounded number of words. The runs of up to five words that begin at each word are sorted and built, one after
the other, into an automaton: a run shares the states of the beginning it has in common with the one before, and each end carries how often the run occurs.
The automata are cut at fixed bounds of the sorted order into pages; tasks that own a range of that order unite the pages of
all shards, add up the weights of equal runs, and sum them by prefix, which gives the count of every phrase that begins in the range. Phrases
that reach over an end of a range come out as parts and are added up afterwards. The parts of a phrase are then looked up among the counted phrases.

Runs stop before a word that is too rare for any phrase: such words are told by a bit table of fixed size, whose errors let a rare word pass and never
drop one. Inside the automata the commonest words, a table of bounded size, go by their rank and all others by their hash, so a page needs no dictionary. The bounds come from a sample of the runs and decide nothing but the size of the ranges, so a phrase, however common, and a word that begins a
third of all runs are dealt over as many tasks as they need. A text or a language null counts as empty or ``und``; empty texts and texts without words add
nothing; very long texts are read in pieces and never cut between words; repeated rows count as often as they come; ties go by
frequency and then by the phrase's bytes; an empty table gives an empty result; other columns, whatever their names, are not looked at.

Words are known by a hash of 64 bits that holds their language; two of them share one with probability near 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import batches as B
from tidegauge.plans import order
from tidegauge.session import settle

U = np.uint64
LONGEST = 5
#: Words of a shard, runs of a page, and runs that a uniting task holds before it gives out what is complete.
SHARD_WORDS, PAGE_RUNS, UNITE_RUNS = 1 << 18, 1 << 14, 1 << 18
RANGE_RUNS = 1 << 21
MOST_RANGES = 4096
SAMPLED_PER_RANGE = 32
#: Bits of the table of words that are common enough, and how many of the commonest go by rank.
BITS, RANKED = 1 << 24, 1 << 18
#: Marks a word that goes by its hash.
HASHED = U(1 << 63)
#: Words end at these bytes, pieces only at the second kind.
BLANKS, STOPS = np.zeros(256, bool), np.zeros(256, bool)
BLANKS[[9, 32]] = True
STOPS[[ord(c) for c in ".,;:!?"]] = True
STOPS[10:14] = True
WORD = ~(BLANKS | STOPS)


def tokens(offsets: np.ndarray, data: np.ndarray, first: int, last: int, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, hash, begin, end) of each word of the rows first … last - 1; ``salts`` holds a number for each row's language."""
    low, high = int(offsets[first]), int(offsets[last])
    bounds = offsets[first : last + 1]
    out, passed = [], 0
    while low < high:
        end = B._cut(data, low, high, WORD) if high - low > B.PIECE else high
        piece = B.LOWER[data[low:end]]
        inside, stop = WORD[piece], STOPS[piece]
        here = bounds[(bounds > low) & (bounds < end)] - low
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        starts[here] |= inside[here]
        ends[here - 1] |= inside[here - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends)
        row = np.searchsorted(bounds, s + low, "right") - 1
        stops = np.cumsum(stop)
        if len(s):
            power, inverse = B._power_tables() if len(piece) <= B.PIECE else B._power_range(len(piece) + 1)
            total = np.cumsum((piece.astype(U) + U(1)) * power[: len(piece)], dtype=U)
            before = np.where(s > 0, total[s - 1], U(0))
            h = B.mix(((total[e] - before) * inverse[s] + (e - s + 1).astype(U)) ^ salts[row])
            # zero is kept for "no word"
            out.append((row.astype(np.int64) + passed + stops[s], np.where(h == 0, U(1), h), s + low, e + low + 1))
        passed += int(stops[-1]) if len(stops) else 0
        low = end
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _salts(languages: list[str]) -> np.ndarray:
    known = {name: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big") for name in set(languages)}
    return np.array([known[name] for name in languages], U)


def _strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Lower-case words at the given places."""
    sizes = end - begin
    offsets = np.zeros(len(begin) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], sizes)
    return pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(B.LOWER[data[at]])).cast(pa.string())


def _words_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(h, lang, word, n) of the words of each shard of a batch."""
    languages = batch.column(0).to_pylist()
    offsets, data = B.texts(batch.column(1))
    salts = _salts(languages)
    names = pa.array(languages, pa.string())
    for low, high in B.groups(offsets, 4 * B.GROUP):
        # only distinct words of a shard stand side by side, all words of a part of it
        held = []
        for first, last in B.groups(offsets[low : high + 1], B.GROUP // 2):
            _, h, begin, end = tokens(offsets, data, low + first, low + last, salts[low + first : low + last])
            found, at, n = np.unique(h, return_index=True, return_counts=True)
            held.append((found, n, begin[at], end[at]))
        h, n, begin, end = (np.concatenate(x) for x in zip(*held))
        if not len(h):
            continue
        found, at, back = np.unique(h, return_index=True, return_inverse=True)
        row = np.searchsorted(offsets, begin[at], "right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(found.view(np.int64)), names.take(pa.array(row)), _strings(data, begin[at], end[at]), pa.array(np.bincount(back, n).astype(np.int64))], ["h", "lang", "word", "n"],
        )


def count_words(rows: DataFrame) -> DataFrame:
    """(h, lang, word, n) of every word, from (lang, text)."""
    found = B.over_text(rows, "text", "h long, lang string, word string, n long", _words_of)
    return found.groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def bit_table(words: DataFrame, bits: int = BITS) -> np.ndarray:
    """Bits of the given words' hashes: at most bits / 64 rows reach the driver."""
    place = F.col("h").bitwiseAND(F.lit(bits - 1))
    held = words.groupBy(F.shiftright(place, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(h & 63 as int))")).alias("b")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[held["i"].to_numpy()] = held["b"].to_numpy()
    return table.view(U)


class Codes:
    """Code of each word that may be common: its rank from 1, or its marked hash; 0 for words that are too rare."""

    def __init__(self, bits: np.ndarray, ranked: np.ndarray) -> None:
        order = np.argsort(ranked)
        self.bits, self.hashes, self.ranks = bits, ranked[order], (order + 1).astype(U)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        place = h & U(len(self.bits) * 64 - 1)
        fine = (self.bits[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == 1
        out = np.where(fine, h | HASHED, U(0))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == h, self.ranks[at], out)
        return out


def coded(common: DataFrame, ranked: int = RANKED) -> DataFrame:
    """The common words with their ``code``."""
    placed = order.global_index(common, [F.desc("n"), F.asc("h")], name="place")
    return placed.withColumn("code", F.when(F.col("place") < ranked, F.col("place") + 1).otherwise(F.col("h").bitwiseOR(F.lit(-(1 << 63)))))


class Runs:
    """Sorted distinct runs of up to five words with their weights. Ids count the distinct words of the runs in the order of their codes, from 1; 0 is none."""

    def __init__(self, words: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> None:
        self.words, self.ids, self.weights = words, ids, weights

    def __len__(self) -> int:
        return len(self.weights)

    @classmethod
    def united(cls, hashes: np.ndarray, weights: np.ndarray) -> Runs:
        """From any rows of five codes; the weights of equal ones are added up."""
        words = np.unique(hashes)
        if not len(words) or words[0] != 0:
            words = np.concatenate([np.zeros(1, U), words])
        # column by column: only the ids, a half of the codes' size, stand beside them
        ids = np.empty(hashes.shape, np.uint32)
        for k in range(LONGEST):
            ids[:, k] = np.searchsorted(words, hashes[:, k])
        return cls(words, *_sorted(ids, weights))

    @classmethod
    def joined(cls, parts: list[Runs]) -> Runs:
        """All runs of ``parts``, which is emptied; the weights of equal ones are added up."""
        words = np.unique(np.concatenate([p.words for p in parts]))
        ids = np.empty((sum(len(p) for p in parts), LONGEST), np.uint32)
        weights = np.empty(len(ids), np.int64)
        at = len(ids)
        while parts:
            part = parts.pop()
            at -= len(part)
            ids[at : at + len(part)] = np.searchsorted(words, part.words).astype(np.uint32)[part.ids]
            weights[at : at + len(part)] = part.weights
        return cls(words, *_sorted(ids, weights))

    def before(self, bound: np.ndarray) -> int:
        """How many runs come before the run of codes ``bound``."""
        low, high = 0, len(self)
        for level in range(LONGEST):
            column = self.ids[low:high, level]
            at = int(np.searchsorted(self.words, bound[level]))
            place = low + int(np.searchsorted(column, at, "left"))
            if at == len(self.words) or self.words[at] != bound[level]:
                return place
            low, high = place, low + int(np.searchsorted(column, at, "right"))
        return low

    def slice(self, low: int, high: int) -> Runs:
        return Runs(self.words, self.ids[low:high], self.weights[low:high])

    def own(self) -> Runs:
        """A copy that holds its own words only, so that the runs it was cut from can go."""
        used = np.zeros(len(self.words), bool)
        used[0] = True
        used[self.ids] = True
        return Runs(self.words[used], (np.cumsum(used) - 1).astype(np.uint32)[self.ids], self.weights.copy())


def _sorted(ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # three words, then two, to a number: vocabularies of up to 2**21 words fit, larger ones are sorted word by word
    if len(ids) and int(ids.max()) >> 21:
        place = np.lexsort(ids.T[::-1])
    else:
        a, b, c, d, e = (ids[:, k].astype(U) for k in range(LONGEST))
        place = np.lexsort(((d << U(21)) | e, (a << U(42)) | (b << U(21)) | c))
        del a, b, c, d, e
    ids, weights = ids[place], weights[place]
    del place
    fresh = np.ones(len(ids), bool)
    fresh[1:] = False
    for k in range(LONGEST):
        fresh[1:] |= ids[1:, k] != ids[:-1, k]
    at = np.flatnonzero(fresh)
    return ids[at], np.add.reduceat(weights, at) if len(at) else weights


def runs_of(piece: np.ndarray, h: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of five codes (0 beyond the end) for every word with a word after it in its piece, up to a word that is not common."""
    n, h = len(h), codes(h)
    fine = h != 0
    rows = np.zeros((n, LONGEST), U)
    alive = fine.copy()
    rows[:, 0] = np.where(alive, h, U(0))
    for k in range(1, LONGEST):
        nxt = np.zeros(n, bool)
        nxt[: n - k] = fine[k:] & (piece[k:] == piece[: n - k]) if n > k else False
        alive &= nxt
        rows[: max(n - k, 0), k] = np.where(alive[: max(n - k, 0)], h[k:], U(0))
    rows = rows[rows[:, 1] != 0]
    return rows, np.ones(len(rows), np.int64)


def pack(runs: Runs) -> bytes:
    """An automaton as bytes: of each run how many words it shares with the one before, its size and weight, and the words that follow, byte by byte."""
    ids = runs.ids
    same = np.zeros(ids.shape, bool)
    same[1:] = np.logical_and.accumulate(ids[1:] == ids[:-1], axis=1)
    size = (ids != 0).sum(axis=1)
    shared = np.minimum(same.sum(axis=1), size)
    tail = (np.arange(LONGEST) >= shared[:, None]) & (np.arange(LONGEST) < size[:, None])
    words = runs.words[ids[tail]]
    hashed = words >= HASHED
    small = np.where(hashed, U(0), words).astype(np.uint32)
    extra = runs.weights[runs.weights >= 255].astype(np.int64)
    head = np.array([len(runs), len(words), len(extra), int(hashed.sum())], np.int64)
    planes = np.ascontiguousarray(small.view(np.uint8).reshape(-1, 4).T)
    body = b"".join(x.tobytes() for x in (head, (shared * 8 + size).astype(np.uint8), np.minimum(runs.weights, 255).astype(np.uint8), planes, extra, words[hashed]))
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(page: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows of five codes and weights."""
    body = pa.decompress(page[8:], decompressed_size=int.from_bytes(page[:8], "little"), codec="zstd", asbytes=True)
    n, n_words, n_extra, n_hashed = (int(x) for x in np.frombuffer(body, np.int64, 4))
    at = 32
    shape = np.frombuffer(body, np.uint8, n, at)
    weights = np.frombuffer(body, np.uint8, n, at + n).astype(np.int64)
    at += 2 * n
    words = np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * n_words, at).reshape(4, -1).T).view(np.uint32).reshape(-1).astype(U)
    at += 4 * n_words
    weights[weights == 255] = np.frombuffer(body, np.int64, n_extra, at)
    words[words == 0] = np.frombuffer(body, U, n_hashed, at + 8 * n_extra)
    shared, size = shape >> 3, shape & 7
    runs = np.zeros((n, LONGEST), U)
    fresh = (np.arange(LONGEST) >= shared[:, None]) & (np.arange(LONGEST) < size[:, None])
    runs[fresh] = words
    for k in range(LONGEST):  # what is shared is what the last run with a word of its own there had
        own = fresh[:, k] | (size <= k)
        runs[:, k] = runs[np.maximum.accumulate(np.where(own, np.arange(n), 0)), k]
    return runs, weights


def prefix_sums(runs: Runs, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(codes, counts, length) of the phrases of two to five words that reach ``least``, and of those that the first or the last run begins with."""
    if not len(runs):
        return
    ids = runs.ids
    changed = np.zeros(len(ids), bool)
    changed[0] = True
    changed[1:] = ids[1:, 0] != ids[:-1, 0]
    for k in range(2, LONGEST + 1):
        changed[1:] |= ids[1:, k - 1] != ids[:-1, k - 1]
        at = np.flatnonzero(changed)
        counts = np.add.reduceat(runs.weights, at)
        keep = counts >= least
        keep[[0, -1]] = True
        keep &= ids[at, k - 1] != 0
        yield runs.words[ids[at[keep], :k]], counts[keep], k


def _keys(bounds: np.ndarray) -> list[bytes]:
    return [row.astype(">u8").tobytes() for row in bounds]


def pages(rows: DataFrame, codes: Codes, bounds: np.ndarray, shard_words: int = SHARD_WORDS, page_runs: int = PAGE_RUNS) -> DataFrame:
    """(range, first, page): the automata of all shards, cut at ``bounds`` and after a number of runs; ``first`` is a page's first run."""

    def emit(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        runs = Runs.united(np.concatenate([h for h, _ in held]), np.concatenate([w for _, w in held]))
        cuts = [0, *(runs.before(b) for b in bounds), len(runs)]
        out: list[tuple[int, bytes, bytes]] = []
        for r, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
            for at in range(low, high, page_runs):
                part = runs.slice(at, min(at + page_runs, high))
                out.append((r, _keys(part.words[part.ids[:1]])[0], pack(part)))
        for i in range(0, len(out), 64):
            cells = list(zip(*out[i : i + 64]))
            yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.binary()), pa.array(cells[2], pa.binary())], ["range", "first", "page"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            salts = _salts(batch.column(0).to_pylist())
            offsets, data = B.texts(batch.column(1))
            for first, last in B.groups(offsets, B.GROUP // 4):
                piece, h, _, _ = tokens(offsets, data, first, last, salts[first:last])
                found = runs_of(piece, h, codes)
                if len(found[0]):
                    held.append(found)
                    n += len(found[0])
                if n >= shard_words:
                    yield from emit(held)
                    held, n = [], 0
        if held:
            yield from emit(held)

    return rows.mapInArrow(run, "range int, first binary, page binary")


def sampled_bounds(rows: DataFrame, codes: Codes, ranges: int, total: int) -> np.ndarray:
    """At most ``ranges`` - 1 runs that cut the order into parts of about the same size, from a sample of texts of bounded size."""
    if ranges < 2:
        return np.zeros((0, LONGEST), U)
    wanted = SAMPLED_PER_RANGE * ranges
    stride = 16

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        salts = _salts(batch.column(0).to_pylist())
        offsets, data = B.texts(batch.column(1))
        for first, last in B.groups(offsets):
            piece, h, _, _ = tokens(offsets, data, first, last, salts[first:last])
            found = runs_of(piece, h, codes)[0][::stride]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(_keys(found), pa.binary())], ["run"])

    part = min(1.0, 2.0 * stride * wanted / max(total, 1))
    drawn = B.over_text(rows.sample(part, 5) if part < 1 else rows, "text", "run binary", work)
    # a run is drawn as often as it occurs, so that common ones get bounds of their own
    found = drawn.orderBy(F.rand(9)).limit(wanted).toArrow()["run"].to_pylist()
    found.sort()
    picks = dict.fromkeys(found[len(found) * i // ranges] for i in range(1, ranges)) if found else {}
    return np.frombuffer(b"".join(sorted(picks)), ">u8").astype(U).reshape(-1, LONGEST)


def unite(paged: DataFrame, least: int, unite_runs: int = UNITE_RUNS) -> DataFrame:
    """(g, n): counts of phrases, in parts where a phrase reaches over a cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # by their own words' ids, half as large as codes
        held: list[Runs] = []
        n, now = 0, None

        def give(runs: Runs) -> Iterator[pa.RecordBatch]:
            for phrases, counts, k in prefix_sums(runs, least):
                for i in range(0, len(counts), 1 << 16):
                    part = phrases[i : i + (1 << 16)]
                    lists = B.lists(np.ascontiguousarray(part).view(np.int64).reshape(-1), np.full(len(part), k))
                    yield pa.RecordBatch.from_arrays([lists, pa.array(counts[i : i + (1 << 16)])], ["g", "n"])

        limit = unite_runs
        for batch in batches:
            for r, first, page in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (r != now or n >= limit):
                    runs = Runs.joined(held)
                    # pages come in the order of their first runs: nothing before this one's can follow
                    done = runs.before(np.frombuffer(first, ">u8").astype(U)) if r == now else len(runs)
                    yield from give(runs.slice(0, done))
                    rest = runs.slice(done, len(runs))
                    held, n = [rest.own()] if len(rest) else [], len(rest)
                    del runs, rest
                    limit = unite_runs if r != now else max(unite_runs, 2 * n)
                now = r
                held.append(Runs.united(*unpack(page)))
                n += len(held[-1])
        if held:
            yield from give(Runs.joined(held))

    dealt = paged.repartition("range").sortWithinPartitions("range", "first")
    return dealt.mapInArrow(run, "g array<long>, n long")


def _part(phrase: str, start: Column, size: Column) -> Column:
    return F.slice(phrase, start, size)


def score(words: DataFrame, phrases: DataFrame, totals: DataFrame, least: int, most: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score from counted words (code, lang, word, n), phrases (g, a) and words per language."""
    # a part of a phrase is at least as frequent as the phrase, so it is among the counted ones
    parts = phrases.select("g", "a").unionByName(words.select(F.array("code").alias("g"), F.col("n").alias("a")))
    cuts = phrases.select("g", "a", F.explode(F.sequence(F.lit(1), F.size("g") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": _part("g", F.lit(1), F.col("k")), "right": _part("g", F.col("k") + 1, F.size("g") - F.col("k"))})
    look = lambda side, name: parts.select(F.col("g").alias(side), F.col("a").alias(name))
    cuts = cuts.join(look("left", "l"), "left").join(look("right", "r"), "right")
    languages = words.select(F.col("code").alias("first"), "lang")
    # the sides of a cut repeat the first word; its language comes with the word
    cuts = cuts.withColumn("first", F.col("g")[0]).join(languages, "first").join(F.broadcast(totals), "lang")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    cuts = cuts.withColumns({"top": wide("a") * wide("n") * F.lit(1000).cast("decimal(4,0)"), "under": wide("l") * wide("r")}).withColumn("score", F.expr("top div under"))
    lowest = cuts.groupBy("g").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("x"), F.first("a").alias("a"), F.first("n").alias("n"), F.first("lang").alias("lang")
    )
    # a phrase goes if a longer one holds it every time
    longer = phrases.where(F.size("g") > 2).select("g", "a")
    spots = F.flatten(F.transform(F.sequence(F.lit(2), F.size("g") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("g") - m + 1), lambda i: F.slice("g", i, m))))
    inside = longer.select(F.explode(F.array_distinct(spots)).alias("g"), F.col("a").alias("held")).groupBy("g").agg(F.max("held").alias("held"))
    own = lowest.join(inside, "g", "left").where(F.col("held").isNull() | (100 * F.col("held") < 100 * F.col("a")))
    near = own.select("g", "lang", "a", "n", "x.*").withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= most)
    spelt = near.select("g", F.posexplode("g").alias("i", "code")).join(words.select("code", "word"), "code").groupBy("g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")
    )
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return near.join(spelt, "g").withColumn("rank", F.row_number().over(by_score).cast("long")).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, most: int = 2000,
    range_runs: int = RANGE_RUNS, shard_words: int = SHARD_WORDS, page_runs: int = PAGE_RUNS, unite_runs: int = UNITE_RUNS, bits: int = BITS, ranked: int = RANKED,
) -> DataFrame:
    """The ``most`` highest-scoring phrases of two to five words of each language among those that occur at least ``least`` times."""
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = settle(count_words(rows))
    totals = settle(words.groupBy("lang").agg(F.sum("n").alias("n")))
    common = settle(coded(words.where(F.col("n") >= least), ranked))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # at most ``ranked`` numbers
    first = common.where(F.col("place") < ranked).select("place", "h").toArrow().sort_by("place")
    codes = Codes(bit_table(common, bits), first["h"].to_numpy().view(U) if first.num_rows else np.zeros(0, U))
    ranges = int(min(MOST_RANGES, max(1, -(-total // range_runs))))
    bounds = sampled_bounds(rows, codes, ranges, total)
    counted = unite(pages(rows, codes, bounds, shard_words, page_runs), least, unite_runs).groupBy("g").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return score(common, settle(counted), totals, least, most)
