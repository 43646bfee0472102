"""Words of Arrow text columns as numpy arrays, about a megabyte of text at a time.

Words are maximal runs of bytes of one class in the UTF-8 text with A-Z lowered. All separators are ASCII, so working
on bytes never cuts a character. A word is known by a 64-bit hash; two different words share one with probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes: everything but blank, tab, newline, vertical tab, form feed, carriage return.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Word bytes: digits, a-z, and all of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Key of a null group; other keys start with "=".
NULL_MARK = "null"
PIECE = 1 << 20
GROUP = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, up to the longest piece met so far."""
    if not _powers:
        _powers.extend(_power_range(PIECE + 1))
    return _powers[0], _powers[1]


def _power_range(n: int) -> list[np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, U)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (one more than rows) and bytes of a string column; a null text is an empty one."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return places, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def groups(offsets: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Runs of rows holding at most ``limit`` bytes each; a longer text is a run of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(last, first + 1)
        yield first, min(last, len(offsets) - 1)
        first = min(last, len(offsets) - 1)


def _cut(data: np.ndarray, low: int, high: int, word: np.ndarray) -> int:
    """The end of a piece that starts at ``low``: never inside a word."""
    end = min(low + PIECE, high)
    while end < high and word[data[end]] and word[data[end - 1]]:
        back = data[max(low, end - 4096) : end]
        gaps = np.flatnonzero(~word[back])
        if len(gaps) and end - len(back) + gaps[-1] + 1 > low:
            return int(end - len(back) + gaps[-1] + 1)
        end = min(end + 4096, high)  # one very long word: let the piece grow
    return end


def words(offsets: np.ndarray, data: np.ndarray, first: int, last: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word counted from ``first``, hash of each word) for the rows first … last - 1, in text order."""
    rows, hashes, low, high = [], [], int(offsets[first]), int(offsets[last])
    bounds = offsets[first : last + 1]
    # a text boundary ends a word too, so pieces may end there as well as at separators
    while low < high:
        end = _cut(data, low, high, LOWERED[id(word)]) if high - low > PIECE else high
        piece = LOWER[data[low:end]]
        inside = word[piece]
        here = bounds[(bounds > low) & (bounds < end)] - low
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        starts[here] |= inside[here]
        ends[here - 1] |= inside[here - 1]
        s, e = np.flatnonzero(starts), np.flatnonzero(ends)
        if len(s):
            power, inverse = _power_tables() if len(piece) <= PIECE else _power_range(len(piece) + 1)
            total = np.cumsum((piece.astype(U) + U(1)) * power[: len(piece)], dtype=U)
            before = np.where(s > 0, total[s - 1], U(0))
            hashes.append(mix((total[e] - before) * inverse[s] + (e - s + 1).astype(U)))
            rows.append(np.searchsorted(bounds, s + low, "right") - 1)
        low = end
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, U)
    return np.concatenate(rows), np.concatenate(hashes)


#: The same classes for text that has not been lowered yet.
LOWERED = {id(NON_SPACE): NON_SPACE[LOWER], id(ALNUM): ALNUM[LOWER]}


def grams(rows: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``k`` words, at the place of its first word; ``whole`` tells runs inside one text."""
    n = max(len(hashes) - k + 1, 0)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * U(0x9E3779B97F4A7C15) + hashes[j : j + n]
    whole = rows[:n] == rows[k - 1 : k - 1 + n] if n else np.zeros(0, bool)
    return mix(out), whole


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Words per row."""
    return np.bincount(rows, minlength=n).astype(np.int64)


def lists(values: pa.Array | np.ndarray, counts: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values) if isinstance(values, np.ndarray) else values)


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def over_text(df: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], begin: Callable[[], object] | None = None, finish=None) -> DataFrame:
    """Run ``work(batch)`` (or ``work(batch, state)``) over Arrow batches; ``finish(state)`` may add rows at the end of a task."""

    def run(batches):
        state = begin() if begin else None
        for batch in batches:
            if batch.num_rows:
                yield from work(batch, state) if begin else work(batch)
        if finish:
            yield from finish(state)

    return df.mapInArrow(run, schema)


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text modulo ``divisor``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(divisor))
