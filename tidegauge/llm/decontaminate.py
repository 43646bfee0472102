"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` consecutive k-gram hashes of a text the smallest is kept (the rightmost of equals). Two texts that share a span of
``GRAM + WINDOW - 1`` words share the kept hash of that span, so joining kept hashes misses no such span. Each hit is then extended to the
whole windows of that length around it, compared word for word by their hashes.

The benchmark is worked through in blocks of a bounded number of words. Every block is a bounded broadcast, joined in one narrow pass over the
documents; only hit intervals are shuffled. One block is the usual case; more blocks mean more passes, never less work.

Null and empty texts have no words and no hits; items without words occur nowhere; rows sharing an item id are one item, null ids are
left out of the list of ids; repeated document rows are returned as often as they come; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import batches as B

GRAM = 5
WINDOW = 6
#: Words of benchmark text that one pass holds (about 50 bytes each in a task).
BLOCK_WORDS = 1 << 20


def kept_places(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places whose hash is the smallest of some ``window`` neighbours (the rightmost of equals)."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    last = window - 1 - views[:, ::-1].argmin(axis=1)
    return np.unique(np.arange(len(views)) + last)


def _items(texts: list[str], ids: list, gram: int, window: int) -> dict:
    """The lookup arrays of one block of benchmark items."""
    offsets, data = B.texts(pa.array(texts, pa.string()))
    rows, words = B.words(offsets, data, 0, len(texts), B.ALNUM)
    counts = B.per_row(rows, len(texts))
    span = gram + window - 1
    hashes, whole = B.grams(rows, words, gram)
    places = kept_places(np.where(whole, hashes, ~B.U(0)), window)
    places = places[whole[places]] if len(places) else places
    places = places[np.argsort(hashes[places], kind="stable")]
    ends = np.cumsum(counts)
    short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in sorted({int(c) for c in counts if 0 < c < span}):
        which = np.flatnonzero(counts == length)
        phrase, _ = B.grams(rows, words, length)
        found = phrase[ends[which] - length]
        order = np.argsort(found, kind="stable")
        short[length] = (found[order], which[order])
    return {
        "ids": ids, "gram": hashes, "row": rows, "start": ends - counts, "end": ends, "place": places, "key": hashes[places], "short": short,
    }


def _equal_range(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``wanted``, index into ``sorted_keys``) of all equal pairs."""
    low, high = np.searchsorted(sorted_keys, wanted, "left"), np.searchsorted(sorted_keys, wanted, "right")
    times = high - low
    left = np.repeat(np.arange(len(wanted)), times)
    step = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
    return left, np.repeat(low, times) + step


def _matches(rows, words, items: dict, gram: int, window: int):
    """(place of the first word, length, item) of every occurrence of an item window in the given texts."""
    span = gram + window - 1
    out = []
    if len(items["key"]) and len(words) >= span:
        hashes, whole = B.grams(rows, words, gram)
        places = kept_places(np.where(whole, hashes, ~B.U(0)), window)
        places = places[whole[places]]
        at, to = _equal_range(items["key"], hashes[places])
        doc, item = places[at], items["place"][to]
        for shift in range(window):
            d, q = doc - shift, item - shift
            owner = items["row"][item]
            ok = (d >= 0) & (q >= items["start"][owner]) & (q + span <= items["end"][owner]) & (d + span <= len(words))
            d, q, owner = d[ok], q[ok], owner[ok]
            # the window is its first gram and those that follow until its end
            same = rows[d] == rows[np.minimum(d + span - 1, len(rows) - 1)]
            for step in sorted({*range(0, window - 1, gram), window - 1}):
                same &= hashes[d + step] == items["gram"][q + step]
            out.append((d[same], np.full(int(same.sum()), span), owner[same]))
    for length, (keys, which) in items["short"].items():
        phrase, whole = B.grams(rows, words, length)
        at, to = _equal_range(keys, phrase)
        good = whole[at]
        out.append((at[good], np.full(int(good.sum()), length), which[to[good]]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _scan(block, gram: int, window: int):
    ready: list = []

    def work(batch: pa.RecordBatch):
        if not ready:
            ready.append(_items(*block.value, gram, window))
        items = ready[0]
        offsets, data = B.texts(batch.column("text"))
        for first, last in B.groups(offsets):
            rows, words = B.words(offsets, data, first, last, B.ALNUM)
            n = last - first
            counts = B.per_row(rows, n)
            begins = np.cumsum(counts) - counts
            place, length, item = _matches(rows, words, items, gram, window)
            spans, found = [[] for _ in range(n)], [set() for _ in range(n)]
            # merge overlapping windows; windows of one text never reach into the next
            order = np.argsort(place, kind="stable")
            for p, m, i in zip(place[order].tolist(), length[order].tolist(), item[order].tolist()):
                r = int(rows[p])
                low, high = p - int(begins[r]), p - int(begins[r]) + m
                if spans[r] and low <= spans[r][-1][1]:
                    spans[r][-1][1] = max(spans[r][-1][1], high)
                else:
                    spans[r].append([low, high])
                if items["ids"][i] is not None:
                    found[r].add(items["ids"][i])
            pairs = [pair for row in spans for pair in row]
            values = pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["from", "until"])
            part = batch.slice(first, n)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("key"), pa.array(counts), B.lists(values, np.array([len(s) for s in spans])), pa.array([sorted(f) for f in found], pa.list_(pa.string()))],
                ["id", "key", "n_words", "spans", "items"],
            )

    return work


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_words: int):
    """The benchmark's items as broadcasts of about ``block_words`` words at most, one after the other."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    # a word takes two bytes at least, with what parts it from the next
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    blocks = size // (2 * block_words) + 1
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for block in range(blocks):
        held = dealt.where(F.col("block") == block).select("item", "text").collect()
        yield spark.sparkContext.broadcast(([r["text"] for r in held], [r["item"] for r in held]))


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", gram: int = GRAM, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the rows whose text holds a window of the benchmark. Nothing is shuffled: each block is one more filter."""

    def holds(shared):
        ready: list = []

        def work(batch: pa.Array) -> pa.Array:
            if not ready:
                ready.append(_items(*shared.value, gram, window))
            offsets, data = B.texts(batch)
            out = np.zeros(len(batch), bool)
            for first, last in B.groups(offsets):
                rows, words = B.words(offsets, data, first, last, B.ALNUM)
                out[first + rows[_matches(rows, words, ready[0], gram, window)[0]]] = True
            return pa.array(out)

        return F.arrow_udf(work, "boolean")(F.coalesce(F.col(text_col), F.lit("")))

    for shared in _blocks(benchmark, item_col, item_text, block_words):
        docs = docs.where(~holds(shared))
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                  gram: int = GRAM, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, spans) for every row; ``spans`` are the merged word intervals, ``items`` the ids as sorted strings."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text, F.length(text)).alias("key"), text.alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, key long, n_words long, spans array<struct<from: long, until: long>>, items array<string>"
    passes = [
        B.over_text(source, "text", schema, _scan(shared, gram, window)).withColumn("block", F.lit(i)) for i, shared in enumerate(_blocks(benchmark, item_col, item_text, block_words))
    ]
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.unionByName(more)
    if len(passes) > 1:
        rows = rows.groupBy("id", "key", "n_words").agg(
            F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.count_if(F.col("block") == 0).alias("times"),
        ).withColumn("copy", F.explode(F.expr("sequence(1, times)")))
    total = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["until"] - F.greatest(s["from"], acc["at"]))).alias("n"), F.greatest(acc["at"], s["until"]).alias("at")),
        lambda acc: acc["n"],
    )
    return rows.select(
        F.col("id").alias(id_col), "n_words", total.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), F.array_sort("spans").alias("spans"),
    )
