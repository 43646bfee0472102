"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on toxic passages, and every window of words is compressed three times: with
neither, with the ordinary one, and with the toxic one. The bytes that each dictionary saves make a cell of a small table, and a window weighs by how
much more often windows of toxic texts fall into its cell than windows of other texts. A text is toxic throughout or in one stretch: the evidence is that of
all windows together, or of the best stretches of neighbouring windows (each stretch as likely as any other), and is calibrated to a probability.

Before compression every byte of a word is replaced by two bytes that stand for the word up to there (for its first four characters, where they are). Two words then
share a match only as far as their beginnings agree, and only from the fourth character on; the same letters further inside another word, common where
words are compounds or inflected, save nothing.

A toxic text is mostly ordinary, so the toxic dictionary is trained on the passages that tell: beginnings of words that occur much more often in toxic
texts than in others. They are counted by occurrence, not by text, since the stem of an inflected word also turns up by chance in ordinary text, but once.
Only fitting uses a sample: at most ``sample`` labelled texts of each label (those of smallest id hash); of a text of more than ``sample_chars``
bytes, fitting takes words spread over the whole of it. Scoring reads every whole text, window by window.

A null or empty text has no windows and gets the probability of no evidence; without labels of both kinds every text gets the share of
toxic labels (0 if there are none); null ids are never training rows; repeated rows and equal texts get equal scores; a row whose score equals the limit is
rejected; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import batches as B
from tidegauge.llm import calibrate

WINDOW_WORDS = 20
ORDINARY_BYTES, TOXIC_BYTES = 4096, 4096
LEVEL = 9
#: Shorter matches say little. Between words stand ``GAP`` bytes, each byte of a word becomes ``WIDTH``.
LEAST_MATCH, GAP, WIDTH = 6, 1, 2
SAMPLE = 1500
SAMPLE_CHARS = 20_000
#: Beginnings that mark toxic passages: characters of the shortest, bytes of the longest, least share of toxic texts, least ratio of their rate to that in ordinary texts.
ROOT, MOST_BYTES, SHARE, RATIO = 4, 16, 0.01, 5.0
#: Share of toxic texts from which a beginning counts whatever its first characters say.
OFTEN = 0.05
#: Cells of the table: bytes saved by the toxic and by the ordinary dictionary, beyond which nothing is told apart.
MOST_TOXIC, MOST_ORDINARY, ORDINARY_STEP = 32, 4, 12
FEW = 20
#: Neighbouring windows of a stretch.
STRETCHES = (1, 2, 4, 8)
_LONG = 200


class Coded:
    """A text whose words are coded byte by byte. A word of more than 200 bytes counts as several."""

    def __init__(self, text: bytes) -> None:
        codes, starts, upto, roots = [], [], [], []
        low, used = 0, 0
        data = np.frombuffer(text, np.uint8)
        while low < len(data):
            end = min(low + B.PIECE, len(data))
            while end < len(data) and B.NON_SPACE[data[end - 1]] and end - low > B.PIECE - 4096:
                end -= 1
            h, first, root = _beginnings(B.LOWER[data[low:end]])
            out = np.zeros(WIDTH * len(h) + GAP * len(first), np.uint8)
            word = np.zeros(len(h), np.int64)
            word[first] = 1
            place = WIDTH * np.arange(len(h)) + GAP * np.cumsum(word)
            sizes = np.diff(np.append(first, len(h)))
            within = np.arange(len(h)) - np.repeat(first, sizes)
            told = np.repeat(first, sizes) + np.maximum(within, np.repeat(root, sizes) - 1)
            salt = B.mix(h[told] + within.astype(B.U)) if len(h) else h
            for i in range(WIDTH):
                out[place + i] = (salt >> B.U(8 * i)) % B.U(255) + B.U(1)
            codes.append(out)
            starts.append(WIDTH * first + GAP * np.arange(len(first)) + used)
            upto.append(h)
            roots.append(root)
            used += len(out)
            low = end
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.uint8)
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        #: Hash of each word up to each of its bytes, without the gaps.
        self.upto = np.concatenate(upto) if upto else np.zeros(0, B.U)
        #: Bytes of the first characters of each word.
        self.roots = np.concatenate(roots) if roots else np.zeros(0, np.int64)

    def windows(self, size: int = WINDOW_WORDS) -> list[bytes]:
        edges = [*self.starts[::size].tolist(), len(self.codes)]
        whole = self.codes.tobytes()
        return [whole[a:b] for a, b in zip(edges[:-1], edges[1:])]

    def marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, bytes from the start of the word, bytes of its root) of every byte of a word that ends a beginning of allowed length."""
        begins = (self.starts - GAP * np.arange(len(self.starts))) // WIDTH
        sizes = np.diff(np.append(begins, len(self.upto)))
        size, root = np.arange(len(self.upto)) - np.repeat(begins, sizes) + 1, np.repeat(self.roots, sizes)
        at = np.flatnonzero((size >= root) & (size <= MOST_BYTES) & np.repeat(sizes >= ROOT, sizes))
        return at, size[at], root[at]

    def beginnings(self, marked: np.ndarray) -> list[bytes]:
        """Of each word the longest marked beginning, coded, after a gap."""
        at, size, _ = self.marks()
        hit = np.isin(self.upto[at], marked)
        at, size = at[hit], size[hit]
        if not len(at):
            return []
        begins = (self.starts - GAP * np.arange(len(self.starts))) // WIDTH
        word = np.searchsorted(begins, at, "right") - 1
        last = np.append(word[1:] != word[:-1], True)
        return [self.codes[self.starts[w] : self.starts[w] + GAP + WIDTH * n].tobytes() for w, n in zip(word[last], size[last])]


def _beginnings(piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of its word up to each byte that stands in a word, the places of the words' first bytes among those, and the bytes of each word's first characters."""
    at = np.flatnonzero(B.NON_SPACE[piece])
    if not len(at):
        return np.zeros(0, B.U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(len(at), bool)
    fresh[1:] = np.diff(at) > 1
    first = np.flatnonzero(fresh)
    within = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(within % _LONG == 0)
    sizes = np.diff(np.append(first, len(at)))
    power, inverse = B._power_tables()
    total = np.cumsum((piece.astype(B.U) + B.U(1)) * power[: len(piece)], dtype=B.U)
    begin = np.repeat(at[first], sizes)
    before = np.where(begin > 0, total[begin - 1], B.U(0))
    # bytes 128 to 191 continue a character
    lead = np.cumsum((piece[at] & 0xC0) != 0x80)
    character = lead - np.repeat(lead[first], sizes) + 1
    root = np.add.reduceat((character <= ROOT).astype(np.int64), first)
    return B.mix((total[at] - before) * inverse[begin] + (at - begin + 1).astype(B.U)), first, root


def _marked(toxic: list[Coded], ordinary: list[Coded]) -> np.ndarray:
    """Beginnings of words at a far higher rate in toxic texts than in ordinary ones; of one in a text at most four places count."""
    words, counts = [max(sum(len(t.starts) for t in texts), 1) for texts in (toxic, ordinary)], []
    for texts in (toxic, ordinary):
        held = []
        for t in texts:
            held.append(np.unique(t.upto[t.marks()[0]], return_counts=True))
        keys = np.concatenate([k for k, _ in held])
        times = np.concatenate([np.minimum(n, 4) for _, n in held])
        found, place = np.unique(keys, return_inverse=True)
        counts.append((found, np.bincount(place, minlength=len(found)), np.bincount(place, times, len(found))))
    (keys, n, times), (other, _, among) = counts
    at = np.minimum(np.searchsorted(other, keys), max(len(other) - 1, 0))
    rest = np.where(other[at] == keys, among[at], 0) if len(other) else np.zeros(len(keys))
    # one and a half standard deviations on either side, so that rare ones need a clearer ratio
    low, high = np.maximum(times - 1.5 * np.sqrt(times), 0) / words[0], (rest + 1.5 * np.sqrt(rest) + 0.5) / words[1]
    least = min(5, max(2, len(toxic) // 20))
    telling = (n >= least) & (n >= SHARE * len(toxic)) & (low > RATIO * high)
    marked = keys[telling]
    # a longer beginning of a few texts counts only where the shortest one tells already: else the dictionary would shorten common words
    rooted = [keys[telling & (n >= OFTEN * len(toxic))]]
    for t in toxic:
        at, size, root = t.marks()
        hit = np.isin(t.upto[at], marked) & np.isin(t.upto[at - size + root], marked)
        rooted.append(np.unique(t.upto[at[hit]]))
    return np.unique(np.concatenate(rooted))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: they are the dictionary
        return b"".join(dict.fromkeys(samples))[:size]


def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters.from_level(
        level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=LEAST_MATCH, strategy=zstandard.STRATEGY_LAZY2,
    )
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=params)


def _content(passages: list[bytes], size: int) -> bytes:
    """A dictionary from passages of a few bytes, too short for the trainer's segments: the commonest distinct ones, the commonest last, where matches cost least."""
    counts = Counter(passages)
    kept, used = [], 0
    for p in sorted((p for p in counts if counts[p] > 1), key=lambda p: (-counts[p], p)) or sorted(counts):
        if used + len(p) <= size and not any(p in other for other in kept):
            kept.append(p)
            used += len(p)
    return b"".join(reversed(kept))


class Meter:
    """The cell of each window: bytes that the toxic dictionary saves, and that the ordinary one saves."""

    def __init__(self, ordinary: bytes, toxic: bytes, level: int = LEVEL) -> None:
        # equally long, so nothing but the content differs
        self.none, self.ordinary, self.toxic = (
            _compressor(bytes(max(len(ordinary), len(toxic)) - len(content)) + content, level).compress for content in (b"", ordinary, toxic)
        )

    def cells(self, found: list[bytes]) -> np.ndarray:
        none, ordinary, toxic = self.none, self.ordinary, self.toxic
        saved = np.array([(n := len(none(w)), n - len(toxic(w)), n - len(ordinary(w))) for w in found], np.int64).reshape(-1, 3)
        return np.clip(saved[:, 1], 0, MOST_TOXIC) * (MOST_ORDINARY + 1) + np.clip(saved[:, 2] // ORDINARY_STEP, 0, MOST_ORDINARY)


def evidence(weights: np.ndarray) -> float:
    """Log odds that the windows of a text are toxic throughout or in one stretch."""
    n = len(weights)
    if not n:
        return 0.0
    total = np.concatenate([[0.0], np.cumsum(weights)])
    ways = [total[-1]]
    for size in STRETCHES:
        if size < n:
            each = total[size:] - total[:-size]
            top = each.max()
            ways.append(top + np.log(np.exp(each - top).mean()))
    return float(np.logaddexp.reduce(ways) - np.log(len(ways)))


def _weights(cells: list[np.ndarray], size: int) -> np.ndarray:
    """Log ratio of each cell's share among toxic and ordinary windows. A line (the bytes that the toxic dictionary saves) with few windows is judged
    together with the next lines above it, the last lines no lower than those before them, and a cell with few windows leans on its line."""
    counts = [np.bincount(np.concatenate(c) if len(c) else np.zeros(0, np.int64), minlength=size).reshape(MOST_TOXIC + 1, -1) for c in cells]
    lines = [c.sum(axis=1) for c in counts]
    upto = np.concatenate([[0], np.cumsum(lines[0] + lines[1])])
    out, totals, before = np.zeros(counts[0].shape), [max(line.sum(), 1) for line in lines], -np.inf
    for i in range(len(out)):
        last = min(max(int(np.searchsorted(upto, upto[i] + FEW)), i + 1), len(out))
        here = [c[i:last].sum(axis=0) for c in counts]
        by_line = np.log(((here[0].sum() + 0.5) / totals[0]) / ((here[1].sum() + 0.5) / totals[1]))
        if upto[last] - upto[i] < FEW:
            by_line = max(by_line, before)
        before = by_line
        both = (here[0] + here[1] + 1) / (here[0] + here[1] + 1).sum()
        within = [h + FEW * both for h in here]
        out[i] = by_line + np.log((within[0] / within[0].sum()) / (within[1] / within[1].sum()))
    return out.reshape(-1)


def fit(toxic: list[bytes], ordinary: list[bytes], totals: tuple[float, float], sample_chars: int = SAMPLE_CHARS) -> dict:
    """A model from sampled texts of either label; ``totals`` are the numbers of all training rows with them."""
    prior = totals[0] / max(sum(totals), 1)
    if not toxic or not ordinary:
        return {"prior": prior}
    # a group of near copies would make its words look typical: one of each fits
    # and in an order of their own, so that the halves below do not follow the order of ids
    coded = [_apart([Coded(_spread(t, sample_chars)) for t in sorted(texts, key=lambda t: (zlib.crc32(t), t))]) for texts in (toxic, ordinary)]
    # each half is weighed by dictionaries of the other, so that no text is judged by what was learned from itself; the model keeps those of all texts
    cells: list[list[np.ndarray]] = [[], []]
    for half in (0, 1):
        learn, check = [c[half::2] or c for c in coded], [c[1 - half :: 2] for c in coded]
        meter = Meter(*_dictionaries(*learn))
        for held, texts in zip(cells, check):
            held += [meter.cells(t.windows()) for t in texts]
    model = {"prior": prior}
    model["ordinary"], model["toxic"] = _dictionaries(*coded)
    model["weights"] = _weights(cells, (MOST_TOXIC + 1) * (MOST_ORDINARY + 1))
    # on a scale that narrows outwards: between a text without any evidence and one full of it, little of it is told apart from much
    found = np.arcsinh([evidence(model["weights"][c]) for texts in cells for c in texts])
    label = np.repeat([1.0, 0.0], [len(c) for c in cells])
    # sampled labels stand for all of theirs
    weight = np.where(label == 1, totals[0] / len(coded[0]), totals[1] / len(coded[1]))
    model["knots"] = calibrate.isotonic(found, weight, weight * label)
    return model


def _dictionaries(toxic: list[Coded], ordinary: list[Coded]) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary."""
    plain = [w for t in ordinary for w in t.windows()]
    marked = _marked(toxic, ordinary)
    passages = [p for t in toxic for p in t.beginnings(marked)]
    telling = _content(passages, TOXIC_BYTES) if passages else _dictionary([w for t in toxic for w in t.windows()], TOXIC_BYTES)
    return _dictionary(plain[:: max(1, len(plain) // 20_000)], ORDINARY_BYTES), telling


def _apart(texts: list[Coded]) -> list[Coded]:
    """Texts that do not share half of their smallest run hashes with texts before them; runs are three words, or all words of a shorter text."""
    seen: set[int] = set()
    kept = []
    for text in texts:
        ends = np.append((text.starts[1:] - GAP * np.arange(1, len(text.starts))) // WIDTH, len(text.upto)) - 1 if len(text.starts) else np.zeros(0, np.int64)
        words = text.upto[ends]
        size = min(3, max(len(words), 1))
        runs = sum((words[i : len(words) - size + 1 + i] * B.U(2 * i + 0x9E3779B97F4A7C15) for i in range(1, size)), words[: max(len(words) - size + 1, 0)].copy())
        least = np.unique(B.mix(runs))[:16].tolist()
        if 2 * sum(x in seen for x in least) <= len(least) - 1 or not least:
            kept.append(text)
        seen.update(least)
    return kept


def _spread(text: bytes, most: int) -> bytes:
    """A text, or every so many of its words where it is longer than ``most``: runs of a window each, spread over all of it."""
    if len(text) <= most:
        return text
    words = text.split()
    step = -(-len(text) // most) * WINDOW_WORDS
    return b" ".join(w for i in range(0, len(words), step) for w in words[i : i + WINDOW_WORDS])


def sample_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, sample_chars: int) -> tuple[DataFrame, tuple[float, float]]:
    """(label, text) of distinct texts for fitting, at most ``sample`` of each label and of ``sample_chars`` bytes each, and how many training rows have each label."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    counts = {row["label"]: row["count"] for row in known.groupBy("label").count().collect() if row["label"] in (0, 1)}
    spread = F.arrow_udf(lambda texts: pa.array([_spread(t, sample_chars) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()), "binary")
    texts = []
    for label in (0, 1):
        # at most ``sample`` ids, so this side of the join is small by construction
        ids = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample).select("id")
        chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").where(F.length("text") > 0)
        once = chosen.groupBy(F.xxhash64("text").alias("h")).agg(F.min("id").alias("id"))
        keep = chosen.join(F.broadcast(once.select("id")), "id").select("id", spread("text").alias("text")).orderBy("id", "text").limit(sample)
        texts.append(keep.select(F.lit(label).alias("label"), "text"))
    return texts[0].unionByName(texts[1]), (counts.get(1, 0), counts.get(0, 0))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> dict:
    texts, totals = sample_texts(docs, labels, id_col, text_col, label_col, sample, sample_chars)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = [[], []]
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                held[label].append(text)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(held[1], held[0], totals, sample_chars))], pa.binary())], ["model"])

    # one task holds the bounded sample and everything coded from it; the driver gets the model alone
    made = texts.coalesce(1).mapInArrow(work, "model binary").head()
    return pickle.loads(made["model"]) if made else fit([], [], totals, sample_chars)


def score_column(model: dict, texts: list[bytes], meter: Meter | None) -> np.ndarray:
    if meter is None:
        return np.full(len(texts), model["prior"])
    return calibrate.apply(model["knots"], np.arcsinh(np.array([evidence(model["weights"][meter.cells(Coded(t).windows())]) for t in texts], float)))


def with_score(docs: DataFrame, model: dict, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` and the probability that each whole text is toxic, under ``name``."""
    meters: list = []

    def scores(batch: pa.Array) -> pa.Array:
        if not meters:
            meters.append(Meter(model["ordinary"], model["toxic"]) if "knots" in model else None)
        return pa.array(score_column(model, batch.cast(pa.binary()).to_pylist(), meters[0]), pa.float64())

    return docs.withColumn(name, F.arrow_udf(scores, "double")(F.coalesce(F.col(text_col), F.lit(""))))


def remove(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose text is scored ``limit`` or more."""
    name = "score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, train(docs, labels, id_col, text_col), text_col, name).where(F.col(name) < limit).drop(name)
