"""Token counts: whole texts encoded in Arrow batches, returning lengths only.

Texts are cut at places where the tokenizer's own split must fall anyway, gathered into batches of about equal bytes, and only the number
of ids leaves a batch. A text may hold the special strings; they are handled as the library does by default.

A null text counts as empty (0 bytes, 0 tokens); null and repeated ids are ordinary rows; an empty table gives an empty table; columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import over_text

#: Texts longer than this are cut; a batch holds about this many characters.
PART_CHARS = 1 << 15
BATCH_CHARS = 1 << 18
LIMIT = 1024
#: Between a letter and a blank that is followed by a letter, a byte-level split always falls. Only ASCII letters are used, as
#: marks may join other characters.
_SAFE = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def parts(text: str, limit: int = PART_CHARS) -> list[str]:
    """``text`` in pieces whose token counts add up to that of the whole."""
    out, start = [], 0
    while len(text) - start > limit:
        found = _SAFE.search(text, start + limit)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:] if start else text)
    return out


def _load(path: str | None):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path or tokenizer_file())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _lengths(tokenizer, texts: list[str]) -> np.ndarray:
    """Token counts, encoding in batches of about equal size in characters."""
    counts = np.zeros(len(texts), np.int64)
    waiting, owners, size = [], [], 0

    def flush():
        for owner, encoded in zip(owners, tokenizer.encode_batch_fast(waiting, add_special_tokens=False)):
            counts[owner] += len(encoded)
        waiting.clear(), owners.clear()

    for row, text in enumerate(texts):
        for part in parts(text):
            if size + len(part) > BATCH_CHARS and waiting:
                flush()
                size = 0
            waiting.append(part)
            owners.append(row)
            size += len(part)
    if waiting:
        flush()
    return counts


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row; ``path`` names the tokenizer file, the same on every machine."""
    loaded: list = []

    def work(batch: pa.RecordBatch):
        if not loaded:
            loaded.append(_load(path))
        values = batch.column(1).to_pylist()
        counts = _lengths(loaded[0], values)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], ["id", "n_bytes", "n_tokens"])

    source = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    sized = source.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = over_text(sized, "text", f"id {kind}, n_bytes long, n_tokens long", work)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
