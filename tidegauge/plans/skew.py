"""Join a large table to a keyed lookup when one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 64
SALTS = 32
BROADCAST_ROWS = 200_000


def salted_lookup(df: DataFrame, key: str, lookup: DataFrame, count: str, how: str = "left", lookup_rows: int | None = None) -> DataFrame:
    """Left/inner join ``df`` to ``lookup`` (one row per ``key``, ``count`` = rows of df with that key).

    A key is hot when it holds more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE
    hot keys and their list is safe to broadcast. Hot rows are spread over SALTS copies of their
    lookup row; all other rows join as usual. Where the caller has counted the lookup and it is small,
    it is broadcast instead.
    """
    if lookup_rows is not None and lookup_rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(lookup.drop(count)), key, how)
    total = lookup.select(F.sum(count)).scalar()
    hot = lookup.where(F.col(count) * HOT_SHARE > total).select(F.col(key).alias("__hot"))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    salted = df.join(F.broadcast(hot), df[key] == F.col("__hot"), "left").withColumn(
        "__salt", F.when(F.col("__hot").isNotNull(), spread).otherwise(F.lit(0))
    ).drop("__hot")
    copies = lookup.withColumn(
        "__copy",
        F.explode(F.when(F.col(count) * HOT_SHARE > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))),
    ).withColumnRenamed(key, "__lookup_key").drop(count)
    joined = salted.join(
        copies, (F.col(key) == F.col("__lookup_key")) & (F.col("__salt") == F.col("__copy")), how
    )
    return joined.drop("__lookup_key", "__salt", "__copy")

