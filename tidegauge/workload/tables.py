"""Reading the given tables, and the views several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Collects queries and, where SQL can say the same, their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracles[query.__name__] = sql
            return query

        return register


def rounded(column: Column | str, places: int = 6) -> Column:
    return F.bround(F.col(column) if isinstance(column, str) else column, places)


def filled(df: DataFrame, **blanks) -> DataFrame:
    """Missing figures as -1 and missing texts as '', so both sides spell them alike."""
    return df.fillna(blanks)


SPLIT_DATE = "1998-01-01"


def earlier_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit(SPLIT_DATE).cast("timestamp_ntz"))


def later_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit(SPLIT_DATE).cast("timestamp_ntz"))


def line_items_with_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return read(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
