"""A query against a database, and whether its declared column types were honoured."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators.normalise import Normalised, datetimes
from tidegauge.operators.validate import Arrival
from tidegauge.session import rows

# Markers of each type family, in order of precedence
FAMILIES = {
    "numeric": ("INT", "NUMERIC", "DECIMAL", "FLOAT", "DOUBLE", "REAL", "SERIAL"),
    "temporal": ("DATE", "TIME"),
    "boolean": ("BOOL",),
    "text": ("CHAR", "TEXT", "CLOB", "STR", "OBJECT"),
}


@dataclass(frozen=True)
class Partitioning:
    """How to split the read over executors; without it a query is one connection."""

    column: str
    lower: str
    upper: str
    partitions: int


def read_query(spark: SparkSession, url: str, query: str, row_limit: int | None = None, partitioning: Partitioning | None = None, **options: str) -> DataFrame:
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partitioning:
        reader = (
            reader.option("dbtable", f"({query}) q").option("partitionColumn", partitioning.column).option("lowerBound", partitioning.lower)
            .option("upperBound", partitioning.upper).option("numPartitions", partitioning.partitions)
        )
    else:
        reader = reader.option("query", query)
    data = reader.load()
    return data.limit(row_limit) if row_limit is not None else data


def type_family(name: str):
    upper = F.upper(name)
    family = None
    for label, markers in FAMILIES.items():
        hit = upper.rlike("|".join(markers))
        family = F.when(hit, label) if family is None else family.when(hit, label)
    return family.otherwise("other")


def type_mismatches(df: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Columns whose declared and actual type families differ; an unknown family is never flagged."""
    spark = df.sparkSession
    said = rows(spark, list(declared.items()), "column string, declared_type string")
    # the engine's own name for 64-bit integers must fall into the numeric family
    actual = rows(spark, list(df.dtypes), "column string, actual_type string")
    both = said.join(actual, "column").withColumns({"said": type_family("declared_type"), "is": type_family("actual_type")})
    return both.where("said != is and said != 'other' and is != 'other'").select("column", "declared_type", "actual_type")


def load(spark: SparkSession, url: str, query: str, declared: dict[str, str] | None = None, row_limit: int | None = None, **options: str) -> tuple[Normalised, Arrival]:
    data = read_query(spark, url, query, row_limit, **options)
    normal = datetimes(data, declared)
    mismatches = type_mismatches(normal.data, declared or {}).collect() if declared else []
    warnings = tuple(f"column '{m['column']}': declared {m['declared_type']} but read as {m['actual_type']}" for m in mismatches)
    return normal, Arrival(warnings=warnings, date_attempts=normal.attempts)
