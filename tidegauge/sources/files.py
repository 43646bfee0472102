"""Delimited files and landed JSON pages, with evidence about delimiter and encoding from the whole input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators.normalise import Normalised, datetimes
from tidegauge.operators.validate import Arrival
from tidegauge.session import rows

# Fixed values
DELIMITERS = (",", ";", "\t", "|")
DEFAULT_DELIMITER = ","
MAX_ROWS, MAX_COLUMNS = 2_000_000, 4_096


class TableTooLarge(ValueError):
    pass


def delimiter_evidence(lines: DataFrame) -> DataFrame:
    """(delimiter, per_line, share): the usual number of each candidate per line, quoted parts ignored."""
    bare = F.regexp_replace("value", '"[^"]*"', "")
    candidates = F.array(*[F.struct(F.lit(d).alias("delimiter"), F.lit(i).alias("preference"), (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("per_line")) for i, d in enumerate(DELIMITERS)])
    counts = lines.where(F.length("value") > 0).select(F.inline(candidates)).groupBy("delimiter", "preference", "per_line").agg(F.count("*").alias("n"))
    usual = counts.where("per_line > 0").groupBy("delimiter", "preference").agg(F.max_by("per_line", F.struct("n", "per_line")).alias("per_line"), F.max("n").alias("n"))
    total = counts.where("preference = 0").agg(F.sum("n")).scalar()
    return usual.select("delimiter", "preference", "per_line", (F.col("n") / total).alias("share"))


def detect_delimiter(lines: DataFrame) -> str:
    """The candidate whose count per line is the steadiest; a comma when there is none."""
    best = delimiter_evidence(lines).orderBy(F.desc("share"), F.desc("per_line"), "preference").first()
    return best["delimiter"] if best else DEFAULT_DELIMITER


def encoding_evidence(lines: DataFrame) -> DataFrame:
    """Lines of the whole input that are, and are not, valid UTF-8, and those that are plain ASCII."""
    return lines.agg(*_encoding_counts())


def _encoding_counts() -> list[Column]:
    valid = F.is_valid_utf8("value")
    return [F.count("*").alias("lines"), F.count_if(~valid).alias("invalid"), F.count_if(valid & F.col("value").rlike(r"^\p{ASCII}*$")).alias("ascii")]


@dataclass(frozen=True)
class Loaded:
    data: DataFrame
    arrival: Arrival
    delimiter: str
    dates: Normalised


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | str | None = None, delimiter: str | None = None) -> Loaded:
    """A delimited file with header; encoding and delimiter judged on all lines, dates settled once.

    Give the ``schema`` once a baseline knows it: inference reads the input a second time.
    """
    lines = spark.read.text(path)
    # a quote left open at the end of a line: some record goes on in the next one
    open_quote = F.regexp_count("value", F.lit('"')) % 2 == 1
    seen = lines.agg(*_encoding_counts(), F.count_if(open_quote).alias("open")).first()
    detected = "ascii" if seen["ascii"] == seen["lines"] else "utf-8"
    used = "utf-8" if not seen["invalid"] else "latin-1"
    confidence = 1.0 - seen["invalid"] / seen["lines"] if seen["lines"] else 0.0
    warnings = ()
    if seen["invalid"]:
        warnings = (f"{seen['invalid']} of {seen['lines']} lines are not valid UTF-8; read as latin-1 instead",)
    delimiter = delimiter or detect_delimiter(lines)
    # quotes inside quotes are doubled; only files whose records span lines are read whole
    reader = spark.read.option("header", True).option("sep", delimiter).option("quote", '"').option("escape", '"').option("multiLine", seen["open"] > 0).option("encoding", "UTF-8" if used == "utf-8" else "ISO-8859-1")
    data = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).option("preferDate", True).csv(path)
    check_columns(data)
    dates = datetimes(data)
    arrival = Arrival(detected, confidence, used, warnings, dates.attempts)
    return Loaded(dates.data, arrival, delimiter, dates)


def read_pages(spark: SparkSession, path: str, record_path: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Landed JSON pages (one document per file): the records at a dotted path, nested objects as ``a.b`` columns."""
    reader = spark.read.option("multiLine", True)
    pages = reader.schema(schema).json(path) if schema is not None else reader.json(path)
    if record_path:
        pages = pages.select(F.explode(F.col(record_path)).alias("record")).select("record.*")
    return flatten(pages)


def flatten(df: DataFrame) -> DataFrame:
    def leaves(struct: T.StructType, prefix: tuple[str, ...]) -> list[Column]:
        found = []
        for f in struct.fields:
            path = (*prefix, f.name)
            if isinstance(f.dataType, T.StructType):
                found += leaves(f.dataType, path)
            else:
                found.append(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)))
        return found

    return df.select(*leaves(df.schema, ()))


def page_cap_warnings(pages: DataFrame, max_pages: int, row_cap: int | None = None, records: str = "records") -> DataFrame:
    """A row per cap that was reached, so that a cut-short landing is never taken for the whole."""
    totals = pages.agg(F.count("*").alias("pages"), F.coalesce(F.sum(records), F.lit(0)).alias("rows"))
    found = totals.where(F.col("pages") >= max_pages).select(F.format_string(f"stopped at the page cap ({max_pages}); more may exist").alias("warning"))
    if row_cap is None:
        return found
    return found.unionByName(totals.where(F.col("rows") >= row_cap).select(F.lit(f"stopped at the row cap ({row_cap}); more may exist").alias("warning")))


def check_columns(df: DataFrame, max_columns: int = MAX_COLUMNS) -> None:
    if len(df.columns) > max_columns:
        raise TableTooLarge(f"{len(df.columns):,} columns, above the limit of {max_columns:,}; check the delimiter and the header")


def check_size(df: DataFrame, max_rows: int | None = None, max_columns: int = MAX_COLUMNS) -> DataFrame:
    """Refuse a table above the limits; never cut it. Rows are limited only where ``max_rows`` is given (as ``MAX_ROWS``)."""
    check_columns(df, max_columns)
    if max_rows is not None:
        seen = df.select(F.lit(1)).limit(max_rows + 1).count()
        if seen > max_rows:
            raise TableTooLarge(f"more than {max_rows:,} rows; nothing was analysed, as part of a table is not the table")
    return df


def contract_metadata(df: DataFrame) -> DataFrame:
    """(column, dtype, row_count)."""
    types = rows(df.sparkSession, list(enumerate_types(df)), "position int, column string, dtype string")
    return types.withColumn("row_count", df.agg(F.count("*")).scalar())


def enumerate_types(df: DataFrame):
    for i, (name, dtype) in enumerate(df.dtypes):
        yield i, name, dtype
