"""Personal data: which columns hold it, and the same table with stable tokens in its place."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.kinds import DATETIME, kinds, nan_to_null, text_of
from tidegauge.functions.text import strip
from tidegauge.plans import order, stats
from tidegauge.plans.skew import salted_lookup
from tidegauge.session import hold, rows

# Value shapes
EMAIL = r"^[^@\s]+@[^@\s.]+\.[^@\s]{2,}$"
PHONE = r"^\+?[\d\s().\-]{7,22}$"
PHONE_MARK = r"^\+|[\s().\-]"
DATE_SHAPE = r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})([ T].*)?$"
IPV4 = r"^(25[0-5]|2[0-4]\d|[01]?\d?\d)(\.(25[0-5]|2[0-4]\d|[01]?\d?\d)){3}$"
IPV6 = r"(?i)^(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}$"
CARD = r"^[\d \-]{13,25}$"
GOVERNMENT_IDS = {
    "us_ssn": r"(?i)^\d{3}-\d{2}-\d{4}$",
    "uk_nino": r"(?i)^[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]$",
    "in_pan": r"(?i)^[A-Z]{5}\d{4}[A-Z]$",
    "in_aadhaar": r"(?i)^\d{4}\s?\d{4}\s?\d{4}$",
}
# Column names that only suggest personal data, in order of preference
NAME_HINTS = {
    "person_name": r"(?i)(name|firstname|first_name|lastname|last_name|surname|fullname|full_name|contact)",
    "postal_address": r"(?i)(address|addr|street|city|postcode|post_code|zip|zipcode)",
    "free_text": r"(?i)(note|notes|comment|comments|description|feedback|message|remark)",
}
TOKEN_PREFIX = {
    "email": "EMAIL", "phone_number": "PHONE", "payment_card": "CARD", "ip_address": "IP", "government_id": "GOV_ID",
    "person_name": "NAME", "postal_address": "ADDRESS", "free_text": "TEXT",
}
MATCH_THRESHOLD, MIN_VALUES = 0.8, 5
STRICT, PERMISSIVE = "strict", "permissive"
HIGH, CANDIDATE, CONFIRMED, NOT_PERSONAL = "high", "candidate", "confirmed", "not_personal"


def is_email(v: Column) -> Column:
    return v.rlike(EMAIL)


def is_card(v: Column) -> Column:
    digits = F.regexp_replace(v, "[ -]", "")
    return v.rlike(CARD) & F.length(digits).between(13, 19) & F.when(digits.rlike(r"^\d+$"), F.call_function("luhn_check", digits)).otherwise(F.lit(False))


def is_ip(v: Column) -> Column:
    return v.rlike(IPV4) | v.rlike(IPV6)


def is_phone(v: Column) -> Column:
    digits = F.length(F.regexp_replace(v, r"\D", ""))
    return ~v.rlike(DATE_SHAPE) & v.rlike(PHONE) & digits.between(7, 15) & v.rlike(PHONE_MARK)


def detectors() -> list[tuple[str, str | None, Column]]:
    """(kind, locale, test) in order of preference, for a value named ``v`` with outer blanks removed."""
    v = F.col("v")
    return [
        ("payment_card", None, is_card(v)),
        ("email", None, is_email(v)),
        ("ip_address", None, is_ip(v)),
        *[("government_id", locale, v.rlike(pattern)) for locale, pattern in GOVERNMENT_IDS.items()],
        ("phone_number", None, is_phone(v)),
    ]


def plain_text(df: DataFrame, column: str) -> Column:
    """The value as a person would write it; doubles without exponent."""
    text = text_of(df, column)
    if not isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return text
    digits = F.regexp_replace(F.col(column).cast("decimal(30,10)").cast("string"), r"(?<=\.\d{1,10})0+$", "")
    return F.when(text.contains("E") & F.abs(F.col(column)).between(1e7, 1e16), digits).otherwise(text)


def match_shares(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, values, kind, locale, matched) for every detector, in one scan of all columns."""
    by_kind = kinds(df)
    columns = [c for c in (columns if columns is not None else df.columns) if by_kind[c] != DATETIME]
    df = nan_to_null(df)
    texts = df.select(*[strip(plain_text(df, c)).alias(c) for c in columns])
    tests = detectors()
    long = texts.unpivot([], columns, "column", "v").where("v is not null")
    flagged = long.select("column", *[t.alias(f"d{i}") for i, (_, _, t) in enumerate(tests)])
    counted = flagged.groupBy("column").agg(F.count("*").alias("values"), *[F.count_if(F.col(f"d{i}")).alias(f"d{i}") for i in range(len(tests))])
    return counted.select("column", "values", F.inline(F.array(*[
        F.struct(F.lit(i).alias("preference"), F.lit(kind).alias("kind"), F.lit(locale).cast("string").alias("locale"), F.col(f"d{i}").alias("matched"))
        for i, (kind, locale, _) in enumerate(tests)
    ])))


CLASSIFICATION = "column string, kind string, confidence string, matched_fraction double, locale string, reason string"


def classify(df: DataFrame, decisions: DataFrame | None = None, threshold: float = MATCH_THRESHOLD, min_values: int = MIN_VALUES) -> DataFrame:
    """One row per column that holds, may hold, or was said to hold personal data.

    ``decisions`` (column, decision): a kind confirms the column; ``not_personal`` clears it unless its
    values verifiably are personal data. Columns are judged on all their values.
    """
    spark = df.sparkSession
    share = F.col("matched") / F.col("values")
    verified = (
        match_shares(df).where((F.col("values") >= min_values) & (share >= threshold))
        .withColumn("i", F.row_number().over(Window.partitionBy("column").orderBy("preference"))).where("i = 1")
        .select("column", F.col("kind").alias("m_kind"), F.col("locale").alias("m_locale"), share.alias("m_fraction"))
    )
    counts = stats.per_column(df, df.columns, lambda c: {"values": F.count(c)})
    named = None
    for kind, pattern in NAME_HINTS.items():
        hit = F.col("column").rlike(pattern)
        named = F.when(hit, kind) if named is None else named.when(hit, kind)
    decided = decisions if decisions is not None else rows(spark, [], "column string, decision string")
    declared = stats.declared_columns(df).select("column", F.col("kind").alias("column_kind"))
    table = hold(declared.join(counts, "column").join(verified, "column", "left").join(decided, "column", "left"))
    readable = (F.col("column_kind") != DATETIME) & (F.col("values") >= min_values)
    confirmed = F.col("decision").isNotNull() & (F.col("decision") != NOT_PERSONAL)
    matched, cleared = F.col("m_kind").isNotNull() & readable, (F.col("decision") == NOT_PERSONAL) & readable
    known = F.when(F.col("decision").isin(*TOKEN_PREFIX), F.col("decision")).otherwise("free_text")
    judged = table.select(
        "column",
        F.when(confirmed, known).when(matched, F.col("m_kind")).when(cleared, F.coalesce(named, F.lit("free_text"))).when(readable, named).alias("kind"),
        F.when(confirmed, CONFIRMED).when(matched, HIGH).when(cleared, NOT_PERSONAL).when(readable & named.isNotNull(), CANDIDATE).alias("confidence"),
        F.when(~confirmed & matched, F.bround(F.col("m_fraction"), 4)).alias("matched_fraction"),
        F.when(~confirmed & matched, F.col("m_locale")).alias("locale"),
        F.when(confirmed, "confirmed by a person")
        .when(matched & cleared, "marked not personal, but its values verifiably are")
        .when(matched, "values match")
        .when(cleared, "marked not personal by a person")
        .when(readable & named.isNotNull(), "the name suggests it; no value pattern can verify it")
        .alias("reason"),
    )
    return judged.where("confidence is not null")


def redactable(classification: DataFrame, policy: str = STRICT) -> DataFrame:
    """Columns to mask: verified and confirmed ones; under the strict policy candidates too."""
    bands = [HIGH, CONFIRMED, CANDIDATE] if policy == STRICT else [HIGH, CONFIRMED]
    return classification.where(F.col("confidence").isin(*bands)).select("column", "kind")


def tokens(df: DataFrame, column: str, kind: str, key: str | None = None) -> DataFrame:
    """(value, token, n): ``<KIND_1>``, ``<KIND_2>``, … by first appearance in ``key`` order (else by value).

    Numbering is a distributed global index, so a column may have any number of distinct values.
    """
    value = text_of(df, column)
    first = F.min(key) if key else F.min(value)
    distinct = df.where(F.col(column).isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("n"), first.alias("first"))
    indexed = order.global_index(distinct, [F.asc("first"), F.asc("value")])
    prefix = TOKEN_PREFIX.get(kind, "REDACTED")
    return indexed.select("value", F.concat(F.lit(f"<{prefix}_"), F.col("idx") + 1, F.lit(">")).alias("token"), "n")


@dataclass(frozen=True)
class Masked:
    data: DataFrame
    columns: dict[str, str]
    masked_counts: DataFrame  # column, distinct values masked


def mask(df: DataFrame, classification: DataFrame, policy: str = STRICT, key: str | None = None) -> Masked:
    """The table with personal values replaced by per-column tokens; equal values get equal tokens."""
    df = nan_to_null(df)
    chosen = {r["column"]: r["kind"] for r in redactable(classification, policy).collect() if r["column"] in df.columns}
    counts = rows(df.sparkSession, [], "column string, masked bigint")
    # a column that is masked itself may be the key, so all numbering reads the table as it came
    numbering = {c: tokens(df, c, kind, key) for c, kind in chosen.items()}
    data = df
    for column, numbered in numbering.items():
        size = numbered.count()
        counts = counts.unionByName(rows(df.sparkSession, [(column, size)], "column string, masked bigint"))
        lookup = numbered.withColumnRenamed("value", "__masked").withColumnRenamed("token", "__token")
        data = salted_lookup(data.withColumn("__masked", text_of(data, column)), "__masked", lookup, "n", lookup_rows=size)
        data = data.withColumn(column, F.col("__token")).drop("__masked", "__token")
    return Masked(data.select(*df.columns), chosen, counts)


def mask_values(findings: DataFrame, classification: DataFrame, columns: str = "columns", values: str = "values", policy: str = PERMISSIVE) -> DataFrame:
    """Mask the value lists quoted in findings about personal columns, numbered within each list."""
    chosen = {r["column"]: TOKEN_PREFIX.get(r["kind"], "REDACTED") for r in redactable(classification, policy).collect()}
    if not chosen:
        return findings
    prefixes = F.create_map(*[F.lit(x) for pair in chosen.items() for x in pair])
    prefix = F.filter(F.transform(F.col(columns), lambda c: F.try_element_at(prefixes, c)), lambda p: p.isNotNull())[0]
    listed = F.array_distinct(F.col(values))
    masked = F.transform(F.col(values), lambda v: F.when(v.isNotNull(), F.concat(F.lit("<"), prefix, F.lit("_"), F.array_position(listed, v), F.lit(">"))))
    return findings.withColumn(values, F.when(prefix.isNull(), F.col(values)).otherwise(masked))


def egress_record(masked: Masked, consumer: str, policy: str) -> DataFrame:
    """What left: columns, row count, how many values were masked - never a value."""
    names = F.array(*[F.lit(c) for c in masked.data.columns])
    kinds_map = F.create_map(*[F.lit(x) for pair in masked.columns.items() for x in pair]) if masked.columns else F.lit(None).cast("map<string,string>")
    counts = masked.masked_counts.agg(F.map_from_entries(F.collect_list(F.struct("column", "masked")))).scalar()
    return masked.data.agg(F.count("*").alias("row_count")).select(
        F.lit(consumer).alias("consumer"), F.lit(policy).alias("policy"), names.alias("columns"), "row_count", kinds_map.alias("redacted_columns"),
        counts.alias("masked_value_counts"),
    )
