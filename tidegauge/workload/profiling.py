"""Profile, baseline, validation and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import normalise, repair, validate
from tidegauge.operators.profile import profile, sanity_floors
from tidegauge.plans import stats
from tidegauge.session import ensure_checkpoint_dir
from tidegauge.streaming.validation import stream_outcomes, validate_stream
from tidegauge.workload.tables import SPLIT_DATE, Registry, earlier_orders, filled, later_orders, read, rounded

R = Registry()

ORDER_COLUMNS = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_totalprice": "numeric", "o_orderstatus": "categorical", "o_orderpriority": "categorical", "o_orderdate": "datetime"}


def _profile_sql(column: str, kind: str) -> str:
    numbers = f"CAST(min({column}) AS DOUBLE), CAST(max({column}) AS DOUBLE), round(avg({column}), 4), round(stddev_pop({column}), 4)"
    return (
        f"SELECT '{column}' AS \"column\", '{kind}' AS kind, CAST(avg(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END) AS DOUBLE) AS null_rate, "
        + (numbers if kind == "numeric" else "-1.0, -1.0, -1.0, -1.0").replace("-1.0, -1.0, -1.0, -1.0", "CAST(-1 AS DOUBLE), CAST(-1 AS DOUBLE), CAST(-1 AS DOUBLE), CAST(-1 AS DOUBLE)")
        + (f", CAST(count(DISTINCT {column}) AS BIGINT)" if kind == "categorical" else ", CAST(-1 AS BIGINT)")
        + (f", CAST(date_diff('second', min({column}), max({column})) AS DOUBLE) / 86400" if kind == "datetime" else ", CAST(-1 AS DOUBLE)")
        + " FROM orders"
    )


PROFILE_NAMES = ['"column"', "kind", "null_rate", "minimum", "maximum", "mean", "std", "cardinality", "span_days"]


@R.add("WITH p(" + ", ".join(PROFILE_NAMES) + ") AS (" + " UNION ALL ".join(_profile_sql(c, k) for c, k in ORDER_COLUMNS.items()) + ") SELECT * FROM p")
def profile_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = profile(read(spark, sf_dir, "orders")).columns
    shown = columns.select("column", "kind", "null_rate", "minimum", "maximum", rounded("mean", 4).alias("mean"), rounded("std", 4).alias("std"), "cardinality", "span_days")
    return filled(shown, minimum=-1.0, maximum=-1.0, mean=-1.0, std=-1.0, cardinality=-1, span_days=-1.0)


MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _bins_sql(table: str, columns, bins: int) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", g.bin AS bin, CAST(coalesce(h.n, 0) AS BIGINT) AS n
        FROM (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin) g LEFT JOIN (
          SELECT least(greatest(CAST(floor((x - lo) * CAST({bins} AS DOUBLE) / (hi - lo)) AS INTEGER), 0), {bins - 1}) AS bin, count(*) AS n
          FROM (SELECT CAST({c} AS DOUBLE) AS x, (SELECT CAST(min({c}) AS DOUBLE) FROM {table}) AS lo, (SELECT CAST(max({c}) AS DOUBLE) FROM {table}) AS hi FROM {table} WHERE {c} IS NOT NULL)
          GROUP BY 1) h ON g.bin = h.bin"""
        for c in columns
    )


NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *[c for c in MEASURES])


@R.add(_bins_sql("lineitem", NUMBERS, 10))
def profile_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(read(spark, sf_dir, "lineitem"), NUMBERS, 10).select("column", "bin", "n")


def _top_sql(table: str, columns, k: int = 10) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST(i AS INTEGER) AS position, value, n FROM (
        SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS i
        FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) WHERE i <= {k}"""
        for c in columns
    )


@R.add(_top_sql("part", ("p_name", "p_brand", "p_type")))
def profile_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(read(spark, sf_dir, "part")).top_values.select("column", F.col("position").cast("int").alias("position"), "value", "n")


@R.add("""SELECT 'c_name' AS "column" FROM customer HAVING count(DISTINCT c_name) = count(*) AND count(*) >= 10
UNION ALL SELECT 'c_mktsegment' FROM customer HAVING count(DISTINCT c_mktsegment) = count(*) AND count(*) >= 10""")
def profile_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(read(spark, sf_dir, "customer")).excluded.select("column")


@R.add(" UNION ALL ".join(f"""SELECT '{c}' AS "column", least(1000, count({c})) AS sampled, true AS all_known FROM lineitem""" for c in NUMBERS))
def profile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    known = stats.number_counts(items).select("column", "value", F.lit(True).alias("known"))
    return profile(items).sample.join(known, ["column", "value"], "left").groupBy("column").agg(
        F.count("*").alias("sampled"), F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known")
    )


@R.add("""SELECT 'mostly_null' AS "column" FROM orders HAVING avg(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_totalprice > 300000 THEN 0.0 ELSE 1.0 END) > 0.95
UNION ALL SELECT 'constant' FROM orders HAVING stddev_pop(1.0) = 0""")
def baseline_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    rare = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)
    odd = orders.withColumn("mostly_null", F.when(rare, F.col("o_totalprice"))).withColumn("constant", F.lit(1.0))
    return sanity_floors(profile(odd)).select("column")


# -- validation: earlier orders are the baseline, later ones, damaged, the batch -----------------------

def damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = later_orders(spark, sf_dir)
    return (
        later.withColumn("o_totalprice", F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice") * 3))
        .withColumn("o_orderstatus", F.concat(F.lit(" "), F.lower("o_orderstatus")))
        .withColumn("o_custkey", F.col("o_custkey").cast("string"))
        .withColumnRenamed("o_orderpriority", "priority")
    )


def outcomes(spark: SparkSession, sf_dir: str, rules: validate.Rules = validate.Rules()) -> DataFrame:
    return validate.evaluate(damaged(spark, sf_dir), profile(earlier_orders(spark, sf_dir)), rules)


OUTCOME_SQL = f"""
WITH before AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT_DATE}'),
after AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, ' ' || lower(o_orderstatus) AS o_orderstatus,
  CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice * 3 END AS o_totalprice, o_orderdate, o_orderpriority AS priority
  FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT_DATE}'),
"""


@R.add(OUTCOME_SQL + """
cols(c, present, same) AS (VALUES ('o_orderkey', true, true), ('o_custkey', true, false), ('o_orderstatus', true, true), ('o_totalprice', true, true), ('o_orderdate', true, true), ('o_orderpriority', false, false)),
share AS (SELECT (SELECT count(*) FROM before) AS b, (SELECT count(*) FROM after) AS a)
SELECT 'schema_conformance:missing_column:' || c AS rule_id, CASE WHEN present THEN 'passed' ELSE 'failed' END AS status FROM cols
UNION ALL SELECT 'schema_conformance:dtype_mismatch:' || c, CASE WHEN NOT present THEN 'not_applicable' WHEN same THEN 'passed' ELSE 'failed' END FROM cols
UNION ALL SELECT 'schema_conformance:unexpected_column:priority', 'failed'
UNION ALL SELECT 'schema_conformance:row_count_drop', CASE WHEN (b - a) * 1.0 / b > 0.1 THEN 'failed' ELSE 'passed' END FROM share""")
def validation_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).where(F.col("family") == validate.SCHEMA).select("rule_id", "status")


@R.add(OUTCOME_SQL + """
rates AS (
  SELECT 'o_totalprice' AS c, (SELECT avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END) FROM before) AS b, (SELECT avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END) FROM after) AS a
  UNION ALL SELECT 'o_orderkey', 0.0, (SELECT avg(CASE WHEN o_orderkey IS NULL THEN 1.0 ELSE 0.0 END) FROM after)
  UNION ALL SELECT 'o_custkey', 0.0, (SELECT avg(CASE WHEN o_custkey IS NULL THEN 1.0 ELSE 0.0 END) FROM after)
  UNION ALL SELECT 'o_orderstatus', 0.0, (SELECT avg(CASE WHEN o_orderstatus IS NULL THEN 1.0 ELSE 0.0 END) FROM after)
  UNION ALL SELECT 'o_orderdate', 0.0, (SELECT avg(CASE WHEN o_orderdate IS NULL THEN 1.0 ELSE 0.0 END) FROM after))
SELECT 'null_threshold:' || c AS rule_id, CASE WHEN a > b + 0.05 THEN 'failed' ELSE 'passed' END AS status, round_even(a, 6) AS current_null_rate FROM rates
UNION ALL SELECT 'null_threshold:o_orderpriority', 'not_applicable', CAST(-1 AS DOUBLE)""")
def validation_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes(spark, sf_dir).where(F.col("family") == validate.NULLS)
    return filled(found.select("rule_id", "status", rounded(F.col("detail")["current_null_rate"].cast("double")).alias("current_null_rate")), current_null_rate=-1.0)


def _psi_sql(column: str) -> str:
    return f"""SELECT '{column}' AS c, sum((cur - base) * ln(cur / base)) AS score FROM (
      SELECT g.bin, CASE WHEN coalesce(b.n, 0) = 0 THEN 0.0001 ELSE b.n * 1.0 / (SELECT count({column}) FROM before) END AS base,
             CASE WHEN coalesce(a.n, 0) = 0 THEN 0.0001 ELSE a.n * 1.0 / (SELECT count({column}) FROM after) END AS cur
      FROM (SELECT unnest(range(10)) AS bin) g
      LEFT JOIN (SELECT least(CAST(floor((CAST({column} AS DOUBLE) - lo) * 10.0 / (hi - lo)) AS BIGINT), 9) AS bin, count(*) AS n FROM before, lim_{column} WHERE {column} IS NOT NULL GROUP BY 1) b ON b.bin = g.bin
      LEFT JOIN (SELECT list_sum(list_transform(range(1, 10), lambda k: CASE WHEN CAST({column} AS DOUBLE) >= lo + k * ((hi - lo) / 10.0) THEN 1 ELSE 0 END)) AS bin, count(*) AS n FROM after, lim_{column} WHERE {column} IS NOT NULL GROUP BY 1) a ON a.bin = g.bin)"""


@R.add(OUTCOME_SQL + ", ".join(f"lim_{c} AS (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM before)" for c in ("o_orderkey", "o_totalprice"))
       + ", s AS (" + " UNION ALL ".join(_psi_sql(c) for c in ("o_orderkey", "o_totalprice"))
       + ") SELECT c AS \"column\", round_even(score, 5) AS score, CASE WHEN score > 0.2 THEN 'failed' ELSE 'passed' END AS status FROM s")
def validation_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outcomes(spark, sf_dir).where((F.col("family") == validate.DRIFT) & (F.col("status") != validate.NOT_APPLICABLE))
    return found.select("column", rounded(F.col("detail")["score"].cast("double"), 5).alias("score"), "status")


@R.add("""WITH base AS (SELECT c_acctbal AS x FROM customer WHERE c_mktsegment = 'BUILDING'), cur AS (SELECT c_acctbal AS x FROM customer),
pts AS (SELECT DISTINCT x FROM base),
d AS (SELECT greatest(
  abs((SELECT count(*) FROM base b WHERE b.x <= pts.x) * 1.0 / (SELECT count(*) FROM base) - (SELECT count(*) FROM cur c WHERE c.x <= pts.x) * 1.0 / (SELECT count(*) FROM cur)),
  abs((SELECT count(*) FROM base b WHERE b.x < pts.x) * 1.0 / (SELECT count(*) FROM base) - (SELECT count(*) FROM cur c WHERE c.x < pts.x) * 1.0 / (SELECT count(*) FROM cur))) AS gap FROM pts)
SELECT 'c_acctbal' AS "column", round_even(max(gap), 6) AS score, CASE WHEN max(gap) > 0.2 THEN 'failed' ELSE 'passed' END AS status FROM d""")
def validation_ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does one market segment's balance differ from everybody's? (The segment fits the stored sample.)"""
    customers = read(spark, sf_dir, "customer")
    baseline = profile(customers.where("c_mktsegment = 'BUILDING'").select("c_acctbal"))
    found = validate.evaluate(customers.select("c_acctbal"), baseline, validate.Rules(drift_test="ks")).where(F.col("family") == validate.DRIFT)
    return found.select("column", rounded(F.col("detail")["score"].cast("double")).alias("score"), "status")


@R.add(OUTCOME_SQL + """
v AS (SELECT (SELECT list_sort(list(DISTINCT o_orderstatus)) FROM before) AS b, (SELECT list_sort(list(DISTINCT o_orderstatus)) FROM after) AS a,
  (SELECT list_sort(list(DISTINCT lower(trim(o_orderstatus)))) FROM before) AS bf, (SELECT list_sort(list(DISTINCT lower(trim(o_orderstatus)))) FROM after) AS af)
SELECT 'o_orderstatus' AS "column", CASE WHEN a <> b AND af = bf THEN 'failed' ELSE 'passed' END AS status FROM v
UNION ALL SELECT c, 'not_applicable' FROM (VALUES ('o_orderkey'), ('o_custkey'), ('o_totalprice'), ('o_orderdate'), ('o_orderpriority')) t(c)""")
def validation_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes(spark, sf_dir).where(F.col("family") == validate.CATEGORY).select("column", "status")


@R.add("""WITH counts AS (SELECT (SELECT count(*) FROM customer) AS n, (SELECT count(DISTINCT c_name) FROM customer) AS d)
SELECT p || 'c_name' AS rule_id, CASE WHEN n = d THEN 'not_applicable' ELSE 'passed' END AS status
FROM counts, (VALUES ('schema_conformance:missing_column:'), ('schema_conformance:dtype_mismatch:'), ('null_threshold:'), ('distribution_drift:'), ('categorical_drift:')) t(p)""")
def validation_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    found = validate.evaluate(customers, profile(customers))
    return found.where(F.col("column") == "c_name").select("rule_id", "status")


# what the file itself was found to be (0.4 sure of utf-8, read as latin-1 with a warning) fails whatever its rows hold; the dates are counted
@R.add("""SELECT * FROM (VALUES ('low_confidence_encoding:utf-8', 'failed'), ('encoding_fallback_overruled:utf-8->latin-1', 'failed'), ('connector_warning:0', 'failed')) t(rule_id, status)
UNION ALL SELECT 'datetime_partial_parse:o_orderdate', CASE WHEN avg(CASE WHEN o_orderstatus = 'P' OR o_orderdate IS NULL THEN 0.0 ELSE 1.0 END) >= 0.99 THEN 'passed' ELSE 'failed' END FROM orders""")
def validation_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding, fallback, warnings and partial dates of a landed text."""
    orders = read(spark, sf_dir, "orders").withColumn("o_orderdate", F.when(F.col("o_orderstatus") == "P", F.lit("unknown 1")).otherwise(F.col("o_orderdate").cast("string")))
    dates = normalise.datetimes(orders)
    arrival = validate.Arrival("utf-8", 0.4, "latin-1", ("read as latin-1",), dates.attempts)
    rules = validate.arrival_rules(orders, arrival, validate.Rules())
    return rules.unionByName(validate.connector_warnings(orders, arrival)).select("rule_id", "status")


@R.add(OUTCOME_SQL + """
folded AS (SELECT 'null_threshold:o_totalprice' AS rule_id, 'bigint' AS was, 'double' AS became
  FROM (SELECT (SELECT avg(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END) FROM after) AS a) WHERE a > 0.05)
SELECT * FROM folded""")
def validation_folded_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole-number column that came back as double with nulls is one failure."""
    before = earlier_orders(spark, sf_dir).withColumn("o_totalprice", F.col("o_totalprice").cast("bigint"))
    found = validate.failures(validate.evaluate(damaged(spark, sf_dir), profile(before)))
    noted = found.where(F.col("detail")["dtype_change_expected"].isNotNull())
    return noted.select("rule_id", F.col("detail")["dtype_change_expected"].alias("was"), F.col("detail")["dtype_change_actual"].alias("became"))


@R.add(OUTCOME_SQL + """
c AS (SELECT (SELECT count(DISTINCT o_orderpriority) FROM before) AS b, (SELECT count(DISTINCT priority) FROM after) AS a)
SELECT 'o_orderpriority' AS missing, 'priority' AS unexpected, round_even(abs(b - a) * 1.0 / greatest(a, b, 1), 6) AS distance FROM c""")
def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, baseline = damaged(spark, sf_dir), profile(earlier_orders(spark, sf_dir))
    pairs = repair.rename_pairs(validate.evaluate(batch, baseline), baseline, batch)
    return pairs.select("missing", "unexpected", rounded("distance").alias("distance"))


def propose(groups: DataFrame) -> DataFrame:
    """A stand-in for a reviewer: the obvious action for each kind of failure."""
    kind = groups.groupBy("group_id").agg(F.max("correlation_rule").alias("pair"), F.min("rule_id").alias("rule"))
    action = (
        F.when(F.col("pair").isNotNull(), repair.RENAME).when(F.col("rule").contains(":dtype_mismatch:"), repair.CAST)
        .when(F.col("rule").startswith(validate.CATEGORY), repair.CASE).otherwise(repair.STRIP)
    )
    return kind.select("group_id", action.alias("action"), F.lit("low").alias("risk_level"), F.lit(0.9).alias("confidence"))


@R.add("""SELECT * FROM (VALUES ('rename_column', 'auto_apply', 1), ('safe_type_cast', 'auto_apply', 1), ('normalize_case', 'auto_apply', 1), ('strip_whitespace', 'escalate', 2)) t(action, decision, fixes)""")
def repair_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, baseline = damaged(spark, sf_dir), profile(earlier_orders(spark, sf_dir))
    groups = repair.correlate(validate.evaluate(batch, baseline), baseline, batch)
    verdicts = repair.gate(groups, propose(groups))
    return verdicts.groupBy("action", "decision").agg(F.count("*").cast("int").alias("fixes"))


@R.add(f"""SELECT o_orderstatus, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, max(o_orderkey) AS last_order
FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT_DATE}' GROUP BY 1, 2""")
def repaired_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renamed, recast and respelled by verified fixes, the damaged batch agrees with the original again."""
    baseline = profile(earlier_orders(spark, sf_dir))
    result = repair.repair_all(damaged(spark, sf_dir), baseline, propose)
    fixed = repair.repaired_table(damaged(spark, sf_dir), result.chain, baseline)
    keys = fixed.where(F.col("o_custkey").isNotNull()).groupBy("o_orderstatus", "o_orderpriority")
    distinct = fixed.select("o_orderstatus", "o_orderpriority", "o_custkey").distinct().groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("customers"))
    return keys.agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_order")).join(distinct, ["o_orderstatus", "o_orderpriority"])


@R.add("""WITH r AS (SELECT (SELECT avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) FROM events) AS n)
SELECT CAST(0 AS BIGINT) AS batch_id, 'null_threshold:value' AS rule_id, CASE WHEN n > 0.05 THEN 'failed' ELSE 'passed' END AS status FROM r
UNION ALL SELECT 0, 'schema_conformance:row_count_drop', 'passed'
UNION ALL SELECT 0, 'categorical_drift:event_type', 'passed'""")
def validation_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, checked batch by batch against its own profile."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    baseline = profile(events)
    stream = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = f"{ensure_checkpoint_dir(spark)}/stream-{spark.sparkContext.applicationId}-{spark.sql('select uuid()').first()[0]}"
    validate_stream(stream.select(*events.columns), baseline, f"{folder}/out", f"{folder}/state").awaitTermination()
    wanted = ["null_threshold:value", "schema_conformance:row_count_drop", "categorical_drift:event_type"]
    return stream_outcomes(spark, f"{folder}/out").where(F.col("rule_id").isin(*wanted)).select("batch_id", "rule_id", "status")


QUERIES, ORACLES = R.queries, R.oracles
