"""Exploration statistics, chart data and column roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import explore, roles
from tidegauge.plans import order, stats
from tidegauge.workload.profiling import _bins_sql, _top_sql
from tidegauge.workload.tables import Registry, filled, read, rounded

R = Registry()

ITEM_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _numeric_sql(table: str, column: str) -> str:
    q = f"quantile_cont(CAST({column} AS DOUBLE), "
    return f"""SELECT '{column}' AS "column", count(*) AS count, count(*) - count({column}) AS null_count, CAST(min({column}) AS DOUBLE) AS minimum,
    CAST(max({column}) AS DOUBLE) AS maximum, round_even(avg({column}), 4) AS mean, round_even(stddev_pop({column}), 4) AS std, round_even({q}0.25), 4) AS q1, round_even({q}0.5), 4) AS median,
    round_even({q}0.75), 4) AS q3, round_even(skewness({column}), 4) AS skew FROM {table}"""


@R.add(" UNION ALL ".join(_numeric_sql("lineitem", c) for c in ITEM_NUMBERS))
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = explore.numeric_summary(read(spark, sf_dir, "lineitem"))
    return found.select(
        "column", "count", "null_count", "minimum", "maximum", *[rounded(c, 4).alias(c) for c in ("mean", "std", "q1", "median", "q3", "skew")]
    )


def _categorical_sql(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", (SELECT count(*) FROM {table}) AS count, (SELECT count(DISTINCT {column}) FROM {table}) AS cardinality,
    (SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode"""


@R.add(" UNION ALL ".join(_categorical_sql("part", c) for c in ("p_name", "p_brand", "p_type")))
def categorical_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.categorical_summary(read(spark, sf_dir, "part")).select("column", "count", "cardinality", "mode")


@R.add(_top_sql("lineitem", ("l_returnflag", "l_linestatus")))
def top_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.top_frequencies(read(spark, sf_dir, "lineitem")).select("column", F.col("position").cast("int").alias("position"), "value", "n")


@R.add("""WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS day, date_trunc('month', ts) AS month, date_trunc('hour', ts) AS hour FROM events),
k(c, v) AS (SELECT DISTINCT 'day', day FROM d UNION SELECT DISTINCT 'month', month FROM d UNION SELECT DISTINCT 'hour', hour FROM d),
g AS (SELECT c, v, date_diff('hour', lag(v) OVER (PARTITION BY c ORDER BY v), v) AS gap FROM k),
s AS (SELECT c, count(*) AS n, min(v) AS lo, max(v) AS hi, count(DISTINCT gap) AS gaps, max(gap) AS gap FROM g GROUP BY 1)
SELECT c AS "column", strftime(lo, '%Y-%m-%d %H:%M:%S') AS first_at, strftime(hi, '%Y-%m-%d %H:%M:%S') AS last_at,
  CAST(date_diff('hour', lo, hi) AS DOUBLE) / 24 AS span_days,
  CASE WHEN n < 3 THEN '' WHEN gaps = 1 AND gap % 168 = 0 THEN 'W' WHEN gaps = 1 AND gap % 24 = 0 THEN CASE WHEN gap > 24 THEN CAST(gap // 24 AS VARCHAR) ELSE '' END || 'D'
       WHEN gaps = 1 THEN CASE WHEN gap > 1 THEN CAST(gap AS VARCHAR) ELSE '' END || 'h' WHEN c = 'month' THEN 'MS' ELSE '' END AS frequency FROM s""")
def datetime_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times by hour, day and month: span, and the spacing of the distinct instants."""
    events = read(spark, sf_dir, "events").select(*[F.date_trunc(unit, F.col("ts").cast("timestamp")).alias(unit) for unit in ("day", "month", "hour")])
    found = explore.datetime_summary(events)
    stamp = "yyyy-MM-dd HH:mm:ss"
    return filled(found.select("column", F.date_format("first_at", stamp).alias("first_at"), F.date_format("last_at", stamp).alias("last_at"), "span_days", "frequency"), frequency="")


@R.add("""WITH c AS (SELECT 'c_name' AS c, count(DISTINCT c_name) AS d, count(c_name) AS n FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(c_mktsegment) FROM customer)
SELECT c AS "column", d AS cardinality, CASE WHEN d * 1.0 / n >= 0.99 THEN 'near_unique' ELSE 'high_cardinality' END AS note FROM c WHERE n >= 10 AND d * 1.0 / n >= 0.9""")
def cardinality_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.cardinality_notes(read(spark, sf_dir, "customer")).select("column", "cardinality", "note")


def with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with two columns missing together, and a third missing only there but not always."""
    hole = F.col("o_orderkey") % 7 == 0
    return read(spark, sf_dir, "orders").withColumns({
        "o_totalprice": F.when(~hole, F.col("o_totalprice")), "o_orderpriority": F.when(~hole, F.col("o_orderpriority")),
        "o_orderstatus": F.when(~(hole & (F.col("o_custkey") % 2 == 0)), F.col("o_orderstatus")),
    })


@R.add("""WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS h, count(*) FILTER (WHERE o_orderkey % 7 = 0 AND o_custkey % 2 = 0) AS s FROM orders)
SELECT 'o_orderpriority' AS narrower, 'o_totalprice' AS broader, 'co_occurring' AS relationship, h AS support, CAST(1 AS DOUBLE) AS confidence FROM t
UNION ALL SELECT 'o_orderstatus', 'o_orderpriority', 'one_directional', s, CAST(1 AS DOUBLE) FROM t
UNION ALL SELECT 'o_orderstatus', 'o_totalprice', 'one_directional', s, CAST(1 AS DOUBLE) FROM t""")
def missing_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.missing_patterns(with_holes(spark, sf_dir)).select("narrower", "broader", "relationship", "support", "confidence")


PAIRED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
PAIRS = [(a, b) for a in sorted(PAIRED) for b in sorted(PAIRED) if a < b]


@R.add(" UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round_even(corr({a}, {b}), 6) AS coefficient, count(*) AS n FROM lineitem" for a, b in PAIRS))
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = explore.correlations(read(spark, sf_dir, "lineitem"), PAIRED, all_pairs=True, methods=("pearson",))
    return found.where("method = 'pearson'").select("column_a", "column_b", rounded("coefficient").alias("coefficient"), "n")


@R.add("WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in PAIRED) + " FROM lineitem) "
       + " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round_even(corr({a}, {b}), 6) AS coefficient FROM r" for a, b in PAIRS))
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = explore.correlations(read(spark, sf_dir, "lineitem"), PAIRED, all_pairs=True, methods=("spearman",))
    return found.where("method = 'spearman'").select("column_a", "column_b", rounded("coefficient").alias("coefficient"))


@R.add("""WITH h AS (SELECT CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS p, o_custkey AS c FROM orders),
r AS (SELECT rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rp, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc FROM h WHERE p IS NOT NULL)
SELECT round_even(corr(rp, rc), 6) AS coefficient, count(*) AS n FROM r""")
def spearman_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks are taken over the rows where both columns are present."""
    found, _ = explore.correlations(with_holes(spark, sf_dir), ("o_custkey", "o_totalprice"), all_pairs=True)
    return found.where("method = 'spearman'").select(rounded("coefficient").alias("coefficient"), "n")


def _outlier_sql(table: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", any_value(lo) AS lower, any_value(hi) AS upper, count(*) FILTER (WHERE x < lo OR x > hi) AS count FROM (
    SELECT x, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q3 - q1 AS iqr FROM (SELECT CAST({column} AS DOUBLE) AS x FROM {table} WHERE {column} IS NOT NULL),
    (SELECT quantile_cont(CAST({column} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({column} AS DOUBLE), 0.75) AS q3 FROM {table})) WHERE iqr <> 0 HAVING count(*) FILTER (WHERE x < lo OR x > hi) > 0"""


@R.add('WITH o AS (' + _outlier_sql("documents", "n_chars") + " UNION ALL " + _outlier_sql("events", "value") + ') SELECT "column", round_even(lower, 3) AS lower, round_even(upper, 3) AS upper, count FROM o')
def outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = explore.outlier_clusters(read(spark, sf_dir, "documents"), ["n_chars"], "doc_id")
    values = explore.outlier_clusters(read(spark, sf_dir, "events"), ["value"], "event_id")
    return texts.unionByName(values).select("column", rounded("lower", 3).alias("lower"), rounded("upper", 3).alias("upper"), "count")


@R.add("""WITH q AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3 FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS example FROM documents, q WHERE n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1) ORDER BY doc_id LIMIT 10""")
def outlier_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.outlier_clusters(read(spark, sf_dir, "documents"), ["n_chars"], "doc_id").select(F.explode("examples").alias("example"))


@R.add(" UNION ALL ".join(
    f"""SELECT '{y}' AS numeric_column, round_even(regr_slope({y}, x) * 1e6, 5) AS slope_per_million, round_even(regr_r2({y}, x) * 1000, 5) AS r_squared_thousandths, count(*) AS n
    FROM (SELECT *, date_diff('second', (SELECT min(l_shipdate) FROM lineitem), l_shipdate) AS x FROM lineitem)""" for y in PAIRED))
def trend_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = explore.Settings(trend_floor=0.0)
    found, _ = explore.trends(read(spark, sf_dir, "lineitem"), ["l_shipdate"], PAIRED, settings, seasonality=False)
    return found.select("numeric_column", rounded(F.col("slope") * 1e6, 5).alias("slope_per_million"), rounded(F.col("r_squared") * 1000, 5).alias("r_squared_thousandths"), "n")


LAGS = (7, 12, 24, 30, 52, 365)


@R.add("""WITH d AS (SELECT o_orderdate AS t, sum(o_totalprice) AS v FROM orders GROUP BY 1),
x AS (SELECT v, """ + ", ".join(f"lag(v, {k}) OVER (ORDER BY t) AS v{k}" for k in LAGS) + " FROM d) "
       + " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS row_lag, round_even(corr(v, v{k}), 6) AS acf FROM x" for k in LAGS))
def autocorrelation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue against itself some rows earlier."""
    daily = read(spark, sf_dir, "orders").groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("v"))
    shifted = order.with_earlier(daily, [F.asc("o_orderdate")], "v", LAGS)
    wide = shifted.agg(*[rounded(F.corr("v", f"lag_{k}")).alias(str(k)) for k in LAGS])
    return wide.unpivot([], [str(k) for k in LAGS], "row_lag", "acf").select(F.col("row_lag").cast("int").alias("row_lag"), "acf")


def _k2_sql(table: str, column: str) -> str:
    return f"""(WITH m AS (SELECT CAST({column} AS DOUBLE) AS x FROM {table} WHERE {column} IS NOT NULL), a AS (SELECT avg(x) AS mu, CAST(count(*) AS DOUBLE) AS n FROM m),
    p AS (SELECT any_value(n) AS n, avg((x - mu) ** 2) AS m2, avg((x - mu) ** 3) AS m3, avg((x - mu) ** 4) AS m4 FROM m, a),
    g AS (SELECT n, m3 / m2 ** 1.5 AS g1, m4 / m2 ** 2 AS b2 FROM p),
    s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta FROM g),
    s2 AS (SELECT *, sqrt(2 * (beta - 1)) - 1 AS w2, 3 * (n - 1) / (n + 1) AS e, 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)) AS v,
      6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS bb FROM s),
    s3 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, (b2 - e) / sqrt(v) AS xx, 6 + 8 / bb * (2 / bb + sqrt(1 + 4 / (bb * bb))) AS aa FROM s2),
    s4 AS (SELECT *, 1 + xx * sqrt(2 / (aa - 4)) AS t FROM s3),
    s5 AS (SELECT *, (1 - 2 / (9 * aa) - sign(t) * cbrt(abs((1 - 2 / aa) / t))) / sqrt(2 / (9 * aa)) AS z2 FROM s4)
    SELECT '{column}' AS "column", round_even(exp(-(z1 * z1 + z2 * z2) / 2), 5) AS p_value, CASE WHEN exp(-(z1 * z1 + z2 * z2) / 2) >= 0.05 THEN 'likely_normal' ELSE 'likely_non_normal' END AS normality FROM s5)"""


@R.add(_k2_sql("customer", "c_acctbal") + " UNION ALL " + _k2_sql("customer", "c_custkey") + " UNION ALL " + _k2_sql("customer", "c_nationkey"))
def normality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.distribution_shape(read(spark, sf_dir, "customer")).select("column", rounded("p_value", 5).alias("p_value"), "normality")


@R.add(_bins_sql("events", ("value",), 12) + " UNION ALL " + _bins_sql("documents", ("n_chars",), 12))
def modality_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stats.histogram(read(spark, sf_dir, "events"), ["value"], 12)
    return events.unionByName(stats.histogram(read(spark, sf_dir, "documents"), ["n_chars"], 12)).select("column", "bin", "n")


@R.add(f"""WITH b AS ({_bins_sql("lineitem", ITEM_NUMBERS, 12)}), h AS (SELECT "column", list(n ORDER BY bin) AS c, sum(n) AS rows FROM b GROUP BY 1),
p AS (SELECT "column", c, unnest(list_filter(range(1, len(c) + 1), lambda i: c[i] > coalesce(c[i - 1], -1) AND c[i] > coalesce(c[i + 1], -1) AND c[i] >= {explore.PEAK_SHARE} * list_max(c))) AS i FROM h),
t AS (SELECT j."column", j.c AS c, j.i AS j, first(a.i ORDER BY a.c[a.i] DESC, a.i) AS i FROM p j JOIN p a ON a."column" = j."column" AND a.i < j.i GROUP BY ALL),
v AS (SELECT DISTINCT "column" FROM t WHERE list_min(c[i:j]) <= {explore.VALLEY_SHARE} * least(c[i], c[j]))
SELECT "column", CASE WHEN rows < 20 THEN 'insufficient_data' WHEN "column" IN (SELECT "column" FROM v) THEN 'multimodal_suspected' ELSE 'unimodal' END AS modality FROM h""")
def modality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.distribution_shape(read(spark, sf_dir, "lineitem")).select("column", "modality")


@R.add("SELECT least(count(*), 50000) AS n, least(count(*), 50000) AS distinct_keys FROM events")
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seeded row cap: the same rows for any partitioning, each once."""
    chosen = explore.seeded_rows(read(spark, sf_dir, "events"), "event_id", 50_000)
    return chosen.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("distinct_keys"))


@R.add()
def explore_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings of the orders table, identifiers left out of the statistics."""
    orders = with_holes(spark, sf_dir)
    excluded = roles.identifier_exclusions(roles.detect(orders))
    findings, _ = explore.explore(orders, excluded, "o_orderkey")
    return findings.select("finding_id", "finding_type", F.array_join("columns", ",").alias("columns"), "sample_size")


@R.add("""SELECT 'o_orderkey' AS subject, 'excluded: detected as transaction identifier' AS reason
UNION ALL SELECT 'o_custkey', 'excluded: detected as entity identifier'
UNION ALL SELECT 'o_totalprice@o_orderdate', 'weak line: r2 0.000 < 0.3' FROM orders HAVING corr(o_totalprice, epoch(o_orderdate)) ** 2 < 0.0005""")
def explore_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    excluded = roles.identifier_exclusions(roles.detect(orders))
    return explore.explore(orders, excluded, "o_orderkey")[1]


@R.add("SELECT o_orderstatus AS action_taken, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def quality_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as events, their status as how they were resolved ('P': not at all)."""
    events = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("action_taken"))
    return explore.quality_context(events)


# -- chart data --------------------------------------------------------------------------------------

@R.add(_bins_sql("orders", ("o_totalprice",), 50))
def histogram_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.histogram_bars(read(spark, sf_dir, "orders"), ["o_totalprice"]).select("column", "bin", "n")


@R.add("SELECT l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1")
def integer_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.integer_bars(read(spark, sf_dir, "lineitem"), "l_linenumber")


@R.add(_top_sql("customer", ("c_mktsegment",)))
def category_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.category_bars(read(spark, sf_dir, "customer")).select("column", F.col("position").cast("int").alias("position"), "value", "n")


@R.add("""WITH i AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, o_custkey, o_totalprice, greatest(1, (SELECT count(*) FROM orders) // 5000) AS stride FROM orders)
SELECT idx, o_custkey, o_totalprice FROM i WHERE idx % stride = 0 AND idx / stride < 5000""")
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.scatter_points(read(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"])


@R.add("SELECT strftime(o_orderdate, '%Y-%m-%d') AS x, o_totalprice AS y FROM orders")
def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = explore.line_points(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")
    return points.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("x"), F.col("o_totalprice").alias("y"))


# -- roles -------------------------------------------------------------------------------------------

ROLE_TABLES = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
}
DATES = ("o_orderdate", "l_shipdate")
TEXTS = ("o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus", "c_name", "c_mktsegment")


def _facts_sql(table: str, column: str) -> str:
    if column in DATES:  # neither an identifier nor a number: refused like a measure that is not above zero
        shape = "CAST(1 AS DOUBLE) AS fractions, CAST(0 AS DOUBLE) AS negatives, CAST(0 AS DOUBLE) AS high, CAST(0 AS DOUBLE) AS skew, true AS numeric"
    elif column in TEXTS:
        shape = "CAST(0 AS DOUBLE) AS fractions, CAST(0 AS DOUBLE) AS negatives, CAST(0 AS DOUBLE) AS high, CAST(0 AS DOUBLE) AS skew, false AS numeric"
    else:
        shape = f"CAST(count(*) FILTER (WHERE {column} <> floor({column})) AS DOUBLE), CAST(count(*) FILTER (WHERE {column} < 0) AS DOUBLE), CAST(max({column}) AS DOUBLE), CAST(skewness({column}) AS DOUBLE), true"
    return f"""SELECT '{table}' AS "table", '{column}' AS c, count({column}) AS n, count(DISTINCT {column}) AS d, {shape} FROM {table}"""


FACTS_SQL = 'WITH f("table", c, n, d, fractions, negatives, high, skew, numeric) AS (' + " UNION ALL ".join(_facts_sql(t, c) for t, cs in ROLE_TABLES.items() for c in cs) + "), u AS (SELECT *, d * 1.0 / n AS uq, n * 1.0 / d AS grp, numeric AND fractions > 0 AS measure FROM f)"


def _role_frames(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    result = None
    for table, columns in ROLE_TABLES.items():
        found = roles.detect(read(spark, sf_dir, table).select(*columns)).candidates.where(F.col("role").isin(*wanted))
        found = found.select(F.lit(table).alias("table"), F.col("column").alias("c"), "role", "score", "band")
        result = found if result is None else result.unionByName(found)
    return result


BAND_SQL = "CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS band"


@R.add(FACTS_SQL + f""", e AS (SELECT "table", c, 'entity_id' AS role, CASE WHEN measure OR d < 2 OR uq > 0.95 THEN 0.0 ELSE greatest(0, CASE WHEN uq BETWEEN 0.001 AND 0.7 THEN 0.6 ELSE 0.35 END) END
    + CASE WHEN NOT (measure OR d < 2 OR uq > 0.95) AND regexp_matches(c, '(?i){roles.NAME_PATTERNS["entity_id"]}') THEN 0.2 ELSE 0.0 END AS score FROM u
  UNION ALL SELECT "table", c, 'transaction_id', CASE WHEN measure OR (uq < 0.9 AND (grp NOT BETWEEN 1.2 AND 50 OR d < 5)) THEN 0.0
    ELSE CASE WHEN uq >= 0.9 THEN 0.6 ELSE 0.45 END + CASE WHEN regexp_matches(c, '(?i){roles.NAME_PATTERNS["transaction_id"]}') THEN 0.2 ELSE 0.0 END END FROM u)
SELECT "table", c, role, CAST(round(score, 3) AS DOUBLE) AS score, {BAND_SQL} FROM e""")
def role_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each column of three tables looks like an entity or a transaction."""
    return _role_frames(spark, sf_dir, "entity_id", "transaction_id")


@R.add(FACTS_SQL + f""", e AS (SELECT "table", c, 'monetary' AS role, CASE WHEN NOT numeric OR negatives / n > 0.05 OR high <= 0 THEN 0.0 ELSE 0.4
    + CASE WHEN NOT regexp_matches(c, '(?i){roles.NAME_PATTERNS["monetary"]}') AND fractions = 0 AND high <= 100 THEN -0.2 WHEN skew > 0.2 THEN 0.15 ELSE 0.0 END
    + CASE WHEN regexp_matches(c, '(?i){roles.REVENUE}') THEN 0.3 WHEN regexp_matches(c, '(?i){roles.COST}') THEN 0.1 WHEN regexp_matches(c, '(?i){roles.NAME_PATTERNS["monetary"]}') THEN 0.2 ELSE 0.0 END END AS score FROM u
  UNION ALL SELECT "table", c, 'quantity', CASE WHEN NOT numeric OR fractions > 0 OR negatives > 0 OR high > 1000 OR regexp_matches(c, '(?i){roles.IDENTIFIER}')
    OR regexp_matches(c, '(?i){roles.NAME_PATTERNS["monetary"]}') OR d > 50 THEN 0.0 ELSE least(1.0, 0.5 + CASE WHEN regexp_matches(c, '(?i){roles.NAME_PATTERNS["quantity"]}') THEN 0.2 ELSE 0.0 END) END FROM u)
SELECT "table", c, role, CAST(round(score, 3) AS DOUBLE) AS score, {BAND_SQL} FROM e""")
def role_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each column of three tables looks like money or a quantity."""
    return _role_frames(spark, sf_dir, "monetary", "quantity")


ITEM_COLUMNS = [c for c in ROLE_TABLES["lineitem"] if c != "l_orderkey"]


@R.add(" UNION ALL ".join(
    f"""SELECT '{c}' AS c, CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, {c} FROM lineitem)) * 1.0 / (SELECT count(DISTINCT l_orderkey) FROM lineitem) <= 1 THEN CAST(0 AS DOUBLE)
    ELSE CAST(0.6 + CASE WHEN regexp_matches('{c}', '(?i){roles.NAME_PATTERNS["item_id"]}') THEN 0.2 ELSE 0.0 END AS DOUBLE) END AS score""" for c in ITEM_COLUMNS if c not in DATES)
    + " UNION ALL SELECT 'l_shipdate', CAST(0 AS DOUBLE)")
def role_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with several values per order."""
    found = roles.detect(read(spark, sf_dir, "lineitem").select(*ROLE_TABLES["lineitem"])).candidates
    return found.where("role = 'item_id'").select(F.col("column").alias("c"), "score")


NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
# no text of these columns reads as a number, so they have neither fractions nor negatives
OTHERS = ("l_returnflag", "l_linestatus", "l_shipdate")


@R.add(" UNION ALL ".join(
    [f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(DISTINCT {c}) AS "distinct", count(*) FILTER (WHERE {c} <> round_even({c}, 0)) AS fractions, count(*) FILTER (WHERE {c} < 0) AS negatives,
    count({c}) > 0 AS numeric_like FROM lineitem""" for c in NUMBERS]
    + [f"SELECT '{c}', count({c}), count(DISTINCT {c}), count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)), 0, count(TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE)) > 0 FROM lineitem" for c in OTHERS]
))
def role_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.column_facts(read(spark, sf_dir, "lineitem")).select("column", "non_null", "distinct", "fractions", "negatives", "numeric_like")


def _named(pattern: str) -> str:
    return f"regexp_matches(c, '(?i){pattern}')"


def _by_name(role: str) -> str:
    return _named(roles.NAME_PATTERNS[role])


def _role_sql() -> dict[str, tuple[str, str]]:
    """role -> (what refuses a column, its score otherwise) over facts u(c, kind, n, d, fractions, negatives, low, high, skew, span)."""
    measure, money, metric = "(kind = 'number' AND fractions > 0)", _by_name("monetary"), _named(roles.AD_METRIC)
    dated, number, like = "kind = 'date'", "kind <> 'number'", "NOT numeric_like"
    year = f"({_by_name('crop_year')} OR (numeric_like AND fractions = 0 AND low >= 1900 AND high <= 2100))"
    bonus = lambda role, w: f"CASE WHEN {_by_name(role)} THEN {w} ELSE 0.0 END"
    counter = f"CASE WHEN {_named(roles.ROW_COUNTER)} THEN 0.3 ELSE 0.0 END"
    found = {
        "entity_id": (f"{metric} OR n = 0 OR {dated} OR {measure} OR d < 2 OR uq > 0.95", f"greatest(0.0, CASE WHEN uq BETWEEN 0.001 AND 0.7 THEN 0.6 ELSE 0.35 END - {counter} + {bonus('entity_id', 0.2)})"),
        "transaction_id": (f"{metric} OR n = 0 OR {dated} OR {measure} OR (uq < 0.9 AND (grp NOT BETWEEN 1.2 AND 50 OR d < 5))", f"greatest(0.0, CASE WHEN uq >= 0.9 THEN 0.6 ELSE 0.45 END - {counter} + {bonus('transaction_id', 0.2)})"),
        "event_date": ("kind <> 'date' OR n = 0 OR d < 2", f"least(1.0, CASE WHEN span >= 1 THEN 0.75 ELSE 0.5 END + {bonus('event_date', 0.2)})"),
        "monetary": (f"{number} OR n = 0 OR negatives * 1.0 / n > 0.05 OR high <= 0", f"""greatest(0.0, 0.4 + CASE WHEN NOT {money} AND fractions = 0 AND high <= 100 THEN -0.2 WHEN skew > 0.2 THEN 0.15 ELSE 0.0 END
          + CASE WHEN {_named(roles.REVENUE)} THEN 0.3 WHEN {_named(roles.COST)} THEN 0.1 WHEN {money} THEN 0.2 ELSE 0.0 END)"""),
        "quantity": (f"{number} OR n = 0 OR fractions > 0 OR negatives > 0 OR high > 1000 OR {_named(roles.IDENTIFIER)} OR {money} OR d > 50", f"least(1.0, 0.5 + {bonus('quantity', 0.2)})"),
        "campaign_id": (f"{dated} OR {measure} OR n = 0 OR d < 2 OR uq > 0.9", f"0.3 + {bonus('campaign_id', 0.4)}"),
        "ctr": (f"{like} OR low < 0 OR high > 100", f"0.3 + {bonus('ctr', 0.4)}"),
        "frequency": (f"{like} OR low < 0 OR high > 50", f"0.3 + {bonus('frequency', 0.4)}"),
        "crop_year": (f"NOT {year} OR n = 0", f"0.3 + {bonus('crop_year', 0.5)}"),
    }
    for role in ("impressions", "clicks", "conversions"):
        value = f"{_by_name('conversion_value')} OR " if role == "conversions" else ""
        found[role] = (f"{value}{like} OR negatives > 0 OR fractions > 0 OR {_named(roles.IDENTIFIER)}", f"0.3 + {bonus(role, 0.4)}")
    for role in ("spend", "conversion_value"):
        found[role] = (f"{like} OR negatives > 0 OR {_named(roles.IDENTIFIER)} OR high = 0", f"0.3 + {bonus(role, 0.4)}")
    for role in ("season", "district", "crop"):
        found[role] = (f"NOT {_by_name(role)} OR n = 0 OR {dated} OR {measure} OR d <= 1", f"0.3 + {bonus(role, 0.5)}")
    for role in ("area_cultivated", "production_quantity", "crop_yield", "rainfall", "market_price"):
        found[role] = (f"{like} OR {year} OR {_named(roles.IDENTIFIER)} OR negatives > 0 OR NOT {_by_name(role)}", f"0.3 + {bonus(role, 0.5)}")
    return found


def _detected_sql(source: str, numbers: tuple[str, ...], texts: tuple[str, ...], dates: tuple[str, ...]) -> str:
    """CTEs up to best(role, c, score, band) and candidate(c, role, score, band), from the table or subquery ``source``; no text reads as a number."""
    facts = [f"""SELECT '{c}' AS c, 'number' AS kind, count({c}) AS n, count(DISTINCT {c}) AS d, count(*) FILTER (WHERE {c} <> round_even({c}, 0)) AS fractions, count(*) FILTER (WHERE {c} < 0) AS negatives,
      CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high, CASE WHEN min({c}) = max({c}) THEN 0.0 ELSE skewness({c}) END AS skew, NULL AS span, true AS numeric_like FROM src""" for c in numbers]
    facts += [f"SELECT '{c}', 'text', count({c}), count(DISTINCT {c}), 0, 0, NULL, NULL, 0.0, NULL, false FROM src" for c in texts]
    facts += [f"SELECT '{c}', 'date', count({c}), count(DISTINCT {c}), 0, 0, NULL, NULL, 0.0, date_diff('day', CAST(min({c}) AS DATE), CAST(max({c}) AS DATE)), false FROM src" for c in dates]
    scored = " UNION ALL ".join(f"SELECT c, '{r}' AS role, CASE WHEN coalesce({refused}, false) THEN 0.0 ELSE {score} END AS score FROM u" for r, (refused, score) in _role_sql().items())
    columns = (*numbers, *texts, *dates)
    pairs = " UNION ALL ".join(f"SELECT '{c}' AS c, '{t}' AS t, count(DISTINCT ({t}, {c})) FILTER (WHERE {t} IS NOT NULL AND {c} IS NOT NULL) * 1.0 / count(DISTINCT {t}) AS mean FROM src" for c in columns for t in numbers if t != c)
    return f"""src AS (SELECT * FROM {source}), facts AS ({" UNION ALL ".join(facts)}), u AS (SELECT *, d * 1.0 / n AS uq, n * 1.0 / greatest(d, 1) AS grp FROM facts),
first AS (SELECT c, role, CAST(round(score, 3) AS DOUBLE) AS score FROM ({scored})),
chosen AS (SELECT c AS t FROM first WHERE role = 'transaction_id' AND score >= 0.5 ORDER BY score DESC, c LIMIT 1),
pairs AS ({pairs}), candidate AS (SELECT *, {BAND_SQL} FROM (SELECT * FROM first
  UNION ALL SELECT u.c, 'item_id', CAST(CASE WHEN n = 0 OR kind = 'date' OR d < 2 OR mean <= 1 THEN 0.0 ELSE 0.6 + CASE WHEN {_by_name('item_id').replace('(c,', '(u.c,')} THEN 0.2 ELSE 0.0 END END AS DOUBLE) FROM u JOIN pairs ON pairs.c = u.c JOIN chosen ON chosen.t = pairs.t)),
best AS (SELECT role, c, score, band FROM candidate WHERE band <> 'low' QUALIFY row_number() OVER (PARTITION BY role ORDER BY score DESC, c) = 1)"""


@R.add("WITH " + _detected_sql("lineitem", NUMBERS, OTHERS[:2], OTHERS[2:]) + ' SELECT role, c AS "column", score, band FROM best')
def assigned_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.detect(read(spark, sf_dir, "lineitem")).assigned_frame().select("role", "column", "score", "band")


NEEDS_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS analysis, '{r}' AS role, '{need}' AS need" for a, (required, optional) in roles.REQUIREMENTS.items() for need, names in (("required", required), ("optional", optional)) for r in names
)


@R.add("WITH " + _detected_sql("orders", ("o_orderkey", "o_custkey", "o_totalprice"), ("o_orderstatus", "o_orderpriority"), ("o_orderdate",)) + f""", needs AS ({NEEDS_SQL})
SELECT analysis, role, need, coalesce(c, '') AS resolved, NOT bool_or(need = 'required' AND c IS NULL) OVER (PARTITION BY analysis) AS applicable FROM needs LEFT JOIN best USING (role)""")
def analysis_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(roles.applicability(roles.detect(read(spark, sf_dir, "orders"))).select("analysis", "role", "need", "resolved", "applicable"), resolved="")


@R.add("SELECT * FROM (VALUES ('entity_id', 'l_suppkey', 'confirmed'), ('event_date', 'l_shipdate', 'high')) t(role, \"column\", band)")
def confirmed_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A confirmed role outranks every score."""
    found = roles.detect(read(spark, sf_dir, "lineitem"), {"entity_id": "l_suppkey", "item_id": "no_such_column"})
    return found.assigned_frame().where(F.col("role").isin("entity_id", "event_date")).select("role", "column", "band")


@R.add("WITH " + _detected_sql("(SELECT p_partkey, p_retailprice AS unit_price, CAST(p_size AS DOUBLE) + 0.5 AS weight_number FROM part)", ("p_partkey", "unit_price", "weight_number"), (), ()) + f"""
SELECT c AS "column", role, score FROM candidate WHERE role = 'quantity' AND band = 'low' AND (SELECT c FROM best WHERE role = 'monetary') = 'unit_price' AND NOT EXISTS (FROM best WHERE role = 'quantity')
ORDER BY NOT {_by_name("quantity")}, score DESC, c LIMIT 3""")
def quantity_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit price without a quantity: which columns come closest."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("unit_price"), F.col("p_size").cast("double").alias("weight_number"))
    return roles.quantity_gap(roles.detect(parts.withColumn("weight_number", F.col("weight_number") + 0.5))).select("column", "role", "score")


QUERIES, ORACLES = R.queries, R.oracles
