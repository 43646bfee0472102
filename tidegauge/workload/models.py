"""Modelling: task, features, folds, baselines, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import modelling
from tidegauge.workload.tables import Registry, filled, read, rounded

R = Registry()


@R.add("""SELECT * FROM (VALUES ('o_totalprice', 'forecast'), ('o_orderpriority', 'forecast')) t(target, task)
UNION ALL SELECT 'c_mktsegment', CASE WHEN count(DISTINCT c_mktsegment) BETWEEN 2 AND 49 THEN 'classification' ELSE 'unsupported' END FROM customer
UNION ALL SELECT 'c_name', CASE WHEN count(DISTINCT c_name) BETWEEN 2 AND 49 THEN 'classification' ELSE 'unsupported' END FROM customer UNION ALL SELECT 'c_acctbal', 'regression'""")
def model_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    chosen = [(c, modelling.select_task(t, c)[0]) for t, c in ((orders, "o_totalprice"), (orders, "o_orderpriority"), (customers, "c_mktsegment"), (customers, "c_name"), (customers, "c_acctbal"))]
    return spark.createDataFrame(chosen, "target string, task string")


def _series_sql(period: str, step: str) -> str:
    return f"""WITH s AS (SELECT {period} AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1),
    g AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(p) FROM s) AS TIMESTAMP), CAST((SELECT max(p) FROM s) AS TIMESTAMP), INTERVAL {step})) AS DATE) AS p),
    y AS (SELECT row_number() OVER (ORDER BY g.p) - 1 AS t, g.p, coalesce(s.v, 0) AS v FROM g LEFT JOIN s ON s.p = g.p)"""


MONTHLY = _series_sql("CAST(date_trunc('month', o_orderdate) AS DATE)", "1 MONTH")
WEEKLY = _series_sql("CAST(date_trunc('week', o_orderdate) AS DATE) + 6", "7 DAY")


@R.add(MONTHLY + " SELECT CAST(t AS INTEGER) AS t, strftime(p, '%Y-%m-%d') AS period, round_even(v, 2) AS value FROM y")
def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    frequency = modelling.series_frequency(orders, "o_orderdate")
    found = modelling.time_series(orders, "o_orderdate", "o_totalprice", frequency)
    return found.select("t", F.date_format("period", "yyyy-MM-dd").alias("period"), rounded("value", 2).alias("value"))


@R.add(WEEKLY + " SELECT CAST(t AS INTEGER) AS t, strftime(p, '%Y-%m-%d') AS period, round_even(v, 2) AS value FROM y")
def weekly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = modelling.time_series(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "W")
    return found.select("t", F.date_format("period", "yyyy-MM-dd").alias("period"), rounded("value", 2).alias("value"))


CHAINED = MONTHLY + """, n AS (SELECT count(*) AS n, count(*) // 6 AS s FROM y), f AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold), w AS (SELECT fold, n - (5 - fold) * s AS a, n - (4 - fold) * s AS b FROM f, n)"""


@R.add(CHAINED + " SELECT fold, count(*) FILTER (WHERE t < a) AS train, count(*) FILTER (WHERE t >= a) AS test FROM y JOIN w ON t < b GROUP BY 1")
def forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = modelling.time_series(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "MS")
    found = modelling.chained(series, series.count(), 5)
    return found.groupBy("fold").agg(F.count_if("train").alias("train"), F.count_if(~F.col("train")).alias("test"))


def _predicted_sql(name: str, folds: str) -> str:
    """Both candidates and the naive forecasts of every period from a to b of each fold (fold, a, b), from all periods before a."""
    return f"""{name}_past AS (SELECT w.fold, y.t, v, v - lag(v) OVER s AS d FROM y JOIN {folds} w ON y.t < a WINDOW s AS (PARTITION BY w.fold ORDER BY y.t)),
{name}_steps AS (SELECT *, lag(d) OVER (PARTITION BY fold ORDER BY t) AS d1 FROM {name}_past),
{name}_fit AS (SELECT fold, regr_slope(v, t) AS slope, regr_intercept(v, t) AS icept, count(*) AS k, arg_max(v, t) AS last, max(t) AS lt, coalesce(arg_max(d, t) FILTER (WHERE d IS NOT NULL), 0) AS last_d,
  greatest(-0.99, least(0.99, coalesce(regr_slope(d, d1), 0))) AS phi, coalesce(regr_intercept(d, d1), avg(d), 0) AS drift FROM {name}_steps GROUP BY 1),
{name}_eff AS (SELECT p.fold, t % 12 AS place, avg(v - icept - slope * t) AS e FROM {name}_past p JOIN {name}_fit USING (fold) WHERE k >= 24 GROUP BY 1, 2),
{name}_tail AS (SELECT p.fold, (t - lt + 11) % 12 AS slot, v AS sn FROM {name}_past p JOIN {name}_fit USING (fold) WHERE t > lt - 12 AND k >= 12),
{name} AS (SELECT w.fold, g.t, y.v, icept + slope * g.t + coalesce(e, 0) AS ts, last AS nv, sn, drift / (1 - phi) AS step,
  last + drift / (1 - phi) * (g.t - lt) + (last_d - drift / (1 - phi)) * phi * (1 - phi ** (g.t - lt)) / (1 - phi) AS ar
  FROM {folds} w, LATERAL (SELECT unnest(range(w.a, w.b)) AS t) g JOIN {name}_fit f ON f.fold = w.fold LEFT JOIN y ON y.t = g.t LEFT JOIN {name}_eff ef ON ef.fold = w.fold AND ef.place = g.t % 12
  LEFT JOIN {name}_tail tl ON tl.fold = w.fold AND tl.slot = (g.t - lt - 1) % 12)"""


FORECAST = CHAINED + ", " + _predicted_sql("p", "w") + """,
r AS (SELECT fold, sqrt(avg((ts - v) ** 2)) AS ts, sqrt(avg((ar - v) ** 2)) AS ar, sqrt(avg((nv - v) ** 2)) AS nv, sqrt(avg((sn - v) ** 2)) AS sn FROM p GROUP BY 1),
score AS (SELECT 'trend_seasonal' AS model, 'candidate' AS role, avg(ts) AS score FROM r UNION ALL SELECT 'differenced_ar1', 'candidate', avg(ar) FROM r
UNION ALL SELECT 'naive', 'baseline', avg(nv) FROM r UNION ALL SELECT 'seasonal_naive', 'baseline', avg(sn) FROM r)"""


@R.add(FORECAST + " SELECT model, role, round_even(score, 1) AS score FROM score WHERE score IS NOT NULL")
def forecast_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample error of both candidates and the naive forecasts over forward-chained folds."""
    series = modelling.time_series(read(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "MS")
    return modelling.forecast_scores(series, series.count(), "MS").select("model", "role", rounded("score", 1).alias("score"))


@R.add(FORECAST + """, best AS (SELECT arg_min(model, score) AS model FROM score WHERE role = 'candidate'),
late AS (SELECT t AS fold, t AS a, t + 1 AS b FROM y, n WHERE t >= greatest(3, n.n // 2)), """ + _predicted_sql("o", "late") + """,
whole AS (SELECT 0 AS fold, n AS a, n + least(12, greatest(1, n // 2)) AS b FROM n), """ + _predicted_sql("q", "whole") + """,
width AS (SELECT 1.2816 * stddev_pop(v - CASE WHEN best.model = 'trend_seasonal' THEN ts ELSE ar END) AS width FROM o, best),
ahead AS (SELECT t, CASE WHEN best.model = 'trend_seasonal' THEN ts ELSE ar END AS value, t - (SELECT max(t) FROM y) AS ahead, width FROM q, best, width)
SELECT CAST(t AS INTEGER) AS t, strftime((SELECT max(p) FROM y) + to_months(CAST(ahead AS INTEGER)), '%Y-%m-%d') AS period,
  round_even(value / 1000, 2) AS thousands, round_even((value - width * sqrt(ahead)) / 1000, 2) AS lower, round_even((value + width * sqrt(ahead)) / 1000, 2) AS upper FROM ahead""")
def forecast_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next months of revenue with their band, in thousands."""
    found = modelling.forecast(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderdate").forecast
    thousands = lambda c: rounded(F.col(c) / 1000, 2)
    return found.select("t", F.date_format("period", "yyyy-MM-dd").alias("period"), thousands("value").alias("thousands"), thousands("lower").alias("lower"), thousands("upper").alias("upper"))


def leaky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a copy of the target, a constant and a mostly missing column."""
    items = read(spark, sf_dir, "lineitem")
    return items.withColumns({
        "target_copy": F.col("l_extendedprice") * 1.1 + 3, "constant": F.lit(1), "mostly_null": F.when(F.col("l_tax") == 0.08, F.col("l_quantity")),
        "row_label": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    })


@R.add("""WITH f AS (SELECT *, l_extendedprice * 1.1 + 3 AS target_copy, CASE WHEN l_tax = 0.08 THEN l_quantity END AS mostly_null, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS row_label FROM lineitem)
SELECT 'target_copy' AS "column", 'near-perfectly correlated with the target' AS reason FROM f HAVING abs(corr(target_copy, l_extendedprice)) > 0.98
UNION ALL SELECT 'constant', 'constant column' UNION ALL SELECT 'mostly_null', 'mostly null' FROM f HAVING 1 - count(mostly_null) * 1.0 / count(*) > 0.5
UNION ALL SELECT 'row_label', 'high cardinality, looks like an identifier' FROM f HAVING count(DISTINCT row_label) * 1.0 / count(*) >= 0.95
UNION ALL SELECT 'l_quantity', 'near-perfectly correlated with the target' FROM f HAVING abs(corr(l_quantity, l_extendedprice)) > 0.98""")
def excluded_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, constants, mostly missing columns and copies of the target are left out, with the reason."""
    return modelling.select_features(leaky(spark, sf_dir), "l_extendedprice").where("not kept").select("column", "reason")


@R.add("""WITH i AS (SELECT p_type, (row_number() OVER (PARTITION BY p_type) - 1) % 5 AS fold FROM part) SELECT p_type, CAST(fold AS INTEGER) AS fold, count(*) AS n FROM i GROUP BY ALL""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every label dealt evenly over the folds."""
    return modelling.with_folds(read(spark, sf_dir, "part"), 5, 0, "p_type").groupBy("p_type", "fold").agg(F.count("*").alias("n"))


@R.add("WITH n AS (SELECT count(*) AS n FROM events) SELECT CAST(f AS INTEGER) AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS n FROM n, (SELECT unnest(range(5)) AS f)")
def even_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.with_folds(read(spark, sf_dir, "events").select("event_id", "value"), 5).groupBy("fold").agg(F.count("*").alias("n"))


@R.add("SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n, round_even(count(*) * 1.0 / (SELECT count(*) FROM labels WHERE quality IS NOT NULL), 6) AS share FROM labels WHERE quality IS NOT NULL GROUP BY 1")
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.class_distribution(read(spark, sf_dir, "labels"), "quality").select("label", "n", rounded("share").alias("share"))


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be measured of a document, beside its quality label."""
    text = F.col("text")
    words = F.size(F.split(text, r"\s+"))
    documents = read(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "n_chars", words.alias("words"), (F.col("n_chars") / words).alias("word_length"),
        F.regexp_count(text, F.lit(r"[.!?]")).alias("stops"), F.regexp_count(text, F.lit(r"[^\p{L}\s]")).alias("symbols"), F.size(F.array_distinct(F.split(text, "\n"))).alias("lines"),
    )
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return documents.join(labels, "doc_id").drop("doc_id")


@R.add()
def quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression and random forest for document quality, against the majority class."""
    outcome = modelling.predict(document_features(spark, sf_dir), "quality")
    scores = outcome.scores if outcome.scores is not None else spark.createDataFrame([], modelling.SCORES)
    return scores.withColumn("status", F.lit(outcome.status)).withColumn("reason", F.lit(outcome.reason))


@R.add()
def price_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retail price of parts from their other columns, with the associations of the winner."""
    outcome = modelling.predict(read(spark, sf_dir, "part"), "p_retailprice")
    return filled(outcome.scores.withColumn("status", F.lit(outcome.status)).withColumn("winner", F.lit(outcome.winner)), winner="")


@R.add("""WITH f AS (SELECT CAST(c_custkey % 17 AS DOUBLE) AS a, c_acctbal AS b, 40.0 * (c_custkey % 17) + c_acctbal / 20 AS y FROM customer),
m AS (SELECT covar_pop(a, y) AS ay, covar_pop(b, y) AS byy, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, stddev_pop(y) AS spread FROM f)
SELECT 'turn' AS "column", round_even(abs((ay * bb - byy * ab) / (aa * bb - ab * ab)), 4) AS association, spread > 0 AS beats_baseline, 'linear_regression' AS winner, 'answered' AS status FROM m
UNION ALL SELECT 'c_acctbal', round_even(abs((byy * aa - ay * ab) / (aa * bb - ab * ab)), 4), spread > 0, 'linear_regression', 'answered' FROM m""")
def planted_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target that is linear in two columns: the linear model wins, beats the mean, and its associations are the coefficients that least squares gives."""
    turn = (F.col("c_custkey") % 17).cast("double")
    people = read(spark, sf_dir, "customer").select(turn.alias("turn"), "c_acctbal", (40.0 * turn + F.col("c_acctbal") / 20).alias("y"))
    outcome = modelling.predict(people, "y", config=modelling.Config(trees=20, depth=10))
    beats = F.lit(outcome.notes["score"] < outcome.notes["best_baseline"])
    return outcome.associations.select("column", rounded("association", 4).alias("association"), beats.alias("beats_baseline"), F.lit(outcome.winner).alias("winner"), F.lit(outcome.status).alias("status"))


@R.add("""WITH f AS (SELECT CASE WHEN c_custkey % 17 >= 8 THEN 'late' ELSE 'early' END AS label FROM customer), n AS (SELECT label, count(*) AS n FROM f GROUP BY 1)
SELECT label, n, round_even(n * 1.0 / (SELECT sum(n) FROM n), 6) AS share, (SELECT max(n) * 1.0 / sum(n) FROM n) <= 0.9 AS modelled, 'answered' AS status, true AS learned FROM n""")
def planted_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label that a cut in one column tells: the classes, that they are balanced enough to model, and that held-out rows are told apart."""
    turn = (F.col("c_custkey") % 17).cast("double")
    people = read(spark, sf_dir, "customer").select(turn.alias("turn"), "c_acctbal", "c_mktsegment", F.when(turn >= 8, "late").otherwise("early").alias("label"))
    outcome = modelling.predict(people, "label", config=modelling.Config(trees=20, depth=10))
    known = outcome.classes.select("label", "n", rounded("share").alias("share"))
    learned = outcome.notes["score"] > 0.95 > outcome.notes["best_baseline"]
    return known.withColumns({"modelled": F.col("share").isNotNull(), "status": F.lit(outcome.status), "learned": F.lit(learned)})


QUERIES, ORACLES = R.queries, R.oracles
