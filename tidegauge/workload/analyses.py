"""The seven business analyses and their chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import analytics, business
from tidegauge.workload.tables import Registry, filled, line_items_with_brand, read, rounded

R = Registry()


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business.entity_features(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", F.col("o_totalprice"))


FEATURES_SQL = """WITH f AS (SELECT o_custkey AS entity, CAST(count(*) AS DOUBLE) AS frequency, CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS DOUBLE) AS lifespan_days,
  CAST(date_diff('day', max(o_orderdate), (SELECT max(o_orderdate) FROM orders)) AS DOUBLE) AS recency_days, sum(o_totalprice) AS monetary FROM orders GROUP BY 1)"""


@R.add(FEATURES_SQL + " SELECT entity, frequency, recency_days, lifespan_days, round(monetary, 2) AS monetary FROM f")
def entity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).select("entity", "frequency", "recency_days", "lifespan_days", F.round("monetary", 2).alias("monetary"))


def _score_sql(alias: str, ordering: str) -> str:
    return f"greatest(0, CAST(ceil((row_number() OVER (ORDER BY {ordering}) - 1) * 5.0 / ((SELECT count(*) FROM f) - 1)) AS INTEGER) - 1) + 1 AS {alias}"


SCORES_SQL = FEATURES_SQL + f""", s AS (SELECT *, {_score_sql('r_score', 'recency_days DESC, entity')}, {_score_sql('f_score', 'frequency, entity')}, {_score_sql('m_score', 'monetary, entity')} FROM f),
seg AS (SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'champions' WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'loyal'
  WHEN r_score >= 4 AND f_score <= 2 AND m_score <= 3 THEN 'promising' WHEN r_score <= 2 AND f_score >= 3 AND m_score >= 3 THEN 'at_risk'
  WHEN r_score <= 2 AND f_score BETWEEN 2 AND 3 AND m_score <= 3 THEN 'hibernating' WHEN r_score = 1 AND f_score <= 2 AND m_score <= 2 THEN 'lost' ELSE 'unsegmented' END AS segment FROM s)"""


@R.add(SCORES_SQL + " SELECT entity, r_score, f_score, m_score, segment FROM seg")
def rfm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business.rfm_scores(features(spark, sf_dir)).select("entity", "r_score", "f_score", "m_score", "segment")


@R.add(SCORES_SQL + """ SELECT segment, count(*) AS entity_count, round_even(count(*) * 1.0 / (SELECT count(*) FROM seg), 6) AS entity_share, round_even(sum(monetary), 2) AS value_total,
  round_even(sum(monetary) / (SELECT sum(monetary) FROM seg), 6) AS value_share, round_even(avg(recency_days), 3) AS mean_recency_days, round_even(avg(frequency), 3) AS mean_frequency,
  round_even(avg(monetary), 2) AS mean_monetary, round_even(avg(r_score), 3) AS mean_r_score, round_even(avg(f_score), 3) AS mean_f_score, round_even(avg(m_score), 3) AS mean_m_score FROM seg GROUP BY 1""")
def rfm_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recency, frequency and monetary scores of every customer, and what each segment is worth."""
    found = business.rfm_segments(business.rfm_scores(features(spark, sf_dir)))
    return found.withColumns({"value_total": rounded("value_total", 2), "mean_monetary": rounded("mean_monetary", 2)})


@R.add(SCORES_SQL + """ SELECT segment, count(*) AS entity_count, round_even(sum(monetary) * 0.4 / sum(frequency), 4) AS average_order_value, round_even(sum(frequency) / count(*), 4) AS purchase_frequency,
  round_even(avg(lifespan_days), 3) AS observed_lifespan_days, round_even(sum(monetary) * 0.4 / sum(frequency) * (sum(frequency) / count(*)), 3) AS historical_value_per_entity, 'margin' AS value_basis FROM seg GROUP BY 1""")
def historical_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = business.historical_value(business.rfm_scores(features(spark, sf_dir)), margin_rate=0.4)
    return found.withColumns({
        "average_order_value": rounded("average_order_value", 4), "purchase_frequency": rounded("purchase_frequency", 4),
        "historical_value_per_entity": rounded("historical_value_per_entity", 3),
    })


# -- concentration: returned lines count against their part ---------------------------------------------

def part_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return business.entity_totals(read(spark, sf_dir, "lineitem"), "l_partkey", value)


PARETO_SQL = """WITH t AS (SELECT l_partkey AS entity, sum(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END) AS total FROM lineitem GROUP BY 1),
p AS (SELECT * FROM t WHERE total > 0),
k AS (SELECT *, row_number() OVER w - 1 AS idx, sum(total) OVER (ORDER BY total DESC, entity ROWS UNBOUNDED PRECEDING) / (SELECT sum(total) FROM p) AS cum_share FROM p WINDOW w AS (ORDER BY total DESC, entity)),
b AS (SELECT *, CASE WHEN idx = 0 OR cum_share <= 0.8 THEN 'A' WHEN cum_share <= 0.95 THEN 'B' ELSE 'C' END AS band FROM k)"""


@R.add(PARETO_SQL + """ SELECT band, count(*) AS entity_count, round_even(count(*) * 1.0 / (SELECT count(*) FROM p), 6) AS entity_share, round_even(sum(total), 2) AS value_total,
  round_even(sum(total) / (SELECT sum(total) FROM p), 6) AS value_share, (SELECT string_agg(CAST(entity AS VARCHAR), ',' ORDER BY idx) FROM (SELECT entity, idx FROM b b2 WHERE b2.band = b.band ORDER BY idx LIMIT 10)) AS top_entities FROM b GROUP BY band""")
def abc_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = business.abc_pareto(part_totals(spark, sf_dir)).bands
    return bands.select("band", "entity_count", "entity_share", rounded("value_total", 2).alias("value_total"), "value_share", F.array_join("top_entities", ",").alias("top_entities"))


@R.add(PARETO_SQL + """, n AS (SELECT count(*) AS n, greatest(1, count(*) // 500) AS stride FROM p)
SELECT idx + 1 AS entity_rank, round_even((idx + 1) * 1.0 / n, 6) AS cumulative_entity_share, round_even(cum_share, 6) AS cumulative_value_share FROM k, n WHERE idx % stride = 0 OR idx = n - 1""")
def concentration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business.abc_pareto(part_totals(spark, sf_dir)).curve


@R.add(PARETO_SQL + """, n AS (SELECT count(*) AS n, greatest(1, CAST(round_even(count(*) * 0.2, 0) AS BIGINT)) AS taken FROM p)
SELECT n AS entity_count, taken AS top_entity_count, round_even(cum_share, 6) AS top_value_share, cum_share < 0.5 AS concentration_is_weak FROM k, n WHERE idx = taken - 1""")
def concentration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business.abc_pareto(part_totals(spark, sf_dir)).summary.drop("total_value")


@R.add(PARETO_SQL + """ SELECT count(*) FILTER (WHERE total <= 0) AS entity_count, count(*) FILTER (WHERE total = 0) AS zero_net_count, count(*) FILTER (WHERE total < 0) AS negative_net_count,
  round_even(sum(total) FILTER (WHERE total <= 0), 2) AS net_value_total, round_even(sum(total), 2) AS combined_value_total,
  (SELECT string_agg(CAST(entity AS VARCHAR), ',' ORDER BY total, entity) FROM (SELECT * FROM t WHERE total <= 0 ORDER BY total, entity LIMIT 10)) AS examples FROM t""")
def non_contributing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = business.abc_pareto(part_totals(spark, sf_dir)).non_contributing
    return found.withColumns({"net_value_total": rounded("net_value_total", 2), "combined_value_total": rounded("combined_value_total", 2), "examples": F.array_join("examples", ",")})


# -- cohorts -----------------------------------------------------------------------------------------

def _cohort_sql(number: str) -> str:
    return f"""WITH s AS (SELECT DISTINCT o_custkey AS e, CAST({number} AS BIGINT) AS period FROM orders), c AS (SELECT e, period, min(period) OVER (PARTITION BY e) AS cohort FROM s),
n AS (SELECT cohort, period - cohort AS off, count(*) AS active FROM c GROUP BY 1, 2), z AS (SELECT cohort, active AS size FROM n WHERE off = 0),
o AS (SELECT DISTINCT off FROM n JOIN z USING (cohort)),
m AS (SELECT z.cohort, size AS cohort_size, o.off AS "offset", CASE WHEN z.cohort + o.off <= (SELECT max(period) FROM s) THEN round_even(coalesce(n.active, 0) * 1.0 / size, 6) END AS retained_share
  FROM z CROSS JOIN o LEFT JOIN n ON n.cohort = z.cohort AND n.off = o.off)"""


MONTHS = "year(o_orderdate) * 12 + month(o_orderdate) - 1"
WEEKS = "floor((epoch(o_orderdate) / 86400 + 3) / 7)"


@R.add(_cohort_sql(MONTHS) + ' SELECT cohort, cohort_size, "offset", coalesce(retained_share, -1) AS retained_share FROM m')
def cohort_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = business.cohort_retention(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").matrix
    return filled(matrix.select(F.col("cohort").cast("bigint").alias("cohort"), "cohort_size", F.col("offset").cast("bigint").alias("offset"), "retained_share"), retained_share=-1.0)


@R.add(_cohort_sql(WEEKS) + ' SELECT cohort, cohort_size, "offset", coalesce(retained_share, -1) AS retained_share FROM m')
def cohort_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = business.cohort_retention(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "week").matrix
    return filled(matrix.select(F.col("cohort").cast("bigint").alias("cohort"), "cohort_size", F.col("offset").cast("bigint").alias("offset"), "retained_share"), retained_share=-1.0)


@R.add(_cohort_sql(MONTHS) + ' SELECT (SELECT count(*) FROM z) AS cohort_count, least(12, (SELECT count(*) FROM z)) AS shown_cohorts, (SELECT count(DISTINCT off) FROM n) AS offset_count, (SELECT count(DISTINCT off) FROM n WHERE off < 6 AND cohort IN (SELECT cohort FROM z ORDER BY cohort DESC LIMIT 12)) AS shown_offsets')
def cohort_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report limited to the last twelve cohorts and six offsets leaves out."""
    return business.cohort_retention(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", max_cohorts=12, max_offsets=6).scope


@R.add(_cohort_sql(MONTHS) + ' SELECT "offset", round_even(avg(CAST(retained_share AS DECIMAL(18, 6))), 6) AS mean_retained_share FROM m WHERE retained_share IS NOT NULL GROUP BY 1')
def cohort_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = business.cohort_retention(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").mean_curve
    return curve.where("mean_retained_share is not null").select(F.col("offset").cast("bigint").alias("offset"), "mean_retained_share")


GAPS_SQL = """WITH g AS (SELECT date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), o_orderdate) AS gap FROM orders)"""


@R.add(GAPS_SQL + " SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1")
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business.gap_counts(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate")


@R.add(GAPS_SQL + ", " + FEATURES_SQL.removeprefix("WITH ") + """ SELECT count(*) AS entity_count, count(*) FILTER (WHERE frequency >= 2) AS repeat_entity_count, round_even(count(*) FILTER (WHERE frequency >= 2) * 1.0 / count(*), 6) AS repeat_rate,
  count(*) FILTER (WHERE recency_days > 90) AS inactive_entity_count, round_even(count(*) FILTER (WHERE recency_days > 90) * 1.0 / count(*), 6) AS inactive_share,
  (SELECT round_even(quantile_cont(gap, 0.25), 3) FROM g) AS gap_days_p25, (SELECT round_even(quantile_cont(gap, 0.5), 3) FROM g) AS gap_days_median, (SELECT round_even(quantile_cont(gap, 0.75), 3) FROM g) AS gap_days_p75 FROM f""")
def repeat_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business.repeat_behaviour(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").drop("inactivity_window_days", "observation_end")


@R.add("""WITH g AS (SELECT CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 86400000000.0) AS BIGINT) AS gap FROM events)
SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1""")
def user_event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole days between a user's events, to the microsecond."""
    return business.gap_counts(read(spark, sf_dir, "events"), "user_id", "ts")


# -- segments and baskets ------------------------------------------------------------------------------

@R.add()
def behavioural_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business.behavioural_segments(features(spark, sf_dir)).profile


@R.add("""WITH f AS (SELECT c_custkey % 3 AS g, 100.0 * (c_custkey % 3) + abs(c_acctbal) / 1000 AS recency, 5.0 * (c_custkey % 3 = 1)::INT + c_nationkey / 100.0 AS frequency, 1000.0 * (c_custkey % 3) + c_acctbal / 100 AS monetary FROM customer),
t AS (SELECT g, count(*) AS n, sum(monetary) AS v, avg(recency) AS r, avg(frequency) AS q FROM f GROUP BY 1)
SELECT 'cluster ' || (row_number() OVER (ORDER BY r) - 1) AS segment, n AS entity_count, round_even(v, 2) AS value_total, round_even(r, 3) AS mean_recency_days, round_even(q, 3) AS mean_frequency FROM t""")
def planted_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups of customers, far apart: the segments are these groups, and three is the number chosen."""
    g = F.col("c_custkey") % 3
    people = read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("entity"), (100.0 * g + F.abs("c_acctbal") / 1000).alias("recency_days"), (5.0 * (g == 1).cast("int") + F.col("c_nationkey") / 100.0).alias("frequency"),
        (1000.0 * g + F.col("c_acctbal") / 100).alias("monetary"),
    )
    found = business.behavioural_segments(people).profile
    return found.select("segment", "entity_count", rounded("value_total", 2).alias("value_total"), *[rounded(c, 3).alias(c) for c in ("mean_recency_days", "mean_frequency")])


BASKET_SQL = """WITH p AS (SELECT DISTINCT l_orderkey AS t, p_brand AS i FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT count(DISTINCT t) AS n FROM p), one AS (SELECT i, count(*) AS n FROM p GROUP BY 1),
two AS (SELECT a.i AS a, b.i AS b, count(*) AS n FROM p a JOIN p b ON a.t = b.t AND a.i < b.i GROUP BY 1, 2)"""
LOW_SUPPORT, LOW_CONFIDENCE = 0.004, 0.15


@R.add(BASKET_SQL + " SELECT a, b, n FROM two UNION ALL SELECT i, i, n FROM one")
def basket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders hold each pair of brands."""
    patterns, items = business.basket_patterns(line_items_with_brand(spark, sf_dir), "l_orderkey", "p_brand")
    names = F.array(*[F.lit(i) for i in items])
    found = business.pair_support(patterns, len(items))
    return found.select(F.element_at(names, F.col("a") + 1).alias("a"), F.element_at(names, F.col("b") + 1).alias("b"), "n")


@R.add(BASKET_SQL + f""", three AS (SELECT a.i AS a, b.i AS b, c.i AS c, count(*) AS n FROM p a JOIN p b ON a.t = b.t AND a.i < b.i JOIN p c ON a.t = c.t AND b.i < c.i GROUP BY 1, 2, 3),
s AS (SELECT [i] AS items, n FROM one UNION ALL SELECT [a, b], n FROM two UNION ALL SELECT [a, b, c], n FROM three), k AS (SELECT items, s.n FROM s, n WHERE s.n >= {LOW_SUPPORT} * n.n),
sides AS (SELECT items, n, [a] AS l, [b] AS r FROM (SELECT items, n, items[1] AS a, items[2] AS b FROM k WHERE len(items) = 2)
  UNION ALL SELECT items, n, [items[2]], [items[1]] FROM k WHERE len(items) = 2
  UNION ALL SELECT items, n, [items[1]], [items[2], items[3]] FROM k WHERE len(items) = 3 UNION ALL SELECT items, n, [items[2]], [items[1], items[3]] FROM k WHERE len(items) = 3
  UNION ALL SELECT items, n, [items[3]], [items[1], items[2]] FROM k WHERE len(items) = 3 UNION ALL SELECT items, n, [items[2], items[3]], [items[1]] FROM k WHERE len(items) = 3
  UNION ALL SELECT items, n, [items[1], items[3]], [items[2]] FROM k WHERE len(items) = 3 UNION ALL SELECT items, n, [items[1], items[2]], [items[3]] FROM k WHERE len(items) = 3),
j AS (SELECT sides.*, kl.n AS nl, kr.n AS nr, (SELECT n FROM n) AS total FROM sides JOIN k kl ON kl.items = l JOIN k kr ON kr.items = r)
SELECT array_to_string(l, ',') AS antecedent, array_to_string(r, ',') AS consequent, round_even(n * 1.0 / total, 6) AS support, round_even(n * 1.0 / nl, 6) AS confidence, round_even(n * 1.0 * total / (nl * nr), 6) AS lift
FROM j WHERE n * 1.0 / nl >= {LOW_CONFIDENCE} AND n * total > nl * nr""")
def association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules between brands bought together more often than chance, not only the first fifty."""
    found = business.market_basket(line_items_with_brand(spark, sf_dir), "l_orderkey", "p_brand", LOW_SUPPORT, LOW_CONFIDENCE, cap=None).rules
    if found is None:  # a table may hold no rule at all
        found = spark.createDataFrame([], business.RULE)
    return found.withColumns({"antecedent": F.array_join("antecedent", ","), "consequent": F.array_join("consequent", ",")})


@R.add()
def business_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every analysis the line items support, from detected roles to findings."""
    items = line_items_with_brand(spark, sf_dir).select("l_orderkey", "p_brand", "l_shipdate", F.col("l_extendedprice").alias("line_total"), F.col("l_suppkey").alias("customer_id"))
    findings, _ = analytics.run_all(items, {"entity_id": "customer_id", "item_id": "p_brand", "transaction_id": "l_orderkey"})
    return findings.select("finding_id", "analysis", "finding_type", "scope")


# -- chart data ----------------------------------------------------------------------------------------

@R.add(SCORES_SQL + " SELECT segment, round_even(round_even(sum(monetary) / (SELECT sum(monetary) FROM seg), 6) * 100, 4) AS percent FROM seg GROUP BY 1")
def segment_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = business.segment_bars(business.rfm_segments(business.rfm_scores(features(spark, sf_dir))))
    return bars.select("segment", rounded("percent", 4).alias("percent"))


@R.add(_cohort_sql(MONTHS) + """, v AS (SELECT min(retained_share * 100) AS lo, max(retained_share * 100) AS hi FROM m WHERE "offset" <> 0 AND retained_share IS NOT NULL)
SELECT round_even(greatest(0, lo - greatest((hi - lo) * 0.05, 0.5)), 2) AS low, round_even(least(100, hi + greatest((hi - lo) * 0.05, 0.5)), 2) AS high FROM v""")
def heatmap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return business.cohort_heatmap(business.cohort_retention(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate"))[1]


@R.add(PARETO_SQL + """, n AS (SELECT count(*) AS n, greatest(1, count(*) // 500) AS stride FROM p)
SELECT round_even(round_even((idx + 1) * 1.0 / n, 6) * 100, 4) AS x, round_even(round_even(cum_share, 6) * 100, 4) AS y FROM k, n WHERE idx % stride = 0 OR idx = n - 1""")
def pareto_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = business.pareto_curve_points(business.abc_pareto(part_totals(spark, sf_dir)))
    return points.select(rounded("x", 4).alias("x"), rounded("y", 4).alias("y"))


QUERIES, ORACLES = R.queries, R.oracles
