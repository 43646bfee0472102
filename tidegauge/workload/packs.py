"""The two rule packs over views of the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import agriculture, marketing, roles
from tidegauge.workload.tables import Registry, filled, line_items_with_brand, read, rounded

R = Registry()

# -- marketing: a brand is a campaign, its line items are what was spent --------------------------------

AD_ROLES = {
    "campaign_id": "campaign", "event_date": "date", "spend": "spend", "impressions": "impressions", "clicks": "clicks",
    "conversions": "conversions", "conversion_value": "conversion_value", "frequency": "frequency",
}
CONFIG = marketing.Config(daily_budget=1_000_000.0, frequency_fatigue=2.95, ctr_decline=0.001, cpa_spike_multiple=0.5, underperformance=1.02, roas_target=2.0)


def advertising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_items_with_brand(spark, sf_dir).select(
        F.col("p_brand").alias("campaign"), F.col("l_shipdate").alias("date"), F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("spend"),
        (F.col("l_quantity") * 1000).alias("impressions"), F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("clicks"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("conversions"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("conversion_value"),
        (F.col("l_tax") * 50 + 1).alias("frequency"),
    )


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marketing.prepare(advertising(spark, sf_dir), AD_ROLES, CONFIG).frame


AD_SQL = """WITH a AS (SELECT p_brand AS campaign, CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) AS spend, sum(l_quantity * 1000) AS impressions, sum(floor(l_extendedprice / 1000)) AS clicks,
  CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS conversions, sum(l_extendedprice * (1 - l_discount)) AS value, avg(l_tax * 50 + 1) AS frequency FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
f AS (SELECT *, spend / nullif(conversions, 0) AS cpa, value / nullif(spend, 0) AS roas, clicks / nullif(impressions, 0) AS ctr FROM a),
d AS (SELECT max(day) AS latest FROM f),
w AS (SELECT f.*, day >= latest - 6 AS recent, day >= latest - 13 AND day < latest - 6 AS prior FROM f, d)"""


@R.add(AD_SQL + " SELECT campaign, strftime(day, '%Y-%m-%d') AS day, round_even(spend, 2) AS spend, impressions, clicks, conversions, round_even(value, 4) AS value, round_even(frequency, 5) AS frequency, coalesce(round_even(cpa, 5), -1) AS cpa, round_even(roas, 5) AS roas, round_even(ctr, 6) AS ctr FROM f")
def campaign_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per campaign and day with the derived ratios."""
    frame = prepared(spark, sf_dir).select(
        "campaign", F.date_format("day", "yyyy-MM-dd").alias("day"), rounded("spend", 2).alias("spend"), "impressions", "clicks", "conversions", rounded("value", 4).alias("value"),
        rounded("frequency", 5).alias("frequency"), rounded("cpa", 5).alias("cpa"), rounded("roas", 5).alias("roas"), rounded("ctr").alias("ctr"),
    )
    return filled(frame, cpa=-1.0)


@R.add(AD_SQL + """ SELECT 'rows_in' AS note, '' AS subject, CAST(count(*) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'rows_out', '', count(*) FROM f UNION ALL SELECT 'unparsed', 'spend', 0
UNION ALL SELECT 'undefined', 'cpa', count(*) FILTER (WHERE cpa IS NULL) FROM f UNION ALL SELECT 'undefined', 'roas', 0 UNION ALL SELECT 'undefined', 'ctr', 0""")
def campaign_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled(marketing.prepare(advertising(spark, sf_dir), AD_ROLES, CONFIG).notes, subject="")


def ad_rule(spark: SparkSession, sf_dir: str, rule, places: int = 4) -> DataFrame:
    findings, _ = rule(prepared(spark, sf_dir), CONFIG)
    shown = findings.select("rule", "severity", "metric", "scope", rounded("observed", places).alias("observed"), rounded("threshold", places).alias("threshold"))
    return filled(shown, scope="", threshold=-1.0)


@R.add(AD_SQL + """, t AS (SELECT sum(spend) AS spend, sum(impressions) AS impressions, sum(clicks) AS clicks, sum(conversions) AS conversions, sum(value) AS value FROM f),
l(metric, observed) AS (SELECT 'spend', spend FROM t UNION ALL SELECT 'impressions', impressions FROM t UNION ALL SELECT 'clicks', clicks FROM t UNION ALL SELECT 'conversions', conversions FROM t UNION ALL SELECT 'value', value FROM t
  UNION ALL SELECT 'blended_cpa', spend / conversions FROM t UNION ALL SELECT 'blended_roas', value / spend FROM t UNION ALL SELECT 'blended_ctr', clicks / impressions FROM t)
SELECT 'account_totals' AS rule, 'key_value' AS severity, metric, '' AS scope, round_even(observed, 2) AS observed, CAST(-1 AS DOUBLE) AS threshold FROM l""")
def account_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_rule(spark, sf_dir, marketing.account_totals, 2)


@R.add(AD_SQL + """, m AS (SELECT avg(cpa) FILTER (WHERE recent) AS r, avg(cpa) FILTER (WHERE prior) AS p, count(cpa) FILTER (WHERE recent) AS nr, count(cpa) FILTER (WHERE prior) AS np FROM w)
SELECT 'cpa_above_baseline' AS rule, 'warning' AS severity, 'cpa' AS metric, '' AS scope, round_even(r, 3) AS observed, round_even(p * 0.5, 3) AS threshold FROM m WHERE nr >= 3 AND np >= 3 AND r > p * 0.5""")
def cpa_above_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_rule(spark, sf_dir, marketing.cpa_above_baseline, 3)


@R.add(AD_SQL + """, m AS (SELECT avg(ctr) FILTER (WHERE recent) AS r, avg(ctr) FILTER (WHERE prior) AS p, count(ctr) FILTER (WHERE recent) AS nr, count(ctr) FILTER (WHERE prior) AS np FROM w)
SELECT 'ctr_decline' AS rule, 'warning' AS severity, 'ctr' AS metric, '' AS scope, round_even(r, 6) AS observed, round_even(p * (1 - 0.001), 6) AS threshold FROM m WHERE nr >= 3 AND np >= 3 AND (p - r) / p >= 0.001""")
def ctr_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_rule(spark, sf_dir, marketing.ctr_decline, 6)


@R.add(AD_SQL + """ SELECT 'frequency_fatigue' AS rule, 'warning' AS severity, 'frequency' AS metric, campaign AS scope, round_even(avg(frequency), 5) AS observed, 2.95 AS threshold FROM f GROUP BY campaign HAVING avg(frequency) > 2.95""")
def frequency_fatigue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_rule(spark, sf_dir, marketing.frequency_fatigue, 5)


@R.add(AD_SQL + """, s AS (SELECT day, sum(spend) AS spend FROM f GROUP BY 1), m AS (SELECT avg(spend) AS x FROM s)
SELECT 'budget_mispacing' AS rule, 'warning' AS severity, 'daily_spend' AS metric, '' AS scope, round_even(x, 2) AS observed, CASE WHEN x > 1250000 THEN 1250000.0 ELSE 750000.0 END AS threshold FROM m WHERE x NOT BETWEEN 750000 AND 1250000""")
def budget_mispacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_rule(spark, sf_dir, marketing.budget_mispacing, 2)


@R.add(AD_SQL + """ SELECT 'roas_below_target' AS rule, 'improvement' AS severity, 'roas' AS metric, '' AS scope, round_even(sum(value) / sum(spend), 6) AS observed, 2.0 AS threshold FROM f HAVING sum(value) / sum(spend) < 2""")
def roas_below_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_rule(spark, sf_dir, marketing.roas_below_target, 6)


@R.add(AD_SQL + """, c AS (SELECT campaign, avg(cpa) AS x FROM f GROUP BY 1 HAVING avg(cpa) IS NOT NULL), m AS (SELECT quantile_cont(x, 0.5) * 1.02 AS lim FROM c)
SELECT 'adset_underperforming' AS rule, 'improvement' AS severity, 'cpa' AS metric, campaign AS scope, round_even(x, 3) AS observed, round_even(lim, 3) AS threshold FROM c, m WHERE x > lim""")
def adset_underperforming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_rule(spark, sf_dir, marketing.adset_underperforming, 3)


@R.add(AD_SQL + """, m AS (SELECT campaign, metric, avg(v) FILTER (WHERE recent) AS after, avg(v) FILTER (WHERE prior) AS before FROM (
  SELECT campaign, recent, prior, 'cpa' AS metric, cpa AS v FROM w UNION ALL SELECT campaign, recent, prior, 'roas', roas FROM w UNION ALL SELECT campaign, recent, prior, 'ctr', ctr FROM w) WHERE recent OR prior GROUP BY 1, 2)
SELECT 'adset_period_movement' AS rule, 'improvement' AS severity, metric, campaign AS scope, round_even(after, 4) AS observed, round_even(before, 4) AS threshold FROM m WHERE after <> before AND (before = 0 OR abs((after - before) / abs(before)) >= 0.05)""")
def adset_period_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_rule(spark, sf_dir, marketing.adset_period_movement)


@R.add(AD_SQL + """, e AS (SELECT campaign, (arg_max(frequency, day) - arg_min(frequency, day)) / (count(*) - 1) AS rise, (arg_max(ctr, day) - arg_min(ctr, day)) / (count(*) - 1) AS fall FROM f GROUP BY 1 HAVING count(*) >= 2)
SELECT 'adset_fatigue_trend' AS rule, 'warning' AS severity, 'frequency vs ctr' AS metric, campaign AS scope, round_even(rise, 6) AS observed, CAST(0 AS DOUBLE) AS threshold FROM e WHERE rise > 0 AND fall < 0""")
def adset_fatigue_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_rule(spark, sf_dir, marketing.adset_fatigue_trend, 6)


def _band_sql(column: str, label: str) -> str:
    return f"""SELECT 'spend_concentration' AS rule, 'key_value' AS severity, '{label} share of band A' AS metric, array_to_string(list(campaign ORDER BY x DESC, campaign)[1:10], ', ') AS scope, round_even(sum(x) / any_value(total), 6) AS observed, count(*) AS campaigns FROM (
    SELECT campaign, x, sum(x) OVER () AS total, row_number() OVER w AS i, sum(x) OVER (ORDER BY x DESC, campaign ROWS UNBOUNDED PRECEDING) / sum(x) OVER () AS cum FROM (SELECT campaign, sum({column}) AS x FROM f GROUP BY 1) WINDOW w AS (ORDER BY x DESC, campaign))
    WHERE i = 1 OR cum <= 0.8"""


@R.add(AD_SQL + " " + _band_sql("spend", "spend") + " UNION ALL " + _band_sql("value", "return"))
def spend_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = marketing.spend_concentration(prepared(spark, sf_dir), CONFIG)
    return findings.select("rule", "severity", "metric", "scope", "observed", F.col("observations").alias("campaigns"))


@R.add(AD_SQL + """, c AS (SELECT campaign, avg(cpa) AS cpa, avg(roas) AS roas FROM f GROUP BY 1), m AS (SELECT quantile_cont(cpa, 0.5) AS mc, quantile_cont(roas, 0.5) AS mr FROM c)
SELECT 'adset_efficiency_rank' AS rule, 'improvement' AS severity, 'cpa' AS metric, campaign AS scope, round_even(cpa, 3) AS observed, round_even(mc, 3) AS threshold FROM c, m WHERE cpa > mc
UNION ALL SELECT 'adset_efficiency_rank', 'improvement', 'roas', campaign, round_even(roas, 3), round_even(mr, 3) FROM c, m WHERE roas < mr""")
def adset_efficiency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad_rule(spark, sf_dir, marketing.adset_efficiency_rank, 3)


def _all_rules_sql(names: tuple[str, ...], columns: str) -> str:
    """What the rules' own SQL finds, put together."""
    return " UNION ALL ".join(f"SELECT {columns}, scope FROM ({R.oracles[name]})" for name in names)


AD_RULES = ("account_totals", "cpa_above_baseline", "ctr_decline", "frequency_fatigue", "budget_mispacing", "roas_below_target", "adset_underperforming",
            "adset_period_movement", "adset_fatigue_trend", "spend_concentration", "adset_efficiency_rank")


@R.add(_all_rules_sql(AD_RULES, "rule, severity, metric"))
def marketing_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles detected from the export itself, then every rule."""
    detection = roles.detect(advertising(spark, sf_dir))
    verdict = marketing.qualification(detection)
    frame = marketing.prepare(advertising(spark, sf_dir), detection.assigned if verdict.applies else AD_ROLES, CONFIG).frame
    findings, _ = marketing.run(frame, CONFIG)
    return filled(findings.select("rule", "severity", "metric", "scope"), scope="")


@R.add(AD_SQL + " SELECT strftime(day, '%Y-%m-%d') AS day, round_even(sum(spend), 2) AS figure FROM f GROUP BY 1")
def daily_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marketing.daily(prepared(spark, sf_dir), "spend").select(F.date_format("day", "yyyy-MM-dd").alias("day"), rounded("figure", 2).alias("figure"))


@R.add(AD_SQL + " SELECT campaign, round_even(avg(cpa), 3) AS mean FROM f GROUP BY 1 ORDER BY avg(cpa), campaign LIMIT 12")
def top_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marketing.top_campaigns(prepared(spark, sf_dir), "cpa").select("campaign", rounded("mean", 3).alias("mean"))


@R.add(AD_SQL + " SELECT campaign, round_even(sum(spend), 2) AS spend, round_even(sum(value), 2) AS value FROM f GROUP BY 1 ORDER BY sum(spend) DESC, campaign LIMIT 12")
def spend_and_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marketing.spend_and_return(prepared(spark, sf_dir)).select("campaign", rounded("spend", 2).alias("spend"), rounded("value", 2).alias("value"))


# -- agriculture: a nation is a district, a brand a crop, a quarter a season ------------------------------

CROP_ROLES = {
    "district": "district", "crop": "crop", "season": "season", "crop_year": "crop_year", "area_cultivated": "area",
    "production_quantity": "production", "rainfall": "rainfall",
}
CROP_CONFIG = agriculture.Config(rainfall_sigma=1.0)


def harvests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    items = line_items_with_brand(spark, sf_dir)
    joined = (
        items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    )
    return joined.select(
        F.concat(F.col("n_name"), F.lit("  ")).alias("district"), F.lower("p_brand").alias("crop"), F.concat(F.lit("q"), F.quarter("o_orderdate")).alias("season"),
        F.year("o_orderdate").alias("crop_year"), F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("production"), (F.col("l_tax") * 10000).alias("rainfall"),
    )


def grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agriculture.prepare(harvests(spark, sf_dir), CROP_ROLES, CROP_CONFIG).frame


CROP_SQL = """WITH f AS (SELECT 'Nation_' || n_nationkey AS district, p_brand AS crop, 'Q' || quarter(o_orderdate) AS season, CAST(year(o_orderdate) AS INTEGER) AS year, sum(l_quantity) AS area, sum(l_extendedprice) AS production,
  avg(l_tax * 10000) AS rainfall, sum(l_extendedprice) / nullif(sum(l_quantity), 0) AS yield FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4),
s AS (SELECT *, row_number() OVER (PARTITION BY district, crop ORDER BY year DESC, season DESC) AS back, lag(production) OVER k AS prev_production, lag(area) OVER k AS prev_area,
  avg(yield) OVER (PARTITION BY district, crop ORDER BY year, season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history, count(yield) OVER (PARTITION BY district, crop ORDER BY year, season ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM f WINDOW k AS (PARTITION BY district, crop ORDER BY year, season))"""


@R.add(CROP_SQL + " SELECT district, crop, season, year, area, round_even(production, 2) AS production, round_even(rainfall, 5) AS rainfall, round_even(yield, 9) AS yield FROM f")
def crop_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per district, crop, season and year, labels cleaned."""
    frame = grown(spark, sf_dir)
    return frame.select("district", "crop", "season", "year", "area", rounded("production", 2).alias("production"), rounded("rainfall", 5).alias("rainfall"), rounded("yield", 9).alias("yield"))


def crop_rule(spark: SparkSession, sf_dir: str, rule, places: int = 3) -> DataFrame:
    findings, _ = rule(grown(spark, sf_dir), CROP_CONFIG)
    shown = findings.select("rule", "metric", "scope", rounded("observed", places).alias("observed"), rounded("threshold", places).alias("threshold"))
    return filled(shown, scope="", threshold=-1.0)


@R.add(CROP_SQL + """, l(metric, scope, observed) AS (SELECT 'total_area', '', sum(area) FROM f UNION ALL SELECT 'total_production', '', sum(production) FROM f UNION ALL SELECT 'average_yield', '', avg(yield) FROM f
  UNION ALL SELECT 'rainfall_mean', '', avg(rainfall) FROM f UNION ALL SELECT 'rainfall_min', '', min(rainfall) FROM f UNION ALL SELECT 'rainfall_max', '', max(rainfall) FROM f
  UNION ALL SELECT 'districts', '', count(DISTINCT district) FROM f UNION ALL SELECT 'crops', '', count(DISTINCT crop) FROM f UNION ALL SELECT 'seasons', '', count(DISTINCT season) FROM f
  UNION ALL (SELECT 'crop_production', crop, sum(production) FROM f GROUP BY crop ORDER BY 3 DESC, 2 LIMIT 5))
SELECT 'season_totals' AS rule, metric, scope, round_even(observed, 2) AS observed, CAST(-1 AS DOUBLE) AS threshold FROM l""")
def season_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_rule(spark, sf_dir, agriculture.season_totals, 2)


@R.add(CROP_SQL + """ SELECT 'yield_collapse' AS rule, 'yield' AS metric, district || ' / ' || crop AS scope, round_even(yield, 3) AS observed, round_even(history * 0.6, 3) AS threshold FROM s WHERE back = 1 AND before >= 3 AND yield < history * 0.6""")
def yield_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_rule(spark, sf_dir, agriculture.yield_collapse)


@R.add(CROP_SQL + """ SELECT 'production_drop' AS rule, 'production' AS metric, district || ' / ' || crop AS scope, round_even(production, 2) AS observed, round_even(prev_production * 0.7, 4) AS threshold FROM s
  WHERE back = 1 AND prev_production > 0 AND (prev_production - production) / prev_production > 0.3""")
def production_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_rule(spark, sf_dir, agriculture.production_drop, 4)


@R.add(CROP_SQL + """ SELECT 'area_fall' AS rule, 'area cultivated' AS metric, district || ' / ' || crop AS scope, area AS observed, round_even(prev_area * 0.75, 3) AS threshold FROM s WHERE back = 1 AND prev_area > 0 AND (prev_area - area) / prev_area > 0.25""")
def area_fall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_rule(spark, sf_dir, agriculture.area_fall)


@R.add(CROP_SQL + """, r AS (SELECT season, avg(rainfall) AS mu, stddev_pop(rainfall) AS sd, count(*) AS n, arg_max(rainfall, (year, district, crop)) AS latest FROM f GROUP BY 1)
SELECT 'rainfall_outside_range' AS rule, 'rainfall' AS metric, season AS scope, round_even(latest, 3) AS observed, round_even(mu + sd * CASE WHEN latest > mu THEN 1 ELSE -1 END, 3) AS threshold FROM r WHERE n >= 4 AND abs(latest - mu) / sd > 1""")
def rainfall_outside_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_rule(spark, sf_dir, agriculture.rainfall_outside_range)


@R.add(CROP_SQL + """, m AS (SELECT crop, district, avg(yield) AS x FROM f GROUP BY 1, 2), c AS (SELECT crop, quantile_cont(x, 0.5) * 0.8 AS floor_, count(*) AS n FROM m GROUP BY 1)
SELECT 'below_median_yield' AS rule, 'yield' AS metric, district || ' / ' || crop AS scope, round_even(x, 3) AS observed, round_even(floor_, 3) AS threshold FROM m JOIN c USING (crop) WHERE n >= 3 AND x < floor_""")
def below_median_yield(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_rule(spark, sf_dir, agriculture.below_median_yield)


@R.add(CROP_SQL + """, m AS (SELECT crop, district, avg(yield) AS mu, stddev_pop(yield) AS sd, count(yield) AS n FROM f GROUP BY 1, 2)
SELECT 'high_yield_variance' AS rule, 'yield coefficient of variation' AS metric, district || ' / ' || crop AS scope, round_even(sd / mu, 6) AS observed, 0.5 AS threshold FROM m WHERE n >= 3 AND sd / mu > 0.5""")
def high_yield_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crop_rule(spark, sf_dir, agriculture.high_yield_variance, 6)


CROP_RULES = ("season_totals", "yield_collapse", "production_drop", "area_fall", "rainfall_outside_range", "below_median_yield", "high_yield_variance")


@R.add(_all_rules_sql(CROP_RULES, "rule, metric"))
def agriculture_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    detection = roles.detect(harvests(spark, sf_dir))
    verdict = agriculture.qualification(detection)
    frame = agriculture.prepare(harvests(spark, sf_dir), detection.assigned if verdict.applies else CROP_ROLES, CROP_CONFIG).frame
    findings, _ = agriculture.run(frame, CROP_CONFIG)
    return filled(findings.select("rule", "metric", "scope"), scope="")


@R.add(CROP_SQL + " SELECT year, round_even(avg(yield), 3) AS yield FROM f GROUP BY 1")
def yield_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agriculture.yield_by_year(grown(spark, sf_dir)).select("year", rounded("yield", 3).alias("yield"))


@R.add(CROP_SQL + " SELECT district, round_even(avg(yield), 3) AS yield FROM f GROUP BY 1 ORDER BY avg(yield) DESC, 1 LIMIT 15")
def yield_by_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agriculture.yield_by_district(grown(spark, sf_dir)).select("district", rounded("yield", 3).alias("yield"))


QUERIES, ORACLES = R.queries, R.oracles
