"""Reading, normalising, capping and asking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.numeric import half_even, number_from_text, ratio
from tidegauge.functions.text import label
from tidegauge.operators import business, normalise, query
from tidegauge.session import ensure_checkpoint_dir
from tidegauge.sources import files, jdbc, store
from tidegauge.workload.tables import Registry, read, rounded

R = Registry()


def landing(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, where every executor can write and read."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{spark.sql('select uuid()').first()[0]}"


# -- scans -------------------------------------------------------------------------------------------

@R.add("SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance, ';' AS delimiter, 'utf-8' AS encoding FROM customer GROUP BY 1")
def delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written with semicolons and read back with delimiter and encoding found from the lines."""
    path = landing(spark, "customers")
    read(spark, sf_dir, "customer").write.option("header", True).option("sep", ";").csv(path)
    loaded = files.read_delimited(spark, path)
    return loaded.data.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")).select(
        "*", F.lit(loaded.delimiter).alias("delimiter"), F.lit(loaded.arrival.encoding_used).alias("encoding")
    )


@R.add("""WITH l AS (SELECT regexp_replace(c_name || ',' || c_custkey || ',' || c_mktsegment, '"[^"]*"', '', 'g') AS v FROM customer)
SELECT ',' AS delimiter, CAST(2 AS INTEGER) AS per_line, avg(CASE WHEN length(v) - length(replace(v, ',', '')) = 2 THEN 1.0 ELSE 0.0 END) AS share FROM l""")
def delimiter_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "customer").select(F.concat_ws(",", "c_name", "c_custkey", "c_mktsegment").alias("value"))
    return files.delimiter_evidence(lines).select("delimiter", F.col("per_line").cast("int").alias("per_line"), "share")


@R.add("SELECT count(*) AS lines, CAST(0 AS BIGINT) AS invalid, count(*) FILTER (WHERE regexp_full_match(text, '[\\x00-\\x7F]*')) AS ascii FROM conversations")
def encoding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.encoding_evidence(read(spark, sf_dir, "conversations").select(F.col("text").alias("value")).withColumn("value", F.regexp_replace("value", "\n", " ")))


@R.add("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY 1")
def json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns landed as nested records and flattened back."""
    turns = read(spark, sf_dir, "conversations")
    path = landing(spark, "pages")
    record = F.struct("conv_id", "turn", F.struct("role", "text").alias("message"))
    turns.groupBy("conv_id").agg(F.collect_list(record).alias("items")).select(F.struct("items").alias("data")).write.json(path)
    flat = files.flatten(spark.read.json(path).select(F.explode("data.items").alias("r")).select("r.*"))
    distinct = flat.select(F.col("`message.role`").alias("role"), "conv_id").distinct().groupBy("role").agg(F.count("*").alias("conversations"))
    return flat.groupBy(F.col("`message.role`").alias("role")).agg(
        F.count("*").alias("turns"), F.sum(F.length("`message.text`")).alias("characters")
    ).join(distinct, "role")


@R.add("""WITH t AS (SELECT count(DISTINCT conv_id) AS pages, count(*) AS n FROM conversations)
SELECT 'pages' AS cap FROM t WHERE pages >= 10 UNION ALL SELECT 'rows' FROM t WHERE n >= 100""")
def page_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("records"))
    warned = files.page_cap_warnings(pages, 10, 100)
    return warned.select(F.when(F.col("warning").contains("page cap"), "pages").otherwise("rows").alias("cap"))


@R.add("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = store.Store(spark, landing(spark, "store"))
    kept.save_snapshot("run-1", read(spark, sf_dir, "orders"))
    return kept.load_snapshot("run-1").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@R.add("SELECT c AS \"column\", (SELECT count(*) FROM nation) AS row_count FROM (VALUES ('n_nationkey'), ('n_name'), ('n_regionkey')) t(c)")
def contract_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.contract_metadata(read(spark, sf_dir, "nation")).select("column", "row_count")


@R.add("SELECT count(*) AS n, count(*) > 1000000 AS refused FROM lineitem")
def size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table above the limit is refused whole, never cut."""
    items = read(spark, sf_dir, "lineitem")
    try:
        files.check_size(items, 1_000_000)
        refused = False
    except files.TableTooLarge:
        refused = True
    return items.agg(F.count("*").alias("n")).select("n", F.lit(refused).alias("refused"))


@R.add("""SELECT o_custkey AS customer, arg_max(o_orderpriority, o_orderdate) AS decision FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) AS i FROM orders) WHERE i = 1 GROUP BY 1 HAVING arg_max(o_orderpriority, o_orderdate) <> '5-LOW'""")
def latest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order a decision about its customer; '5-LOW' clears it. The last word wins."""
    orders = read(spark, sf_dir, "orders")
    last_of_day = orders.groupBy("o_custkey", "o_orderdate").agg(F.max_by("o_orderpriority", "o_orderkey").alias("p"))
    log = last_of_day.select(
        F.col("o_custkey").alias("source_id"), F.lit("role").alias("subject"), F.lit("entity_id").alias("key"),
        F.when(F.col("p") != "5-LOW", F.col("p")).alias("decision"), F.lit("reviewer").alias("decided_by"), F.col("o_orderdate").alias("at"),
    )
    return store.latest_decisions(log).select(F.col("source_id").alias("customer"), "decision")


@R.add("SELECT o_custkey AS source_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS baseline_id FROM orders GROUP BY 1")
def active_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order a baseline version of its customer: the newest is the active one."""
    versions = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("baseline_id"), F.col("o_orderdate").alias("created_at"))
    return store.active_baselines(versions).select("source_id", "baseline_id")


@R.add("SELECT * FROM (VALUES ('o_totalprice', 'VARCHAR(20)', 'double'), ('o_orderpriority', 'INTEGER', 'string')) t(\"column\", declared_type, actual_type)")
def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared against actual type families of the orders table; an unknown family is not flagged."""
    declared = {"o_orderkey": "BIGINT", "o_totalprice": "VARCHAR(20)", "o_orderdate": "TIMESTAMP", "o_orderpriority": "INTEGER", "o_orderstatus": "GEOMETRY"}
    return jdbc.type_mismatches(read(spark, sf_dir, "orders"), declared)


# -- normalisation -----------------------------------------------------------------------------------

@R.add("""WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 200 = 0) AS junk, count(*) FILTER (WHERE o_orderkey % 20 = 0) AS more FROM orders)
SELECT 'mixed' AS "column", round_even((n - junk) * 1.0 / n, 6) AS parse_rate, (n - junk) * 1.0 / n >= 0.99 AS coerced FROM t
UNION ALL SELECT 'partial', round_even((n - more) * 1.0 / n, 6), (n - more) * 1.0 / n >= 0.99 FROM t""")
def date_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written four ways, with some junk: nearly all parse in one column, too few in the other."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    written = (
        F.when(key % 4 == 0, F.date_format(date, "MM/dd/yyyy")).when(key % 4 == 1, F.date_format(date, "MMM d, yyyy"))
        .when(key % 4 == 2, F.date_format(date, "yyyyMMdd")).otherwise(F.date_format(date, "yyyy-MM-dd"))
    )
    orders = read(spark, sf_dir, "orders").select(
        F.when(key % 200 == 0, "to be 1 set").otherwise(written).alias("mixed"), F.when(key % 20 == 0, "n/a 9").otherwise(date.cast("string")).alias("partial"),
        F.lit("no digits").alias("words"),
    )
    return normalise.datetimes(orders).attempts.select("column", rounded("parse_rate").alias("parse_rate"), "coerced")


def priced():
    return F.concat(F.lit("$"), F.format_number("l_extendedprice", 2))


@R.add("SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total, count(*) AS parsed FROM lineitem GROUP BY 1")
def number_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_returnflag", number_from_text(priced()).alias("v"))
    return items.groupBy("l_returnflag").agg(F.round(F.sum("v"), 2).alias("total"), F.count("v").alias("parsed"))


@R.add("""SELECT 'price' AS "column", count(l_extendedprice) * 1.0 / count(*) AS parse_rate, true AS looks_numeric FROM lineitem
UNION ALL SELECT 'flag', avg(CASE WHEN l_returnflag SIMILAR TO '-?[0-9.]+' THEN 1.0 ELSE 0.0 END), false FROM lineitem
UNION ALL SELECT 'mixed', round_even(avg(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END), 6), avg(CASE WHEN l_returnflag = 'R' THEN 0.0 ELSE 1.0 END) >= 0.9 FROM lineitem""")
def numeric_text_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select(
        priced().alias("price"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_returnflag") == "R", "returned").otherwise(priced()).alias("mixed")
    )
    return normalise.numeric_text_share(items).select("column", rounded("parse_rate").alias("parse_rate"), "looks_numeric")


@R.add("SELECT 'price' AS \"column\", count(*) FILTER (WHERE l_returnflag = 'R') AS unparsed FROM lineitem")
def money_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_returnflag") == "R", "returned").otherwise(priced()).alias("price"))
    return normalise.money(items, "price")[1].select("column", "unparsed")


@R.add("SELECT 'points' AS \"column\", round_even(sum(l_discount), 4) AS total FROM lineitem UNION ALL SELECT 'fraction', round_even(sum(l_discount), 4) FROM lineitem UNION ALL SELECT 'signed', round_even(sum(l_discount), 4) FROM lineitem")
def ratio_convention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts as points, as fractions and with a % sign end up as the same fractions."""
    items = read(spark, sf_dir, "lineitem").select(
        (F.col("l_discount") * 100).alias("points"), F.col("l_discount").alias("fraction"), F.concat(F.format_number(F.col("l_discount") * 100, 0), F.lit("%")).alias("signed")
    )
    for column in ("points", "fraction", "signed"):
        items, _ = normalise.ratio_column(items, column)
    return items.agg(*[rounded(F.sum(c), 4).alias(c) for c in items.columns]).unpivot([], items.columns, "column", "total")


@R.add("""SELECT upper(substr(lower(p_type), 1, 1)) || substr(lower(p_type), 2) AS normalised_to, count(*) AS n, CAST(3 AS INTEGER) AS spellings FROM part GROUP BY 1""")
def label_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three spellings of each part type become one label."""
    key = F.col("p_partkey") % 3
    parts = read(spark, sf_dir, "part").withColumn(
        "p_type", F.when(key == 0, F.col("p_type")).when(key == 1, F.lower("p_type")).otherwise(F.concat(F.lit("  "), F.initcap("p_type"), F.lit(" ")))
    )
    clean, merged = normalise.labels(parts, "p_type")
    sizes = clean.groupBy(F.col("p_type").alias("normalised_to")).agg(F.count("*").alias("n"))
    return merged.join(sizes, "normalised_to").select("normalised_to", "n", F.size("from").alias("spellings"))


@R.add("SELECT count(*) AS n, count(*) FILTER (WHERE l_tax = 0) AS undefined, round_even(sum(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END), 3) AS total FROM lineitem")
def safe_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select(ratio("l_discount", "l_tax").alias("r"))
    return items.agg(F.count("*").alias("n"), F.count_if(F.col("r").isNull()).alias("undefined"), half_even(F.sum("r"), 3).alias("total"))


@R.add("""SELECT 'p_retailprice x l_quantity' AS label, round_even(sum(p_retailprice * l_quantity), 2) AS value FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'line_total', round_even(sum(l_extendedprice), 2) FROM lineitem JOIN part ON l_partkey = p_partkey""")
def value_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit price is multiplied by quantity, a line total is not."""
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("unit_price"))
    items = read(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("l_extendedprice", "line_total")
    unit, total = business.value_basis("unit_price", "l_quantity"), business.value_basis("line_total", "l_quantity")
    sums = items.agg(half_even(F.sum(unit.column()), 2).alias("unit"), half_even(F.sum(total.column()), 2).alias("total"))
    named = {"unit": unit.label.replace("unit_price", "p_retailprice"), "total": total.label}
    return sums.unpivot([], ["unit", "total"], "kind", "value").select(
        F.create_map(*[F.lit(x) for p in named.items() for x in p])[F.col("kind")].alias("label"), "value"
    )


@R.add("SELECT 'Grand Total' AS label, count(*) AS dropped FROM part WHERE p_brand = 'Brand#1' UNION ALL SELECT ' TOTAL ', count(*) FROM part WHERE p_brand = 'Brand#2'")
def summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.col("p_brand")
    parts = read(spark, sf_dir, "part").withColumn("p_brand", F.when(brand == "Brand#1", "Grand Total").when(brand == "Brand#2", " TOTAL ").otherwise(brand))
    return normalise.drop_summary_rows(parts, "p_brand")[1]


# -- asking ------------------------------------------------------------------------------------------

@R.add("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def ask_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "WITH t AS (SELECT o_orderpriority, o_totalprice FROM asked) SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM t GROUP BY o_orderpriority"
    return query.ask(read(spark, sf_dir, "orders"), "asked", sql)


@R.add("SELECT least(count(*), 10000) AS n, count(*) > 10000 AS truncated FROM lineitem")
def ask_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    answered = query.answer(read(spark, sf_dir, "lineitem"), "asked_items", "SELECT * FROM asked_items")
    return answered.rows.agg(F.count("*").alias("n")).select("n", F.lit(answered.truncated).alias("truncated"))


@R.add("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 5)")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows by key, names masked."""
    head = query.sample_rows(read(spark, sf_dir, "customer"), "c_custkey")
    return head.agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


@R.add("SELECT upper(substr(x, 1, 1)) || lower(substr(x, 2)) AS brand, n FROM (SELECT p_brand AS x, count(*) AS n FROM part GROUP BY 1)")
def brand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").groupBy(label(F.col("p_brand")).alias("brand")).agg(F.count("*").alias("n"))


QUERIES, ORACLES = R.queries, R.oracles
