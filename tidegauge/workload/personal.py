"""Personal data and text checks over the documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import privacy, textchecks
from tidegauge.workload.tables import Registry, read

R = Registry()

# Shapes looked for inside running text; the detectors then judge each find as a whole value
FINDS = {"email": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "digits": r"[0-9][0-9 -]{11,22}[0-9]"}


def contacts(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """(doc_id, kind, value): everything in the documents that looks like a contact detail or a long number."""
    documents = read(spark, sf_dir, "documents")
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(FINDS[k]), F.lit(0)).alias("found")) for k in kinds or FINDS])
    each = documents.select("doc_id", F.inline(found)).select("doc_id", "kind", F.explode("found").alias("value"))
    return each.withColumn("value", F.trim("value"))


def _finds_sql(kind: str) -> str:
    return f"SELECT doc_id, '{kind}' AS kind, trim(unnest(regexp_extract_all(text, '{FINDS[kind]}'))) AS value FROM documents"


CONTACTS_SQL = "WITH c AS (" + " UNION ALL ".join(_finds_sql(k) for k in FINDS) + ")"
LUHN_SQL = """(length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1
  THEN CASE WHEN 2 * CAST(substr(d, i, 1) AS INTEGER) > 9 THEN 2 * CAST(substr(d, i, 1) AS INTEGER) - 9 ELSE 2 * CAST(substr(d, i, 1) AS INTEGER) END ELSE CAST(substr(d, i, 1) AS INTEGER) END)) % 10 = 0)"""


@R.add(CONTACTS_SQL + f""", v AS (SELECT kind, value, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM c)
SELECT kind, count(*) AS n, count(*) FILTER (WHERE regexp_matches(value, '^[0-9 -]{{13,25}}$') AND {LUHN_SQL}) AS payment_card, count(*) FILTER (WHERE regexp_matches(value, '^[^@\\s]+@[^@\\s.]+\\.[^@\\s]{{2,}}$')) AS email,
  count(*) FILTER (WHERE regexp_matches(value, '^(25[0-5]|2[0-4]\\d|[01]?\\d?\\d)(\\.(25[0-5]|2[0-4]\\d|[01]?\\d?\\d)){{3}}$')) AS ip_address,
  count(*) FILTER (WHERE regexp_matches(value, '^\\+?[\\d\\s().\\-]{{7,22}}$') AND length(d) BETWEEN 7 AND 15 AND regexp_matches(value, '^\\+|[\\s().\\-]')
    AND NOT regexp_matches(value, '^(\\d{{4}}[-/.]\\d{{1,2}}[-/.]\\d{{1,2}}|\\d{{1,2}}[-/.]\\d{{1,2}}[-/.]\\d{{2,4}})([ T].*)?$')) AS phone_number FROM v GROUP BY 1""")
def detector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many finds of each shape each detector accepts."""
    wide = contacts(spark, sf_dir).groupBy("kind")
    v = F.col("value")
    return wide.agg(
        F.count("*").alias("n"), F.count_if(privacy.is_card(v)).alias("payment_card"), F.count_if(privacy.is_email(v)).alias("email"),
        F.count_if(privacy.is_ip(v)).alias("ip_address"), F.count_if(privacy.is_phone(v)).alias("phone_number"),
    )


@R.add(CONTACTS_SQL + """, w AS (SELECT kind, count(*) AS n, count(*) FILTER (WHERE regexp_matches(value, '^[^@\\s]+@[^@\\s.]+\\.[^@\\s]{2,}$')) AS e FROM c WHERE kind = 'email' GROUP BY 1),
p AS (SELECT count(*) AS n, count(*) FILTER (WHERE regexp_matches(value, '^(25[0-5]|2[0-4]\\d|[01]?\\d?\\d)(\\.(25[0-5]|2[0-4]\\d|[01]?\\d?\\d)){3}$')) AS e FROM c WHERE kind = 'ip')
SELECT 'email' AS "column", 'email' AS kind, 'high' AS confidence, round_even(e * 1.0 / n, 4) AS matched_fraction FROM w WHERE e * 1.0 / n >= 0.8
UNION ALL SELECT 'ip', 'ip_address', 'high', round_even(e * 1.0 / n, 4) FROM p WHERE e * 1.0 / n >= 0.8""")
def column_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which columns of a contact table hold personal data."""
    found = contacts(spark, sf_dir)
    columns = [F.when(F.col("kind") == k, F.col("value")).alias(k) for k in ("email", "ip")]
    return privacy.classify(found.select("doc_id", *columns)).select("column", "kind", "confidence", "matched_fraction")


@R.add("""SELECT 'c_name' AS "column", 'person_name' AS kind, 'candidate' AS confidence FROM customer HAVING count(c_name) >= 5
UNION ALL SELECT 'c_mktsegment', 'free_text', 'not_personal' FROM customer HAVING count(c_mktsegment) >= 5 UNION ALL SELECT 'c_custkey', 'government_id', 'confirmed' FROM customer HAVING count(*) > 0""")
def classification_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name only suggests; a person's decision outranks it either way."""
    decided = spark.createDataFrame([("c_custkey", "government_id"), ("c_mktsegment", "not_personal")], "column string, decision string")
    return privacy.classify(read(spark, sf_dir, "customer"), decided).select("column", "kind", "confidence")


@R.add(CONTACTS_SQL + """, f AS (SELECT value, min(doc_id) AS first FROM c WHERE kind = 'ip' GROUP BY 1), t AS (SELECT value, '<IP_' || row_number() OVER (ORDER BY first, value) || '>' AS token FROM f)
SELECT doc_id, token AS ip FROM c JOIN t USING (value) WHERE kind = 'ip'""")
def masked_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses replaced by tokens numbered by first appearance; equal addresses share one."""
    found = contacts(spark, sf_dir, "ip").select("doc_id", F.col("value").alias("ip"))
    return privacy.mask(found, privacy.classify(found), key="doc_id").data


@R.add("SELECT c_custkey, '<NAME_' || row_number() OVER (ORDER BY c_custkey, c_name) || '>' AS c_name FROM customer")
def masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the strict policy a name column is masked on suspicion, at any number of distinct values."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return privacy.mask(customers, privacy.classify(customers), privacy.STRICT, "c_custkey").data


@R.add("SELECT c_custkey, c_name FROM customer")
def permissive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return privacy.mask(customers, privacy.classify(customers), privacy.PERMISSIVE).data


@R.add(CONTACTS_SQL + """, l AS (SELECT doc_id, list(value ORDER BY value) AS v FROM c WHERE kind = 'email' GROUP BY 1)
SELECT doc_id, array_to_string(list_transform(v, lambda x: '<EMAIL_' || list_position(list_sort(list_distinct(v)), x) || '>'), ',') AS quoted FROM l""")
def masked_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values quoted in findings about a personal column, masked within each list."""
    found = contacts(spark, sf_dir, "email")
    verdict = privacy.classify(found.select("doc_id", F.col("value").alias("email")))
    quoted = found.groupBy("doc_id").agg(F.array_sort(F.collect_list("value")).alias("values")).withColumn("columns", F.array(F.lit("email")))
    return privacy.mask_values(quoted, verdict).select("doc_id", F.array_join("values", ",").alias("quoted"))


@R.add(CONTACTS_SQL + " SELECT 'ask' AS consumer, 'strict' AS policy, count(*) AS row_count, count(DISTINCT value) AS masked FROM c WHERE kind = 'email'")
def egress_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contacts(spark, sf_dir, "email").select("doc_id", F.col("value").alias("email"))
    masked = privacy.mask(found, privacy.classify(found), key="doc_id")
    record = privacy.egress_record(masked, "ask", privacy.STRICT)
    return record.select("consumer", "policy", "row_count", F.col("masked_value_counts")["email"].alias("masked"))


# -- texts -------------------------------------------------------------------------------------------

@R.add("""WITH b AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), n AS (SELECT doc_id, CASE WHEN length(t) = 0 THEN 0 ELSE greatest(1, len(regexp_extract_all(t, '[.!?](?:\\s|$)'))) END AS sentences FROM b)
SELECT doc_id, CAST(sentences AS INTEGER) AS sentences, CASE WHEN sentences < 4 THEN 'too_short' WHEN sentences > 8 THEN 'too_long' ELSE 'ok' END AS verdict FROM n""")
def sentence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textchecks.length_check(read(spark, sf_dir, "documents"), "doc_id", "text")


# The test documents are invented prose, so a second lexicon of words they do use goes with the causal one
COMMON = (r"\bthe\b", r"\band\b", r"\bof\s+the\b", r"\bwith\b")


def _lexicon_sql(pattern: str) -> str:
    return f"""SELECT '{pattern}' AS pattern, count(*) FILTER (WHERE len(regexp_extract_all(text, '(?i){pattern}')) > 0) AS texts, CAST(coalesce(sum(len(regexp_extract_all(text, '(?i){pattern}'))), 0) AS BIGINT) AS hits FROM documents"""


@R.add(" UNION ALL ".join(_lexicon_sql(p) for p in (*textchecks.CAUSAL_LEXICON, *COMMON)))
def lexicon_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every expression of the lexicon over the whole texts."""
    return textchecks.causal_counts(read(spark, sf_dir, "documents"), "text", (*textchecks.CAUSAL_LEXICON, *COMMON))


@R.add(" UNION ALL ".join(f"SELECT doc_id, '{p}' AS pattern, CAST(len(regexp_extract_all(text, '(?i){p}')) AS BIGINT) AS hits FROM documents WHERE regexp_matches(text, '(?i){p}')" for p in COMMON))
def lexicon_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match with its position and surroundings, counted here per text."""
    found = textchecks.causal_matches(read(spark, sf_dir, "documents"), "doc_id", "text", COMMON)
    return found.groupBy("doc_id", "pattern").agg(F.count("*").alias("hits"))


@R.add()
def text_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textchecks.numerals(read(spark, sf_dir, "documents"), "doc_id", "text")


def turn_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as texts, what the user said before as the claims they may draw on."""
    turns = read(spark, sf_dir, "conversations")
    texts = turns.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("text_id"), "text")
    said = turns.where("role = 'user'").select(F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("text_id"), F.col("text").alias("claim_text"), F.concat_ws("-", "conv_id", "turn").alias("claim_id"))
    return texts, said.withColumn("values", F.array(F.length("claim_text").cast("double")))


@R.add()
def unsupported_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numerals of each document that neither its id nor its length accounts for."""
    documents = read(spark, sf_dir, "documents")
    claims = documents.select("doc_id", F.array(F.col("doc_id").cast("double"), F.col("n_chars").cast("double")).alias("values"), F.col("source").alias("claim_text"))
    return textchecks.unsupported_numbers(documents.select("doc_id", "text"), claims, "doc_id", "text")


@R.add()
def uncovered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, claims = turn_claims(spark, sf_dir)
    return textchecks.uncovered_claims(claims, texts, "text_id", "text").select("claim_id", "text_id")


@R.add("""WITH c AS (SELECT conv_id, turn, turn % 3 = 0 AS broken FROM conversations WHERE role = 'user') SELECT conv_id || '-' || turn AS claim_id, 'kept' AS verdict FROM c WHERE NOT broken
UNION ALL SELECT conv_id || '-' || turn, 'rejected' FROM c WHERE broken""")
def grounded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims citing a turn that does not exist are rejected."""
    turns = read(spark, sf_dir, "conversations")
    findings = turns.select(F.concat_ws("-", "conv_id", "turn").alias("finding_id"))
    cited = F.when(F.col("turn") % 3 == 0, F.concat_ws("-", F.lit("missing"), "conv_id")).otherwise(F.concat_ws("-", "conv_id", "turn"))
    claims = turns.where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("claim_id"), F.array(cited).alias("finding_ids"), F.array(F.col("turn").cast("double")).alias("values"))
    kept, rejected = textchecks.grounded_claims(claims, findings)
    return kept.select("claim_id", F.lit("kept").alias("verdict")).unionByName(rejected.select("claim_id", F.lit("rejected").alias("verdict")))


QUERIES, ORACLES = R.queries, R.oracles
