"""The registered queries of this subpackage: each applies one operator to its whole table and returns its digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import batches, collocations, ctw, decontaminate, hard_negatives, jaccard_join, licenses, mixing, pii, quality, spotsigs, tokens, toxicity, urls
from tidegauge.session import settle

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _add(sql: str | None = None):
    def register(query):
        QUERIES[query.__name__] = query
        if sql is not None:
            ORACLES[query.__name__] = sql
        return query

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_add()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a public byte-level vocabulary."""
    return tokens.count_tokens(_read(spark, sf_dir, "documents"))


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@_add(rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, m WHERE len(w) >= m)),
h AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a ten-word window of a benchmark item."""
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_add()
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and template spans in every document."""
    return licenses.scan(_read(spark, sf_dir, "documents")).drop("spans")


@_add()
def op9_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-model and context-tree probability of every document, learned from four fifths of them."""
    documents = _read(spark, sf_dir, "documents")
    held = batches.remainder("doc_id", 5) == 1
    scored = ctw.score(documents, documents.where(~held))
    return scored.withColumn("held_out", batches.remainder("doc_id", 5) == 1)


@_add()
def op1_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and how alike they are."""
    return spotsigs.edit_report(_read(spark, sf_dir, "documents"))


@_add()
def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes from every document."""
    return mixing.taken_words(_read(spark, sf_dir, "documents"))


@_add()
def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from the labels of two thirds of them."""
    labels = _read(spark, sf_dir, "labels")
    measured = settle(quality.measure(_read(spark, sf_dir, "documents")))
    model = quality.train(measured, labels.where(batches.remainder("doc_id", 3) != 1).select("doc_id", "quality"))
    scored = quality.score(measured, model)
    return scored.select("doc_id", (batches.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_add()
def op10_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of four fifths of them."""
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels.where(batches.remainder("doc_id", 5) != 0).select("doc_id", "toxic"))
    scored = toxicity.with_score(documents, model)
    return scored.select("doc_id", (batches.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_add()
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the exact shapes, and what boosted trees accept beyond them."""
    found = pii.report(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.BASE], F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans")


@_add(r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 80 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a WHERE r.root < e.b)
SELECT r.doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1, 2""")
def op2_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count of every document and the smallest document it is linked with, directly or through others."""
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents")).drop("n_links")


@_add()
def op2_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other documents each document is linked with."""
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "component_id", "n_links")


#: The rules that every run applies.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@_add()
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL; trees judge where no rule fits."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select(F.col("page.page_id").alias("page_id"), "host", "path", "rule", "verdict", "score")


@_add("""WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every anchor and positive, the rows of other labels that score highest within its window."""
    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"), F.col("id") % 50 == 0, "vec_id", "label", "embedding")


@_add(r"""WITH pieces AS (SELECT row_number() OVER () AS p, coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY 1),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS g, count(*)::HUGEINT AS f
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
cand AS (SELECT lang, m, g, f, string_split(g, ' ') AS w FROM grams WHERE m > 1),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, (1000 * c.f * n) // (l.f * r.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM cand) c JOIN total t ON t.lang = c.lang
  JOIN grams l ON l.lang = c.lang AND l.g = array_to_string(w[1:k], ' ') JOIN grams r ON r.lang = c.lang AND r.g = array_to_string(w[k + 1:], ' ')),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS g, max(f) AS held FROM (
  SELECT lang, w, f, s, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand WHERE m > 2)) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN inner_ USING (lang, g) WHERE held IS NULL OR 100 * held < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000""")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two to five words of every language."""
    return collocations.mine(_read(spark, sf_dir, "documents"))
