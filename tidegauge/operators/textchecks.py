"""Checks on generated or collected texts: numbers, causal wording, coverage of claims, length."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.text import strip
from tidegauge.session import rows, spread

# Fixed values
NUMERAL = r"(?<![A-Za-z0-9_-])-?\d+(?:,\d{3})*(?:\.\d+)?%?(?![A-Za-z0-9_])"
CAUSAL_LEXICON = (
    r"\bcaus(e|es|ed|ing|al)\b", r"\bdriv(e|es|en|ing|er|ers)\b", r"\bdrove\b", r"\blead(s|ing)?\s+to\b", r"\bled\s+to\b",
    r"\bresults?\s+in\b", r"\bresult(ed|ing)\s+in\b", r"\bstem(s|med|ming)?\s+from\b", r"\baris(e|es|ing)\s+from\b",
    r"\barose\s+from\b", r"\bdue\s+to\b", r"\bowing\s+to\b", r"\bthanks\s+to\b", r"\bresponsible\s+for\b",
    r"\battributable\s+to\b", r"\battributed\s+to\b", r"\bbecause\b", r"\bas\s+a\s+result\b", r"\bconsequently\b",
    r"\btherefore\b", r"\bhence\b", r"\bthus\b", r"\bthe\s+reason\s+(for|why|behind|that)\b", r"\bimpact(s|ed|ing)?\b",
    r"\beffects?\b", r"\binfluenc(es?|ed|ing)\b", r"\bexplain(s|ed|ing)?\b",
)
STOPWORDS = (
    "this", "that", "with", "from", "have", "were", "been", "which", "there", "their", "about", "above", "below", "between",
    "shows", "shown", "value", "values", "found", "across", "these", "those", "based", "than", "then", "each", "when", "while",
    "into", "over", "under", "such",
)
DECIMALS = 6
SNIPPET = 30
MIN_SENTENCES, MAX_SENTENCES = 4, 8
SENTENCE_END = r"[.!?](?:\s|$)"


def numeral_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMERAL), F.lit(0))


def numeral_value(token: Column) -> Column:
    return F.regexp_replace(token, "[,%]", "").try_cast("double")


def forms(value: Column, decimals: int = DECIMALS) -> Column:
    """A number as written, as a share and as percent points: any of them may be quoted."""
    return F.array_distinct(F.array(F.bround(value, decimals), F.bround(value / 100.0, decimals), F.bround(value * 100.0, decimals)))


def numerals(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, value): distinct numerals per text, over the whole text."""
    tokens = texts.select(key, F.explode(F.array_distinct(numeral_tokens(F.col(text)))).alias("token"))
    return tokens.withColumn("value", numeral_value(F.col("token"))).where("value is not null")


def allowed_forms(claims: DataFrame, key: str, values: str = "values", claim_text: str = "claim_text") -> DataFrame:
    """(key, form): every number a text may quote, from the claims' values and wording."""
    given = claims.select(key, F.explode(values).alias("value"))
    worded = claims.select(key, F.explode(F.transform(numeral_tokens(F.col(claim_text)), numeral_value)).alias("value"))
    return given.unionByName(worded).where("value is not null").select(key, F.explode(forms(F.col("value"))).alias("form")).distinct()


def unsupported_numbers(texts: DataFrame, claims: DataFrame, key: str, text: str, values: str = "values", claim_text: str = "claim_text") -> DataFrame:
    """(key, token): numerals with no matching value in any claim of the same text."""
    quoted = numerals(texts, key, text)
    allowed = allowed_forms(claims, key, values, claim_text)
    supported = quoted.select(key, "token", F.explode(forms(F.col("value"))).alias("form")).join(allowed, [key, "form"], "left_semi")
    return quoted.select(key, "token").join(supported.select(key, "token").distinct(), [key, "token"], "left_anti")


def causal_matches(texts: DataFrame, key: str, text: str, lexicon: Sequence[str] = CAUSAL_LEXICON) -> DataFrame:
    """(key, pattern, position, term, snippet) for every causal expression in the whole text.

    One alternation over the lexicon discards the texts without any; in the others every pattern is looked for
    by an expression of its own, compiled once. A term's position follows from the lengths of the pieces around the earlier terms.
    """
    body = F.col("__body")
    suspects = texts.select(key, F.col(text).alias("__body")).where(body.rlike("(?i)" + "|".join(f"(?:{p})" for p in lexicon)))
    looks = [
        F.struct(F.lit(p).alias("pattern"), F.regexp_extract_all(body, F.lit(f"(?i){p}"), F.lit(0)).alias("__terms"), F.split(body, f"(?i){p}", -1).alias("__gaps")) for p in lexicon
    ]
    split = suspects.select(key, "__body", F.inline(F.array(*looks))).where(F.size("__terms") > 0)
    lengths = F.zip_with(F.slice("__gaps", F.lit(1), F.size("__terms")), "__terms", lambda g, t: F.struct(F.length(g).alias("g"), F.length(t).alias("t")))
    empty = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("at"))
    walked = F.aggregate(
        lengths, empty,
        lambda a, s: F.struct(F.array_append(a["starts"], a["at"] + s["g"]).alias("starts"), (a["at"] + s["g"] + s["t"]).alias("at")),
    )["starts"]
    found = split.withColumn("hit", F.explode(F.arrays_zip(walked.alias("start"), F.col("__terms").alias("term"))))
    start, term = F.col("hit.start"), F.col("hit.term")
    begin = F.greatest(F.lit(0), start - SNIPPET)
    snippet = F.regexp_replace(F.trim(body.substr(begin + 1, start - begin + F.length(term) + SNIPPET)), "\n", " ")
    return found.select(key, "pattern", start.alias("position"), term.alias("term"), snippet.alias("snippet"))


def causal_counts(texts: DataFrame, text: str, lexicon: Sequence[str] = CAUSAL_LEXICON) -> DataFrame:
    """(pattern, texts, hits): the whole lexicon in one scan, patterns without a hit included.

    A pattern is looked for where its plain letters occur: that is told by bytes, and costs far less than the expression.
    """
    held = spread(texts.select(F.col(text).alias("__body"))).select("__body", F.lower("__body").alias("__low"))

    def hits(p: str) -> Column:
        found = F.regexp_count(F.col("__body"), F.lit(f"(?i){p}"))
        for letters in _letters(p):
            found = F.when(F.contains(F.col("__low"), F.lit(letters)), found).otherwise(0)
        return found

    each = held.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), hits(p).alias("hits")) for i, p in enumerate(lexicon)])))
    counts = each.groupBy("i").agg(F.count_if(F.col("hits") > 0).alias("texts"), F.sum("hits").alias("hits"))
    names = rows(texts.sparkSession, list(enumerate(lexicon)), "i int, pattern string")
    whole = names.join(F.broadcast(counts), "i", "left")
    return whole.select("pattern", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("texts", "hits")])


def _letters(pattern: str) -> list[str]:
    """Runs of lower-case letters that every text matching ``pattern`` (case ignored) has once it is lowered; none for expressions not understood."""
    bare = re.sub(r"\([^()\\]*\)[?*]?", " ", pattern)
    if not re.fullmatch(r"(?:\\b|\\s[+*]?|[a-z]\??| )*", bare):
        return []
    return re.findall("[a-z]+", re.sub(r"[a-z]\?|\\[bs][+*]?", " ", bare))


def significant_words(text: Column) -> Column:
    words = F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z_]{3,}"), F.lit(0)), F.lower)
    return F.array_except(words, F.array(*[F.lit(w) for w in STOPWORDS]))


def uncovered_claims(claims: DataFrame, texts: DataFrame, key: str, text: str, values: str = "values", claim_text: str = "claim_text") -> DataFrame:
    """Claims neither whose numbers nor whose significant words appear in their text."""
    prose = texts.select(key, F.lower(text).alias("__prose"), F.flatten(F.transform(numeral_tokens(F.col(text)), lambda t: forms(numeral_value(t)))).alias("__numbers"))
    joined = claims.join(prose, key)
    own = F.concat(
        F.flatten(F.transform(F.col(values), lambda v: forms(v))),
        F.flatten(F.transform(numeral_tokens(F.col(claim_text)), lambda t: forms(numeral_value(t)))),
    )
    worded = F.exists(significant_words(F.col(claim_text)), lambda w: F.col("__prose").contains(w))
    covered = F.coalesce(F.arrays_overlap(own, F.col("__numbers")), F.lit(False)) | worded
    return joined.where(~covered).select(*claims.columns)


def grounded_claims(claims: DataFrame, findings: DataFrame, cited: str = "finding_ids", values: str = "values", decimals: int = 2) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): claims citing a finding that does not exist are rejected; kept values are rounded."""
    unknown = (
        claims.select("claim_id", F.explode(cited).alias("finding_id"))
        .join(findings.select("finding_id").distinct(), "finding_id", "left_anti")
        .groupBy("claim_id").agg(F.array_sort(F.collect_set("finding_id")).alias("unknown_ids"))
    )
    kept = claims.join(unknown.select("claim_id"), "claim_id", "left_anti").withColumn(
        values, F.transform(values, lambda v: F.bround(v, decimals))
    )
    return kept, unknown


def sentence_count(text: Column) -> Column:
    body = strip(text)
    return F.when(F.length(body) == 0, 0).otherwise(F.greatest(F.regexp_count(body, F.lit(SENTENCE_END)), F.lit(1)))


def length_check(texts: DataFrame, key: str, text: str, low: int = MIN_SENTENCES, high: int = MAX_SENTENCES) -> DataFrame:
    n = F.col("sentences")
    return texts.select(key, sentence_count(F.col(text)).alias("sentences")).withColumn(
        "verdict", F.when(n < low, "too_short").when(n > high, "too_long").otherwise("ok")
    )
