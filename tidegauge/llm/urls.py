"""URL filter: block and allow rules first, gradient-boosted trees on lexical features for the URLs that no rule fits.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; the path follows up to ``?``, ``#`` or the end.
A rule is (action, host, path beginning); it fits its host and all subdomains where the path starts with its own. The longest rule that fits
wins (of equally long ones that with the longer host, then the smaller text).

The trees learn from labelled URLs: those that rules decide, or a table of (url, blocked) given by the caller. Their features are lengths, depth,
digit ratio, entropy of the characters, counts of parameters and marks, and statistics of the host's suffix (its last two labels): how many URLs
have it, how many hosts, and which share of them is labelled as blocked, unlabelled URLs standing for the overall share. A labelled
URL is taken out of its own suffix's share. Only fitting uses a bounded sample: at most ``sample`` labelled URLs, those of smallest hash;
the suffix statistics and the verdicts read every row.

Everything here is column expressions, joins and ``pyspark.ml`` in the JVM.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by the trees on the text it has; repeated rows are judged
alike; without labelled URLs nothing is blocked but by rules, with labels of one kind every other URL gets that kind; an empty table gives an
empty result; extra columns, whatever their names, are kept out of the way and returned by ``judge`` unchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.plans.skew import salted_lookup
from tidegauge.session import settle

Rule = tuple[str, str, str]

SAMPLE = 20_000
TREES, DEPTH = 20, 4
#: Labelled URLs that the overall share stands for in each suffix.
PRIOR_URLS = 20.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters whose frequencies make the entropy; all others count as one more.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~/:?#=&%+@"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where there is none."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_text(host: str, path: str) -> str:
    return host + path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(action, text) of the rule that wins, null where none fits. Hosts of rules are looked up by the last labels of the host."""
    if not rules:
        return F.lit(None).cast("struct<action:string,text:string>")
    by_host: dict[str, list[Rule]] = {}
    for action, name, start in rules:
        by_host.setdefault(name, []).append((action, name, start))
    entry = "array<struct<size:int,host_size:int,text:string,start:string,action:string>>"
    pairs: list[Column] = []
    for name, own in sorted(by_host.items()):
        held = [
            F.struct(
                F.lit(len(rule_text(n, p))).alias("size"), F.lit(len(n)).alias("host_size"), F.lit(rule_text(n, p)).alias("text"), F.lit(p).alias("start"), F.lit(a).alias("action")
            )
            for a, n, p in own
        ]
        pairs += [F.lit(name), F.array(*held).cast(entry)]
    table = F.create_map(*pairs)
    deepest = max(n.count(".") for n in by_host) + 1
    # no rule has more labels than ``deepest``, so a host of any length costs as much
    labels = F.split(host, r"\.")
    last = F.slice(labels, F.greatest(F.size(labels) - deepest + 1, F.lit(1)), F.lit(deepest))
    names = F.transform(F.sequence(F.lit(1), F.size(last)), lambda i: F.array_join(F.slice(last, i, F.size(last)), "."))
    offered = F.flatten(F.transform(names, lambda n: F.coalesce(F.element_at(table, n), F.array().cast(entry))))
    fit = F.filter(offered, lambda r: F.startswith(path, r["start"]))
    best = F.array_sort(
        fit,
        lambda a, b: F.when(a["size"] != b["size"], b["size"] - a["size"])
        .when(a["host_size"] != b["host_size"], b["host_size"] - a["host_size"])
        .when(a["text"] != b["text"], F.when(a["text"] < b["text"], -1).otherwise(1))
        .otherwise(F.when(a["action"] < b["action"], -1).when(a["action"] > b["action"], 1).otherwise(0)),
    )
    first = F.try_element_at(best, F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["action"].alias("action"), first["text"].alias("text")))


def suffix(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _entropy(text: Column) -> Column:
    n = F.length(text)
    counts = F.transform(F.array(*[F.lit(c) for c in ALPHABET]), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    rest = n - F.aggregate(counts, F.lit(0), lambda a, c: a + c)
    part = lambda c: F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(F.lit(0.0))
    return F.aggregate(F.transform(F.concat(counts, F.array(rest)), part), F.lit(0.0), lambda a, c: a + c)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def lexical_features(frame: DataFrame, url_col: str = "url") -> tuple[DataFrame, list[Column]]:
    """What the text of a URL tells, without any table: ``frame`` with the parts it is read from, and the numbers."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    # the parts are columns of their own, so that they are cut once a row and not once a feature
    own_host, own_path = split_url(url)
    cut = frame.withColumns({"lx_text": F.translate(url, UPPER, LOWER), "lx_host": own_host, "lx_path": own_path})
    cut = cut.withColumns({"lx_query": F.regexp_extract("lx_text", r"\?([^#]*)", 1), "lx_size": F.greatest(F.length("lx_text"), F.lit(1))})
    text, host, path, query, n = (F.col(f"lx_{c}") for c in ("text", "host", "path", "query", "size"))
    return cut, [
        F.length(text), F.length(host), F.length(path), F.length(query), _count(host, r"\."), _count(path, "/+[^/]"), _count(text, "[0-9]") / n, _count(host, "[0-9]"),
        _count(host, "-"), _entropy(text), _entropy(host), _count(query, "[^&;]+"), _count(text, "%[0-9a-f]{2}"), F.startswith(text, F.lit("http://")).cast("int"),
        _count(host, "[aeiou]") / F.greatest(F.length(host), F.lit(1)), F.coalesce(F.array_max(F.transform(F.split(host, r"[.-]"), lambda p: F.length(p))), F.lit(0)),
        F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)), F.contains(text, F.lit("#")).cast("int"), F.endswith(path, F.lit("/")).cast("int"),
        _count(text, r"[^\x00-\x7F]"), _count(text, "@"),
    ]


def _suffix_table(seen: DataFrame) -> DataFrame:
    return seen.groupBy("suffix").agg(
        F.count("*").alias("urls"), F.approx_count_distinct("host").alias("hosts"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("bad")
    )


def _featured(frame: DataFrame, table: DataFrame, share: float) -> DataFrame:
    """``features`` beside the columns of ``frame`` (url, suffix, blocked); the share of a suffix leaves the URL itself out."""
    cut, numbers = lexical_features(frame)
    joined = salted_lookup(cut, "suffix", table, "urls_count")
    own = F.col("blocked").isNotNull().cast("int")
    rest = F.coalesce(F.col("urls") - own, F.lit(0))
    bad = F.coalesce(F.col("bad") - F.coalesce(F.col("blocked"), F.lit(0.0)), F.lit(0.0))
    unlabelled = F.coalesce(F.col("urls") - F.col("labelled"), F.lit(0)) + PRIOR_URLS
    shrunk = (bad + F.lit(share) * unlabelled) / F.greatest(rest - F.coalesce(F.col("urls") - F.col("labelled"), F.lit(0)) + unlabelled, F.lit(1))
    numbers += [F.log1p(F.coalesce("urls", F.lit(0))), F.log1p(F.coalesce("hosts", F.lit(0))), shrunk]
    return joined.withColumn("features", F.array(*[c.cast("double") for c in numbers])).drop("urls", "hosts", "labelled", "bad", "lx_text", "lx_host", "lx_path", "lx_query", "lx_size")


def judge(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", labelled: DataFrame | None = None, sample: int = SAMPLE, limit: float = 0.5) -> DataFrame:
    """The columns of ``pages`` in one struct ``page``, and host, path, rule, verdict (allow or block) and score (the trees' probability of blocking).

    ``labelled`` holds (url, blocked 0/1); by default the URLs that rules decide are the labelled ones.
    """
    url = F.col(url_col)
    host, path = split_url(url)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), url.cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("suffix", suffix(F.col("host")))
    ruled = (F.col("fit.action") == "block").cast("double")
    if labelled is None:
        seen = rows.select("url", "host", "suffix", ruled.alias("blocked"))
        rows = rows.withColumn("blocked", ruled)
    else:
        own_host, _ = split_url(F.col("url"))
        own = labelled.select("url", F.col("blocked").cast("double").alias("blocked")).withColumn("host", own_host).withColumn("suffix", suffix(F.col("host")))
        seen = rows.select("url", "host", "suffix", F.lit(None).cast("double").alias("blocked")).unionByName(own)
        rows = rows.withColumn("blocked", F.lit(None).cast("double"))
    table = settle(_suffix_table(seen)).withColumn("urls_count", F.col("urls"))
    totals = table.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad")).first()
    out = ["page", "host", "path", F.col("fit.text").alias("rule")]
    ruled_verdict = F.col("fit.action")
    if not totals["labelled"] or totals["bad"] in (0.0, float(totals["labelled"])):
        score = 1.0 if totals["labelled"] and totals["bad"] else 0.0
        return rows.select(*out, F.coalesce(ruled_verdict, F.lit("block" if score else "allow")).alias("verdict"), F.lit(score).alias("score"))
    share = totals["bad"] / totals["labelled"]
    # the smallest hashes of distinct URLs: a sample that does not hang on the partitioning
    known = seen.where(F.col("blocked").isNotNull())
    place = F.shiftrightunsigned(F.xxhash64(F.lit("fit"), "url"), 11) / F.lit(float(1 << 53))
    part = min(1.0, sample / totals["labelled"])
    drawn = known.withColumn("place", place).where(F.col("place") < part).orderBy("place", "url", "blocked").limit(2 * sample)
    fitting = settle(_featured(drawn, table, share).select(array_to_vector("features").alias("features"), "blocked"))
    kinds = fitting.agg(F.count("*").alias("n"), F.coalesce(F.sum("blocked"), F.lit(0.0)).alias("bad")).first()
    if kinds["bad"] in (0.0, float(kinds["n"])):  # repeated URLs can leave a sample of one kind
        score = F.lit(share)
        scored = rows.withColumn("score", score)
    else:
        trees = GBTClassifier(featuresCol="features", labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, maxBins=64, seed=11, cacheNodeIds=False, checkpointInterval=-1)
        model = trees.fit(fitting)
        featured = _featured(rows, table, share).withColumn("features", array_to_vector("features"))
        scored = model.setRawPredictionCol("").setPredictionCol("").transform(featured).withColumn("score", vector_to_array("probability")[1])
    method = F.when(F.col("score") >= limit, "block").otherwise("allow")
    return scored.select(*out, F.coalesce(ruled_verdict, method).alias("verdict"), F.round("score", 9).alias("score"))

