"""Document fingerprints by SpotSigs.

Wherever a common word (an anchor) stands, the chain of the next content words after it is a signature; a text's fingerprint is the set of its
signatures. Common words are skipped inside chains, so boilerplate and small edits touch few signatures. The start of a text counts as an
anchor, so every text with a word has a signature. Sets are compared by Jaccard likeness, pruned by their lengths: texts fall into partitions of set
length, and a pair whose lengths alone keep it below the wanted likeness is not compared. DataFrame functions only.

Null and empty texts, and texts without letters or digits, have the empty set; two empty sets are alike (1), an empty and another are not (0). Rows
equal in id and text are one document in the order of documents and are returned as often as they come; null ids come last in that order;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.plans.order import global_index

# Very common words of the languages at hand
ANCHORS = {
    "en": "a an and are as at be by for from has in is it of on or that the this to was were which with",
    "de": "als auf aus das dem den der des die ein eine es für im in ist mit nicht sich und von zu",
    "fr": "au avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une",
    "es": "al con de del el en es esta la las lo los para por que se su un una y",
}
CHAIN = 3
_SPOT = "\u0001"


def _anchor_words() -> list[str]:
    return sorted({w for words in ANCHORS.values() for w in words.split()})


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct 32-bit hashes of the chains of ``chain`` content words after each anchor."""
    common = _anchor_words()
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")

    def content(words: Column) -> Column:
        # content words in order, each with a mark if an anchor (or the start) stands before it
        def marked(w: Column, i: Column) -> Column:
            before = F.get(words, i - 1)
            spot = before.isNull() | before.isin(*common, "")
            return F.when(w.isin(*common, ""), None).when(spot, F.concat(F.coalesce(before, F.lit("")), F.lit(_SPOT), w)).otherwise(w)

        return F.filter(F.transform(words, marked), lambda w: w.isNotNull())

    def chains(kept: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            rest = [F.substring_index(F.get(kept, i + j), _SPOT, -1) for j in range(1, chain)]
            return F.when(F.contains(w, F.lit(_SPOT)), F.hash(w, *rest))

        return F.filter(F.transform(kept, one), lambda h: h.isNotNull())

    return F.array_sort(F.array_distinct(_let(_let(words, content), chains)))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def as_text(signs: Column) -> Column:
    """A set as lower-case hex, eight digits a signature, in order."""
    return F.array_join(F.transform(signs, lambda h: F.lpad(F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def length_partition(signs: Column, least: float) -> Column:
    """Partition by set length: sets at least ``least`` alike lie in the same partition or in neighbouring ones."""
    return F.when(F.size(signs) > 0, F.floor(F.log(F.size(signs).cast("double")) / F.log(F.lit(1 / least)))).otherwise(-1)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 without a comparison if their lengths alone keep it below ``least``."""
    na, nb = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    bound = F.least(na, nb) / F.greatest(na, nb)
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0) | (bound < least), 0.0).otherwise(shared / (na + nb - shared))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(id, signatures) for every row."""
    return docs.select(F.col(id_col), signatures(F.col(text_col), chain).alias("signatures"))


def similar_pairs(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> tuple[DataFrame, DataFrame]:
    """(membership: id, class), (links between classes: class_a, class_b, likeness). A class is one set of signatures, named by its smallest id.

    Sets meet in an inverted index over their rarest signatures, within neighbouring length partitions only.
    """
    signed = fingerprints(docs, id_col, text_col, chain).where(F.size("signatures") > 0)
    classes = signed.groupBy("signatures").agg(F.min(id_col).alias("class"))
    member = signed.join(classes, "signatures").select(F.col(id_col), "class")
    each = classes.select("class", "signatures", F.explode("signatures").alias("sign"))
    rare = each.groupBy("sign").agg(F.count("*").alias("held"))
    ordered = classes.select("class", F.explode("signatures").alias("sign")).join(rare, "sign").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("held", "sign"))).alias("order"))
    # sets that alike share one of so many of their rarest signatures
    prefix = F.size("order") - F.ceil(F.size("order") * F.lit(least) - 1e-9) + 1
    index = ordered.select("class", F.size("order").alias("n"), F.explode(F.slice("order", F.lit(1), prefix.cast("int"))).alias("entry")).where("entry.held > 1")
    index = index.select("class", "n", F.col("entry.sign").alias("sign"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least))).alias("part"))
    near = index.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    a, b = index.alias("a"), near.alias("b")
    met = a.join(b, (F.col("a.sign") == F.col("b.sign")) & (F.col("a.part") == F.col("b.part")) & (F.col("b.n") <= F.col("a.n")) & (F.col("b.n") >= F.col("a.n") * F.lit(least)) & (F.col("a.class") != F.col("b.class")))
    pairs = met.select(F.least("a.class", "b.class").alias("class_a"), F.greatest("a.class", "b.class").alias("class_b")).distinct()
    sets = classes.select("class", "signatures")
    compared = pairs.join(sets.withColumnsRenamed({"class": "class_a", "signatures": "sa"}), "class_a").join(sets.withColumnsRenamed({"class": "class_b", "signatures": "sb"}), "class_b")
    return member, compared.select("class_a", "class_b", likeness(F.col("sa"), F.col("sb"), least).alias("likeness")).where(F.col("likeness") >= least)


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(id, text, edited, signatures, next_signatures): ``edited`` ends in the beginning of the next document instead of its own last quarter.

    Only ids and lengths are ordered. Texts are dealt out once by their key; each then sends its neighbour no more than the wanted beginning.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumns({"k1": F.xxhash64("id", "text"), "k2": F.hash(F.lit(1), "text", "id")})
    keys = rows.select("id", "k1", "k2", F.length("text").alias("n")).distinct()
    order = global_index(keys, [F.col("id").asc_nulls_last(), F.col("k1").asc(), F.col("k2").asc()], name="place")
    total = order.count()
    before = order.select(((F.col("place") + 1) % F.lit(max(total, 1))).alias("place"), F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("n").alias("before_n"))
    order = order.join(before, "place").select("k1", "k2", "b1", "b2", "before_n")
    # both sides of the later join start from this shuffle, which is written once
    placed = rows.withColumn("signs", signatures(F.col("text"), chain)).join(order.hint("merge"), ["k1", "k2"])
    once = placed.withColumn("turn", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).where("turn = 1")
    heads = once.select(F.col("b1").alias("k1"), F.col("b2").alias("k2"), F.expr("left(text, cast(floor(before_n / 4) as int))").alias("head"), F.col("signs").alias("next_signatures"))
    kept = F.expr("left(text, cast(length(text) - floor(length(text) / 4) as int))")
    return placed.join(heads.hint("merge"), ["k1", "k2"]).select(
        F.col("id").alias(id_col), "text", F.concat(kept, "head").alias("edited"), F.col("signs").alias("signatures"), "next_signatures",
    )


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_signatures, length_class) for every row."""
    pairs = edited_texts(docs, id_col, text_col, chain).select(
        F.col(id_col), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "signatures", "next_signatures",
        signatures(F.col("edited"), chain).alias("edited_signatures"),
    )
    return pairs.select(
        id_col, "n_chars", "edited_sha256", as_text(F.col("signatures")).alias("fingerprint"), as_text(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"), likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
        F.size("signatures").cast("long").alias("n_signatures"), length_partition(F.col("signatures"), 0.8).alias("length_class"),
    )
