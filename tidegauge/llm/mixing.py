"""Mixing sources to target weights by entropy balancing.

Every document gets a rate exp(a + b x) of its source, cut off at ``cap``, with x its size against the source's mean. Among all rates that take the
wanted words and keep the source's ratio of words to documents, these are the ones of least relative entropy to the documents as they are. The dual
is convex and is solved by Newton steps whose sums run over (source, size) counts, so that a source holding a third of all rows is a few thousand rows.

Rates are rounded into copies without gathering a source: a document takes the whole part of its rate, and one more if its fixed random number,
divided by the rate's fraction, lies below the source's cut. The cut comes from two histograms of words, and a few single documents close the rest.
All of it depends on the rows alone, so reruns agree. DataFrame functions only.

A null text has size 0; a null source is a source of its own, after all others; null ids and repeated rows are rows like others (equal rows get equal
copies); sources without words take nothing; an empty table gives an empty table; other columns are kept by ``mix`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.batches import NULL_MARK
from tidegauge.plans.order import global_index
from tidegauge.plans.skew import salted_lookup
from tidegauge.session import hold, settle

CAP = 3.0
WEIGHTS = (1, 2, 3)
STEPS = 40
TOLERANCE = 1e-10
BINS = 4096
FILLS = 12
#: Source rows of at most this many bytes in all are held as a local relation and broadcast; more are kept in the shared folder and joined in a shuffle with hot sources salted.
BROADCAST_BYTES = 4 << 20
_HASH_BITS = 53


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, *kept: Column) -> DataFrame:
    """``kept``, the source as a key, the size, and a number that is fixed for each row; all read from the columns of ``docs`` as they are, whatever their names."""
    return docs.select(
        *kept, F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(NULL_MARK)).alias("mix_key"), words_in(F.col(text_col)).alias("mix_size"),
        F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col(id_col), F.col(text_col)), 64 - _HASH_BITS).alias("mix_hash"),
    )


def targets(sources: DataFrame, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to (mix_key, size, …): shares by weight, none above ``cap`` times its size, the excess reshared until none is."""
    ranked = global_index(sources, [F.when(F.col("mix_key") == NULL_MARK, 1).otherwise(0).asc(), F.col("mix_key").asc()], name="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = settle(ranked.withColumn("weight", weight))
    most = F.col("size") * F.lit(cap)
    total, level = None, 0.0
    while True:  # the level only rises, past at least one more source each time
        full = F.col("weight") * F.lit(level) > most
        row = weighed.agg(F.sum("size").alias("total"), F.sum(F.when(full, most).otherwise(0.0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).head()
        total = row["total"] or 0
        higher = (total - row["full"]) / row["open"] if row["open"] else level
        if higher <= level or not row["open"]:
            break
        level = higher
    return weighed.withColumn("target", F.least(F.col("weight") * F.lit(level), most))


def _rate(cap: float) -> Column:
    x = F.when(F.col("mean") > 0, F.col("mix_size") / F.col("mean") - 1).otherwise(0.0)
    return F.least(F.lit(cap), F.exp(F.col("a") + F.col("b") * x))


def _few(sources: DataFrame) -> bool:
    """Whether the rows of all sources together are small; what is added to them later is of fixed size."""
    return (sources.agg(F.sum(F.octet_length("mix_key") + F.lit(200))).head()[0] or 0) <= BROADCAST_BYTES


def _kept(sources: DataFrame, few: bool) -> DataFrame:
    """One row per source, computed once: every step is a plan of its own, and a held one needs one job and no files."""
    return hold(sources) if few else settle(sources)


def balance(counts: DataFrame, sources: DataFrame, few: bool, cap: float = CAP, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds the dual solution ``a``, ``b`` to the sources. ``counts``: (mix_key, mix_size, n)."""
    state = sources.withColumns({
        "mean": F.when(F.col("n") > 0, F.col("size") / F.col("n")).otherwise(0.0), "a": F.lit(0.0), "b": F.lit(0.0),
    })
    fixed = (F.col("size") == 0) | (F.col("target") >= F.col("size") * F.lit(cap) * (1 - 1e-12))
    state = _kept(state.withColumn("a", F.when(F.col("size") == 0, 0.0).when(fixed, F.lit(50.0)).otherwise(0.0)).withColumn("open", ~fixed), few)
    for _ in range(steps):
        of = state.select("mix_key", "mean", "a", "b")
        s, n = F.col("mix_size"), F.col("n")
        x = F.when(F.col("mean") > 0, s / F.col("mean") - 1).otherwise(0.0)
        tilted = counts.join(of, "mix_key").withColumn("rate", _rate(cap))
        free = F.when(F.col("rate") < cap, F.col("rate") * n).otherwise(0.0)
        sums = tilted.groupBy("mix_key").agg(
            F.sum(F.col("rate") * n * s).alias("words"), F.sum(F.col("rate") * n).alias("docs"), F.sum(free * s).alias("ja"), F.sum(free * s * x).alias("jb"), F.sum(free).alias("ka"), F.sum(free * x).alias("kb"),
        )
        c = F.col
        rest, more = c("target") - c("words"), c("target") / c("size") * c("n") - c("docs")
        det = c("ja") * c("kb") - c("jb") * c("ka")
        plain = F.log(c("target") / c("words"))
        newton = F.abs(det) > 1e-9 * c("ja") * c("ka")
        da = F.when(newton, (rest * c("kb") - c("jb") * more) / det).otherwise(plain)
        db = F.when(newton, (c("ja") * more - c("ka") * rest) / det).otherwise(0.0)
        damp = F.least(F.lit(1.0), 1.0 / F.greatest(F.abs(da), F.abs(db), F.lit(1e-300)))
        stepped = state.join(sums, "mix_key")
        error = F.when(c("open"), F.abs(rest) / c("target")).otherwise(0.0)
        moves = c("open") & (error > tolerance)
        state = _kept(stepped.select(
            *sources.columns, "mean", "open", F.when(moves, c("a") + damp * da).otherwise(c("a")).alias("a"), F.when(moves, c("b") + damp * db).otherwise(c("b")).alias("b"), error.alias("error"),
        ), few)
        if (state.agg(F.max("error")).head()[0] or 0.0) <= tolerance:
            break
        state = state.drop("error")
    return state.select(*sources.columns, "mean", "a", "b")


def _with_source(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """Joins the row of its source to every row."""
    if few:
        return rows.join(F.broadcast(sources), "mix_key")
    return salted_lookup(rows, "mix_key", sources.withColumn("rows", F.col("n")), "rows", "inner")


def _copies(cap: float) -> Column:
    """Copies of a row that has its source's columns."""
    rate, turn = _rate(cap), _turn(cap)
    cut = F.coalesce(turn < F.col("cut"), F.lit(False)) & (F.col("mix_size") > 0)
    return (F.floor(rate + 1e-9) + cut.cast("long") + F.array_contains("picks", F.col("mix_hash")).cast("long")).cast("long")


def _turn(cap: float) -> Column:
    """In [0, 1): the earlier, the sooner a row takes the copy that its rate's fraction may give; null, which no cut reaches, if there is no fraction."""
    rate = _rate(cap)
    fraction = rate - F.floor(rate + 1e-9)
    v = F.col("mix_hash") / F.lit(float(1 << _HASH_BITS)) / fraction
    return F.when(fraction > 1e-9, v / (1 + v))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame, bool]:
    """(measured rows, one row per source with everything that fixes its documents' copies, whether these are few)."""
    rows = settle(_measured(docs, id_col, text_col, source_col, F.col(id_col).alias("id")))
    counts = settle(rows.groupBy("mix_key", "mix_size").agg(F.count("*").alias("n")))
    sources = counts.groupBy("mix_key").agg(F.sum(F.col("mix_size") * F.col("n")).alias("size"), F.sum("n").alias("n"))
    few = _few(sources)
    sources = _kept(targets(sources, cap, weights).select("mix_key", "size", "n", "target"), few)
    sources = _kept(balance(counts, sources, few, cap).withColumns({"cut": F.lit(0.0), "picks": F.array().cast("array<long>")}), few)
    base = F.floor(_rate(cap) + 1e-9)
    # two rounds of bins: the second divides the bin in which the first one's words pass the target
    width = 1.0 / BINS
    for _ in range(2):
        held = _with_source(rows, sources, few).withColumn("turn", _turn(cap))
        place = F.floor((F.col("turn") - F.col("cut")) / F.lit(width))
        inside = (F.col("turn") < 1) & (place >= 0) & (place < BINS)
        words = held.groupBy("mix_key", F.when(inside, place).alias("bin")).agg(
            F.sum(F.when(inside, F.col("mix_size"))).alias("in_bin"), F.sum(base * F.col("mix_size")).alias("whole"), F.sum(F.when(F.col("turn") < F.col("cut"), F.col("mix_size")).otherwise(0)).alias("before"),
        )
        # at most BINS + 1 rows a source
        steps = words.groupBy("mix_key").agg(
            F.sum("whole").alias("whole"), F.sum("before").alias("before"), F.array_sort(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "in_bin")))).alias("bins"),
        )
        reached = F.aggregate(
            "bins", F.struct(F.col("room").alias("room"), F.lit(-1).cast("long").alias("last"), F.lit(True).alias("going")),
            lambda acc, b: F.struct(
                F.when(acc["going"], acc["room"] - b["in_bin"]).otherwise(acc["room"]).alias("room"), F.when(acc["going"] & (acc["room"] >= b["in_bin"]), b["bin"]).otherwise(acc["last"]).alias("last"),
                (acc["going"] & (acc["room"] >= b["in_bin"])).alias("going"),
            ),
        )
        moved = sources.join(steps, "mix_key").withColumn("room", F.col("target") - F.col("whole") - F.col("before")).withColumn("reached", reached)
        # all bins up to the last that fits; a bin that does not fit is divided in the next round
        cut = F.col("cut") + F.when(F.col("reached.going"), F.lit(float(BINS))).otherwise(F.expr("element_at(filter(bins, b -> b.bin > reached.last), 1).bin")) * F.lit(width)
        sources = _kept(moved.select(*[c for c in sources.columns if c != "cut"], F.when(F.col("size") > 0, F.least(cut, F.lit(1.0))).otherwise(0.0).alias("cut")), few)
        width /= BINS
    for _ in range(FILLS):
        held = _with_source(rows, sources, few).withColumn("copies", _copies(cap))
        gap = F.col("target") - F.col("taken")
        taken = held.groupBy("mix_key").agg(F.sum(F.col("copies") * F.col("mix_size")).alias("taken"))
        short = sources.join(taken, "mix_key").withColumn("gap", gap)
        open_ = _kept(short, few)
        if not open_.where(F.col("gap") > 0.0005 * F.col("target")).limit(1).count():
            break
        wanted = _with_source(rows, open_, few).withColumn("copies", _copies(cap))
        useful = wanted.where((F.col("mix_size") > 0) & (F.col("copies") + 1 <= cap) & ~F.array_contains("picks", F.col("mix_hash")) & (F.abs(F.col("gap") - F.col("mix_size")) < F.col("gap")))
        best = _kept(useful.groupBy("mix_key").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("mix_size")).alias("miss"), "mix_hash")).alias("best")), few)
        if not best.limit(1).count():
            break
        more = F.when(F.col("best").isNotNull(), F.array_append("picks", F.col("best.mix_hash"))).otherwise(F.col("picks"))
        sources = _kept(open_.join(best, "mix_key", "left").select(*[c for c in sources.columns if c != "picks"], more.alias("picks")), few)
    return rows, sources, few


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for every row."""
    rows, sources, few = plan(docs, id_col, text_col, source_col, cap, weights)
    held = _with_source(rows, sources, few).withColumn("copies", _copies(cap))
    return held.select(
        F.col("id").alias(id_col), F.col("mix_size").alias("size"), F.col("size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("mix_size")).alias("taken"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; nothing but the source's few numbers is joined to the texts."""
    _, sources, few = plan(docs, id_col, text_col, source_col, cap, weights)
    packed = _measured(docs, id_col, text_col, source_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"))
    copies = _with_source(packed, sources, few).withColumn("copies", _copies(cap))
    return copies.where("copies > 0").select("mix_row", F.explode(F.expr("sequence(1L, copies)")).alias("mix_copy")).select("mix_row.*")
