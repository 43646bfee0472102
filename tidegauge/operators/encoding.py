"""Features of a table: filled numbers, and labels through a dictionary that stays in Spark.

The dictionary has one row per label column and distinct label (known by a 128-bit print): a code, for one-hot vectors, and per fold the rows and the sums of the target.
It is joined in, so no list of labels passes through the driver and none is hashed together with others. A tree's split of a
label column is a cut in the order of the labels' mean target, and that mean is taken from other rows than the one it describes:
from the training folds without the row's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.kinds import NUMERIC, kinds, text_of
from tidegauge.plans import order, select, stats
from tidegauge.plans.skew import salted_lookup
from tidegauge.session import settle

#: Rows that the overall mean stands for in the mean of a label.
PRIOR_ROWS = 10.0


@dataclass(frozen=True)
class Encoding:
    """Kept columns by kind, in the table's order."""

    numeric: list[str]
    labels: list[str]


def encoding(df: DataFrame, features: DataFrame) -> Encoding:
    by_kind = kinds(df)
    kept = [r["column"] for r in features.where("kept").orderBy("position").collect()]
    return Encoding([c for c in kept if by_kind[c] == NUMERIC], [c for c in kept if by_kind[c] != NUMERIC])


def typed(df: DataFrame, enc: Encoding, *extra: str) -> DataFrame:
    """``extra``, then n0, n1, … numbers (NaN and null alike missing) and l0, l1, … prints of labels, null being a label of its own."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return df.select(
        *extra, *[number(c).alias(f"n{i}") for i, c in enumerate(enc.numeric)],
        *[stats.fingerprint(F.coalesce(text_of(df, c), F.lit("__missing__"))).alias(f"l{i}") for i, c in enumerate(enc.labels)],
    )


@dataclass(frozen=True)
class Encoded:
    """Rows (row, fold, label, n0 …, c0 … codes, t0 … target sums by fold) with what is known of the training rows of every fit.

    Fit i leaves fold i out; the last fit leaves nothing out. ``classes`` is 0 for numbers; a label column gives one feature for
    numbers and for two classes, else one per class.
    """

    rows: DataFrame
    enc: Encoding
    folds: int
    classes: int
    medians: list[dict[str, float]]
    priors: list[list[float]]

    @property
    def sides(self) -> int:
        """Target values that a label's mean is taken of."""
        return 1 if self.classes <= 2 else self.classes

    def columns(self) -> list[str]:
        """The original column of each feature of the trees."""
        return [*self.enc.numeric, *[c for c in self.enc.labels for _ in range(self.sides)]]


def _targets(classes: int) -> list[Column]:
    """What is summed of the target: itself, or the membership of each class (of the second where there are two)."""
    if not classes:
        return [F.col("label")]
    return [(F.col("label") == c).cast("double") for c in ([1] if classes <= 2 else range(classes))]


def encode(data: DataFrame, enc: Encoding, folds: int, classes: int = 0) -> Encoded:
    """``data`` holds fold, label and the columns of ``typed``."""
    rows = data.withColumn("row", F.monotonically_increasing_id())
    rows = settle(rows) if not enc.labels else rows
    targets = _targets(classes)
    # for each fold: the rows, then the sums
    cells = [F.count_if(F.col("fold") == f).cast("double") for f in range(folds)]
    cells += [F.sum(F.when(F.col("fold") == f, t).otherwise(0.0)) for t in targets for f in range(folds)]
    if enc.labels:
        rows = settle(rows)
        long = rows.unpivot(["fold", "label"], [f"l{i}" for i in range(len(enc.labels))], "column", "print")
        counted = long.groupBy("column", "print").agg(F.count("*").alias("size"), F.array(*cells).alias("t"))
        named = settle(order.global_index(counted, [F.col("print").asc()], by=["column"], name="code"))
        joined = rows
        for i in range(len(enc.labels)):
            lookup = named.where(F.col("column") == f"l{i}").select(F.col("print").alias(f"l{i}"), F.col("code").cast("double").alias(f"c{i}"), F.col("t").alias(f"t{i}"), "size")
            joined = salted_lookup(joined, f"l{i}", lookup, "size").drop(f"l{i}")
        rows = settle(joined)
    numbers = [f"n{i}" for i in range(len(enc.numeric))]
    medians: list[dict[str, float]] = [{} for _ in range(folds + 1)]
    if numbers:
        trained = rows.select("fold", *numbers, F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("fit")).where(F.col("fit") != F.col("fold"))
        for r in select.medians(trained, numbers, ["fit"]).collect():  # one row a fit and column
            medians[r["fit"]][r["column"]] = r["median"]
    totals = rows.agg(F.array(*cells).alias("t")).first()["t"]
    priors = []
    for fit in range(folds + 1):
        used = [f for f in range(folds) if f != fit]
        n = sum(totals[f] for f in used)
        priors.append([sum(totals[(s + 1) * folds + f] for f in used) / n if n else 0.0 for s in range(len(targets))])
    return Encoded(rows, enc, folds, classes, medians, priors)


def tree_rows(e: Encoded, fits: list[int]) -> DataFrame:
    """(fit, row, train, label, x): the trees' features of every row for each of the fits."""
    fit, fold = F.col("fit"), F.col("fold")
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), fit + 1)
    x = [F.coalesce(F.col(f"n{i}"), at([e.medians[f].get(f"n{i}", 0.0) for f in range(e.folds + 1)])) for i in range(len(e.enc.numeric))]
    for i in range(len(e.enc.labels)):
        held = F.col(f"t{i}")

        def seen(side: int, held: Column = held) -> Column:
            """Sum over the folds that train this fit, without the row's own."""
            cells = F.slice(held, side * e.folds + 1, e.folds)
            return F.aggregate(F.transform(cells, lambda v, f: F.when((f == fit) | (f == fold), 0.0).otherwise(v)), F.lit(0.0), lambda a, v: a + v)

        n = seen(0)
        for s in range(e.sides):
            x.append((seen(s + 1) + PRIOR_ROWS * at([e.priors[f][s] for f in range(e.folds + 1)])) / (n + PRIOR_ROWS))
    spread = e.rows.withColumn("fit", F.explode(F.array(*[F.lit(f) for f in fits])))
    return spread.select("fit", "row", (fit != fold).alias("train"), "label", F.array(*[c.cast("double") for c in x]).alias("x") if x else F.array().cast("array<double>").alias("x"))


def one_hot(e: Encoded, fit: int) -> tuple[DataFrame, DataFrame, list[tuple[str, int]]]:
    """(training rows, held-out rows, width of each original column) with ``label`` and a sparse vector ``features`` for linear models."""
    filled = [F.coalesce(F.col(f"n{i}"), F.lit(e.medians[fit].get(f"n{i}", 0.0))).alias(f"n{i}") for i in range(len(e.enc.numeric))]
    codes = [f"c{i}" for i in range(len(e.enc.labels))]
    rows = e.rows.select("fold", "label", *filled, *codes)
    train, test = rows.where(F.col("fold") != fit), rows.where(F.col("fold") == fit)
    parts, widths = [f"n{i}" for i in range(len(e.enc.numeric))], [(c, 1) for c in e.enc.numeric]
    if codes:
        # only the largest code of each column is fitted; a label without training rows falls into the slot beyond
        model = OneHotEncoder(inputCols=codes, outputCols=[f"h_{c}" for c in codes], dropLast=False, handleInvalid="keep").fit(train)
        train, test = model.transform(train), model.transform(test)
        parts += [f"h_{c}" for c in codes]
        widths += [(c, size + 1) for c, size in zip(e.enc.labels, model.categorySizes)]
    vectors = VectorAssembler(inputCols=parts, outputCol="features")
    return vectors.transform(train).select("label", "features"), vectors.transform(test).select("label", "features"), widths
