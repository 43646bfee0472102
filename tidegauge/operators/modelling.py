"""Leakage-guarded models that must beat a trivial baseline to be believed."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.kinds import CATEGORICAL, DATETIME, NUMERIC, columns_of, kinds, nan_to_null, text_of
from tidegauge.functions.numeric import micros
from tidegauge.operators.encoding import Encoded, encode, encoding, one_hot, tree_rows, typed
from tidegauge.operators.forest import Plan, forest
from tidegauge.plans import order, stats
from tidegauge.session import hold, rows, settle

FORECAST, CLASSIFICATION, REGRESSION, UNSUPPORTED = "forecast", "classification", "regression", "unsupported"


@dataclass(frozen=True)
class Config:
    leakage_correlation: float = 0.98
    identifier_ratio: float = 0.95
    null_rate: float = 0.5
    class_ceiling: int = 50
    min_rows: int = 100
    min_periods: int = 24
    splits: int = 5
    seed: int = 0
    baseline_margin: float = 0.05
    f1_floor: float = 0.5
    rmse_ceiling: float | None = None
    majority_share: float = 0.9
    monthly_span: int = 365
    weekly_span: int = 60
    horizon: int = 12
    trees: int = 100
    depth: int = 30
    iterations: int = 1000
    task_rows: int | None = None


#: Features beyond which the linear model is solved by gradients.
WIDE = 512
SEASONS = {"MS": 12, "W": 52, "D": 7}
BAND_80 = 1.2816


# -- task --------------------------------------------------------------------------------------------

def select_task(df: DataFrame, target: str, config: Config = Config()) -> tuple[str, str | None]:
    """Another datetime column makes it a forecast; else the target's kind and number of values decide."""
    moments = [c for c in columns_of(df, DATETIME) if c != target]
    if moments:
        return FORECAST, moments[0]
    kind = kinds(df)[target]
    if kind == NUMERIC:
        return REGRESSION, None
    if kind == CATEGORICAL:
        # one more than the ceiling is enough to know
        seen = df.where(F.col(target).isNotNull()).select(target).distinct().limit(config.class_ceiling).count()
        if 1 < seen < config.class_ceiling:
            return CLASSIFICATION, None
    return UNSUPPORTED, None


def series_frequency(df: DataFrame, moment: str, config: Config = Config()) -> str:
    span = df.agg(F.floor((micros(F.max(moment)) - micros(F.min(moment))) / F.lit(86_400_000_000))).first()[0] or 0
    return "MS" if span >= config.monthly_span else "W" if span >= config.weekly_span else "D"


def period_start(moment: Column, frequency: str) -> Column:
    """Month start, the Sunday that ends the week, or the day."""
    day = F.to_date(moment)
    if frequency == "MS":
        return F.trunc(day, "month")
    return F.date_add(F.to_date(F.date_trunc("week", day)), 6) if frequency == "W" else day


def time_series(df: DataFrame, moment: str, target: str, frequency: str) -> DataFrame:
    """(t, period, value): sums (counts for text), empty periods as zero. One row per period."""
    numeric = kinds(df)[target] == NUMERIC
    value = F.coalesce(F.sum(F.col(target).cast("double")), F.lit(0.0)) if numeric else F.count(target).cast("double")
    sums = df.where(F.col(moment).isNotNull()).groupBy(period_start(F.col(moment), frequency).alias("period")).agg(value.alias("value"))
    sums = hold(sums)  # at most one row per period of the data's span
    step = {"MS": "interval 1 month", "W": "interval 7 days", "D": "interval 1 day"}[frequency]
    grid = sums.agg(F.min("period").alias("lo"), F.max("period").alias("hi")).select(F.explode(F.expr(f"sequence(lo, hi, {step})")).alias("period"))
    filled = grid.join(sums, "period", "left").select("period", F.coalesce("value", F.lit(0.0)).alias("value"))
    return filled.select((F.row_number().over(Window.orderBy("period")) - 1).alias("t"), "period", "value")


# -- features ----------------------------------------------------------------------------------------

FEATURE = "column string, kept boolean, reason string"


def select_features(df: DataFrame, target: str, moment: str | None = None, near_unique: Sequence[str] = (), config: Config = Config()) -> DataFrame:
    """(column, kept, reason): identifiers, constants, mostly-null columns and copies of the target are left out."""
    df = nan_to_null(df)
    by_kind = kinds(df)
    columns = [c for c in df.columns if c not in (target, moment)]
    numeric_target = by_kind[target] == NUMERIC

    def measures(c: str) -> dict[str, Column]:
        both = F.col(c).isNotNull() & F.col(target).isNotNull()
        numeric = numeric_target and by_kind[c] == NUMERIC
        later = F.col(c).cast("timestamp") >= F.col(moment).cast("timestamp") if moment and by_kind[c] == DATETIME else F.lit(False)
        same = F.avg(F.when(both, (text_of(df, c) == text_of(df, target)).cast("double")))
        return {
            "rows": F.count(F.lit(1)),
            "nulls": F.count_if(F.col(c).isNull()),
            "r": stats.correlation(F.col(c).cast("double"), F.col(target).cast("double")) if numeric else F.lit(None).cast("double"),
            "agreement": F.lit(None).cast("double") if numeric else same,
            "later": F.coalesce(F.bool_or(later), F.lit(False)),
        }

    distinct = stats.distinct_per_column(df, columns)
    facts = stats.per_column(df, columns, measures).join(distinct, "column", "left").fillna(0, ["distinct"])
    facts = facts.join(F.broadcast(stats.declared_columns(df).select("column", "position", "kind")), "column")
    share = F.try_divide(F.col("nulls"), F.col("rows"))
    limit = config.leakage_correlation
    reason = (
        F.when(F.col("column").isin(*near_unique) if near_unique else F.lit(False), "near-unique, identifier-like")
        .when((F.col("kind") == CATEGORICAL) & (F.try_divide(F.col("distinct"), F.col("rows")) >= config.identifier_ratio), "high cardinality, looks like an identifier")
        .when(F.col("distinct") <= 1, "constant column")
        .when(share > config.null_rate, "mostly null")
        .when(F.abs("r") > limit, "near-perfectly correlated with the target")
        .when(F.col("agreement") > limit, "near-perfect agreement with the target")
        .when(F.col("later"), "timestamp at or after the reference time on at least one row")
    )
    return hold(facts.select("position", "column", "distinct", reason.isNull().alias("kept"), reason.alias("reason"))).orderBy("position")


# -- folds -------------------------------------------------------------------------------------------

def with_folds(df: DataFrame, k: int, seed: int = 0, label: str | None = None) -> DataFrame:
    """Add ``fold`` 0..k-1: shuffled by hash, dealt out in turn (within each label when one is given).

    Dealing by a global index keeps folds even, and a majority label is never gathered in one task.
    """
    shuffled = F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed))
    hashed = df.withColumn("__hash", shuffled)
    indexed = order.global_index(hashed, [F.asc("__hash")], by=[label] if label else ())
    return indexed.withColumn("fold", (F.col("idx") % k).cast("int")).drop("idx", "__hash")


def forward_folds(n: int, k: int) -> list[tuple[int, int]]:
    """(test start, test end) of forward chaining: training is everything before the start."""
    size = n // (k + 1)
    return [(n - (k - i) * size, n - (k - i - 1) * size) for i in range(k)]


# -- outcome -----------------------------------------------------------------------------------------

SCORES = "model string, role string, metric string, score double"


@dataclass
class Outcome:
    task: str
    status: str  # answered / escalated
    reason: str | None = None
    scores: DataFrame | None = None
    winner: str | None = None
    features: DataFrame | None = None
    associations: DataFrame | None = None
    classes: DataFrame | None = None
    forecast: DataFrame | None = None
    notes: dict = field(default_factory=dict)


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    counts = df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def gate(scores: DataFrame, metric: str, config: Config = Config()) -> DataFrame:
    """(winner, score, best_baseline, decision, reason): a model must beat the best baseline by the margin."""
    higher = metric == "f1"
    best = F.max if higher else F.min
    pick = F.max_by if higher else F.min_by
    model = F.when(F.col("role") == "candidate", F.col("score"))
    baseline = F.when(F.col("role") == "baseline", F.col("score"))
    top = scores.agg(
        pick(F.when(F.col("role") == "candidate", F.col("model")), model).alias("winner"), best(model).alias("score"), best(baseline).alias("best_baseline")
    )
    needed = F.col("best_baseline") * (1 + config.baseline_margin if higher else 1 - config.baseline_margin)
    beats = F.col("best_baseline").isNull() | (F.col("score") > needed if higher else F.col("score") < needed)
    floor = F.col("score") < config.f1_floor if higher else F.lit(False) if config.rmse_ceiling is None else F.col("score") > config.rmse_ceiling
    reason = F.when(~beats, "no model beats its baseline by the required margin").when(floor, "score is beyond the configured floor")
    return top.select("*", F.when(reason.isNull(), "answered").otherwise("escalated").alias("decision"), reason.alias("reason"))


def _linear_weights(model) -> list[float]:
    """|coefficient| of each feature, averaged over classes."""
    if hasattr(model, "coefficientMatrix"):
        return list(abs(model.coefficientMatrix.toArray()).mean(axis=0))
    return [abs(w) for w in model.coefficients.toArray()]


def _associations(spark, weights: list[float], widths: list[tuple[str, int]]) -> DataFrame:
    """Mean weight per original column, the largest first."""
    found, at = [], 0
    for column, width in widths:
        block = weights[at : at + width]
        found.append((column, float(sum(block) / max(1, len(block)))))
        at += width
    return rows(spark, sorted(found, key=lambda f: (-f[1], f[0])), "column string, association double")


def _families(e: Encoded, config: Config) -> tuple[str, Callable, Plan]:
    """The linear model's name and maker, and the forest."""
    plan = Plan(config.trees, config.depth, config.seed, e.classes, config.task_rows)
    if e.classes:
        return "logistic_regression", lambda wide: LogisticRegression(maxIter=config.iterations), plan
    # the closed solution needs a square of the features; beyond a few hundred the gradients of it are cheaper
    return "linear_regression", lambda wide: LinearRegression(solver="l-bfgs" if wide else "auto"), plan


def _cross_validate(e: Encoded, evaluator, baseline: Column, config: Config) -> dict[str, list[float]]:
    """Scores by family and fold; the forest's fits of all folds are one job."""
    name, linear, plan = _families(e, config)
    values, _ = forest(tree_rows(e, list(range(e.folds))), list(range(e.folds)), plan)
    labelled = settle(values.join(e.rows.select("row", "label"), "row"))
    scores: dict[str, list[float]] = {name: [], "random_forest": [], "baseline": []}
    for fit in range(e.folds):
        train, test, widths = one_hot(e, fit)
        train = settle(train)
        scores[name].append(evaluator.evaluate(linear(sum(w for _, w in widths) > WIDE).fit(train).transform(test)))
        scores["random_forest"].append(evaluator.evaluate(labelled.where(F.col("fit") == fit).select("label", _decided(e.classes).alias("prediction"))))
        constant = e.rows.where(F.col("fold") != fit).agg(baseline).first()[0]
        scores["baseline"].append(evaluator.evaluate(e.rows.where(F.col("fold") == fit).select("label", F.lit(constant).alias("prediction"))))
    return scores


def _decided(classes: int) -> Column:
    """The number, or the class of the largest share, the first among equals."""
    if not classes:
        return F.col("value")[0]
    return (F.array_position("value", F.array_max("value")) - 1).cast("double")


def classify(df: DataFrame, target: str, features: DataFrame, config: Config = Config()) -> Outcome:
    """Logistic regression against a random forest, by weighted F1; the baseline is the majority class."""
    known = df.where(F.col(target).isNotNull())
    classes = hold(class_distribution(df, target))  # fewer labels than the class ceiling
    seen = classes.agg(F.sum("n").alias("n"), F.max("share").alias("majority"), F.min("n").alias("rarest"), F.count("*").alias("classes")).first()
    if (seen["n"] or 0) < config.min_rows:
        return Outcome(CLASSIFICATION, "escalated", f"{seen['n'] or 0} rows, needs {config.min_rows}", classes=classes, features=features)
    if seen["majority"] > config.majority_share:
        return Outcome(CLASSIFICATION, "escalated", f"one class holds {seen['majority']:.0%} of the rows", classes=classes, features=features)
    if seen["classes"] > config.class_ceiling:
        return Outcome(CLASSIFICATION, "escalated", f"{seen['classes']} classes, more than {config.class_ceiling}", classes=classes, features=features)
    enc = encoding(df, features)
    k = max(2, min(config.splits, seen["rarest"]))
    named = typed(known.withColumn("__target", F.col(target).cast("string")), enc, "__target")
    # numbered by size; the table of classes has at most the ceiling's rows
    order_of = {r["label"]: float(i) for i, r in enumerate(classes.orderBy(F.desc("n"), "label").collect())}
    label = F.create_map(*[F.lit(x) for pair in order_of.items() for x in pair])[F.col("__target")]
    e = encode(with_folds(named.withColumn("label", label).drop("__target"), k, config.seed, "label"), enc, k, len(order_of))
    scores = _cross_validate(e, MulticlassClassificationEvaluator(metricName="f1"), F.mode("label", True), config)
    return _finish(CLASSIFICATION, "f1", scores, e, "majority_class", features, classes, config)


def regress(df: DataFrame, target: str, features: DataFrame, config: Config = Config()) -> Outcome:
    """Linear regression against a random forest, by RMSE; the baseline is the mean."""
    known = df.where(F.col(target).isNotNull())
    n = known.count()
    if n < config.min_rows:
        return Outcome(REGRESSION, "escalated", f"{n} rows, needs {config.min_rows}", features=features)
    enc = encoding(df, features)
    k = max(2, min(config.splits, n - 1))
    named = typed(known.withColumn("__target", F.col(target).cast("double")), enc, "__target").withColumnRenamed("__target", "label")
    e = encode(with_folds(named, k, config.seed), enc, k)
    scores = _cross_validate(e, RegressionEvaluator(metricName="rmse"), F.avg("label"), config)
    return _finish(REGRESSION, "rmse", scores, e, "mean", features, None, config)


def _finish(task, metric, scores, e: Encoded, baseline_name, features, classes, config) -> Outcome:
    spark = e.rows.sparkSession
    table = rows(
        spark,
        [(name if name != "baseline" else baseline_name, "baseline" if name == "baseline" else "candidate", metric, sum(s) / len(s)) for name, s in scores.items()],
        SCORES,
    )
    verdict = gate(table, metric, config).first()
    # the winner's weights come from a last fit on all rows
    everything = e.folds
    if verdict["winner"] == "random_forest":
        _, gains = forest(tree_rows(e, [everything]), [everything], _families(e, config)[2])
        weights = {r["feature"]: r["importance"] for r in gains.collect()}  # one row a feature
        widths = [(c, 1) for c in e.enc.numeric] + [(c, e.sides) for c in e.enc.labels]
        weights = [weights.get(i, 0.0) for i in range(sum(w for _, w in widths))]
    else:
        train, _, widths = one_hot(e, everything)
        weights = _linear_weights(_families(e, config)[1](sum(w for _, w in widths) > WIDE).fit(settle(train)))
    return Outcome(
        task, verdict["decision"], verdict["reason"], table, verdict["winner"], features, _associations(spark, weights, widths), classes,
        notes={"score": verdict["score"], "best_baseline": verdict["best_baseline"]},
    )


# -- forecasting -------------------------------------------------------------------------------------

def chained(series: DataFrame, n: int, k: int) -> DataFrame:
    """(fold, t, value, train, start): each fold with its training past and its test window."""
    folds = rows(series.sparkSession, [(i, a, b) for i, (a, b) in enumerate(forward_folds(n, k))], "fold int, start int, end int")
    return series.join(folds, F.col("t") < F.col("end")).withColumn("train", F.col("t") < F.col("start"))


def _fits(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group of ``by``: straight line, AR(1) on differences, last value and last difference - all plain aggregates."""
    step = Window.partitionBy(*by).orderBy("t")
    moved = frame.where("train").withColumn("d", F.col("value") - F.lag("value").over(step)).withColumn("d1", F.lag("d").over(step))
    return moved.groupBy(*by).agg(
        F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("intercept"),
        F.coalesce(F.regr_slope("d", "d1"), F.lit(0.0)).alias("phi"), F.coalesce(F.regr_intercept("d", "d1"), F.avg("d"), F.lit(0.0)).alias("drift"),
        F.max_by("value", "t").alias("last"), F.max_by("d", "t").alias("last_d"), F.max("t").alias("last_t"), F.count("*").alias("n_train"),
    ).withColumn("phi", F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("phi"))))


def _season_effects(frame: DataFrame, fits: DataFrame, by: Sequence[str], season: int) -> DataFrame:
    """Mean residual of the line per place in the season; only with two full seasons to average."""
    line = F.col("intercept") + F.col("slope") * F.col("t")
    return (
        frame.where("train").join(fits, list(by)).where(F.col("n_train") >= 2 * season)
        .groupBy(*by, (F.col("t") % season).alias("place")).agg(F.avg(F.col("value") - line).alias("effect"))
    )


def predictions(frame: DataFrame, by: Sequence[str], season: int) -> DataFrame:
    """For each row after the training past: both candidates, and the naive baselines."""
    fits = _fits(frame, by)
    effects = _season_effects(frame, fits, by, season)
    tail = frame.where("train").join(fits.select(*by, "last_t", "n_train"), list(by)).where(
        (F.col("t") > F.col("last_t") - season) & (F.col("n_train") >= season)
    ).select(*by, ((F.col("t") - F.col("last_t") + season - 1) % season).alias("slot"), F.col("value").alias("seasonal_naive"))
    ahead = F.col("t") - F.col("last_t")
    power = F.pow(F.col("phi"), ahead)
    geometric = F.col("phi") * (1 - power) / (1 - F.col("phi"))
    mean_step = F.col("drift") / (1 - F.col("phi"))
    differenced = F.col("last") + mean_step * ahead + (F.coalesce("last_d", F.lit(0.0)) - mean_step) * geometric
    tests = (
        frame.where("not train").join(fits, list(by)).withColumn("place", F.col("t") % season).withColumn("slot", (ahead - 1) % season)
        .join(effects, [*by, "place"], "left").join(tail, [*by, "slot"], "left")
    )
    return tests.select(
        *by, "t", "value", (F.col("intercept") + F.col("slope") * F.col("t") + F.coalesce("effect", F.lit(0.0))).alias("trend_seasonal"),
        differenced.alias("differenced_ar1"), F.col("last").alias("naive"), "seasonal_naive", ahead.alias("ahead"),
    )


def one_step(series: DataFrame, season: int) -> DataFrame:
    """(t, value) and both candidates' forecasts of each period from all periods before it.

    Every fit follows from running sums, over the whole past and over the past of the same place in the season, so a period is read once however
    many fits it takes part in. The series has a row a period.
    """
    along = Window.orderBy("t")
    past, own_past = along.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("place").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    t, v = F.col("t").cast("double"), F.col("value")
    steps = series.select("t", "value", (F.col("t") % season).alias("place"), (v - F.lag("value").over(along)).alias("d")).withColumn("d1", F.lag("d").over(along))
    d = F.when(F.col("d1").isNotNull(), F.col("d"))
    total = lambda c: F.sum(c).over(past)
    summed = steps.select(
        "t", "value", "place", F.count("*").over(past).cast("double").alias("n"), total(t).alias("st"), total(v).alias("sv"), total(t * v).alias("stv"), total(t * t).alias("stt"),
        F.count("*").over(own_past).cast("double").alias("pn"), F.sum(t).over(own_past).alias("pst"), F.sum(v).over(own_past).alias("psv"),
        F.count(d).over(past).cast("double").alias("m"), total(d).alias("sd"), total("d1").alias("sd1"), total(d * F.col("d1")).alias("sdd"), total(F.col("d1") * F.col("d1")).alias("sd1d1"),
        F.avg("d").over(past).alias("mean_d"), F.lag("value").over(along).alias("last"), F.lag("d").over(along).alias("last_d"),
    )
    slope = F.try_divide(F.col("n") * F.col("stv") - F.col("st") * F.col("sv"), F.col("n") * F.col("stt") - F.col("st") * F.col("st"))
    phi = F.try_divide(F.col("m") * F.col("sdd") - F.col("sd") * F.col("sd1"), F.col("m") * F.col("sd1d1") - F.col("sd1") * F.col("sd1"))
    fitted = summed.withColumns({"slope": slope, "phi": phi}).withColumns({
        "intercept": (F.col("sv") - F.col("slope") * F.col("st")) / F.col("n"),
        "drift": F.coalesce(F.try_divide(F.col("sd") - F.col("phi") * F.col("sd1"), F.col("m")), F.col("mean_d"), F.lit(0.0)),
        "phi": F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.coalesce("phi", F.lit(0.0)))),
    })
    effect = F.when(F.col("n") >= 2 * season, F.try_divide(F.col("psv") - F.col("intercept") * F.col("pn") - F.col("slope") * F.col("pst"), F.col("pn")))
    mean_step = F.col("drift") / (1 - F.col("phi"))
    return fitted.select(
        "t", "value", (F.col("intercept") + F.col("slope") * t + F.coalesce(effect, F.lit(0.0))).alias("trend_seasonal"),
        (F.col("last") + mean_step + (F.coalesce("last_d", F.lit(0.0)) - mean_step) * F.col("phi")).alias("differenced_ar1"),
    )


FAMILIES, BASELINES = ("trend_seasonal", "differenced_ar1"), ("naive", "seasonal_naive")


def forecast_scores(series: DataFrame, n: int, frequency: str, config: Config = Config()) -> DataFrame:
    """Mean RMSE over forward-chained folds; a seasonal baseline needs one full season of training in a fold."""
    k = max(2, min(config.splits, n - 1))
    predicted = predictions(chained(series, n, k), ["fold"], SEASONS[frequency])
    names = [*FAMILIES, *BASELINES]
    per_fold = predicted.groupBy("fold").agg(*[F.sqrt(F.avg(F.pow(F.col(m) - F.col("value"), 2))).alias(m) for m in names])
    mean = per_fold.agg(*[F.avg(m).alias(m) for m in names]).unpivot([], names, "model", "score").where("score is not null")
    role = F.when(F.col("model").isin(*FAMILIES), "candidate").otherwise("baseline")
    return mean.select("model", role.alias("role"), F.lit("rmse").alias("metric"), "score")


def forecast_band(series: DataFrame, n: int, frequency: str, family: str, config: Config = Config()) -> DataFrame:
    """(t, period, value, lower, upper): the next periods with an 80 % band that widens with the horizon."""
    horizon = min(config.horizon, max(1, n // 2))
    season = SEASONS[frequency]
    last = series.agg(F.max("t").alias("t"), F.max("period").alias("p")).first()
    step = {"MS": lambda i: F.add_months(F.lit(last["p"]), i), "W": lambda i: F.date_add(F.lit(last["p"]), i * 7), "D": lambda i: F.date_add(F.lit(last["p"]), i)}[frequency]
    spark = series.sparkSession
    future = rows(spark, [(last["t"] + i, i) for i in range(1, horizon + 1)], "t int, i int")
    frame = series.select(F.lit(0).alias("g"), "t", "value", F.lit(True).alias("train")).unionByName(
        future.select(F.lit(0).alias("g"), "t", F.lit(None).cast("double").alias("value"), F.lit(False).alias("train"))
    )
    predicted = predictions(frame, ["g"], season).select("t", "ahead", F.col(family).alias("forecast"))
    # one-step errors over the second half of the series give the width of the band
    late = one_step(series, season).where(F.col("t") >= max(3, n // 2))
    error = late.agg(F.stddev_pop(F.col("value") - F.col(family))).first()[0] or 0.0
    width = F.lit(BAND_80 * error) * F.sqrt(F.col("ahead").cast("double"))
    dated = predicted.withColumn("period", step(F.col("ahead").cast("int")))
    return dated.select("t", "period", F.col("forecast").alias("value"), (F.col("forecast") - width).alias("lower"), (F.col("forecast") + width).alias("upper"))


def forecast(df: DataFrame, target: str, moment: str, config: Config = Config(), frequency: str | None = None) -> Outcome:
    frequency = frequency or series_frequency(df, moment, config)
    series = hold(time_series(df, moment, target, frequency))  # one row per period
    n = series.count()
    if n < config.min_periods:
        return Outcome(FORECAST, "escalated", f"{n} periods, needs {config.min_periods}")
    scores = hold(forecast_scores(series, n, frequency, config))
    verdict = gate(scores, "rmse", config).first()
    band = forecast_band(series, n, frequency, verdict["winner"], config)
    return Outcome(FORECAST, verdict["decision"], verdict["reason"], scores, verdict["winner"], forecast=band,
                   notes={"frequency": frequency, "score": verdict["score"], "best_baseline": verdict["best_baseline"]})


def predict(df: DataFrame, target: str, near_unique: Sequence[str] = (), config: Config = Config()) -> Outcome:
    """Choose the task, guard against leakage, train, score out of sample, and answer only above the gate."""
    task, moment = select_task(df, target, config)
    if task == UNSUPPORTED:
        return Outcome(task, "escalated", "the target's shape supports no model")
    if task == FORECAST:
        return forecast(df, target, moment, config)
    features = select_features(df, target, moment, near_unique, config)
    if not features.where("kept").take(1):
        return Outcome(task, "escalated", "no usable feature is left", features=features)
    return classify(df, target, features, config) if task == CLASSIFICATION else regress(df, target, features, config)
