"""Safe repairs: only low-risk ones, only when re-validation proves them harmless."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.kinds import CATEGORICAL, columns_of, nan_to_null
from tidegauge.functions.text import fold, strip
from tidegauge.operators import validate
from tidegauge.operators.profile import Baseline, column_summary
from tidegauge.operators.validate import FAILED, NOT_APPLICABLE, PASSED, Arrival, Rules
from tidegauge.session import hold, rows, settle

RENAME, CAST, STRIP, CASE = "rename_column", "safe_type_cast", "strip_whitespace", "normalize_case"
ACTIONS = (RENAME, CAST, STRIP, CASE)
RENAME_PAIR = "missing_unexpected_column_pair"
# Fixed values
MAX_PROFILE_DISTANCE, DTYPE_PENALTY = 1.0, 10.0
CONFIDENCE_THRESHOLD = 0.8
REVEAL_DEPTH = 2


class FixRefused(ValueError):
    pass


# -- actions -----------------------------------------------------------------------------------------

def rename_column(df: DataFrame, current: str, target: str) -> DataFrame:
    if current not in df.columns:
        raise FixRefused(f"column '{current}' not present, cannot rename")
    return df.withColumnRenamed(current, target)


def safe_type_cast(df: DataFrame, column: str, target: str) -> DataFrame:
    """Cast only if every value survives it."""
    if column not in df.columns:
        raise FixRefused(f"column '{column}' not present, cannot cast")
    cast = F.col(column).try_cast(target)
    lost = df.agg(F.count_if(F.col(column).isNotNull() & cast.isNull())).first()[0]
    if lost:
        raise FixRefused(f"cast to {target} failed on {lost} non-null value(s)")
    return df.withColumn(column, cast)


def strip_whitespace(df: DataFrame, column: str) -> DataFrame:
    if column not in df.columns:
        raise FixRefused(f"column '{column}' not present")
    return df.withColumn(column, strip(F.col(column))) if dict(df.dtypes)[column] == "string" else df


def normalise_case(df: DataFrame, column: str, baseline: Baseline) -> DataFrame:
    """Spell each value as the baseline does, matching without case and outer white space."""
    if column not in df.columns:
        raise FixRefused(f"column '{column}' not present")
    known = baseline.top_values.where(F.col("column") == column).select("value", fold(F.col("value")).alias("k")).collect()  # at most ten
    if not known:
        raise FixRefused(f"no baseline values for '{column}'")
    spelling = F.create_map(*[F.lit(x) for r in known for x in (r["k"], r["value"])])
    return df.withColumn(column, F.coalesce(F.try_element_at(spelling, fold(F.col(column))), F.col(column)))


def apply_action(df: DataFrame, action: str, spec: dict[str, str], baseline: Baseline) -> DataFrame:
    if action == RENAME:
        return rename_column(df, spec["current_name"], spec["target_name"])
    if action == CAST:
        return safe_type_cast(df, spec["column"], spec["target_dtype"])
    if action == STRIP:
        return strip_whitespace(df, spec["column"])
    if action == CASE:
        return normalise_case(df, spec["column"], baseline)
    raise FixRefused(f"'{action}' is not an executable action")


def replay(df: DataFrame, chain: Sequence[dict], baseline: Baseline) -> DataFrame:
    """Apply committed fixes in order, as one lazy plan; a broken entry is an error."""
    for entry in chain:
        try:
            df = apply_action(df, entry["action"], entry["spec"], baseline)
        except FixRefused as refusal:
            raise ValueError(f"fix replay failed at {entry!r}: {refusal}") from refusal
    return df


def repaired_table(base: DataFrame, chain: Sequence[dict], baseline: Baseline) -> DataFrame:
    """The repaired table of a run, computed once for every later step."""
    return settle(replay(base, chain, baseline))


# -- which failures belong together ------------------------------------------------------------------

def rename_pairs(outcomes: DataFrame, baseline: Baseline, df: DataFrame, max_distance: float = MAX_PROFILE_DISTANCE) -> DataFrame:
    """(missing, unexpected, distance): every pair of a missing and a new column that look alike.

    Rows number missing x unexpected columns, a property of two schemas.
    """
    df = nan_to_null(df)
    missing = outcomes.where((F.col("status") == FAILED) & F.col("rule_id").contains(":missing_column:")).select(F.col("column").alias("missing"))
    fresh = outcomes.where((F.col("status") == FAILED) & F.col("rule_id").contains(":unexpected_column:")).select(F.col("column").alias("unexpected"))
    texts = [r["unexpected"] for r in fresh.collect() if r["unexpected"] in columns_of(df, CATEGORICAL)]
    now = column_summary(df).select(F.col("column").alias("unexpected"), F.col("dtype").alias("now_dtype"), F.col("null_rate").alias("now_nulls"))
    now = now.join(validate.cardinalities(df, texts).withColumnRenamed("column", "unexpected"), "unexpected", "left")
    before = baseline.columns.select(F.col("column").alias("missing"), "dtype", "null_rate", "cardinality")
    # a type difference alone exceeds the distance, so only columns of one type need to meet
    alike = F.col("dtype") == F.col("now_dtype") if max_distance < DTYPE_PENALTY else F.lit(True)
    pairs = missing.join(before, "missing").join(fresh.join(now, "unexpected"), alike)
    widest = F.greatest(F.col("cardinality"), F.col("now_cardinality"), F.lit(1))
    distance = (
        F.when(F.col("dtype") != F.col("now_dtype"), DTYPE_PENALTY).otherwise(0.0)
        + F.abs(F.col("null_rate") - F.col("now_nulls"))
        + F.coalesce(F.abs(F.col("cardinality") - F.col("now_cardinality")) / widest, F.lit(0.0))
    )
    return pairs.select("missing", "unexpected", distance.alias("distance")).where(F.col("distance") <= max_distance)


GROUP = "group_id int, correlation_rule string, rule_id string, column string, detail map<string,string>"


def correlate(outcomes: DataFrame, baseline: Baseline, df: DataFrame) -> DataFrame:
    """Failed rules in groups: likely renames as pairs (closest first, each column once), others alone."""
    failed = hold(validate.failures(outcomes))
    taken: dict[str, int] = {}
    pairs = rename_pairs(failed, baseline, df).orderBy("distance", "missing", "unexpected").collect()
    used: set[tuple[str, str]] = set()
    chosen = []
    for p in pairs:
        if ("m", p["missing"]) not in used and ("u", p["unexpected"]) not in used:
            used |= {("m", p["missing"]), ("u", p["unexpected"])}
            chosen.append((p["missing"], p["unexpected"]))
    for i, (gone, new) in enumerate(chosen):
        taken[f"{validate.SCHEMA}:missing_column:{gone}"] = i
        taken[f"{validate.SCHEMA}:unexpected_column:{new}"] = i
    grouped, position = [], len(chosen)
    for r in failed.orderBy("rule_id").collect():  # one row per failed rule
        group = taken.get(r["rule_id"])
        if group is None:
            group, position = position, position + 1
        grouped.append((group, RENAME_PAIR if r["rule_id"] in taken else None, r["rule_id"], r["column"], r["detail"]))
    return rows(df.sparkSession, grouped, GROUP)


# -- which fixes may be applied ----------------------------------------------------------------------

def gate(groups: DataFrame, proposals: DataFrame, threshold: float = CONFIDENCE_THRESHOLD) -> DataFrame:
    """(group_id, action, decision, reasons): may the proposed action run unattended?

    ``proposals``: group_id, action, risk_level, confidence. Permitted: a rename for a rename pair, a cast
    for a type change, white space or case for categorical drift; low risk; confidence above the threshold.
    """
    shape = groups.groupBy("group_id").agg(
        F.max("correlation_rule").alias("pair"), F.count("*").alias("members"), F.min("rule_id").alias("rule")
    )
    alone = F.col("members") == 1
    permitted = (
        F.when(F.col("pair") == RENAME_PAIR, F.array(F.lit(RENAME)))
        .when(alone & F.col("rule").contains(":dtype_mismatch:"), F.array(F.lit(CAST)))
        .when(alone & F.col("rule").startswith(validate.CATEGORY), F.array(F.lit(STRIP), F.lit(CASE)))
        .otherwise(F.array().cast("array<string>"))
    )
    known = F.col("action").isin(*ACTIONS)
    joined = shape.join(proposals, "group_id", "left").withColumn("permitted", permitted)
    reasons = F.when(F.col("action").isNull(), F.array(F.lit("no valid proposal"))).otherwise(F.array_compact(F.array(
        F.when(~known, F.lit("not a recognised action")),
        F.when(known & ~F.array_contains("permitted", F.col("action")), F.lit("action not permitted for this rule")),
        F.when(F.coalesce(F.col("risk_level") != "low", F.lit(True)), F.lit("risk is not low")),
        F.when(F.coalesce(F.col("confidence") <= threshold, F.lit(True)), F.lit("confidence does not exceed the threshold")),
    )))
    return joined.withColumn("reasons", reasons).select(
        "group_id", "action", F.when(F.size("reasons") == 0, "auto_apply").otherwise("escalate").alias("decision"), "reasons"
    )


def fix_spec(members: list, action: str) -> dict[str, str]:
    """The arguments of an action, read off the failed rules it answers."""
    if action == RENAME:
        gone = next(m for m in members if ":missing_column:" in m["rule_id"])
        new = next(m for m in members if ":unexpected_column:" in m["rule_id"])
        return {"current_name": new["column"], "target_name": gone["column"]}
    if action == CAST:
        return {"column": members[0]["column"], "target_dtype": members[0]["detail"]["expected_dtype"]}
    return {"column": members[0]["column"]}


# -- apply, verify, revert ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Repair:
    verified: bool
    data: DataFrame
    unresolved: list[str] = field(default_factory=list)
    regressed: list[str] = field(default_factory=list)
    revealed: DataFrame | None = None
    error: str | None = None
    outcomes: DataFrame | None = None  # of ``data``


def attempt(
    df: DataFrame, targeted: Sequence[str], action: str, spec: dict[str, str], baseline: Baseline,
    rules: Rules = Rules(), arrival: Arrival = Arrival(), before: DataFrame | None = None,
) -> Repair:
    """Apply a fix and keep it only if its own rules no longer fail and no passing rule starts to.

    A rule that could not be evaluated before and fails now was revealed, not caused; it is kept apart.
    Reverting is keeping the old DataFrame: nothing was changed in place.
    """
    before = before if before is not None else validate.evaluate(df, baseline, rules, arrival)
    try:
        fixed = apply_action(df, action, spec, baseline)
    except FixRefused as refusal:
        return Repair(False, df, error=str(refusal), outcomes=before)
    after = validate.evaluate(fixed, baseline, rules, arrival)
    was = before.select("rule_id", F.col("status").alias("was"))
    failing = hold(after.where(F.col("status") == FAILED).join(was, "rule_id", "left").withColumn("was", F.coalesce("was", F.lit(NOT_APPLICABLE))))
    own = F.col("rule_id").isin(*targeted)
    unresolved = sorted(r["rule_id"] for r in failing.where(own).collect())
    regressed = sorted(r["rule_id"] for r in failing.where(~own & (F.col("was") == PASSED)).collect())
    if unresolved or regressed:
        return Repair(False, df, unresolved, regressed, error="the fix did not hold", outcomes=before)
    return Repair(True, fixed, revealed=failing.where(~own & (F.col("was") == NOT_APPLICABLE)).drop("was"), outcomes=after)


@dataclass
class ChainResult:
    data: DataFrame
    chain: list[dict]
    escalated: list[str]
    depth: int


def repair_all(
    df: DataFrame, baseline: Baseline, propose, rules: Rules = Rules(), arrival: Arrival = Arrival(),
    threshold: float = CONFIDENCE_THRESHOLD, depth_cap: int = REVEAL_DEPTH,
) -> ChainResult:
    """Fix what may be fixed, then what those fixes reveal, down to ``depth_cap`` levels.

    ``propose(groups)`` returns proposals for the gate. One level of groups at a time; each verified fix is
    one re-validation of the table.
    """
    outcomes = validate.evaluate(df, baseline, rules, arrival)
    groups = correlate(outcomes, baseline, df)
    result = ChainResult(df, [], [], 0)
    for depth in range(depth_cap + 1):
        result.depth = depth
        verdicts = {r["group_id"]: r for r in gate(groups, propose(groups), threshold).collect()}
        members: dict[int, list] = {}
        for r in groups.orderBy("group_id", "rule_id").collect():
            members.setdefault(r["group_id"], []).append(r)
        revealed = None
        for group_id in sorted(members):
            verdict, targeted = verdicts[group_id], [m["rule_id"] for m in members[group_id]]
            if verdict["decision"] != "auto_apply":
                result.escalated += targeted
                continue
            spec = fix_spec(members[group_id], verdict["action"])
            repair = attempt(result.data, targeted, verdict["action"], spec, baseline, rules, arrival, outcomes)
            if not repair.verified:
                result.escalated += targeted
                continue
            result.data, outcomes = repair.data, repair.outcomes
            result.chain.append({"action": verdict["action"], "spec": spec})
            revealed = repair.revealed if revealed is None else revealed.unionByName(repair.revealed)
        if revealed is None or not revealed.take(1):
            break
        groups = hold(correlate(revealed.dropDuplicates(["rule_id"]), baseline, result.data))
        if depth == depth_cap:
            result.escalated += [r["rule_id"] for r in groups.collect()]
    return result


