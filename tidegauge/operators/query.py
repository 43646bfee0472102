"""A user's SELECT over one registered table, capped and shaped."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import privacy
from tidegauge.session import settle

ROW_CAP = 10_000


class QueryRefused(ValueError):
    pass


@dataclass(frozen=True)
class Answer:
    rows: DataFrame  # at most cap rows
    columns: list[str]
    truncated: bool


#: What a query may be built of, by the names that Spark's parser gives its nodes. Anything else is refused: commands, files as tables, table functions,
#: names computed by IDENTIFIER, scripts.
QUERY_NODES = frozenset({
    "Project", "Filter", "Aggregate", "Join", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "Union", "Except",
    "Intersect", "UnresolvedHaving", "WithWindowDefinition", "Generate", "Pivot", "Unpivot", "UnresolvedWith", "LateralJoin", "UnresolvedInlineTable", "OneRowRelation", "LocalRelation",
    "UnresolvedRelation", "Sample", "ResolvedInlineTable", "UnionLoop", "AsOfJoin",
})
#: Built-in functions that leave the query: they call into the JVM or read or name what lies outside.
OUTSIDE_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "sql", "session_user", "current_user", "user"})
UNRESOLVED_NAMES = frozenset({"ExpressionWithUnresolvedIdentifier", "NamedParameter", "PosParameter", "UnresolvedTableValuedFunction"})


class _Walk:
    """Judges a parsed query: every relation is the view or a name that is in scope where it stands, every function a harmless built-in one."""

    def __init__(self, spark: SparkSession) -> None:
        self.functions = {r[0].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()}

    def plan(self, node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind not in QUERY_NODES:
            raise QueryRefused(f"only a query over the registered table is allowed, not {kind}")
        if kind == "UnresolvedWith":
            scope = self._defined(node, scope)
        elif kind == "UnresolvedRelation":
            parts = _each(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in scope:
                raise QueryRefused(f"references table(s) that are not registered: {['.'.join(parts)]}")
        for e in _each(node.expressions()):
            self.expression(e, scope)
        for child in _each(node.children()):
            self.plan(child, scope)

    def _defined(self, node, scope: frozenset[str]) -> frozenset[str]:
        """Names that the query after a WITH sees; each definition sees those before it (and itself where the WITH is recursive)."""
        for pair in _each(node.cteRelations()):
            own = frozenset({pair._1().lower()})
            self.plan(pair._2(), scope | own if node.allowRecursion() else scope)
            scope = scope | own
        return scope

    def expression(self, e, scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind in UNRESOLVED_NAMES:
            raise QueryRefused(f"calls that are not allowed: {kind}")
        if kind == "UnresolvedFunction":
            name = ".".join(_each(e.nameParts())).lower()
            if name not in self.functions or name in OUTSIDE_FUNCTIONS:
                raise QueryRefused(f"calls that are not allowed: {[name]}")
        if _is_plan_expression(e):
            self.plan(e.plan(), scope)
        for child in _each(e.children()):
            self.expression(child, scope)


def _each(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _is_plan_expression(e) -> bool:
    kind = e.getClass()
    while kind is not None:
        if kind.getSimpleName() == "PlanExpression":
            return True
        kind = kind.getSuperclass()
    return False


def confine(spark: SparkSession, view: str, sql: str) -> None:
    """Refuse a text that is not one query, or that names anything but ``view`` and what it defines itself."""
    try:
        parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Py4JJavaError as error:
        raise QueryRefused(str(error.java_exception.getMessage()).strip().splitlines()[0]) from error
    except (ParseException, AnalysisException) as error:
        raise QueryRefused(str(error).strip().splitlines()[0]) from error
    _Walk(spark).plan(parsed, frozenset({view.lower()}))


def ask(df: DataFrame, view: str, sql: str, cap: int = ROW_CAP) -> DataFrame:
    """At most ``cap + 1`` rows of one SELECT that sees ``df`` as ``view``.

    The text is parsed by Spark as it stands and judged node by node (``confine``); the very same text is then run as a subquery, its own LIMIT in force below
    ours. The table is known to it by a common table expression over a view of a private name, so no view of the caller's is replaced.
    """
    spark = df.sparkSession
    text = sql.strip().rstrip(";")
    confine(spark, view, text)
    private = f"asked_{uuid.uuid4().hex}"
    df.createOrReplaceTempView(private)
    try:
        return spark.sql(f"WITH `{view.replace('`', '``')}` AS (SELECT * FROM {private}) SELECT * FROM (\n{text}\n) LIMIT {int(cap) + 1}")
    except (ParseException, AnalysisException) as error:
        raise QueryRefused(str(error).strip().splitlines()[0]) from error
    finally:
        spark.catalog.dropTempView(private)


def answer(df: DataFrame, view: str, sql: str, cap: int = ROW_CAP) -> Answer:
    result = settle(ask(df, view, sql, cap))  # at most cap + 1 rows, computed once
    return Answer(result.limit(cap), result.columns, result.count() > cap)


def as_json(answered: Answer) -> DataFrame:
    """One JSON document per row, missing values written as null."""
    return answered.rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))


def sample_rows(df: DataFrame, key: str | None = None, k: int = 5, policy: str = privacy.STRICT) -> DataFrame:
    """The first rows (in key order when one is given), personal data masked."""
    verdict = privacy.classify(df)
    head = (df.orderBy(key) if key else df).limit(k)
    return privacy.mask(head, verdict, policy, key).data
