"""Free SQL over allowed tables only: one SELECT, known functions, a row limit, a time limit.

Two walls. Spark's own parser reads the text, and every plan and expression in its tree must be of a known kind; names are
resolved by scope, so that a name given by WITH stands for its query only where that can be seen. Then the text is analysed in a session of
its own, which has the allowed tables as views and no view of the caller's; every leaf of the analysed plan must be
one of those views, however it was written. Anything that either wall doesn't know is rejected.

The trees are read through the session's JVM, so this doesn't run on Spark Connect.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

MAX_ROWS, SECONDS = 500, 5.0
#: Fixed values.
FUNCTIONS = frozenset(
    "sum avg min max count round abs stddev stddev_samp stddev_pop var_samp var_pop corr percentile_cont percentile_disc rank dense_rank row_number ntile lag lead first_value last_value percent_rank cume_dist "
    "greatest least coalesce nullif lower upper trim btrim ltrim rtrim length substring substr concat concat_ws replace split_part left right cast to_char string_agg array_agg now date_trunc extract date_part make_date "
    "floor ceil ceiling power sqrt mod div exp ln log and or not if when listagg".split()
)
#: Operators that the parser reads as functions.
OPERATORS = frozenset(["between", "ilike", "like", "rlike"])
PLANS = frozenset(
    "Aggregate Distinct Except Filter GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Sort SubqueryAlias Union UnresolvedHaving UnresolvedInlineTable UnresolvedRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition".split()
)
EXPRESSIONS = frozenset(
    "Add Alias And AttributeReference Between BitwiseAnd BitwiseNot BitwiseOr BitwiseXor CaseWhen Cast Concat CurrentDate CurrentRow$ CurrentTimestamp Cube Divide EqualNullSafe EqualTo Exists Extract GreaterThan GreaterThanOrEqual GroupingSets ILike If "
    "In InSubquery IntegralDivide IsNotNull IsNull LateralSubquery LessThan LessThanOrEqual Like LikeAll LikeAny ListQuery Literal Multiply NamedExpression Not NotLikeAll NotLikeAny Or Overlay RLike Remainder Rollup ScalarSubquery SortOrder SpecifiedWindowFrame "
    "StringLocate StringTrim StringTrimLeft StringTrimRight Substring Subtract UnaryMinus UnaryPositive UnboundedFollowing$ UnboundedPreceding$ UnresolvedAlias UnresolvedAttribute UnresolvedExtractValue UnresolvedFunction UnresolvedOrdinal UnresolvedStar UnresolvedWindowExpression "
    "UnspecifiedFrame$ WindowExpression WindowSpecDefinition".split()
)
#: Leaves that hold no stored rows, and what an analysed plan must not ask of the session.
EMPTY_LEAVES = frozenset("OneRowRelation LocalRelation CTERelationRef".split())
SESSION = frozenset("CurrentUser CurrentDatabase CurrentCatalog SessionUser InputFileName InputFileBlockStart InputFileBlockLength CallMethodViaReflection ScalaUDF PythonUDF VariableReference".split())
OWN = "org.apache.spark.sql.catalyst."


class Rejected(ValueError):
    """The SQL can't be run; the message says why."""


class TooSlow(RuntimeError):
    """The query was ended, as it took more time than it may."""


@dataclass
class Guarded:
    sql: str
    tables: list[str]
    limit: int
    rewritten: bool


def _kind(node: JavaObject) -> str:
    return node.getClass().getName()


def _is(node: JavaObject, name: str) -> bool:
    return is_instance_of(SparkContext._gateway, node, name)


def _held(value: JavaObject) -> Iterator[JavaObject]:
    """What a tree's node, collection, option or tuple holds."""
    items = value.iterator() if _is(value, "scala.collection.Iterable") else value.productIterator() if _is(value, "scala.Product") else None
    while items is not None and items.hasNext():
        item = items.next()
        if isinstance(item, JavaObject):
            yield item


def _texts(seq: JavaObject) -> list[str]:
    return [seq.apply(i) for i in range(seq.length())]


class _Reader:
    """Reads a parsed tree: what it isn't allowed to hold raises, tables are gathered."""

    def __init__(self, known: frozenset[str], functions: frozenset[str]):
        self.known, self.functions, self.tables = known, functions, set()

    def relation(self, node: JavaObject, scope: frozenset[str]) -> None:
        name = _texts(node.multipartIdentifier())
        if len(name) > 1:
            raise Rejected(f"schema {name[0]!r} is not accessible")
        if node.isStreaming():
            raise Rejected("streams are not available")
        table = name[0].lower()
        if table in scope:
            return
        if table not in self.known:
            raise Rejected(f"table {name[0]!r} is not available; available: {', '.join(sorted(self.known))}")
        self.tables.add(table)

    def ctes(self, node: JavaObject, scope: frozenset[str]) -> None:
        """Each of WITH's queries sees those before it, and not itself; what follows sees all."""
        if node.allowRecursion():
            raise Rejected("WITH RECURSIVE is not available")
        relations = node.cteRelations()
        for i in range(relations.length()):
            entry = relations.apply(i)
            self.read(entry._2(), scope)
            scope |= {entry._1().lower()}
        self.read(node.child(), scope)

    def read(self, value: JavaObject, scope: frozenset[str] = frozenset()) -> None:
        if _is(value, OWN + "trees.TreeNode"):
            kind = _kind(value)
            name = kind.rpartition(".")[2]
            plan = _is(value, OWN + "plans.logical.LogicalPlan")
            if not kind.startswith(OWN) or name not in (PLANS if plan else EXPRESSIONS):
                raise Rejected(f"only SELECT is allowed, got {name}" if plan else f"{name} is not available")
            if name == "UnresolvedRelation":
                return self.relation(value, scope)
            if name == "UnresolvedWith":
                return self.ctes(value, scope)
            if name == "UnresolvedFunction":
                called = _texts(value.nameParts())
                if len(called) > 1 or called[0].lower() not in self.functions | OPERATORS:
                    raise Rejected(f"function {'.'.join(called)}() is not available")
        for item in _held(value):
            self.read(item, scope)


def _own_limit(plan: JavaObject) -> int | None:
    if _kind(plan).endswith(".GlobalLimit") and _kind(plan.limitExpr()).endswith(".Literal"):
        value = plan.limitExpr().value()
        return value if isinstance(value, int) else None
    return None


def guard(spark: SparkSession, sql: str, allowed: Iterable[str], functions: Iterable[str] = FUNCTIONS, max_rows: int = MAX_ROWS) -> Guarded:
    """The statement with its limit, if it may run; else Rejected."""
    text = (sql or "").strip().rstrip(";").strip()
    if not text:
        raise Rejected("empty query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Rejected(f"this is no single SQL statement: {str(e).strip().splitlines()[0][:200]}") from e
    reader = _Reader(frozenset(t.lower() for t in allowed), frozenset(functions))
    reader.read(plan)
    own = _own_limit(plan)
    limit = max_rows if own is None else min(own, max_rows)
    # on lines of its own, so that a comment at the end of the text ends there
    return Guarded(f"SELECT * FROM (\n{text}\n) LIMIT {limit}", sorted(reader.tables), limit, own != limit)


def _check_leaves(value: JavaObject, tables: frozenset[str]) -> None:
    """Every leaf of an analysed plan is a view of the guard's own, or holds no rows."""
    if _is(value, OWN + "trees.TreeNode"):
        name = _kind(value).rpartition(".")[2]
        if name == "View":
            if value.desc().identifier().table().lower() not in tables or not value.isTempView():
                raise Rejected(f"view {value.desc().identifier().table()!r} is not available")
            return
        if _is(value, OWN + "plans.logical.LeafNode") and name not in EMPTY_LEAVES:
            raise Rejected(f"{name} is not available")
        if name in SESSION:
            raise Rejected(f"{name} is not available")
    for item in _held(value):
        _check_leaves(item, tables)


def isolated(spark: SparkSession, tables: Mapping[str, DataFrame]) -> SparkSession:
    """A session with these tables as its only temporary views, and the caller's settings."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    bind = own._jvm.org.apache.spark.sql.classic.Dataset.ofRows
    for name, df in tables.items():
        bind(own._jsparkSession, df._jdf.queryExecution().analyzed()).createOrReplaceTempView(name)
    return own


def analysed(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], max_rows: int = MAX_ROWS) -> DataFrame:
    """The guarded query, analysed in a session of its own and not run yet."""
    guarded = guard(spark, sql, tables, max_rows=max_rows)
    by_name = {name.lower(): df for name, df in tables.items()}
    own = isolated(spark, {name: by_name[name] for name in guarded.tables})
    try:
        out = own.sql(guarded.sql)
    except PySparkException as e:
        raise Rejected(f"this can't be resolved: {str(e).strip().splitlines()[0][:200]}") from e
    _check_leaves(out._jdf.queryExecution().analyzed(), frozenset(guarded.tables))
    return out


def run(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame], max_rows: int = MAX_ROWS, seconds: float = SECONDS) -> DataFrame:
    """The guarded query's rows, max_rows at most, worked out by now; TooSlow if that takes more seconds."""
    out = analysed(spark, sql, tables, max_rows)
    context, group = spark.sparkContext, f"guarded-{uuid.uuid4().hex}"
    ended = threading.Event()

    def end() -> None:
        # jobs that start after a cancel are cancelled too
        while not ended.wait(0.2):
            late.set()
            context.cancelJobGroup(group)

    def wait() -> None:
        if not ended.wait(seconds):
            end()

    late, timer = threading.Event(), threading.Thread(target=wait, daemon=True)
    before = [(k, context.getLocalProperty(k)) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")]
    context.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer.start()
    try:
        rows = out.collect()
    except Exception as e:
        if late.is_set():
            raise TooSlow(f"the query was ended after {seconds:g} seconds") from e
        raise
    finally:
        ended.set()
        for key, value in before:
            context.setLocalProperty(key, value)
    return spark.createDataFrame(rows, out.schema)
