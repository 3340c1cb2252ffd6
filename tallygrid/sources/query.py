"""One guarded SELECT with typed parameters and a row cap, on Spark tables or over JDBC."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from tallygrid.grid import Grid, grid
from tallygrid.sources.names import dedupe_names

# Row caps and accepted boolean spellings.
DEFAULT_MAX_ROWS = 10_000
HARD_MAX_ROWS = 100_000
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")

_INT64 = range(-(2**63), 2**63)
#: Logical plans a query can start with. Anything else is a command or changes data.
_QUERY_PLANS = frozenset(
    """Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset
    OneRowRelation PipeOperator Pivot Project Repartition RepartitionByExpression Sample Sort SubqueryAlias Tail
    Unpivot UnresolvedHaving UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases
    UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedHint UnresolvedWith UnresolvedWithCTERelations
    Union View Window WithWindowDefinition""".split()
)


@dataclass(frozen=True)
class Param:
    """``kind`` is ``text``, ``number``, ``boolean`` or ``null``."""

    name: str
    value: str = ""
    kind: str = "text"

    def typed(self):
        if self.kind == "null":
            return None
        if self.kind == "number":
            return _number(self)
        if self.kind == "boolean":
            word = self.value.strip().lower()
            if word in TRUE_WORDS or word in FALSE_WORDS:
                return int(word in TRUE_WORDS)
            raise ValueError(f"參數 {self.name} 不是有效布林值")
        if self.kind == "text":
            return self.value
        raise ValueError(f"unknown parameter kind {self.kind!r}")


def _number(param: Param) -> int | float:
    if re.fullmatch(r"[+-]?[0-9]+", param.value) and int(param.value) in _INT64:
        return int(param.value)
    try:
        # Python also reads 1_000 and surrounding blanks.
        if re.search(r"[\s_]", param.value):
            raise ValueError
        return float(param.value)
    except ValueError:
        raise ValueError(f"參數 {param.name} 不是有效數字") from None


def bind(params) -> dict:
    """Arguments for ``spark.sql``. Parameters without a name are skipped."""
    return {p.name.removeprefix(":"): p.typed() for p in params if p.name.strip()}


def check_select(spark: SparkSession, sql: str) -> None:
    """Refuse anything but a single query. Only parses; nothing is looked up or run."""
    if not sql.strip():
        raise ValueError("請輸入 SELECT 查詢")
    # Commands run as soon as spark.sql sees them, so the parsed plan is inspected first.
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as error:
        raise ValueError(f"SQL 語法無法解析：{error}") from error
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _QUERY_PLANS:
            raise ValueError("只允許 SELECT 查詢，不能執行新增、修改、刪除或 DDL")
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]


def clamp_rows(max_rows: int | None = None) -> int:
    """A row cap of at least 1 and at most 100 000, by default 10 000, for callers that want one."""
    return max(1, min(DEFAULT_MAX_ROWS if max_rows is None else max_rows, HARD_MAX_ROWS))


@dataclass(frozen=True)
class QueryResult:
    """``rows`` has at most ``cap`` rows if there is a cap; the query itself may have more."""

    rows: DataFrame
    probe: DataFrame
    cap: int | None
    label: str

    def truncated(self) -> bool:
        """Whether rows were cut off. Counts at most ``cap + 1`` rows."""
        return self.cap is not None and self.probe.count() > self.cap

    def row_count(self) -> int:
        return self.rows.count()

    def grid(self, order_by=()) -> Grid:
        """The rows as a grid with unique names. Give ``order_by`` for order-dependent profiles."""
        return grid(self.rows, order_by, names=dedupe_names(self.rows.columns))


def query(spark: SparkSession, sql: str, params=(), max_rows: int | None = None, label: str = "spark") -> QueryResult:
    """Run one SELECT over the session's tables and views; all its rows unless ``max_rows`` is given."""
    check_select(spark, sql)
    return _result(spark.sql(sql, args=bind(params)), max_rows, label)


def _result(rows: DataFrame, max_rows: int | None, label: str) -> QueryResult:
    if max_rows is None:
        return QueryResult(rows, rows, None, label)
    return QueryResult(rows.limit(max_rows), rows.limit(max_rows + 1), max_rows, label)


def jdbc_query(spark: SparkSession, url: str, sql: str, max_rows: int | None = None, **options) -> QueryResult:
    """Run one SELECT in an external database; the limit is pushed down to it.

    The database's driver and credentials are passed as reader options. JDBC reads take no
    named parameters.
    """
    check_select(spark, sql)
    result = spark.read.format("jdbc").options(url=url, query=sql, **options).load()
    return _result(result, max_rows, url)
