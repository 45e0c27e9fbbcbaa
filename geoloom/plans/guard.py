"""Read-only SQL: which statements may run, and which relations they read.

Spark parses the text and nothing runs here. The unresolved plan is only reachable through the session's
JVM object; that access stays in this module.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import SparkSession

MAX_LENGTH = 12_000
PLAN_NODES = {
    "Aggregate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin",
    "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "PipeOperator", "Pivot", "Project", "Sample", "Sort",
    "SubqueryAlias", "Union", "UnionLoop", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable",
    "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "UnresolvedWith",
    "Unpivot", "WithWindowDefinition",
}
TABLE_FUNCTIONS = {
    "range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack",
    "json_tuple",
}
#: Built-in functions that run other code or read files, the session or the host.
REFUSED_FUNCTIONS = {
    "current_catalog", "current_database", "current_path", "current_schema", "current_timezone", "current_user",
    "from_avro", "from_protobuf", "input_file_block_length", "input_file_block_start", "input_file_name", "java_method",
    "read_files", "reflect", "schema_of_avro", "session_user", "to_avro", "to_protobuf", "try_reflect", "user", "version",
}
#: The same as expressions.
REFUSED_EXPRESSIONS = {"CurrentCatalog", "CurrentDatabase", "CurrentSchema", "CurrentTimeZone", "CurrentUser"}
#: Names that stand for such a function where no column has them; columns are then named with their relation.
REFUSED_NAMES = {"current_catalog", "current_database", "current_schema", "current_user", "session_user", "user"}


class RefusedQuery(ValueError):
    """A statement the workspace does not run."""


@dataclass(frozen=True)
class GuardedQuery:
    """Accepted text without its trailing semicolon, and the relations it reads."""

    sql: str
    relations: tuple[str, ...]


def guard(spark: SparkSession, sql: str | None, known: Iterable[str]) -> GuardedQuery:
    """Accepts a single SELECT or WITH query over known relations, else raises :class:`RefusedQuery`."""
    text = re.sub(r";+\s*\Z", "", (sql or "").strip()).strip()
    if not text:
        raise RefusedQuery("There is no query text.")
    if len(text) > MAX_LENGTH:
        raise RefusedQuery(f"A query may have at most {MAX_LENGTH} characters.")
    if not re.match(r"(select|with)\b", text, re.IGNORECASE):
        raise RefusedQuery("Only SELECT and WITH queries run here.")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as error:  # the parser's own message names the position
        raise RefusedQuery(f"The query cannot be parsed: {_first_line(error)}") from error
    found = _Reading(spark, {name.lower(): name for name in known})
    _check(plan, frozenset(), found)
    return GuardedQuery(text, tuple(found.read))


class _Reading:
    """What a query may read, and what it reads."""

    def __init__(self, spark: SparkSession, known: dict[str, str]):
        self.known, self.read = known, {}
        self._registry = spark._jsparkSession.sessionState().functionRegistry()
        self._identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self._allowed: dict[str, bool] = {}

    def function(self, parts: list[str]) -> None:
        """Refuses all but Spark's own functions; a registered function is not one, whatever its name."""
        name = ".".join(parts).lower()
        if name not in self._allowed:
            info = None if len(parts) != 1 or name in REFUSED_FUNCTIONS else self._registry.lookupFunction(
                self._identifier.apply(name))
            self._allowed[name] = info is not None and info.isDefined() and info.get().getSource() == "built-in"
        if not self._allowed[name]:
            raise RefusedQuery(f"The function {name} is not available.")


def _first_line(error: Exception) -> str:
    message = getattr(error, "getMessage", lambda: None)() or str(error)
    return message.strip().splitlines()[0]


def _items(seq) -> Iterable:
    return (seq.apply(i) for i in range(seq.size()))


def _check(plan, local: frozenset[str], found: _Reading) -> None:
    """Walks a plan; ``local`` holds the names that earlier WITH entries define here."""
    kind = plan.getClass().getSimpleName().rstrip("$")
    if kind not in PLAN_NODES:
        raise RefusedQuery(f"Only reading queries run here, and this one needs {kind}.")
    if kind == "UnresolvedWith":
        inner = local
        for entry in _items(plan.cteRelations()):
            name = entry._1().lower()
            own = inner | {name} if plan.allowRecursion() else inner
            _check(entry._2(), own, found)
            inner = inner | {name}
        local = inner
    elif kind == "UnresolvedRelation":
        _check_relation(plan, local, found)
    elif kind == "SubqueryAlias" and plan.alias().lower() == "asof":
        raise RefusedQuery("ASOF is no join here but would be read as an alias; use the as-of join operator.")
    elif kind == "UnresolvedTableValuedFunction":
        name = ".".join(_items(plan.name())).lower()
        if name not in TABLE_FUNCTIONS:
            raise RefusedQuery(f"The table function {name} is not available.")
    for expression in _items(plan.expressions()):
        _check_expression(expression, local, found)
    for child in _items(plan.children()):
        _check(child, local, found)


def _check_relation(plan, local, found) -> None:
    parts = list(_items(plan.multipartIdentifier()))
    name = parts[-1].lower()
    if len(parts) != 1 or plan.isStreaming():
        raise RefusedQuery("Relations are named without a path, catalog or stream.")
    if name in local:
        return
    if name not in found.known:
        raise RefusedQuery(f"Unknown relation {parts[0]}; load external data through the dataset loader first.")
    found.read[found.known[name]] = None


def _check_expression(expression, local, found) -> None:
    kind = expression.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        found.function(list(_items(expression.nameParts())))
    elif kind == "UnresolvedGenerator":
        if expression.name().funcName().lower() not in TABLE_FUNCTIONS:
            raise RefusedQuery(f"The table function {expression.name().funcName()} is not available.")
    elif kind == "UnresolvedAttribute":
        parts = list(_items(expression.nameParts()))
        if len(parts) == 1 and parts[0].lower() in REFUSED_NAMES:
            raise RefusedQuery(f"{parts[0]} may name the session; name a column of that name with its relation.")
    elif "UnresolvedIdentifier" in kind or kind.rstrip("$") in REFUSED_EXPRESSIONS:
        raise RefusedQuery(f"Names are written out here, and this query needs {kind}.")
    plan = getattr(expression, "plan", None) if _holds_plan(expression) else None
    if plan is not None:
        _check(plan(), local, found)
    for child in _items(expression.children()):
        _check_expression(child, local, found)


def _holds_plan(expression) -> bool:
    cls = expression.getClass()
    while cls is not None:
        if cls.getSimpleName() in ("PlanExpression", "SubqueryExpression"):
            return True
        cls = cls.getSuperclass()
    return False
