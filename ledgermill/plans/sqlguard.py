"""Guarded read-only SQL: one SELECT over two relations, checked on the parsed tree, run in a session that holds no more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RELATIONS = frozenset(("metrics", "facts_visible"))
REQUIRED = "facts_visible"
LIMIT = 100
#: Plan nodes and functions that a question may need; whatever else the parser makes is refused.
NODES = frozenset("Project Filter Aggregate UnresolvedRelation SubqueryAlias Join Sort GlobalLimit LocalLimit UnresolvedHaving Distinct UnresolvedSubqueryColumnAliases Union Offset WithWindowDefinition".split())
FUNCTIONS = frozenset(
    "sum avg mean min max count median stddev variance round floor ceil ceiling abs sign power sqrt exp ln log coalesce nullif ifnull nvl if greatest least "
    "year month quarter day dayofmonth date_trunc trunc extract date_part datediff date_add date_sub add_months last_day make_date to_date date_format current_date "
    "lower upper trim ltrim rtrim length substring substr left right concat concat_ws replace split_part like contains startswith endswith position locate "
    "row_number rank dense_rank lag lead first_value last_value ntile percent_rank min_by max_by first last "
    "and or not + - * / % = <=> <> != < <= > >= in between when case isnull isnotnull".split()
)


class Refused(ValueError):
    pass


def _simple(node) -> str:
    return node.getClass().getSimpleName()


def _seq(items):
    return (items.apply(i) for i in range(items.size()))


def _inspect(plan, found: set[str]) -> None:
    kind = _simple(plan)
    if kind not in NODES:
        raise Refused(f"{kind} is not allowed")
    if kind == "UnresolvedRelation":
        parts = [str(p).lower() for p in _seq(plan.multipartIdentifier())]
        if len(parts) != 1 or parts[0] not in RELATIONS:
            raise Refused(f"{'.'.join(parts)} is not among the relations")
        found.add(parts[0])
    for child in _seq(plan.children()):
        _inspect(child, found)
    for e in _seq(plan.expressions()):
        _expression(e, found)


def _expression(e, found: set[str]) -> None:
    kind = _simple(e)
    if kind == "UnresolvedFunction":
        name = ".".join(str(p) for p in _seq(e.nameParts())).lower()
        if name not in FUNCTIONS:
            raise Refused(f"function {name} is not allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery") and hasattr(e, "plan"):
        if kind == "InSubquery":
            _inspect(e.query().plan(), found)
        else:
            _inspect(e.plan(), found)
    for child in _seq(e.children()):
        _expression(child, found)


def check(spark: SparkSession, text: str) -> None:
    """Raise unless the text is one SELECT over the allowed relations with allowed functions."""
    sql = text.strip()
    if not sql.lower().startswith("select") or ";" in sql:
        raise Refused("one SELECT without semicolons is allowed")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused("the text does not parse") from e
    found: set[str] = set()
    _inspect(plan, found)
    if REQUIRED not in found:
        raise Refused(f"{REQUIRED} is not read")


def is_safe(spark: SparkSession, text: str) -> bool:
    try:
        check(spark, text)
    except Refused:
        return False
    return True


def run(spark: SparkSession, text: str, facts_visible: DataFrame, metrics: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows of a checked query, at most ``limit``.

    The reader's rows are bound by ``facts_visible``.  The query runs in a new session whose only views are the two
    relations, where files can't be named as tables.
    """
    check(spark, text)
    inner = spark.newSession()
    inner.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in (("facts_visible", facts_visible), ("metrics", metrics)):
        _register(inner, df, name)
    return inner.sql(text.strip()).limit(limit)


def _register(session: SparkSession, df: DataFrame, name: str) -> None:
    """The plan of ``df`` as a view of another session of the same context."""
    jdf = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df._jdf.queryExecution().logical())
    jdf.createOrReplaceTempView(name)
