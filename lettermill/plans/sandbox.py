"""Ad-hoc SQL over a few named views: one SELECT, known relations and functions only, and a bounded result."""

from __future__ import annotations

import re
import threading
import uuid
from dataclasses import dataclass

from py4j.java_gateway import is_instance_of
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS, MAX_COLUMNS, MAX_BYTES, MAX_PARAMS, SECONDS, CELL = 500, 32, 4000, 32, 20, 512  # fixed values

# The functions a statement may call.
FUNCTIONS = frozenset(
    """abs avg cast ceil coalesce count cume_dist date date_format datetime dense_rank first_value floor group_concat if ifnull iif
    instr julianday lag last_value lead length like listagg lower ltrim max min ntile nullif percent_rank printf rank replace round row_number
    rtrim strftime substr substring sum time to_date total trim unix_timestamp unixepoch upper""".split()
)


class Refused(ValueError):
    """A statement that the sandbox does not run."""


@dataclass
class Result:
    """frame: at most 500 rows, as they may be shown. fetch() runs it within the deadline."""

    frame: DataFrame
    columns: list[str]
    shown: DataFrame
    seconds: int

    def fetch(self) -> tuple[list, bool]:
        """The rows, and whether there were more than are shown."""
        return run_bounded(self.shown, self.seconds)


_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
_EXPRESSION = "org.apache.spark.sql.catalyst.expressions."
_ANALYSIS = "org.apache.spark.sql.catalyst.analysis."


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _walk(gateway, node, known: frozenset[str]) -> None:
    """Refuses what the parsed tree calls or reads beyond what is allowed. known: the relations in scope, among them the
    names of the WITH clauses around the node."""
    kind = node.getClass().getSimpleName()

    def is_a(name: str) -> bool:
        return is_instance_of(gateway, node, name)

    if is_a(_LOGICAL + "Command") or is_a(_LOGICAL + "ParsedStatement") or kind in ("ScriptTransformation", "Generate", "UnresolvedTableValuedFunction", "UnresolvedTableArgPlan") or "UnresolvedIdentifier" in kind:
        raise Refused(f"not allowed: {kind}")
    if kind == "UnresolvedFunction":
        name = ".".join(_items(node.nameParts())).lower()
        if name not in FUNCTIONS:
            raise Refused(f"function not allowed: {name}")
    if kind == "UnresolvedRelation":
        name = ".".join(_items(node.multipartIdentifier())).lower()
        if name not in known:
            raise Refused(f"unknown relation: {name}")
        return
    if kind == "UnresolvedWith":
        if node.allowRecursion():
            raise Refused("recursive")
        for each in _items(node.cteRelations()):
            _walk(gateway, each._2(), known)
            known = known | {each._1().lower()}
    if is_a(_EXPRESSION + "PlanExpression"):
        _walk(gateway, node.plan(), known)
    for child in _items(node.children()):
        _walk(gateway, child, known)
    if is_a("org.apache.spark.sql.catalyst.plans.QueryPlan"):
        for e in _items(node.expressions()):
            _walk(gateway, e, known)


def validate(spark: SparkSession, sql: str, relations: set[str]) -> str:
    """The statement without a trailing semicolon; Refused says why not. What counts is the tree that the parser makes of
    it, so quoting, comments and letter case hide nothing."""
    if len(sql.encode()) > MAX_BYTES:
        raise Refused(f"over {MAX_BYTES} bytes")
    statement = sql.strip().rstrip(";").rstrip()
    if not re.match(r"(?is)(select|with)\b", statement):
        raise Refused("not a SELECT")
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except PySparkException as e:
        raise Refused(f"cannot be parsed: {str(e).splitlines()[0]}") from e
    _walk(spark.sparkContext._gateway, tree, frozenset(r.lower() for r in relations))
    return statement


def run_select(spark: SparkSession, sql: str, views: dict[str, DataFrame], args: dict | None = None, *, seconds: int = SECONDS) -> Result:
    """The statement over views alone. The result has at most 500 rows, long texts are cut and binaries named; fetch()
    cancels what takes longer than seconds. The session's own views stay as they are: the given ones stand under names of
    their own until the statement is analysed, and the statement sees them through a WITH clause around it."""
    if len(args or {}) > MAX_PARAMS:
        raise Refused("too many parameters")
    statement = validate(spark, sql, set(views))
    names = {name: f"lettermill_{uuid.uuid4().hex}" for name in views}
    try:
        for name, df in views.items():
            df.createTempView(names[name])
        given = ", ".join(f"`{name}` AS (SELECT * FROM `{own}`)" for name, own in names.items())
        df = spark.sql(f"WITH {given} ({statement}\n)" if given else statement, args=args or {})
    finally:
        for own in names.values():
            spark.catalog.dropTempView(own)
    if len(df.columns) > MAX_COLUMNS:
        raise Refused("too many columns")
    shown = [F.lit("<binary>").alias(n) if t == "binary" else F.when(F.length(n) > CELL, F.concat(F.substring(n, 1, CELL), F.lit("…"))).otherwise(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes]
    out = df.select(*shown)
    return Result(out.limit(MAX_ROWS), df.columns, out, seconds)


def run_bounded(df: DataFrame, seconds: int = SECONDS) -> tuple[list, bool]:
    """Rows (at most 500) and whether there were more; the job is cancelled after seconds."""
    jobs, tag = df.sparkSession.sparkContext, f"sandbox-{uuid.uuid4().hex}"
    jobs.addJobTag(tag)
    timer = threading.Timer(seconds, lambda: jobs.cancelJobsWithTag(tag))
    timer.start()
    try:
        rows = df.limit(MAX_ROWS + 1).collect()
    finally:
        timer.cancel()
        jobs.removeJobTag(tag)
    return rows[:MAX_ROWS], len(rows) > MAX_ROWS
