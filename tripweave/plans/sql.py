"""Guarded ad-hoc SQL over the derived points.

The dialect is Spark's. Views: ``commute_data`` (points), ``commutes`` and ``segments``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tripweave.operators.analytics import commutes, segments

# Words that change data or reach outside the views.
BLOCKED = (
    "COPY", "EXPORT", "IMPORT", "INSTALL", "LOAD", "ATTACH", "CREATE", "DROP", "ALTER", "INSERT", "UPDATE",
    "DELETE", "PRAGMA",
)
# Spark's own ways out of a SELECT: JVM calls, child processes, files as tables.
_ESCAPES = {
    "JVM call": r"\b(java_method|reflect|try_reflect)\s*\(",
    "script": r"\busing\s*'",
    "file relation": r"\b(parquet|json|csv|orc|text|avro|delta|binaryfile|jdbc|read_files)\s*[.(]\s*`",
}


VIEWS = ("commute_data", "commutes", "segments")
#: Table functions that read nothing.
TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "inline", "stack")


def check_query(sql: str) -> str:
    """The query, or ValueError: it must be one SELECT without blocked whole words."""
    # string contents and comments can hold any word
    bare = re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", sql)
    bare = re.sub(r"\"(?:[^\"\\]|\\.)*\"", '""', bare)
    bare = re.sub(r"--[^\n]*|/\*.*?\*/", " ", bare, flags=re.S)
    if not re.match(r"\s*select\b", bare, flags=re.I):
        raise ValueError("a query must be one SELECT")
    for word in BLOCKED:
        if re.search(rf"\b{word}\b", bare, flags=re.I):
            raise ValueError(f"{word} is not allowed in a query")
    for what, pattern in _ESCAPES.items():
        if re.search(pattern, bare, flags=re.I):
            raise ValueError(f"a query may not use a {what}")
    return sql


def register_views(pts: DataFrame) -> None:
    pts.createOrReplaceTempView("commute_data")
    commutes(pts).createOrReplaceTempView("commutes")
    segments(pts).createOrReplaceTempView("segments")


def check_relations(spark: SparkSession, sql: str) -> None:
    """ValueError unless all relations that Spark's own parser finds are the views or the query's own common tables."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()
    # a common table must not share its name with a table that the rest of the query could then reach
    common = {c.strip().lower() for names in re.findall(r"CTE \[([^\]]*)\]", plan) for c in names.split(",")}
    if hidden := sorted(c for c in common - set(VIEWS) if spark.catalog.tableExists(c)):
        raise ValueError(f"common table {hidden[0]} has the name of a table")
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]?", plan):
        if name.strip().lower() not in common | set(VIEWS):
            raise ValueError(f"{name} is none of the views {', '.join(VIEWS)}")
    # named at run time, read from outside, or run outside
    for what in ("UnresolvedIdentifier", "ScriptTransformation", "Streaming"):
        if what in plan:
            raise ValueError(f"a query may not use {what}")
    for name in re.findall(r"UnresolvedTableValuedFunction \[?([\w.]*)", plan):
        if name.lower() not in TABLE_FUNCTIONS:
            raise ValueError(f"table function {name} is not allowed in a query")
    # by name anywhere in the text, since a long column list is shortened in the plan's text
    if found := re.search(r"\b(java_method|reflect|try_reflect)\b", sql, re.I):
        raise ValueError(f"{found[0]} is not allowed in a query")


def query(spark: SparkSession, sql: str, args: dict | list | None = None) -> DataFrame:
    """Run a checked SELECT; values are bound as ``:name`` or ``?`` parameters, never pasted. Files are never relations."""
    check_query(sql)
    check_relations(spark, sql)
    before = spark.conf.get("spark.sql.runSQLOnFiles")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        return spark.sql(sql, args=args) if args else spark.sql(sql)
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", before)
