"""Dialect-compatible conditional, null and ratio expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def decode(expr: Column, pairs: Sequence[tuple[Any, Any]], default: Any = None) -> Column:
    """First result whose value equals ``expr``; null equals null."""
    out = None
    for value, result in pairs:
        hit = expr.eqNullSafe(F.lit(value))
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def nvl(first: Column, second: Column) -> Column:
    return F.coalesce(first, second)


def nullifzero(x: Column) -> Column:
    return F.nullif(x, F.lit(0))


def zeroifnull(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def safe_div(x: Column, y: Column) -> Column:
    """Quotient, or null where the divisor is zero."""
    return F.try_divide(x, y)


def ratio_to_report(value: Column, over: WindowSpec) -> Column:
    """Share of a value in its window total; 0 where the total is 0.

    Meant for aggregated rows, as the window covers all rows of its partition.
    """
    total = F.sum(value).over(over)
    return F.when(total == 0, F.lit(0.0)).otherwise(value / F.nullif(total, F.lit(0.0)))


# The compatibility functions, their syntax and category.
FUNCTION_CATALOG = (
    ("ADD_DAYS", "ADD_DAYS(date, days)", "date"),
    ("ADD_MONTHS", "ADD_MONTHS(date, months)", "date"),
    ("ADD_YEARS", "ADD_YEARS(date, years)", "date"),
    ("DAYS_BETWEEN", "DAYS_BETWEEN(date1, date2)", "date"),
    ("SECONDS_BETWEEN", "SECONDS_BETWEEN(ts1, ts2)", "date"),
    ("MONTHS_BETWEEN", "MONTHS_BETWEEN(date1, date2)", "date"),
    ("DECODE", "DECODE(expr, val1, res1, val2, res2, ...)", "logic"),
    ("EDIT_DISTANCE", "EDIT_DISTANCE(str1, str2)", "string"),
    ("INSTR", "INSTR(str, substr[, start[, occurrence]])", "string"),
    ("NVL", "NVL(val1, val2)", "null"),
    ("NULLIFZERO", "NULLIFZERO(num)", "null"),
    ("ZEROIFNULL", "ZEROIFNULL(num)", "null"),
    ("RATIO_TO_REPORT", "RATIO_TO_REPORT(val) OVER (...)", "analytic"),
    ("ROUND", "ROUND(num, places)", "math"),
    ("DIV", "DIV(dividend, divisor)", "math"),
    ("MOD", "MOD(dividend, divisor)", "math"),
    ("HASH_SHA1", "HASH_SHA1(input)", "hash"),
    ("HASH_MD5", "HASH_MD5(input)", "hash"),
    ("TO_NUMBER", "TO_NUMBER(str, format)", "conversion"),
)


def function_catalog(spark):
    """The compatibility functions as a DataFrame ordered by category and name."""
    return spark.createDataFrame(
        FUNCTION_CATALOG, "function_name string, syntax string, category string").orderBy("category", "function_name")
