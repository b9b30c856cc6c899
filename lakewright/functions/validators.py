"""Named rules for values of a column, and the guard for dynamic names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The accepted shape of each kind of value.
PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "ipv4": r"^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$",
    "digits": r"^[0-9]+$",
    "domain": r"^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*$",
    "url": r"^https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(:[0-9]+)?(/.*)?$",
    "connection": r"^postgresql://[^:]+:[^@]+@[^:]+:[0-9]+/[^/]+$",
    "memory": r"^[0-9]+[KMG]B?$",
    "username": r"^[a-zA-Z0-9_-]{3,32}$",
    "semver": r"^[0-9]+\.[0-9]+\.[0-9]+(-[a-zA-Z0-9.-]+)?(\+[a-zA-Z0-9.-]+)?$",
    "env_name": r"^[A-Z_][A-Z0-9_]*$",
    "database_name": r"^[a-zA-Z][a-zA-Z0-9_]{0,62}$",
}
IDENTIFIER = r"^[a-zA-Z_][a-zA-Z0-9_]*$"
IDENTIFIER_LENGTH = 63
COLUMN_TEXT = r"^[a-zA-Z0-9\s,()_]+$"
DANGEROUS = r"(drop|delete|update|insert|exec|execute|;|--|/\*|\*/|xp_|sp_)"


def _number_between(x: Column, low: int, high: int) -> Column:
    return x.rlike(PATTERNS["digits"]) & F.coalesce(x.try_cast("long").between(low, high), F.lit(False))


def rule(name: str, x: Column) -> Column:
    """True where the text follows the named rule; null counts as a violation."""
    special = {
        "port": lambda: _number_between(x, 1, 65535),
        "cpu_count": lambda: _number_between(x, 1, 1024),
        "domain": lambda: x.rlike(PATTERNS["domain"]) & (F.length(x) <= 253),
        "email": lambda: x.rlike(PATTERNS["email"]) & ~x.contains(".."),
        "password": lambda: (F.length(x) >= 8) & x.rlike("[A-Z]") & x.rlike("[a-z]") & x.rlike("[0-9]"),
        "json": lambda: F.try_parse_json(x).isNotNull(),
    }
    check = special[name]() if name in special else x.rlike(PATTERNS[name])
    return F.coalesce(check, F.lit(False))


def validate_columns(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows checked and rows violating each rule, ``rules`` mapping column to rule name, in one pass."""
    checks = [F.count_if(~rule(name, F.col(c).cast("string"))).alias(c) for c, name in rules.items()]
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *checks)
    entries = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("rule"), F.col(c).alias("bad"))
                        for c, name in rules.items()])
    return counted.select("_rows", F.explode(entries).alias("e")).select(
        "e.column_name", "e.rule", F.col("_rows").alias("checked"), F.col("e.bad").alias("violations"))


def violations(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.where(~rule(name, F.col(column).cast("string")))


def identifier_ok(x: Column) -> Column:
    return F.coalesce(x.rlike(IDENTIFIER) & (F.length(x) <= IDENTIFIER_LENGTH), F.lit(False))


def column_text_ok(x: Column) -> Column:
    return F.coalesce(x.rlike(COLUMN_TEXT) & ~F.lower(x).rlike(DANGEROUS), F.lit(False))


def identifier(name: str | None) -> str:
    """The name, or an error if it is not a plain identifier of at most 63 characters."""
    if not name or len(name) > IDENTIFIER_LENGTH or not re.fullmatch(IDENTIFIER, name):
        raise ValueError(f"not a valid identifier: {name!r}")
    return name


def column_definitions(text: str | None) -> str:
    """Column text with blanks normalized, or an error if it holds anything but names and types."""
    if not text or not re.fullmatch(COLUMN_TEXT, text) or re.search(DANGEROUS, text.lower()):
        raise ValueError(f"not a valid column definition: {text!r}")
    return re.sub(r"\s+", " ", text).strip()
