"""Aggregates over tables and columns named at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.functions.validators import identifier
from lakewright.operators.windows import match, top_per_key

# The aggregate functions that may be named at run time.
ALLOWED = ("count", "sum", "avg", "min", "max", "stddev", "variance")


def parallel_sum(df: DataFrame, column: str, where: str | None = None) -> DataFrame:
    """Sum of a column under an optional predicate; partial sums are taken on every partition."""
    rows = df.where(F.expr(where)) if where else df
    return rows.agg(F.sum(identifier(column)).alias("total"))


def optimized_agg(df: DataFrame, columns: list[str], function: str, where: str | None = None) -> DataFrame:
    """One allowed aggregate function over several columns in one pass."""
    if function.lower() not in ALLOWED:
        raise ValueError(f"aggregate function not allowed: {function}")
    rows = df.where(F.expr(where)) if where else df
    return rows.agg(*[F.expr(f"{function}(`{identifier(c)}`)").alias(f"{function.lower()}_{c}") for c in columns])


def duplicates(df: DataFrame, keys: list[str], member: str, samples: int = 3) -> DataFrame:
    """Keys found more than once, with their count and first members in order.

    Each salt keeps only its first members, so no key is gathered whole.
    """
    salts = 32
    parts = (df.withColumn("_salt", F.pmod(F.xxhash64(member), F.lit(salts)))
             .groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("n")))
    counts = parts.groupBy(*keys).agg(F.sum("n").alias("copies")).where("copies > 1")
    repeated = match(df.select(*keys, member), counts.select(*keys), keys, "left_semi")
    first = (top_per_key(repeated, keys, [F.col(member).asc()], samples)
             .groupBy(*keys).agg(F.sort_array(F.collect_list(member)).alias("first_members")))
    return match(counts, first, keys, "left")


def fanout_distinct(base: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Base rows with the number of child rows of each kind, each child counted before the join."""
    out = base
    for name, (child, foreign_key) in children.items():
        counts = child.groupBy(F.col(foreign_key).alias("_fk")).agg(F.count(F.lit(1)).alias("_n"))
        out = (out.join(counts, F.col(key) == F.col("_fk"), "left")
               .withColumn(name, F.coalesce("_n", F.lit(0))).drop("_fk", "_n"))
    return out
