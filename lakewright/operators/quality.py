"""Data-quality checks compiled into as few passes over a table as possible."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Check:
    """A check that counts bad rows, or with ``mode='ratio'`` takes their share in percent.

    With a threshold it passes at or below it, without one it passes above 0.
    """

    name: str
    kind: str  # null, unique, range, regex, referential, custom
    columns: tuple[str, ...] = ()
    severity: str = "ERROR"
    threshold: float | None = 0.0
    mode: str = "count"
    low: object = None
    high: object = None
    pattern: str | None = None
    predicate: str | None = None  # custom: the condition of a bad row
    reference: DataFrame | None = None
    reference_column: str | None = None

    def bad(self) -> Column:
        column = F.col(self.columns[0]) if self.columns else None
        if self.kind == "null":
            return column.isNull()
        if self.kind == "range":
            return column.isNotNull() & ~column.between(self.low, self.high)
        if self.kind == "regex":
            return column.isNotNull() & ~column.rlike(self.pattern)
        if self.kind == "custom":
            return F.expr(self.predicate)
        raise ValueError(f"check kind {self.kind} is not a row condition")


ROW_KINDS = ("null", "range", "regex", "custom")


def repeated_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def orphans(df: DataFrame, column: str, reference: DataFrame, reference_column: str) -> DataFrame:
    """Rows whose value is set but missing from the reference."""
    known = reference.select(F.col(reference_column).alias("_known"))
    return df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_known"), "left_anti")


def bad_rows(df: DataFrame, check: Check) -> DataFrame:
    if check.kind == "unique":
        return repeated_keys(df, check.columns)
    if check.kind == "referential":
        return orphans(df, check.columns[0], check.reference, check.reference_column)
    return df.where(F.coalesce(check.bad(), F.lit(False)))


def error_sample(df: DataFrame, check: Check, n: int = 10) -> DataFrame:
    """Up to ``n`` failing rows as JSON."""
    return bad_rows(df, check).limit(n).select(F.lit(check.name).alias("check_name"), F.to_json(F.struct("*")).alias("record"))


def _count_rows(df: DataFrame, checks: Sequence[Check]) -> dict[str, int]:
    aggs = [F.count_if(c.bad()).alias(f"c{i}") for i, c in enumerate(checks)]
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *aggs).first()
    return {"_rows": row["_rows"], **{c.name: row[f"c{i}"] for i, c in enumerate(checks)}}


RESULT = T.StructType([
    T.StructField("check_name", T.StringType()), T.StructField("kind", T.StringType()),
    T.StructField("severity", T.StringType()), T.StructField("threshold", T.DoubleType()),
    T.StructField("value_checked", T.DoubleType()), T.StructField("passed", T.BooleanType()),
    T.StructField("error", T.StringType())])


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One result row per check. All row conditions are counted in a single pass.

    A check that cannot be evaluated fails with its error and does not stop the others.
    """
    counts: dict[str, int] = {}
    errors: dict[str, str] = {}
    row_checks = [c for c in checks if c.kind in ROW_KINDS]
    try:
        counts = _count_rows(df, row_checks)
    except Exception:  # noqa: BLE001 - find out which of them fails
        counts["_rows"] = df.count()
        for c in row_checks:
            try:
                counts[c.name] = _count_rows(df, [c])[c.name]
            except Exception as error:  # noqa: BLE001
                errors[c.name] = str(error).split("\n")[0]
    for c in checks:
        if c.kind not in ROW_KINDS:
            try:
                counts[c.name] = bad_rows(df, c).count()
            except Exception as error:  # noqa: BLE001
                errors[c.name] = str(error).split("\n")[0]
    rows = []
    for c in checks:
        if c.name in errors:
            rows.append((c.name, c.kind, c.severity, c.threshold, None, False, errors[c.name]))
            continue
        value = float(counts[c.name])
        if c.mode == "ratio":
            value = value * 100.0 / counts["_rows"] if counts["_rows"] else 0.0
        passed = value <= c.threshold if c.threshold is not None else value > 0
        rows.append((c.name, c.kind, c.severity, c.threshold, value, passed, None))
    return df.sparkSession.createDataFrame(rows, RESULT)


def score(results: DataFrame) -> DataFrame:
    """Totals of a run and its score: passed checks in percent."""
    return results.agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if("passed").alias("passed_checks"),
        F.count_if(~F.col("passed")).alias("failed_checks"),
        F.try_divide(F.count_if("passed") * F.lit(100.0), F.count(F.lit(1)).cast("double")).alias("quality_score"))


def source_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of several sources side by side."""
    counts = [df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("source"), "records")
              for name, df in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out
