"""Windowed aggregates that read the same in a batch and in a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _aggregates(value: str) -> list[Column]:
    return [F.count(value).alias("count_values"), F.sum(value).alias("sum_values"), F.avg(value).alias("avg_values"),
            F.min(value).alias("min_values"), F.max(value).alias("max_values")]


def _bounded(df: DataFrame, ts: str, watermark: str | None) -> DataFrame:
    """Late-data bound for a stream; event time must be a timestamp with the session's zone."""
    if not (watermark and df.isStreaming):
        return df
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)


def sliding(df: DataFrame, ts: str, value: str, size: str, slide: str | None = None, *, overlap: bool = True,
            as_of: Column | None = None, keys: tuple[str, ...] = (), watermark: str | None = None) -> DataFrame:
    """Count, sum, mean, minimum and maximum per window; the slide defaults to the size.

    With ``overlap`` a row falls into every window that covers it. Without, rows
    are bucketed by the slide and the window end is the start plus the size.
    With ``as_of`` only rows newer than twice the size count.
    """
    rows = _bounded(df, ts, watermark)
    if as_of is not None:
        rows = rows.where(F.col(ts) >= as_of - F.expr(f"2 * INTERVAL {size}"))
    bucket = F.window(ts, size, slide or size) if overlap else F.window(ts, slide or size)
    grouped = rows.groupBy(*keys, bucket.alias("w")).agg(*_aggregates(value))
    kind = df.schema[ts].dataType
    end = F.col("w.end") if overlap else F.col("w.start") + F.expr(f"INTERVAL {size}")
    return grouped.select(*keys, F.col("w.start").cast(kind).alias("window_start"), end.cast(kind).alias("window_end"),
                          "count_values", "sum_values", "avg_values", "min_values", "max_values")


def tumbling(df: DataFrame, ts: str, value: str, size: str, **options) -> DataFrame:
    return sliding(df, ts, value, size, **options)


def _per_column(columns: list[str]) -> list[Column]:
    out = []
    for c in columns:
        out += [F.sum(c).alias(f"sum_{c}"), F.avg(c).alias(f"avg_{c}"), F.count(c).alias(f"count_{c}")]
    return [*out, F.count(F.lit(1)).alias("total_rows")]


def real_time_aggregate(df: DataFrame, keys: list[str], columns: list[str], ts: str, window: str = "1 hour", *,
                        as_of: Column | None = None, watermark: str | None = "10 minutes") -> DataFrame:
    """Sum, mean and count per column and group.

    A batch covers the last window before ``as_of``; a stream gives every window.
    Rows later than the watermark are dropped; without one none are, which a run
    over a whole stored table needs, as its files come in any order.
    """
    if df.isStreaming:
        grouped = _bounded(df, ts, watermark).groupBy(*keys, F.window(ts, window).alias("w")).agg(*_per_column(columns))
        return grouped.withColumn("window_start", F.col("w.start").cast(df.schema[ts].dataType)).drop("w")
    recent = df.where((F.col(ts) >= as_of - F.expr(f"INTERVAL {window}")) & (F.col(ts) < as_of))
    return recent.groupBy(*keys).agg(*_per_column(columns))
