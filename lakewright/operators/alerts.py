"""Alert rules over metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_for(samples: DataFrame, keys: list[str], ts: str, condition: Column, hold_seconds: float,
                  severity: str) -> DataFrame:
    """Spans in which the condition held without a break for at least ``hold_seconds``.

    Samples are metric readings, few per key and time step.
    """
    by_time = Window.partitionBy(*keys).orderBy(ts)
    flagged = samples.withColumn("_on", F.coalesce(condition, F.lit(False)))
    starts = (F.col("_on") != F.coalesce(F.lag("_on").over(by_time), ~F.col("_on"))).cast("int")
    runs = flagged.withColumn("_start", starts).withColumn("_run", F.sum("_start").over(by_time))
    spans = (runs.where("_on").groupBy(*keys, "_run")
             .agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("samples")))
    held = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / F.lit(1e6)
    return (spans.withColumn("held_seconds", held).where(F.col("held_seconds") >= hold_seconds)
            .withColumn("severity", F.lit(severity)).drop("_run"))


def counter_rate(samples: DataFrame, keys: list[str], ts: str, counter: str, bucket: Column, seconds: float) -> DataFrame:
    """Increase of a counter per second and bucket; a falling counter has restarted from 0."""
    by_time = Window.partitionBy(*keys).orderBy(ts)
    before = F.lag(counter).over(by_time)
    rise = (F.when(before.isNull(), F.lit(None)).when(F.col(counter) < before, F.col(counter))
            .otherwise(F.col(counter) - before))
    return (samples.withColumn("_rise", rise).withColumn("bucket", bucket).groupBy(*keys, "bucket")
            .agg((F.coalesce(F.sum("_rise"), F.lit(0.0)) / seconds).alias("rate")))
