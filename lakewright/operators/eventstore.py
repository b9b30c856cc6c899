"""Append-only event store with gapless versions per aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.windows import match, numbered


def append(store: DataFrame, new: DataFrame, key: str, order: list[str], chunks: int | None = None) -> DataFrame:
    """New events with ``event_version`` continuing after the stored maximum of their aggregate.

    ``order`` must be unique within an aggregate.
    """
    top = store.groupBy(key).agg(F.max("event_version").alias("_top"))
    placed = numbered(new, [key], order, "event_version", chunks)
    return (match(placed, top, [key], "left")
            .withColumn("event_version", F.col("event_version") + F.coalesce("_top", F.lit(0))).drop("_top"))


def events_of(store: DataFrame, key: str, aggregate, from_version: int = 1) -> DataFrame:
    return store.where((F.col(key) == aggregate) & (F.col("event_version") >= from_version)).orderBy("event_version")


def version_check(store: DataFrame, key: str) -> DataFrame:
    """Per aggregate: events, greatest version, and whether versions are unique and gapless from 1."""
    # Counting per (aggregate, version) first keeps a large aggregate out of one task.
    cells = store.groupBy(key, "event_version").agg(F.count(F.lit(1)).alias("_n"))
    facts = cells.groupBy(key).agg(
        F.sum("_n").alias("events"), F.max("event_version").alias("last_version"),
        F.count(F.lit(1)).alias("_d"), F.min("event_version").alias("_lo"))
    ok = (F.col("events") == F.col("_d")) & (F.col("last_version") == F.col("_d")) & (F.col("_lo") == 1)
    return facts.select(key, "events", "last_version", ok.alias("gapless"))


def replay(store: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """State of every aggregate: its last version, and per field the last value that is not null.

    An aggregate that combines before the shuffle, so a long history is never sorted.
    """
    last = [F.max_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), F.col("event_version"))).alias(name)
            for name, value in fields.items()]
    return store.groupBy(key).agg(F.max("event_version").alias("version"), *last)
