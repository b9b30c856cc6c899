"""Materialized results, their refresh schedule and incremental upkeep."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakewright.functions.validators import identifier
from lakewright.operators import cdc
from lakewright.operators.windows import match
from lakewright.sources.keyed import GONE, KeyedTable
from lakewright.sources.versioned import VersionedTable, upsert

log = logging.getLogger(__name__)

SCHEDULE = ("view_name string, interval_seconds long, last_refresh timestamp_ntz, next_refresh timestamp_ntz, "
            "is_active boolean, refresh_mode string")


def create(df: DataFrame, table: VersionedTable, view: str, with_data: bool = True) -> DataFrame:
    """Store a result and show it under a view name; without data only the schema is kept."""
    table.replace(df if with_data else df.limit(0))
    stored = table.read()
    stored.createOrReplaceTempView(identifier(view))
    return stored


def _later(ts: Column, seconds: Column) -> Column:
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def schedule_refresh(schedule: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Schedule with the requested views (view_name, interval_seconds, refresh_mode) added or changed."""
    known = schedule.select("view_name", F.col("last_refresh").alias("_last"), F.col("is_active").alias("_active"))
    rows = match(requests, known, ["view_name"], "left").select(
        "view_name", F.col("interval_seconds").cast("long").alias("interval_seconds"), F.col("_last").alias("last_refresh"),
        _later(as_of, F.col("interval_seconds")).cast("timestamp_ntz").alias("next_refresh"),
        F.coalesce("_active", F.lit(True)).alias("is_active"), "refresh_mode")
    return upsert(schedule, rows, ["view_name"])


def process_refreshes(schedule: DataFrame, as_of: Column, builders: dict[str, Callable[[], DataFrame]],
                      tables: dict[str, VersionedTable | TotalsView],
                      changes: dict[str, Callable[[], DataFrame]] | None = None) -> tuple[DataFrame, int]:
    """Bring the due views up to date; a view that fails keeps its schedule. Returns (schedule, refreshed).

    ``refresh_mode`` decides how: COMPLETE rebuilds a view from ``builders``,
    INCREMENTAL applies what ``changes`` gives for it (see ``TotalsView``). An
    INCREMENTAL view without changes, or with nothing stored yet, is rebuilt.
    """
    changes = changes or {}
    due = schedule.where(F.col("is_active") & (F.col("next_refresh") <= as_of)).where(
        F.col("view_name").isin(list(builders)))
    done = []
    for row in due.select("view_name", "refresh_mode").orderBy("view_name").collect():  # at most one row per builder
        name, view = row.view_name, tables[row.view_name]
        try:
            if row.refresh_mode == "INCREMENTAL" and name in changes and isinstance(view, TotalsView) and view.version():
                view.refresh(changes[name]())
            else:
                view.replace(builders[name]())
            done.append(name)
        except Exception as error:  # noqa: BLE001 - one broken view must not stop the others
            log.warning("refresh of %s failed: %s", name, error)
    fresh = F.col("view_name").isin(done)
    updated = (schedule.withColumn("last_refresh", F.when(fresh, as_of).otherwise(F.col("last_refresh")))
               .withColumn("next_refresh", F.when(fresh, _later(as_of, F.col("interval_seconds")).cast("timestamp_ntz"))
                           .otherwise(F.col("next_refresh"))))
    return updated, len(done)


SIGN = "_sign"


def signed_changes(log_: DataFrame, schema: StructType) -> DataFrame:
    """Rows of a change log (see ``cdc.capture``) with ``_sign``: -1 for the image that goes, 1 for the one that comes."""
    def side(column: str, sign: int) -> DataFrame:
        return log_.where(F.col(column).isNotNull()).select(
            F.from_json(column, schema, cdc.IMAGE).alias("r")).select("r.*", F.lit(sign).alias(SIGN))

    return side("old_values", -1).unionByName(side("new_values", 1))


class TotalsView:
    """A stored view with total, count, minimum and maximum of ``value`` per group, kept current from signed changes.

    Beside the view lies how often each value of each group occurs. Signed
    counts of a refresh are added to it, so a minimum or maximum survives the
    retraction of its row. A refresh writes the counts and groups that changed and
    nothing else; it reads the counts of the changed groups. Groups without rows
    leave the view. Null is a group of its own, null values count only as rows.
    """

    def __init__(self, spark: SparkSession, base: str, keys: list[str], value: str):
        self.spark, self.keys, self.value = spark, keys, value
        self.counts = VersionedTable(spark, f"{base.rstrip('/')}/counts")
        self.view = KeyedTable(spark, f"{base.rstrip('/')}/view", keys)

    def version(self) -> int:
        return self.view.log.latest()

    def read(self) -> DataFrame:
        return self.view.read()

    def replace(self, rows: DataFrame) -> None:
        """Rebuild from all rows (keys and value)."""
        self.counts.replace(self._signed(rows.withColumn(SIGN, F.lit(1))))
        self.view.create(self._totals(self.counts.read()))

    def refresh(self, changes: DataFrame) -> int:
        """Apply rows (keys, value, ``_sign``: 1 comes, -1 goes) and return how many groups they change."""
        self.counts.insert(self._signed(changes))
        changed = self.counts.part_of_last_insert().select(*self.keys).distinct()
        totals = self._totals(match(self.counts.read(), changed, self.keys, "left_semi"))
        rows = match(changed, totals.withColumn("_there", F.lit(True)), self.keys, "left")
        return self.view.apply(rows.withColumn(GONE, F.col("_there").isNull()).drop("_there"), [GONE])

    def compact(self) -> None:
        """Add up the counts of all refreshes so far."""
        self.counts.replace(self._signed(self.counts.read().withColumnRenamed("n", SIGN)))

    def _signed(self, rows: DataFrame) -> DataFrame:
        value = F.col(self.value)
        return rows.groupBy(*self.keys, value.alias(self.value)).agg(F.sum(F.col(SIGN).cast("long")).alias("n")).where("n <> 0")

    def _totals(self, counts: DataFrame) -> DataFrame:
        held = counts.groupBy(*self.keys, self.value).agg(F.sum("n").alias("n")).where("n <> 0")
        value, there = F.col(self.value), F.col(self.value).isNotNull()
        return held.groupBy(*self.keys).agg(
            F.sum(value * F.col("n")).alias("total"), F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0).cast("long")).alias("n"),
            F.min(value).alias("lowest"), F.max(value).alias("highest"))


def partial_totals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mergeable aggregates: sum, count, minimum and maximum per group."""
    return df.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"),
                                 F.min(value).alias("lowest"), F.max(value).alias("highest"))


def merge_partials(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Stored aggregates brought up to date with those of new rows only."""
    return stored.unionByName(new).groupBy(*keys).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
