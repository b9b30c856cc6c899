"""Joins beyond the built-in forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.windows import latest_per_key, match, running_points, shifted
from lakewright.sources.tables import durable, scratch_path

def not_in(left: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows whose ``column`` is NOT IN the values, with SQL null rules.

    A null among the values rejects every row, and a null on the left is
    rejected unless there are no values at all.
    """
    if values.isEmpty():
        return left
    if not values.where(F.col(value).isNull()).isEmpty():
        return left.limit(0)
    listed = values.select(F.col(value).alias("_value")).distinct()
    return left.where(F.col(column).isNotNull()).join(listed, F.col(column) == F.col("_value"), "left_anti")


def with_latest(left: DataFrame, right: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """Each left row with the latest right row of its key, or nulls."""
    return match(left, latest_per_key(right, on, order), on, "left")


def update_from(target: DataFrame, source: DataFrame, on: list[str], changes: dict[str, Column]) -> DataFrame:
    """Target with columns replaced where the source has the key; ``source`` must be unique on it."""
    kept = target.columns
    joined = match(target, source.withColumn("_hit", F.lit(True)), on, "left")
    hit = F.col("_hit").isNotNull()
    return joined.select(*[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
                           for c in kept])


def hierarchy(nodes: DataFrame) -> DataFrame:
    """Level and path of every node (id, parent) reachable from the roots, level by level.

    Each level is written before the next one starts, so depth does not grow the
    plan, and the levels are read back as one table: there is no limit on rows
    or depth. A node that comes up again below itself raises an error.
    """
    spark = nodes.sparkSession
    path = scratch_path(spark, "hierarchy")
    children = nodes.where(F.col("parent").isNotNull())
    level = nodes.where(F.col("parent").isNull()).select("id", "parent", F.lit(1).alias("level"), F.col("id").alias("path"),
                                                         F.array("id").alias("_above"))
    depth = 1
    while True:
        folder = f"{path}/depth={depth}"
        level.write.option("compression", "zstd").parquet(folder)
        written = spark.read.parquet(folder)
        if written.isEmpty():
            break
        above = written.select(F.col("id").alias("_up"), "level", "path", "_above")
        below = children.join(above, F.col("parent") == F.col("_up"))
        looped = below.where(F.array_contains("_above", F.col("id"))).select("id").first()
        if looped is not None:
            raise ValueError(f"node {looped.id} lies below itself")
        level = below.select("id", "parent", (F.col("level") + 1).alias("level"), F.concat_ws("/", "path", "id").alias("path"),
                             F.concat("_above", F.array("id")).alias("_above"))
        depth += 1
    return spark.read.parquet(path).drop("_above", "depth")


def within_intervals(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, seconds: int) -> DataFrame:
    """Pairs of a point and an interval (lo inclusive, hi exclusive) that holds it.

    Time is cut into slots of ``seconds``, an interval stands in each slot it
    touches, and the two meet by slot: choose about the usual interval length.
    """
    def slot(c):
        return F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000))

    spread = intervals.withColumn("_slot", F.explode(F.sequence(slot(F.col(lo)), slot(F.col(hi)))))
    near = points.withColumn("_slot", slot(F.col(at)))
    return near.join(spread, "_slot").where((F.col(at) >= F.col(lo)) & (F.col(at) < F.col(hi))).drop("_slot")


def count_within(points: DataFrame, at: str, intervals: DataFrame, lo: str, hi: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Intervals with the number of points (of the same ``keys``) in them, lo inclusive and hi exclusive.

    No pair is listed: running counts of the points are looked up at both ends,
    so the work does not depend on how many points an interval holds, and a
    time that holds many of them is split like any other. An interval with a
    null end holds none.
    """
    keys = keys or []
    ends = None
    for end in (lo, hi):
        side = intervals.select(*keys, F.struct(F.col(end).alias("at"), F.lit(0).alias("side")).alias("_place"), F.lit(0).alias("_one"))
        ends = side if ends is None else ends.unionByName(side)
    # At an equal time an end comes before the points.
    every = points.where(F.col(at).isNotNull()).select(*keys, F.struct(F.col(at).alias("at"), F.lit(1).alias("side")).alias("_place"), F.lit(1).alias("_one"))
    upto = durable(running_points(every.unionByName(ends), keys, "_place", {"_n": ("sum", "_one")}).where("_place.side = 0"))
    out = intervals
    for end in (lo, hi):
        found = upto.select(*keys, F.col("_place.at").alias(end), F.col("_n").alias(f"_n_{end}"))
        out = match(out, found, [*keys, end])
    n = F.greatest(F.col(f"_n_{hi}") - F.col(f"_n_{lo}"), F.lit(0))
    return out.withColumn(name, F.when(F.col(lo).isNull() | F.col(hi).isNull(), F.lit(0)).otherwise(n).cast("long")).drop(f"_n_{lo}", f"_n_{hi}")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Left rows with ``match``: the last right row of their key at or before them, or null.

    Both sides stand in one order by time, right rows first among equals, and a
    left row takes the last right row before it. ``tie`` orders rows of one side
    and must be unique within key and time. No key is gathered in one task.
    """
    both = (right.select(*keys, at, F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.struct(*right.columns).alias("_match"),
                         F.lit(None).cast(left.schema.simpleString()).alias("_row"))
            .unionByName(left.select(*keys, at, F.lit(1).alias("_side"), F.col(tie).alias("_tie"),
                                     F.lit(None).cast(right.schema.simpleString()).alias("_match"), F.struct(*left.columns).alias("_row"))))
    found = shifted(both, keys, [at, "_side", "_tie"], "_match", 1, "match", ignore_nulls=True)
    return found.where("_side = 1").select("_row.*", "match")


#: Rows that a bucket holds on average at most: the task that writes or joins it sorts them.
BUCKET_ROWS = 500_000


def bucket_count(least: int, *tables: DataFrame, rows: int = BUCKET_ROWS) -> int:
    """Number of buckets for tables stored alike: a multiple of ``least`` that grows with the largest of them."""
    return least * max(1, *(-(-df.count() // (least * rows)) for df in tables))


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Store a table bucketed and sorted by ``key``, so that joins on it need no shuffle: one file and one task per bucket."""
    (df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return df.sparkSession.table(table)
