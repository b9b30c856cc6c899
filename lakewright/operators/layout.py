"""Partitioned, distributed and co-located tables, their upkeep and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.validators import identifier

# How partitions of each interval are named and how far apart they start.
INTERVALS = {
    "daily": ("'_y'yyyy'm'MM'd'dd", "day", "INTERVAL 1 DAY"),
    "monthly": ("'_y'yyyy'm'MM", "month", "INTERVAL 1 MONTH"),
    "yearly": ("'_y'yyyy", "year", "INTERVAL 1 YEAR"),
}


def time_partition(table: str, ts: Column, interval: str) -> Column:
    """Name of the partition holding a time, such as sales_y2024m01."""
    return F.concat(F.lit(identifier(table)), F.date_format(ts, INTERVALS[interval][0]))


def week_partition(table: str, ts: Column, days: int, origin: str = "1970-01-01") -> Column:
    """Partition of a fixed number of days, named by its first day."""
    since = F.floor(F.datediff(ts, F.lit(origin)) / days) * days
    return F.concat(F.lit(identifier(table)), F.date_format(F.date_add(F.lit(origin).cast("date"), since.cast("int")), "'_y'yyyy'm'MM'd'dd"))


def list_partition(table: str, column: Column, groups: dict[str, Sequence]) -> Column:
    """Partition by lists of values; other values go to the default partition."""
    name = None
    for group, values in groups.items():
        hit = column.isin(*values)
        label = f"{identifier(table)}_{identifier(group)}"
        name = F.when(hit, label) if name is None else name.when(hit, label)
    return name.otherwise(f"{table}_default")


def hash_partition(column: Column, modulus: int) -> Column:
    """Remainder of the column's hash."""
    return F.pmod(F.xxhash64(column), F.lit(modulus)).cast("int")


def write_partitioned(df: DataFrame, columns: Sequence[str], path: str) -> DataFrame:
    """Write by partition columns. The rebalance step gives each partition few files and splits large ones."""
    (df.hint("rebalance", *[F.col(c) for c in columns]).write.mode("overwrite").option("compression", "zstd")
     .partitionBy(*columns).parquet(path))
    return df.sparkSession.read.parquet(path)


def future_partitions(tables: DataFrame, interval: str, months: int) -> DataFrame:
    """Partition names and bounds from each table's ``since`` date over the coming months.

    Daily tables get 30 partitions per month, yearly ones one per started year.
    """
    count = {"daily": 30 * months, "monthly": months, "yearly": months // 12 + 1}[interval]
    pattern, unit, step = INTERVALS[interval]
    first = F.date_trunc(unit, F.col("since")).cast("date")
    starts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: {
        "daily": F.date_add(first, i), "monthly": F.add_months(first, i), "yearly": F.add_months(first, i * 12)}[interval])
    return (tables.select("table_name", F.explode(starts).alias("lower"))
            .withColumn("upper", (F.col("lower") + F.expr(step)).cast("date"))
            .withColumn("partition_name", F.concat(F.col("table_name"), F.date_format("lower", pattern))))


def retention_class(ts: Column, as_of: Column, keep_months: int, archive_months: int) -> Column:
    """keep, archive or drop by the month a row belongs to."""
    start = F.trunc(ts, "month")
    today = F.to_date(as_of)
    return (F.when(start < F.add_months(today, -(keep_months + archive_months)), "drop")
            .when(start < F.add_months(today, -keep_months), "archive").otherwise("keep"))


def apply_retention(df: DataFrame, ts: str, as_of: Column, keep_months: int, archive_months: int, keep_path: str,
                    archive_path: str) -> tuple[DataFrame, DataFrame]:
    """Write the rows to keep and to archive, by month; older rows are left out."""
    tagged = (df.withColumn("_class", retention_class(F.col(ts), as_of, keep_months, archive_months))
              .withColumn("part_month", F.date_format(ts, "yyyyMM")))
    kept = write_partitioned(tagged.where("_class = 'keep'").drop("_class"), ["part_month"], keep_path)
    archived = write_partitioned(tagged.where("_class = 'archive'").drop("_class"), ["part_month"], archive_path)
    return kept, archived


def drop_older(df: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return df.where(F.to_date(ts) >= F.date_sub(F.to_date(as_of), days))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Path and size of the data files below a folder; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
            .load(path).select("path", "length"))


def partition_report(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Rows, files and bytes per partition of a written table."""
    rows = (spark.read.parquet(path).groupBy(F.col(column).cast("string").alias("partition_value"))
            .agg(F.count(F.lit(1)).alias("row_count")))
    value = F.url_decode(F.regexp_extract("path", f"/{column}=([^/]+)/", 1))
    files = (file_sizes(spark, path).groupBy(value.alias("partition_value"))
             .agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes")))
    return rows.join(files, "partition_value", "left")


def size_breakdown(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """Rows and bytes of stored tables, largest first."""
    out = None
    for name, path in tables.items():
        rows = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("row_count"), F.lit(0).cast("long").alias("bytes"))
        size = file_sizes(spark, path).agg(F.lit(0).cast("long").alias("row_count"), F.sum("length").alias("bytes"))
        facts = rows.unionByName(size).select(F.lit(name).alias("table_name"), "row_count", "bytes")
        out = facts if out is None else out.unionByName(facts)
    return (out.groupBy("table_name").agg(F.sum("row_count").alias("row_count"), F.sum("bytes").alias("bytes"))
            .orderBy(F.desc("bytes"), "table_name"))


def maintain(tables: dict[str, tuple[DataFrame, str]], as_of: Column, keep_months: int, archive_months: int,
             ahead_months: int) -> DataFrame:
    """For every registered table: rows to keep, archive and drop, and months planned ahead."""
    reports = []
    for name, (df, ts) in tables.items():
        kind = retention_class(F.col(ts), as_of, keep_months, archive_months)
        counts = df.agg(*[F.count_if(kind == k).alias(f"{k}_rows") for k in ("keep", "archive", "drop")],
                        F.max(ts).alias("_last"))
        lead = F.months_between(F.trunc(F.add_months(F.to_date(as_of), ahead_months), "month"), F.trunc("_last", "month"))
        reports.append(counts.select(F.lit(name).alias("table_name"), "keep_rows", "archive_rows", "drop_rows",
                                     F.greatest(lead, F.lit(0.0)).cast("int").alias("months_to_plan")))
    out = reports[0]
    for one in reports[1:]:
        out = out.unionByName(one)
    return out


#: Rows in which a repeated value is looked for before a column is counted as a whole.
LOOK = 100_000


def is_unique(df: DataFrame, column: str, look: int = LOOK) -> bool:
    """Whether no row lacks the column and no two rows share a value, exactly.

    A value that repeats among some rows, or a null, settles it; only a column
    without one there is counted in full, on its own.
    """
    rows = df.select(F.col(column).alias("v"))
    for part in (rows.limit(look), rows):
        if not part.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or v is null").isEmpty():
            return False
    return True


def choose_key(df: DataFrame, table: str) -> DataFrame:
    """Recommended distribution column: the first unique column, else the first time column (by range), else the first."""
    simple = [f.name for f in df.schema if f.dataType.typeName() not in ("array", "map", "struct")]
    rows = df.count()
    unique = next((c for c in simple if rows and is_unique(df, c)), None)
    times = [f.name for f in df.schema if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")]
    if unique:
        choice, strategy, reason = unique, "hash", "unique column"
    elif times:
        choice, strategy, reason = times[0], "range", "first time column"
    else:
        choice, strategy, reason = df.columns[0], "hash", "first column"
    return df.sparkSession.createDataFrame([(table, choice, strategy, reason, rows)],
                                           "table_name string, key string, strategy string, reason string, row_count long")


def distribute(df: DataFrame, strategy: str, key: str | None = None, n: int | None = None) -> DataFrame:
    """Rows laid out by hash or range of a key, kept as they come, or marked as a small reference table.

    ``hash`` keeps each key together; ``balanced`` groups by the key as well but splits large keys.
    """
    if strategy == "hash":
        return df.repartition(n, key) if n else df.repartition(key)
    if strategy == "range":
        return df.repartitionByRange(n, key) if n else df.repartitionByRange(key)
    if strategy == "balanced":
        return df.hint("rebalance", F.col(key))
    if strategy == "reference":
        # A small table needs no layout: Spark sends it to every task if its size allows.
        return df
    if strategy == "append":
        return df
    raise ValueError(f"unknown strategy {strategy}")


def distribute_schema(tables: dict[str, DataFrame], exclude: Sequence[str] = ()) -> DataFrame:
    """A recommendation per table; a table that fails is reported and does not stop the others."""
    reports = []
    for name, df in tables.items():
        if name in exclude:
            continue
        try:
            reports.append(choose_key(df, name))
        except Exception as error:  # noqa: BLE001
            reports.append(df.sparkSession.createDataFrame(
                [(name, None, "failed", str(error).split("\n")[0], None)],
                "table_name string, key string, strategy string, reason string, row_count long"))
    out = reports[0]
    for one in reports[1:]:
        out = out.unionByName(one)
    return out


def partition_sizes(df: DataFrame) -> DataFrame:
    """Rows per partition of the present layout."""
    return df.groupBy(F.spark_partition_id().alias("node")).agg(F.count(F.lit(1)).alias("size"))


def rebalance_plan(sizes: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Whether (node, size) is out of balance, and a move from the largest to the smallest node.

    A node is out of balance if it differs from the mean by more than the threshold.
    """
    facts = sizes.agg(F.avg("size").alias("mean"), F.max(F.struct("size", "node")).alias("hi"),
                      F.min(F.struct("size", "node")).alias("lo"))
    off = F.greatest(F.col("hi.size") - F.col("mean"), F.col("mean") - F.col("lo.size"))
    return facts.select(F.col("hi.node").alias("from_node"), F.col("lo.node").alias("to_node"),
                        F.floor((F.col("hi.size") - F.col("lo.size")) / 2).alias("move_rows"),
                        (off > F.col("mean") * threshold).alias("rebalance"))


def by_key(df: DataFrame, key: str, n: int, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run a job that aggregates by the key, its result spread over ``n`` hash parts of the key.

    The rows are not moved by key beforehand: partial results are, so a large key costs no more than others.
    """
    return job(df).repartition(n, key)


def format_sizes(df: DataFrame, base: str) -> DataFrame:
    """Bytes of the same rows as compressed columns and as JSON lines, and their ratio."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{base}/columns")
    df.write.mode("overwrite").json(f"{base}/rows")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{parquet,json}")
             .load(base).select("length", F.col("path").endswith(".json").alias("as_rows")))
    return files.agg(
        F.sum(F.when(~F.col("as_rows"), F.col("length"))).alias("column_bytes"),
        F.sum(F.when(F.col("as_rows"), F.col("length"))).alias("row_bytes")).withColumn(
        "ratio", F.col("row_bytes") / F.col("column_bytes"))
