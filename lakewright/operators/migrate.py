"""Moving tables between systems: schema text, copy plan, copy and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.windows import match
from lakewright.sources.federation import map_vendor_type


def table_definitions(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """DDL text per table from its columns (table_name, position, column_name, vendor_type, nullable) and key columns."""
    kind = map_vendor_type(F.col("vendor_type"))
    line = F.concat_ws(" ", "column_name", kind, F.when(~F.col("nullable"), "NOT NULL"))
    body = columns.groupBy("table_name").agg(F.sort_array(F.collect_list(F.struct("position", line.alias("line")))).alias("c"))
    primary = keys.groupBy("table_name").agg(F.expr("listagg(column_name, ', ') WITHIN GROUP (ORDER BY position)").alias("pk"))
    key = F.when(F.col("pk").isNotNull(), F.concat(F.lit(", PRIMARY KEY ("), "pk", F.lit(")"))).otherwise("")
    return match(body, primary, ["table_name"], "left").select("table_name", F.concat(
        F.lit("CREATE TABLE "), "table_name", F.lit(" ("), F.array_join(F.transform("c", lambda c: c["line"]), ", "), key,
        F.lit(")")).alias("ddl"))


def chunk_plan(tables: DataFrame, size: int = 100_000) -> DataFrame:
    """Chunks (offset, rows) of every table (table_name, row_count); only a table's first chunk empties the target."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("row_count") - 1, F.lit(0)), F.lit(size).cast("long"))
    return (tables.select("table_name", "row_count", F.explode(starts).alias("chunk_offset"))
            .select("table_name", "chunk_offset", F.least(F.lit(size), F.col("row_count") - F.col("chunk_offset")).alias("chunk_rows"),
                    (F.col("chunk_offset") == 0).alias("truncate_before")))


def copy_table(df: DataFrame, staging: str, target: str) -> DataFrame:
    """Copy a table through a staged export, in parallel on both sides; every value and type survives."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def copy_statistics(results: DataFrame) -> DataFrame:
    """Rows, tables and outcomes of copy results (table_name, rows, outcome)."""
    return results.agg(
        F.count(F.lit(1)).alias("tasks"), F.countDistinct("table_name").alias("tables"), F.sum("rows").alias("rows"),
        *[F.count_if(F.col("outcome") == o).alias(f"{o}_count") for o in ("success", "warning", "error")])


def reconcile(source: DataFrame, target: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """Row count and sums of both sides with a flag per metric."""
    def facts(df, name):
        row = df.agg(F.count(F.lit(1)).cast("double").alias("row_count"), *[F.sum(c).cast("double").alias(n) for n, c in amounts.items()])
        entries = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias(name)) for n in ("row_count", *amounts)])
        return row.select(F.explode(entries).alias("e")).select("e.*")

    both = facts(source, "source_value").join(facts(target, "target_value"), "metric")
    return both.withColumn("matches", F.col("source_value").eqNullSafe(F.col("target_value")))
