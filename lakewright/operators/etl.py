"""Metadata-driven loads: column mappings, full and incremental runs, star-schema steps."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.functions.validators import identifier
from lakewright.operators.joins import update_from
from lakewright.operators.windows import latest_per_key, match
from lakewright.sources.versioned import upsert


@dataclass(frozen=True)
class Mapping:
    """One target column: from a source column or a rule, cast, with default and null rule."""

    target: str
    type: str
    source: str | None = None
    rule: str | None = None
    nullable: bool = True
    default: object = None

    def value(self) -> Column:
        raw = F.expr(self.rule) if self.rule else F.col(self.source)
        cast = raw.try_cast(self.type)
        return cast if self.default is None else F.coalesce(cast, F.lit(self.default).cast(self.type))


@dataclass(frozen=True)
class Job:
    name: str
    mappings: Sequence[Mapping]
    source_type: str = "database"
    options: dict = field(default_factory=dict)
    incremental_column: str | None = None


def register(registry: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Registry with rows added or replaced by key: jobs by name, mappings by (job, target), checks by (job, name)."""
    return upsert(registry, rows, keys)


def target_schema(mappings: Sequence[Mapping]) -> T.StructType:
    schema = T.StructType()
    for m in mappings:
        schema.add(T.StructField(identifier(m.target), T._parse_datatype_string(m.type), m.nullable))
    return schema


def create_target(spark: SparkSession, mappings: Sequence[Mapping], path: str) -> DataFrame:
    """An empty stored table with the mapped columns."""
    empty = spark.createDataFrame([], target_schema(mappings))
    empty.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def apply_mapping(df: DataFrame, mappings: Sequence[Mapping]) -> DataFrame:
    """Mapped columns plus ``_rejected``: a required value is missing or a value does not fit its type."""
    bad = F.lit(False)
    for m in mappings:
        if not m.nullable:
            bad = bad | m.value().isNull()
        if m.source and not m.rule:
            bad = bad | (F.col(m.source).isNotNull() & F.col(m.source).try_cast(m.type).isNull())
    return df.select(*[m.value().alias(identifier(m.target)) for m in mappings], bad.alias("_rejected"))


@dataclass(frozen=True)
class RunResult:
    run_id: str
    rows_processed: int
    rows_loaded: int
    rows_rejected: int
    seconds: float
    last_value: object


def load(source: DataFrame, job: Job, path: str, last_value=None, run_id: str | None = None) -> RunResult:
    """One run of a job as one distributed write into a folder of its own under the target.

    An incremental job takes rows above ``last_value`` and reports the greatest
    value it saw. The folder is named after the run: without ``run_id`` after
    job and mark, so a repeated load replaces itself and others stay.
    """
    run_id, begin = run_id or hashlib.md5(f"{job.name}:{last_value}".encode()).hexdigest(), time.monotonic()
    rows, mark = source, F.lit(None)
    if job.incremental_column:
        mark = F.col(job.incremental_column)
        if last_value is not None:
            rows = rows.where(mark > F.lit(last_value))
    seen = Observation()
    facts = [F.count(F.lit(1)).alias("rows"), F.max("_mark").alias("last")]
    rows = rows.withColumn("_mark", mark).observe(seen, *facts)
    taken = Observation()
    mapped = apply_mapping(rows, job.mappings).where(~F.col("_rejected")).drop("_rejected")
    mapped.observe(taken, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/load_id={run_id}")
    processed, loaded = seen.get["rows"], taken.get["rows"]
    newest = seen.get["last"] if job.incremental_column else None
    return RunResult(run_id, processed, loaded, processed - loaded, time.monotonic() - begin,
                     last_value if newest is None else newest)


def read_target(spark: SparkSession, path: str, mappings: Sequence[Mapping]) -> DataFrame:
    return spark.read.schema(target_schema(mappings)).option("recursiveFileLookup", "true").parquet(path)


def open_source(spark: SparkSession, job: Job) -> DataFrame:
    """The job's source: a table or view of the session, or files."""
    if job.source_type == "database":
        return spark.table(identifier(job.options["table"]))
    if job.source_type == "file":
        options = {k: v for k, v in job.options.items() if k not in ("format", "path", "schema")}
        reader = spark.read.format(job.options.get("format", "parquet")).options(**options)
        if "schema" in job.options:
            reader = reader.schema(job.options["schema"])
        return reader.load(job.options["path"])
    raise NotImplementedError(f"source type {job.source_type}")


def run_job(spark: SparkSession, job: Job, path: str, last_value=None) -> RunResult:
    return load(open_source(spark, job), job, path, last_value)


def derive_profit(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Sales (product_id, quantity, total_price, profit) with missing profit set from the product's cost."""
    costs = products.select("product_id", F.col("cost").alias("_cost"))
    joined = match(sales, costs, ["product_id"], "left")
    found = F.col("total_price") - F.col("_cost") * F.col("quantity")
    return joined.withColumn("profit", F.coalesce("profit", found)).drop("_cost")


def update_customers(customers: DataFrame, sales: DataFrame) -> DataFrame:
    """Customers with first and last purchase widened and the total set from their sales."""
    facts = sales.groupBy("customer_id").agg(F.min("sale_date").alias("_first"), F.max("sale_date").alias("_last"),
                                             F.sum("total_price").alias("_total"))
    return update_from(customers, facts, ["customer_id"], {
        "first_purchase_date": F.least("first_purchase_date", "_first"),
        "last_purchase_date": F.greatest("last_purchase_date", "_last"),
        "total_purchases": F.col("_total")})


def run_steps(spark: SparkSession, steps: dict[str, Callable[[], None]]) -> list[tuple[str, str, str]]:
    """Run named steps in order and return their activity log; an error is logged and raised again."""
    log: list[tuple[str, str, str]] = []
    for name, step in steps.items():
        log.append((name, "STARTED", ""))
        try:
            step()
        except Exception as error:
            log.append((name, "ERROR", str(error)))
            raise
        log.append((name, "COMPLETED", ""))
    return log


def active_jobs(jobs: DataFrame, runs: DataFrame, mappings: DataFrame, checks: DataFrame) -> DataFrame:
    """Jobs with their number of runs, columns and checks; each side is counted before it is joined."""
    r = runs.groupBy("job").agg(F.count(F.lit(1)).alias("total_runs"), F.max("start_time").alias("last_run"))
    m = mappings.groupBy("job").agg(F.countDistinct("target").alias("column_count"))
    q = checks.groupBy("job").agg(F.countDistinct("check_name").alias("quality_checks"))
    out = jobs
    for side in (r, m, q):
        out = match(out, side, ["job"], "left")
    return out.na.fill(0, ["total_runs", "column_count", "quality_checks"])


def job_statistics(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Run counts, times, row totals, rejection and success rates per job; status in any letter case."""
    seconds = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / F.lit(1e6)
    status = F.upper("status")
    totals = runs.groupBy("job").agg(
        F.count(F.lit(1)).alias("total_runs"), F.avg(seconds).alias("avg_runtime_seconds"),
        F.max(seconds).alias("max_runtime_seconds"), F.min(seconds).alias("min_runtime_seconds"),
        F.sum("rows_processed").alias("total_rows_processed"), F.sum("rows_rejected").alias("total_rows_rejected"),
        F.try_divide(F.sum("rows_rejected") * F.lit(100.0), F.sum("rows_processed").cast("double")).alias("rejection_rate_percent"),
        F.count_if(status == "SUCCESS").alias("successful_runs"), F.count_if(status == "FAILED").alias("failed_runs"),
        (F.count_if(status == "SUCCESS") * F.lit(100.0) / F.count(F.lit(1))).alias("success_rate_percent"))
    return match(jobs, totals, ["job"], "left")


def last_runs(runs: DataFrame, results: DataFrame) -> DataFrame:
    """The latest run of every job with its quality checks counted and listed as JSON."""
    latest = latest_per_key(runs, ["job"], ["start_time", "run_id"])
    mine = match(results, latest.select("run_id"), ["run_id"], "left_semi")
    checks = mine.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if("passed").alias("passed_checks"),
        F.to_json(F.sort_array(F.collect_list(F.struct("check_name", "passed")))).alias("check_results"))
    return match(latest, checks, ["run_id"], "left").na.fill(0, ["checks", "passed_checks"])
