"""A catalogue of user functions: registered as callables or SQL bodies, run in batches, exported as scripts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.validators import identifier
from lakewright.operators.windows import match


@dataclass
class Entry:
    name: str
    language: str
    return_type: str
    signature: str = ""
    description: str = ""
    tags: tuple[str, ...] = ()
    function: Callable | None = None
    body: str | None = None
    examples: list[tuple[str, str]] = field(default_factory=list)


class Catalog:
    """Functions of one session; registering a known name replaces it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.entries: dict[str, Entry] = {}

    def create_python(self, name: str, function: Callable, return_type: str, **facts) -> Entry:
        """Register and deploy a vectorized function: it takes and returns pandas series."""
        entry = Entry(identifier(name), "python", return_type, function=function, **facts)
        self.spark.udf.register(name, F.pandas_udf(function, return_type))
        self.entries[name] = entry
        return entry

    def create_sql(self, name: str, signature: str, return_type: str, body: str, language: str = "sql", **facts) -> Entry:
        """Register and deploy a function with a SQL expression as its body.

        ``language`` records where the body came from; R and Lua bodies are given as expressions.
        """
        entry = Entry(identifier(name), language, return_type, signature=signature, body=body, **facts)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS {return_type} RETURN {body}")
        self.entries[name] = entry
        return entry

    def add_example(self, name: str, call: str, expected: str) -> None:
        self.entries[name].examples.append((call, expected))

    def run_examples(self, name: str) -> list[tuple[str, str, bool]]:
        """(call, result, as expected) of every example."""
        out = []
        for call, expected in self.entries[name].examples:
            got = self.spark.sql(f"SELECT CAST({call} AS STRING)").first()[0]
            out.append((call, got, got == expected))
        return out

    def drop(self, name: str) -> bool:
        if self.entries.pop(identifier(name), None) is None:
            return False
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        return True

    def frame(self) -> DataFrame:
        rows = [(e.name, e.language, e.signature, e.return_type, e.description, list(e.tags), len(e.examples))
                for e in self.entries.values()]
        return self.spark.createDataFrame(
            rows, "name string, language string, signature string, return_type string, description string, "
                  "tags array<string>, example_count int")


def catalog_view(functions: DataFrame, examples: DataFrame, executions: DataFrame) -> DataFrame:
    """Functions with example and execution counts and mean time, each side counted before it is joined."""
    e = examples.groupBy("name").agg(F.count(F.lit(1)).alias("example_count"))
    x = executions.groupBy("name").agg(F.count(F.lit(1)).alias("execution_count"), F.avg("seconds").alias("avg_execution_time"))
    return match(match(functions, e, ["name"], "left"), x, ["name"], "left").na.fill(0, ["example_count", "execution_count"])


BATCH_SCHEMA = "partition int, batch int, rows long, seconds double, success boolean, error string"


def batch_execute(df: DataFrame, function: Callable[[pd.DataFrame], object]) -> DataFrame:
    """Run a function over every batch of every partition; one row of facts per batch.

    A batch that fails is reported and does not stop the others.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId() if context else 0
        for i, batch in enumerate(batches):
            begin = time.monotonic()
            try:
                function(batch)
                ok, error = True, None
            except Exception as e:  # noqa: BLE001
                ok, error = False, str(e)
            yield pd.DataFrame({"partition": [part], "batch": [i], "rows": [len(batch)],
                                "seconds": [time.monotonic() - begin], "success": [ok], "error": [error]})

    return df.mapInPandas(run, BATCH_SCHEMA)


def map_rows(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a Python function to batches of rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(run, schema)


def mergeable_aggregate(df: DataFrame, keys: list[str], partial: Callable[[pd.DataFrame], pd.Series], states: list[str]) -> DataFrame:
    """A Python aggregate whose states add up: computed per batch and key, then summed by Spark.

    No task ever holds a whole group.
    """
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"`{s}` double" for s in states)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not batch.empty:
                yield batch.groupby(keys, dropna=False).apply(partial, include_groups=False).reset_index()

    return df.mapInPandas(run, schema).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in states])


# Script languages and the catalogue's names for them.
SCRIPT_LANGUAGES = {"PYTHON": "python", "R": "r", "LUA": "lua", "SQL": "sql"}


def export_scripts(functions: DataFrame) -> DataFrame:
    """Script text of catalogue rows (schema_name, name, language, signature, return_type, source)."""
    names = F.create_map(*[F.lit(x) for k, v in SCRIPT_LANGUAGES.items() for x in (v, k)])
    language = F.coalesce(F.try_element_at(names, F.col("language")), F.upper("language"))
    script = F.format_string("CREATE OR REPLACE %s SCRIPT %s.%s (%s) RETURNS %s AS\n%s\n/\n", language, "schema_name", "name",
                             "signature", "return_type", "source")
    return functions.withColumn("script", script)


def import_scripts(scripts: DataFrame, column: str = "script") -> DataFrame:
    """Catalogue columns found in script texts."""
    head = r"(?is)^CREATE\s+OR\s+REPLACE\s+(\w+)\s+SCRIPT\s+(\w+)\.(\w+)\s*\(([^)]*)\)\s+RETURNS\s+(\S+)\s+AS\s*\n(.*)\n/\s*$"

    def part(i):
        return F.regexp_extract(column, head, i)

    languages = F.create_map(*[F.lit(x) for pair in SCRIPT_LANGUAGES.items() for x in pair])
    return scripts.select(
        *scripts.columns, F.coalesce(F.try_element_at(languages, F.upper(part(1))), F.lit("sql")).alias("language"),
        part(2).alias("schema_name"), part(3).alias("name"), part(4).alias("signature"), part(5).alias("return_type"),
        part(6).alias("source"))
