"""Reading and writing delimited files and stored tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewright.functions.validators import column_definitions, identifier
from lakewright.sources.tables import remove_at_exit


@dataclass(frozen=True)
class CsvFormat:
    """How a delimited file is written and read.

    ``line_breaks`` allows line breaks inside quoted values: one file is then
    read by one task, so large exports should consist of many files. Without it
    large files are split. A null and an empty text differ if ``null_string``
    is not empty.
    """

    delimiter: str = ","
    null_string: str = ""
    header: bool = True
    encoding: str = "UTF-8"
    quote: str = '"'
    escape: str = '"'
    line_breaks: bool = True

    def options(self) -> dict[str, str]:
        return {"sep": self.delimiter, "nullValue": self.null_string, "header": str(self.header).lower(),
                "encoding": self.encoding, "quote": self.quote, "escape": self.escape,
                "multiLine": str(self.line_breaks).lower(), "mode": "FAILFAST", "lineSep": "\n",
                "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
                "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "timestampFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]"}


def scan_csv(spark: SparkSession, path: str, schema: str, fmt: CsvFormat = CsvFormat()) -> DataFrame:
    return spark.read.schema(schema).options(**fmt.options()).csv(path)


def export_csv(df: DataFrame, path: str, fmt: CsvFormat = CsvFormat()) -> None:
    df.write.mode("overwrite").options(**fmt.options()).csv(path)


def optimized_copy(spark: SparkSession, path: str, schema: str, target: str, fmt: CsvFormat = CsvFormat(),
                   truncate_before: bool = False) -> int:
    """Load delimited files into a stored table and return the number of rows."""
    seen = Observation()
    rows = scan_csv(spark, path, schema, fmt).observe(seen, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("overwrite" if truncate_before else "append").option("compression", "zstd").parquet(target)
    return seen.get["rows"]


def csv_text_to_table(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Lines of delimited text in a column as typed columns."""
    return df.select(F.from_csv(F.col(column), schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")


@dataclass(frozen=True)
class TextLoad:
    """What a load of delimited text gave: how many lines became rows, how many did not fit, and where both lie."""

    rows: int
    bad: int
    path: str
    bad_path: str


def load_csv_text(df: DataFrame, column: str, schema: str, target: str) -> TextLoad:
    """Parse a text column of delimited lines and store it: rows under ``target``, lines that do not fit (line) beside it.

    A line fits if it has the columns of ``schema`` and every value its type; an
    empty value is null. Null and blank lines are skipped. One pass over the lines.
    """
    parsed = F.from_csv(F.col(column), f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = df.where(F.trim(column) != "").select(F.col(column).alias("line"), parsed.alias("r"))
    counted = Observation()
    seen = lines.observe(counted, F.count_if(F.col("r._bad").isNull()).alias("rows"), F.count_if(F.col("r._bad").isNotNull()).alias("bad"))
    staged = f"{target}-staged"
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    seen.select("line", "r", F.col("r._bad").isNotNull().alias("is_bad")).write.mode("overwrite").parquet(staged)
    remove_at_exit(df.sparkSession, staged)
    held = df.sparkSession.read.parquet(staged)
    held.where("not is_bad").select(*[F.col("r")[c].alias(c) for c in names]).write.mode("overwrite").parquet(target)
    held.where("is_bad").select("line").write.mode("overwrite").parquet(f"{target}-bad")
    return TextLoad(counted.get["rows"], counted.get["bad"], target, f"{target}-bad")


def write_analytics_table(df: DataFrame, schema: str, table: str, columns: str, base: str) -> DataFrame:
    """Store the named and typed columns as a compressed columnar table, after checking every name."""
    path = f"{base}/{identifier(schema)}/{identifier(table)}"
    wanted = [c.strip().split(" ", 1) for c in _split_columns(column_definitions(columns))]
    df.select(*[F.col(n).cast(kind).alias(identifier(n)) for n, kind in wanted]).write.mode("errorifexists").option(
        "compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _split_columns(text: str) -> list[str]:
    """Column definitions at commas outside parentheses."""
    parts, depth = [""], 0
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    return parts


def frame_from_query(spark: SparkSession, sql: str, views: dict[str, DataFrame]) -> DataFrame:
    """Result of a query over named frames."""
    return spark.sql(sql, **views)


def frame_to_table(df: DataFrame, table: str, path: str, mode: str = "overwrite") -> DataFrame:
    """Store a frame as a named table in one distributed write."""
    df.write.mode(mode).option("path", path).saveAsTable(identifier(table))
    return df.sparkSession.table(table)


def create_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


def series_table(spark: SparkSession, n: int, columns: dict[str, Column]) -> DataFrame:
    """Rows 1..n with columns derived from ``id``."""
    return spark.range(1, n + 1).select("id", *[c.alias(name) for name, c in columns.items()])


# Column type by frame dtype; anything else is text.
DTYPES = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "float": "DOUBLE PRECISION",
          "double": "DOUBLE PRECISION", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "TIMESTAMP", "boolean": "BOOLEAN"}


def frame_types(df: DataFrame, split_whole: bool = False) -> DataFrame:
    """(column_name, type) of a frame; with ``split_whole`` a floating column of whole numbers is an integer."""
    whole: dict[str, bool] = {}
    if split_whole:
        floats = [c for c, k in df.dtypes if k in ("float", "double")]
        if floats:
            row = df.agg(*[F.every(F.col(c) == F.floor(c)).alias(c) for c in floats]).first()
            whole = {c: bool(row[c]) for c in floats}
    rows = [(c, "INTEGER" if whole.get(c) else DTYPES.get(k, "TEXT")) for c, k in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column_name string, type string")
