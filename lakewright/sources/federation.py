"""Tables of other systems: options, type maps, registration, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.functions.validators import identifier
from lakewright.operators.windows import top_per_key
from lakewright.sources.files import CsvFormat, scan_csv

# Default ports of the source types.
PORTS = {"postgres": 5432, "mysql": 3306, "mssql": 1433, "mongodb": 27017, "redis": 6379, "oracle": 1521}
# URL pattern and driver class per relational source type.
DRIVERS = {
    "postgres": ("jdbc:postgresql://{host}:{port}/{dbname}", "org.postgresql.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{dbname}", "com.mysql.cj.jdbc.Driver"),
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={dbname}", "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "oracle": ("jdbc:oracle:thin:@{host}:{port}/{dbname}", "oracle.jdbc.OracleDriver"),
    "sqlite": ("jdbc:sqlite:{dbname}", "org.sqlite.JDBC"),
}


def jdbc_options(source_type: str, table: str, options: dict, partition: tuple[str, int, int, int] | None = None) -> dict[str, str]:
    """Reader options of a relational table; ``partition`` = (column, low, high, parts) reads it in parallel."""
    url, driver = DRIVERS[source_type]
    place = {"host": "localhost", "port": PORTS.get(source_type, ""), "dbname": "", **options}
    out = {"url": url.format(**place), "driver": driver, "dbtable": table, "fetchsize": "10000"}
    out.update({k: str(options[k]) for k in ("user", "password") if k in options})
    if partition:
        column, low, high, parts = partition
        out.update(partitionColumn=identifier(column), lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return out


def source_options(registry: DataFrame) -> DataFrame:
    """Host, port and database of registered sources (source_type, connection, options), with each type's default port.

    Explicit options win over what the connection text says.
    """
    text = F.col("connection")
    host = F.regexp_extract(text, r"^(?:\w+://)?(?:[^@/]*@)?([^:/?]+)", 1)
    port = F.nullif(F.regexp_extract(text, r"^(?:\w+://)?(?:[^@/]*@)?[^:/?]+:(\d+)", 1), F.lit(""))
    name = F.nullif(F.regexp_extract(text, r"^(?:\w+://)?[^/]*/([^?]+)", 1), F.lit(""))
    defaults = F.create_map(*[F.lit(x) for k, v in PORTS.items() for x in (k, str(v))])
    own = F.from_json("options", "map<string,string>")

    def option(key, fallback):
        return F.coalesce(F.try_element_at(own, F.lit(key)), fallback)

    server = F.col("source_type") != "sqlite"
    return registry.select(
        *[c for c in registry.columns if c not in ("connection", "options")],
        F.when(server, option("host", host)).alias("host"),
        F.when(server, option("port", F.coalesce(port, F.try_element_at(defaults, F.col("source_type"))))).alias("port"),
        F.when(server, option("dbname", name)).otherwise(text).alias("dbname"))


# Column types of two source systems and the warehouse type of each.
TYPE_RULES = {
    "mysql": {
        "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "SMALLINT", "decimal": "NUMERIC(p,s)",
        "float": "REAL", "double": "DOUBLE PRECISION", "date": "DATE", "datetime": "TIMESTAMP",
        "timestamp": "TIMESTAMP WITH TIME ZONE", "time": "TIME", "char": "CHAR(n)", "varchar": "VARCHAR(n)", "text": "TEXT",
        "blob": "BYTEA", "json": "JSONB", "enum": "TEXT"},
    "mssql": {
        "int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "tinyint": "SMALLINT", "decimal": "NUMERIC(p,s)",
        "numeric": "NUMERIC(p,s)", "float": "DOUBLE PRECISION", "real": "REAL", "money": "MONEY", "date": "DATE",
        "datetime": "TIMESTAMP", "datetime2": "TIMESTAMP", "datetimeoffset": "TIMESTAMP WITH TIME ZONE", "time": "TIME",
        "char": "CHAR(n)", "varchar": "VARCHAR(n)", "nvarchar": "VARCHAR(n)", "text": "TEXT", "ntext": "TEXT",
        "binary": "BYTEA", "varbinary": "BYTEA", "image": "BYTEA", "bit": "BOOLEAN", "uniqueidentifier": "UUID", "xml": "XML"},
}
# Pieces of a type name and the warehouse type they mean, first hit first.
GENERIC_RULES = (
    (("int",), "INTEGER"), (("char", "text"), "TEXT"), (("date", "time"), "TIMESTAMP"), (("num", "dec"), "NUMERIC"),
    (("float", "real", "double"), "DOUBLE PRECISION"), (("bool", "bit"), "BOOLEAN"), (("blob", "binary"), "BYTEA"),
    (("json",), "JSONB"))


def map_type(kind: Column, length: Column, precision: Column, scale: Column, source: str) -> Column:
    """Warehouse type of a source column type; unknown types are text."""
    name = F.lower(kind)
    if source == "postgres":
        return name
    if source in TYPE_RULES:
        rules = F.create_map(*[F.lit(x) for pair in TYPE_RULES[source].items() for x in pair])
        found = F.coalesce(F.try_element_at(rules, name), F.lit("TEXT"))
        if source == "mysql":
            found = F.when((name == "tinyint") & (length == 1), "BOOLEAN").otherwise(found)
        number = F.concat(F.lit("NUMERIC("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")"))
        sized = F.replace(found, F.lit("(n)"), F.concat(F.lit("("), length.cast("string"), F.lit(")")))
        return F.when(found == "NUMERIC(p,s)", number).otherwise(F.coalesce(sized, found))
    out = None
    for pieces, target in GENERIC_RULES:
        hit = F.lit(False)
        for p in pieces:
            hit = hit | name.contains(p)
        out = F.when(hit, target) if out is None else out.when(hit, target)
    return out.otherwise("TEXT")


# Type patterns of the migrated system and their replacement, first hit first.
VENDOR_RULES = (
    (r"DECIMAL", "NUMERIC"), (r"DOUBLE", "DOUBLE PRECISION"), (r"BIGINT", "BIGINT"), (r"INTEGER", "INTEGER"),
    (r"SMALLINT", "SMALLINT"), (r"VARCHAR\((\d+)\)", "VARCHAR($1)"), (r"CHAR\((\d+)\)", "CHAR($1)"), (r"BOOLEAN", "BOOLEAN"),
    (r"DATE", "DATE"), (r"TIMESTAMP WITH LOCAL TIME ZONE", "TIMESTAMP WITH TIME ZONE"), (r"TIMESTAMP", "TIMESTAMP"),
    (r"INTERVAL YEAR TO MONTH", "INTERVAL"), (r"INTERVAL DAY TO SECOND", "INTERVAL"), (r"GEOMETRY", "GEOMETRY"),
    (r"HASHTYPE", "BYTEA"))


def map_vendor_type(kind: Column) -> Column:
    """Warehouse type of a migrated column; what follows the name, such as (p,s), is kept."""
    out = None
    for pattern, replacement in VENDOR_RULES:
        hit = kind.rlike(f"(?i)^{pattern}")
        value = F.regexp_replace(kind, f"(?i)^{pattern}", replacement)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(kind)


# Spark type behind the warehouse types of foreign columns.
SPARK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "SMALLINT": "smallint", "REAL": "float", "DOUBLE PRECISION": "double",
               "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean", "BYTEA": "binary"}


def spark_type(warehouse: str) -> str:
    if warehouse.startswith("NUMERIC("):
        return warehouse.lower().replace("numeric", "decimal")
    return SPARK_TYPES.get(warehouse, "string")


# Warehouse type of plain type names of the other relational sources.
PLAIN_TYPES = {
    "integer": "INTEGER", "bigint": "BIGINT", "numeric": "DOUBLE PRECISION", "real": "DOUBLE PRECISION", "number": "DOUBLE PRECISION",
    "double precision": "DOUBLE PRECISION", "text": "TEXT", "varchar2": "TEXT", "timestamp": "TIMESTAMP", "date": "TIMESTAMP"}


def foreign_schema(columns: Sequence[tuple[str, str]], source: str) -> str:
    """Reader schema of (name, source type) columns."""
    rules = TYPE_RULES.get(source, PLAIN_TYPES)
    return ", ".join(f"`{identifier(n)}` {spark_type(rules.get(k.lower(), 'TEXT'))}" for n, k in columns)


def foreign_table(spark: SparkSession, source: str, columns: Sequence[tuple[str, str]], *, path: str | None = None,
                  options: dict | None = None, table: str | None = None,
                  partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A relational table of another system, from its exported files or over its driver.

    Over the driver ``partition`` (column, low, high, parts) is asked for, as a
    read without it is one connection in one task; a small table is read so by
    giving one part.
    """
    if path:
        return scan_csv(spark, path, foreign_schema(columns, source), CsvFormat())
    if partition is None:
        raise ValueError("give partition = (column, low, high, parts) to read a table over its driver")
    return spark.read.format("jdbc").options(**jdbc_options(source, table, options or {}, partition)).load()


def column_definitions(df: DataFrame, mapping: dict[str, tuple[str, str]] | None = None) -> list[tuple[str, str, str]]:
    """(source column, target column, type) from a mapping, or as the source has them."""
    if mapping:
        return [(s, identifier(target), kind) for s, (target, kind) in mapping.items()]
    return [(c, c, k) for c, k in df.dtypes]


class VirtualSchema:
    """Registered tables of one source, each seen as a view with mapped columns."""

    def __init__(self, spark: SparkSession, name: str, source_type: str):
        self.spark = spark
        self.name = identifier(name)
        self.source_type = source_type
        self.tables: dict[str, dict] = {}

    def add_table(self, table: str, remote: DataFrame, mapping: dict[str, tuple[str, str]] | None = None,
                  where: str | None = None) -> DataFrame:
        """Register a table; a filter adds a second view ending in _filtered."""
        columns = column_definitions(remote, mapping)
        frame = remote.select(*[F.col(s).cast(k).alias(t) for s, t, k in columns])
        view = f"{self.name}_{identifier(table)}"
        frame.createOrReplaceTempView(view)
        if where:
            frame.where(F.expr(where)).createOrReplaceTempView(f"{view}_filtered")
        self.tables[table] = {"view": view, "columns": len(columns), "filtered": bool(where)}
        return frame

    def import_all(self, remotes: dict[str, DataFrame]) -> int:
        for name, df in remotes.items():
            self.add_table(name, df)
        return len(remotes)

    def table(self, name: str, filtered: bool = False) -> DataFrame:
        return self.spark.table(self.tables[name]["view"] + ("_filtered" if filtered else ""))

    def drop(self) -> int:
        """Remove all views of the schema and its registrations."""
        for facts in self.tables.values():
            self.spark.catalog.dropTempView(facts["view"])
            if facts["filtered"]:
                self.spark.catalog.dropTempView(f"{facts['view']}_filtered")
        gone = len(self.tables)
        self.tables.clear()
        return gone

    def registry(self) -> DataFrame:
        rows = [(self.name, self.source_type, t, f["view"], f["columns"]) for t, f in self.tables.items()]
        return self.spark.createDataFrame(
            rows, "schema_name string, source_type string, table_name string, view_name string, column_count int")


def _row_bytes(df: DataFrame, columns: Sequence[str]) -> Column:
    """Bytes of the values of a row: what texts and binaries hold, the width of other types; null takes none."""
    widths = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    sizes = []
    for c in columns:
        kind = dict(df.dtypes)[c]
        size = F.octet_length(c) if kind in ("string", "binary") else F.when(F.col(c).isNotNull(), F.lit(widths.get(kind, 8)))
        sizes.append(F.coalesce(size, F.lit(0)).cast("long"))
    return sum(sizes[1:], sizes[0])


def table_stats(df: DataFrame, columns: Sequence[str], top: int) -> DataFrame:
    """Per column: row count, average row size, null share, distinct values, the ``top`` most common values and their shares.

    Each column's values are counted on their own, so a scan reads one column
    and no row is multiplied; equal values meet within each task before the shuffle.
    A table without rows gives no rows.
    """
    whole = df.agg(F.count(F.lit(1)).alias("row_count"), F.avg(_row_bytes(df, columns)).alias("avg_row_size"))
    cells = None
    for c in columns:
        own = df.groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("column_name"), "v", "n")
        cells = own if cells is None else cells.unionByName(own)
    facts = cells.groupBy("column_name").agg(
        (F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)) / F.sum("n")).alias("null_frac"),
        F.count("v").alias("n_distinct"))
    ranked = top_per_key(cells.where(F.col("v").isNotNull()), ["column_name"], [F.desc("n"), F.asc("v")], top)
    # At most ``top`` rows per column are left to gather.
    best = ranked.groupBy("column_name").agg(F.sort_array(F.collect_list(F.struct("rank", "v", "n"))).alias("best"))
    joined = facts.join(best, "column_name", "left").crossJoin(F.broadcast(whole))  # one row
    return joined.select(
        "column_name", "row_count", "avg_row_size", "null_frac", "n_distinct", F.array_join(F.transform("best", lambda s: s["v"]), ",").alias("most_common_vals"),
        F.array_join(F.transform("best", lambda s: F.round(s["n"] / F.col("row_count"), 6).cast("decimal(7,6)").cast("string")), ",").alias("most_common_freqs"))


def table_info(registry: DataFrame, stats: DataFrame) -> DataFrame:
    """Registered tables with their statistics, if any."""
    return registry.join(stats, "table_name", "left")


def usage_stats(access: DataFrame, schema: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Queries, times and share with push-down per table; every filter is optional."""
    rows = access
    if schema is not None:
        rows = rows.where(F.col("schema_name") == schema)
    if start is not None:
        rows = rows.where(F.col("executed_at") >= start)
    if end is not None:
        rows = rows.where(F.col("executed_at") <= end)
    return rows.groupBy("schema_name", "table_name").agg(
        F.count(F.lit(1)).alias("query_count"), F.sum("execution_ms").alias("total_ms"),
        (F.sum("execution_ms") / F.count(F.lit(1))).alias("avg_ms"),
        F.round(F.count_if("pushdown_applied") * F.lit(100.0) / F.count(F.lit(1)), 2).alias("pushdown_percentage"))
