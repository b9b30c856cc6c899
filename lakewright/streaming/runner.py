"""Running a stream over what is available and keeping its results as a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators import cdc
from lakewright.operators.windows import latest_per_key
from lakewright.sources.keyed import KeyedTable
from lakewright.sources.tables import durable
from lakewright.streaming.state import keyed_state, versioned


def file_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of a parquet table: the files of the folder called ``name``, or the one file of that name."""
    path = f"{folder}/{name}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


def is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.exists(where) and system.getFileStatus(where).isDirectory()


def _read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """The written table, or no rows of its schema if nothing has been written."""
    return spark.read.schema(schema).parquet(path) if is_folder(spark, path) else spark.createDataFrame([], schema)


def _finish(writer) -> None:
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def append_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append rows to a parquet folder, each input file exactly once."""
    _finish(stream.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint))


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    _finish(stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint))


def updates_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write each batch's changed groups under its batch number; a repeated batch replaces itself."""
    nothing = stream.sparkSession.createDataFrame([], stream.schema)
    nothing.write.mode("overwrite").parquet(f"{path}/batch_id=-1")
    each_batch(stream, lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/batch_id={batch}"),
               checkpoint, mode="update")


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """Merge the batches written so far into the newest one's folder; readers see the same groups.

    The merged state replaces the newest batch before older folders go, so a
    reader that comes between finds each group's latest state either way. A
    batch must not be running.
    """
    written = spark.read.parquet(path)
    newest = written.agg(F.max("batch_id")).first()[0]
    if newest is None:
        return
    merged = durable(latest_per_key(written, keys, ["batch_id"]).drop("batch_id"))
    merged.write.mode("overwrite").parquet(f"{path}/batch_id={newest}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in system.listStatus(where):
        name = status.getPath().getName()
        if name.startswith("batch_id=") and int(name.split("=")[1]) < newest:
            system.delete(status.getPath(), True)


def apply_changes(log: DataFrame, table: KeyedTable, order: list[str], checkpoint: str) -> None:
    """Apply a stream of changes (see ``cdc.capture``) to a keyed table, one run of changes per batch.

    The last change of a key wins. The table holds the number of its newest
    batch, so a batch that is repeated after a failure counts once.
    """
    schema = table.schema()

    def step(changes: DataFrame, batch: int) -> None:
        table.apply(cdc.keyed_rows(changes, schema, table.keys, order), order, batch)

    each_batch(log, step, checkpoint)


def current(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The latest written state of every group."""
    return latest_per_key(spark.read.parquet(path), keys, ["batch_id"]).drop("batch_id")


def process_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataFrame:
    """Apply a row transformation to everything new and return the processed table."""
    changed = transform(stream)
    append_to(changed, path, checkpoint)
    return _read_or_empty(stream.sparkSession, path, changed.schema)


def append_versions(stream: DataFrame, key: str, order: list[str], path: str, checkpoint: str,
                    first: DataFrame) -> DataFrame:
    """Store a stream of events with gapless versions and return the store; ``first`` is an empty store.

    The versions reached are state per key, kept in the checkpoint, so a
    restart goes on from them and what is stored is not read again.
    """
    with keyed_state(stream.sparkSession):
        append_to(versioned(stream, key, order), path, checkpoint)
    return _read_or_empty(stream.sparkSession, path, first.schema)
