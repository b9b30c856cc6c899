"""Helpers of the training-data operators: texts in Arrow batches, words as numbers, written steps."""

from __future__ import annotations

import contextlib
import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakewright.operators.windows import top_per_key
from lakewright.sources.tables import remove_at_exit, scratch_path

#: A word is a run of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
#: Bytes of text that one numpy step handles at once, so that its arrays stay in the processor's cache. One longer
#: text forms a step of its own.
STEP_BYTES = 1 << 18
#: Steps of operators that look up every different part of a step once.
WIDE_STEP_BYTES = 1 << 21

#: Documents are large rows: a batch that Spark hands to Python is bounded by this size instead of 64 MB.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def process_store() -> dict:
    """A dictionary that lives as long as the worker process, whichever task runs in it.

    Functions travel by value, so a module global would be new in every task.
    """
    return vars(sys).setdefault("_lakewright_llm", {})


def _start_step(step: str) -> None:
    """Let go of the tables that another step left in this worker.

    Workers outlive their stage, and the tables of all steps they ran would add up.
    """
    store = process_store()
    if store.get("step") != step:
        store.clear()
        store["step"] = step


def step_ranges(sizes: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes add up to at most ``limit``, or one row each."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n + 1 offsets of its rows; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def text_step(df: DataFrame, text: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str,
              limit: int = STEP_BYTES) -> DataFrame:
    """Run ``work`` on slices of Arrow batches that hold at most ``limit`` bytes of ``text``.

    Sets the session's batch size, as Spark reads it when the result is used.
    """
    df.sparkSession.conf.set(_BATCH, BATCH_BYTES)
    names = [f.name for f in _fields(df.sparkSession, schema)]
    step = f"{work.__module__}.{work.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _start_step(step)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(utf8(batch.column(text))[1])
            for a, b in step_ranges(sizes, limit):
                out = work(batch.slice(a, b - a))
                if out is not None and out.num_rows:
                    yield out.select(names)

    return df.mapInArrow(run, schema)


def _fields(spark: SparkSession, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit numbers; the finalizer of splitmix64 (fixed constants)."""
    x = x.astype(np.uint64, copy=True)
    x += _ODD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, kept per process."""
    held = process_store().get("powers")
    if held is None or len(held[0]) < n:
        size = max(n, WIDE_STEP_BYTES + 1)
        base = 0xD6E8FEB86659FD93
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            held = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 4 * WIDE_STEP_BYTES:
            process_store()["powers"] = held
    return held


_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every row, and the n + 1 word offsets of the rows."""
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    # A row may begin right behind a word of the row before.
    cut = edges[inside[edges] & inside[edges - 1]]
    first[cut] = True
    last[cut - 1] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


#: Spans are hashed by a polynomial modulo this prime, at a base drawn from a seed: two different spans of n bytes agree
#: for at most n of its bases.
_PRIME = (1 << 61) - 1
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
_P, _61, _31, _30 = np.uint64(_PRIME), np.uint64(61), np.uint64(31), np.uint64(30)
HASH_SEED = "spans"
#: Sums of longer spans of bytes, and of characters, would not fit; such spans are hashed one by one.
LONG_BYTES, LONG_CHARACTERS = 1 << 24, 1 << 11


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for numbers below it, by halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << np.uint64(1)) + (middle >> _30) + ((middle & _LOW30) << _31) + _reduced(a0 * b0))


def _span_powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low 31 and high bits of the base's powers, and the powers of its inverse; kept per process."""
    held = process_store().get("span powers")
    if held is None or len(held[0]) < n:
        base = 2 + int.from_bytes(hashlib.sha256(HASH_SEED.encode()).digest()[:8], "little") % (_PRIME - 3)
        made = []
        for b in (base, pow(base, -1, _PRIME)):
            powers = np.ones(1, np.uint64)
            while len(powers) < max(n, STEP_BYTES + 2):
                factor, more = np.uint64(pow(b, len(powers), _PRIME)), np.empty(2 * len(powers), np.uint64)
                more[:len(powers)] = powers
                # By pieces, as a product takes ten arrays of its size for a moment.
                for a in range(0, len(powers), 1 << 15):
                    piece = powers[a:a + (1 << 15)]
                    more[len(powers) + a:len(powers) + a + len(piece)] = _product(piece, factor)
                powers = more
            made.append(powers)
        held = made[0] & _LOW31, made[0] >> _31, made[1]
        if len(held[0]) <= 4 * WIDE_STEP_BYTES:
            process_store()["span powers"] = held
    return held


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte (or character) range, from running sums over all of them.

    Depends on the range's content alone. Where equal hashes decide a result,
    ``unequal`` compares the ranges themselves.
    """
    low, high, inverse = _span_powers(len(data) + 1)
    n = len(data)
    values = data.astype(np.uint16 if data.dtype == np.uint8 else np.uint32) + data.dtype.type(1)
    with np.errstate(over="ignore"):
        lows, highs = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        for parts, sums in ((low, lows), (high, highs)):  # in place, as a step's arrays are many times its text
            np.multiply(values, parts[:n], out=sums[1:])
            np.cumsum(sums[1:], out=sums[1:])
        # Sums wrap modulo 2**64; those of a span do not reach it.
        upper = _reduced(highs[ends] - highs[starts])
        upper = (upper >> _30) + ((upper & _LOW30) << _31)
        value = _product(_reduced(upper + _reduced(lows[ends] - lows[starts])), inverse[starts])
        sizes = (ends - starts).astype(np.uint64)
        out = mixed(value + sizes * _ODD)
    for k in np.flatnonzero(ends - starts > (LONG_BYTES if data.dtype == np.uint8 else LONG_CHARACTERS)):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k]:ends[k]].tobytes())
    return out


def unequal(data: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which ranges of ``sizes`` from ``starts`` on differ from those from ``others`` on."""
    out = np.zeros(len(starts), bool)
    some = np.flatnonzero(sizes > 0)
    for a, b in step_ranges(sizes[some], WIDE_STEP_BYTES):
        k = some[a:b]
        first = np.cumsum(sizes[k]) - sizes[k]
        at = np.arange(int(sizes[k].sum())) - np.repeat(first, sizes[k])
        differs = data[np.repeat(starts[k], sizes[k]) + at] != data[np.repeat(others[k], sizes[k]) + at]
        out[k] = np.logical_or.reduceat(differs, first)
    return out


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes from each position on."""
    n = len(data) - length + 1
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
        return mixed((total[length:] - total[:n]) * down[:n])


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


@contextlib.contextmanager
def shuffles_released(spark: SparkSession):
    """Within it, shuffle files go as soon as the job that wrote them has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Steps:
    """Tables written between the steps of one operator, in the folder all executors share.

    A step that a later written step has used up can be dropped. The ones that
    the returned result still reads stay until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = name
        self.paths: dict[str, str] = {}

    def write(self, step: str, df: DataFrame) -> DataFrame:
        path = self.paths[step] = scratch_path(self.spark, f"{self.name}-{step}")
        with shuffles_released(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        remove_at_exit(self.spark, path)
        return self.spark.read.parquet(path)

    def drop(self, *steps: str) -> None:
        jvm = self.spark._jvm
        for step in steps:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(step))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sample_by_hash(df: DataFrame, key: str, place: str, n: int) -> DataFrame:
    """At most ``n`` rows of each ``key``, those with the least hash ``place``.

    A threshold per key, from its count, leaves about twice the rows wanted, so
    the exact choice that follows never sees a whole key. For few keys (classes).
    """
    share = F.lit(0)
    for value, count in df.groupBy(key).count().collect():
        share = F.when(F.col(key).eqNullSafe(F.lit(value)), F.lit(min(1 << 20, 1 + (2 * n << 20) // count))).otherwise(share)
    rest = [F.col(c) for c in df.columns if c not in (key, place)]
    return top_per_key(df.where(F.pmod(F.col(place), F.lit(1 << 20)) < share), [key], [F.col(place), *rest], n)


def word_count(text: str = "text"):
    """Number of words of a text column; null counts as no word."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def row_key(id_: Column, text: Column) -> Column:
    """What tells rows apart where ids are null or repeat: the id (null last) and half of the whole text's SHA-256.

    Never null itself; only rows with the same id and the same text share one.
    """
    return F.struct(id_.isNull().alias("no_id"), id_.alias("id"), F.substring(F.unhex(F.sha2(text.cast("string"), 256)), 1, 16).alias("text_hash"))


def keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) with the row's key as its id."""
    return documents.select(row_key(F.col(id_col), F.col(text_col)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def rows_by_key(documents: DataFrame, id_col: str, text_col: str, chosen: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose key has a verdict that keeps them, with all their columns.

    ``chosen`` holds (doc_id, keep, single) for keys that need one: those with
    keep false go, of those with single true one row stays, and keys without a
    row in it stay as they are. Rows of one key have the same id and text; of
    them the one whose other columns come first as JSON stays. Columns go by
    position, so names cannot clash.
    """
    held = documents.toDF(*[f"c{k}" for k in range(len(documents.columns))])
    own, text = (f"c{documents.columns.index(c)}" for c in (id_col, text_col))
    verdict = chosen.select(F.col("doc_id").alias("v_id"), F.col("keep").alias("v_keep"), F.col("single").alias("v_single"))
    # By merge at every size: the verdicts of a large corpus fit no broadcast.
    marked = held.withColumn("key", row_key(F.col(own), F.col(text))).join(verdict.hint("merge"), F.col("key") == F.col("v_id"), "left")
    plain = marked.where("v_keep is null or (v_keep and not v_single)").select(*held.columns)
    rest = [c for c in held.columns if c not in (own, text)]
    order = F.to_json(F.struct(*rest)) if rest else F.lit("")
    one = marked.where("v_keep and v_single").groupBy("key").agg(F.min_by(F.struct(*held.columns), order).alias("row")).select("row.*")
    return plain.unionByName(one).toDF(*documents.columns)
