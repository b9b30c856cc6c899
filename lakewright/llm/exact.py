"""Exact duplicates by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewright.llm.chunks import DIGEST_BYTES, clashing, digest, distinct_batch
from lakewright.llm.common import SPACE_BYTES, STEP_BYTES, Steps, keyed, mixed, rows_by_key, text_step
from lakewright.operators.windows import match

#: A chunk ends where the hash of the last 16 bytes is rare enough, but not before and not long after these sizes.
LEAST_CHUNK, MOST_CHUNK, RARE_BITS = 256, 8192, 10
_GEAR = (mixed(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
#: Bytes of text per step; a frequent chunk leaves a step once.
_STEP = 8 << 20


def _cuts(data: np.ndarray) -> list[int]:
    """Where the hash of the last 16 bytes is rare enough for a cut, by pieces: its arrays are many times their text.

    The rolling hash sums shifted byte values, built by doubling the width.
    """
    found = []
    for a in range(0, len(data), STEP_BYTES):
        before = min(a, 15)
        rolling = _GEAR[data[a - before:a + STEP_BYTES]]
        for width in (1, 2, 4, 8):
            wider = rolling.copy()
            wider[width:] += rolling[:-width] << np.uint32(width)
            rolling = wider
        found.append(np.flatnonzero(rolling[before:] >> np.uint32(32 - RARE_BITS) == 0) + (a + 1))
    return np.concatenate(found).tolist() if found else []


def chunk_ends(texts: list[bytes]) -> list[list[int]]:
    """The ends of the chunks of each text.

    The first cut lies behind ``LEAST_CHUNK`` bytes, so no window of it reaches
    into the text before.
    """
    cuts = _cuts(np.frombuffer(b"".join(texts), np.uint8))
    ends, base = [], 0
    for text in texts:
        size, own, at = len(text), [], 0
        while at < size:
            k = bisect_left(cuts, base + at + LEAST_CHUNK)
            cut = cuts[k] - base if k < len(cuts) else size
            at = min(cut, at + MOST_CHUNK, size)
            own.append(at)
        ends.append(own)
        base += size
    return ends


def _normal(batch: pa.RecordBatch) -> tuple[list[str], list[bytes]]:
    texts = [t or "" for t in batch.column("text").to_pylist()]
    return texts, [t.encode().translate(None, SPACE_BYTES) for t in texts]


def _cut(plain: list[bytes]) -> list[list[bytes]]:
    return [[p[a:b] for a, b in zip([0, *e[:-1]], e)] for p, e in zip(plain, chunk_ends(plain))]


def recipes(documents: DataFrame, *, digest_bytes: int = DIGEST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, text_sha256, recipe): the ordered chunk digests of each text without its white space."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, plain = _normal(batch)
        lists = [[digest(c, digest_bytes) for c in cs] for cs in _cut(plain)]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "text_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in plain]), "recipe": pa.array(lists, pa.list_(pa.binary()))})

    source = documents.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    return text_step(source, "text", work, f"doc_id {dict(source.dtypes)['doc_id']}, n_chars long, text_sha256 string, recipe array<binary>",
                     _STEP)


def _chunks(documents: DataFrame, digest_bytes: int, text_col: str) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        cut = [c for cs in _cut(_normal(batch)[1]) for c in cs]
        return distinct_batch([digest(c, digest_bytes) for c in cut], cut)

    source = documents.selectExpr(f"cast(`{text_col}` as string) as text").where("text is not null")
    return text_step(source, "text", work, "digest binary, chunk binary", _STEP)


def exact_duplicates(documents: DataFrame, *, digest_bytes: int = DIGEST_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal if they are after deletion of blanks, tabs and line ends.
    Each text is cut into chunks by content. Chunks of the same digest are
    compared by their bytes once, which moves every distinct chunk once; from
    then on a text is its list of chunk identifiers, and equal lists are equal
    texts. Should a digest stand for different bytes, the texts that hold it are
    compared whole.

    Of a group the row with the most code points stays, of those the one with
    the smallest id (null last); of repeated rows one stays. Null text counts as
    empty. No rows give no rows; other columns of the input are ignored.
    """
    steps = Steps(documents.sparkSession, "exact")
    listed = steps.write("recipes", recipes(documents, digest_bytes=digest_bytes, id_col=id_col, text_col=text_col)
                         .withColumn("row", F.monotonically_increasing_id()))
    clashes = steps.write("clashes", clashing(_chunks(documents, digest_bytes, text_col)))
    keys = ["recipe"]
    if not clashes.isEmpty():
        doubtful = (listed.select("row", F.explode("recipe").alias("digest")).join(clashes, "digest", "left_semi")
                    .select("row").distinct().withColumn("_doubtful", F.lit(True)))
        plain = documents.select(F.col(id_col).alias("_id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_n"), F.translate(
            F.coalesce(F.col(text_col).cast("string"), F.lit("")), SPACE_BYTES.decode(), "").alias("whole"))
        plain = plain.withColumn("_sha", F.sha2("whole", 256)).dropDuplicates(["_id", "_n", "_sha", "whole"])
        held = listed.join(doubtful, "row", "left")
        sure = held.where("_doubtful is null").withColumn("whole", F.lit(None).cast("string"))
        rest = held.where("_doubtful").join(
            plain, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("n_chars") == F.col("_n")) & (F.col("text_sha256") == F.col("_sha")))
        listed = steps.write("checked", sure.unionByName(rest.select(*sure.columns)).drop("_doubtful"))
        keys = ["recipe", "whole"]
    best = F.min(F.struct((-F.col("n_chars")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = listed.groupBy(*keys).agg(best.alias("_best"), F.count(F.lit(1)).alias("group_size"))
    return match(listed, groups, keys).select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("_best.row")).alias("kept"), "text_sha256")


def without_exact_duplicates(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with all their columns: one of each group of equal texts, whether ids are null, repeat or not.

    Rows are told apart by id and text, of rows with one id the hash of the text
    decides which comes first. Of rows with the same id and text one stays.
    """
    found = exact_duplicates(keyed(documents, id_col, text_col), **options).groupBy("doc_id").agg(
        F.bool_or("kept").alias("keep"), (F.count(F.lit(1)) > 1).alias("single"))
    return rows_by_key(documents, id_col, text_col, found.where("not keep or single"))
