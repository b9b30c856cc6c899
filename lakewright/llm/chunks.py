"""Chunk identifiers that have been verified by comparing bytes."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGEST_BYTES = 16


def digest(chunk: bytes, width: int = DIGEST_BYTES) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:width]


def distinct_batch(digests: list[bytes], chunks: list[bytes]) -> pa.RecordBatch:
    """One row per distinct (digest, chunk) of a step, so that a frequent chunk leaves it once."""
    pairs = dict.fromkeys(zip(digests, chunks))
    return pa.RecordBatch.from_pydict({"digest": pa.array([d for d, _ in pairs], pa.binary()),
                                       "chunk": pa.array([c for _, c in pairs], pa.binary())})


def clashing(chunks: DataFrame) -> DataFrame:
    """Digests that stand for more than one byte string.

    Grouping by the bytes themselves compares them; equal chunks meet once per
    task before the shuffle, so a chunk of half of all documents is no hot key.
    """
    distinct = chunks.select("digest", "chunk").distinct()
    return distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest")
