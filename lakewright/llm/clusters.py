"""Centroid clustering in whole numbers; vectors find their centroid by Orchard's search of sorted neighbour lists."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from lakewright.llm.common import Steps

LENGTH, CLUSTERS, ROUNDS, SCALE = 64, 40, 5, 256


def largest(length: int) -> int:
    """Components are held within this bound on either side, so that four times a squared distance fits 64 bits."""
    return math.isqrt((1 << 60) // length) // 2


def whole_vectors(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", length: int = LENGTH) -> DataFrame:
    """(vec_id, v array<int>): the usable vectors, each component x as floor(256 * x)."""
    x, bound = F.col(vector_col), largest(length)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    # In doubles first: a large component fits no whole number before it is held within the bound.
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c.cast("double") * SCALE).cast("double"), F.lit(float(bound))), F.lit(float(-bound))).cast("int"))
    return embeddings.where((F.size(x) == length) & finite).select(F.col(id_col).alias("vec_id"), whole.alias("v"))


def neighbour_lists(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per centroid all centroids by distance from it, and those squared distances."""
    gaps = np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids], np.int64).reshape(len(centroids), len(centroids))
    order = np.argsort(gaps, axis=1, kind="stable")
    return order, np.take_along_axis(gaps, order, axis=1)


def nearest(vectors: np.ndarray, centroids: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equally near ones the smallest number) and its squared distance.

    Each vector walks the list of its best centroid so far, skips what it has
    visited, goes over to the list of a closer centroid as soon as it meets one,
    and stops where a list is more than twice as far from the centroid as the
    vector is: beyond, no centroid is as near. All vectors take a step at once.
    """
    order, gaps = lists
    n, k = len(vectors), len(centroids)
    best, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
    distance = ((vectors - centroids[0]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    walking = np.arange(n)
    while len(walking):
        walking = walking[gaps[best[walking], place[walking]] <= 4 * distance[walking]]
        met = order[best[walking], place[walking]]
        place[walking] += 1
        fresh = ~seen[walking, met]
        who, which = walking[fresh], met[fresh]
        seen[who, which] = True
        far = ((vectors[who] - centroids[which]) ** 2).sum(axis=1)
        closer = (far < distance[who]) | ((far == distance[who]) & (which < best[who]))
        who = who[closer]
        best[who], distance[who], place[who] = which[closer], far[closer], 0
        walking = walking[place[walking] < k]
    return best, distance


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, length).astype(np.int64)


def _assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    length, lists = centroids.shape[1], neighbour_lists(centroids)

    def run(batches):
        for batch in batches:
            best, distance = nearest(_matrix(batch.column("v"), length), centroids, lists)
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": pa.array(best, pa.int32()), "distance": pa.array(distance)})

    return vectors.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long")


def _moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. A task gives one row of sums per centroid; Spark adds them up."""
    k, length = centroids.shape
    lists = neighbour_lists(centroids)

    def run(batches):
        sums, n = np.zeros((k, length), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            rows = _matrix(batch.column("v"), length)
            best, _ = nearest(rows, centroids, lists)
            np.add.at(sums, best, rows)
            n += np.bincount(best, minlength=k)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(n[some]),
                                          "sums": pa.array(list(sums[some]), pa.list_(pa.int64()))})

    partial = vectors.select("v").mapInArrow(run, "cluster int, n long, sums array<long>")
    total = partial.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(length)])
    after = centroids.copy()
    for r in total.collect():  # one row per centroid
        after[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(length)]
    return after


def cluster(embeddings: DataFrame, *, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "2", id_col: str = "vec_id",
            vector_col: str = "embedding", length: int = LENGTH) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Usable are vectors of exactly ``length`` components, none null or not
    finite; others give no row. Components count as floor(256 * x), held within
    ``largest(length)`` on either side (2**26 for 64 components), beyond which
    squared distances would not fit 64 bits. The ``k`` vectors whose
    ``seed:vec_id`` has the least SHA-256 are the first centroids (of equal ids
    the smaller vector first, a null id counts as empty); with fewer vectors
    there are fewer centroids. Each round assigns all vectors and moves every
    centroid that has some to the floor of their mean; then all are assigned
    once more. Rows that repeat are vectors of their own. Sums that do not fit a
    long are null. No usable vectors give no rows; other columns are ignored.

    Only the ``k`` centroids and their sums come to the driver, whatever the
    number of vectors; a hot cluster is summed within each task first.
    """
    steps = Steps(embeddings.sparkSession, "clusters")
    vectors = steps.write("vectors", whole_vectors(embeddings, id_col=id_col, vector_col=vector_col, length=length))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.orderBy(name, "v").limit(k).select("v").collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, length)
    for _ in range(rounds if len(first) else 0):
        centroids = _moved(vectors, centroids)
    assigned = steps.write("assigned", _assigned(vectors, centroids))
    steps.drop("vectors")
    exact = F.sum(F.col("distance").cast("decimal(20,0)"))
    within = assigned.groupBy("cluster").agg(exact.alias("sum"))
    rows = [Row(number=c, centroid_sha256=hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    names = embeddings.sparkSession.createDataFrame(rows, "number int, centroid_sha256 string")
    # One row per centroid: k rows at most.
    summary = within.join(F.broadcast(names), F.col("cluster") == F.col("number")).select(
        "number", "sum", "centroid_sha256").crossJoin(F.broadcast(within.agg(F.sum("sum").alias("all"))))
    return assigned.join(F.broadcast(summary), F.col("cluster") == F.col("number")).select(
        "vec_id", "cluster", "distance", F.col("sum").try_cast("long").alias("cluster_inertia"), F.col("all").try_cast("long").alias("inertia"), "centroid_sha256")
