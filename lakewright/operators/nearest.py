"""Nearest vectors, exactly and by an index of cells, and nearest places."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.windows import top_per_key
from lakewright.sources.tables import durable

#: Queries of a block, vectors of a chunk, and queries whose best a task holds before it gives them out.
BLOCK, CHUNK, HELD = 512, 4096, 50_000
#: Vectors that the cells and codes are learned from, at most; cells at most; parts of a code and values of a part.
SAMPLE, CELLS, PARTS, CODES = 20_000, 256, 8, 256
#: Vectors of a chunk, at least and per wanted neighbour, that are measured exactly after the codes have ranked them.
RERANKED, RERANKED_PER_K = 64, 8


def _width(vectors: DataFrame, vector: str) -> int:
    """Components of most vectors; others are left out."""
    sizes = vectors.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count()
    first = sizes.orderBy(F.desc("count"), "n").limit(1).collect()
    return first[0].n if first else 0


def _usable(vectors: DataFrame, id_: str, vector: str, width: int) -> DataFrame:
    whole = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull())
    return vectors.where(whole).select(F.col(id_).alias("id"), F.col(vector).cast("array<double>").alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _packed(rows: DataFrame, width: int, most: int, group: str) -> DataFrame:
    """(group, ids, matrix[, codes]) of up to ``most`` neighbouring rows with one group each."""
    coded = "codes" in rows.columns

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(group).to_numpy()
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            out: list[pa.RecordBatch] = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]):
                for at in range(a, b, most):
                    part = batch.slice(at, min(most, b - at))
                    ids = part.column("id")
                    held = {group: part.column(group).slice(0, 1), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                            "matrix": pa.array([_matrix(part.column("vector"), width).tobytes()], pa.binary())}
                    if coded:
                        held["codes"] = pa.array([b"".join(part.column("codes").to_pylist())], pa.binary())
                    out.append(pa.RecordBatch.from_pydict(held))
            yield from out

    types = dict(rows.dtypes)
    return rows.mapInArrow(pack, f"{group} {types[group]}, ids array<{types['id']}>, matrix binary" + ", codes binary" * coded)


class _Best:
    """The nearest ``k`` of each query that a task has met."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, query, distances: np.ndarray, ids: list) -> None:
        rows = self.held.setdefault(query, [])
        rows += zip(distances.tolist(), ids)
        rows.sort()
        del rows[self.k:]

    def given(self, ids: pa.DataType, queries: pa.DataType) -> pa.RecordBatch:
        rows = [(q, i, d) for q, found in self.held.items() for d, i in found]
        self.held = {}
        q, i, d = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(q, queries), pa.array(i, ids), pa.array(d, pa.float64())], ["query_id", "neighbor", "distance"])


def _ranked(pairs: DataFrame, width: int, k: int, measure) -> DataFrame:
    """The ``k`` nearest per query from rows that pair a chunk with a block of queries."""
    types = dict(pairs.dtypes)
    ids, queries = (types[c][len("array<"):-1] for c in ("ids", "query_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kinds = _Best(k), None
        for batch in batches:
            kinds = batch.column("ids").type.value_type, batch.column("query_ids").type.value_type
            for r in range(batch.num_rows):
                points = np.frombuffer(batch.column("matrix")[r].as_py(), np.float64).reshape(-1, width)
                asked = np.frombuffer(batch.column("queries")[r].as_py(), np.float64).reshape(-1, width)
                names = batch.column("ids")[r].as_py()
                for n, (query_id, query) in enumerate(zip(batch.column("query_ids")[r].as_py(), asked)):
                    near = measure(batch, r, n, query, points)
                    distance = np.sqrt(((points[near] - query) ** 2).sum(axis=1))
                    if len(near) > k:
                        # All that tie with the last of the best stay until ids decide.
                        kept = distance <= np.partition(distance, k - 1)[k - 1]
                        near, distance = near[kept], distance[kept]
                    best.add(query_id, distance, [names[i] for i in near.tolist()])
                if len(best.held) > HELD:
                    yield best.given(*kinds)
        if best.held:
            yield best.given(*kinds)

    local = pairs.mapInArrow(run, f"query_id {queries}, neighbor {ids}, distance double")
    return top_per_key(local, ["query_id"], [F.col("distance").asc(), F.col("neighbor").asc()], k)


def _blocks(queries: DataFrame, width: int, group: str) -> DataFrame:
    """Queries (group, id, vector) in blocks (group, query_ids, queries), sorted so that a group lies together."""
    sizes = queries.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_parts"))
    dealt = queries.join(sizes, group).withColumn("_part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("_parts")))
    rows = dealt.repartition(group, "_part").sortWithinPartitions(group, "_part").select(group, "id", "vector")
    return _packed(rows, width, BLOCK, group).withColumnsRenamed({"ids": "query_ids", "matrix": "queries"})


def l2_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, slice_size: int | None = None) -> DataFrame:
    """The ``k`` vectors nearest to each query (query_id, query) by Euclidean distance, exactly: (query_id, neighbor, distance, rank).

    Queries are numbered blocks of about ``slice_size``, vectors are chunks, and Spark joins each chunk
    to every block by its number: blocks that are small travel to the chunks,
    otherwise both are shuffled. A task keeps the best ``k`` per query over all
    it meets, so only those meet in the shuffle. Equal distances are ranked by
    id. Vectors and queries that are null, have null components or another
    length than most vectors are left out.
    """
    width = _width(vectors, vector)
    asked = _usable(queries, "query_id", "query", width)
    n = -(-asked.count() // (slice_size or BLOCK))
    numbered = durable(_blocks(asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(n, 1))).cast("int")), width, "block"))
    chunks = _packed(_usable(vectors, key, vector, width).withColumn("chunk", F.lit(0)), width, CHUNK, "chunk").drop("chunk")
    met = chunks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))).join(numbered, "block").drop("block")
    return _ranked(met, width, k, lambda batch, r, n, query, points: np.arange(len(points)))


def _means(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced first centres."""
    centres = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _closest(points, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


@dataclass(frozen=True)
class CellIndex:
    """Chunks (cell, ids, matrix, codes) of all vectors, the centres of the cells and the values of each part of a code."""

    chunks: DataFrame
    centres: np.ndarray
    values: list[np.ndarray]

    @property
    def width(self) -> int:
        return self.centres.shape[1]


def build_cells(vectors: DataFrame, key: str, vector: str, *, cells: int | None = None, sample: int = SAMPLE, parts: int = PARTS) -> CellIndex:
    """Index every vector: the cell whose centre is nearest, and its distance from there as a product-quantised code.

    Centres and code values are learned from the ``sample`` vectors with the
    least hash of their id; everything else runs over all vectors. There are as
    many cells as the root of the number of vectors, at most ``CELLS``, unless given. A
    cell of any size is split into chunks. Vectors that are null, have null
    components or another length than most are left out.
    """
    width = _width(vectors, vector)
    rows = _usable(vectors, key, vector, width)
    first = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").collect()  # bounded by ``sample``
    learned = np.array([r[0] for r in first], np.float64).reshape(len(first), width)
    n = rows.count()
    k = min(cells or min(CELLS, max(1, round(n ** 0.5))), max(1, len(learned)))
    centres = _means(learned, k) if len(learned) else np.zeros((1, width))
    rest = learned - centres[_closest(learned, centres)]
    places = [p for p in np.array_split(np.arange(width), parts) if len(p)] or [np.arange(width)]
    values = [_means(rest[:, p], min(CODES, len(rest))) if len(rest) else np.zeros((1, len(p))) for p in places]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("vector"), width)
            own = _closest(points, centres)
            apart = points - centres[own]
            codes = np.stack([_closest(apart[:, p], v) for p, v in zip(places, values)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(own, pa.int32()), "id": batch.column("id"), "vector": batch.column("vector"),
                                              "codes": pa.array([c.tobytes() for c in codes], pa.binary())})

    coded = durable(rows.mapInArrow(code, f"cell int, id {dict(rows.dtypes)['id']}, vector array<double>, codes binary"))
    sizes = coded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_parts"))
    dealt = coded.join(sizes, "cell").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    laid = dealt.repartition("cell", "_part").sortWithinPartitions("cell", "_part").select("cell", "id", "vector", "codes")
    return CellIndex(durable(_packed(laid, width, CHUNK, "cell")), centres, values)


def cells_topk(index: CellIndex, queries: DataFrame, k: int, probes: int = 16) -> DataFrame:
    """The ``k`` nearest vectors of each query (query_id, query) among those in its ``probes`` nearest cells.

    Queries meet the chunks of their cells in a Spark join. In a chunk the
    codes rank all vectors, and the best are measured exactly. A query whose
    length is not the vectors' is left out. Distances are exact, recall depends on ``probes``.
    """
    centres, width, values = index.centres, index.width, index.values
    places = np.array_split(np.arange(width), len(values))
    most = min(probes, len(centres))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _matrix(batch.column("vector"), width)
            far = (centres ** 2).sum(axis=1) - 2 * points @ centres.T
            cells = np.argpartition(far, most - 1, axis=1)[:, :most] if len(points) else np.zeros((0, most), int)
            again = pa.array(np.repeat(np.arange(len(points)), most))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells.ravel(), pa.int32()), "id": batch.column("id").take(again), "vector": batch.column("vector").take(again)})

    asked = _usable(queries, "query_id", "query", width)
    probed = asked.mapInArrow(probe, f"cell int, id {dict(asked.dtypes)['id']}, vector array<double>")
    pairs = index.chunks.join(_blocks(durable(probed), width, "cell"), "cell")

    def by_code(batch: pa.RecordBatch, r: int, n: int, query: np.ndarray, points: np.ndarray) -> np.ndarray:
        wanted = max(RERANKED, RERANKED_PER_K * k)
        if len(points) <= wanted:
            return np.arange(len(points))
        apart = query - centres[batch.column("cell")[r].as_py()]
        codes = np.frombuffer(batch.column("codes")[r].as_py(), np.uint8).reshape(len(points), len(values))
        rough = sum(((v - apart[p]) ** 2).sum(axis=1)[codes[:, j]] for j, (p, v) in enumerate(zip(places, values)))
        return np.sort(np.argpartition(rough, wanted - 1)[:wanted])

    return _ranked(pairs, width, k, by_code)


# Fixed value: mean radius of the earth in kilometres.
EARTH_KM = 6371.0


def planar_distance(lon: Column, lat: Column, x: float, y: float) -> Column:
    """Distance in degrees, as for plain coordinates."""
    return F.sqrt((lon - x) * (lon - x) + (lat - y) * (lat - y))


def haversine_km(lon: Column, lat: Column, x: float, y: float) -> Column:
    a = (F.pow(F.sin(F.radians(lat - y) / 2), F.lit(2.0))
         + F.cos(F.radians(F.lit(y))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon - x) / 2), F.lit(2.0)))
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * 2 * EARTH_KM


def places_topk(places: DataFrame, key: str, x: float, y: float, k: int) -> DataFrame:
    """The ``k`` places (lon, lat) nearest to a point."""
    lon, lat = F.col("lon"), F.col("lat")
    return (places.withColumn("distance", planar_distance(lon, lat, x, y))
            .withColumn("distance_km", haversine_km(lon, lat, x, y))
            .orderBy("distance", key).limit(k))
