"""Nearest vectors against distances to all vectors, and the recall of the index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewright.operators import nearest


def plain(vectors, queries, k):
    out = {}
    for q, query in queries:
        found = sorted((float(np.sqrt(((np.array(v) - query) ** 2).sum())), i) for i, v in vectors)
        out[q] = [(i, pytest.approx(d, abs=1e-9)) for d, i in found[:k]]
    return out


def listed(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.neighbor, r.distance))
    return out


@pytest.fixture(scope="module")
def groups(spark):
    """3000 vectors around 12 centres, and 60 queries near some of them."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (12, 10))
    vectors = [(i, (centres[i % 12] + rng.normal(0, 1, 10)).tolist()) for i in range(3000)]
    queries = [(100 + i, (np.array(vectors[i * 7][1]) + rng.normal(0, 0.3, 10)).tolist()) for i in range(60)]
    return vectors, queries, spark.createDataFrame(vectors, "id long, v array<double>").repartition(5), spark.createDataFrame(queries, "query_id long, query array<double>")


@pytest.mark.parametrize("block,chunk,held", [(512, 4096, 50_000), (7, 50, 3)])
def test_exact_search(groups, monkeypatch, block, chunk, held):
    for name, n in (("BLOCK", block), ("CHUNK", chunk), ("HELD", held)):
        monkeypatch.setattr(nearest, name, n)
    vectors, queries, df, asked = groups
    assert listed(nearest.l2_topk(df, "id", "v", asked, 5)) == plain(vectors, queries, 5)


def test_ties_nulls_and_other_lengths(spark):
    rows = [(3, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (4, None), (5, [1.0]), (6, [None, 1.0]), (7, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 2.0, 3.0])], "query_id long, query array<double>")
    want = {1: [(1, 1.0), (2, 1.0)]}
    assert listed(nearest.l2_topk(df, "id", "v", asked, 2)) == want == listed(nearest.cells_topk(nearest.build_cells(df, "id", "v"), asked, 2))
    for empty in (df.limit(0), df.where("id = 4")):
        assert listed(nearest.l2_topk(empty, "id", "v", asked, 2)) == {}
        assert listed(nearest.cells_topk(nearest.build_cells(empty, "id", "v"), asked, 2)) == {}
    assert listed(nearest.l2_topk(df, "id", "v", asked.limit(0), 2)) == {}


def recall(found, exact):
    return sum(len({i for i, _ in found[q]} & {i for i, _ in rows}) for q, rows in exact.items()) / sum(map(len, exact.values()))


def test_the_index_holds_every_vector_and_finds_nine_of_ten(groups, monkeypatch):
    monkeypatch.setattr(nearest, "CHUNK", 100)
    vectors, queries, df, asked = groups
    index = nearest.build_cells(df, "id", "v", sample=800)
    held = index.chunks.select("cell", F.explode("ids").alias("id"))
    assert held.count() == held.select("id").distinct().count() == len(vectors)
    exact = listed(nearest.l2_topk(df, "id", "v", asked, 10))
    found = listed(nearest.cells_topk(index, asked, 10, probes=12))
    assert recall(found, exact) >= 0.9
    distances = {i: np.array(v) for i, v in vectors}
    assert all(d == pytest.approx(np.linalg.norm(distances[i] - dict(queries)[q])) for q, rows in found.items() for i, d in rows)
    assert recall(listed(nearest.cells_topk(index, asked, 10, probes=10 ** 6)), exact) >= 0.99


def test_recall_over_the_given_vectors(spark, tables):
    """Every twentieth vector of sf0.01 as a query."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact = listed(nearest.l2_topk(vectors, "vec_id", "embedding", asked, 10))
    assert recall(listed(nearest.cells_topk(nearest.build_cells(vectors, "vec_id", "embedding"), asked, 10)), exact) >= 0.9
