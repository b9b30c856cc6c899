"""Centroid clustering against plain distances to all centroids."""

import hashlib
import math
import random

import numpy as np
import pytest

from lakewright.llm import clusters
from tests.llm.helpers import NAMES, collected


def plain(rows, k, rounds, length):
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [max(-clusters.largest(length), min(clusters.largest(length), math.floor(256 * x))) for x in v]))
    kept.sort(key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in kept[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        held = [[] for _ in centroids]
        for _, v in kept:
            held[place(v)[1]].append(v)
        centroids = [[sum(x) // len(h) for x in zip(*h)] if h else c for h, c in zip(held, centroids)]
    out = [(i, *place(v)[::-1]) for i, v in kept]
    sums = {j: sum(d for _, c, d in out if c == j) for _, j, _ in out}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fits = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, d, fits(sums[c]), fits(sum(sums.values())), names[c]) for i, c, d in out), key=repr)


def check(df, k=clusters.CLUSTERS, rounds=clusters.ROUNDS, length=clusters.LENGTH):
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    got = clusters.cluster(df, k=k, rounds=rounds, length=length)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, k, rounds, length)


def test_given_vectors(tables):
    check(tables.embeddings, k=12, rounds=3)


@pytest.mark.parametrize("span", [1, 30, 4000])
def test_search_finds_the_nearest(span):
    rng = np.random.default_rng(span)
    vectors, centroids = rng.integers(-span, span + 1, (700, 6)), rng.integers(-span, span + 1, (40, 6))
    best, distance = clusters.nearest(vectors, centroids, clusters.neighbour_lists(centroids))
    every = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()


def test_the_search_skips_far_centroids():
    rng = np.random.default_rng(4)
    centroids = np.concatenate([rng.integers(0, 9, (20, 4)), rng.integers(10 ** 6, 10 ** 6 + 9, (20, 4))])
    order, gaps = clusters.neighbour_lists(centroids)
    order = order.copy()
    # Lists whose far half leads nowhere still give the same, as it is never read.
    order[:, 20:] = -10 ** 6
    best, _ = clusters.nearest(rng.integers(0, 9, (50, 4)), centroids, (order, gaps))
    assert (best < 20).all()


def test_odd_vectors_ties_and_names(spark):
    rng = random.Random(8)
    rows = [(i, [rng.choice([0.0, 0.004, -0.004, 1.0, -1.0]) for _ in range(3)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [1.0, 2.0]), (63, [1.0, None, 2.0]), (64, [1.0, float("nan"), 2.0]), (65, [1.0, float("inf"), 2.0]),
             (66, [1.0, 2.0, 3.0, 4.0]), (None, [0.5, 0.5, 0.5]), (None, [0.25, 0.5, 0.5]), (3, [9.0, 9.0, 9.0]), (67, [3e38, -3e38, 0.0]), (68, [-3e38, 3e38, 1e30])]
    schema = "vec_id long, embedding array<float>, " + ", ".join(f"`{c}` string" for c in (*NAMES, "cluster", "distance", "v"))
    df = spark.createDataFrame([(*r, *["x"] * (len(NAMES) + 3)) for r in rows], schema).repartition(3)
    check(df, k=7, rounds=4, length=3)
    check(df.where("vec_id < 4"), k=7, rounds=2, length=3)
    check(df.where("vec_id is null"), k=7, rounds=2, length=3)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert collected(clusters.cluster(df)) == [] and collected(clusters.cluster(df.limit(0))) == []
