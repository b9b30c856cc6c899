"""Chunked window operators against plain windows, with several chunks and one very large key."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakewright.operators import windows as lw
from lakewright.operators.percentiles import percentiles
from lakewright.operators.timeseries import exponential_smoothing


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows has key 'hot', some keys are null, times tie and a third of the values is null."""
    rng = random.Random(7)
    data = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else rng.choice([None, "a", "b", "c", f"k{i % 40}"])
        data.append((i, key, rng.randrange(200), None if rng.random() < 0.33 else rng.randrange(1000)))
    return spark.createDataFrame(data, "id long, k string, t long, v long").cache()


def as_set(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(left, right):
    assert as_set(left) == as_set(right.select(left.columns))


def test_chunks_split_the_hot_key(rows):
    chunked = lw.ordered_chunks(rows, ["k"], ["t", "id"], 9)
    assert chunked.where("k = 'hot'").select(lw.CHUNK).distinct().count() >= 3
    assert lw.spanning_keys(chunked, ["k"]).count() < chunked.select(lw.CHUNK).distinct().count()


def test_row_numbers(rows):
    w = Window.partitionBy("k").orderBy("t", "id")
    same(lw.numbered(rows, ["k"], ["t", "id"], "n", 9).select("id", "n"),
         rows.select("id", F.row_number().over(w).cast("long").alias("n")))


def test_row_numbers_without_keys(rows):
    w = Window.partitionBy().orderBy("t", "id")
    same(lw.numbered(rows, [], ["t", "id"], "n", 9).select("id", "n"),
         rows.select("id", F.row_number().over(w).cast("long").alias("n")))


def test_running_aggregates_share_ties(rows):
    w = Window.partitionBy("k").orderBy("t")
    specs = {"s": ("sum", "v"), "n": ("count", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "m": ("avg", "v")}
    got = lw.running(rows, ["k"], "t", specs, 9).select("id", "s", "n", "lo", "hi", "m")
    want = rows.select("id", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n"), F.min("v").over(w).alias("lo"),
                       F.max("v").over(w).alias("hi"), F.avg("v").over(w).alias("m"))
    same(got, want)


def test_ranks(rows):
    w = Window.partitionBy("k").orderBy("t")
    same(lw.ranked(rows, ["k"], "t", 9).select("id", "rank", "dense_rank"),
         rows.select("id", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense_rank")))


@pytest.mark.parametrize("preceding,until", [(6, 0), (3, -1), (40, 0)])
def test_row_frames(rows, preceding, until):
    w = Window.partitionBy("k").orderBy("t", "id").rowsBetween(-preceding, until)
    got = lw.rows_frame(rows, ["k"], ["t", "id"], preceding, {"s": F.sum("v"), "n": F.count("v")}, until, 9).select("id", "s", "n")
    same(got, rows.select("id", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("n")))


@pytest.mark.parametrize("offset", [1, 4, -1, -3])
@pytest.mark.parametrize("skip", [False, True])
def test_lag_and_lead(rows, offset, skip):
    name = "lag" if offset > 0 else "lead"
    spec = f"{name}(v, {abs(offset)})" + (" IGNORE NULLS" if skip else "")
    want = rows.select("id", F.expr(f"{spec} OVER (PARTITION BY k ORDER BY t, id)").alias("x"))
    same(lw.shifted(rows, ["k"], ["t", "id"], "v", offset, "x", ignore_nulls=skip, chunks=9).select("id", "x"), want)


def test_lag_default(spark):
    df = spark.createDataFrame([(1, "a", 1, 5), (2, "a", 2, 6)], "id long, k string, t long, v long")
    got = lw.shifted(df, ["k"], ["t"], "v", 1, "x", default=-1, chunks=2).orderBy("id").select("x")
    assert [r.x for r in got.collect()] == [-1, 5]


def test_lag_skips_many_empty_chunks(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("t"), F.when(F.col("id") == 3, 33).alias("v"))
    got = lw.shifted(df, ["k"], ["t"], "v", 1, "x", ignore_nulls=True, chunks=16)
    assert got.where("t > 3 AND x = 33").count() == 996
    assert got.where("t <= 3 AND x IS NULL").count() == 4


def test_edges_and_latest(rows):
    full = Window.partitionBy("k").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same(lw.edge_value(rows, ["k"], ["t", "id"], "v", "x", ignore_nulls=True).select("id", "x"),
         rows.select("id", F.first("v", ignorenulls=True).over(full).alias("x")))
    same(lw.edge_value(rows, ["k"], ["t", "id"], "v", "x", last=True).select("id", "x"),
         rows.select("id", F.last("v").over(full).alias("x")))
    down = Window.partitionBy("k").orderBy(F.desc("t"), F.desc("id"))
    want = rows.withColumn("r", F.row_number().over(down)).where("r = 1").drop("r")
    same(lw.latest_per_key(rows, ["k"], ["t", "id"]), want)


def test_top_per_key(rows):
    w = Window.partitionBy("k").orderBy(F.desc("t"), "id")
    want = rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5")
    same(lw.top_per_key(rows, ["k"], [F.desc("t"), F.asc("id")], 5).select(*rows.columns, "rank"), want)


@pytest.mark.parametrize("alpha", [0.3, 0.999, 1.0, 0.001, 0.00001])
def test_smoothing_follows_the_recurrence(spark, alpha):
    rng = random.Random(3)
    series = {"hot": [rng.uniform(-50, 100) for _ in range(5000)], "a": [1.0], "b": [2.0, 4.0]}
    rows = [(k, i, x) for k, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(8)
    got = {(r.k, r.t): r.smoothed for r in exponential_smoothing(df, ["k"], ["t"], "x", alpha, chunks=7).collect()}
    assert len(got) == len(rows)
    for k, xs in series.items():
        s = xs[0]
        for i, x in enumerate(xs):
            s = x if i == 0 else alpha * x + (1 - alpha) * s
            assert got[(k, i)] == pytest.approx(s, rel=1e-9, abs=1e-9)


def test_smoothing_fixture(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 30.0)], "k string, t long, x double")
    got = exponential_smoothing(df, ["k"], ["t"], "x", 0.5).orderBy("t").collect()
    assert [r.smoothed for r in got] == [10.0, 15.0, 22.5]


@pytest.mark.parametrize("crowd,bins", [(65536, 4096), (20, 8), (2, 3), (1, 1)])
def test_percentiles(spark, crowd, bins):
    import numpy as np

    rng = random.Random(1)
    data = [("hot", rng.expovariate(0.01)) for _ in range(700)] + [("hot", 1e9)] + [("one", 5.0)] + [(None, float(i % 7)) for i in range(90)]
    data += [("nulls", None)] * 3
    df = spark.createDataFrame(data, "k string, v double")
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    for discrete in (False, True):
        got = {r.k: r for r in percentiles(df, ["k"], "v", probs, discrete, bins, crowd).collect()}
        assert set(got) == {"hot", "one", None, "nulls"}
        assert all(got["nulls"][name] is None for name in probs)
        for k in ("hot", "one", None):
            values = np.array([v for kk, v in data if kk == k])
            for name, p in probs.items():
                want = np.quantile(values, p, method="inverted_cdf" if discrete else "linear")
                assert got[k][name] == pytest.approx(want, rel=1e-12)


def test_percentiles_of_nothing_and_of_large_whole_numbers(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert [tuple(r) for r in percentiles(empty, [], "v", {"p": 0.5}).collect()] == [(None,)]
    assert percentiles(empty, ["k"], "v", {"p": 0.5}).count() == 0
    large = spark.createDataFrame([(9007199254740993,), (9007199254740995,)], "v long")
    assert percentiles(large, [], "v", {"p": 0.1}, True).first().p == 9007199254740993


def test_percentiles_of_infinities_far_values_and_ties(spark):
    import numpy as np

    rng = random.Random(6)
    inf = float("inf")
    groups = {"inf": [inf] * 30 + [-inf] * 40 + [rng.random() for _ in range(300)], "all": [inf] * 5, "far": [rng.random() for _ in range(500)] + [1e300, -1e300],
              "ties": [1.0] * 400 + [2.0] * 400 + [rng.random() + 1 for _ in range(200)], "whole": [float(k) for k in range(3000)]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    probs = {f"p{p}": p / 100 for p in (0, 1, 10, 33, 50, 67, 90, 99, 100)}
    for discrete in (False, True):
        for crowd in (65536, 64):
            got = {r.k: r for r in percentiles(df, ["k"], "v", probs, discrete, 64, crowd).collect()}
            for k, vs in groups.items():
                for name, p in probs.items():
                    low, high = (np.quantile(vs, p, method=m) for m in (("inverted_cdf",) * 2 if discrete else ("lower", "higher")))
                    want = low if low == high else np.quantile(vs, p)
                    assert got[k][name] == pytest.approx(want, rel=1e-12), (k, name)


def test_percentiles_when_the_sketch_is_off(spark, monkeypatch):
    """Brackets that miss their ranks cost a pass and no wrong result."""
    import numpy as np

    from lakewright.operators import percentiles as module

    df = spark.createDataFrame([(k % 3, float(k * 7919 % 10007)) for k in range(3000)], "k int, v double")
    monkeypatch.setattr(module.F, "percentile_approx", lambda c, marks, a: F.array(*[F.min(c) + 1 for _ in marks]))
    got = {r.k: r.p for r in percentiles(df, ["k"], "v", {"p": 0.4}).collect()}
    for k in range(3):
        assert got[k] == pytest.approx(np.quantile([i * 7919 % 10007 for i in range(3000) if i % 3 == k], 0.4))


def test_percentiles_keep_few_values(spark, tables, monkeypatch):
    from lakewright.operators import percentiles as module

    written = []

    def keep(df):
        out = durable(df)
        written.append(out.count())
        return out

    durable = module.durable
    monkeypatch.setattr(module, "durable", keep)
    percentiles(tables.lineitem, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9}).collect()
    assert max(written) < tables.lineitem.count() / 20


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "y"]), st.integers(-5, 5), st.one_of(st.none(), st.integers(-9, 9))),
                min_size=1, max_size=40), st.integers(1, 6))
def test_running_sum_property(spark, data, chunks):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(data)], "id long, k string, t long, v long")
    w = Window.partitionBy("k").orderBy("t")
    same(lw.running(df, ["k"], "t", {"s": ("sum", "v")}, chunks).select("id", "s"), df.select("id", F.sum("v").over(w).alias("s")))
