"""Time frames, counts within intervals and tail probabilities against plain counterparts."""

import datetime as dt
import math
import random

import duckdb
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakewright.functions import probability
from lakewright.operators import joins, stats
from lakewright.operators import windows as lw
from lakewright.plans import extras, load_plans
from lakewright.sources.tables import durable
from tests.conftest import plan_text


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def readings(spark):
    """One key fills a single slot, others are spread; ties, nulls and times on the edge of a frame."""
    rng, base = random.Random(4), dt.datetime(2024, 1, 1)
    data = [("hot", base + dt.timedelta(seconds=rng.randrange(500)), rng.choice([None, *range(9)])) for _ in range(400)]
    data += [(rng.choice(["a", None]), base + dt.timedelta(seconds=100 * rng.randrange(60)), rng.choice([None, -1, 4, 7])) for _ in range(120)]
    data += [("a", None, 3), ("a", None, None), (None, None, 5), ("old", dt.datetime(1969, 12, 31, 23, 59, 1), 2), ("old", dt.datetime(1970, 1, 1), 1)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "id int, k string, ts timestamp_ntz, v long").repartition(6)


@pytest.mark.parametrize("seconds,chunks", [(100, None), (1000, 7), (86400, 3), (1, 5)])
def test_time_frames(readings, seconds, chunks):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = Window.partitionBy("k").orderBy("at").rangeBetween(-seconds * 1_000_000, 0)
    fns = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    want = readings.withColumn("at", at).select("id", *[fns[f]("v").over(frame).alias(f) for f in fns])
    got = lw.time_frame(readings, ["k"], "ts", seconds, {f: (f, "v") for f in fns}, chunks)
    assert got.columns == ["id", "k", "ts", "v", *fns]
    assert rows(got.select("id", *fns)) == rows(want)
    assert rows(lw.time_frame(readings.limit(0), ["k"], "ts", seconds, {"n": ("max", "v")})) == []


def test_counts_within_intervals_list_no_pair(spark, readings):
    rng, base = random.Random(5), dt.datetime(2024, 1, 1)
    spans = []
    for i in range(60):
        lo = base + dt.timedelta(seconds=rng.randrange(6000))
        spans.append((i, rng.choice(["hot", "a", None]), lo, lo + dt.timedelta(seconds=rng.choice([0, -5, 1, 100, 5000]))))
    spans += [(60, "a", None, base), (61, "a", base, None), (0, "hot", base, base + dt.timedelta(days=1)), (62, "none", base, base)]
    intervals = spark.createDataFrame(spans, "i int, k string, lo timestamp_ntz, hi timestamp_ntz")
    points = [(r.k, r.ts) for r in readings.collect()]
    for keys in ([], ["k"]):
        got = joins.count_within(readings, "ts", intervals, "lo", "hi", "n", keys)
        want = [(*s, sum(t is not None and s[2] <= t < s[3] and (not keys or k == s[1]) for k, t in points) if s[2] and s[3] else 0) for s in spans]
        assert rows(got.select("i", "k", "lo", "hi", "n")) == sorted(want, key=repr)
    pairs = joins.within_intervals(readings.drop("k"), "ts", intervals, "lo", "hi", 600).groupBy("i").count()
    listed = {r.i: r["count"] for r in pairs.collect()}
    got = joins.count_within(readings, "ts", intervals.where("i not in (0, 60, 61)"), "lo", "hi", "n")
    assert {r.i: r.n for r in got.where("n > 0").collect()} == {k: n for k, n in listed.items() if k != 0}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# Quantiles from published tables, with their probabilities.
TABLE = [("t", 2.2281388519649385, 10, 0.05), ("t", 12.706204736432095, 1, 0.05), ("t", 4.032142983555227, 5, 0.01), ("t", 1.9623390808264078, 1000, 0.05),
         ("chi", 18.307038053275146, 10, 0.05), ("chi", 3.841458820694124, 1, 0.05), ("chi", 124.34211340400407, 100, 0.05), ("f", 3.3258345304130126, (5, 10), 0.05),
         ("f", 4.9646027437307145, (1, 10), 0.05)]


@pytest.mark.parametrize("kind,x,df,want", TABLE)
def test_tail_probabilities_of_tables(spark, kind, x, df, want):
    lit = F.lit(float(x))
    got = {"t": lambda: probability.t_two_sided(lit, F.lit(df)), "chi": lambda: probability.chi_square_upper(lit, F.lit(df)),
           "f": lambda: probability.f_upper(lit, *map(F.lit, df if isinstance(df, tuple) else (0, 0)))}[kind]()
    assert one(spark, got) == pytest.approx(want, rel=1e-9)


def test_tail_probabilities_of_closed_forms(spark):
    cases = []
    for x in (0.0, 0.5, 3.0, 80.0):
        cases += [(probability.t_two_sided(F.lit(x), F.lit(1)), 1 - 2 / math.pi * math.atan(x)), (probability.t_two_sided(F.lit(-x), F.lit(2)), 1 - x / math.sqrt(2 + x * x)),
                  (probability.chi_square_upper(F.lit(x), F.lit(2)), math.exp(-x / 2)), (probability.chi_square_upper(F.lit(x), F.lit(1)), math.erfc(math.sqrt(x / 2))),
                  (probability.chi_square_upper(F.lit(x), F.lit(6)), math.exp(-x / 2) * (1 + x / 2 + x * x / 8)), (probability.f_upper(F.lit(x), F.lit(2), F.lit(9)), (1 + 2 * x / 9) ** -4.5)]
    for a, b in ((1, 1), (30, 40), (200, 3), (400, 500)):
        for x in (0.0, 0.37, 0.9, 1.0):
            n = a + b - 1
            cases.append((probability.beta_share(F.lit(x), F.lit(a), F.lit(b)), sum(math.comb(n, j) * x ** j * (1 - x) ** (n - j) for j in range(a, n + 1))))
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    for value, (_, want) in zip(got, cases):
        assert value == pytest.approx(want, rel=1e-9, abs=1e-12)
    outside = [probability.beta_share(F.lit(1.5), F.lit(1), F.lit(1)), probability.gamma_rest(F.lit(-1), F.lit(1)), probability.t_two_sided(F.lit(None).cast("double"), F.lit(3))]
    assert all(v is None for v in spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(outside)]).first())


def test_tests_give_their_p_values(spark, tables):
    got = stats.t_test(tables.events, "event_type", "value", "click", "view").first()
    assert one(spark, probability.t_two_sided(F.lit(got.statistic), F.lit(got.df))) == got.p_value and 0 < got.p_value <= 1
    same = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 1.0), ("b", 2.0), ("b", 3.0)], "g string, v double")
    assert stats.t_test(same, "g", "v", "a", "b").first().p_value == pytest.approx(1)
    assert stats.anova(same, "g", "v").first().p_value == pytest.approx(1)
    apart = spark.createDataFrame([("x", "p")] * 50 + [("y", "q")] * 50, "a string, b string")
    assert stats.chi_square(apart, "a", "b").first().p_value == pytest.approx(math.erfc(math.sqrt(50)), rel=1e-9)


def test_sketches_beside_a_distinct_count_are_kept_per_group(spark, tmp_path, monkeypatch):
    rows = [(None if k % 7 == 0 else f"t{k % 3}", None if k % 11 == 0 else k % 40, None if k % 5 == 0 else float(k % 90)) for k in range(900)]
    spark.createDataFrame(rows, "event_type string, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    plan, plans = load_plans()["agg_approx_distinct"], []
    monkeypatch.setattr(extras, "durable", lambda df: plans.append(plan_text(df)) or durable(df), raising=False)
    got = plan(spark, str(tmp_path))
    nodes = "\n\n".join([*plans, plan_text(got)]).split("\n\n")
    assert not [n for n in nodes if "Functions" in n and "percentile_approx" in n and "user_id" in n.split("Keys")[-1].split("\n")[0]]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got.select("event_type", "users", "distinct_close", "median_close").collect()), key=repr) == sorted(con.execute(plan.sql).fetchall(), key=repr)
