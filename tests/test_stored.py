"""Stored tables: parts, masks, versions, two writers; keyed tables with runs of changes."""

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lakewright.operators import cdc, matviews
from lakewright.sources.commits import CommitLog, Conflict
from lakewright.sources.keyed import KeyedTable
from lakewright.sources.versioned import VersionedTable
from lakewright.streaming import runner


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def size(path):
    return sum(p.stat().st_size for p in path.rglob("*.parquet"))


@pytest.fixture
def wide(spark):
    return spark.range(60000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"), (F.col("id") % 7).alias("g"))


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.create(spark, str(tmp_path / "table"))


def test_a_change_writes_what_it_touches(spark, table, wide, tmp_path):
    table.replace(wide.repartition(4))
    whole = size(tmp_path)
    for change in (lambda: table.insert(wide.limit(20).withColumn("id", F.col("id") + 100000)),
                   lambda: table.update(F.col("id").between(500, 520), {"v": F.lit("new")}),
                   lambda: table.delete(F.col("id") < 30),
                   lambda: table.upsert(wide.where("id in (100, 101)").withColumn("v", F.lit("up")), ["id"])):
        before = size(tmp_path)
        change()
        assert size(tmp_path) - before < whole / 20
    got = {r.id: r.v for r in table.read().collect()}
    assert len(got) == table.read().count() == 60000 + 20 - 30
    assert got[510] == "new" and got[100] == got[101] == "up" and 29 not in got and 100000 in got
    assert [(k, n) for _, k, n in table.history()] == [("replace", 60000), ("insert", 60020), ("update", 60020), ("delete", 59990), ("upsert", 59990)]


def test_random_changes_give_what_plain_rows_give(spark, table):
    rng = random.Random(3)
    plain = {i: i % 5 for i in range(50)}
    schema = "id long, v long"
    table.replace(spark.createDataFrame(list(plain.items()), schema).repartition(3))
    for turn in range(10):
        kind, lo = rng.choice(["update", "delete", "upsert", "insert", "compact"]), rng.randrange(60)
        near = F.col("id").between(lo, lo + 6)
        inside = [i for i in plain if lo <= i <= lo + 6]
        if kind == "update":
            assert table.update(near, {"v": F.col("v") + 10}) == len(inside)
            plain |= {i: plain[i] + 10 for i in inside}
        elif kind == "delete":
            assert table.delete(near) == len(inside)
            for i in inside:
                del plain[i]
        elif kind == "upsert":
            given = [(lo + k, turn) for k in range(4)]
            plain |= dict(given)
            assert table.upsert(spark.createDataFrame(given, schema), ["id"]) == len(plain)
        elif kind == "insert":
            assert table.insert(spark.createDataFrame([(1000 + turn, turn)], "id int, v int")) == 1
            plain[1000 + turn] = turn
        else:
            table.compact()
        assert rows(table.read()) == sorted(plain.items(), key=repr)
    table.compact()
    assert rows(table.read()) == sorted(plain.items(), key=repr) and not table.compact()


def test_partitions_nulls_and_repeated_keys(spark, table):
    base = spark.createDataFrame([(None, "a", 1), (1, "a", 1), (1, "b", 2), (2, None, 2)], "id int, v string, p int")
    table.replace(base, partition_by=["p"])
    assert table.delete(F.col("v") == "nothing") == 0 and table.update(F.col("v").isNull(), {"v": F.lit("x")}) == 1
    assert rows(table.read()) == rows(spark.createDataFrame([(None, "a", 1), (1, "a", 1), (1, "b", 2), (2, "x", 2)], base.schema))
    # Both stored rows of key 1 are replaced; null is a key.
    assert table.upsert(spark.createDataFrame([(1, "n", 3), (None, "m", 3), (1, "k", 9)], base.schema), ["id"]) == 3
    assert rows(table.read()) == rows(spark.createDataFrame([(None, "m", 3), (1, "n", 3), (2, "x", 2)], base.schema))
    assert rows(table.read(1)) == rows(base)
    assert table.truncate() == 3 and table.read().count() == 0
    table.insert(base.limit(1))
    assert table.read().count() == 1


def test_the_second_of_two_writers_fails(spark, table, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    table.replace(base)
    other, seen = VersionedTable(spark, table.base), table.version()
    table.update(F.col("id") == 1, {"v": F.lit("first")}, at=seen)
    files = size(tmp_path)
    for change in (lambda: other.delete(F.col("id") == 1, at=seen), lambda: other.insert(base, at=seen), lambda: other.replace(base, at=seen),
                   lambda: other.upsert(base, ["id"], at=seen), lambda: other.truncate(at=seen)):
        with pytest.raises(Conflict):
            change()
    assert size(tmp_path) == files and rows(other.read()) == [(1, "first"), (2, "b")]
    assert other.delete(F.col("id") == 2) == 1


def test_one_of_many_commits_wins(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))

    def attempt(k):
        try:
            return log.commit(0, {"by": k})
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(attempt, range(16)))
    assert done.count(1) == 1 and log.entry(1)["by"] == done.index(1) and log.latest() == 1


def test_keyed_table_against_a_dictionary(spark, tmp_path):
    rng = random.Random(5)
    plain = {k: f"v{k}" for k in [None, *range(40)]}
    table = KeyedTable(spark, str(tmp_path), ["id"], fanout=2)
    with pytest.raises(LookupError):
        table.read()
    table.create(spark.createDataFrame(list(plain.items()), "id int, v string"))
    levels = set()
    for batch in range(7):
        log = [(rng.choice([None, *range(60)]), f"b{batch}.{n}", rng.random() < 0.3, n) for n in range(4)]
        for key, v, gone, _ in log:
            plain.pop(key, None)
            if not gone:
                plain[key] = v
        changes = spark.createDataFrame([(k, None if g else v, g, n) for k, v, g, n in log], "id int, v string, _gone boolean, n int")
        assert table.apply(changes, ["n"], batch) == len({k for k, *_ in log})
        assert table.apply(changes.withColumn("v", F.lit("again")), ["n"], batch) == 0
        assert rows(table.read()) == sorted(plain.items(), key=repr)
        levels |= {r["level"] for r in table._state()[1]["runs"]}
    assert len(levels) > 1


def test_a_batch_of_changes_writes_in_proportion(spark, wide, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["id"])
    table.create(wide)
    whole = size(tmp_path)
    for batch in range(6):
        before = size(tmp_path)
        changes = wide.where(f"id between {batch * 10} and {batch * 10 + 20}").select("*", F.lit(batch % 2 == 1).alias("_gone"), F.lit(batch).alias("n"))
        table.apply(changes, ["n"], batch)
        assert size(tmp_path) - before < whole / 20
    assert table.read().count() == wide.count() - 41  # 10 to 19, 30 to 39 and 50 to 70 are gone
    assert len(table._state()[1]["runs"]) <= 2 * table.fanout


def test_a_change_stream_gives_what_one_batch_gives(spark, tables, tmp_path):
    before = tables.customer.select("c_custkey", "c_name", "c_acctbal")
    after = before.where("c_custkey % 3 > 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.col("c_acctbal")))
    log = cdc.capture(before, after, ["c_custkey"], "customer").withColumn("n", F.col("c_custkey"))
    log.repartition(5).write.parquet(str(tmp_path / "in" / "log"))
    table = KeyedTable(spark, str(tmp_path / "table"), ["c_custkey"])
    table.create(before)
    changes = runner.file_stream(spark, str(tmp_path / "in"), "log", files_per_batch=1)
    runner.apply_changes(changes, table, ["n"], str(tmp_path / "cp"))
    assert rows(table.read()) == rows(after) == rows(cdc.apply(before, log, ["c_custkey"], ["n"]))
    runner.apply_changes(changes, table, ["n"], str(tmp_path / "cp"))
    assert rows(table.read()) == rows(after)


def totals(df):
    return rows(matviews.partial_totals(df, ["k"], "v").select("k", "total", "n", "lowest", "highest"))


def test_incremental_totals_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(9)
    schema = "k string, v double"
    held = [(rng.choice(["a", "b", None]), rng.choice([1.0, 2.0, 5.0, None])) for _ in range(12)]
    view = matviews.TotalsView(spark, str(tmp_path), ["k"], "v")
    view.replace(spark.createDataFrame(held, schema))
    for turn in range(5):
        gone = rng.sample(held, min(4, len(held)))
        for r in gone:
            held.remove(r)
        new = [(rng.choice(["a", "b", "c", None]), rng.choice([0.5, 1.0, 9.0, None])) for _ in range(turn)]
        held += new
        changes = spark.createDataFrame([(*r, -1) for r in gone] + [(*r, 1) for r in new], schema + ", _sign int")
        assert view.refresh(changes) == len({k for k, _ in gone + new})
        assert rows(view.read()) == totals(spark.createDataFrame(held, schema))
        if turn == 2:
            view.compact()


def test_a_refresh_writes_what_changed_and_keeps_the_next_minimum(spark, tmp_path):
    df = spark.range(40000).select((F.col("id") % 9000).alias("k"), F.col("id").cast("double").alias("v"))
    view = matviews.TotalsView(spark, str(tmp_path), ["k"], "v")
    view.replace(df)
    whole = size(tmp_path)
    view.refresh(df.where("v < 20").withColumn("_sign", F.lit(-1)))
    assert size(tmp_path) - whole < whole / 10
    assert rows(view.read()) == totals(df.where("v >= 20"))


def test_refresh_mode_decides(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("x", 1.0)], "k string, v double")
    views = {n: matviews.TotalsView(spark, str(tmp_path / n), ["k"], "v") for n in ("a", "b", "c")}
    for n in ("a", "b"):
        views[n].replace(df)
    schedule = spark.createDataFrame([(n, 60, None, at, True, m) for n, m in (("a", "INCREMENTAL"), ("b", "COMPLETE"), ("c", "INCREMENTAL"))], matviews.SCHEDULE)
    change = df.withColumn("v", F.lit(7.0)).withColumn("_sign", F.lit(1))
    done = matviews.process_refreshes(schedule, F.lit(at), {n: (lambda: df) for n in "abc"}, views, {n: (lambda: change) for n in "abc"})[1]
    # a takes the change, b is rebuilt, c has nothing stored yet and is built.
    assert done == 3 and [views[n].read().first().total for n in "abc"] == [8.0, 1.0, 1.0]
