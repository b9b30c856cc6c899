"""Change logs, event store, stored tables, loads and quality checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakewright.operators import audit, cdc, etl, eventstore, joins, logs, matviews, quality
from lakewright.operators.quality import Check
from lakewright.sources import versioned
from lakewright.sources.tables import scratch_path
from lakewright.sources.versioned import VersionedTable


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable.create(spark, str(tmp_path / "table"))


def test_capture_fixture(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (4, "gone")], "id int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id int, v string")
    log = cdc.capture(before, after, ["id"], "t")
    assert rows(log.select("id", "operation")) == [(2, "U"), (3, "I"), (4, "D")]
    assert rows(cdc.change_trail(log, ["id"])) == [("t", 2, "UPDATE", "v"), ("t", 3, "INSERT", "id,v"), ("t", 4, "DELETE", "id,v")]


def test_apply_gives_the_after_image_and_is_idempotent(spark):
    before = spark.createDataFrame([(1, "a", 1.5, None), (2, "b", None, dt.datetime(2024, 1, 1, 1, 2, 3, 456789)), (4, None, 0.1, None)],
                                   "id int, v string, x double, at timestamp_ntz")
    after = spark.createDataFrame([(1, None, 1.5, None), (3, "new", 2.25, dt.datetime(2024, 1, 1)), (4, None, 0.1, None)], before.schema)
    log = cdc.capture(before, after, ["id"], "t").withColumn("change_id", F.col("id"))
    once = cdc.apply(before, log, ["id"], ["change_id"])
    assert rows(once) == rows(after)
    assert rows(cdc.apply(once, log, ["id"], ["change_id"])) == rows(after)


def test_apply_takes_the_last_change(spark):
    base = spark.createDataFrame([(1, "a")], "id int, v string")
    log = spark.createDataFrame([(1, "U", '{"id":1,"v":"b"}', 1), (1, "D", None, 2), (2, "I", '{"id":2,"v":"x"}', 3), (2, "U", '{"id":2,"v":"y"}', 4)],
                                "id int, operation string, new_values string, change_id int")
    assert rows(cdc.apply(base, log, ["id"], ["change_id"])) == [(2, "y")]


def test_connector(spark):
    assert cdc.connector_topic("c", "s", "t") == "c.s.t"
    with pytest.raises(ValueError):
        cdc.connector_topic("c", "s;", "t")
    message = '{"op":"u","before":{"id":1,"v":"a"},"after":{"id":1,"v":"b"},"ts_ms":5}'
    got = cdc.decode_envelope(spark.createDataFrame([(message,)], "m string"), "m", {"id": "int"}).first()
    assert (got.id, got.operation, got.ts_ms) == (1, "U", 5)
    assert got.new_values == '{"id":1,"v":"b"}'


def test_versions_continue(spark):
    store = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "k string, event_version long")
    new = spark.createDataFrame([("a", 10), ("a", 11), ("b", 12)], "k string, id int")
    got = eventstore.append(store, new, "k", ["id"], chunks=3)
    assert rows(got.select("k", "id", "event_version")) == [("a", 10, 4), ("a", 11, 5), ("b", 12, 1)]
    bad = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 1), ("c", 1), ("c", 2)], "k string, event_version long")
    assert {r.k: r.gapless for r in eventstore.version_check(bad, "k").collect()} == {"a": False, "b": False, "c": True}


def test_stored_table_changes(spark, table):
    with pytest.raises(LookupError):
        table.read()
    base = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    assert table.replace(base) == 3
    assert table.insert(spark.createDataFrame([(4, "d")], base.schema)) == 1
    assert table.update(F.col("v") == "a", {"v": F.lit("z")}) == 1
    assert table.delete(F.col("v") == "c") == 1
    assert rows(table.read()) == [(1, "z"), (2, None), (4, "d")]
    source = spark.createDataFrame([(2, "two"), (9, "nine")], base.schema)
    assert table.upsert(source, ["id"]) == 4
    once = rows(table.read())
    table.upsert(source, ["id"])
    assert rows(table.read()) == once == [(1, "z"), (2, "two"), (4, "d"), (9, "nine")]
    assert table.truncate() == 4 and table.read().count() == 0
    assert table.version() == 7


def test_insert_ignore(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n")], "id int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "b"), (None, "m")], "id int, v string")
    assert rows(versioned.insert_ignore(a, b, ["id"])) == [(1, "a"), (2, "b"), (None, "n")]


MAPPINGS = (etl.Mapping("k", "int", "id", nullable=False), etl.Mapping("label", "string", rule="upper(v)", default="NONE"),
            etl.Mapping("batch", "int", rule="7"))


def test_mapping_rejects_and_defaults(spark):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c"), ("4", None)], "id string, v string")
    got = rows(etl.apply_mapping(df, MAPPINGS))
    assert (1, "A", 7, False) in got and (4, "NONE", 7, False) in got
    assert sum(r[-1] for r in got) == 2


def test_incremental_load(spark, tmp_path):
    job = etl.Job("j", MAPPINGS, incremental_column="at")
    df = spark.createDataFrame([("1", "a", 10), ("2", "b", 20), ("bad", "c", 30)], "id string, v string, at int")
    path = str(tmp_path / "target")
    first = etl.load(df.where("at <= 10"), job, path)
    assert (first.rows_processed, first.rows_loaded, first.rows_rejected, first.last_value) == (1, 1, 0, 10)
    second = etl.load(df, job, path, first.last_value)
    assert (second.rows_processed, second.rows_loaded, second.rows_rejected, second.last_value) == (2, 1, 1, 30)
    third = etl.load(df, job, path, second.last_value)
    assert (third.rows_processed, third.last_value) == (0, 30)
    assert rows(etl.read_target(spark, path, MAPPINGS)) == [(1, "A", 7), (2, "B", 7)]


def test_sources_and_steps(spark, tmp_path):
    with pytest.raises(NotImplementedError):
        etl.open_source(spark, etl.Job("j", MAPPINGS, source_type="api"))
    spark.range(3).write.csv(str(tmp_path / "in"))
    job = etl.Job("j", MAPPINGS, source_type="file", options={"format": "csv", "path": str(tmp_path / "in"), "schema": "id string"})
    assert etl.open_source(spark, job).count() == 3
    done = []
    log = etl.run_steps(spark, {"one": lambda: done.append(1), "two": lambda: done.append(2)})
    assert done == [1, 2] and [s for _, s, _ in log] == ["STARTED", "COMPLETED"] * 2
    with pytest.raises(ZeroDivisionError):
        etl.run_steps(spark, {"bad": lambda: 1 / 0, "never": lambda: done.append(3)})
    assert done == [1, 2]


def test_net_amounts_of_the_sample_orders(spark):
    df = spark.createDataFrame([(1, 150.0, 0.0), (2, 75.5, 10.0), (3, 200.85, 10.0), (4, 50.0, 0.0)], "id int, total double, discount double")
    got = df.select("id", F.round(F.col("total") - F.col("discount"), 2).alias("net")).orderBy("id")
    assert [r.net for r in got.collect()] == [150.0, 65.5, 190.85, 50.0]


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, "a@b.co", 5, 1), (2, "bad", 50, 2), (2, None, None, 9)], "id int, mail string, n int, ref int")
    known = spark.createDataFrame([(1,), (2,)], "r int")
    checks = [
        Check("nulls", "null", ("mail",), threshold=1.0), Check("null_share", "null", ("mail",), threshold=10.0, mode="ratio"),
        Check("unique", "unique", ("id",)), Check("range", "range", ("n",), low=0, high=10, threshold=1.0),
        Check("format", "regex", ("mail",), pattern="@"), Check("refs", "referential", ("ref",), reference=known, reference_column="r"),
        Check("some", "custom", predicate="n > 1", threshold=None), Check("broken", "custom", predicate="no_such_column > 1"),
        Check("raises", "custom", predicate="CAST(mail AS INT) > 1")]
    got = {r.check_name: r for r in quality.run_checks(df, checks).collect()}
    assert {n: (r.value_checked, r.passed) for n, r in got.items() if not r.error} == {
        "nulls": (1.0, True), "null_share": (pytest.approx(100 / 3), False), "unique": (1.0, False), "range": (1.0, True),
        "format": (1.0, False), "refs": (1.0, False), "some": (2.0, True)}
    assert not got["broken"].passed and got["broken"].error and not got["raises"].passed and got["raises"].error
    total = quality.score(quality.run_checks(df, checks[:4])).first()
    assert (total.total_checks, total.passed_checks, total.quality_score) == (4, 2, 50.0)
    sample = quality.error_sample(df, checks[4]).collect()
    assert len(sample) == 1 and '"bad"' in sample[0].record


def test_not_in_null_rules(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    values = spark.createDataFrame([(2,), (None,)], "b int")
    assert rows(joins.not_in(left, "a", values, "b")) == []
    assert rows(joins.not_in(left, "a", values.where("b = 2"), "b")) == [(1,)]
    assert len(rows(joins.not_in(left, "a", values.limit(0), "b"))) == 3


def test_hierarchy_has_no_depth_limit(spark):
    chain = spark.range(110).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    got = joins.hierarchy(chain)
    assert got.count() == 110 and got.agg(F.max("level")).first()[0] == 110


def test_hierarchy_finds_a_node_below_itself(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("b", "c")], "id string, parent string")
    with pytest.raises(ValueError, match="lies below itself"):
        joins.hierarchy(nodes)
    assert joins.hierarchy(nodes.limit(0)).count() == 0


def test_refresh_schedule(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    schedule = spark.createDataFrame([("a", 60, None, at, True, "COMPLETE"), ("b", 60, None, at, True, "COMPLETE"),
                                      ("c", 60, None, dt.datetime(2025, 1, 1), True, "COMPLETE")], matviews.SCHEDULE)
    tables = {n: VersionedTable.create(spark, str(tmp_path / n)) for n in "abc"}

    def broken():
        raise RuntimeError("no source")

    updated, done = matviews.process_refreshes(schedule, F.lit(at), {"a": lambda: spark.range(3), "b": broken, "c": lambda: spark.range(9)}, tables)
    got = {r.view_name: r for r in updated.collect()}
    assert done == 1 and tables["a"].read().count() == 3 and tables["b"].version() == tables["c"].version() == 0
    assert got["a"].last_refresh == at and got["a"].next_refresh == at + dt.timedelta(seconds=60)
    assert got["b"].last_refresh is None
    asked = spark.createDataFrame([("a", 5, "INCREMENTAL"), ("d", 9, "COMPLETE")], "view_name string, interval_seconds int, refresh_mode string")
    assert matviews.schedule_refresh(updated, asked, F.lit(at)).count() == 4
    kept = matviews.create(spark.range(4), tables["c"], "view_c", with_data=False)
    assert kept.count() == 0 and spark.table("view_c").columns == ["id"]


def test_severity_and_off_hours(spark):
    log = spark.createDataFrame([("SELECT 1", 10000, None), ("drop table x", 10001, None), ("VACUUM", 1, "boom")],
                                "command_tag string, execution_time_ms long, error_message string").withColumn("query_text", F.lit("q"))
    got = [(r.operation_type, r.severity) for r in audit.enrich(log).collect()]
    assert got == [("SELECT", "INFO"), ("DDL", "WARNING"), ("OTHER", "ERROR")]
    activity = spark.createDataFrame([(dt.datetime(2024, 1, 1, h, 30), f"u{h}", "ip", ["app.CustomerX"]) for h in (7, 8, 18, 19)],
                                     "logged_at timestamp_ntz, user_name string, client_ip string, table_names array<string>")
    found = audit.off_hours(activity, F.lit(dt.datetime(2024, 1, 2)), "1 DAY")
    assert sorted(r.user_name for r in found.collect()) == ["u19", "u7"]


@pytest.mark.parametrize("size,want", [(0, "0 bytes"), (10239, "10239 bytes"), (10240, "10 kB"), (10752, "11 kB"), (10 * 1024 ** 2, "10 MB"),
                                       (20 * 1024 ** 3, "20 GB"), (50 * 1024 ** 4, "50 TB")])
def test_size_pretty(spark, size, want):
    assert spark.range(1).select(audit.size_pretty(F.lit(size).cast("long")).alias("x")).first().x == want


@pytest.mark.parametrize("now,want", [(10.6, "REGRESSION"), (10.4, "PASS")])
def test_benchmark_status(spark, now, want):
    base = spark.createDataFrame([("q", 10.0), ("q", 10.0)], "benchmark string, seconds double")
    current = spark.createDataFrame([("q", now), ("q", now)], "benchmark string, seconds double")
    assert logs.benchmark_compare(base, current).first().status == want


def test_predicate_columns_sum_equal_texts_once(spark):
    text = "select * from app.t where t.a = 1 and b > 2 order by c desc, t.a limit 3"
    log = spark.createDataFrame([(text, 5), (text, 7)], "query_text string, execution_time_ms long")
    got = {(r.table_name, r.column_name): (r.uses, r.total_ms) for r in logs.predicate_columns(log).collect()}
    assert got == {("t", "a"): (2, 12), ("t", "b"): (2, 12), ("t", "c"): (2, 12)}


def test_scratch_paths_are_in_the_shared_folder(spark):
    from lakewright.sources.tables import shared_folder

    assert scratch_path(spark, "x").startswith(shared_folder(spark) + "/x-")


def test_predicate_columns_of_texts(spark):
    from lakewright.operators import logs

    texts = [
        "SELECT a, b FROM Orders o JOIN items AS i ON o.id = i.order_id WHERE o.status in ('a.b = c', 'x') AND total > 5 ORDER BY o.placed DESC, i.line",
        "select 1 from users where name like '%= 3' -- and hidden.col = 1\n and /* other.col = 2 */ \"Age\" not in (3) limit 3",
        "SELECT * FROM a, b WHERE a.x = b.y",
        "SELECT * FROM t WHERE id IN (SELECT ref FROM u WHERE u.kind <> 'k') ORDER BY 1",
    ]
    log = spark.createDataFrame([(t, 10) for t in texts], "query_text string, execution_time_ms long")
    got = {(r.table_name, r.column_name) for r in logs.predicate_columns(log).collect()}
    assert got == {("orders", "status"), ("orders", "total"), ("items", "total"), ("orders", "placed"),
                   ("items", "line"), ("users", "name"), ("users", "age"), ("a", "x"), ("b", "y"), ("t", "id"), ("u", "id"), ("u", "kind")}


def test_change_to_null_is_in_the_trail(spark):
    before = spark.createDataFrame([(1, 5.0, "a"), (2, None, "b")], "id int, x double, y string")
    after = spark.createDataFrame([(1, None, "a"), (2, 3.0, "b"), (3, None, "c")], "id int, x double, y string")
    log = cdc.capture(before, after, ["id"], "t")
    got = {r.id: (r.action, r.changed_fields) for r in cdc.change_trail(log, ["id"]).collect()}
    assert got == {1: ("UPDATE", "x"), 2: ("UPDATE", "x"), 3: ("INSERT", "id,x,y")}
    assert rows(cdc.apply(before, log.withColumn("n", F.lit(1)), ["id"], ["n"])) == rows(after)


def test_a_repeated_load_replaces_itself(spark, tmp_path):
    from lakewright.operators import etl

    job = etl.Job("numbers", (etl.Mapping("n", "bigint", "id", nullable=False),))
    for _ in range(2):
        assert etl.load(spark.range(10), job, str(tmp_path)).rows_loaded == 10
    assert etl.read_target(spark, str(tmp_path), job.mappings).count() == 10
    etl.load(spark.range(3), job, str(tmp_path), run_id="other")
    assert etl.read_target(spark, str(tmp_path), job.mappings).count() == 13


def test_upsert_takes_one_row_per_key(spark):
    from lakewright.sources.versioned import upsert

    target = spark.createDataFrame([(1, "old", 0), (2, "kept", 0)], "id int, v string, at int")
    source = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (3, "new", 1)], "id int, v string, at int")
    assert rows(upsert(target, source, ["id"], ["at"])) == rows(spark.createDataFrame([(1, "b", 2), (2, "kept", 0), (3, "new", 1)], target.schema))
    assert upsert(target, source, ["id"]).count() == 3
