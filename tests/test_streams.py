"""Streams over several files give what the batch form gives, also after a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakewright.operators import alerts
from lakewright.streaming import runner, windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def feed(spark, tables, tmp_path):
    """The events in four files, in time order."""
    folder = tmp_path / "feed"
    cuts = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01"]
    for lo, hi in zip(cuts, cuts[1:]):
        part = tables.events.where(f"ts >= timestamp_ntz'{lo}' AND ts < timestamp_ntz'{hi}'")
        part.coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, feed, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)


def test_tumbling_stream_equals_batch(spark, tables, feed, tmp_path):
    source = stream(spark, feed, tables.events.schema)
    out = str(tmp_path / "out")
    runner.updates_to(windows.tumbling(source, "ts", "value", "1 day", watermark="40 days"), out, str(tmp_path / "cp"))
    got = runner.current(spark, out, ["window_start", "window_end"])
    want = windows.tumbling(tables.events, "ts", "value", "1 day")
    columns = ["window_start", "window_end", "count_values", F.round("sum_values", 2).alias("s"), "min_values", "max_values"]
    assert rows(got.select(columns)) == rows(want.select(columns))


def test_restart_adds_nothing(spark, tables, feed, tmp_path):
    out, progress = str(tmp_path / "out"), str(tmp_path / "cp")
    step = lambda df: df.select("event_id", (F.col("value") * 2).alias("x"))
    first = runner.process_stream(stream(spark, feed, tables.events.schema), step, out, progress).count()
    again = runner.process_stream(stream(spark, feed, tables.events.schema), step, out, progress)
    assert first == again.count() == tables.events.count()
    assert again.select("event_id").distinct().count() == first


def test_stream_versions_are_gapless(spark, tables, feed, tmp_path):
    source = stream(spark, feed, tables.events.schema).select("user_id", "ts", "event_id")
    empty = tables.events.select("user_id", "ts", "event_id").limit(0).withColumn("event_version", F.lit(0).cast("long"))
    store = runner.append_versions(source, "user_id", ["ts", "event_id"], str(tmp_path / "store"), str(tmp_path / "cp"), empty)
    from lakewright.operators.eventstore import version_check

    assert store.count() == tables.events.count()
    assert version_check(store, "user_id").where("NOT gapless").isEmpty()


def test_hourly_stream_equals_batch_of_each_hour(spark, tables, feed, tmp_path):
    source = stream(spark, feed, tables.events.schema)
    out = str(tmp_path / "out")
    runner.updates_to(windows.real_time_aggregate(source, ["event_type"], ["value"], "ts", "1 day", watermark="40 days"), out, str(tmp_path / "cp"))
    got = runner.current(spark, out, ["event_type", "window_start"]).where("window_start = timestamp_ntz'2024-01-10'")
    want = windows.real_time_aggregate(tables.events, ["event_type"], ["value"], "ts", "1 day", as_of=F.expr("timestamp_ntz'2024-01-11'"))
    columns = ["event_type", F.round("sum_value", 2).alias("s"), "count_value", "total_rows"]
    assert rows(got.select(columns)) == rows(want.select(columns))


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp_ntz, value double"
    feed = str(tmp_path / "feed")
    for day, hour in ((1, 0), (10, 0), (11, 0), (1, 1)):  # a watermark takes effect one batch later
        spark.createDataFrame([(dt.datetime(2024, 1, day, hour), 1.0)], schema).coalesce(1).write.mode("append").parquet(feed)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
    out = str(tmp_path / "out")
    runner.updates_to(windows.tumbling(source, "ts", "value", "1 day", watermark="1 hour"), out, str(tmp_path / "cp"))
    got = runner.current(spark, out, ["window_start", "window_end"])
    assert got.agg(F.sum("count_values")).first()[0] == 3


def test_sliding_modes(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 7), 3.0)], "ts timestamp_ntz, value double")
    both = rows(windows.sliding(df, "ts", "value", "10 minutes", "5 minutes").select("window_start", "window_end"))
    assert both == [(dt.datetime(2024, 1, 1, 0, 0), dt.datetime(2024, 1, 1, 0, 10)), (dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 0, 15))]
    one = rows(windows.sliding(df, "ts", "value", "10 minutes", "5 minutes", overlap=False).select("window_start", "window_end"))
    assert one == [(dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 0, 15))]


def test_threshold_spans_and_rates(spark):
    minutes = [(0, 5.0), (1, 9.0), (2, 9.0), (3, 9.0), (4, 1.0), (5, 9.0), (6, 9.0)]
    df = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 0, m), v) for m, v in minutes], "k string, ts timestamp_ntz, v double")
    found = alerts.threshold_for(df, ["k"], "ts", F.col("v") > 8, 120, "warning").collect()
    assert [(r.started.minute, r.ended.minute, r.samples) for r in found] == [(1, 3, 3)]
    rate = alerts.counter_rate(df, ["k"], "ts", "v", F.lit("all"), 60.0).first().rate
    assert rate == pytest.approx((4 + 0 + 0 + 1 + 8 + 0) / 60)


def test_a_folder_streams_as_a_file_does(spark, tables, tmp_path):
    from lakewright.plans import load_plans

    plans = load_plans()
    folder = tmp_path / "tables"
    for k, part in enumerate(tables.events.randomSplit([1.0, 1.0, 1.0], 3)):
        part.coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
    for key in ("stream_process", "stream_rt_aggregate", "stream_tumbling", "stream_sliding"):
        rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in plans[key](spark, tables.folder).dtypes]
        assert rows(plans[key](spark, str(folder)).select(rounded)) == rows(plans[key](spark, tables.folder).select(rounded)), key


def test_unordered_batches_lose_nothing_without_a_watermark(spark, tables, tmp_path):
    for lo, hi in (("2024-01-20", "2024-02-01"), ("2024-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20")):
        part = tables.events.where(f"ts >= timestamp_ntz'{lo}' AND ts < timestamp_ntz'{hi}'")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / "events.parquet"))
    source = runner.file_stream(spark, str(tmp_path / "in"), "events.parquet", files_per_batch=1)
    out = str(tmp_path / "out")
    runner.updates_to(windows.tumbling(source, "ts", "value", "1 day"), out, str(tmp_path / "cp"))
    total = runner.current(spark, out, ["window_start"]).agg(F.sum("count_values")).first()[0]
    assert total == tables.events.count()
    before = rows(runner.current(spark, out, ["window_start"]))
    runner.compact(spark, out, ["window_start"])
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch_id=")]) == 1
    assert rows(runner.current(spark, out, ["window_start"])) == before


def test_an_empty_stream_gives_an_empty_table(spark, tables, tmp_path):
    schema = tables.events.schema
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    done = runner.process_stream(source, lambda df: df.select("event_id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert done.columns == ["event_id"] and done.count() == 0
    runner.updates_to(windows.tumbling(source, "ts", "value", "1 day"), str(tmp_path / "w"), str(tmp_path / "cp2"))
    assert runner.current(spark, str(tmp_path / "w"), ["window_start"]).count() == 0


def test_versions_go_on_after_a_restart_without_reading_the_store(spark, tmp_path):
    folder, store, progress = (str(tmp_path / n) for n in ("in", "store", "cp"))
    schema = "k string, n long"
    empty = spark.createDataFrame([], schema + ", event_version long")
    want = []
    for part in ([("a", 2), ("a", 1), ("b", 5)], [("b", 4), ("c", 1)], [("a", 9), (None, 1)], [(None, 2)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder)
        got = runner.append_versions(source, "k", ["n"], store, progress, empty)
        for k in {k for k, _ in part}:
            last = max((v for kk, _, v in want if kk == k), default=0)
            want += [(k, n, last + 1 + i) for i, n in enumerate(sorted(n for kk, n in part if kk == k))]
        assert rows(got) == sorted(want, key=repr)
    assert rows(runner.append_versions(source, "k", ["n"], store, progress, empty)) == sorted(want, key=repr)


def test_an_alert_fires_when_the_hold_time_passes(spark, tmp_path):
    from lakewright.streaming.state import held_alerts, keyed_state

    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "k string, ts timestamp, v double"
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)

    def after(*samples, idle=None):
        spark.createDataFrame([(k, at(s), v) for k, s, v in samples], schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", "0 seconds")
        with keyed_state(spark):
            found = runner.process_stream(held_alerts(source, ["k"], "ts", F.col("v") > 8, 60, idle), lambda df: df, out, progress)
        return sorted((r.k, (r.started - at(0)).seconds, (r.fired - at(0)).seconds) for r in found.collect())

    assert after(("a", 0, 9.0), ("b", 0, 9.0), ("b", 30, 1.0), ("c", 10, 9.0), ("d", 5, None)) == []
    # a has no further sample: the clock that other keys move is enough. c goes on.
    assert after(("c", 40, 9.0), ("e", 62, 1.0)) == [("a", 0, 60)]
    # c has held until the sample that ends it; b starts anew; a does not fire twice.
    assert after(("a", 65, 9.0), ("c", 70, 2.0), ("b", 66, 9.0)) == [("a", 0, 60), ("c", 10, 70)]
    assert after(("b", 100, 1.0), ("e", 200, 1.0)) == [("a", 0, 60), ("c", 10, 70)]


def test_a_run_is_forgotten_after_a_silence(spark, tmp_path):
    from lakewright.streaming.state import held_alerts, keyed_state

    folder, out, progress = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "k string, ts timestamp, v double"
    found = []
    for s, k in ((0, "a"), (50, "x"), (55, "a"), (130, "x")):
        spark.createDataFrame([(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), 9.0 if k == "a" else 0.0)], schema).coalesce(1).write.mode("append").parquet(folder)
        source = spark.readStream.schema(schema).parquet(folder).withWatermark("ts", "0 seconds")
        with keyed_state(spark):
            done = runner.process_stream(held_alerts(source, ["k"], "ts", F.col("v") > 8, 60, idle_seconds=40), lambda df: df, out, progress)
        found.append(done.count())
    # The run of second 0 ends in silence at second 40, so the one of second 55 is on its own, and it too falls silent at 95.
    assert found == [0, 0, 0, 0]


def test_versions_take_one_state_for_many_keys_and_keep_whole_numbers(spark, tmp_path):
    from lakewright.streaming import state

    keys, big = [*range(120), None], 2 ** 53 + 1
    part = [(k, n, big if n else None) for k in keys for n in range(2)]
    schema = "k long, n long, big long"
    spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(state, "STATE_BUCKETS", 2, raising=False)
        got = runner.append_versions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", ["n"], str(tmp_path / "store"), str(tmp_path / "cp"),
                                     spark.createDataFrame([], schema + ", event_version long"))
    assert rows(got) == sorted(((k, n, b, n + 1) for k, n, b in part), key=repr)
