"""Layouts, sources, functions and migration, with the plans they lead to."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakewright.operators import joins, layout, migrate, nearest, stats, timeseries, udfs
from lakewright.operators.windows import top_per_key
from lakewright.plans import load_plans
from lakewright.plans.relational import colocated_orders
from lakewright.sources import federation, files
from tests.conftest import DATA, plan_text


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- plans

def test_filters_and_columns_reach_the_scan(spark):
    text = plan_text(load_plans()["tpch_q6"](spark, DATA))
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text
    schema = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "l_orderkey" not in schema and "l_discount" in schema


def test_colocated_join_does_not_shuffle(spark, tables):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_text(colocated_orders(tables))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_partition_filter_prunes(spark, tables, tmp_path):
    written = layout.write_partitioned(tables.orders.withColumn("y", F.year("o_orderdate")), ["y"], str(tmp_path / "t"))
    assert "PartitionFilters: [isnotnull(y" in plan_text(written.where("y = 1998"))


@pytest.mark.parametrize("key", ["agg_group", "an_q1", "etl_upsert", "audit_daily_summary", "win_running", "stat_corr_matrix"])
def test_no_products_and_no_python_in_the_hot_path(spark, key):
    text = plan_text(load_plans()[key](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text and "Python" not in text


# --- layout

def test_partition_names(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 12, 31, 23),)], "ts timestamp_ntz")
    got = df.select(*[layout.time_partition("sales", F.col("ts"), i) for i in ("daily", "monthly", "yearly")],
                    layout.week_partition("sales", F.col("ts"), 7)).first()
    assert tuple(got) == ("sales_y2024m12d31", "sales_y2024m12", "sales_y2024", "sales_y2024m12d26")
    bounds = layout.future_partitions(spark.createDataFrame([("sales", dt.date(2024, 12, 5))], "table_name string, since date"), "monthly", 2)
    assert rows(bounds.select("partition_name", "lower", "upper"))[0] == ("sales_y2024m12", dt.date(2024, 12, 1), dt.date(2025, 1, 1))
    for interval, n in (("daily", 60), ("monthly", 2), ("yearly", 1)):
        assert layout.future_partitions(spark.createDataFrame([("t", dt.date(2024, 1, 1))], "table_name string, since date"), interval, 2).count() == n


def test_retention_splits_everything(spark, tables):
    as_of = F.expr("timestamp_ntz'2001-08-01'")
    kinds = tables.orders.groupBy(layout.retention_class(F.col("o_orderdate"), as_of, 24, 12).alias("c")).count()
    assert {r.c for r in kinds.collect()} == {"keep", "archive", "drop"}
    assert kinds.agg(F.sum("count")).first()[0] == tables.orders.count()


def test_a_hot_partition_is_split_into_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        df = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"),
                                         F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("p"))
        path = str(tmp_path / "t")
        assert layout.write_partitioned(df, ["p"], path).count() == 200_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files_per = {r.partition_value: r.files for r in layout.partition_report(spark, path, "p").collect()}
    assert files_per["hot"] > 1


def test_rebalance_plan(spark):
    def plan(sizes):
        return layout.rebalance_plan(spark.createDataFrame(list(enumerate(sizes)), "node int, size long")).first()

    p = plan([100, 100, 160])
    assert p.rebalance and p.from_node == 2 and p.to_node == 0
    assert not plan([100, 110, 105]).rebalance


def test_hash_parts_equal_the_plain_job(tables):
    job = lambda df: df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    assert rows(layout.by_key(tables.orders, "o_custkey", 5, job)) == rows(job(tables.orders))


def test_distribution_strategies(tables):
    assert layout.distribute(tables.orders, "hash", "o_custkey", 4).rdd.getNumPartitions() == 4
    assert layout.distribute(tables.orders, "range", "o_orderdate", 4).rdd.getNumPartitions() <= 4
    assert layout.partition_sizes(layout.distribute(tables.orders, "append")).agg(F.sum("size")).first()[0] == tables.orders.count()
    with pytest.raises(ValueError):
        layout.distribute(tables.orders, "other")


# --- sources

@pytest.mark.parametrize("source,kind,length,want", [
    ("mysql", "tinyint", 1, "BOOLEAN"), ("mysql", "tinyint", 4, "SMALLINT"), ("mysql", "DateTime", None, "TIMESTAMP"),
    ("mysql", "enum", None, "TEXT"), ("mysql", "geography", None, "TEXT"), ("mssql", "bit", None, "BOOLEAN"),
    ("mssql", "uniqueidentifier", None, "UUID"), ("mssql", "decimal", None, "NUMERIC(9,2)"), ("mssql", "nvarchar", 30, "VARCHAR(30)"),
    ("postgres", "Text", None, "text"), ("db2", "longint", None, "INTEGER"), ("db2", "geography", None, "TEXT")])
def test_type_maps(spark, source, kind, length, want):
    got = spark.range(1).select(federation.map_type(F.lit(kind), F.lit(length).cast("int"), F.lit(9), F.lit(2), source).alias("t")).first().t
    assert got == want


def test_jdbc_options():
    got = federation.jdbc_options("mysql", "orders", {"host": "h", "dbname": "d", "user": "u"}, ("id", 1, 100, 8))
    assert got["url"] == "jdbc:mysql://h:3306/d" and got["numPartitions"] == "8" and got["partitionColumn"] == "id" and got["user"] == "u"
    assert federation.jdbc_options("mssql", "t", {"host": "h", "dbname": "d"})["url"] == "jdbc:sqlserver://h:1433;databaseName=d"
    assert federation.jdbc_options("sqlite", "t", {"dbname": "/x.db"})["url"] == "jdbc:sqlite:/x.db"
    assert federation.foreign_schema([("a", "bigint"), ("b", "datetime"), ("c", "enum")], "mysql") == "`a` bigint, `b` timestamp_ntz, `c` string"
    with pytest.raises(ValueError):
        federation.jdbc_options("mysql", "t", {}, ("id; drop", 1, 2, 3))


def test_source_options(spark):
    df = spark.createDataFrame([("postgres", "postgresql://u:p@db.host:6000/shop?x=1", "{}"), ("mysql", "h2", "{}"),
                                ("redis", "h3:1", '{"port":"7"}'), ("sqlite", "/a/b.db", "{}")], "source_type string, connection string, options string")
    got = {r.source_type: (r.host, r.port, r.dbname) for r in federation.source_options(df).collect()}
    assert got == {"postgres": ("db.host", "6000", "shop"), "mysql": ("h2", "3306", None), "redis": ("h3", "7", None), "sqlite": (None, None, "/a/b.db")}


def test_virtual_schema(spark, tables):
    schema = federation.VirtualSchema(spark, "shop", "parquet")
    schema.add_table("orders", tables.orders, {"o_orderkey": ("id", "string")}, where="id = '1'")
    assert schema.table("orders").dtypes == [("id", "string")] and schema.table("orders", filtered=True).count() <= 1
    assert schema.registry().count() == 1 and schema.drop() == 1 and not spark.catalog.tableExists("shop_orders")


def test_csv_example(spark, tmp_path):
    (tmp_path / "e.csv").write_text('id,name,value\n1,"Item, one",10.5\n2,,20\n3,c,\n4,d,1\n5,e,2\n')
    path = str(tmp_path / "e.csv")
    df = files.scan_csv(spark, path, "id int, name string, value double")
    assert df.count() == 5 and df.first().name == "Item, one"
    target = str(tmp_path / "t")
    assert files.optimized_copy(spark, path, "id int, name string, value double", target, truncate_before=True) == 5
    assert files.optimized_copy(spark, path, "id int, name string, value double", target) == 5
    assert spark.read.parquet(target).count() == 10


def test_analytics_table_names_are_checked(tables, tmp_path):
    with pytest.raises(ValueError):
        files.write_analytics_table(tables.orders, "bad-name!", "t", "o_orderkey bigint", str(tmp_path))
    with pytest.raises(ValueError):
        files.write_analytics_table(tables.orders, "s", "t", "o_orderkey bigint; drop table x", str(tmp_path))
    got = files.write_analytics_table(tables.orders, "s", "t", "o_orderkey bigint, o_totalprice decimal(18, 2)", str(tmp_path))
    assert got.dtypes == [("o_orderkey", "bigint"), ("o_totalprice", "decimal(18,2)")]


# --- functions

def test_catalog_examples_and_drop(spark):
    catalog = udfs.Catalog(spark)
    catalog.create_sql("lw_add", "a INT, b INT", "INT", "a + b", tags=("math",))
    catalog.add_example("lw_add", "lw_add(2, 3)", "5")
    catalog.add_example("lw_add", "lw_add(2, 2)", "5")
    assert catalog.run_examples("lw_add") == [("lw_add(2, 3)", "5", True), ("lw_add(2, 2)", "4", False)]
    assert catalog.frame().first().example_count == 2
    assert catalog.drop("lw_add") and not catalog.drop("lw_add")
    with pytest.raises(Exception):
        spark.sql("SELECT lw_add(1, 2)").collect()


def test_failing_batches_are_reported(spark):
    def picky(batch: pd.DataFrame):
        if (batch["id"] == 5).any():
            raise ValueError("five")

    facts = udfs.batch_execute(spark.range(0, 40, 1, 4), picky).collect()
    assert sum(r.rows for r in facts) == 40 and [r.error for r in facts if not r.success] == ["five"]


def test_script_round_trip(spark):
    df = spark.createDataFrame([("tools", "f", "python", "x INT", "DOUBLE", "line one\nline two")],
                               "schema_name string, name string, language string, signature string, return_type string, source string")
    back = udfs.import_scripts(udfs.export_scripts(df).select("script"))
    assert rows(back.select(df.columns)) == rows(df)


# --- statistics, series, neighbours, migration

def test_outlier_fixture(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(9)] + [(9, 10.0)], "id int, v double")
    flagged = stats.zscore_outliers(df, [], "v").where("is_outlier").collect()
    assert [(r.id, round(r.z_score, 3)) for r in flagged] == [(9, 2.846)]
    assert stats.remove_outliers_iqr(df, [], "v").count() == 9
    constant = df.where("id < 9")
    assert stats.zscore_outliers(constant, [], "v").where("is_outlier").isEmpty()


def test_regression_and_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, 4.0, 1.0), (3.0, 6.0, 2.0)], "x double, y double, z double")
    assert stats.regression(df, [], "y", "x").first().slope == pytest.approx(2)
    flat = df.withColumn("x", F.lit(1.0))
    assert stats.regression(flat, [], "y", "x").first().slope is None
    m = {(r.col1, r.col2): r.correlation for r in stats.correlation_matrix(df, ["x", "y", "z"]).collect()}
    assert all(m[(a, a)] == pytest.approx(1) for a in "xyz") and all(m[(a, b)] == pytest.approx(m[(b, a)]) for a in "xyz" for b in "xyz")


def test_describe_matches_numpy(spark):
    values = np.random.default_rng(5).normal(10, 2, 400)
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, v double")
    got = stats.describe(df, ["g"], "v").first()
    assert got.median == pytest.approx(np.median(values)) and got.q1 == pytest.approx(np.quantile(values, 0.25))
    assert got.std_dev == pytest.approx(values.std(ddof=1)) and got.is_normal
    skewed = spark.createDataFrame([("a", float(v)) for v in np.exp(values / 4)], "g string, v double")
    assert not stats.describe(skewed, ["g"], "v").first().is_normal


def test_interpolation(spark):
    def at(h):
        return dt.datetime(2024, 1, 1, h)

    samples = spark.createDataFrame([("a", at(2), 1, 10.0), ("a", at(6), 2, 30.0), ("a", at(8), 3, None)], "k string, ts timestamp_ntz, id int, v double")
    points = spark.createDataFrame([("a", at(h)) for h in (1, 2, 3, 6, 9)], "k string, ts timestamp_ntz")
    got = timeseries.interpolate(samples, points, ["k"], "ts", "id", "v", chunks=3).orderBy("ts").collect()
    assert [r.value for r in got] == [10.0, 10.0, 15.0, 30.0, 30.0]


def test_forecast_continues_a_line(spark):
    df = spark.createDataFrame([("a", i, 5.0 + 2 * i) for i in range(20)] + [("b", 0, 4.0)], "k string, t int, v double")
    got = timeseries.forecast(df, ["k"], "t", "v").orderBy("k", "step").collect()
    a = [r for r in got if r.k == "a"]
    assert len(a) == 6 and [round(r.point_forecast, 6) for r in a] == [45.0 + 2 * i for i in range(6)]
    assert all(r.lower_95 <= r.lower_80 <= r.point_forecast <= r.upper_80 <= r.upper_95 for r in got)
    assert [r.point_forecast for r in got if r.k == "b"] == [4.0]


def test_decompose_adds_up(spark):
    df = spark.createDataFrame([("a", i, float(i + [0, 3, -3][i % 3])) for i in range(30)], "k string, t int, v double")
    got = timeseries.decompose(df, ["k"], "t", "v", 3).where("trend IS NOT NULL").collect()
    assert len(got) == 28 and all(r.v == pytest.approx(r.trend + r.seasonal + r.residual) for r in got)


def test_nearest_is_exact(spark, tables):
    vectors = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in tables.embeddings.select("vec_id", "embedding").collect()]
    asked = tables.embeddings.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = nearest.l2_topk(tables.embeddings.repartition(7), "vec_id", "embedding", asked, 5).collect()
    for q in range(3):
        want = sorted((float(np.sqrt(((v - vectors[q][1]) ** 2).sum())), i) for i, v in vectors)[:5]
        assert [r.neighbor for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in want]
    assert nearest.l2_topk(tables.embeddings, "vec_id", "embedding", asked.limit(0), 5).isEmpty()
    sliced = nearest.l2_topk(tables.embeddings, "vec_id", "embedding", asked, 5, slice_size=1)
    assert rows(sliced.select("query_id", "rank", "neighbor")) == sorted(((r.query_id, r["rank"], r.neighbor) for r in got), key=repr)


def test_top_per_key_limits_before_the_shuffle(tables):
    text = plan_text(top_per_key(tables.events, ["event_type"], [F.col("value").desc(), F.col("event_id").asc()], 3))
    assert "WindowGroupLimit" in text


def test_small_tables_are_sent_by_size_alone(tables):
    from lakewright.operators import layout

    joined = tables.customer.join(layout.distribute(tables.nation, "reference"), F.col("c_nationkey") == F.col("n_nationkey"))
    assert "BroadcastHashJoin" in plan_text(joined) and "ResolvedHint" not in plan_text(joined)


def test_haversine(spark):
    km = spark.range(1).select(nearest.haversine_km(F.lit(13.405), F.lit(52.52), 2.3522, 48.8566).alias("km")).first().km
    assert km == pytest.approx(877.5, abs=1.5)


def test_chunk_plan(spark):
    counts = spark.createDataFrame([("small", 3), ("large", 250), ("empty", 0)], "table_name string, row_count long")
    got = rows(migrate.chunk_plan(counts, 100))
    assert got == [("empty", 0, 0, True), ("large", 0, 100, True), ("large", 100, 100, False), ("large", 200, 50, False), ("small", 0, 3, True)]


def test_reconcile_finds_a_lost_row(tables):
    amounts = {"total": F.col("o_totalprice").cast("decimal(18,2)")}
    assert migrate.reconcile(tables.orders, tables.orders, amounts).where("NOT matches").isEmpty()
    short = tables.orders.where("o_orderkey > 0")
    assert migrate.reconcile(tables.orders, short, amounts).where("NOT matches").count() == 2


@pytest.mark.parametrize("name", ["documents", "conversations"])
def test_delimited_files_keep_texts(spark, tables, tmp_path, name):
    from lakewright.sources import files

    odd = spark.createDataFrame([('a "quoted"\nline\\', ""), (" spaces ", None), ("\r\n", "x,y|z")], "text string, other string")
    given = getattr(tables, name)
    for k, df in enumerate((given, odd, tables.events.select("event_id", (F.col("ts") + F.expr("INTERVAL 123456 MICROSECOND")).alias("ts"),
                                                             F.lit("2024-01-01 00:00:00.123456").cast("timestamp").alias("zoned")))):
        fmt = files.CsvFormat(null_string="\\N")
        path = str(tmp_path / f"{k}")
        files.export_csv(df, path, fmt)
        back = files.scan_csv(spark, path, ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes), fmt)
        assert back.exceptAll(df).isEmpty() and df.exceptAll(back).isEmpty()
    assert rows(migrate.copy_table(odd, str(tmp_path / "staged"), str(tmp_path / "copy"))) == rows(odd)


def test_uniqueness_is_exact(spark):
    """A column with one repeated value beyond the rows that are looked at first, and one with a single null."""
    from lakewright.operators.layout import choose_key, is_unique

    df = spark.range(3000).select(F.when(F.col("id") == 2999, 7).otherwise(F.col("id")).alias("nearly"), F.when(F.col("id") != 5, F.col("id")).alias("gap"), "id")
    assert [is_unique(df, c, look=100) for c in ("nearly", "gap", "id")] == [False, False, True]
    assert choose_key(df, "t").first().key == "id" and "Expand" not in plan_text(df.groupBy("id").count())
    assert choose_key(df.select("nearly", "gap"), "t").first().reason == "first column"
    assert choose_key(df.limit(0), "t").first().row_count == 0


def test_statistics_multiply_no_rows(spark, tables):
    from lakewright.operators.stats import profile
    from lakewright.sources.federation import table_stats

    df = spark.createDataFrame([("a", 1), ("a", None), ("bb", 2), (None, 2)], "s string, n int")
    got = {r.column_name: r for r in table_stats(df, ["s", "n"], 2).collect()}
    assert (got["s"].row_count, got["s"].avg_row_size, got["s"].null_frac, got["s"].n_distinct) == (4, 4.0, 0.25, 2)
    assert (got["s"].most_common_vals, got["s"].most_common_freqs) == ("a,bb", "0.500000,0.250000")
    assert (got["n"].most_common_vals, got["n"].most_common_freqs) == ("2,1", "0.500000,0.250000")
    assert table_stats(df.limit(0), ["s"], 2).isEmpty()
    for out in (table_stats(tables.events, ["event_type", "user_id"], 3), profile(tables.events, ["event_type", "user_id"])):
        assert "Expand" not in plan_text(out)


def test_a_text_load_counts_rows_and_reports_bad_lines(spark, tmp_path):
    from lakewright.sources.files import load_csv_text

    lines = ["1,a,2.5", "2,,", "x,b,1", "3,c", "4,d,1,9", None, "", '5,"e,f",-1', "6,g,many"]
    done = load_csv_text(spark.createDataFrame([(x,) for x in lines], "t string"), "t", "n int, s string, v double", str(tmp_path / "out"))
    got = sorted(tuple(r) for r in spark.read.parquet(done.path).collect())
    bad = sorted(r.line for r in spark.read.parquet(done.bad_path).collect())
    assert got == [(1, "a", 2.5), (2, None, None), (5, "e,f", -1.0)] and (done.rows, done.bad) == (3, 4)
    assert bad == ["3,c", "4,d,1,9", "6,g,many", "x,b,1"]


def test_functions_take_whole_batches():
    import pandas as pd

    from lakewright.plans.layouts import array_span, as_json

    assert array_span(pd.Series([np.array([1.0, 4.0]), None, np.array([]), np.array([-2, 3, 3])])).tolist()[::3] == [3.0, 5.0]
    assert as_json(pd.Series(['a"b', "c\\"]), pd.Series([1, 2])).tolist() == ['{"kind":"a\\"b","user":1}', '{"kind":"c\\\\","user":2}']


def test_buckets_grow_with_the_rows_and_are_one_file_each(spark, tables, tmp_path):
    assert [joins.bucket_count(4, spark.range(10), spark.range(n), rows=10) for n in (0, 40, 41, 400)] == [4, 4, 8, 40]
    lines = tables.lineitem.select("l_orderkey", "l_extendedprice").repartition(5)
    stored = joins.write_bucketed(lines, "lines_by_bucket", str(tmp_path / "lines"), "l_orderkey", 12)
    assert stored.select(F.input_file_name()).distinct().count() == 12
    assert rows(stored) == rows(lines)
