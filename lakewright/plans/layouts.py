"""Partition, distribution, source, federation, catalogue, function and migration queries."""

from __future__ import annotations

import json
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


from lakewright.operators import layout, migrate, udfs
from lakewright.plans.registry import plan
from lakewright.plans.relational import COLOCATED_SQL, colocated_orders
from lakewright.plans.workloads import K_SQL, SERVICE_SQL, k_of, ntz, service
from lakewright.sources import federation, files
from lakewright.sources.tables import TABLES, scratch_path
from lakewright.sources.versioned import VersionedTable

C = F.col

# --- partitions


@plan("part_time", """SELECT 'orders' || strftime(o_orderdate, '_y%Ym%m') AS partition_name, strftime(min(date_trunc('month', o_orderdate)), '%Y-%m-%d') AS lower,
  strftime(min(date_trunc('month', o_orderdate)) + INTERVAL 1 MONTH, '%Y-%m-%d') AS upper, count(*) AS n FROM orders GROUP BY 1""")
def part_time(t):
    rows = t.orders.withColumn("partition_name", layout.time_partition("orders", C("o_orderdate"), "monthly"))
    written = layout.write_partitioned(rows, ["partition_name"], scratch_path(t.spark, "by_month"))
    lower = F.trunc(F.min("o_orderdate"), "month")
    return written.groupBy("partition_name").agg(
        lower.cast("string").alias("lower"), F.add_months(lower, 1).cast("string").alias("upper"), F.count(F.lit(1)).alias("n"))


@plan("part_list", """SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'orders_fast' WHEN o_orderpriority = '3-MEDIUM' THEN 'orders_normal' ELSE 'orders_default' END AS partition_name,
  count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def part_list(t):
    name = layout.list_partition("orders", C("o_orderpriority"), {"fast": ["1-URGENT", "2-HIGH"], "normal": ["3-MEDIUM"]})
    written = layout.write_partitioned(t.orders.withColumn("partition_name", name), ["partition_name"], scratch_path(t.spark, "by_list"))
    return written.groupBy("partition_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@plan("part_hash", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, 0::BIGINT AS keys_in_two_partitions, true AS within_modulus FROM orders")
def part_hash(t):
    rows = t.orders.withColumn("part", layout.hash_partition(C("o_custkey"), 8))
    written = layout.write_partitioned(rows, ["part"], scratch_path(t.spark, "by_hash"))
    per_key = written.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    return per_key.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.count_if(C("lo") != C("hi")).alias("keys_in_two_partitions"),
                       ((F.min("lo") >= 0) & (F.max("hi") < 8)).alias("within_modulus"))


@plan("part_future", """SELECT s || strftime(m, '_y%Ym%m') AS partition_name, strftime(m, '%Y-%m-%d') AS lower, strftime(m + INTERVAL 1 MONTH, '%Y-%m-%d') AS upper
FROM (SELECT 'orders_' || o_orderstatus AS s, unnest(generate_series(date_trunc('month', max(o_orderdate))::TIMESTAMP, date_trunc('month', max(o_orderdate))::TIMESTAMP + INTERVAL 5 MONTH, INTERVAL 1 MONTH)) AS m FROM orders GROUP BY 1)""")
def part_future(t):
    since = t.orders.groupBy(F.concat(F.lit("orders_"), "o_orderstatus").alias("table_name")).agg(F.max("o_orderdate").alias("since"))
    out = layout.future_partitions(since, "monthly", 6)
    return out.select("partition_name", C("lower").cast("string").alias("lower"), C("upper").cast("string").alias("upper"))


CLASS_SQL = """CASE WHEN date_trunc('month', o_orderdate) < TIMESTAMP '2001-08-01' - INTERVAL 60 MONTH THEN 'drop'
  WHEN date_trunc('month', o_orderdate) < TIMESTAMP '2001-08-01' - INTERVAL 36 MONTH THEN 'archive' ELSE 'keep' END"""


@plan("part_retention", f"""SELECT {CLASS_SQL} AS class, strftime(o_orderdate, '%Y%m') AS part_month, count(*) AS n FROM orders WHERE {CLASS_SQL} <> 'drop' GROUP BY 1, 2""")
def part_retention(t):
    kept, archived = layout.apply_retention(t.orders, "o_orderdate", ntz("2001-08-01"), 36, 24,
                                            scratch_path(t.spark, "kept"), scratch_path(t.spark, "archive"))
    both = kept.withColumn("class", F.lit("keep")).unionByName(archived.withColumn("class", F.lit("archive")))
    return both.groupBy("class", C("part_month").cast("string").alias("part_month")).agg(F.count(F.lit(1)).alias("n"))


@plan("part_list_report", "SELECT strftime(o_orderdate, '%Y') AS partition_value, count(*) AS row_count, true AS has_files FROM orders GROUP BY 1")
def part_list_report(t):
    path = scratch_path(t.spark, "by_year")
    layout.write_partitioned(t.orders.withColumn("part", F.year("o_orderdate")), ["part"], path)
    report = layout.partition_report(t.spark, path, "part")
    return report.select("partition_value", "row_count", ((C("files") > 0) & (C("bytes") > 0)).alias("has_files"))


@plan("part_drop_old_doc", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 400 DAY")
def part_drop_old_doc(t):
    return layout.drop_older(t.orders, "o_orderdate", ntz("2001-08-01"), 400).select("o_orderkey")


@plan("part_maintain_all", f"""SELECT 'orders' AS table_name, count(*) FILTER ({CLASS_SQL} = 'keep') AS keep_rows, count(*) FILTER ({CLASS_SQL} = 'archive') AS archive_rows,
  count(*) FILTER ({CLASS_SQL} = 'drop') AS drop_rows, ((2002 - year(max(o_orderdate))) * 12 + 2 - month(max(o_orderdate)))::INT AS months_to_plan FROM orders
UNION ALL SELECT 'lineitem', count(*) FILTER ({CLASS_SQL.replace('o_orderdate', 'l_shipdate')} = 'keep'), count(*) FILTER ({CLASS_SQL.replace('o_orderdate', 'l_shipdate')} = 'archive'),
  count(*) FILTER ({CLASS_SQL.replace('o_orderdate', 'l_shipdate')} = 'drop'), ((2002 - year(max(l_shipdate))) * 12 + 2 - month(max(l_shipdate)))::INT FROM lineitem""")
def part_maintain_all(t):
    return layout.maintain({"orders": (t.orders, "o_orderdate"), "lineitem": (t.lineitem, "l_shipdate")}, ntz("2001-08-01"), 36, 24, 6)


@plan("size_breakdown_doc", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, true AS has_bytes FROM {n}" for n in TABLES))
def size_breakdown_doc(t):
    return layout.size_breakdown(t.spark, {n: t.path(n) for n in TABLES}).select("table_name", "row_count", (C("bytes") > 0).alias("has_bytes"))


@plan("part_copy", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1, 2")
def part_copy(t):
    copied = layout.write_partitioned(t.lineitem, ["l_returnflag", "l_linestatus"], scratch_path(t.spark, "copy"))
    return copied.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@plan("part_prune", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1")
def part_prune(t):
    written = layout.write_partitioned(t.orders.withColumn("y", F.year("o_orderdate")), ["y"], scratch_path(t.spark, "by_year"))
    return written.where("y = 1998").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# --- distribution

@plan("dist_choose_key", """SELECT 'orders' AS table_name, 'o_orderkey' AS key, 'hash' AS strategy, 'unique column' AS reason, count(*) AS row_count FROM orders
UNION ALL SELECT 'lineitem', 'l_shipdate', 'range', 'first time column', count(*) FROM lineitem""")
def dist_choose_key(t):
    return layout.choose_key(t.orders, "orders").unionByName(layout.choose_key(t.lineitem, "lineitem"))


@plan("dist_schema", """SELECT 'customer' AS table_name, 'c_custkey' AS key, 'hash' AS strategy, 'unique column' AS reason, count(*) AS row_count FROM customer
UNION ALL SELECT 'orders', 'o_orderkey', 'hash', 'unique column', count(*) FROM orders
UNION ALL SELECT 'lineitem', 'l_shipdate', 'range', 'first time column', count(*) FROM lineitem
UNION ALL SELECT 'conversations', 'conv_id', 'hash', 'first column', count(*) FROM conversations""")
def dist_schema(t):
    return layout.distribute_schema({"customer": t.customer, "orders": t.orders, "lineitem": t.lineitem,
                                     "conversations": t.conversations.select("conv_id", "turn", "role"), "region": t.region}, exclude=["region"])


@plan("dist_table", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS keys, 0::BIGINT AS split_keys FROM orders")
def dist_table(t):
    placed = layout.distribute(t.orders.select("o_custkey"), "hash", "o_custkey", 8).withColumn("node", F.spark_partition_id())
    per_key = placed.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    return per_key.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("keys"), F.count_if(C("lo") != C("hi")).alias("split_keys"))


@plan("dist_rebalance_plan", """WITH s AS (SELECT c_nationkey AS node, count(*) AS size FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT (arg_max(node, (size, node)))::INT AS from_node, (arg_min(node, (size, node)))::INT AS to_node, (max(size) - min(size)) // 2 AS move_rows,
  greatest(max(size) - avg(size), avg(size) - min(size)) > avg(size) * 0.2 AS rebalance FROM s""")
def dist_rebalance_plan(t):
    sizes = (t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).groupBy(C("c_nationkey").alias("node"))
             .agg(F.count(F.lit(1)).alias("size")))
    return layout.rebalance_plan(sizes)


plan("dist_colocate", COLOCATED_SQL)(lambda t: colocated_orders(t, 4))


@plan("par_hash_split", "SELECT l_partkey, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def par_hash_split(t):
    return layout.by_key(t.lineitem.select("l_partkey", "l_extendedprice"), "l_partkey", 8, lambda df: df.groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")))


@plan("layout_compare", "SELECT 'lineitem' AS table_name, count(*) > 0 AS columns_smaller FROM lineitem")
def layout_compare(t):
    sizes = layout.format_sizes(t.lineitem, scratch_path(t.spark, "formats"))
    return sizes.select(F.lit("lineitem").alias("table_name"), (C("ratio") > 1).alias("columns_smaller"))


# --- scans and files

@plan("scan_table", "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND l_quantity > 45")
def scan_table(t):
    return (t.lineitem.where((C("l_shipdate") >= ntz("2001-01-01")) & (C("l_quantity") > 45))
            .select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate"))


@plan("scan_columnar_agg", "SELECT round(sum(l_tax), 2) / count(*) AS average, min(l_tax) AS lowest, max(l_tax) AS highest FROM lineitem")
def scan_columnar_agg(t):
    return t.lineitem.agg((F.round(F.sum("l_tax"), 2) / F.count(F.lit(1))).alias("average"), F.min("l_tax").alias("lowest"), F.max("l_tax").alias("highest"))


CUSTOMER_CSV = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def exported(t, df, fmt=files.CsvFormat()):
    path = scratch_path(t.spark, "export")
    files.export_csv(df, path, fmt)
    return path


@plan("scan_csv", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'")
def scan_csv(t):
    rows = files.scan_csv(t.spark, exported(t, t.customer), CUSTOMER_CSV)
    return rows.where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal")


@plan("optimized_copy", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment FROM customer")
def optimized_copy(t):
    fmt = files.CsvFormat(delimiter="|", null_string="\\N", header=False)
    source = exported(t, t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY"))), fmt)
    target = scratch_path(t.spark, "copied")
    files.optimized_copy(t.spark, source, CUSTOMER_CSV, target, fmt, truncate_before=True)
    return t.spark.read.parquet(target)


@plan("csv_text_to_table", "SELECT p_partkey, p_name, p_retailprice FROM part")
def csv_text_to_table(t):
    line = F.concat_ws(",", C("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name", F.lit('"')), C("p_retailprice").cast("string"))
    return files.csv_text_to_table(t.part.select(line.alias("line")), "line", "p_partkey bigint, p_name string, p_retailprice double")


@plan("csv_text_load", "SELECT count(*) AS loaded, count(*) FILTER (p_partkey % 10 = 3) AS bad, round(sum(p_retailprice) FILTER (p_partkey % 10 <> 3), 2) AS total, count(*) FILTER (p_partkey % 10 <> 3) AS stored FROM part")
def csv_text_load(t):
    """Every tenth line has a price that is no number; it is reported and not stored. ``loaded`` counts all lines taken."""
    price = F.when(C("p_partkey") % 10 == 3, F.lit("cheap")).otherwise(C("p_retailprice").cast("string"))
    line = F.concat_ws(",", C("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name", F.lit('"')), price)
    done = files.load_csv_text(t.part.select(line.alias("line")), "line", "p_partkey bigint, p_name string, p_retailprice double", scratch_path(t.spark, "parts"))
    return t.spark.read.parquet(done.path).agg(
        F.lit(done.rows + done.bad).cast("long").alias("loaded"), F.lit(done.bad).cast("long").alias("bad"),
        F.round(F.sum("p_retailprice"), 2).alias("total"), F.count(F.lit(1)).alias("stored"))


@plan("import_csv", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def import_csv(t):
    path = exported(t, t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"))
    return files.scan_csv(t.spark, path, "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz")


@plan("export_csv", "SELECT count(*) AS n, count(DISTINCT p_partkey) AS keys FROM part")
def export_csv(t):
    back = files.scan_csv(t.spark, exported(t, t.part), "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    return back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("p_partkey").alias("keys"))


@plan("write_analytics_table", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def write_analytics_table(t):
    return files.write_analytics_table(t.orders, "analytics", "order_totals", "o_orderkey bigint, o_totalprice double, o_orderstatus  string",
                                       scratch_path(t.spark, "warehouse"))


@plan("df_from_query", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def df_from_query(t):
    return files.frame_from_query(t.spark, "SELECT n_name, count(*) AS customers FROM {c} JOIN {n} ON c_nationkey = n_nationkey GROUP BY 1",
                                  {"c": t.customer, "n": t.nation})


@plan("df_to_table", "SELECT s_suppkey, s_name FROM supplier")
def df_to_table(t):
    name = f"supplier_{uuid.uuid4().hex[:12]}"
    return files.frame_to_table(t.supplier.select("s_suppkey", "s_name"), name, scratch_path(t.spark, name))


@plan("ctas", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def ctas(t):
    path = scratch_path(t.spark, "ctas")
    result = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    result.write.parquet(path)
    return files.create_like(result).unionByName(t.spark.read.parquet(path))


@plan("gen_series_table", """SELECT i AS id, 'category_' || (i % 8) AS category, ['card', 'cash', 'transfer'][i % 3 + 1] AS payment, strftime(TIMESTAMP '2022-01-01' + to_days((i % 1000)::INT), '%Y-%m-%d') AS sale_date
FROM (SELECT unnest(range(1, max(o_orderkey) + 2)) AS i FROM orders)""")
def gen_series_table(t):
    n = t.orders.agg(F.max("o_orderkey")).first()[0] + 1
    return files.series_table(t.spark, n, {
        "category": F.concat(F.lit("category_"), (C("id") % 8).cast("string")),
        "payment": F.element_at(F.array(F.lit("card"), F.lit("cash"), F.lit("transfer")), (C("id") % 3 + 1).cast("int")),
        "sale_date": F.date_add(F.lit("2022-01-01").cast("date"), (C("id") % 1000).cast("int")).cast("string")})


@plan("inline_values", """SELECT o_orderkey, v.label, v.weight FROM orders JOIN (VALUES ('F', 'finished', 1), ('O', 'open', 2), ('P', 'partly', 3)) AS v(status, label, weight) ON o_orderstatus = v.status""")
def inline_values(t):
    rows = t.spark.createDataFrame([("F", "finished", 1), ("O", "open", 2), ("P", "partly", 3)], "status string, label string, weight int")
    return t.orders.join(rows, C("o_orderstatus") == C("status")).select("o_orderkey", "label", "weight")


@plan("pandas_type_map", """SELECT 'l_quantity' AS column_name, CASE WHEN count(*) FILTER (l_quantity <> floor(l_quantity)) = 0 THEN 'INTEGER' ELSE 'DOUBLE PRECISION' END AS type FROM lineitem
UNION ALL SELECT 'l_discount', CASE WHEN count(*) FILTER (l_discount <> floor(l_discount)) = 0 THEN 'INTEGER' ELSE 'DOUBLE PRECISION' END FROM lineitem
UNION ALL SELECT 'l_returnflag', 'TEXT' UNION ALL SELECT 'l_shipdate', 'TIMESTAMP' UNION ALL SELECT 'l_orderkey', 'INTEGER'""")
def pandas_type_map(t):
    return files.frame_types(t.lineitem.select("l_quantity", "l_discount", "l_returnflag", "l_shipdate", "l_orderkey"), split_whole=True)


@plan("tbl_column_count", "SELECT count(*) AS row_count, count(nullif(event_type, 'error')) AS filled, count(DISTINCT nullif(event_type, 'error')) AS different FROM events")
def tbl_column_count(t):
    column = t.events.select(F.nullif("event_type", F.lit("error")).alias("v"))
    return column.agg(F.count(F.lit(1)).alias("row_count"), F.count("v").alias("filled"), F.countDistinct("v").alias("different"))


# --- federation

def relational(source, columns):
    def build(t):
        rows = t.orders.select(C("o_orderkey").alias("id"), C("o_totalprice").alias("amount"), C("o_orderdate").alias("placed"),
                               C("o_orderstatus").alias("status"))
        return federation.foreign_table(t.spark, source, columns, path=exported(t, rows))

    return build


FOREIGN_SQL = "SELECT o_orderkey AS id, o_totalprice AS amount, o_orderdate AS placed, o_orderstatus AS status FROM orders"
for _key, _source, _types in (
        ("fdw_postgres", "postgres", ("bigint", "double precision", "timestamp", "text")),
        ("fdw_mysql", "mysql", ("bigint", "double", "datetime", "enum")),
        ("fdw_mssql", "mssql", ("bigint", "float", "datetime2", "nvarchar")),
        ("fdw_sqlite", "sqlite", ("bigint", "real", "timestamp", "text")),
        ("fdw_oracle", "oracle", ("bigint", "number", "date", "varchar2"))):
    plan(_key, FOREIGN_SQL)(relational(_source, list(zip(("id", "amount", "placed", "status"), _types))))


@plan("fdw_mongo", """SELECT c_custkey AS id, c_name AS name, n_name AS country, count(o_orderkey) AS orders, coalesce(max(o_orderkey), -1) AS last_order
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def fdw_mongo(t):
    keys = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last"))
    documents = (t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey")).join(keys, C("c_custkey") == C("o_custkey"), "left")
                 .select(C("c_custkey").alias("_id"), F.struct(C("c_name").alias("name"), F.struct(C("n_name").alias("country")).alias("address")).alias("profile"),
                         F.array(F.coalesce("n", F.lit(0)), F.coalesce("last", F.lit(-1))).alias("orders")))
    path = scratch_path(t.spark, "documents")
    documents.write.json(path)
    schema = "_id bigint, profile struct<name: string, address: struct<country: string>>, orders array<bigint>"
    return t.spark.read.schema(schema).json(path).select(
        C("_id").alias("id"), "profile.name", "profile.address.country", C("orders")[0].alias("orders"), C("orders")[1].alias("last_order"))


@plan("fdw_redis", "SELECT 'user:' || c_custkey AS key, c_name AS value FROM customer")
def fdw_redis(t):
    pairs = (t.customer.select(F.concat(F.lit("user:"), C("c_custkey").cast("string")).alias("key"), C("c_name").alias("value"))
             .unionByName(t.supplier.select(F.concat(F.lit("seller:"), C("s_suppkey").cast("string")).alias("key"), C("s_name").alias("value"))))
    return files.scan_csv(t.spark, exported(t, pairs), "key string, value string").where(C("key").like("user:%"))


def sources_registry(t):
    """One registered source per customer, its type and address taken from the row."""
    kinds = F.array(*[F.lit(k) for k in ("postgres", "mysql", "mssql", "mongodb", "redis", "sqlite")])
    kind = F.element_at(kinds, (C("c_custkey") % 6 + 1).cast("int"))
    host = F.concat(F.lit("host"), C("c_nationkey").cast("string"))
    port = F.when(C("c_custkey") % 2 == 0, F.concat(F.lit(":"), (C("c_custkey") + 2000).cast("string"))).otherwise("")
    url = F.when(kind == "sqlite", F.concat(F.lit("/data/"), "c_name")).otherwise(F.concat(F.lit("u:p@"), host, port, F.lit("/db"), C("c_nationkey").cast("string")))
    extra = F.when(C("c_mktsegment") == "BUILDING", F.lit('{"port":"9999"}')).otherwise("{}")
    return t.customer.select(C("c_custkey").alias("source_id"), kind.alias("source_type"), url.alias("connection"), extra.alias("options"))


SOURCES_SQL = """src AS (SELECT *, ['postgres', 'mysql', 'mssql', 'mongodb', 'redis', 'sqlite'][c_custkey % 6 + 1] AS source_type FROM customer)"""


@plan("vs_create", f"""WITH {SOURCES_SQL} SELECT c_custkey AS source_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'postgres' ELSE source_type END AS source_type,
  CASE WHEN c_mktsegment = 'BUILDING' THEN '{{"port":"9999"}}' ELSE '{{}}' END AS options FROM src""")
def vs_create(t):
    # Every source is registered; those of one segment are then registered again with another type.
    registry = VersionedTable.create(t.spark, scratch_path(t.spark, "sources"))
    registry.replace(sources_registry(t).select("source_id", "source_type", "options"))
    moved = registry.read().where(C("options") != "{}").withColumn("source_type", F.lit("postgres"))
    registry.upsert(moved, ["source_id"])
    return registry.read()


@plan("vs_setup_source", f"""WITH {SOURCES_SQL} SELECT c_custkey AS source_id, source_type, CASE WHEN source_type <> 'sqlite' THEN 'host' || c_nationkey END AS host,
  CASE WHEN source_type = 'sqlite' THEN NULL WHEN c_mktsegment = 'BUILDING' THEN '9999' WHEN c_custkey % 2 = 0 THEN (c_custkey + 2000)::VARCHAR
    ELSE CASE source_type WHEN 'postgres' THEN '5432' WHEN 'mysql' THEN '3306' WHEN 'mssql' THEN '1433' WHEN 'mongodb' THEN '27017' WHEN 'redis' THEN '6379' END END AS port,
  CASE WHEN source_type = 'sqlite' THEN '/data/' || c_name ELSE 'db' || c_nationkey END AS dbname FROM src""")
def vs_setup_source(t):
    return federation.source_options(sources_registry(t))


def virtual(t):
    schema = federation.VirtualSchema(t.spark, f"vs_{uuid.uuid4().hex[:8]}", "parquet")
    schema.add_table("orders", t.orders, {"o_orderkey": ("order_id", "string"), "o_totalprice": ("amount", "double"), "o_orderstatus": ("status", "string")},
                     where="status = 'F'")
    return schema


@plan("vs_add_table", "SELECT o_orderkey::VARCHAR AS order_id, o_totalprice AS amount, o_orderstatus AS status FROM orders WHERE o_orderstatus = 'F'")
def vs_add_table(t):
    return virtual(t).table("orders", filtered=True)


@plan("vs_import_all", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ("customer", "supplier", "part", "orders")))
def vs_import_all(t):
    schema = federation.VirtualSchema(t.spark, f"vs_{uuid.uuid4().hex[:8]}", "parquet")
    schema.import_all({n: getattr(t, n) for n in ("customer", "supplier", "part", "orders")})
    counts = [schema.table(n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in schema.tables]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


@plan("vs_column_defs", """SELECT 'c_custkey' AS column_name, 'bigint' AS type, count(c_custkey) AS filled FROM customer UNION ALL SELECT 'c_name', 'string', count(c_name) FROM customer
UNION ALL SELECT 'c_nationkey', 'int', count(c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', 'double', count(c_acctbal) FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment) FROM customer""")
def vs_column_defs(t):
    found = federation.column_definitions(t.customer)
    filled = t.customer.agg(*[F.count(c).alias(c) for c, _, _ in found])
    entries = F.array(*[F.struct(F.lit(target).alias("column_name"), F.lit(k).alias("type"), C(s).alias("filled")) for s, target, k in found])
    return filled.select(F.explode(entries).alias("e")).select("e.*")


VENDOR_TYPES = ("int", "tinyint", "decimal", "datetime", "varchar", "enum", "geography", "json")


@plan("vs_type_map", """WITH c AS (SELECT p_partkey, p_size, ['int', 'tinyint', 'decimal', 'datetime', 'varchar', 'enum', 'geography', 'json'][p_partkey % 8 + 1] AS k, (p_size % 4 + 1) AS n FROM part)
SELECT p_partkey, CASE k WHEN 'int' THEN 'INTEGER' WHEN 'tinyint' THEN CASE WHEN n = 1 THEN 'BOOLEAN' ELSE 'SMALLINT' END WHEN 'decimal' THEN 'NUMERIC(' || p_size || ',2)'
    WHEN 'datetime' THEN 'TIMESTAMP' WHEN 'varchar' THEN 'VARCHAR(' || n || ')' WHEN 'json' THEN 'JSONB' ELSE 'TEXT' END AS mysql_type,
  CASE k WHEN 'int' THEN 'INTEGER' WHEN 'tinyint' THEN 'SMALLINT' WHEN 'decimal' THEN 'NUMERIC(' || p_size || ',2)' WHEN 'datetime' THEN 'TIMESTAMP' WHEN 'varchar' THEN 'VARCHAR(' || n || ')' ELSE 'TEXT' END AS mssql_type,
  CASE k WHEN 'int' THEN 'INTEGER' WHEN 'tinyint' THEN 'INTEGER' WHEN 'decimal' THEN 'NUMERIC' WHEN 'datetime' THEN 'TIMESTAMP' WHEN 'enum' THEN 'NUMERIC' WHEN 'json' THEN 'JSONB' ELSE 'TEXT' END AS other_type FROM c""")
def vs_type_map(t):
    kind = F.element_at(F.array(*map(F.lit, VENDOR_TYPES)), (C("p_partkey") % 8 + 1).cast("int"))
    length, precision, scale = C("p_size") % 4 + 1, C("p_size"), F.lit(2)
    return t.part.select("p_partkey", *[federation.map_type(kind, length, precision, scale, s).alias(f"{s}_type")
                                        for s in ("mysql", "mssql", "other")])


@plan("vendor_type_map", """WITH c AS (SELECT p_partkey, ['DECIMAL(' || p_size || ',2)', 'VARCHAR(' || p_size || ')', 'CHAR(' || p_size || ')', 'DOUBLE', 'TIMESTAMP WITH LOCAL TIME ZONE', 'HASHTYPE', 'OTHER'][p_partkey % 7 + 1] AS k FROM part)
SELECT p_partkey, CASE WHEN k LIKE 'DECIMAL%' THEN replace(k, 'DECIMAL', 'NUMERIC') WHEN k = 'DOUBLE' THEN 'DOUBLE PRECISION' WHEN k LIKE 'TIMESTAMP%' THEN 'TIMESTAMP WITH TIME ZONE' WHEN k = 'HASHTYPE' THEN 'BYTEA' ELSE k END AS type FROM c""")
def vendor_type_map(t):
    sized = [F.concat(F.lit(f"{n}("), C("p_size").cast("string"), F.lit(f"{rest})")) for n, rest in (("DECIMAL", ",2"), ("VARCHAR", ""), ("CHAR", ""))]
    kinds = F.array(*sized, F.lit("DOUBLE"), F.lit("TIMESTAMP WITH LOCAL TIME ZONE"), F.lit("HASHTYPE"), F.lit("OTHER"))
    return t.part.select("p_partkey", federation.map_vendor_type(F.element_at(kinds, (C("p_partkey") % 7 + 1).cast("int"))).alias("type"))


STAT_COLUMNS = ("event_type", "kind", "user_id")
STATS_SQL = "WITH e AS (SELECT event_type, nullif(event_type, 'error') AS kind, user_id FROM events) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS row_count, avg(strlen(event_type) + coalesce(strlen(kind), 0) + 8) AS avg_row_size, count(*) FILTER ({c} IS NULL)::DOUBLE / count(*) AS null_frac, count(DISTINCT {c}) AS n_distinct,
  (SELECT string_agg(v, ',' ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM e WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3)) AS most_common_vals,
  (SELECT string_agg(printf('%.6f', round(n / (SELECT count(*) FROM e)::DOUBLE, 6)), ',' ORDER BY n DESC, v) FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM e WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3)) AS most_common_freqs FROM e"""
    for c in STAT_COLUMNS)


def stats_of_events(t):
    rows = t.events.select("event_type", F.nullif("event_type", F.lit("error")).alias("kind"), "user_id")
    return federation.table_stats(rows, STAT_COLUMNS, top=3)


plan("vs_refresh_stats", STATS_SQL)(stats_of_events)
plan("meta_statistics", STATS_SQL)(stats_of_events)


@plan("vs_table_info", """SELECT 'orders' AS table_name, 'parquet' AS source_type, 3::INT AS column_count, count(*) AS row_count FROM orders""")
def vs_table_info(t):
    schema = virtual(t)
    counted = schema.table("orders").agg(F.count(F.lit(1)).alias("row_count")).select(F.lit("orders").alias("table_name"), "row_count")
    return federation.table_info(schema.registry().select("table_name", "source_type", "column_count"), counted)


@plan("vs_usage_stats", f"""SELECT {SERVICE_SQL} AS schema_name, event_type AS table_name, count(*) AS query_count, sum(round(value * 100)::BIGINT)::BIGINT AS total_ms,
  sum(round(value * 100)::BIGINT)::DOUBLE / count(*) AS avg_ms, floor((count(*) FILTER ({K_SQL} < 50) * 20000 + count(*)) / (2 * count(*))::DOUBLE) / 100.0::DOUBLE AS pushdown_percentage
FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1, 2""")
def vs_usage_stats(t):
    access = t.events.select(service().alias("schema_name"), C("event_type").alias("table_name"), F.round(C("value") * 100).cast("long").alias("execution_ms"),
                             (k_of() < 50).alias("pushdown_applied"), C("ts").alias("executed_at"))
    return federation.usage_stats(access, start=ntz("2024-01-10"))


UNION_SQL = """SELECT 'customers' AS source, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_acctbal FROM supplier"""


@plan("fed_union_view", UNION_SQL)
def fed_union_view(t):
    csv = files.scan_csv(t.spark, exported(t, t.supplier), "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")
    a = t.customer.select(F.lit("customers").alias("source"), C("c_custkey").cast("long").alias("id"), C("c_acctbal").cast("double").alias("balance"))
    b = csv.select(F.lit("suppliers").alias("source"), C("s_suppkey").cast("long").alias("id"), C("s_acctbal").cast("double").alias("balance"))
    return a.unionByName(b)


@plan("fed_join_view", "SELECT c_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def fed_join_view(t):
    people = files.scan_csv(t.spark, exported(t, t.customer), CUSTOMER_CSV)
    spent = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return people.join(spent, C("o_custkey") == C("c_custkey")).select("c_name", "orders", "total")


# --- catalogue views

@plan("meta_objects", " UNION ALL ".join(f"SELECT '{n}' AS object_name, 'TABLE' AS object_type, count(*) AS row_count FROM {n}" for n in TABLES))
def meta_objects(t):
    parts = [getattr(t, n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("object_name"), F.lit("TABLE").alias("object_type"), "row_count")
             for n in TABLES]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


@plan("meta_columns", """SELECT 'events' AS table_name, 1 AS position, 'event_id' AS column_name, 'bigint' AS type, count(event_id) AS filled FROM events
UNION ALL SELECT 'events', 2, 'ts', 'timestamp_ntz', count(ts) FROM events UNION ALL SELECT 'events', 3, 'user_id', 'bigint', count(user_id) FROM events
UNION ALL SELECT 'events', 4, 'event_type', 'string', count(event_type) FROM events UNION ALL SELECT 'events', 5, 'value', 'double', count(value) FROM events
UNION ALL SELECT 'events', 6, 'props', 'string', count(props) FROM events""")
def meta_columns(t):
    filled = t.events.agg(*[F.count(c).alias(c) for c in t.events.columns])
    entries = F.array(*[F.struct(F.lit("events").alias("table_name"), F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"), F.lit(k).alias("type"), C(c).alias("filled"))
                        for i, (c, k) in enumerate(t.events.dtypes)])
    return filled.select(F.explode(entries).alias("e")).select("e.*")


SCHEMAS = {"sales": ("orders", "lineitem", "customer"), "web": ("pages", "events"), "text": ("documents", "conversations")}


@plan("meta_schemas", " UNION ALL ".join(f"SELECT '{s}' AS schema_name, {len(ts)} AS tables, ({' + '.join(f'(SELECT count(*) FROM {n})' for n in ts)})::BIGINT AS row_count" for s, ts in SCHEMAS.items()))
def meta_schemas(t):
    parts = [getattr(t, n).agg(F.count(F.lit(1)).alias("c")).select(F.lit(s).alias("schema_name"), "c") for s, names in SCHEMAS.items() for n in names]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out.groupBy("schema_name").agg(F.count(F.lit(1)).cast("int").alias("tables"), F.sum("c").alias("row_count"))


# --- functions

def net_price(price: pd.Series) -> pd.Series:
    return (price * 0.9).round(3)


@plan("udf_scalar", "SELECT o_orderkey, round(o_totalprice * 0.9, 3) AS net FROM orders")
def udf_scalar(t):
    return t.orders.select("o_orderkey", F.pandas_udf(net_price, "double")("o_totalprice").alias("net"))


def array_span(values: pd.Series) -> pd.Series:
    """Largest less smallest element, for a whole batch of arrays at once; null for null and empty ones."""
    sizes = np.array([0 if v is None else len(v) for v in values])
    out, some = np.full(len(values), np.nan), np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate([values.iloc[i] for i in some]).astype(np.float64)
        first = np.cumsum(sizes[some]) - sizes[some]
        out[some] = np.maximum.reduceat(flat, first) - np.minimum.reduceat(flat, first)
    return pd.Series(out)


@plan("udf_array_in", "SELECT vec_id, round(list_max(embedding)::DOUBLE - list_min(embedding)::DOUBLE, 9) AS span FROM embeddings")
def udf_array_in(t):
    return t.embeddings.select("vec_id", F.round(F.pandas_udf(array_span, "double")("embedding"), 9).alias("span"))


def as_json(kind: pd.Series, user: pd.Series) -> pd.Series:
    """Documents of a batch by string operations on whole columns; each different text is escaped once."""
    quoted = kind.map({k: json.dumps(k, ensure_ascii=False) for k in kind.unique()})
    return '{"kind":' + quoted + ',"user":' + user.astype(str) + "}"


@plan("udf_json_out", """SELECT event_id, '{"kind":"' || event_type || '","user":' || user_id || '}' AS doc FROM events""")
def udf_json_out(t):
    return t.events.select("event_id", F.pandas_udf(as_json, "string")("event_type", "user_id").alias("doc"))


@plan("udf_register", "SELECT o_orderkey, round(o_totalprice * 0.9, 3) AS net FROM orders")
def udf_register(t):
    catalog = udfs.Catalog(t.spark)
    catalog.create_python("lw_net_price", net_price, "double", description="price less ten percent", tags=("price",))
    return t.orders.select("o_orderkey", F.expr("lw_net_price(o_totalprice)").alias("net"))


plan("udf_deploy", "SELECT o_orderkey, round(o_totalprice * 0.9, 3) AS net FROM orders")(udf_register)
plan("udf_create_python", "SELECT o_orderkey, round(o_totalprice * 0.9, 3) AS net FROM orders")(udf_register)


@plan("udf_create_sql", "SELECT o_orderkey, ((2001 - year(o_orderdate)) * 12 + 8 - month(o_orderdate))::INT AS months_ago FROM orders")
def udf_create_sql(t):
    catalog = udfs.Catalog(t.spark)
    catalog.create_sql("lw_months_ago", "d TIMESTAMP_NTZ", "INT", "(2001 - year(d)) * 12 + 8 - month(d)")
    return t.orders.select("o_orderkey", F.expr("lw_months_ago(o_orderdate)").alias("months_ago"))


@plan("udf_create_r", "SELECT event_id, (value - 5) / 7.0::DOUBLE AS scaled FROM events")
def udf_create_r(t):
    catalog = udfs.Catalog(t.spark)
    catalog.create_sql("lw_scale", "x DOUBLE, center DOUBLE, spread DOUBLE", "DOUBLE", "(x - center) / nullif(spread, 0)", language="r")
    return t.events.select("event_id", F.expr("lw_scale(value, 5, 7)").alias("scaled"))


@plan("udf_create_lua", "SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS snake FROM part")
def udf_create_lua(t):
    catalog = udfs.Catalog(t.spark)
    catalog.create_sql("lw_snake", "x STRING", "STRING", "lower(regexp_replace(x, ' +', '_'))", language="lua")
    return t.part.select("p_partkey", F.expr("lw_snake(p_name)").alias("snake"))


@plan("udf_catalog_view", f"""SELECT {SERVICE_SQL} AS name, count(*) FILTER (event_type = 'signup') AS example_count, count(*) FILTER (event_type <> 'signup') AS execution_count,
  round(avg(value) FILTER (event_type <> 'signup'), 6) AS avg_execution_time FROM events GROUP BY 1""")
def udf_catalog_view(t):
    runs = t.events.select(service().alias("name"), "event_type", C("value").alias("seconds"))
    out = udfs.catalog_view(runs.select("name").distinct(), runs.where("event_type = 'signup'"), runs.where("event_type <> 'signup'"))
    return out.withColumn("avg_execution_time", F.round("avg_execution_time", 6))


@plan("udf_batch_execute", "SELECT count(*) AS rows, true AS all_succeeded FROM events")
def udf_batch_execute(t):
    facts = udfs.batch_execute(t.events, lambda batch: net_price(batch["value"]))
    return facts.agg(F.sum("rows").alias("rows"), F.every("success").alias("all_succeeded"))


@plan("udf_export_import_script", """SELECT p_partkey, ['python', 'r', 'lua', 'sql'][p_partkey % 4 + 1] AS language, 'tools' AS schema_name, 'f_' || p_partkey AS name, 'x ' || lower(p_type) AS signature,
  'DOUBLE' AS return_type, 'return ' || p_name AS source FROM part""")
def udf_export_import_script(t):
    language = F.element_at(F.array(*map(F.lit, ("python", "r", "lua", "sql"))), (C("p_partkey") % 4 + 1).cast("int"))
    catalogue = t.part.select("p_partkey", language.alias("language"), F.lit("tools").alias("schema_name"),
                              F.concat(F.lit("f_"), C("p_partkey").cast("string")).alias("name"), F.concat(F.lit("x "), F.lower("p_type")).alias("signature"),
                              F.lit("DOUBLE").alias("return_type"), F.concat(F.lit("return "), "p_name").alias("source"))
    return udfs.import_scripts(udfs.export_scripts(catalogue).select("p_partkey", "script")).drop("script")


@plan("udaf_grouped", "SELECT event_type, round(exp(avg(ln(value + 1))), 8) AS geometric_mean FROM events GROUP BY 1")
def udaf_grouped(t):
    def partial(batch):
        return pd.Series({"logs": float((batch["value"] + 1).map(math.log).sum()), "n": float(len(batch))})

    states = udfs.mergeable_aggregate(t.events.select("event_type", "value"), ["event_type"], partial, ["logs", "n"])
    return states.select("event_type", F.round(F.exp(C("logs") / C("n")), 8).alias("geometric_mean"))


class _Words:
    def eval(self, text: str):
        for i, word in enumerate(text.split(" ")):
            yield i, word


@plan("udtf_table", "SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1)::INT - 1 AS pos, unnest(string_split(p_name, ' ')) AS word FROM part")
def udtf_table(t):
    words = F.udtf(_Words, returnType="pos int, word string")
    return t.part.lateralJoin(words(C("p_name").outer())).select("p_partkey", "pos", "word")


@plan("py_exec_doc", "SELECT event_id, value * 3 AS tripled FROM events")
def py_exec_doc(t):
    return udfs.map_rows(t.events.select("event_id", "value"), lambda b: b.assign(tripled=b["value"] * 3)[["event_id", "tripled"]],
                         "event_id long, tripled double")


# --- migration

@plan("mig_extract_schema", """WITH m AS (SELECT max(length(c_name)) AS n, max(length(c_mktsegment)) AS s FROM customer)
SELECT 'customer' AS table_name, 'CREATE TABLE customer (c_custkey BIGINT NOT NULL, c_name VARCHAR(' || n || '), c_nationkey INTEGER, c_acctbal DOUBLE PRECISION, c_mktsegment VARCHAR(' || s || '), PRIMARY KEY (c_custkey))' AS ddl FROM m
UNION ALL SELECT 'supplier', 'CREATE TABLE supplier (s_suppkey BIGINT NOT NULL, s_name VARCHAR(' || max(length(s_name)) || '), s_nationkey INTEGER, s_acctbal DOUBLE PRECISION, PRIMARY KEY (s_suppkey))' FROM supplier""")
def mig_extract_schema(t):
    vendor = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}
    found, keys = [], []
    for name in ("customer", "supplier"):
        df = getattr(t, name)
        texts = [c for c, k in df.dtypes if k == "string"]
        widths = df.agg(*[F.max(F.length(c)).alias(c) for c in texts]).first()
        for i, (c, k) in enumerate(df.dtypes):
            found.append((name, i, c, vendor.get(k) or f"VARCHAR({widths[c]})", i != 0))
        keys.append((name, 0, df.columns[0]))
    columns = t.spark.createDataFrame(found, "table_name string, position int, column_name string, vendor_type string, nullable boolean")
    return migrate.table_definitions(columns, t.spark.createDataFrame(keys, "table_name string, position int, column_name string"))


def table_counts(t, names):
    parts = [getattr(t, n).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in names]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


@plan("mig_chunk_plan", " UNION ALL ".join(f"""SELECT '{n}' AS table_name, o AS chunk_offset, least(5000, c - o) AS chunk_rows, o = 0 AS truncate_before
FROM (SELECT count(*) AS c, unnest(generate_series(0, greatest(count(*) - 1, 0), 5000)) AS o FROM {n})""" for n in ("customer", "orders", "lineitem")))
def mig_chunk_plan(t):
    return migrate.chunk_plan(table_counts(t, ("customer", "orders", "lineitem")), 5000)


@plan("mig_copy", "SELECT * FROM orders")
def mig_copy(t):
    return migrate.copy_table(t.orders, scratch_path(t.spark, "staging"), scratch_path(t.spark, "copied"))


@plan("mig_stats", f"""SELECT count(*) AS tasks, count(DISTINCT {SERVICE_SQL}) AS tables, sum({K_SQL})::BIGINT AS rows, count(*) FILTER (event_type NOT IN ('error', 'view')) AS success_count,
  count(*) FILTER (event_type = 'view') AS warning_count, count(*) FILTER (event_type = 'error') AS error_count FROM events""")
def mig_stats(t):
    outcome = F.when(C("event_type") == "error", "error").when(C("event_type") == "view", "warning").otherwise("success")
    return migrate.copy_statistics(t.events.select(service().alias("table_name"), k_of().alias("rows"), outcome.alias("outcome")))


@plan("mig_reconcile", """SELECT 'row_count' AS metric, count(*)::DOUBLE AS source_value, count(*)::DOUBLE AS target_value, true AS matches FROM orders
UNION ALL SELECT 'cents', sum(round(o_totalprice * 100)::BIGINT)::DOUBLE, sum(round(o_totalprice * 100)::BIGINT)::DOUBLE, true FROM orders
UNION ALL SELECT 'keys', sum(o_custkey)::DOUBLE, sum(o_custkey)::DOUBLE, true FROM orders""")
def mig_reconcile(t):
    target = migrate.copy_table(t.orders, scratch_path(t.spark, "staging"), scratch_path(t.spark, "copied"))
    return migrate.reconcile(t.orders, target, {"cents": F.round(C("o_totalprice") * 100).cast("long"), "keys": C("o_custkey")})
