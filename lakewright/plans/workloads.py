"""Operational, storage-test and reporting workloads over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.operators.percentiles import percentiles
from lakewright.plans.registry import plan

EVENTS_AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-01 00:00:00"


def ntz(text: str):
    return F.expr(f"timestamp_ntz'{text}'")


def k_of(col: str = "props"):
    return F.get_json_object(col, "$.k").cast("long")


K_SQL = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@plan("oltp_q1", """SELECT c_custkey AS user_id, c_name AS username, c_mktsegment AS segment, c_acctbal AS balance
FROM customer WHERE c_name = 'Customer#000000042' AND c_acctbal > -1000""")
def oltp_q1(t):
    return (t.customer.where((F.col("c_name") == "Customer#000000042") & (F.col("c_acctbal") > -1000))
            .select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"),
                    F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")))


@plan("oltp_q2", """SELECT s_suppkey AS account_id, s_name AS account_number, s_acctbal AS balance
FROM supplier WHERE s_name = 'Supplier#000000007'""")
def oltp_q2(t):
    return (t.supplier.where(F.col("s_name") == "Supplier#000000007")
            .select(F.col("s_suppkey").alias("account_id"), F.col("s_name").alias("account_number"),
                    F.col("s_acctbal").alias("balance")))


@plan("oltp_q3", f"""SELECT event_id AS transaction_id, event_type AS transaction_type, value AS amount, ts AS created_at
FROM events WHERE user_id = 12 OR {K_SQL} = 12 ORDER BY ts DESC, event_id DESC LIMIT 10""")
def oltp_q3(t):
    return (t.events.where((F.col("user_id") == 12) | (k_of() == 12))
            .select(F.col("event_id").alias("transaction_id"), F.col("event_type").alias("transaction_type"),
                    F.col("value").alias("amount"), F.col("ts").alias("created_at"))
            .orderBy(F.desc("created_at"), F.desc("transaction_id")).limit(10))


@plan("oltp_q4", """SELECT p_partkey AS product_id, p_name AS name, p_retailprice AS price, p_size AS quantity_in_stock
FROM part WHERE p_type = 'ECONOMY' AND p_size > 0 ORDER BY p_name, p_partkey LIMIT 20""")
def oltp_q4(t):
    return (t.part.where((F.col("p_type") == "ECONOMY") & (F.col("p_size") > 0))
            .select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
                    F.col("p_retailprice").alias("price"), F.col("p_size").alias("quantity_in_stock"))
            .orderBy("name", "product_id").limit(20))


@plan("oltp_q5", """SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS total_amount,
  l_partkey AS product_id, l_quantity AS quantity, l_extendedprice AS total_price, p_name AS product_name
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderkey = 5979""")
def oltp_q5(t):
    return (t.orders.where("o_orderkey = 5979").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"))
            .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"),
                    F.col("o_totalprice").alias("total_amount"), F.col("l_partkey").alias("product_id"),
                    F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("total_price"),
                    F.col("p_name").alias("product_name")))


@plan("oltp_q6", """SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS total_amount, o_orderdate AS created_at
FROM orders WHERE o_custkey = 42 AND o_orderstatus IN ('O', 'P') ORDER BY o_orderdate DESC""")
def oltp_q6(t):
    return (t.orders.where((F.col("o_custkey") == 42) & F.col("o_orderstatus").isin("O", "P"))
            .select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"),
                    F.col("o_totalprice").alias("total_amount"), F.col("o_orderdate").alias("created_at"))
            .orderBy(F.desc("created_at")))


@plan("oltp_q7", f"""SELECT event_type AS transaction_type, count(*) AS transaction_count,
  round(sum(value), 2) AS total_amount, round(sum(value), 2) / count(*) AS avg_amount
FROM events WHERE (user_id = 12 OR {K_SQL} = 12) AND ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY
GROUP BY event_type""")
def oltp_q7(t):
    recent = F.col("ts") >= ntz(EVENTS_AS_OF) - F.expr("INTERVAL 30 DAYS")
    return (t.events.where(((F.col("user_id") == 12) | (k_of() == 12)) & recent)
            .groupBy(F.col("event_type").alias("transaction_type"))
            .agg(F.count(F.lit(1)).alias("transaction_count"), F.round(F.sum("value"), 2).alias("total_amount"),
                 (F.round(F.sum("value"), 2) / F.count(F.lit(1))).alias("avg_amount")))


@plan("oltp_q8", f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS sale_date, count(*) AS order_count,
  round(sum(o_totalprice), 2) AS total_sales, round(sum(o_totalprice), 2) / count(*) AS avg_order_value
FROM orders WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 7 DAY AND o_orderstatus IN ('F', 'O')
GROUP BY 1""")
def oltp_q8(t):
    recent = F.col("o_orderdate") >= ntz(ORDERS_AS_OF) - F.expr("INTERVAL 7 DAYS")
    return (t.orders.where(recent & F.col("o_orderstatus").isin("F", "O"))
            .groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("sale_date"))
            .agg(F.count(F.lit(1)).alias("order_count"), F.round(F.sum("o_totalprice"), 2).alias("total_sales"),
                 (F.round(F.sum("o_totalprice"), 2) / F.count(F.lit(1))).alias("avg_order_value"))
            .orderBy(F.desc("sale_date")))


@plan("oltp_q9", """SELECT p_partkey AS product_id, p_name AS name, p_size AS quantity_in_stock, length(p_name)::INT AS reorder_level
FROM part WHERE p_size <= length(p_name) ORDER BY p_size""")
def oltp_q9(t):
    return (t.part.withColumn("reorder_level", F.length("p_name")).where("p_size <= reorder_level")
            .select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
                    F.col("p_size").alias("quantity_in_stock"), "reorder_level").orderBy("quantity_in_stock"))


@plan("oltp_q10", f"""SELECT c_custkey AS user_id, c_name AS username, count(*) AS order_count, round(sum(o_totalprice), 2) AS total_spent
FROM customer JOIN orders ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 90 DAY
GROUP BY 1, 2 HAVING sum(o_totalprice) > 1000 ORDER BY total_spent DESC, user_id LIMIT 10""")
def oltp_q10(t):
    recent = F.col("o_orderdate") >= ntz(ORDERS_AS_OF) - F.expr("INTERVAL 90 DAYS")
    spent = (t.orders.where((F.col("o_orderstatus") == "F") & recent).groupBy("o_custkey")
             .agg(F.count(F.lit(1)).alias("order_count"), F.sum("o_totalprice").alias("s")).where("s > 1000"))
    return (spent.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), "order_count",
                    F.round("s", 2).alias("total_spent"))
            .orderBy(F.desc("total_spent"), "user_id").limit(10))


def apply_transfers(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """New balances after a batch of transfers (from_id, to_id, amount) on accounts (account_id, balance)."""
    moves = (transfers.select(F.col("from_id").alias("account_id"), (-F.col("amount")).alias("delta"))
             .unionByName(transfers.select(F.col("to_id").alias("account_id"), F.col("amount").alias("delta"))))
    net = moves.groupBy("account_id").agg(F.sum("delta").alias("delta"))
    return (accounts.join(net, "account_id", "left")
            .withColumn("new_balance", F.round(F.col("balance") + F.coalesce("delta", F.lit(0.0)), 2)).drop("delta"))


@plan("oltp_q11", f"""WITH moves AS (
  SELECT user_id AS id, -value AS delta FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT {K_SQL}, value FROM events WHERE event_type = 'purchase'),
net AS (SELECT id, sum(delta) AS delta FROM moves GROUP BY id)
SELECT c_custkey AS account_id, c_acctbal AS balance, round(c_acctbal + coalesce(delta, 0), 2) AS new_balance
FROM customer LEFT JOIN net ON id = c_custkey""")
def oltp_q11(t):
    accounts = t.customer.select(F.col("c_custkey").alias("account_id"), F.col("c_acctbal").alias("balance"))
    transfers = t.events.where("event_type = 'purchase'").select(
        F.col("user_id").alias("from_id"), k_of().alias("to_id"), F.col("value").alias("amount"))
    return apply_transfers(accounts, transfers)


@plan("oltp_q12", """SELECT count(*) AS lookup_count FROM (
  SELECT c_custkey FROM customer WHERE c_custkey = 12 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey = 56
  UNION ALL SELECT c_custkey FROM customer WHERE c_custkey = 90 UNION ALL SELECT c_custkey FROM customer WHERE c_custkey = 34
  UNION ALL SELECT c_custkey FROM customer WHERE c_custkey = 78)""")
def oltp_q12(t):
    lookups = [t.customer.where(F.col("c_custkey") == k).select("c_custkey") for k in (12, 56, 90, 34, 78)]
    merged = lookups[0]
    for one in lookups[1:]:
        merged = merged.unionByName(one)
    return merged.agg(F.count(F.lit(1)).alias("lookup_count"))


def _regions(t):
    return (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", F.col("r_name").alias("region")))


REGION_SQL = """(SELECT s_suppkey, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey) JOIN lineitem ON l_suppkey = s_suppkey"""


def amounts(col: str, *extra):
    total = F.round(F.sum(col), 2)
    return [F.count(F.lit(1)).alias("n"), total.alias("total"), (total / F.count(F.lit(1))).alias("average"), *extra]


AMOUNTS_SQL = "count(*) AS n, round(sum({0}), 2) AS total, round(sum({0}), 2) / count(*) AS average"


@plan("perf_t1", f"""SELECT {AMOUNTS_SQL.format('l_extendedprice')}, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest
FROM lineitem""")
def perf_t1(t):
    return t.lineitem.agg(*amounts("l_extendedprice", F.min("l_extendedprice").alias("lowest"),
                                   F.max("l_extendedprice").alias("highest")))


@plan("perf_t2", f"SELECT region, {AMOUNTS_SQL.format('l_extendedprice')} FROM {REGION_SQL} GROUP BY region ORDER BY total DESC")
def perf_t2(t):
    return (t.lineitem.join(_regions(t), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("region").agg(*amounts("l_extendedprice")).orderBy(F.desc("total")))


MONTH_SQL = "strftime(date_trunc('month', {0}), '%Y-%m-%d')"


def month(col: str):
    return F.date_format(F.date_trunc("month", col), "yyyy-MM-dd")


@plan("perf_t3", f"SELECT {MONTH_SQL.format('l_shipdate')} AS month, {AMOUNTS_SQL.format('l_extendedprice')} FROM lineitem GROUP BY 1 ORDER BY 1")
def perf_t3(t):
    return t.lineitem.groupBy(month("l_shipdate").alias("month")).agg(*amounts("l_extendedprice")).orderBy("month")


@plan("perf_t4", f"""SELECT n_name AS country, p_type AS category, {AMOUNTS_SQL.format('l_extendedprice')}
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY total DESC""")
def perf_t4(t):
    country = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return (t.lineitem.join(country, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t.part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("n_name").alias("country"), F.col("p_type").alias("category"))
            .agg(*amounts("l_extendedprice")).orderBy(F.desc("total")))


@plan("perf_t5", f"""SELECT region, {AMOUNTS_SQL.format('l_extendedprice')} FROM {REGION_SQL}
WHERE l_shipdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-06-30' GROUP BY region ORDER BY total DESC""")
def perf_t5(t):
    span = t.lineitem.where(F.col("l_shipdate").between(ntz("1997-01-01"), ntz("1997-06-30")))
    return (span.join(_regions(t), F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy("region").agg(*amounts("l_extendedprice")).orderBy(F.desc("total")))


@plan("col_t1", f"""SELECT {MONTH_SQL.format('o_orderdate')} AS month, {AMOUNTS_SQL.format('o_totalprice')},
  count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1 ORDER BY 1""")
def col_t1(t):
    return (t.orders.groupBy(month("o_orderdate").alias("month"))
            .agg(*amounts("o_totalprice", F.countDistinct("o_custkey").alias("customers"))).orderBy("month"))


@plan("col_t2", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10000")
def col_t2(t):
    return t.orders.orderBy("o_orderkey").limit(10000)


@plan("col_t3", "SELECT ts, user_id, value FROM events WHERE value > 50 ORDER BY ts DESC, event_id DESC LIMIT 1000")
def col_t3(t):
    return (t.events.where("value > 50").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)
            .select("ts", "user_id", "value"))


@plan("comp_q1", "SELECT round(sum(value), 2) / count(*) AS average, min(value) AS lowest, max(value) AS highest FROM events")
def comp_q1(t):
    return t.events.agg((F.round(F.sum("value"), 2) / F.count("value")).alias("average"),
                        F.min("value").alias("lowest"), F.max("value").alias("highest"))


@plan("comp_q2", "SELECT * FROM events ORDER BY event_id LIMIT 1000")
def comp_q2(t):
    return t.events.orderBy("event_id").limit(1000)


SERVICE_SQL = "'service_' || (user_id % 7)::VARCHAR"


def service():
    return F.concat(F.lit("service_"), F.pmod("user_id", F.lit(7)).cast("string"))


COMP_Q3_SQL = f"""SELECT {SERVICE_SQL} AS service_name, event_type AS log_level, strftime(ts, '%Y-%m-%d') AS day,
  count(*) AS log_count, round(sum(value * 100), 0) / count(*) AS avg_time FROM events GROUP BY 1, 2, 3"""


def service_log_daily(t):
    return (t.events.groupBy(service().alias("service_name"), F.col("event_type").alias("log_level"),
                             F.date_format("ts", "yyyy-MM-dd").alias("day"))
            .agg(F.count(F.lit(1)).alias("log_count"),
                 (F.round(F.sum(F.col("value") * 100), 0) / F.count(F.lit(1))).alias("avg_time"))
            .orderBy("day", F.desc("log_count")))


plan("comp_q3", COMP_Q3_SQL)(service_log_daily)
plan("svc_log_daily", COMP_Q3_SQL)(service_log_daily)


@plan("comp_q4", f"""SELECT p_type AS category, {AMOUNTS_SQL.format('l_extendedprice')}, sum(l_quantity) AS units
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY total DESC""")
def comp_q4(t):
    return (t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_type").alias("category"))
            .agg(*amounts("l_extendedprice", F.sum("l_quantity").alias("units"))).orderBy(F.desc("total")))


@plan("comp_q5", f"""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, {AMOUNTS_SQL.format('o_totalprice')}
FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1""")
def comp_q5(t):
    return (t.orders.where("o_orderpriority = '1-URGENT'").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
            .agg(*amounts("o_totalprice")).orderBy("day"))


@plan("e2e_monthly", f"""SELECT {MONTH_SQL.format('o_orderdate')} AS month, {AMOUNTS_SQL.format('o_totalprice')} FROM orders
WHERE o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 90 DAY GROUP BY 1 ORDER BY 1""")
def e2e_monthly(t):
    return (t.orders.where(F.col("o_orderdate") >= ntz(ORDERS_AS_OF) - F.expr("INTERVAL 90 DAYS"))
            .groupBy(month("o_orderdate").alias("month")).agg(*amounts("o_totalprice")).orderBy("month"))


@plan("gs_hourly", f"""SELECT date_trunc('hour', ts) AS hour, round(sum(value), 2) / count(*) AS avg_value FROM events
WHERE ts > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOUR GROUP BY 1 ORDER BY 1""")
def gs_hourly(t):
    return (t.events.where(F.col("ts") > ntz(EVENTS_AS_OF) - F.expr("INTERVAL 24 HOURS"))
            .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
            .agg((F.round(F.sum("value"), 2) / F.count("value")).alias("avg_value")).orderBy("hour"))


@plan("gs_totals", f"SELECT {AMOUNTS_SQL.format('o_totalprice')} FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01'")
def gs_totals(t):
    return t.orders.where(F.col("o_orderdate") >= ntz("1999-01-01")).agg(*amounts("o_totalprice"))


@plan("pgb_groups", """SELECT c_nationkey AS branch, round(sum(c_acctbal), 2) / count(*) AS avg_balance,
  round(sum(c_acctbal), 2) AS total_balance FROM customer WHERE c_acctbal > 1000
GROUP BY 1 ORDER BY total_balance DESC, branch LIMIT 10""")
def pgb_groups(t):
    total = F.round(F.sum("c_acctbal"), 2)
    return (t.customer.where("c_acctbal > 1000").groupBy(F.col("c_nationkey").alias("branch"))
            .agg((total / F.count(F.lit(1))).alias("avg_balance"), total.alias("total_balance"))
            .orderBy(F.desc("total_balance"), "branch").limit(10))


@plan("order_summary", """SELECT o_orderkey AS order_id, c_name AS username, o_orderstatus AS status, count(*) AS item_count,
  string_agg(p_name, ', ' ORDER BY p_name) AS product_names
FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
GROUP BY 1, 2, 3""")
def order_summary(t):
    items = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_name")
    # The list of one order is the row asked for; names are listed only after the line join.
    listed = items.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("item_count"),
        F.expr("listagg(p_name, ', ') WITHIN GROUP (ORDER BY p_name)").alias("product_names"))
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(listed, F.col("o_orderkey") == F.col("l_orderkey"))
            .select(F.col("o_orderkey").alias("order_id"), F.col("c_name").alias("username"),
                    F.col("o_orderstatus").alias("status"), "item_count", "product_names"))


@plan("json_browser", f"SELECT {K_SQL} AS k, count(*) AS n FROM events WHERE json_exists(props, '$.k') GROUP BY 1")
def json_browser(t):
    return (t.events.where(F.array_contains(F.json_object_keys("props"), "k"))
            .groupBy(k_of().alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n")))


@plan("dist_monthly", f"""SELECT {MONTH_SQL.format('o_orderdate')} AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1 ORDER BY 1""")
def dist_monthly(t):
    return (t.orders.groupBy(month("o_orderdate").alias("month"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy("month"))


@plan("ts_rolling_doc", """WITH daily AS (
  SELECT date_trunc('day', ts) AS d, count(*) AS n, round(sum(value), 2)::DECIMAL(18,2) AS s, quantile_cont(value, 0.95) AS p95
  FROM events GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, n, s::DOUBLE AS total,
  sum(s) OVER w::DOUBLE / count(*) OVER w AS rolling_7day, round(p95, 6) AS p95
FROM daily WINDOW w AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def ts_rolling_doc(t):
    events = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    daily = events.groupBy("day").agg(F.count(F.lit(1)).alias("n"),
                                      F.round(F.sum("value"), 2).cast("decimal(18,2)").alias("s"))
    tail = percentiles(events, ["day"], "value", {"p95": 0.95})
    frame = Window.partitionBy().orderBy("day").rowsBetween(-6, 0)
    return daily.join(tail, "day").select(
        "day", "n", F.col("s").cast("double").alias("total"),
        (F.sum("s").over(frame).cast("double") / F.count("s").over(frame)).alias("rolling_7day"),
        F.round("p95", 6).alias("p95"))


@plan("region_p99_doc", f"""SELECT r_name AS region, count(*) AS events, round(sum(value), 2) / count(*) AS avg_value,
  round(quantile_cont(value, 0.99), 6) AS p99_value
FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 30 DAY GROUP BY 1""")
def region_p99_doc(t):
    recent = (t.events.where(F.col("ts") >= ntz(EVENTS_AS_OF) - F.expr("INTERVAL 30 DAYS"))
              .join(t.customer, F.col("user_id") == F.col("c_custkey"))
              .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
              .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
              .select(F.col("r_name").alias("region"), "value"))
    base = recent.groupBy("region").agg(F.count(F.lit(1)).alias("events"),
                                        (F.round(F.sum("value"), 2) / F.count(F.lit(1))).alias("avg_value"))
    tail = percentiles(recent, ["region"], "value", {"p99": 0.99})
    return base.join(tail, "region").select("region", "events", "avg_value", F.round("p99", 6).alias("p99_value"))
