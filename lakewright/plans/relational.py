"""Join, aggregate, window, sort and set queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakewright.functions import dates
from lakewright.operators import aggregates, joins, windows
from lakewright.operators.percentiles import percentiles
from lakewright.plans.registry import plan
from lakewright.plans.star import growth_pct
from lakewright.plans.workloads import K_SQL, k_of, month
from lakewright.sources.tables import scratch_path

C = F.col


def total(col, places=2):
    return F.round(F.sum(col), places)


def n_rows():
    return F.count(F.lit(1))


# --- joins

@plan("join_inner_star", """SELECT year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, n_name, p_type, count(*) AS n,
  round(sum(l_extendedprice), 2) AS total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def join_inner_star(t):
    when = dates.calendar(t.orders, "o_orderdate").select("date_actual", "year", "quarter")
    return (t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))
            .join(when, F.to_date("o_orderdate") == C("date_actual"))
            .join(t.customer, C("o_custkey") == C("c_custkey")).join(t.nation, C("c_nationkey") == C("n_nationkey"))
            .join(t.part, C("l_partkey") == C("p_partkey"))
            .groupBy("year", "quarter", "n_name", "p_type").agg(n_rows().alias("n"), total("l_extendedprice").alias("total")))


@plan("join_inner_chain", """SELECT r_name, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def join_inner_chain(t):
    return (t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).join(t.nation, C("c_nationkey") == C("n_nationkey"))
            .join(t.region, C("n_regionkey") == C("r_regionkey")).groupBy("r_name")
            .agg(n_rows().alias("n"), total("o_totalprice").alias("total")))


@plan("join_left", """SELECT o_orderkey, o_totalprice, n FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def join_left(t):
    lines = t.lineitem.groupBy("l_orderkey").agg(n_rows().alias("n"))
    return (t.orders.join(lines, C("o_orderkey") == C("l_orderkey"), "left").select("o_orderkey", "o_totalprice", "n"))


@plan("join_multi_key", """WITH m AS (SELECT user_id, event_type, round(sum(value), 2) AS v FROM events GROUP BY 1, 2),
k AS (SELECT user_id, event_type, max(event_id) AS last_id FROM events GROUP BY 1, 2)
SELECT user_id, event_type, v, last_id FROM m JOIN k USING (user_id, event_type)""")
def join_multi_key(t):
    m = t.events.groupBy("user_id", "event_type").agg(total("value").alias("v"))
    k = t.events.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_id"))
    return m.join(k, ["user_id", "event_type"])


@plan("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def join_semi(t):
    return t.customer.join(t.orders, (C("o_custkey") == C("c_custkey")) & (C("o_totalprice") > 400000), "left_semi").select("c_custkey")


@plan("join_anti", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(t):
    return t.orders.join(t.lineitem, C("l_orderkey") == C("o_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


@plan("join_not_in", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def join_not_in(t):
    return joins.not_in(t.customer, "c_custkey", t.events, "user_id").select("c_custkey")


@plan("join_cross", """SELECT p_partkey, s_suppkey, s_name, ((p_partkey * 7 + s_suppkey * 13) % 9999 + 1)::BIGINT AS availqty
FROM part CROSS JOIN supplier WHERE list_contains([p_partkey % (SELECT count(*) FROM supplier), (p_partkey + 7) % (SELECT count(*) FROM supplier),
  (p_partkey + 14) % (SELECT count(*) FROM supplier), (p_partkey + 21) % (SELECT count(*) FROM supplier)], s_suppkey)""")
def join_cross(t):
    # Four suppliers per part: pairs are generated from each part, so no product of the tables is formed.
    n = t.supplier.count()
    pairs = t.part.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).select(
        "p_partkey", ((C("p_partkey") + C("i") * 7) % n).alias("s_suppkey")).distinct()
    return pairs.join(t.supplier, "s_suppkey").select(
        "p_partkey", "s_suppkey", "s_name", ((C("p_partkey") * 7 + C("s_suppkey") * 13) % 9999 + 1).alias("availqty"))


@plan("join_lateral_top1", """SELECT c_custkey, o_orderkey, o_orderdate FROM customer LEFT JOIN LATERAL
  (SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) ON true""")
def join_lateral_top1(t):
    runs = t.orders.select(C("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    return joins.with_latest(t.customer.select("c_custkey"), runs, ["c_custkey"], ["o_orderdate", "o_orderkey"])


@plan("subq_corr_scalar", """SELECT p_partkey, p_name, p_type, p_retailprice FROM part o
WHERE p_retailprice = (SELECT min(p_retailprice) FROM part i WHERE i.p_type = o.p_type)""")
def subq_corr_scalar(t):
    low = t.part.groupBy("p_type").agg(F.min("p_retailprice").alias("p_retailprice"))
    return t.part.join(low, ["p_type", "p_retailprice"]).select("p_partkey", "p_name", "p_type", "p_retailprice")


@plan("subq_uncorr_scalar", """SELECT (SELECT count(*) FROM events WHERE event_type = 'error')::DOUBLE / (SELECT count(*) FROM events) AS error_ratio""")
def subq_uncorr_scalar(t):
    return t.events.agg((F.count_if(C("event_type") == "error").cast("double") / n_rows()).alias("error_ratio"))


@plan("subq_from", """SELECT size_class, count(*) AS n FROM (SELECT CASE WHEN count(*) >= 5 THEN 'big' ELSE 'small' END AS size_class
  FROM lineitem GROUP BY l_orderkey) GROUP BY 1""")
def subq_from(t):
    per = t.lineitem.groupBy("l_orderkey").agg(n_rows().alias("lines"))
    return per.groupBy(F.when(C("lines") >= 5, "big").otherwise("small").alias("size_class")).agg(n_rows().alias("n"))


@plan("cte_multi", """WITH spend AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1),
seg AS (SELECT c_mktsegment, s FROM spend JOIN customer ON o_custkey = c_custkey),
per AS (SELECT c_mktsegment, count(*) AS buyers, round(sum(s), 2) AS total FROM seg GROUP BY 1)
SELECT c_mktsegment, buyers, total, total / buyers AS per_buyer FROM per""")
def cte_multi(t):
    spend = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    seg = spend.join(t.customer, C("o_custkey") == C("c_custkey")).select("c_mktsegment", "s")
    per = seg.groupBy("c_mktsegment").agg(n_rows().alias("buyers"), total("s").alias("total"))
    return per.withColumn("per_buyer", C("total") / C("buyers"))


@plan("cte_recursive", """WITH RECURSIVE nodes AS (
  SELECT 'R' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders),
tree AS (SELECT id, parent, 1 AS level, id AS path FROM nodes WHERE parent IS NULL
  UNION ALL SELECT n.id, n.parent, level + 1, path || '/' || n.id FROM nodes n JOIN tree ON n.parent = tree.id)
SELECT id, parent, level, path FROM tree""")
def cte_recursive(t):
    def tag(letter, column):
        return F.concat(F.lit(letter), C(column).cast("string"))

    nodes = (t.region.select(tag("R", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
             .unionByName(t.nation.select(tag("N", "n_nationkey").alias("id"), tag("R", "n_regionkey").alias("parent")))
             .unionByName(t.customer.select(tag("C", "c_custkey").alias("id"), tag("N", "c_nationkey").alias("parent")))
             .unionByName(t.orders.select(tag("O", "o_orderkey").alias("id"), tag("C", "o_custkey").alias("parent"))))
    return joins.hierarchy(nodes)


@plan("join_update_from", """SELECT c_custkey, c_mktsegment, CASE WHEN s IS NULL THEN c_acctbal ELSE round(c_acctbal + s, 2) END AS c_acctbal
FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey""")
def join_update_from(t):
    spent = (t.orders.where("o_orderstatus = 'F'").groupBy(C("o_custkey").alias("c_custkey"))
             .agg(F.sum("o_totalprice").alias("s")))
    return joins.update_from(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), spent, ["c_custkey"],
                             {"c_acctbal": F.round(C("c_acctbal") + C("s"), 2)})


@plan("join_broadcast", """SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def join_broadcast(t):
    return (t.customer.join(t.nation, C("c_nationkey") == C("n_nationkey"))
            .groupBy("n_name").agg(n_rows().alias("n")))


COLOCATED_SQL = """SELECT o_orderkey, o_totalprice, count(*) AS lines, round(sum(l_extendedprice), 2) AS total
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2"""


def colocated_orders(t, buckets=8):
    """Orders and lines stored in the same buckets of the order key, more for large tables: the join and sum need no shuffle."""
    tag = uuid.uuid4().hex[:12]
    buckets = joins.bucket_count(buckets, t.orders, t.lineitem)
    orders = joins.write_bucketed(t.orders.select("o_orderkey", "o_totalprice"), f"orders_{tag}",
                                  scratch_path(t.spark, "orders"), "o_orderkey", buckets)
    lines = joins.write_bucketed(t.lineitem.select("l_orderkey", "l_extendedprice"), f"lines_{tag}",
                                 scratch_path(t.spark, "lines"), "l_orderkey", buckets)
    per_order = lines.groupBy("l_orderkey").agg(n_rows().alias("lines"), total("l_extendedprice").alias("total"))
    return orders.join(per_order, C("o_orderkey") == C("l_orderkey")).select("o_orderkey", "o_totalprice", "lines", "total")


plan("join_colocated", COLOCATED_SQL)(lambda t: colocated_orders(t))


@plan("join_repartition", COLOCATED_SQL)
def join_repartition(t):
    per_order = t.lineitem.groupBy("l_orderkey").agg(n_rows().alias("lines"), total("l_extendedprice").alias("total"))
    return (t.orders.join(per_order.hint("merge"), C("o_orderkey") == C("l_orderkey"))
            .select("o_orderkey", "o_totalprice", "lines", "total"))


@plan("fanout_distinct", """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders,
  (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events FROM customer""")
def fanout_distinct(t):
    return aggregates.fanout_distinct(t.customer.select("c_custkey"), "c_custkey",
                                      {"orders": (t.orders, "o_custkey"), "events": (t.events, "user_id")})


# --- aggregation

@plan("agg_global", """SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(sum(l_quantity), 2) / count(*) AS a,
  min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem""")
def agg_global(t):
    return t.lineitem.agg(n_rows().alias("n"), total("l_quantity").alias("s"), (total("l_quantity") / n_rows()).alias("a"),
                          F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@plan("agg_group", """SELECT l_suppkey, l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1, 2""")
def agg_group(t):
    return t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(n_rows().alias("n"), total("l_extendedprice").alias("s"))


@plan("agg_distinct", """SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1""")
def agg_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_partkey").alias("parts"),
                                                  F.countDistinct("l_suppkey").alias("suppliers"))


@plan("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def agg_having(t):
    return t.orders.groupBy("o_custkey").agg(n_rows().alias("n")).where("n >= 15")


@plan("agg_conditional", """SELECT user_id, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors,
  round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0), 2) AS spent FROM events GROUP BY 1""")
def agg_conditional(t):
    return t.events.groupBy("user_id").agg(
        F.count(F.when(C("event_type") == "error", 1)).alias("errors"),
        F.round(F.coalesce(F.sum(F.when(C("event_type") == "purchase", C("value"))), F.lit(0.0)), 2).alias("spent"))


@plan("agg_stddev_var", "SELECT p_type, round(stddev_samp(p_retailprice), 6) AS sd, round(var_samp(p_retailprice), 4) AS v FROM part GROUP BY 1")
def agg_stddev_var(t):
    return t.part.groupBy("p_type").agg(F.round(F.stddev_samp("p_retailprice"), 6).alias("sd"),
                                        F.round(F.var_samp("p_retailprice"), 4).alias("v"))


@plan("agg_percentile_cont", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1""")
def agg_percentile_cont(t):
    p = percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9})
    return p.select("l_returnflag", F.round("p50", 4).alias("p50"), F.round("p90", 4).alias("p90"))


@plan("agg_percentile_disc_array", """SELECT event_type, quantile_disc(value, 0.25) AS p25, quantile_disc(value, 0.5) AS p50,
  quantile_disc(value, 0.75) AS p75 FROM events GROUP BY 1""")
def agg_percentile_disc_array(t):
    return percentiles(t.events, ["event_type"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, discrete=True)


@plan("agg_median", "SELECT o_orderpriority, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1")
def agg_median(t):
    return (percentiles(t.orders, ["o_orderpriority"], "o_totalprice", {"median": 0.5})
            .select("o_orderpriority", F.round("median", 4).alias("median")))


@plan("agg_percentile_doc", "SELECT round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def agg_percentile_doc(t):
    return percentiles(t.events, [], "value", {"p95": 0.95}).select(F.round("p95", 6).alias("p95"))


@plan("agg_corr", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem GROUP BY 1")
def agg_corr(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("r"))


@plan("agg_array_distinct", """SELECT strftime(ts, '%Y-%m-%d') AS day, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM events GROUP BY 1""")
def agg_array_distinct(t):
    return (t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
            .agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("types")))


@plan("agg_string", """SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations
FROM (SELECT DISTINCT r_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey) GROUP BY 1""")
def agg_string(t):
    buyers = t.orders.select("o_custkey").distinct().join(t.customer, C("o_custkey") == C("c_custkey"))
    named = (buyers.join(t.nation, C("c_nationkey") == C("n_nationkey")).join(t.region, C("n_regionkey") == C("r_regionkey"))
             .select("r_name", "n_name").distinct())
    return named.groupBy("r_name").agg(F.expr("listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name)").alias("nations"))


@plan("agg_json", """SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS by_type
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""")
def agg_json(t):
    per = t.events.groupBy("user_id", "event_type").agg(n_rows().alias("n"))
    entries = F.sort_array(F.collect_list(F.struct("event_type", "n")))
    return per.groupBy("user_id").agg(F.to_json(F.map_from_entries(entries)).alias("by_type"))


@plan("agg_of_agg", """SELECT month, count(*) AS days, max(s) AS best, min(s) AS worst FROM (
  SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, o_orderdate, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1, 2) GROUP BY 1""")
def agg_of_agg(t):
    daily = t.orders.groupBy(month("o_orderdate").alias("month"), "o_orderdate").agg(total("o_totalprice").alias("s"))
    return daily.groupBy("month").agg(n_rows().alias("days"), F.max("s").alias("best"), F.min("s").alias("worst"))


@plan("agg_by_expr", """SELECT year(l_shipdate)::INT AS y, (l_quantity >= 25) AS bulk, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def agg_by_expr(t):
    return t.lineitem.groupBy(F.year("l_shipdate").alias("y"), (C("l_quantity") >= 25).alias("bulk")).agg(n_rows().alias("n"))


@plan("agg_ratio_pct", """SELECT user_id, count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / nullif(count(*), 0) AS error_pct FROM events GROUP BY 1""")
def agg_ratio_pct(t):
    return t.events.groupBy("user_id").agg(
        F.try_divide(F.count_if(C("event_type") == "error") * F.lit(100.0), n_rows().cast("double")).alias("error_pct"))


@plan("parallel_sum", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 10 AND l_returnflag = 'R'")
def parallel_sum(t):
    return (aggregates.parallel_sum(t.lineitem, "l_extendedprice", "l_quantity > 10 AND l_returnflag = 'R'")
            .select(F.round("total", 2).alias("total")))


@plan("optimized_agg", "SELECT max(l_quantity) AS max_l_quantity, max(l_extendedprice) AS max_l_extendedprice FROM lineitem WHERE l_tax > 0.02")
def optimized_agg(t):
    return aggregates.optimized_agg(t.lineitem, ["l_quantity", "l_extendedprice"], "max", "l_tax > 0.02")


@plan("dup_group", """SELECT md5(text) AS digest, count(*) AS copies, array_to_string(list_sort(list(doc_id))[1:3], ',') AS first_members
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_group(t):
    found = aggregates.duplicates(t.documents.select(F.md5("text").alias("digest"), "doc_id"), ["digest"], "doc_id")
    return found.withColumn("first_members", F.array_join(F.transform("first_members", lambda x: x.cast("string")), ","))


@plan("pivot", """SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view,
  count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def pivot(t):
    return (t.events.groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(n_rows())
            .na.fill(0, ["click", "view", "purchase"]))


# --- windows

@plan("win_running", """SELECT event_id, user_id, sum(value::DECIMAL(18,2)) OVER w::DOUBLE AS running_value, count(*) OVER w AS running_n
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""")
def win_running(t):
    rows = t.events.select("event_id", "user_id", "ts", C("value").cast("decimal(18,2)").alias("v"))
    out = windows.running(rows, ["user_id"], "ts", {"running_value": ("sum", "v"), "running_n": ("count", "v")})
    return out.select("event_id", "user_id", C("running_value").cast("double").alias("running_value"), "running_n")


DAILY_SQL = "SELECT o_custkey, o_orderdate AS d, sum(o_totalprice::DECIMAL(18,2)) AS s FROM orders GROUP BY 1, 2"


def daily_spend(t):
    """One row per customer and day: a window partition is bounded by the calendar."""
    return t.orders.groupBy("o_custkey", C("o_orderdate").alias("d")).agg(
        F.sum(C("o_totalprice").cast("decimal(18,2)")).alias("s"))


@plan("win_rows_frame", f"""SELECT o_custkey, d, sum(s) OVER w::DOUBLE / count(*) OVER w AS avg7 FROM ({DAILY_SQL})
WINDOW w AS (PARTITION BY o_custkey ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def win_rows_frame(t):
    w = Window.partitionBy("o_custkey").orderBy("d").rowsBetween(-6, 0)
    return daily_spend(t).select("o_custkey", "d", (F.sum("s").over(w).cast("double") / F.count("s").over(w)).alias("avg7"))


@plan("win_rows_exclusive", f"""SELECT o_custkey, d, sum(s) OVER w::DOUBLE / nullif(count(*) OVER w, 0) AS prior_avg FROM ({DAILY_SQL})
WINDOW w AS (PARTITION BY o_custkey ORDER BY d ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def win_rows_exclusive(t):
    w = Window.partitionBy("o_custkey").orderBy("d").rowsBetween(-3, -1)
    return daily_spend(t).select("o_custkey", "d", (F.sum("s").over(w).cast("double")
                                                    / F.nullif(F.count("s").over(w), F.lit(0))).alias("prior_avg"))


@plan("win_lag", """SELECT event_id, user_id, lag(value, 1) OVER w AS prev, lag(value, 5) OVER w AS prev5 FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_lag(t):
    wide = windows.with_halo(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], 5)
    w = Window.partitionBy("user_id", windows.CHUNK).orderBy("ts", "event_id")
    out = windows.without_halo(wide.withColumn("prev", F.lag("value", 1).over(w)).withColumn("prev5", F.lag("value", 5).over(w)))
    return out.select("event_id", "user_id", "prev", "prev5")


@plan("win_share", "SELECT p_type, round(sum(p_retailprice), 2) / sum(round(sum(p_retailprice), 2)::DECIMAL(18,2)) OVER ()::DOUBLE * 100 AS pct FROM part GROUP BY 1")
def win_share(t):
    per = t.part.groupBy("p_type").agg(total("p_retailprice").cast("decimal(18,2)").alias("s"))
    # The total is one row, so joining it sends one row to every task; a window without a key would be one task.
    whole = per.agg(F.sum("s").cast("double").alias("whole"))
    return per.join(F.broadcast(whole), F.lit(True)).select("p_type", (C("s").cast("double") / C("whole") * 100).alias("pct"))


@plan("win_rank", """SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn,
  rank() OVER w AS rank, dense_rank() OVER w AS dense_rank FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate)""")
def win_rank(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate")
    numbered = windows.numbered(rows, ["o_orderpriority"], ["o_orderdate", "o_orderkey"], "rn")
    return windows.ranked(numbered, ["o_orderpriority"], "o_orderdate").drop("o_orderpriority", "o_orderdate")


@plan("win_lead_first_last", """SELECT event_id, lead(value) OVER w AS next_value, first_value(value) OVER w AS first_value,
  last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_value
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_lead_first_last(t):
    order = ["ts", "event_id"]
    rows = t.events.select("event_id", "user_id", "ts", "value")
    out = windows.shifted(rows, ["user_id"], order, "value", -1, "next_value")
    out = windows.edge_value(out, ["user_id"], order, "value", "first_value")
    return (windows.edge_value(out, ["user_id"], order, "value", "last_value", last=True)
            .select("event_id", "next_value", "first_value", "last_value"))


@plan("lag_ignore_nulls", """SELECT event_id, coalesce(lag(v, 2 IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), -1) AS prior
FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)""")
def lag_ignore_nulls(t):
    rows = t.events.select("event_id", "user_id", "ts", F.when(C("event_type") != "error", C("value")).alias("v"))
    return windows.shifted(rows, ["user_id"], ["ts", "event_id"], "v", 2, "prior", default=-1.0,
                           ignore_nulls=True).select("event_id", "prior")


@plan("first_value_ignore_nulls", """SELECT event_id, first_value(v IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_v
FROM (SELECT *, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)""")
def first_value_ignore_nulls(t):
    rows = t.events.select("event_id", "user_id", "ts", F.when(C("event_type") != "error", C("value")).alias("v"))
    return (windows.edge_value(rows, ["user_id"], ["ts", "event_id"], "v", "first_v", ignore_nulls=True)
            .select("event_id", "first_v"))


def moving_rows(t, width):
    rows = t.events.select("event_id", "user_id", "ts", C("value").cast("decimal(18,2)").alias("v"))
    return windows.rows_frame(rows, ["user_id"], ["ts", "event_id"], width - 1,
                              {"_s": F.sum("v"), "_n": F.count("v"), "_sd": F.stddev_samp(C("v").cast("double"))})


@plan("moving_average", """SELECT event_id, sum(v) OVER w::DOUBLE / 4 AS average
FROM (SELECT event_id, user_id, ts, value::DECIMAL(18,2) AS v FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY count(*) OVER w = 4""")
def moving_average(t):
    return moving_rows(t, 4).where("_n = 4").select("event_id", (C("_s").cast("double") / 4).alias("average"))


@plan("moving_average_doc", """SELECT event_id, sum(value::DECIMAL(18,2)) OVER w::DOUBLE / count(*) OVER w AS average FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def moving_average_doc(t):
    return moving_rows(t, 7).select("event_id", (C("_s").cast("double") / C("_n")).alias("average"))


@plan("rolling_stddev", """SELECT event_id, round(stddev_samp(value) OVER w, 6) AS sd FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def rolling_stddev(t):
    return moving_rows(t, 7).select("event_id", F.round("_sd", 6).alias("sd"))


@plan("growth_pct", """WITH m AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1, 2),
g AS (SELECT *, lag(s, 1) OVER w AS p, lag(s, 12) OVER w AS y FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY m))
SELECT o_orderpriority, strftime(m, '%Y-%m-%d') AS month, CASE WHEN p > 0 THEN round((s - p) / p * 100, 4) ELSE 0 END AS mom,
  CASE WHEN y > 0 THEN round((s - y) / y * 100, 4) ELSE 0 END AS yoy FROM g""")
def growth_pct_q(t):
    monthly = t.orders.groupBy("o_orderpriority", month("o_orderdate").alias("month")).agg(total("o_totalprice").alias("s"))
    w = Window.partitionBy("o_orderpriority").orderBy("month")
    return monthly.select("o_orderpriority", "month", growth_pct(C("s"), F.lag("s", 1).over(w)).alias("mom"),
                          growth_pct(C("s"), F.lag("s", 12).over(w)).alias("yoy"))


@plan("win_latest_per_key", """SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def win_latest_per_key(t):
    return windows.latest_per_key(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


# --- sort, limit, set operations

@plan("sort_multi", f"SELECT event_id, event_type, nullif({K_SQL}, 5) AS k FROM events ORDER BY event_type DESC, k ASC NULLS LAST, event_id")
def sort_multi(t):
    rows = t.events.select("event_id", "event_type", F.nullif(k_of(), F.lit(5)).alias("k"))
    return rows.orderBy(F.desc("event_type"), F.asc_nulls_last("k"), "event_id")


@plan("topk", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def topk(t):
    return t.events.orderBy(F.desc("value"), "event_id").limit(50).select("event_id", "value")


@plan("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 250")
def limit_offset(t):
    return t.orders.orderBy("o_orderkey").offset(250).limit(100).select("o_orderkey", "o_totalprice")


@plan("topk_random", "SELECT * FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 1")
def topk_random(t):
    """One customer at random by seed: the smallest hash of seed and key, so reruns and other engines agree."""
    place = F.md5(F.concat(F.lit("42:"), C("c_custkey").cast("string")))
    return t.customer.orderBy(place, "c_custkey").limit(1)


@plan("union_all", """SELECT c_custkey AS id, 'customer' AS kind, c_acctbal AS balance FROM customer
UNION ALL SELECT s_suppkey, 'supplier', s_acctbal FROM supplier""")
def union_all(t):
    return (t.customer.select(C("c_custkey").alias("id"), F.lit("customer").alias("kind"), C("c_acctbal").alias("balance"))
            .unionByName(t.supplier.select(C("s_suppkey").alias("id"), F.lit("supplier").alias("kind"),
                                           C("s_acctbal").alias("balance"))))


@plan("distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()
