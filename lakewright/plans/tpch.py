"""Order-entry decision-support queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.plans.registry import plan


def mean(column):
    """Mean of a column of hundredths: the sum is rounded to them, so the summing order does not show."""
    return F.round(F.sum(column), 2) / F.count(F.lit(1))


def disc_price():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@plan("tpch_q1", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
  round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 4) AS sum_charge,
  round(sum(l_quantity), 2) / count(*) AS avg_qty, round(sum(l_extendedprice), 2) / count(*) AS avg_price,
  round(sum(l_discount), 2) / count(*) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")
def q1(t):
    return (t.lineitem.where("l_shipdate <= timestamp_ntz'1998-09-02'")
            .groupBy("l_returnflag", "l_linestatus")
            .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
                 F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
                 F.round(F.sum(disc_price()), 4).alias("sum_disc_price"),
                 F.round(F.sum(disc_price() * (1 + F.col("l_tax"))), 4).alias("sum_charge"),
                 mean("l_quantity").alias("avg_qty"), mean("l_extendedprice").alias("avg_price"),
                 mean("l_discount").alias("avg_disc"),
                 F.count(F.lit(1)).alias("count_order"))
            .orderBy("l_returnflag", "l_linestatus"))


@plan("tpch_q2", """
WITH cost AS (
  SELECT l_partkey, l_suppkey, min(l_extendedprice / l_quantity) AS supplycost
  FROM lineitem GROUP BY l_partkey, l_suppkey),
offers AS (
  SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, supplycost
  FROM cost JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE r_name = 'EUROPE' AND p_size = 15 AND p_type LIKE '%ECONOMY')
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, supplycost FROM offers o
WHERE supplycost = (SELECT min(supplycost) FROM offers i WHERE i.p_partkey = o.p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""")
def q2(t):
    parts = t.part.where((F.col("p_size") == 15) & F.col("p_type").like("%ECONOMY"))
    sellers = (t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
               .join(t.region.where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey")))
    offers = (t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"))
              .join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
              .groupBy("s_suppkey", "s_acctbal", "s_name", "n_name", "p_partkey", "p_brand")
              .agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("supplycost")))
    cheapest = offers.groupBy("p_partkey").agg(F.min("supplycost").alias("supplycost"))
    return (offers.join(cheapest, ["p_partkey", "supplycost"])
            .select("s_acctbal", "s_name", "n_name", "p_partkey", "p_brand", "supplycost")
            .orderBy(F.desc("s_acctbal"), "n_name", "s_name", "p_partkey").limit(100))


@plan("tpch_q3", """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1996-03-15' AND l_shipdate > TIMESTAMP '1996-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
def q3(t):
    buyers = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    open_orders = (t.orders.where("o_orderdate < timestamp_ntz'1996-03-15'")
                   .join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi"))
    return (t.lineitem.where("l_shipdate > timestamp_ntz'1996-03-15'")
            .join(open_orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(disc_price()), 4).alias("revenue"))
            .orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10))


@plan("tpch_q4", """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-04-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)
GROUP BY o_orderpriority ORDER BY o_orderpriority""")
def q4(t):
    quarter = t.orders.where("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1996-04-01'")
    late = (F.col("l_orderkey") == F.col("o_orderkey")) & F.expr("l_shipdate > o_orderdate + INTERVAL 60 DAYS")
    return (quarter.join(t.lineitem, late, "left_semi").groupBy("o_orderpriority")
            .agg(F.count(F.lit(1)).alias("order_count")).orderBy("o_orderpriority"))


@plan("tpch_q5", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
  AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'
GROUP BY n_name ORDER BY revenue DESC""")
def q5(t):
    nations = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    sellers = t.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    year = t.orders.where("o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1997-01-01'")
    buyers = year.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return (t.lineitem.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(buyers, (F.col("l_orderkey") == F.col("o_orderkey"))
                  & (F.col("c_nationkey") == F.col("s_nationkey")))
            .groupBy("n_name").agg(F.round(F.sum(disc_price()), 4).alias("revenue"))
            .orderBy(F.desc("revenue")))


@plan("tpch_q6", """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'
  AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def q6(t):
    return (t.lineitem.where("l_shipdate >= timestamp_ntz'1996-01-01' AND l_shipdate < timestamp_ntz'1997-01-01'")
            .where(F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
            .agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue")))
