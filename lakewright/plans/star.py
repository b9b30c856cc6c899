"""Star-schema analytics: sales fact from lineitem and orders, dimensions from the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.operators.percentiles import percentiles
from lakewright.plans.registry import plan
from lakewright.sources.tables import durable

FACT_SQL = """fact AS (SELECT l_orderkey AS order_id, o_custkey AS customer_key, l_partkey AS product_key,
  o_orderdate AS sale_ts, o_orderpriority AS channel, l_quantity AS quantity,
  l_extendedprice / l_quantity AS unit_price, l_extendedprice * (1 - l_discount) AS net_sales,
  l_extendedprice * (0.4 - l_discount) AS gross_profit
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
GEO_SQL = """geo AS (SELECT c_custkey, c_mktsegment, n_name AS country_name, r_name AS region_name FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def sales(t, since: str | None = None, until: str | None = None) -> DataFrame:
    """Fact rows, restricted to order dates in [since, until) at the scan."""
    orders = t.orders
    if since:
        orders = orders.where(F.col("o_orderdate") >= F.expr(f"timestamp_ntz'{since}'"))
    if until:
        orders = orders.where(F.col("o_orderdate") < F.expr(f"timestamp_ntz'{until}'"))
    price, disc = F.col("l_extendedprice"), F.col("l_discount")
    return t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_key"),
        F.col("l_partkey").alias("product_key"), F.col("o_orderdate").alias("sale_ts"),
        F.col("o_orderpriority").alias("channel"), F.col("l_quantity").alias("quantity"),
        (price / F.col("l_quantity")).alias("unit_price"), (price * (1 - disc)).alias("net_sales"),
        (price * (F.lit(0.4) - disc)).alias("gross_profit"))


def geography(t) -> DataFrame:
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("c_custkey", "c_mktsegment", F.col("n_name").alias("country_name"),
                    F.col("r_name").alias("region_name")))


def _margin():
    return F.round(F.sum("gross_profit") / F.nullif(F.sum("net_sales"), F.lit(0.0)) * 100, 6)


@plan("an_q1", f"""WITH {FACT_SQL}
SELECT year(sale_ts)::INT AS year, month(sale_ts)::INT AS month, strftime(sale_ts, '%B') AS month_name,
  count(DISTINCT order_id) AS total_orders, round(sum(net_sales), 4) AS total_sales,
  round(sum(gross_profit), 4) AS total_profit, round(sum(net_sales), 4) / count(*) AS avg_order_value,
  round(sum(gross_profit) / nullif(sum(net_sales), 0) * 100, 6) AS profit_margin_pct
FROM fact WHERE sale_ts >= TIMESTAMP '1997-01-01' GROUP BY ALL ORDER BY 1, 2""")
def an_q1(t):
    return (sales(t, since="1997-01-01")
            .groupBy(F.year("sale_ts").alias("year"), F.month("sale_ts").alias("month"),
                     F.date_format("sale_ts", "MMMM").alias("month_name"))
            .agg(F.countDistinct("order_id").alias("total_orders"),
                 F.round(F.sum("net_sales"), 4).alias("total_sales"),
                 F.round(F.sum("gross_profit"), 4).alias("total_profit"),
                 (F.round(F.sum("net_sales"), 4) / F.count(F.lit(1))).alias("avg_order_value"),
                 _margin().alias("profit_margin_pct"))
            .orderBy("year", "month"))


@plan("an_q2", f"""WITH {FACT_SQL}
SELECT p_type AS category, count(DISTINCT order_id) AS order_count, round(sum(quantity), 2) AS units_sold,
  round(sum(net_sales), 4) AS revenue, round(sum(gross_profit), 4) AS profit,
  round(avg(unit_price), 6) AS avg_unit_price,
  round(sum(gross_profit) / nullif(sum(net_sales), 0) * 100, 6) AS profit_margin
FROM fact JOIN part ON product_key = p_partkey
WHERE sale_ts >= TIMESTAMP '1998-01-01' AND sale_ts < TIMESTAMP '1999-01-01'
GROUP BY p_type ORDER BY revenue DESC""")
def an_q2(t):
    return (sales(t, "1998-01-01", "1999-01-01").join(t.part, F.col("product_key") == F.col("p_partkey"))
            .groupBy(F.col("p_type").alias("category"))
            .agg(F.countDistinct("order_id").alias("order_count"),
                 F.round(F.sum("quantity"), 2).alias("units_sold"),
                 F.round(F.sum("net_sales"), 4).alias("revenue"),
                 F.round(F.sum("gross_profit"), 4).alias("profit"),
                 F.round(F.avg("unit_price"), 6).alias("avg_unit_price"),
                 _margin().alias("profit_margin"))
            .orderBy(F.desc("revenue")))


@plan("an_q3", f"""WITH {FACT_SQL}, {GEO_SQL}
SELECT region_name, country_name, count(DISTINCT customer_key) AS unique_customers,
  count(DISTINCT order_id) AS total_orders, round(sum(net_sales), 4) AS revenue,
  round(sum(net_sales), 4) / count(*) AS avg_order_value,
  round(sum(net_sales), 4) / count(DISTINCT customer_key) AS revenue_per_customer
FROM fact JOIN geo ON customer_key = c_custkey
WHERE sale_ts >= TIMESTAMP '1998-01-01' AND sale_ts < TIMESTAMP '1999-01-01'
GROUP BY ALL ORDER BY revenue DESC""")
def an_q3(t):
    return (sales(t, "1998-01-01", "1999-01-01").join(geography(t), F.col("customer_key") == F.col("c_custkey"))
            .groupBy("region_name", "country_name")
            .agg(F.countDistinct("customer_key").alias("unique_customers"),
                 F.countDistinct("order_id").alias("total_orders"),
                 F.round(F.sum("net_sales"), 4).alias("revenue"),
                 (F.round(F.sum("net_sales"), 4) / F.count(F.lit(1))).alias("avg_order_value"),
                 (F.round(F.sum("net_sales"), 4) / F.countDistinct("customer_key")).alias("revenue_per_customer"))
            .orderBy(F.desc("revenue")))


@plan("an_q4", f"""WITH {FACT_SQL}
SELECT channel AS channel_name, count(DISTINCT order_id) AS order_count, round(sum(net_sales), 4) AS revenue,
  round(sum(gross_profit), 4) AS profit, round(sum(net_sales), 4) / count(*) AS avg_order_value,
  round(sum(net_sales) / sum(sum(net_sales)) OVER () * 100, 6) AS revenue_share_pct
FROM fact WHERE sale_ts >= TIMESTAMP '1998-07-01' AND sale_ts < TIMESTAMP '1999-01-01'
GROUP BY channel ORDER BY revenue DESC""")
def an_q4(t):
    per_channel = (sales(t, "1998-07-01", "1999-01-01").groupBy(F.col("channel").alias("channel_name"))
                   .agg(F.countDistinct("order_id").alias("order_count"), F.sum("net_sales").alias("s"),
                        F.round(F.sum("gross_profit"), 4).alias("profit"),
                        (F.round(F.sum("net_sales"), 4) / F.count(F.lit(1))).alias("avg_order_value")))
    return per_channel.select(
        "channel_name", "order_count", F.round("s", 4).alias("revenue"), "profit", "avg_order_value",
        F.round(F.col("s") / F.sum("s").over(Window.partitionBy()) * 100, 6).alias("revenue_share_pct"),
    ).orderBy(F.desc("revenue"))


@plan("an_q5", f"""WITH {FACT_SQL},
firsts AS (SELECT customer_key, date_trunc('month', min(sale_ts)) AS cohort FROM fact GROUP BY customer_key),
activity AS (SELECT cohort, date_trunc('month', sale_ts) AS active_month, count(DISTINCT fact.customer_key) AS n
  FROM fact JOIN firsts USING (customer_key) GROUP BY ALL),
sizes AS (SELECT cohort, count(*) AS cohort_size FROM firsts GROUP BY cohort)
SELECT strftime(cohort, '%Y-%m-%d') AS cohort_month, cohort_size,
  strftime(active_month, '%Y-%m-%d') AS activity_month, n AS active_customers,
  round(n * 100.0::DOUBLE / cohort_size, 2) AS retention_rate,
  (((year(active_month) - year(cohort)) * 12 + month(active_month) - month(cohort)) % 12)::INT
    AS months_since_first_purchase
FROM activity JOIN sizes USING (cohort) WHERE cohort >= TIMESTAMP '1995-02-01'""")
def an_q5(t):
    monthly = (sales(t).groupBy("customer_key", F.date_trunc("month", "sale_ts").alias("active_month"))
               .agg(F.count(F.lit(1)).alias("lines")))
    firsts = monthly.groupBy("customer_key").agg(F.min("active_month").alias("cohort"))
    activity = (monthly.join(firsts, "customer_key").groupBy("cohort", "active_month")
                .agg(F.count(F.lit(1)).alias("active_customers")))
    sizes = firsts.groupBy("cohort").agg(F.count(F.lit(1)).alias("cohort_size"))
    since = ((F.year("active_month") - F.year("cohort")) * 12 + F.month("active_month") - F.month("cohort")) % 12
    return (activity.join(sizes, "cohort").where("cohort >= timestamp'1995-02-01'")
            .select(F.date_format("cohort", "yyyy-MM-dd").alias("cohort_month"), "cohort_size",
                    F.date_format("active_month", "yyyy-MM-dd").alias("activity_month"), "active_customers",
                    F.round(F.col("active_customers") * 100.0 / F.col("cohort_size"), 2).alias("retention_rate"),
                    since.alias("months_since_first_purchase"))
            .orderBy("cohort_month", "activity_month"))


@plan("an_q6", f"""WITH {FACT_SQL},
daily AS (SELECT date_trunc('day', sale_ts) AS d, sum(net_sales) AS s FROM fact
  WHERE sale_ts >= TIMESTAMP '1998-01-01' AND sale_ts < TIMESTAMP '1999-01-01' GROUP BY 1)
SELECT month(d)::INT AS month, strftime(d, '%B') AS month_name, dayofweek(d) IN (0, 6) AS is_weekend,
  round(sum(s), 4) / count(*) AS avg_daily_sales, round(stddev_samp(s), 4) AS sales_volatility,
  round(max(s), 4) AS peak_daily_sales, round(min(s), 4) AS min_daily_sales
FROM daily GROUP BY ALL ORDER BY 1, 3""")
def an_q6(t):
    daily = (sales(t, "1998-01-01", "1999-01-01").groupBy(F.to_date("sale_ts").alias("d"))
             .agg(F.sum("net_sales").alias("s")))
    return (daily.groupBy(F.month("d").alias("month"), F.date_format("d", "MMMM").alias("month_name"),
                          F.dayofweek("d").isin(1, 7).alias("is_weekend"))
            .agg((F.round(F.sum("s"), 4) / F.count(F.lit(1))).alias("avg_daily_sales"),
                 F.round(F.stddev_samp("s"), 4).alias("sales_volatility"),
                 F.round(F.max("s"), 4).alias("peak_daily_sales"), F.round(F.min("s"), 4).alias("min_daily_sales"))
            .orderBy("month", "is_weekend"))


@plan("an_q7", f"""WITH {FACT_SQL},
daily AS (SELECT product_key, date_trunc('day', sale_ts) AS d, round(sum(net_sales), 4)::DECIMAL(18,4) AS s FROM fact
  WHERE sale_ts >= TIMESTAMP '1998-10-01' AND sale_ts < TIMESTAMP '1999-01-01' GROUP BY 1, 2)
SELECT product_key, p_name AS product_name, p_type AS category, strftime(d, '%Y-%m-%d') AS date_actual,
  s::DOUBLE AS daily_sales, sum(s) OVER w7::DOUBLE / count(*) OVER w7 AS sales_7day_avg,
  sum(s) OVER w30::DOUBLE / count(*) OVER w30 AS sales_30day_avg
FROM daily JOIN part ON product_key = p_partkey WHERE p_type IN ('ECONOMY', 'SMALL', 'PROMO')
WINDOW w7 AS (PARTITION BY product_key ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
  w30 AS (PARTITION BY product_key ORDER BY d ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def an_q7(t):
    # One row per product and day after the sum, so a window partition is bounded by the calendar.
    products = t.part.where(F.col("p_type").isin("ECONOMY", "SMALL", "PROMO"))
    daily = (sales(t, "1998-10-01", "1999-01-01")
             .join(products, F.col("product_key") == F.col("p_partkey"))
             .groupBy("product_key", F.col("p_name").alias("product_name"), F.col("p_type").alias("category"),
                      F.to_date("sale_ts").alias("d"))
             .agg(F.round(F.sum("net_sales"), 4).cast("decimal(18,4)").alias("s")))
    w = Window.partitionBy("product_key").orderBy("d")

    def rolling(n):
        frame = w.rowsBetween(1 - n, 0)
        return F.sum("s").over(frame).cast("double") / F.count("s").over(frame)

    return (daily.select("product_key", "product_name", "category",
                         F.date_format("d", "yyyy-MM-dd").alias("date_actual"),
                         F.col("s").cast("double").alias("daily_sales"),
                         rolling(7).alias("sales_7day_avg"), rolling(30).alias("sales_30day_avg"))
            .orderBy("category", "product_name", "product_key", "date_actual"))


@plan("an_q8", f"""WITH {FACT_SQL},
metrics AS (SELECT customer_key, c_mktsegment AS customer_type, count(DISTINCT order_id) AS total_orders,
    round(sum(net_sales), 4) AS total_spent, avg(net_sales) AS avg_order_value,
    date_diff('day', min(sale_ts), max(sale_ts)) + 1 AS lifespan
  FROM fact JOIN customer ON customer_key = c_custkey GROUP BY 1, 2)
SELECT customer_type, count(*) AS customer_count, round(sum(total_spent), 4) / count(*) AS avg_lifetime_value,
  sum(total_orders)::DOUBLE / count(*) AS avg_orders_per_customer, round(avg(avg_order_value), 4) AS avg_order_value,
  sum(lifespan)::DOUBLE / count(*) AS avg_lifespan_days,
  round(quantile_cont(total_spent, 0.5), 4) AS median_lifetime_value,
  round(quantile_cont(total_spent, 0.9), 4) AS top_10pct_lifetime_value
FROM metrics WHERE total_orders >= 2 GROUP BY customer_type""")
def an_q8(t):
    # Read three times below: one row per customer, written once.
    metrics = durable(sales(t).groupBy("customer_key")
               .agg(F.countDistinct("order_id").alias("total_orders"),
                    F.round(F.sum("net_sales"), 4).alias("total_spent"),
                    F.avg("net_sales").alias("order_value"),
                    (F.datediff(F.max("sale_ts"), F.min("sale_ts")) + 1).alias("lifespan"))
               .where("total_orders >= 2")
               .join(t.customer.select(F.col("c_custkey").alias("customer_key"),
                                       F.col("c_mktsegment").alias("customer_type")), "customer_key"))
    totals = metrics.groupBy("customer_type").agg(
        F.count(F.lit(1)).alias("customer_count"), (F.round(F.sum("total_spent"), 4) / F.count(F.lit(1))).alias("avg_lifetime_value"),
        F.avg("total_orders").alias("avg_orders_per_customer"),
        F.round(F.avg("order_value"), 4).alias("avg_order_value"),
        F.avg("lifespan").alias("avg_lifespan_days"))
    ranks = percentiles(metrics, ["customer_type"], "total_spent",
                        {"median_lifetime_value": 0.5, "top_10pct_lifetime_value": 0.9})
    return totals.join(ranks.select(
        "customer_type", F.round("median_lifetime_value", 4).alias("median_lifetime_value"),
        F.round("top_10pct_lifetime_value", 4).alias("top_10pct_lifetime_value")), "customer_type")


CHANNELS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
MARKETING_SQL = """marketing AS (
  SELECT 'campaign_' || (CAST(json_extract_string(props, '$.k') AS BIGINT) // 25) AS campaign,
    ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][(user_id % 5 + 1)::INT] AS channel,
    n_name AS country_name, value AS spend, event_type
  FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def marketing(t) -> DataFrame:
    """Campaign touches from the event stream: type is the funnel step, value the spend."""
    return (t.events.join(t.customer, F.col("user_id") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.concat(F.lit("campaign_"),
                             F.floor(F.get_json_object("props", "$.k").cast("long") / 25).cast("string")).alias("campaign"),
                    F.element_at(F.array(*map(F.lit, CHANNELS)), (F.pmod("user_id", F.lit(5)) + 1).cast("int")).alias("channel"),
                    F.col("n_name").alias("country_name"), F.col("value").alias("spend"), "event_type"))


@plan("an_q9", f"""WITH {FACT_SQL}, {GEO_SQL}, {MARKETING_SQL},
perf AS (SELECT campaign, channel, country_name, sum(spend) AS total_spend,
    count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS conversions
  FROM marketing GROUP BY 1, 2, 3),
attributed AS (SELECT channel, country_name, sum(net_sales) AS attributed_sales FROM fact JOIN geo ON customer_key = c_custkey
  WHERE sale_ts >= TIMESTAMP '1998-01-01' AND sale_ts < TIMESTAMP '1999-01-01' GROUP BY 1, 2)
SELECT campaign AS campaign_name, channel AS channel_name, country_name, round(total_spend, 2) AS total_spend,
  conversions AS total_conversions,
  CASE WHEN clicks > 0 THEN round(conversions * 100.0::DOUBLE / clicks, 6) ELSE 0.0::DOUBLE END AS conversion_rate,
  round(attributed_sales, 4) AS attributed_sales,
  CASE WHEN total_spend > 0 THEN round(attributed_sales / total_spend, 4) ELSE 0 END AS roas_ratio,
  CASE WHEN total_spend > 0 THEN round((attributed_sales - total_spend) / total_spend * 100, 4) ELSE 0 END AS roi_percentage
FROM perf LEFT JOIN attributed USING (channel, country_name) WHERE total_spend > 500""")
def an_q9(t):
    def steps(kind):
        return F.count(F.when(F.col("event_type") == kind, 1))

    perf = (marketing(t).groupBy("campaign", "channel", "country_name")
            .agg(F.sum("spend").alias("spent"), steps("click").alias("clicks"),
                 steps("purchase").alias("total_conversions")).where("spent > 500"))
    attributed = (sales(t, "1998-01-01", "1999-01-01")
                  .join(geography(t), F.col("customer_key") == F.col("c_custkey"))
                  .groupBy("channel", "country_name").agg(F.sum("net_sales").alias("a")))
    spent, a = F.col("spent"), F.col("a")
    return perf.join(attributed, ["channel", "country_name"], "left").select(
        F.col("campaign").alias("campaign_name"), F.col("channel").alias("channel_name"), "country_name",
        F.round(spent, 2).alias("total_spend"), "total_conversions",
        F.when(F.col("clicks") > 0, F.round(F.col("total_conversions") * 100.0 / F.nullif(F.col("clicks"), F.lit(0)), 6))
        .otherwise(F.lit(0.0)).alias("conversion_rate"),
        F.round(a, 4).alias("attributed_sales"),
        F.when(spent > 0, F.round(a / spent, 4)).otherwise(F.lit(0.0)).alias("roas_ratio"),
        F.when(spent > 0, F.round((a - spent) / spent * 100, 4)).otherwise(F.lit(0.0)).alias("roi_percentage"),
    ).orderBy(F.desc("roas_ratio"))


def growth_pct(now, base):
    """Percent change against a base; 0 where the base is missing or not positive."""
    return F.when(base > 0, F.round((now - base) / base * 100, 4)).otherwise(F.lit(0.0))


@plan("an_q10", f"""WITH {FACT_SQL},
weekly AS (SELECT date_trunc('week', sale_ts) AS w, sum(net_sales) AS s, count(DISTINCT order_id) AS o,
    count(DISTINCT customer_key) AS c FROM fact WHERE sale_ts >= TIMESTAMP '1996-01-01' GROUP BY 1),
trend AS (SELECT *, lag(s, 1) OVER (ORDER BY w) AS p, lag(s, 52) OVER (ORDER BY w) AS y,
    avg(s) OVER (ORDER BY w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a FROM weekly)
SELECT strftime(w, '%Y-%m-%d') AS week_start, round(s, 4) AS weekly_sales, o AS weekly_orders, c AS weekly_customers,
  CASE WHEN p > 0 THEN round((s - p) / p * 100, 4) ELSE 0 END AS week_over_week_growth,
  CASE WHEN y > 0 THEN round((s - y) / y * 100, 4) ELSE 0 END AS year_over_year_growth,
  CASE WHEN a > 0 THEN round((s - a) / a * 100, 4) ELSE 0 END AS vs_3week_avg_pct
FROM trend WHERE w >= TIMESTAMP '1997-01-01' ORDER BY 1""")
def an_q10(t):
    weekly = (sales(t, since="1996-01-01").groupBy(F.date_trunc("week", "sale_ts").alias("w"))
              .agg(F.sum("net_sales").alias("s"), F.countDistinct("order_id").alias("weekly_orders"),
                   F.countDistinct("customer_key").alias("weekly_customers")))
    # One row per calendar week is left, so a single ordered window is small at any scale.
    by_week = Window.partitionBy().orderBy("w")
    s = F.col("s")
    return (weekly.withColumn("p", F.lag("s", 1).over(by_week)).withColumn("y", F.lag("s", 52).over(by_week))
            .withColumn("a", F.avg("s").over(by_week.rowsBetween(-3, -1)))
            .where("w >= timestamp'1997-01-01'")
            .select(F.date_format("w", "yyyy-MM-dd").alias("week_start"), F.round("s", 4).alias("weekly_sales"),
                    "weekly_orders", "weekly_customers",
                    growth_pct(s, F.col("p")).alias("week_over_week_growth"),
                    growth_pct(s, F.col("y")).alias("year_over_year_growth"),
                    growth_pct(s, F.col("a")).alias("vs_3week_avg_pct"))
            .orderBy("week_start"))
