"""Statistics, time-series, model and nearest-neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.operators import ml, nearest, stats, timeseries
from lakewright.operators.percentiles import percentiles
from lakewright.plans.registry import plan
from lakewright.plans.workloads import EVENTS_AS_OF, SERVICE_SQL, ntz, service
from lakewright.sources.tables import scratch_path

C = F.col


def rounded(df, places, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


@plan("stat_describe", """WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi,
  quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
c AS (SELECT event_type, avg((value - mean) ** 2) AS m2, avg((value - mean) ** 3) AS m3, avg((value - mean) ** 4) AS m4 FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_type, n, round(mean, 6) AS mean, round(q2, 6) AS median, round(sd, 6) AS std_dev, lo AS min, hi AS max, round(hi - lo, 2) AS range,
  round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
  CASE WHEN n >= 3 THEN round(n / 6.0::DOUBLE * ((m3 / m2 ** 1.5) ** 2 + (m4 / m2 ** 2 - 3) ** 2 / 4), 4) END AS jarque_bera FROM m JOIN c USING (event_type)""")
def stat_describe(t):
    d = stats.describe(t.events, ["event_type"], "value").drop("p_value", "is_normal")
    return rounded(rounded(rounded(d, 6, "mean", "median", "std_dev", "q1", "q3", "iqr"), 2, "range"), 4, "jarque_bera")


@plan("arr_var_quantile", """SELECT event_type, round(var_samp(value), 6) AS variance, round(quantile_cont(value, 0.1), 6) AS q10, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY 1""")
def arr_var_quantile(t):
    spread = t.events.groupBy("event_type").agg(F.round(F.var_samp("value"), 6).alias("variance"))
    quantiles = percentiles(t.events, ["event_type"], "value", {"q10": 0.1, "q90": 0.9})
    return spread.join(rounded(quantiles, 6, "q10", "q90"), "event_type")


@plan("stat_regr_slope", """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM lineitem GROUP BY 1""")
def stat_regr_slope(t):
    line = stats.regression(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity")
    return line.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


@plan("stat_linear_model", """SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS value FROM lineitem
UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem
UNION ALL SELECT 'r2', round(regr_r2(l_extendedprice, l_quantity), 4) FROM lineitem""")
def stat_linear_model(t):
    terms, _ = ml.linear_model(t.lineitem.select("l_quantity", "l_extendedprice"), ["l_quantity"], "l_extendedprice")
    return terms.where("term <> 'rmse'").select("term", F.round("value", 4).alias("value"))


@plan("stat_outlier_z", """SELECT event_id, round(abs(value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z_score FROM events
WINDOW w AS (PARTITION BY event_type) QUALIFY abs(value - avg(value) OVER w) / stddev_samp(value) OVER w > 2""")
def stat_outlier_z(t):
    flagged = stats.zscore_outliers(t.events, ["event_type"], "value").where("is_outlier")
    return flagged.select("event_id", F.round("z_score", 6).alias("z_score"))


@plan("stat_outlier_iqr", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_id, value FROM events JOIN q USING (event_type) WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def stat_outlier_iqr(t):
    return stats.remove_outliers_iqr(t.events, ["event_type"], "value").select("event_id", "value")


CORR_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@plan("stat_corr_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({a}, {b}), 8) AS correlation FROM lineitem"
    for a in CORR_COLUMNS for b in CORR_COLUMNS))
def stat_corr_matrix(t):
    return rounded(stats.correlation_matrix(t.lineitem, CORR_COLUMNS), 8, "correlation")


PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, 'null_count' AS metric, count(*) FILTER ({c} IS NULL)::VARCHAR AS value FROM orders
UNION ALL SELECT '{c}', 'distinct_count', count(DISTINCT {c})::VARCHAR FROM orders
UNION ALL SELECT '{c}', 'min_value', min({c})::VARCHAR FROM orders UNION ALL SELECT '{c}', 'max_value', max({c})::VARCHAR FROM orders"""
    for c in ("o_custkey", "o_orderpriority", "o_orderstatus"))


@plan("stat_profile_column", PROFILE_SQL)
def stat_profile_column(t):
    return stats.profile(t.orders, ["o_custkey", "o_orderpriority", "o_orderstatus"])


@plan("ts_exp_smoothing", """WITH s AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT *, CASE WHEN n = 1 THEN value ELSE value / 3 END / pow(2 / 3.0::DOUBLE, n) AS u FROM s)
SELECT event_id, round(pow(2 / 3.0::DOUBLE, n) * sum(u) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING), 6) AS smoothed FROM p""")
def ts_exp_smoothing(t):
    rows = t.events.select("event_id", "user_id", "ts", "value")
    out = timeseries.exponential_smoothing(rows, ["user_id"], ["ts", "event_id"], "value", alpha=1 / 3)
    return out.select("event_id", F.round("smoothed", 6).alias("smoothed"))


def daily_totals(t):
    """One row per event type and day."""
    return (t.events.groupBy("event_type", day("ts").alias("day"))
            .agg(F.round(F.sum("value"), 2).alias("total")))


DAILY_SQL = "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


@plan("ts_decompose", f"""WITH d AS (SELECT *, row_number() OVER w - 1 AS i, CASE WHEN count(*) OVER f = 7 THEN sum(total) OVER f / 7 END AS trend FROM ({DAILY_SQL})
  WINDOW w AS (PARTITION BY event_type ORDER BY day), f AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
s AS (SELECT *, avg(total - trend) OVER (PARTITION BY event_type, i % 7) AS seasonal FROM d)
SELECT event_type, day, total, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(total - trend - seasonal, 4) AS residual FROM s""")
def ts_decompose(t):
    return rounded(timeseries.decompose(daily_totals(t), ["event_type"], "day", "total", 7), 4, "trend", "seasonal", "residual")


@plan("ts_forecast")
def ts_forecast(t):
    return timeseries.forecast(daily_totals(t), ["event_type"], "day", "total")


@plan("ts_interpolate", """WITH g AS (SELECT event_type, unnest(generate_series(date_trunc('day', lo)::TIMESTAMP + INTERVAL 6 HOUR, hi, INTERVAL 6 HOUR)) AS ts
  FROM (SELECT event_type, min(ts) AS lo, max(ts) AS hi FROM events GROUP BY 1)),
b AS (SELECT g.event_type, g.ts, e.ts AS t0, e.value AS v0 FROM g ASOF LEFT JOIN events e ON g.event_type = e.event_type AND g.ts >= e.ts),
a AS (SELECT b.*, e.ts AS t1, e.value AS v1 FROM b ASOF LEFT JOIN events e ON b.event_type = e.event_type AND b.ts < e.ts)
SELECT event_type, ts, round(coalesce(v0 + (v1 - v0) * ((epoch_us(ts) - epoch_us(t0)) / (epoch_us(t1) - epoch_us(t0))::DOUBLE), v0, v1), 6) AS value FROM a""")
def ts_interpolate(t):
    span = t.events.groupBy("event_type").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    start = F.date_trunc("day", "lo").cast("timestamp_ntz") + F.expr("INTERVAL 6 HOURS")
    grid = span.select("event_type", F.explode(F.sequence(start, C("hi"), F.expr("INTERVAL 6 HOURS"))).alias("ts"))
    return rounded(timeseries.interpolate(t.events, grid, ["event_type"], "ts", "event_id", "value"), 6, "value")


@plan("ts_predict_linear", f"""WITH s AS (SELECT {SERVICE_SQL} AS instance, (epoch_us(ts) - epoch_us(TIMESTAMP '{EVENTS_AS_OF}')) / 1000000.0::DOUBLE AS x, value FROM events
  WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY),
f AS (SELECT instance, regr_slope(value, x) AS a, regr_intercept(value, x) AS b FROM s GROUP BY 1)
SELECT instance, round(b + a * 21600, 4) AS in_6h, round(b + a * 43200, 4) AS in_12h, b + a * 21600 > 50 AS in_6h_alert, b + a * 43200 > 50 AS in_12h_alert FROM f""")
def ts_predict_linear(t):
    as_of = ntz(EVENTS_AS_OF)
    x = (F.unix_micros(C("ts").cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))) / F.lit(1000000.0)
    recent = (t.events.where(C("ts") >= as_of - F.expr("INTERVAL 7 DAYS"))
              .select(service().alias("instance"), x.alias("x"), "value"))
    out = timeseries.predict_linear(recent, ["instance"], "x", "value", {"in_6h": 21600, "in_12h": 43200}, 50.0)
    return rounded(out, 4, "in_6h", "in_12h")


def vector_rows(t):
    return ml.vector_column(t.embeddings.select("vec_id", "label", "embedding"), "embedding", "vector")


@plan("ml_classify")
def ml_classify(t):
    return ml.classify(vector_rows(t), ["vector"], "label").select("vec_id", "label", "prediction", "confidence")


def customer_features(t):
    """Order count, spend and balance per customer; quiet customers have no order after mid 2000."""
    spend = (t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("orders"),
                                               (F.sum("o_totalprice") / 1e6).alias("spent"), F.max("o_orderdate").alias("last")))
    return (t.customer.join(spend, C("c_custkey") == C("o_custkey"))
            .select("c_custkey", "orders", "spent", (C("c_acctbal") / 1e4).alias("balance"),
                    (C("last") < ntz("2000-07-01")).cast("double").alias("quiet")))


@plan("ml_predict_doc")
def ml_predict_doc(t):
    path = scratch_path(t.spark, "model")
    rows = customer_features(t)
    ml.train_classifier(rows, ["orders", "spent", "balance"], "quiet", path)
    return ml.predict(rows, path).select("c_custkey", "prediction", "score")


@plan("ml_churn_doc")
def ml_churn_doc(t):
    path = scratch_path(t.spark, "model")
    rows = customer_features(t)
    ml.train_classifier(rows, ["orders", "spent", "balance"], "quiet", path)
    return ml.predict(rows, path).where("score > 0.3").select("c_custkey", "score").orderBy(F.desc("score"), "c_custkey")


@plan("stat_tests_doc", """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
tt AS (SELECT (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS s FROM g a, g b WHERE a.event_type = 'click' AND b.event_type = 'view'),
an AS (SELECT ((sum(n * m * m) - sum(n * m) ** 2 / sum(n)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))) AS s FROM g),
o AS (SELECT l_returnflag, l_linestatus, count(*) AS o FROM lineitem GROUP BY 1, 2),
e AS (SELECT o, sum(o) OVER (PARTITION BY l_returnflag)::DOUBLE * sum(o) OVER (PARTITION BY l_linestatus) / sum(o) OVER () AS e FROM o)
SELECT 't_test' AS test, round(s, 6) AS statistic FROM tt UNION ALL SELECT 'anova', round(s, 6) FROM an
UNION ALL SELECT 'chi_square', round(sum((o - e) ** 2 / e), 6) FROM e""")
def stat_tests_doc(t):
    tests = {"t_test": stats.t_test(t.events, "event_type", "value", "click", "view"),
             "anova": stats.anova(t.events, "event_type", "value"),
             "chi_square": stats.chi_square(t.lineitem, "l_returnflag", "l_linestatus")}
    rows = [d.select(F.lit(n).alias("test"), F.round("statistic", 6).alias("statistic")) for n, d in tests.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@plan("vec_l2_topk", """WITH q AS (SELECT label::BIGINT AS query_id, arg_min(embedding, vec_id) AS query FROM embeddings GROUP BY 1)
SELECT query_id, rank::INT AS rank, vec_id AS neighbor, round(d, 6) AS distance FROM (
  SELECT query_id, vec_id, list_distance(embedding::DOUBLE[], query::DOUBLE[]) AS d,
    row_number() OVER (PARTITION BY query_id ORDER BY list_distance(embedding::DOUBLE[], query::DOUBLE[]), vec_id) AS rank FROM embeddings, q) WHERE rank <= 10""")
def vec_l2_topk(t):
    queries = t.embeddings.groupBy(C("label").cast("long").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))
    return rounded(nearest.l2_topk(t.embeddings, "vec_id", "embedding", queries, 10), 6, "distance")


@plan("vec_cells_topk")
def vec_cells_topk(t):
    """As vec_l2_topk, by the index of cells."""
    queries = t.embeddings.groupBy(C("label").cast("long").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("query"))
    return rounded(nearest.cells_topk(nearest.build_cells(t.embeddings, "vec_id", "embedding"), queries, 10), 6, "distance")


@plan("geo_distance_topk", """WITH p AS (SELECT c_custkey, (c_custkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (c_custkey * 17 % 1800) / 10.0::DOUBLE - 90 AS lat FROM customer)
SELECT c_custkey, lon, lat, round(sqrt((lon - 13.4) ** 2 + (lat - 52.5) ** 2), 9) AS distance,
  round(2 * 6371 * asin(sqrt(pow(sin(radians(lat - 52.5) / 2), 2) + cos(radians(52.5)) * cos(radians(lat)) * pow(sin(radians(lon - 13.4) / 2), 2))), 6) AS distance_km
FROM p ORDER BY distance, c_custkey LIMIT 10""")
def geo_distance_topk(t):
    places = t.customer.select("c_custkey", ((C("c_custkey") * 37 % 3600) / F.lit(10.0) - 180).alias("lon"),
                               ((C("c_custkey") * 17 % 1800) / F.lit(10.0) - 90).alias("lat"))
    return rounded(rounded(nearest.places_topk(places, "c_custkey", 13.4, 52.5, 10), 9, "distance"), 6, "distance_km")
