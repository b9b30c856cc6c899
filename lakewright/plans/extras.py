"""Further joins, frames, grouping sets and streams that a warehouse user expects."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.operators import eventstore, joins, windows
from lakewright.plans.registry import plan
from lakewright.plans.streams import AFTER_SQL, BEFORE_SQL, STORE_SQL, events_stream, snapshots, stored_events
from lakewright.plans.workloads import ntz
from lakewright.sources.tables import durable, scratch_path
from lakewright.streaming import runner

C = F.col


def n_rows():
    return F.count(F.lit(1))


# --- joins

@plan("join_full_diff", f"""WITH b AS ({BEFORE_SQL}), a AS ({AFTER_SQL})
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed'
  WHEN a.balance IS DISTINCT FROM b.balance OR a.name IS DISTINCT FROM b.name THEN 'changed' ELSE 'same' END AS status,
  b.balance AS old_balance, a.balance AS new_balance FROM b FULL JOIN a ON a.id = b.id""")
def join_full_diff(t):
    before, after = snapshots(t)
    old, new = (df.select("id", F.struct("name", "balance").alias(side)) for df, side in ((before, "old"), (after, "new")))
    status = (F.when(C("old").isNull(), "added").when(C("new").isNull(), "removed")
              .when(~C("old").eqNullSafe(C("new")), "changed").otherwise("same"))
    return old.join(new, "id", "full_outer").select("id", status.alias("status"), C("old.balance").alias("old_balance"),
                                                    C("new.balance").alias("new_balance"))


@plan("join_range_interval", """SELECT e.event_id, count(v.event_id) AS views FROM (SELECT * FROM events WHERE event_type = 'error') e
LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.ts >= e.ts AND v.ts < e.ts + INTERVAL 20 MINUTE GROUP BY 1""")
def join_range_interval(t):
    """Views in the twenty minutes after each error, whoever caused them."""
    errors = t.events.where("event_type = 'error'").select("event_id", C("ts").alias("lo"), (C("ts") + F.expr("INTERVAL 20 MINUTES")).alias("hi"))
    return joins.count_within(t.events.where("event_type = 'view'").select("ts"), "ts", errors, "lo", "hi", "views").select("event_id", "views")


@plan("join_asof", """WITH r AS (SELECT user_id, ts, event_type = 'purchase' AS later, event_id, CASE WHEN event_type = 'view' THEN event_id END AS view_id,
    CASE WHEN event_type = 'view' THEN value END AS view_value FROM events WHERE event_type IN ('purchase', 'view')),
w AS (SELECT *, last_value(view_id IGNORE NULLS) OVER x AS last_view, last_value(view_value IGNORE NULLS) OVER x AS last_value FROM r
  WINDOW x AS (PARTITION BY user_id ORDER BY ts, later, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, last_view, last_value FROM w WHERE later""")
def join_asof(t):
    """Each purchase with its user's last view at or before it."""
    found = joins.asof(t.events.where("event_type = 'purchase'").select("user_id", "ts", "event_id"),
                       t.events.where("event_type = 'view'").select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "event_id")
    return found.select("event_id", "user_id", C("match.event_id").alias("last_view"), C("match.value").alias("last_value"))


# --- aggregates and windows

@plan("agg_approx_distinct", """SELECT event_type, count(DISTINCT user_id) AS users, true AS distinct_close, true AS median_close FROM events GROUP BY 1""")
def agg_approx_distinct(t):
    """Sketches next to the exact values they stand for: both must be within their stated error.

    Users are counted apart from the sketches: beside a distinct count Spark keeps every sketch once per user.
    """
    users = t.events.select("event_type", "user_id").distinct().groupBy("event_type").agg(F.count("user_id").alias("users"))
    sketched = t.events.groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.01).alias("about"), F.percentile_approx("value", 0.5, 1000).alias("middle"), F.count("value").alias("n"))
    per = durable(windows.match(sketched, users, ["event_type"]))
    below = windows.match(t.events.select("event_type", "value"), per.select("event_type", "middle"), ["event_type"]).groupBy("event_type").agg(
        F.count_if(C("value") < C("middle")).alias("under"), F.count_if(C("value") <= C("middle")).alias("upto"))
    close = (C("under") <= 0.5 * C("n") + 0.002 * C("n") + 1) & (C("upto") >= 0.5 * C("n") - 0.002 * C("n") - 1)
    return windows.match(per, below, ["event_type"]).select(
        "event_type", "users", (F.abs(C("about") - C("users")) <= 0.05 * C("users") + 1).alias("distinct_close"), close.alias("median_close"))


@plan("agg_cube_rollup", """SELECT 'cube' AS kind, l_returnflag, l_linestatus, grouping(l_returnflag)::INT * 2 + grouping(l_linestatus)::INT AS level, count(*) AS n, sum(l_quantity) AS quantity
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)
UNION ALL SELECT 'rollup', l_returnflag, l_linestatus, grouping(l_returnflag)::INT * 2 + grouping(l_linestatus)::INT, count(*), sum(l_quantity) FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def agg_cube_rollup(t):
    def facts(kind, grouped):
        return grouped.agg(F.grouping_id().cast("int").alias("level"), n_rows().alias("n"), F.sum("l_quantity").alias("quantity")).select(
            F.lit(kind).alias("kind"), "l_returnflag", "l_linestatus", "level", "n", "quantity")

    keys = ("l_returnflag", "l_linestatus")
    return facts("cube", t.lineitem.cube(*keys)).unionByName(facts("rollup", t.lineitem.rollup(*keys)))


@plan("win_ntile_pct", """SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)::BIGINT AS quarter,
  percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS percent_rank, cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS cume_dist FROM customer""")
def win_ntile_pct(t):
    rows = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    tiled = windows.tiles(rows, ["c_mktsegment"], ["c_acctbal", "c_custkey"], 4, "quarter")
    shares = windows.rank_shares(rows, ["c_mktsegment"], "c_nationkey")
    return tiled.select("c_custkey", "quarter").join(shares.select("c_custkey", "percent_rank", "cume_dist"), "c_custkey")


@plan("win_range_time", """SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total, min(value) OVER w AS lowest FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)""")
def win_range_time(t):
    rows = t.events.select("event_id", "event_type", "ts", "value", C("value").cast("decimal(18,2)").alias("exact"), F.lit(1).alias("one"))
    out = windows.time_frame(rows, ["event_type"], "ts", 6 * 3600, {"n": ("count", "one"), "total": ("sum", "exact"), "lowest": ("min", "value")})
    return out.select("event_id", "n", F.round(C("total").cast("double"), 4).alias("total"), "lowest")


@plan("set_ops_other", """WITH v AS (SELECT user_id FROM events WHERE event_type = 'view'), p AS (SELECT user_id FROM events WHERE event_type = 'purchase')
SELECT 'union' AS op, user_id FROM (SELECT user_id FROM v UNION SELECT user_id FROM p) UNION ALL
SELECT 'intersect', user_id FROM (SELECT user_id FROM v INTERSECT SELECT user_id FROM p) UNION ALL
SELECT 'except', user_id FROM (SELECT user_id FROM v EXCEPT SELECT user_id FROM p) UNION ALL
SELECT 'except all', user_id FROM (SELECT user_id FROM v EXCEPT ALL SELECT user_id FROM p) UNION ALL
SELECT 'intersect all', user_id FROM (SELECT user_id FROM v INTERSECT ALL SELECT user_id FROM p)""")
def set_ops_other(t):
    v, p = (t.events.where(C("event_type") == kind).select("user_id") for kind in ("view", "purchase"))
    ops = {"union": v.union(p).distinct(), "intersect": v.intersect(p), "except": v.subtract(p), "except all": v.exceptAll(p), "intersect all": v.intersectAll(p)}
    out = None
    for name, df in ops.items():
        one = df.select(F.lit(name).alias("op"), "user_id")
        out = one if out is None else out.unionByName(one)
    return out


# --- event store and streams

@plan("es_replay", f"""SELECT user_id, max(event_version) AS version, arg_max(event_type, event_version) AS last_type, max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_purchase
FROM ({STORE_SQL}) GROUP BY 1""")
def es_replay(t):
    bought = F.when(C("event_type") == "purchase", C("ts"))
    return eventstore.replay(stored_events(t), "user_id", {"last_type": C("event_type"), "last_purchase": bought})


def timed(df):
    return df.withColumn("ts", C("ts").cast("timestamp"))


@plan("stream_dedup", "SELECT event_id, event_type, value FROM events")
def stream_dedup(t):
    """Every event arrives twice, in different files; one of each is left."""
    path = scratch_path(t.spark, "twice")
    for _ in range(2):
        t.events.write.mode("append").parquet(f"{path}/events")
    stream = timed(runner.file_stream(t.spark, path, "events")).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_id"])
    return runner.process_stream(stream, lambda df: df.select("event_id", "event_type", "value"), scratch_path(t.spark, "out"),
                                 scratch_path(t.spark, "progress"))


LATE_SQL = "event_id % 10 = 0 AND ts < TIMESTAMP '2024-01-05'"


@plan("stream_watermark", f"""WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, ts FROM events WHERE NOT ({LATE_SQL}))
SELECT window_start, count(*) AS n FROM d GROUP BY 1 HAVING window_start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM d)""")
def stream_watermark(t):
    """Rows that arrive after their window has closed are dropped, and open windows are not given out.

    The late rows come with the second run of the stream: a batch drops rows by
    the watermark of the batch before, and the first run ends with the empty
    batch that closes its windows.
    """
    path, out, progress = (scratch_path(t.spark, n) for n in ("late", "out", "progress"))
    late = (C("event_id") % 10 == 0) & (C("ts") < ntz("2024-01-05"))
    for part in (t.events.where(~late), t.events.where(late)):
        part.write.mode("append").parquet(f"{path}/events")
        stream = timed(runner.file_stream(t.spark, path, "events")).withWatermark("ts", "2 days")
        daily = stream.groupBy(F.window("ts", "1 day").alias("w")).agg(n_rows().alias("n"))
        closed = runner.process_stream(daily, lambda df: df.select(C("w.start").cast("timestamp_ntz").alias("window_start"), "n"), out, progress)
    return closed


@plan("stream_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, session
HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_session(t):
    """Sessions of a user end after thirty quiet minutes; the ones that the watermark has passed are given out."""
    stream = timed(events_stream(t)).withWatermark("ts", "10 minutes")
    sessions = stream.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(n_rows().alias("n"))
    return runner.process_stream(sessions, lambda df: df.select(
        "user_id", C("w.start").cast("timestamp_ntz").alias("session_start"), C("w.end").cast("timestamp_ntz").alias("session_end"), "n"),
        scratch_path(t.spark, "out"), scratch_path(t.spark, "progress"))


@plan("stream_join", """SELECT v.event_id AS view_id, p.event_id AS purchase_id, v.user_id FROM events v JOIN events p ON v.user_id = p.user_id
  AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR WHERE v.event_type = 'view' AND p.event_type = 'purchase'""")
def stream_join(t):
    """Purchases within six hours of a view of the same user, both sides as streams with bounded state."""
    def side(kind, name):
        rows = timed(events_stream(t)).where(C("event_type") == kind)
        return rows.select(C("event_id").alias(f"{name}_id"), C("user_id").alias(f"{name}_user"), C("ts").alias(f"{name}_ts")).withWatermark(f"{name}_ts", "40 days")

    near = (C("view_user") == C("purchase_user")) & (C("purchase_ts") >= C("view_ts")) & (C("purchase_ts") <= C("view_ts") + F.expr("INTERVAL 6 HOURS"))
    joined = side("view", "view").join(side("purchase", "purchase"), near)
    return runner.process_stream(joined, lambda df: df.select("view_id", "purchase_id", C("view_user").alias("user_id")),
                                 scratch_path(t.spark, "out"), scratch_path(t.spark, "progress"))
