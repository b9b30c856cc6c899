"""Change-data, event-store, materialization, window and alert queries, in batch and stream form."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.operators import alerts, cdc, eventstore, matviews
from lakewright.plans.registry import plan
from lakewright.plans.workloads import EVENTS_AS_OF, K_SQL, SERVICE_SQL, ntz, service
from lakewright.sources.keyed import KeyedTable
from lakewright.sources.tables import durable, scratch_path
from lakewright.sources.versioned import VersionedTable
from lakewright.streaming import runner, windows
from lakewright.streaming.state import held_alerts, keyed_state

C = F.col

# Two snapshots of the customer table: accounts below -500 are closed, buyers pay
# for their purchases, suppliers become customers.
BEFORE_SQL = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer"
AFTER_SQL = """SELECT c_custkey AS id, c_name AS name, CASE WHEN s IS NULL THEN c_acctbal ELSE round(c_acctbal - s, 2) END AS balance
FROM customer LEFT JOIN (SELECT user_id, sum(value) AS s FROM events WHERE event_type = 'purchase' GROUP BY 1) ON user_id = c_custkey
WHERE c_acctbal >= -500 UNION ALL SELECT s_suppkey + 1000000000, s_name, s_acctbal FROM supplier"""


def snapshots(t):
    before = t.customer.select(C("c_custkey").alias("id"), C("c_name").alias("name"), C("c_acctbal").alias("balance"))
    paid = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.sum("value").alias("s"))
    kept = (before.where("balance >= -500").join(paid, C("user_id") == C("id"), "left")
            .select("id", "name", F.when(C("s").isNull(), C("balance")).otherwise(F.round(C("balance") - C("s"), 2)).alias("balance")))
    joined = t.supplier.select((C("s_suppkey") + 1000000000).alias("id"), C("s_name").alias("name"), C("s_acctbal").alias("balance"))
    return before, kept.unionByName(joined)


def change_log(t):
    before, after = snapshots(t)
    return before, after, cdc.capture(before, after, ["id"], "customer")


LOG_SQL = f"""b AS ({BEFORE_SQL}), a AS ({AFTER_SQL}),
log AS (SELECT 'customer' AS table_name, CASE WHEN b.id IS NULL THEN 'I' WHEN a.id IS NULL THEN 'D' ELSE 'U' END AS operation,
  coalesce(a.id, b.id) AS id, b.balance AS old_balance, a.balance AS new_balance
  FROM b FULL JOIN a ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.balance <> b.balance OR a.name <> b.name)"""


@plan("cdc_capture", f"WITH {LOG_SQL} SELECT * FROM log")
def cdc_capture(t):
    log = change_log(t)[2]

    def balance(c):
        return F.get_json_object(c, "$.balance").cast("double")

    return log.select("table_name", "operation", "id", balance("old_values").alias("old_balance"),
                      balance("new_values").alias("new_balance"))


@plan("cdc_apply", AFTER_SQL)
def cdc_apply(t):
    """The captured log, stored in several files, is streamed into the stored table."""
    before, _, log = change_log(t)
    table = KeyedTable(t.spark, scratch_path(t.spark, "customers"), ["id"])
    table.create(before)
    path = scratch_path(t.spark, "changes")
    log.withColumn("change_id", C("id")).repartition(3).write.parquet(f"{path}/log")
    changes = runner.file_stream(t.spark, path, "log", files_per_batch=2)
    runner.apply_changes(changes, table, ["change_id"], scratch_path(t.spark, "progress"))
    return table.read()


@plan("audit_change_trail", f"""WITH {LOG_SQL} SELECT table_name, id, CASE operation WHEN 'I' THEN 'INSERT' WHEN 'U' THEN 'UPDATE' ELSE 'DELETE' END AS action,
  CASE operation WHEN 'U' THEN 'balance' ELSE 'balance,id,name' END AS changed_fields FROM log""")
def audit_change_trail(t):
    return cdc.change_trail(change_log(t)[2], ["id"])


@plan("cdc_enable", """SELECT source AS table_name, 'doc_id' AS key_columns, true AS enabled FROM documents GROUP BY source
UNION ALL SELECT split_part(url, '/', 3), 'page_id', regexp_matches(split_part(url, '/', 3), '^[a-zA-Z_][a-zA-Z0-9_]*$') FROM pages GROUP BY 1, 3""")
def cdc_enable(t):
    # Document sources are tables with plain names; host names of pages are not and stay off.
    sources = t.documents.groupBy(C("source").alias("table_name")).agg(F.lit("doc_id").alias("key_columns"))
    hosts = t.pages.groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("table_name")).agg(F.lit("page_id").alias("key_columns"))
    config = sources.withColumn("enabled", F.lit(False))
    return cdc.enable(config, sources.unionByName(hosts))


@plan("cdc_connector_config", """SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'I' WHEN 'view' THEN 'I' WHEN 'purchase' THEN 'U' WHEN 'error' THEN 'D' END AS operation,
  epoch_us(ts) // 1000 AS ts_ms FROM events""")
def cdc_connector_config(t):
    code = F.element_at(F.create_map(*[F.lit(x) for x in (
        "signup", "c", "view", "r", "purchase", "u", "error", "d", "click", "x")]), C("event_type"))
    image = F.to_json(F.struct("user_id", "value"))
    gone = C("event_type") == "error"
    message = F.to_json(F.struct(
        code.alias("op"), F.when(gone, image).alias("before"), F.when(~gone, image).alias("after"),
        F.floor(F.unix_micros(C("ts").cast("timestamp")) / 1000).alias("ts_ms")))
    log = cdc.decode_envelope(t.events.select("event_id", message.alias("m")), "m", {"user_id": "long"})
    return log.select("event_id", "user_id", "operation", "ts_ms")


# --- event store

def stored_events(t):
    """All events with versions per user: the first half as the store, the rest appended to it."""
    rows = t.events.select("user_id", "event_type", "props", "ts", "event_id")
    half = ntz("2024-01-16")
    empty = rows.limit(0).withColumn("event_version", F.lit(0).cast("long"))
    old = eventstore.append(empty, rows.where(C("ts") < half), "user_id", ["ts", "event_id"])
    new = eventstore.append(old, rows.where(C("ts") >= half), "user_id", ["ts", "event_id"])
    return old.unionByName(new)


STORE_SQL = "SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_version FROM events"


@plan("es_append", f"SELECT user_id, event_id, event_version FROM ({STORE_SQL})")
def es_append(t):
    return stored_events(t).select("user_id", "event_id", "event_version")


@plan("es_append_stream", f"SELECT user_id, event_id, event_version FROM ({STORE_SQL})")
def es_append_stream(t):
    """Two loads of events, the second with the stream started again: versions go on from the state of each user."""
    path, store, progress = (scratch_path(t.spark, n) for n in ("feed", "store", "progress"))
    half = ntz("2024-01-16")
    rows = t.events.select("user_id", "ts", "event_id")
    empty = rows.limit(0).withColumn("event_version", F.lit(0).cast("long"))
    for part in (rows.where(C("ts") < half), rows.where(C("ts") >= half)):
        part.write.mode("append").parquet(f"{path}/events")
        stored = runner.append_versions(runner.file_stream(t.spark, path, "events"), "user_id", ["ts", "event_id"], store, progress, empty)
    return stored.select("user_id", "event_id", "event_version")


@plan("es_get", f"SELECT event_type, event_version, ts FROM ({STORE_SQL}) WHERE user_id = 12 AND event_version >= 5 ORDER BY event_version")
def es_get(t):
    return eventstore.events_of(stored_events(t), "user_id", 12, 5).select("event_type", "event_version", "ts")


@plan("es_version_check", "SELECT user_id, count(*) AS events, count(*) AS last_version, true AS gapless FROM events GROUP BY 1")
def es_version_check(t):
    return eventstore.version_check(stored_events(t), "user_id")


# --- streams

def mean_of_sum(df, total="sum_values", n="count_values", name="avg_values"):
    return df.withColumn(total, F.round(total, 2)).withColumn(name, C(total) / C(n))


def events_stream(t):
    return runner.file_stream(t.spark, t.folder, "events.parquet")


@plan("stream_process", f"SELECT event_id, {K_SQL} AS k, value * 2 AS doubled, value > 50 AS is_large FROM events")
def stream_process(t):
    def step(df):
        return df.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
                         (C("value") * 2).alias("doubled"), (C("value") > 50).alias("is_large"))

    return runner.process_stream(events_stream(t), step, scratch_path(t.spark, "out"), scratch_path(t.spark, "progress"))


@plan("stream_rt_aggregate", """SELECT event_type, date_trunc('hour', ts) AS window_start, round(sum(value), 2) AS sum_value,
  round(sum(value), 2) / count(*) AS avg_value, count(value) AS count_value, count(*) AS total_rows FROM events GROUP BY 1, 2""")
def stream_rt_aggregate(t):
    agg = windows.real_time_aggregate(events_stream(t), ["event_type"], ["value"], "ts", "1 hour", watermark=None)
    path = scratch_path(t.spark, "hourly")
    runner.updates_to(agg, path, scratch_path(t.spark, "progress"))
    out = runner.current(t.spark, path, ["event_type", "window_start"])
    return mean_of_sum(out, "sum_value", "count_value", "avg_value")


WINDOW_SQL = """count(*) AS count_values, round(sum(value), 2) AS sum_values, round(sum(value), 2) / count(*) AS avg_values,
  min(value) AS min_values, max(value) AS max_values"""


@plan("stream_tumbling", f"""SELECT time_bucket(INTERVAL '2 hours', ts) AS window_start, time_bucket(INTERVAL '2 hours', ts) + INTERVAL 2 HOUR AS window_end, {WINDOW_SQL} FROM events GROUP BY 1, 2""")
def stream_tumbling(t):
    path = scratch_path(t.spark, "tumbling")
    runner.updates_to(windows.tumbling(events_stream(t), "ts", "value", "2 hours"), path,
                      scratch_path(t.spark, "progress"))
    return mean_of_sum(runner.current(t.spark, path, ["window_start", "window_end"]))


@plan("stream_sliding", f"""WITH e AS (SELECT *, unnest([time_bucket(INTERVAL '3 hours', ts), time_bucket(INTERVAL '3 hours', ts) - INTERVAL 3 HOUR]) AS window_start FROM events
  WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 12 HOUR)
SELECT window_start, window_start + INTERVAL 6 HOUR AS window_end, {WINDOW_SQL} FROM e GROUP BY 1, 2""")
def stream_sliding(t):
    path = scratch_path(t.spark, "sliding")
    runner.updates_to(windows.sliding(events_stream(t), "ts", "value", "6 hours", "3 hours", as_of=ntz(EVENTS_AS_OF)), path,
                      scratch_path(t.spark, "progress"))
    return mean_of_sum(runner.current(t.spark, path, ["window_start", "window_end"]))


@plan("stream_event_summary", """SELECT event_type, count(*) AS event_count, count(DISTINCT user_id) AS unique_users, min(ts) AS first_event, max(ts) AS last_event FROM events GROUP BY 1""")
def stream_event_summary(t):
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("event_count"), F.countDistinct("user_id").alias("unique_users"),
        F.min("ts").alias("first_event"), F.max("ts").alias("last_event"))


@plan("stream_user_activity", """SELECT user_id, count(*) AS total_events, count(DISTINCT event_type) AS event_types, min(ts) AS first_activity, max(ts) AS last_activity FROM events GROUP BY 1""")
def stream_user_activity(t):
    return t.events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_events"), F.countDistinct("event_type").alias("event_types"),
        F.min("ts").alias("first_activity"), F.max("ts").alias("last_activity"))


@plan("stream_metrics_summary", """SELECT event_type AS metric_name, count(*) AS measurements, round(sum(value), 2) / count(*) AS avg_value, min(value) AS min_value, max(value) AS max_value,
  min(ts) AS first_measured, max(ts) AS last_measured FROM events GROUP BY 1""")
def stream_metrics_summary(t):
    return t.events.groupBy(C("event_type").alias("metric_name")).agg(
        F.count(F.lit(1)).alias("measurements"), (F.round(F.sum("value"), 2) / F.count(F.lit(1))).alias("avg_value"),
        F.min("value").alias("min_value"), F.max("value").alias("max_value"),
        F.min("ts").alias("first_measured"), F.max("ts").alias("last_measured"))


# --- materialized results

def view_schedule(t):
    """A refresh schedule with one view per event type, due at the end of the type's first day."""
    first = t.events.groupBy("event_type").agg(F.min("ts").alias("first"))
    return first.select(
        F.concat(F.lit("mv_"), "event_type").alias("view_name"), F.lit(3600).cast("long").alias("interval_seconds"),
        C("first").alias("last_refresh"),
        (F.date_trunc("day", "first").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias("next_refresh"),
        (C("event_type") != "error").alias("is_active"), F.lit("COMPLETE").alias("refresh_mode"))


@plan("mv_schedule_refresh", f"""SELECT 'mv_' || event_type AS view_name, CASE WHEN n > 0 THEN 300 ELSE 3600 END::BIGINT AS interval_seconds, lo AS last_refresh,
  CASE WHEN n > 0 THEN TIMESTAMP '{EVENTS_AS_OF}' + INTERVAL 300 SECOND ELSE date_trunc('day', lo)::TIMESTAMP + INTERVAL 1 DAY END AS next_refresh, event_type <> 'error' AS is_active,
  CASE WHEN n > 0 THEN 'INCREMENTAL' ELSE 'COMPLETE' END AS refresh_mode
FROM (SELECT event_type, min(ts) AS lo, count(*) FILTER (value > 350) AS n FROM events GROUP BY 1)""")
def mv_schedule_refresh(t):
    busy = (t.events.where("value > 350").select(F.concat(F.lit("mv_"), "event_type").alias("view_name")).distinct()
            .select("view_name", F.lit(300).alias("interval_seconds"), F.lit("INCREMENTAL").alias("refresh_mode")))
    return matviews.schedule_refresh(view_schedule(t), busy, ntz(EVENTS_AS_OF))


@plan("mv_process_refreshes", f"""SELECT 'mv_' || event_type AS view_name, 3600::BIGINT AS interval_seconds,
  CASE WHEN event_type IN ('click', 'view') THEN TIMESTAMP '{EVENTS_AS_OF}' ELSE lo END AS last_refresh,
  CASE WHEN event_type IN ('click', 'view') THEN TIMESTAMP '{EVENTS_AS_OF}' + INTERVAL 1 HOUR ELSE date_trunc('day', lo)::TIMESTAMP + INTERVAL 1 DAY END AS next_refresh,
  event_type <> 'error' AS is_active, 'COMPLETE' AS refresh_mode FROM (SELECT event_type, min(ts) AS lo FROM events GROUP BY 1)""")
def mv_process_refreshes(t):
    names = ["click", "view", "error"]
    base = scratch_path(t.spark, "views")
    tables = {f"mv_{n}": VersionedTable.create(t.spark, f"{base}/{n}") for n in names}

    def builder(kind):
        return lambda: t.events.where(C("event_type") == kind).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))

    builders = {f"mv_{n}": builder(n) for n in names}
    return matviews.process_refreshes(view_schedule(t), ntz(EVENTS_AS_OF), builders, tables)[0]


DAILY_PRODUCT_SQL = """SELECT l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1, 2"""


def daily_products(t):
    return t.lineitem.groupBy("l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def materialized(t):
    table = VersionedTable.create(t.spark, scratch_path(t.spark, "daily_products"))
    return matviews.create(daily_products(t), table, "daily_products")


plan("mv_create", DAILY_PRODUCT_SQL)(materialized)
plan("mv_daily", DAILY_PRODUCT_SQL)(materialized)


@plan("mv_incremental", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total, count(*) AS n, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM lineitem GROUP BY 1")
def mv_incremental(t):
    """Built from the older lines, some of them with a wrong price; then corrections, removals and new lines are applied."""
    cut, price = ntz("2000-01-01"), C("l_extendedprice")
    lines = t.lineitem.select("l_suppkey", "l_extendedprice", "l_linenumber", "l_shipdate")
    wrong = lines.where((C("l_shipdate") < cut) & (C("l_linenumber") == 1))
    view = matviews.TotalsView(t.spark, scratch_path(t.spark, "supplier_totals"), ["l_suppkey"], "l_extendedprice")
    extra = wrong.where("l_suppkey % 5 = 0").withColumn("l_extendedprice", F.lit(0.01))
    mistaken = wrong.withColumn("l_extendedprice", price + 200000)
    view.replace(lines.where((C("l_shipdate") < cut) & (C("l_linenumber") != 1)).unionByName(mistaken).unionByName(extra))
    goes = mistaken.unionByName(extra).withColumn(matviews.SIGN, F.lit(-1))
    comes = wrong.unionByName(lines.where(C("l_shipdate") >= cut)).withColumn(matviews.SIGN, F.lit(1))
    view.refresh(goes.unionByName(comes))
    return view.read().withColumn("total", F.round("total", 2))


@plan("mv_refresh_modes", """SELECT 'mv_' || event_type AS view_name, user_id, round(sum(value), 2) AS total, count(*) AS n, min(value) AS lowest, max(value) AS highest
FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2""")
def mv_refresh_modes(t):
    """Two due views over events that are corrected meanwhile: one is rebuilt, the other takes the change log."""
    rows = t.events.where("event_type IN ('click', 'view')").select("event_id", "event_type", "user_id", "value")
    # Before: every seventh event lacked, every fifth had another value, and events of another user stood in between.
    before = rows.where("event_id % 7 <> 0").withColumn("value", F.when(C("event_id") % 5 == 0, C("value") + 9000).otherwise(C("value"))).unionByName(
        rows.where("event_id % 11 = 0").select((C("event_id") + 1000000000).alias("event_id"), "event_type", (C("user_id") + 1000000).alias("user_id"), "value"))
    log = cdc.capture(before, rows, ["event_id"], "events")
    names = {"mv_click": "click", "mv_view": "view"}
    views = {n: matviews.TotalsView(t.spark, scratch_path(t.spark, n), ["user_id"], "value") for n in names}

    def of(df, kind):
        return df.where(C("event_type") == kind)

    for name, kind in names.items():
        views[name].replace(of(before, kind))
    schedule = view_schedule(t).withColumn("refresh_mode", F.when(C("view_name") == "mv_click", "INCREMENTAL").otherwise("COMPLETE"))
    matviews.process_refreshes(
        schedule, ntz(EVENTS_AS_OF), {n: (lambda k=k: of(rows, k)) for n, k in names.items()}, views,
        {n: (lambda k=k: of(matviews.signed_changes(log, rows.schema), k)) for n, k in names.items()})
    one, other = (v.read().withColumn("view_name", F.lit(n)) for n, v in views.items())
    return one.unionByName(other).withColumn("total", F.round("total", 2))


# --- alerts

HOURLY_SQL = f"SELECT {SERVICE_SQL} AS instance, date_trunc('hour', ts) AS hour, round(sum(value), 2) AS load FROM events GROUP BY 1, 2"


def hourly_load(t):
    """One reading per service and hour."""
    return t.events.groupBy(service().alias("instance"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.round(F.sum("value"), 2).alias("load"))


@plan("alert_threshold_for", f"""WITH s AS (SELECT *, load > 60 AS on_, row_number() OVER (PARTITION BY instance ORDER BY hour)
    - row_number() OVER (PARTITION BY instance, load > 60 ORDER BY hour) AS run FROM ({HOURLY_SQL}))
SELECT instance, min(hour) AS started, max(hour) AS ended, count(*) AS samples, date_diff('second', min(hour), max(hour))::DOUBLE AS held_seconds, 'warning' AS severity
FROM s WHERE on_ GROUP BY instance, run HAVING date_diff('second', min(hour), max(hour)) >= 10800""")
def alert_threshold_for(t):
    return alerts.threshold_for(hourly_load(t), ["instance"], "hour", C("load") > 60, 3 * 3600, "warning")


@plan("alert_threshold_stream", f"""WITH s AS (SELECT *, load > 60 AS on_, lag(load > 60) OVER (PARTITION BY instance ORDER BY hour) AS before FROM ({HOURLY_SQL})),
r AS (SELECT a.instance, a.hour AS started, min(b.hour) AS ended FROM s a LEFT JOIN s b ON b.instance = a.instance AND b.hour > a.hour AND NOT b.on_
  WHERE a.on_ AND a.before IS DISTINCT FROM true GROUP BY 1, 2)
SELECT instance, started, started + INTERVAL 3 HOUR AS fired FROM r
WHERE coalesce(ended, (SELECT max(hour) + INTERVAL 1 HOUR FROM s)) >= started + INTERVAL 3 HOUR
  AND started + INTERVAL 3 HOUR <= (SELECT max(hour) FROM s)""")
def alert_threshold_stream(t):
    """The readings arrive in two parts; an alert fires three hours after its start, with or without another reading."""
    path, out, progress = (scratch_path(t.spark, n) for n in ("readings", "alerts", "progress"))
    readings = durable(hourly_load(t))
    half = ntz("2024-01-16")
    for part in (readings.where(C("hour") < half), readings.where(C("hour") >= half)):
        part.write.mode("append").parquet(f"{path}/readings")
        stream = runner.file_stream(t.spark, path, "readings").withColumn("hour", C("hour").cast("timestamp")).withWatermark("hour", "0 seconds")
        with keyed_state(t.spark):
            found = runner.process_stream(held_alerts(stream, ["instance"], "hour", C("load") > 60, 3 * 3600), lambda df: df, out, progress)
    return found.select("instance", C("started").cast("timestamp_ntz").alias("started"), C("fired").cast("timestamp_ntz").alias("fired"))


@plan("alert_rate", f"""WITH s AS (SELECT *, lag(load) OVER (PARTITION BY instance ORDER BY hour) AS p FROM ({HOURLY_SQL})),
r AS (SELECT instance, strftime(hour, '%Y-%m-%d') AS bucket, CASE WHEN p IS NULL THEN NULL WHEN load < p THEN load ELSE load - p END AS rise FROM s)
SELECT instance, bucket, round(coalesce(sum(rise), 0) / 86400, 9) AS rate FROM r GROUP BY 1, 2""")
def alert_rate(t):
    out = alerts.counter_rate(hourly_load(t), ["instance"], "hour", "load", F.date_format("hour", "yyyy-MM-dd"), 86400.0)
    return out.withColumn("rate", F.round("rate", 9))
