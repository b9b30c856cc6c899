"""Audit and log queries; the event stream stands for the activity log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.operators import audit, logs
from lakewright.plans.registry import plan
from lakewright.plans.workloads import EVENTS_AS_OF, K_SQL, SERVICE_SQL, k_of, ntz, service

C = F.col

TAG_SQL = """CASE event_type WHEN 'view' THEN 'SELECT 1' WHEN 'purchase' THEN 'INSERT 0 1' WHEN 'click' THEN 'UPDATE 1' WHEN 'signup' THEN 'CREATE TABLE' ELSE 'DELETE 1' END"""
TEXT_SQL = """CASE event_type WHEN 'view' THEN 'SELECT * FROM app.view JOIN app.users ON view.user_id = users.id WHERE view.value > 5 AND region = 1 ORDER BY ts DESC LIMIT 5'
  ELSE 'SELECT * FROM app.' || event_type || ' WHERE user_id = ' || (user_id % 10) || ' ORDER BY value' END"""
MS_SQL = "round(value * 100)::BIGINT"
ACT_SQL = f"""act AS (SELECT event_id, ts AS logged_at, 'user_' || user_id AS user_name, '10.0.0.' || (user_id % 50) AS client_ip, {TAG_SQL} AS command_tag, {TEXT_SQL} AS query_text,
  {MS_SQL} AS execution_time_ms, {K_SQL} AS affected_rows, CASE WHEN event_type = 'error' THEN 'failed' END AS error_message, event_type FROM events),
enr AS (SELECT *, CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'purchase' THEN 'INSERT' WHEN 'click' THEN 'UPDATE' WHEN 'signup' THEN 'DDL' ELSE 'DELETE' END AS operation_type,
  md5(query_text) AS query_hash, CASE WHEN error_message IS NOT NULL THEN 'ERROR' WHEN execution_time_ms > 10000 THEN 'WARNING' ELSE 'INFO' END AS severity FROM act)"""


def activity(t):
    """Activity log rows: the event type gives the command, the value the time in hundredths."""
    kind = C("event_type")
    tag = (F.when(kind == "view", "SELECT 1").when(kind == "purchase", "INSERT 0 1").when(kind == "click", "UPDATE 1")
           .when(kind == "signup", "CREATE TABLE").otherwise("DELETE 1"))
    text = F.when(kind == "view", "SELECT * FROM app.view JOIN app.users ON view.user_id = users.id "
                  "WHERE view.value > 5 AND region = 1 ORDER BY ts DESC LIMIT 5").otherwise(
        F.concat(F.lit("SELECT * FROM app."), kind, F.lit(" WHERE user_id = "), (C("user_id") % 10).cast("string"), F.lit(" ORDER BY value")))
    return t.events.select(
        "event_id", C("ts").alias("logged_at"), F.concat(F.lit("user_"), C("user_id").cast("string")).alias("user_name"),
        F.concat(F.lit("10.0.0."), (C("user_id") % 50).cast("string")).alias("client_ip"), tag.alias("command_tag"),
        text.alias("query_text"), F.round(C("value") * 100).cast("long").alias("execution_time_ms"),
        k_of().alias("affected_rows"), F.when(kind == "error", "failed").alias("error_message"),
        F.array(F.concat(F.lit("app."), kind), F.when(kind == "purchase", "Customer_payments").otherwise("users")).alias("table_names"),
        "event_type")


def security(t):
    """Security events: an error is a failed login, critical above 20 seconds."""
    kind = F.when(C("event_type") == "error", "LOGIN_FAILED").otherwise(F.upper("event_type"))
    level = F.when((C("event_type") == "error") & (C("value") > 200), "CRITICAL").otherwise("INFO")
    return t.events.select(
        "event_id", C("ts").alias("occurred_at"), F.concat(F.lit("user_"), C("user_id").cast("string")).alias("user_name"),
        F.concat(F.lit("10.0.0."), (C("user_id") % 50).cast("string")).alias("client_ip"), kind.alias("event_type"), level.alias("severity"))


SEC_SQL = """sec AS (SELECT event_id, ts AS occurred_at, 'user_' || user_id AS user_name, '10.0.0.' || (user_id % 50) AS client_ip,
  CASE WHEN event_type = 'error' THEN 'LOGIN_FAILED' ELSE upper(event_type) END AS event_type, CASE WHEN event_type = 'error' AND value > 200 THEN 'CRITICAL' ELSE 'INFO' END AS severity FROM events)"""
AS_OF_SQL = f"TIMESTAMP '{EVENTS_AS_OF}'"


def as_of():
    return ntz(EVENTS_AS_OF)


@plan("audit_enrich", f"WITH {ACT_SQL} SELECT event_id, operation_type, query_hash, severity FROM enr")
def audit_enrich(t):
    return audit.enrich(activity(t)).select("event_id", "operation_type", "query_hash", "severity")


SESSION_SQL = """ses AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, 'user_' || user_id AS user_name, min(ts) AS login_time, max(ts) AS last_activity,
  max(CASE WHEN event_type = 'signup' THEN ts END) AS logout_time, count(*) AS queries_executed, (round(sum(value), 2) * 100)::BIGINT * 10 AS data_read_bytes FROM events GROUP BY 1, 2)"""


def session_id():
    return F.concat_ws("-", C("user_id").cast("string"), F.date_format("ts", "yyyyMMdd"))


def session_starts(t):
    return t.events.groupBy(session_id().alias("session_id")).agg(
        F.concat(F.lit("user_"), F.min("user_id").cast("string")).alias("user_name"), F.min("ts").alias("login_time"),
        F.max("ts").alias("last_activity"), F.count(F.lit(1)).alias("queries_executed"),
        (F.round(F.round(F.sum("value"), 2) * 100).cast("long") * 10).alias("data_read_bytes"))


def session_ends(t):
    return t.events.where("event_type = 'signup'").select(
        session_id().alias("session_id"), C("ts").alias("logout_time"), F.lit("signed out").alias("reason"))


@plan("audit_sessions", f"""WITH {SESSION_SQL} SELECT session_id, user_name, login_time, logout_time, CASE WHEN logout_time IS NOT NULL THEN 'signed out' END AS reason,
  (epoch_us(logout_time) - epoch_us(login_time)) / 1000000.0::DOUBLE AS duration_seconds FROM ses""")
def audit_sessions(t):
    return audit.sessions(session_starts(t), session_ends(t)).select(
        "session_id", "user_name", "login_time", "logout_time", "reason", "duration_seconds")


@plan("audit_security_events", f"WITH {SEC_SQL} SELECT event_id, user_name, client_ip, event_type, severity FROM sec WHERE severity = 'CRITICAL'")
def audit_security_events(t):
    return audit.critical(security(t)).select("event_id", "user_name", "client_ip", "event_type", "severity")


@plan("audit_daily_summary", f"""WITH {ACT_SQL} SELECT strftime(logged_at, '%Y-%m-%d') AS activity_date, user_name, operation_type, count(*) AS operation_count,
  sum(execution_time_ms)::BIGINT AS total_execution_time, sum(execution_time_ms)::DOUBLE / count(*) AS avg_execution_time, sum(affected_rows)::BIGINT AS total_affected_rows
FROM enr WHERE logged_at >= {AS_OF_SQL} - INTERVAL 30 DAY GROUP BY 1, 2, 3""")
def audit_daily_summary(t):
    return audit.daily_summary(audit.enrich(activity(t)), as_of())


@plan("audit_security_summary", f"""WITH {SEC_SQL} SELECT date_trunc('hour', occurred_at) AS event_hour, event_type, severity, count(*) AS event_count,
  array_to_string(list_sort(list(DISTINCT user_name)), ',') AS affected_users, array_to_string(list_sort(list(DISTINCT client_ip)), ',') AS source_ips
FROM sec WHERE occurred_at >= {AS_OF_SQL} - INTERVAL 7 DAY GROUP BY 1, 2, 3""")
def audit_security_summary(t):
    out = audit.security_summary(security(t), as_of())
    return out.withColumn("affected_users", F.array_join("affected_users", ",")).withColumn("source_ips", F.array_join("source_ips", ","))


@plan("audit_active_sessions", f"""WITH {SESSION_SQL} SELECT session_id, user_name, login_time, last_activity, (epoch_us({AS_OF_SQL}) - epoch_us(last_activity)) / 1000000.0::DOUBLE AS idle_seconds,
  queries_executed, CASE WHEN data_read_bytes < 10240 THEN data_read_bytes || ' bytes' ELSE ((data_read_bytes // 512 + 1) // 2) || ' kB' END AS data_read FROM ses WHERE logout_time IS NULL""")
def audit_active_sessions(t):
    return audit.active_sessions(audit.sessions(session_starts(t), session_ends(t)), as_of())


@plan("audit_compliance_report", f"""WITH {ACT_SQL}, {SEC_SQL}
SELECT 'User Activity' AS report_section, 'Total Queries' AS metric_name, count(*)::VARCHAR AS metric_value, CASE WHEN count(*) > 0 THEN 'COMPLIANT' ELSE 'NO_ACTIVITY' END AS compliance_status FROM enr WHERE logged_at >= TIMESTAMP '2024-01-10' AND logged_at < TIMESTAMP '2024-01-20'
UNION ALL SELECT 'Security Events', 'Critical Events', count(*)::VARCHAR, CASE WHEN count(*) = 0 THEN 'COMPLIANT' ELSE 'REQUIRES_ATTENTION' END FROM sec WHERE severity = 'CRITICAL' AND occurred_at >= TIMESTAMP '2024-01-10' AND occurred_at < TIMESTAMP '2024-01-20'
UNION ALL SELECT 'Schema Changes', 'DDL Operations', count(*)::VARCHAR, 'LOGGED' FROM enr WHERE operation_type = 'DDL' AND logged_at >= TIMESTAMP '2024-01-10' AND logged_at < TIMESTAMP '2024-01-20'
UNION ALL SELECT 'Performance', 'Slow Queries (>5s)', count(*)::VARCHAR, CASE WHEN count(*) < 10 THEN 'ACCEPTABLE' ELSE 'REQUIRES_OPTIMIZATION' END FROM enr WHERE execution_time_ms > 5000 AND logged_at >= TIMESTAMP '2024-01-10' AND logged_at < TIMESTAMP '2024-01-20'""")
def audit_compliance_report(t):
    log = audit.enrich(activity(t))
    changes = log.where("operation_type = 'DDL'").withColumn("changed_at", C("logged_at"))
    return audit.compliance_report(log, security(t), changes, ntz("2024-01-10"), ntz("2024-01-20"))


FAIL_SQL = f"""SELECT 'MULTIPLE_LOGIN_FAILURES' AS alert_type, user_name, client_ip, 'Multiple login failures within 24 hours' AS description, 'HIGH' AS severity, count(*) AS event_count
FROM sec WHERE event_type = 'LOGIN_FAILED' AND occurred_at > {AS_OF_SQL} - INTERVAL 24 HOUR AND occurred_at <= {AS_OF_SQL} GROUP BY 2, 3 HAVING count(*) >= 2"""
BURST_SQL = f"""SELECT 'UNUSUAL_QUERY_PATTERN' AS alert_type, user_name, client_ip, 'High volume of queries in short time' AS description, 'MEDIUM' AS severity, count(*) AS event_count
FROM enr WHERE logged_at > {AS_OF_SQL} - INTERVAL 12 HOUR AND logged_at <= {AS_OF_SQL} GROUP BY 2, 3 HAVING count(*) > 2"""
OFF_SQL = f"""SELECT 'OFF_HOURS_SENSITIVE_ACCESS' AS alert_type, user_name, client_ip, 'Access to sensitive data outside business hours' AS description, 'HIGH' AS severity, count(*) AS event_count
FROM enr WHERE event_type = 'purchase' AND logged_at > {AS_OF_SQL} - INTERVAL 24 HOUR AND logged_at <= {AS_OF_SQL} AND (hour(logged_at) < 8 OR hour(logged_at) > 18) GROUP BY 2, 3"""


@plan("audit_login_failures", f"WITH {SEC_SQL} {FAIL_SQL}")
def audit_login_failures(t):
    return audit.login_failures(security(t), as_of(), "24 HOURS", 2)


@plan("audit_query_burst", f"WITH {ACT_SQL} {BURST_SQL}")
def audit_query_burst(t):
    return audit.query_burst(activity(t), as_of(), "12 HOURS", 2)


@plan("audit_off_hours", f"WITH {ACT_SQL} {OFF_SQL}")
def audit_off_hours(t):
    return audit.off_hours(activity(t), as_of(), "24 HOURS")


@plan("audit_detect_all", f"WITH {ACT_SQL}, {SEC_SQL} {FAIL_SQL} UNION ALL {BURST_SQL} UNION ALL {OFF_SQL}")
def audit_detect_all(t):
    return audit.detect_all(activity(t), security(t), as_of(), failure_span="24 HOURS", failures=2, burst_span="12 HOURS",
                            burst=2, off_hours_span="24 HOURS")


@plan("audit_retention", """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 48 MONTH""")
def audit_retention(t):
    return audit.retain(t.orders, "o_orderdate", ntz("2001-08-01"), 48).select("o_orderkey", "o_orderdate")


# --- query logs

STATS_SQL = """SELECT md5(query_text) AS query_hash, min(query_text) AS query_text, count(*) AS calls, sum(execution_time_ms)::BIGINT AS total_ms,
  sum(execution_time_ms)::DOUBLE / count(*) AS mean_ms FROM act GROUP BY 1"""


@plan("log_slow_queries", f"WITH {ACT_SQL} SELECT * FROM ({STATS_SQL}) WHERE mean_ms > 4800 ORDER BY mean_ms DESC, query_hash LIMIT 10")
def log_slow_queries(t):
    return logs.slow_queries(logs.query_statistics(activity(t)), 4800, 10)


@plan("log_query_stats", f"""WITH {ACT_SQL}, d AS (SELECT md5(query_text) AS query_hash, date_diff('day', TIMESTAMP '2024-01-01', logged_at) AS day, avg(execution_time_ms) AS m FROM act GROUP BY 1, 2),
tr AS (SELECT query_hash, regr_slope(m, day) AS slope, count(*) AS days FROM d GROUP BY 1)
SELECT query_hash, calls, total_ms, mean_ms, round(slope, 4) AS ms_per_day, days FROM ({STATS_SQL}) JOIN tr USING (query_hash)""")
def log_query_stats(t):
    log = activity(t)
    trend = logs.query_trend(log, F.datediff("logged_at", ntz("2024-01-01")))
    return logs.query_statistics(log).drop("query_text").join(trend, "query_hash").withColumn("ms_per_day", F.round("ms_per_day", 4))


NODES_SQL = """nodes AS (SELECT o_orderkey AS query_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Seq Scan' WHEN '2-HIGH' THEN 'Sort' WHEN '3-MEDIUM' THEN 'Hash Join' WHEN '4-NOT SPECIFIED' THEN 'Merge Join' ELSE 'Aggregate' END AS node_type,
  'orders_' || o_orderstatus AS relation, o_orderkey % 5000 AS plan_rows, o_custkey + 1 AS actual_rows, o_totalprice AS total_cost, 'o_custkey = ' || o_custkey || ' AND o_totalprice > 5' AS filter FROM orders)"""


def plan_nodes(t):
    """Plan nodes from orders: the priority gives the node type, the price its cost."""
    priority = C("o_orderpriority")
    node = (F.when(priority == "1-URGENT", "Seq Scan").when(priority == "2-HIGH", "Sort")
            .when(priority == "3-MEDIUM", "Hash Join").when(priority == "4-NOT SPECIFIED", "Merge Join").otherwise("Aggregate"))
    return t.orders.select(
        C("o_orderkey").alias("query_id"), node.alias("node_type"), F.concat(F.lit("orders_"), "o_orderstatus").alias("relation"),
        (C("o_orderkey") % 5000).alias("plan_rows"), (C("o_custkey") + 1).alias("actual_rows"), C("o_totalprice").alias("total_cost"),
        F.concat(F.lit("o_custkey = "), C("o_custkey").cast("string"), F.lit(" AND o_totalprice > 5")).alias("filter"))


@plan("log_plan_issues", f"""WITH {NODES_SQL}, r AS (SELECT *, greatest(plan_rows::DOUBLE / nullif(actual_rows, 0), actual_rows::DOUBLE / nullif(plan_rows, 0)) AS ratio FROM nodes)
SELECT query_id, node_type, relation, total_cost, 'seq_scan' AS issue, 'o_custkey,o_totalprice' AS detail FROM r WHERE node_type = 'Seq Scan' AND plan_rows > 100 AND total_cost > 1000
UNION ALL SELECT query_id, node_type, relation, total_cost, 'expensive_sort', '' FROM r WHERE node_type = 'Sort' AND total_cost > 10000
UNION ALL SELECT query_id, node_type, relation, total_cost, 'high_cost_join', node_type FROM r WHERE node_type LIKE '%Join%' AND total_cost > 50000
UNION ALL SELECT query_id, node_type, relation, total_cost, 'estimation_error', floor(ratio)::BIGINT::VARCHAR FROM r WHERE plan_rows > 0 AND actual_rows > 0 AND ratio > 100""")
def log_plan_issues(t):
    return logs.plan_issues(plan_nodes(t))


@plan("log_predicate_columns", f"""WITH {ACT_SQL}, u AS (
  SELECT event_type, user_id % 10 AS g, {MS_SQL} AS ms FROM events),
c AS (SELECT event_type AS table_name, unnest(['user_id', 'value']) AS column_name, ms FROM u WHERE event_type <> 'view'
  UNION ALL SELECT 'view', unnest(['value', 'region', 'ts']), ms FROM u WHERE event_type = 'view'
  UNION ALL SELECT 'users', unnest(['region', 'ts']), ms FROM u WHERE event_type = 'view')
SELECT table_name, column_name, count(*) AS uses, sum(ms)::BIGINT AS total_ms FROM c GROUP BY 1, 2""")
def log_predicate_columns(t):
    return logs.predicate_columns(activity(t))


@plan("log_table_bloat_rank", """WITH s AS (SELECT p_brand AS table_name, count(*) FILTER (l_returnflag <> 'R') AS live, count(*) FILTER (l_returnflag = 'R') AS dead,
    date_diff('day', max(l_shipdate), TIMESTAMP '2001-12-31') AS days FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
p AS (SELECT *, round(dead * 100.0::DOUBLE / (dead + live), 2) AS dead_percent FROM s WHERE dead > 800 OR (live > 0 AND dead > live * 50 / 100.0::DOUBLE))
SELECT table_name, live, dead, dead_percent, round(dead_percent * 0.5 + least(dead_percent, 50) * 0.3 + least(days, 30) * 0.2, 6) AS priority FROM p""")
def log_table_bloat_rank(t):
    gone = C("l_returnflag") == "R"
    per = (t.lineitem.join(t.part, C("l_partkey") == C("p_partkey")).groupBy(C("p_brand").alias("table_name"))
           .agg(F.count_if(~gone).alias("live"), F.count_if(gone).alias("dead"),
                F.datediff(ntz("2001-12-31"), F.max("l_shipdate")).alias("days_since_clean")))
    per = per.withColumn("bloat_percent", F.round(C("dead") * F.lit(100.0) / (C("dead") + C("live")), 2))
    out = logs.bloat_rank(per, 800, 50.0)
    return out.select("table_name", "live", "dead", "dead_percent", F.round("priority", 6).alias("priority"))


BENCH_SQL = f"""SELECT {SERVICE_SQL} AS benchmark, count(*) AS runs, avg(value) AS mean, stddev_samp(value) AS stddev, min(value) AS min, max(value) AS max, median(value) AS median FROM events"""


@plan("bench_compare", f"""WITH b AS ({BENCH_SQL} WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), c AS ({BENCH_SQL} WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1)
SELECT c.benchmark, c.runs, round(c.mean, 6) AS mean, round(c.stddev, 6) AS stddev, c.min, c.max, round(c.median, 6) AS median, round((c.mean - b.mean) / b.mean * 100, 4) AS time_change,
  round((1 / c.mean - 1 / b.mean) / (1 / b.mean) * 100, 4) AS qps_change, CASE WHEN (c.mean - b.mean) / b.mean * 100 > 5 THEN 'REGRESSION' ELSE 'PASS' END AS status FROM c JOIN b USING (benchmark)""")
def bench_compare(t):
    runs = t.events.select(service().alias("benchmark"), C("value").alias("seconds"), "ts")
    cut = ntz("2024-01-16")
    out = logs.benchmark_compare(runs.where(C("ts") < cut), runs.where(C("ts") >= cut)).drop("baseline_mean")
    return out.withColumns({c: F.round(c, n) for c, n in (("mean", 6), ("stddev", 6), ("median", 6), ("time_change", 4), ("qps_change", 4))})


@plan("bench_hint", """SELECT event_id, CASE WHEN value * 10 < 100 THEN 'good' WHEN value * 10 < 1000 THEN 'consider optimizing' ELSE 'rewrite or materialize' END AS advice,
  CASE WHEN value * 10 > 1000 THEN 'split the data' ELSE 'no split needed' END AS parallel FROM events""")
def bench_hint(t):
    advice, parallel = logs.benchmark_hint(C("value") * 10)
    return t.events.select("event_id", advice.alias("advice"), parallel.alias("parallel"))


@plan("log_state_counts", f"""SELECT CASE event_type WHEN 'view' THEN 'active' WHEN 'error' THEN 'aborted' ELSE 'idle' END AS state, count(*) AS sessions,
  sum({MS_SQL})::DOUBLE / count(*) AS avg_duration_ms, max({MS_SQL})::BIGINT AS max_duration_ms FROM events GROUP BY 1""")
def log_state_counts(t):
    state = F.when(C("event_type") == "view", "active").when(C("event_type") == "error", "aborted").otherwise("idle")
    return logs.state_counts(t.events.select(state.alias("state"), F.round(C("value") * 100).cast("long").alias("duration_ms")))
