"""Audit-log analytics over activity, session and security-event tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operation types by how the command tag starts.
OPERATIONS = (("SELECT", "SELECT"), ("INSERT", "INSERT"), ("UPDATE", "UPDATE"), ("DELETE", "DELETE"),
              ("CREATE", "DDL"), ("ALTER", "DDL"), ("DROP", "DDL"))
# Names that mark a table as sensitive.
SENSITIVE = ("customer", "payment", "sensitive")


def enrich(log: DataFrame) -> DataFrame:
    """Activity rows with operation type, query hash and severity."""
    kind = None
    for start, name in OPERATIONS:
        hit = F.col("command_tag").ilike(f"{start}%")
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    severity = (F.when(F.col("error_message").isNotNull(), "ERROR")
                .when(F.col("execution_time_ms") > 10000, "WARNING").otherwise("INFO"))
    return (log.withColumn("operation_type", kind.otherwise("OTHER"))
            .withColumn("query_hash", F.md5("query_text")).withColumn("severity", severity))


def sessions(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Sessions (session_id, login_time, ...) with end, reason and duration; open ones have none."""
    last = ends.groupBy("session_id").agg(F.max("logout_time").alias("logout_time"),
                                          F.max_by("reason", "logout_time").alias("reason"))
    seconds = (F.unix_micros(F.col("logout_time").cast("timestamp"))
               - F.unix_micros(F.col("login_time").cast("timestamp"))) / F.lit(1e6)
    return starts.join(last, "session_id", "left").withColumn("duration_seconds", seconds)


def critical(events: DataFrame) -> DataFrame:
    """Security events to notify about; works on a stream as well."""
    return events.where(F.col("severity") == "CRITICAL")


def daily_summary(log: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    recent = log.where(F.col("logged_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(F.date_format("logged_at", "yyyy-MM-dd").alias("activity_date"), "user_name", "operation_type").agg(
        F.count(F.lit(1)).alias("operation_count"), F.sum("execution_time_ms").alias("total_execution_time"),
        (F.sum("execution_time_ms") / F.count("execution_time_ms")).alias("avg_execution_time"),
        F.sum("affected_rows").alias("total_affected_rows"))


def security_summary(events: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Counts, distinct users and addresses per hour, type and severity."""
    recent = events.where(F.col("occurred_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))
    return recent.groupBy(F.date_trunc("hour", "occurred_at").cast("timestamp_ntz").alias("event_hour"), "event_type", "severity").agg(
        F.count(F.lit(1)).alias("event_count"), F.sort_array(F.collect_set("user_name")).alias("affected_users"),
        F.sort_array(F.collect_set("client_ip")).alias("source_ips"))


def size_pretty(size: Column) -> Column:
    """Bytes with a unit, switching units above about ten thousand and rounding half up."""
    shown = F.when(size < 10240, F.concat(size.cast("string"), F.lit(" bytes")))
    halves = F.shiftright(size, 9)  # twice the number of the current unit
    for unit in ("kB", "MB", "GB"):
        shown = shown.when(halves < 20479, F.concat(F.floor((halves + 1) / 2).cast("string"), F.lit(f" {unit}")))
        halves = F.shiftright(halves, 10)
    return shown.otherwise(F.concat(F.floor((halves + 1) / 2).cast("string"), F.lit(" TB")))


def active_sessions(log: DataFrame, as_of: Column) -> DataFrame:
    """Open sessions with idle seconds and readable sizes."""
    idle = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_activity").cast("timestamp"))) / F.lit(1e6)
    return log.where(F.col("logout_time").isNull()).select(
        "session_id", "user_name", "login_time", "last_activity", idle.alias("idle_seconds"), "queries_executed",
        size_pretty(F.col("data_read_bytes")).alias("data_read"))


def _in_range(df: DataFrame, ts: str, start: Column, end: Column, user: str | None) -> DataFrame:
    rows = df.where((F.col(ts) >= start) & (F.col(ts) < end))
    return rows.where(F.col("user_name") == user) if user else rows


def compliance_report(activity: DataFrame, security: DataFrame, changes: DataFrame, start: Column, end: Column,
                      user: str | None = None) -> DataFrame:
    """Four sections with their count and status over [start, end)."""
    def section(rows, name, metric, status):
        n = F.col("n")
        return rows.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("report_section"), F.lit(metric).alias("metric_name"), n.cast("string").alias("metric_value"),
            status(n).alias("compliance_status"))

    act = _in_range(activity, "logged_at", start, end, user)
    parts = [
        section(act, "User Activity", "Total Queries", lambda n: F.when(n > 0, "COMPLIANT").otherwise("NO_ACTIVITY")),
        section(critical(_in_range(security, "occurred_at", start, end, user)), "Security Events", "Critical Events",
                lambda n: F.when(n == 0, "COMPLIANT").otherwise("REQUIRES_ATTENTION")),
        section(_in_range(changes, "changed_at", start, end, user), "Schema Changes", "DDL Operations", lambda n: F.lit("LOGGED")),
        section(act.where("execution_time_ms > 5000"), "Performance", "Slow Queries (>5s)",
                lambda n: F.when(n < 10, "ACCEPTABLE").otherwise("REQUIRES_OPTIMIZATION")),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.unionByName(one)
    return out


WHO = ["user_name", "client_ip"]
# Name, text and severity of each alert.
LOGIN_FAILURES = ("MULTIPLE_LOGIN_FAILURES", "Multiple login failures within {span}", "HIGH")
QUERY_BURST = ("UNUSUAL_QUERY_PATTERN", "High volume of queries in short time", "MEDIUM")
OFF_HOURS = ("OFF_HOURS_SENSITIVE_ACCESS", "Access to sensitive data outside business hours", "HIGH")


def _since(df: DataFrame, ts: str, as_of: Column, span: str) -> DataFrame:
    return df.where((F.col(ts) > as_of - F.expr(f"INTERVAL {span}")) & (F.col(ts) <= as_of))


def _alert(rows: DataFrame, alert: tuple[str, str, str], span: str, at_least: int) -> DataFrame:
    kind, text, severity = alert
    return (rows.groupBy(*WHO).agg(F.count(F.lit(1)).alias("event_count")).where(F.col("event_count") >= at_least)
            .select(F.lit(kind).alias("alert_type"), *WHO, F.lit(text.format(span=span.lower())).alias("description"), F.lit(severity).alias("severity"),
                    "event_count"))


def login_failures(security: DataFrame, as_of: Column, span: str = "1 HOUR", at_least: int = 5) -> DataFrame:
    failed = _since(security, "occurred_at", as_of, span).where("event_type = 'LOGIN_FAILED'")
    return _alert(failed, LOGIN_FAILURES, span, at_least)


def query_burst(activity: DataFrame, as_of: Column, span: str = "10 MINUTES", more_than: int = 1000) -> DataFrame:
    return _alert(_since(activity, "logged_at", as_of, span), QUERY_BURST, span, more_than + 1)


def off_hours(activity: DataFrame, as_of: Column, span: str = "1 HOUR") -> DataFrame:
    hour = F.hour("logged_at")
    touched = F.exists("table_names", lambda n: reduce(or_, [n.ilike(f"%{word}%") for word in SENSITIVE]))
    rows = _since(activity, "logged_at", as_of, span).where(((hour < 8) | (hour > 18)) & touched)
    return _alert(rows, OFF_HOURS, span, 1)


def failures_per_window(security: DataFrame, span: str, at_least: int) -> DataFrame:
    """Failed logins per user, address and window, for whole logs and streams."""
    return (security.where("event_type = 'LOGIN_FAILED'")
            .groupBy(*WHO, F.window("occurred_at", span).getField("start").alias("window_start"))
            .agg(F.count(F.lit(1)).alias("event_count")).where(F.col("event_count") >= at_least))


def detect_all(activity: DataFrame, security: DataFrame, as_of: Column, *, failure_span: str = "1 HOUR", failures: int = 5,
               burst_span: str = "10 MINUTES", burst: int = 1000, off_hours_span: str = "1 HOUR") -> DataFrame:
    """All suspicious-activity alerts."""
    return (login_failures(security, as_of, failure_span, failures)
            .unionByName(query_burst(activity, as_of, burst_span, burst))
            .unionByName(off_hours(activity, as_of, off_hours_span)))


def retain(df: DataFrame, ts: str, as_of: Column, months: int = 84, closed_only: bool = False) -> DataFrame:
    """Rows young enough to keep; with ``closed_only`` rows without the time are kept as well."""
    cutoff = F.add_months(F.to_date(as_of), -months)
    young = F.to_date(ts) >= cutoff
    return df.where(young | F.col(ts).isNull()) if closed_only else df.where(young)
