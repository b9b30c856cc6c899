"""Query-log, plan, table-statistics and benchmark analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakewright.operators.percentiles import percentiles
from lakewright.operators.windows import match

# Texts that mark a query of the system itself.
SYSTEM_TEXTS = ("pg_stat_statements", "query_diagnosis", "information_schema")

# Words that begin a clause, compare their left neighbour, or are no name.
_CLAUSES = ("select", "from", "join", "where", "on", "group", "having", "order", "limit", "offset", "set", "values", "union")
_COMPARISONS = ("=", "<", ">", "<=", ">=", "<>", "!=", "in", "like", "ilike", "between", "is")
_WORDS = (*_CLAUSES, *_COMPARISONS, "and", "or", "not", "null", "as", "by", "asc", "desc", "nulls", "first", "last", "case", "when",
          "then", "else", "end", "true", "false", "distinct", "exists", "inner", "left", "right", "full", "outer", "cross", "using", "all")


def _tokens(text: Column) -> Column:
    """Names, comparison signs and punctuation of a query in lower case.

    Comments go, and literals become marks, so nothing inside them is taken for a name.
    """
    bare = F.regexp_replace(text, r"--[^\n]*|/\*(?s:.*?)\*/", " ")
    plain = F.regexp_replace(bare, r"'(?:[^']|'')*'", " ? ")
    name = r'(?:[a-z_][a-z0-9_$]*|"[^"]+")'
    return F.transform(F.regexp_extract_all(F.lower(plain), F.lit(rf"({name}(?:\.{name})*|<=|>=|<>|!=|[=<>(),?]|[0-9]+)"), F.lit(1)),
                       lambda t: F.replace(t, F.lit('"'), F.lit("")))


def _is_name(token: Column) -> Column:
    return token.rlike(r"^[a-z_]") & ~token.isin(*_WORDS)


def _with_neighbours(tokens: Column) -> Column:
    """Every token with the ones around it and the clause it stands in."""
    def around(token: Column, i: Column) -> Column:
        clause = F.try_element_at(F.filter(F.slice(tokens, F.lit(1), i), lambda t: t.isin(*_CLAUSES)), F.lit(-1))
        return F.struct(token.alias("t"), F.get(tokens, i - 1).alias("before"), F.get(tokens, i + 1).alias("after"),
                        F.get(tokens, i + 2).alias("second"), clause.alias("clause"))

    return F.transform(tokens, around)


def _compared(x: Column) -> Column:
    """Whether a name is an operand of a comparison."""
    left = x["after"].isin(*_COMPARISONS) | ((x["after"] == "not") & x["second"].isin(*_COMPARISONS))
    right = x["before"].isin("=", "<", ">", "<=", ">=", "<>", "!=")
    return _is_name(x["t"]) & F.coalesce(left | right, F.lit(False))


def query_statistics(log: DataFrame) -> DataFrame:
    """Calls, total and mean time per query text, keyed by the text's hash."""
    return log.groupBy(F.md5("query_text").alias("query_hash")).agg(
        F.min("query_text").alias("query_text"), F.count(F.lit(1)).alias("calls"), F.sum("execution_time_ms").alias("total_ms"),
        (F.sum("execution_time_ms") / F.count(F.lit(1))).alias("mean_ms"))


def slow_queries(stats: DataFrame, threshold_ms: float = 1000, n: int = 10) -> DataFrame:
    own = None
    for text in SYSTEM_TEXTS:
        one = F.col("query_text").contains(text)
        own = one if own is None else own | one
    return stats.where((F.col("mean_ms") > threshold_ms) & ~own).orderBy(F.desc("mean_ms"), "query_hash").limit(n)


def query_trend(log: DataFrame, day: Column) -> DataFrame:
    """Slope per day of each query's mean time."""
    daily = log.groupBy(F.md5("query_text").alias("query_hash"), day.alias("_day")).agg(F.avg("execution_time_ms").alias("_m"))
    return daily.groupBy("query_hash").agg(F.regr_slope("_m", "_day").alias("ms_per_day"), F.count(F.lit(1)).alias("days"))


def plan_issues(nodes: DataFrame) -> DataFrame:
    """Issues found on plan nodes (query_id, node_type, relation, plan_rows, actual_rows, total_cost, filter)."""
    kind, cost, rows = F.col("node_type"), F.col("total_cost"), F.col("plan_rows")
    off = F.greatest(rows / F.nullif(F.col("actual_rows"), F.lit(0)), F.col("actual_rows") / F.nullif(rows, F.lit(0)))
    operands = F.filter(_with_neighbours(_tokens(F.col("filter"))), _compared)
    columns = F.array_join(F.transform(operands, lambda x: F.element_at(F.split(x["t"], r"\."), -1)), ",")

    def issue(condition, name, detail):
        return F.when(condition, F.struct(F.lit(name).alias("issue"), detail.cast("string").alias("detail")))

    found = F.array(
        issue((kind == "Seq Scan") & (rows > 100) & (cost > 1000), "seq_scan", columns),
        issue((kind == "Sort") & (cost > 10000), "expensive_sort", F.lit("")),
        issue(kind.contains("Join") & (cost > 50000), "high_cost_join", kind),
        issue((rows > 0) & (F.col("actual_rows") > 0) & (off > 100), "estimation_error", F.floor(off)))
    return (nodes.select("query_id", "node_type", "relation", "total_cost", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i"))
            .select("query_id", "node_type", "relation", "total_cost", "i.issue", "i.detail"))


def predicate_columns(log: DataFrame) -> DataFrame:
    """Tables and columns used in filters (WHERE) and orderings, ranked by the time of their queries.

    Equal texts are summed first, so each text is searched once. A qualified
    column belongs to the table of that name or alias, any other to every table
    of its query. Case does not matter; names come out in lower case.
    """
    texts = query_statistics(log).withColumn("_x", _with_neighbours(_tokens(F.col("query_text"))))

    def table(x: Column) -> Column:
        listed = x["before"].isin("from", "join") | ((x["before"] == ",") & (x["clause"] == "from"))
        return _is_name(x["t"]) & F.coalesce(listed, F.lit(False))

    def alias(x: Column) -> Column:
        named = F.when(x["after"] == "as", x["second"]).otherwise(x["after"])
        own = F.element_at(F.split(x["t"], r"\."), -1)
        return F.struct(F.when(F.coalesce(_is_name(named), F.lit(False)), named).otherwise(own).alias("alias"), own.alias("name"))

    def used(x: Column) -> Column:
        filtered = _compared(x) & (x["clause"] == "where")
        ordered = (x["clause"] == "order") & x["before"].isin("by", ",") & _is_name(x["t"])
        return F.coalesce(filtered | ordered, F.lit(False))

    found = texts.select(
        "query_hash", "calls", "total_ms", F.transform(F.filter("_x", table), alias).alias("_tables"),
        F.explode(F.array_distinct(F.transform(F.filter("_x", used), lambda x: x["t"]))).alias("_column"))
    parts = F.split("_column", r"\.")
    owner = F.try_element_at(parts, F.lit(-2))
    # The last name before the column is an alias, a table, or unknown and then taken as it is.
    of_alias = F.transform(F.filter("_tables", lambda t: t["alias"] == owner), lambda t: t["name"])
    names = F.transform("_tables", lambda t: t["name"])
    owners = F.when(owner.isNull(), names).when(F.size(of_alias) > 0, of_alias).otherwise(F.array(owner))
    uses = found.select("query_hash", "calls", "total_ms", F.explode(owners).alias("table_name"), F.element_at(parts, -1).alias("column_name")).distinct()
    return (uses.groupBy("table_name", "column_name")
            .agg(F.sum("calls").alias("uses"), F.sum("total_ms").alias("total_ms")).orderBy(F.desc("total_ms")))


def bloat_rank(tables: DataFrame, min_dead: int, min_percent: float) -> DataFrame:
    """Tables (table_name, live, dead, bloat_percent, days_since_clean) with dead share and clean-up priority."""
    live, dead = F.col("live"), F.col("dead")
    share = F.when(live > 0, F.round(dead * F.lit(100.0) / F.nullif(dead + live, F.lit(0)), 2)).otherwise(F.lit(0.0))
    wanted = tables.where((dead > min_dead) | ((live > 0) & (dead > live * min_percent / 100.0))).withColumn("dead_percent", share)
    # The weights 0.5, 0.3 and 0.2 and the limits 50 and 30.
    priority = (F.greatest(F.col("bloat_percent"), F.lit(0.0)) * 0.5 + F.least(F.col("dead_percent"), F.lit(50.0)) * 0.3
                + F.coalesce(F.least(F.col("days_since_clean"), F.lit(30)) * 0.2, F.lit(0.0)))
    return wanted.withColumn("priority", priority).orderBy(F.desc("priority"), "table_name")


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Mean, median, deviation and range of run times (benchmark, seconds)."""
    base = runs.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("mean"), F.stddev_samp("seconds").alias("stddev"),
        F.min("seconds").alias("min"), F.max("seconds").alias("max"))
    return match(base, percentiles(runs, ["benchmark"], "seconds", {"median": 0.5}), ["benchmark"])


def benchmark_compare(baseline: DataFrame, current: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Change of the mean time and of the rate in percent; a mean more than ``threshold`` slower is a regression."""
    a = benchmark_summary(baseline).select("benchmark", F.col("mean").alias("baseline_mean"))
    b = benchmark_summary(current)
    slower = (F.col("mean") - F.col("baseline_mean")) / F.nullif(F.col("baseline_mean"), F.lit(0.0)) * 100
    rate = (1 / F.col("mean") - 1 / F.col("baseline_mean")) / (1 / F.col("baseline_mean")) * 100
    return match(b, a, ["benchmark"]).withColumn("time_change", slower).withColumn("qps_change", rate).withColumn(
        "status", F.when(F.col("time_change") > threshold, "REGRESSION").otherwise("PASS"))


def benchmark_hint(elapsed_ms: Column) -> tuple[Column, Column]:
    """What to do about a run time, and whether the work should be split."""
    advice = (F.when(elapsed_ms < 100, "good").when(elapsed_ms < 1000, "consider optimizing")
              .otherwise("rewrite or materialize"))
    return advice, F.when(elapsed_ms > 1000, "split the data").otherwise("no split needed")


def state_counts(sessions: DataFrame) -> DataFrame:
    """Sessions, mean and longest duration per state."""
    return sessions.groupBy("state").agg(
        F.count(F.lit(1)).alias("sessions"), (F.sum("duration_ms") / F.count(F.lit(1))).alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"))
