"""Projection, filter, conditional, date, string, math and JSON queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.functions import compat, dates, jsons, numbers, strings, validators
from lakewright.plans.registry import plan
from lakewright.plans.workloads import K_SQL, k_of, ntz

C = F.col


def text(x):
    return x.cast("string")


def day(x):
    return F.date_format(x, "yyyy-MM-dd")


# --- projection, filter, predicate, conditional

@plan("proj_expr", """SELECT o_orderkey, round(o_totalprice - o_totalprice * 0.1, 3) AS net_amount,
  round(o_totalprice * 0.08, 4) AS tax_share FROM orders""")
def proj_expr(t):
    return t.orders.select("o_orderkey", F.round(C("o_totalprice") - C("o_totalprice") * 0.1, 3).alias("net_amount"),
                           F.round(C("o_totalprice") * 0.08, 4).alias("tax_share"))


@plan("filter_point", "SELECT * FROM customer WHERE c_custkey = 77")
def filter_point(t):
    return t.customer.where(C("c_custkey") == 77)


@plan("filter_or", """SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_custkey = 12 OR o_orderkey = 345
ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""")
def filter_or(t):
    return (t.orders.where((C("o_custkey") == 12) | (C("o_orderkey") == 345))
            .select("o_orderkey", "o_custkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(10))


@plan("filter_in", "SELECT p_partkey, p_type FROM part WHERE p_type IN ('ECONOMY', 'PROMO') AND p_size IN (1, 5, 15)")
def filter_in(t):
    return t.part.where(C("p_type").isin("ECONOMY", "PROMO") & C("p_size").isin(1, 5, 15)).select("p_partkey", "p_type")


@plan("filter_between", """SELECT o_orderkey, o_orderdate FROM orders
WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-01-01' + INTERVAL 3 MONTH""")
def filter_between(t):
    start = ntz("1997-01-01")
    return (t.orders.where(C("o_orderdate").between(start, start + F.expr("INTERVAL 3 MONTHS")))
            .select("o_orderkey", "o_orderdate"))


@plan("filter_like", """SELECT p_partkey, p_name FROM part
WHERE p_name LIKE '%ring' AND p_name ILIKE '%E%' AND p_name NOT LIKE 'blue%'""")
def filter_like(t):
    n = C("p_name")
    return t.part.where(n.like("%ring") & n.ilike("%E%") & ~n.like("blue%")).select("p_partkey", "p_name")


@plan("filter_regex", """SELECT p_partkey, p_brand FROM part
WHERE regexp_matches(p_brand, '#[12][0-9]$') AND NOT regexp_matches(p_name, '^(?i)RED')""")
def filter_regex(t):
    return t.part.where(C("p_brand").rlike("#[12][0-9]$") & ~C("p_name").rlike("^(?i)RED")).select("p_partkey", "p_brand")


@plan("filter_isnull", """SELECT count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v IS NOT NULL) AS present
FROM (SELECT nullif(event_type, 'error') AS v FROM events)""")
def filter_isnull(t):
    v = t.events.select(F.nullif("event_type", F.lit("error")).alias("v"))
    return v.agg(F.count_if(C("v").isNull()).alias("missing"), F.count_if(C("v").isNotNull()).alias("present"))


@plan("case_when", """SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium'
  ELSE 'small' END AS size_class FROM orders""")
def case_when(t):
    p = C("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p > 300000, "large").when(p > 100000, "medium")
                           .otherwise("small").alias("size_class"))


def optional_filter(df, **wanted):
    """Equality filters for the arguments that are given."""
    for column, value in wanted.items():
        if value is not None:
            df = df.where(C(column) == value)
    return df


@plan("optional_filter", "SELECT event_id FROM events WHERE event_type = 'click'")
def optional_filter_q(t):
    return optional_filter(t.events, event_type="click", user_id=None).select("event_id")


def dynamic_where(df, predicate: str | None):
    """Filter by a predicate given as text."""
    return df.where(F.expr(predicate)) if predicate else df


@plan("dynamic_where", "SELECT o_orderkey FROM orders WHERE o_totalprice > 450000 AND o_orderstatus <> 'P'")
def dynamic_where_q(t):
    return dynamic_where(t.orders, "o_totalprice > 450000 AND o_orderstatus <> 'P'").select("o_orderkey")


@plan("array_any_match", """SELECT p_partkey FROM part
WHERE len(list_filter(string_split(p_name, ' '), lambda x: x ILIKE '%bol%')) > 0""")
def array_any_match(t):
    return t.part.where(F.exists(F.split("p_name", " "), lambda w: w.ilike("%bol%"))).select("p_partkey")


@plan("compat_decode", """SELECT event_id, CASE WHEN nullif(event_type, 'error') IS NULL THEN 'none'
  WHEN event_type = 'click' THEN 'c' WHEN event_type = 'view' THEN 'v' ELSE 'other' END AS code FROM events""")
def compat_decode(t):
    kind = F.nullif("event_type", F.lit("error"))
    return t.events.select("event_id", compat.decode(
        kind, [(None, "none"), ("click", "c"), ("view", "v")], "other").alias("code"))


@plan("compat_nvl", "SELECT event_id, coalesce(nullif(event_type, 'error'), 'unknown') AS kind FROM events")
def compat_nvl(t):
    return t.events.select("event_id", compat.nvl(F.nullif("event_type", F.lit("error")), F.lit("unknown")).alias("kind"))


@plan("compat_nullifzero", "SELECT l_partkey, count(nullif(l_discount, 0)) AS discounted FROM lineitem GROUP BY 1")
def compat_nullifzero(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count(compat.nullifzero(C("l_discount"))).alias("discounted"))


@plan("compat_zeroifnull", f"SELECT event_id, coalesce(nullif({K_SQL}, 5), 0) AS k FROM events")
def compat_zeroifnull(t):
    return t.events.select("event_id", compat.zeroifnull(F.nullif(k_of(), F.lit(5))).alias("k"))


@plan("null_safe_div", f"SELECT event_id, value / nullif({K_SQL}, 0) AS ratio FROM events")
def null_safe_div(t):
    return t.events.select("event_id", compat.safe_div(C("value"), k_of().cast("double")).alias("ratio"))


@plan("compat_isnull", "SELECT event_id, nullif(event_type, 'error') IS NULL AS is_missing FROM events")
def compat_isnull(t):
    return t.events.select("event_id", F.nullif("event_type", F.lit("error")).isNull().alias("is_missing"))


@plan("compat_top", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def compat_top(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


# --- dates

@plan("dt_add_days", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 45 DAY, '%Y-%m-%d') AS due FROM orders")
def dt_add_days(t):
    return t.orders.select("o_orderkey", day(dates.add_days(F.to_date("o_orderdate"), 45)).alias("due"))


@plan("dt_add_months", """SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month,
  strftime(o_orderdate - INTERVAL 3 MONTH, '%Y-%m-%d') AS prior_quarter FROM orders""")
def dt_add_months(t):
    d = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", day(dates.add_months(d, 1)).alias("next_month"),
                           day(dates.add_months(d, -3)).alias("prior_quarter"))


@plan("dt_add_years", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 YEAR, '%Y-%m-%d') AS next_year FROM orders")
def dt_add_years(t):
    return t.orders.select("o_orderkey", day(dates.add_years(F.to_date("o_orderdate"), 1)).alias("next_year"))


LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"


def shipped(t):
    return t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey"))


@plan("dt_days_between", f"""SELECT date_diff('day', o_orderdate, l_shipdate)::INT AS days, (-date_diff('day', o_orderdate, l_shipdate))::INT AS helper_days,
  count(*) AS n FROM {LINES} GROUP BY 1, 2""")
def dt_days_between(t):
    o, s = F.to_date("o_orderdate"), F.to_date("l_shipdate")
    return (shipped(t).groupBy(dates.days_between(o, s).alias("days"), dates.diff_days(o, s).alias("helper_days"))
            .agg(F.count(F.lit(1)).alias("n")))


@plan("dt_seconds_between", """SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000.0::DOUBLE AS seconds FROM events""")
def dt_seconds_between(t):
    return t.events.select("event_id", dates.seconds_between(ntz("2024-01-01"), C("ts")).alias("seconds"))


@plan("dt_months_between", f"""SELECT l_orderkey, l_linenumber, l_partkey, round(12 * (year(l_shipdate) - year(o_orderdate)) + (month(l_shipdate) - month(o_orderdate))
  + (day(l_shipdate) - day(o_orderdate)) / 31.0::DOUBLE, 9) AS months FROM {LINES}""")
def dt_months_between(t):
    return shipped(t).select("l_orderkey", "l_linenumber", "l_partkey", F.round(
        dates.months_between(C("o_orderdate"), C("l_shipdate")), 9).alias("months"))


@plan("dt_diff_months", """SELECT o_orderkey, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 3)::INT AS months FROM orders""")
def dt_diff_months(t):
    return t.orders.select("o_orderkey", dates.diff_months(C("o_orderdate"), ntz("1995-03-15")).alias("months"))


@plan("dt_diff_years", "SELECT o_orderkey, (year(o_orderdate) - 1996)::INT AS years FROM orders")
def dt_diff_years(t):
    return t.orders.select("o_orderkey", dates.diff_years(C("o_orderdate"), ntz("1996-07-01")).alias("years"))


@plan("dt_difference_unit", """WITH d AS (SELECT event_id, TIMESTAMP '2023-12-30 12:30:45' AS a, ts AS b,
  epoch_us(ts) - epoch_us(TIMESTAMP '2023-12-30 12:30:45') AS us FROM events)
SELECT event_id, (year(b) - year(a))::BIGINT AS years, ((year(b) - year(a)) * 12 + month(b) - month(a))::BIGINT AS months,
  us // 86400000000 AS days, us // 3600000000 AS hours, us // 60000000 AS minutes,
  round(us / 1000000.0::DOUBLE)::BIGINT AS seconds FROM d""")
def dt_difference_unit(t):
    a = ntz("2023-12-30 12:30:45")
    return t.events.select("event_id", *[dates.date_difference(a, C("ts"), F.lit(u)).alias(u)
                                         for u in ("years", "months", "days", "hours", "minutes", "seconds")])


@plan("dt_extract", """SELECT event_id, year(ts)::INT AS y, quarter(ts)::INT AS q, month(ts)::INT AS m, week(ts)::INT AS w, dayofyear(ts)::INT AS doy,
  day(ts)::INT AS d, dayofweek(ts)::INT AS dow, hour(ts)::INT AS h, epoch_us(ts) / 1000000.0::DOUBLE AS epoch FROM events""")
def dt_extract(t):
    names = {"year": "y", "quarter": "q", "month": "m", "week": "w", "doy": "doy", "day": "d", "dow": "dow",
             "hour": "h", "epoch": "epoch"}
    return t.events.select("event_id", *[dates.extract(p, C("ts")).alias(a) for p, a in names.items()])


@plan("dt_trunc", """SELECT event_id, date_trunc('hour', ts) AS hour, date_trunc('day', ts)::TIMESTAMP AS day,
  date_trunc('week', ts)::TIMESTAMP AS week, date_trunc('month', ts)::TIMESTAMP AS month FROM events""")
def dt_trunc(t):
    return t.events.select("event_id", *[dates.trunc(u, C("ts")).alias(u) for u in ("hour", "day", "week", "month")])


@plan("dt_time_bucket", """SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1""")
def dt_time_bucket(t):
    return (t.events.groupBy(dates.time_bucket("6 hours", C("ts")).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")))


@plan("dt_age_months", """SELECT o_orderkey, ((year(e) - year(o)) * 12 + month(e) - month(o) - (day(e) < day(o))::INT)::INT AS total_months,
  (((year(e) - year(o)) * 12 + month(e) - month(o) - (day(e) < day(o))::INT) % 12)::INT AS month_part
FROM (SELECT o_orderkey, o_orderdate AS o, TIMESTAMP '2001-08-31' AS e FROM orders)""")
def dt_age_months(t):
    end = ntz("2001-08-31")
    return t.orders.select("o_orderkey", dates.age_months(end, C("o_orderdate")).alias("total_months"),
                           dates.age_month_part(end, C("o_orderdate")).alias("month_part"))


@plan("dt_to_char", """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS date_key, strftime(o_orderdate, '%A') AS day_name,
  strftime(o_orderdate, '%B') AS month_name, strftime(o_orderdate, 'y%Ym%m') AS partition_name FROM orders""")
def dt_to_char(t):
    d = C("o_orderdate")
    return t.orders.select("o_orderkey", dates.format_date(d, "YYYYMMDD").alias("date_key"),
                           F.date_format(d, "EEEE").alias("day_name"), F.date_format(d, "MMMM").alias("month_name"),
                           dates.format_date(d, "'y'YYYY'm'MM").alias("partition_name"))


@plan("dt_parse_multi", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE o_orderdate END AS parsed FROM orders""")
def dt_parse_multi(t):
    spelled = (F.when(C("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
               .when(C("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss"))
               .otherwise(F.date_format("o_orderdate", "yyyy/dd")))
    return t.orders.select("o_orderkey", dates.parse_timestamp(spelled).alias("parsed"))


@plan("dt_to_date_fmt", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderdate AS ts FROM orders""")
def dt_to_date_fmt(t):
    spelled = F.date_format("o_orderdate", "dd/MM/yyyy")
    stamped = F.date_format("o_orderdate", "yyyyMMdd HH:mm:ss")
    return t.orders.select("o_orderkey", text(dates.to_date(spelled, "DD/MM/YYYY")).alias("d"),
                           dates.to_timestamp(stamped, "YYYYMMDD HH24:MI:SS").cast("timestamp_ntz").alias("ts"))


@plan("dt_format", "SELECT event_id, strftime(ts, '%d.%m.%Y %H:%M') AS label FROM events")
def dt_format(t):
    return t.events.select("event_id", dates.format_date(C("ts"), "DD.MM.YYYY HH24:MI").alias("label"))


@plan("dt_now_today", """SELECT event_id, TIMESTAMP '2024-01-31' AS as_of, date_diff('day', ts, TIMESTAMP '2024-01-31')::INT AS age_days FROM events""")
def dt_now_today(t):
    as_of = ntz("2024-01-31")
    return t.events.select("event_id", as_of.alias("as_of"), F.datediff(as_of, "ts").alias("age_days"))


@plan("dt_batch_id", "SELECT event_id, epoch(date_trunc('day', ts))::BIGINT AS batch_id FROM events")
def dt_batch_id(t):
    return t.events.select("event_id", dates.batch_id(C("ts")).alias("batch_id"))


@plan("dim_date", """SELECT strftime(d, '%Y%m%d')::INT AS date_key, strftime(d, '%Y-%m-%d') AS date_actual, year(d)::INT AS year, quarter(d)::INT AS quarter,
  month(d)::INT AS month, week(d)::INT AS week, dayofyear(d)::INT AS day_of_year, day(d)::INT AS day_of_month, dayofweek(d)::INT AS day_of_week,
  strftime(d, '%A') AS weekday_name, strftime(d, '%B') AS month_name, dayofweek(d) IN (0, 6) AS is_weekend, false AS is_holiday
FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS d FROM orders)""")
def dim_date(t):
    return dates.calendar(t.orders, "o_orderdate").withColumn("date_actual", text(C("date_actual")))


# --- strings

@plan("str_edit_distance", "SELECT p_partkey, levenshtein(p_name, p_type)::INT AS distance FROM part")
def str_edit_distance(t):
    return t.part.select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"))


@plan("str_instr", """SELECT p_partkey, instr(p_name, 'e')::INT AS first_e,
  coalesce(list_filter(range(1, length(p_name) + 1), lambda i: substring(p_name, i, 1) = 'e')[2], 0)::INT AS second_e FROM part""")
def str_instr(t):
    return t.part.select("p_partkey", strings.instr(C("p_name"), F.lit("e")).alias("first_e"),
                         strings.instr(C("p_name"), F.lit("e"), 1, 2).alias("second_e"))


@plan("str_case", "SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low FROM part")
def str_case(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"))


@plan("str_substring", "SELECT c_custkey, substring(c_name, 10) AS tail, substring(c_name, 1, 4) AS head FROM customer")
def str_substring(t):
    n = C("c_name")
    return t.customer.select("c_custkey", F.substring(n, F.lit(10), F.length(n)).alias("tail"),
                             F.substring(n, 1, 4).alias("head"))


@plan("str_replace", "SELECT p_partkey, replace(p_brand, 'Brand#', 'B-') AS brand FROM part")
def str_replace(t):
    return t.part.select("p_partkey", F.replace("p_brand", F.lit("Brand#"), F.lit("B-")).alias("brand"))


@plan("str_trim", "SELECT p_partkey, p_name AS trimmed, p_name || ' ' AS left_only, ' ' || p_name AS right_only FROM part")
def str_trim(t):
    padded = F.concat(F.lit(" "), C("p_name"), F.lit(" "))
    return t.part.select("p_partkey", strings.trim_all(F.concat(F.lit("\t "), padded, F.lit("\n"))).alias("trimmed"),
                         F.ltrim(padded).alias("left_only"), F.rtrim(padded).alias("right_only"))


@plan("str_left_right", "SELECT c_custkey, left(c_name, 8) AS l, right(c_name, 4) AS r FROM customer")
def str_left_right(t):
    return t.customer.select("c_custkey", strings.left(C("c_name"), 8).alias("l"), strings.right(C("c_name"), 4).alias("r"))


@plan("str_length", "SELECT doc_id, length(text)::INT AS chars FROM documents")
def str_length(t):
    return t.documents.select("doc_id", F.char_length("text").alias("chars"))


@plan("str_regex_replace", r"SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS masked FROM documents")
def str_regex_replace(t):
    return t.documents.select("doc_id", F.md5(F.regexp_replace("text", "[0-9]+", "#")).alias("masked"))


@plan("str_regexp_substr", r"SELECT page_id, nullif(regexp_extract(url, '//[^/]+'), '') AS host FROM pages")
def str_regexp_substr(t):
    return t.pages.select("page_id", F.regexp_substr("url", F.lit("//[^/]+")).alias("host"))


@plan("str_split_part", "SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', 4) AS first_dir FROM pages")
def str_split_part(t):
    return t.pages.select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"),
                          F.split_part("url", F.lit("/"), F.lit(4)).alias("first_dir"))


@plan("str_lpad", "SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 10, '0') AS order_number FROM orders")
def str_lpad(t):
    return t.orders.select("o_orderkey", F.lpad(text(C("o_orderkey")), 10, "0").alias("order_number"))


@plan("str_format_case", """WITH w AS (SELECT p_partkey, p_name, string_split(p_name, ' ') AS ws FROM part)
SELECT p_partkey, upper(p_name) AS upper_text, array_to_string(list_transform(ws, lambda x: upper(x[1]) || lower(x[2:])), ' ') AS title_text,
  lower(replace(p_name, ' ', '_')) AS snake_text,
  lower(p_name[1]) || array_to_string(list_transform(ws, lambda x: upper(x[1]) || x[2:]), '')[2:] AS camel_text,
  array_to_string(list_transform(ws, lambda x: upper(x[1]) || x[2:]), '') AS pascal_text FROM w""")
def str_format_case(t):
    return t.part.select("p_partkey", *[strings.format_case(C("p_name"), s).alias(f"{s}_text")
                                        for s in ("upper", "title", "snake", "camel", "pascal")])


@plan("str_text_analysis", r"""WITH d AS (SELECT doc_id, length(text) AS char_count,
    list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}_\s\p{Z}]', '', 'g'), '[\s\p{Z}]+'), lambda x: x <> '') AS ws FROM documents),
f AS (SELECT doc_id, char_count, len(ws)::BIGINT AS word_count, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS letters FROM d),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d),
c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS pos FROM e GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS rk FROM c),
b AS (SELECT doc_id, string_agg(word || ':' || n, ',' ORDER BY rk) AS top_words FROM r WHERE rk <= 10 GROUP BY 1)
SELECT doc_id, word_count, char_count, CASE WHEN word_count = 0 THEN 0 ELSE ((letters * 200 + word_count) // (word_count * 2)) / 100.0::DOUBLE END AS avg_word_length,
  top_words FROM f LEFT JOIN b USING (doc_id)""")
def str_text_analysis(t):
    return strings.text_analysis(t.documents, "doc_id", "text")


TRIGRAM_SQL = """list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"""


@plan("str_trigram_similarity", f"""WITH g AS (SELECT p_partkey, {TRIGRAM_SQL.format("p_name")} AS a, {TRIGRAM_SQL.format("p_brand || ' ' || p_name")} AS b FROM part)
SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE AS similarity FROM g""")
def str_trigram_similarity(t):
    return t.part.select("p_partkey", strings.trigram_similarity(
        C("p_name"), F.concat_ws(" ", "p_brand", "p_name")).alias("similarity"))


@plan("hash_sha1", "SELECT doc_id, sha1(text) AS digest FROM documents")
def hash_sha1(t):
    return t.documents.select("doc_id", F.sha1("text").alias("digest"))


@plan("hash_md5", "SELECT doc_id, md5(text) AS digest FROM documents")
def hash_md5(t):
    return t.documents.select("doc_id", F.md5("text").alias("digest"))


@plan("to_number", """SELECT event_id, TRY_CAST(event_type AS DOUBLE) AS not_a_number, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events""")
def to_number(t):
    return t.events.select("event_id", strings.to_number(C("event_type")).alias("not_a_number"),
                           strings.to_number(jsons.get(C("props"), "k")).alias("k"))


@plan("to_char_any", "SELECT o_orderkey, o_orderkey::VARCHAR AS key_text, printf('%.2f', o_totalprice) AS price_text FROM orders")
def to_char_any(t):
    return t.orders.select("o_orderkey", text(C("o_orderkey")).alias("key_text"),
                           text(C("o_totalprice").cast("decimal(18,2)")).alias("price_text"))


@plan("cast_any", "SELECT o_orderkey, o_orderkey::INT AS as_int, o_orderkey::DOUBLE AS as_double, TRY_CAST(o_orderstatus AS INT) AS bad FROM orders")
def cast_any(t):
    return t.orders.select("o_orderkey", C("o_orderkey").cast("int").alias("as_int"),
                           C("o_orderkey").cast("double").alias("as_double"), C("o_orderstatus").try_cast("int").alias("bad"))


@plan("identifier_check", r"""SELECT doc_id, regexp_matches(source, '^[a-zA-Z_][a-zA-Z0-9_]*$') AND length(source) <= 63 AS name_ok,
  regexp_full_match(text, '[a-zA-Z0-9\s,()_]+') AND NOT regexp_matches(lower(text), '(drop|delete|update|insert|exec|execute|;|--|/\*|\*/|xp_|sp_)') AS text_ok FROM documents""")
def identifier_check(t):
    return t.documents.select("doc_id", validators.identifier_ok(C("source")).alias("name_ok"),
                              validators.column_text_ok(C("text")).alias("text_ok"))


@plan("rules_validate", r"""SELECT 'email' AS rule, count(*) AS checked,
  count(*) FILTER (NOT regexp_matches(lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || CASE WHEN c_nationkey % 5 = 0 THEN '' ELSE '.com' END,
    '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$')) AS violations FROM customer""")
def rules_validate(t):
    domain = F.concat(F.lower("c_mktsegment"), F.when(C("c_nationkey") % 5 == 0, "").otherwise(".com"))
    mail = F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@"), domain)
    return (validators.validate_columns(t.customer.select(mail.alias("email")), {"email": "email"})
            .select("rule", "checked", "violations"))


@plan("rules_column_set", r"""SELECT 'url' AS column_name, 'url' AS rule, count(*) AS checked,
  count(*) FILTER (NOT regexp_matches(url, '^https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(:[0-9]+)?(/.*)?$')) AS violations FROM pages
UNION ALL SELECT 'page_id', 'port', count(*), count(*) FILTER (NOT page_id BETWEEN 1 AND 65535) FROM pages
UNION ALL SELECT 'host', 'domain', count(*), count(*) FILTER (NOT regexp_matches(split_part(url, '/', 3),
  '^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*$') OR length(split_part(url, '/', 3)) > 253) FROM pages""")
def rules_column_set(t):
    pages = t.pages.select("page_id", "url", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    return validators.validate_columns(pages, {"url": "url", "page_id": "port", "host": "domain"})


# --- math

@plan("math_round", """SELECT o_orderkey, round(o_totalprice::DECIMAL(18,2), 1)::DOUBLE AS one,
  round(o_totalprice::DECIMAL(18,2))::DOUBLE AS whole,
  (round(o_orderkey / 100.0::DOUBLE) * 100)::DOUBLE AS hundreds FROM orders""")
def math_round(t):
    exact = C("o_totalprice").cast("decimal(18,2)")
    return t.orders.select("o_orderkey", numbers.round_half_away(exact, 1).cast("double").alias("one"),
                           numbers.round_half_away(exact, 0).cast("double").alias("whole"),
                           numbers.round_half_away(C("o_orderkey"), -2).cast("double").alias("hundreds"))


@plan("math_div", f"SELECT event_id, floor((value - 50) / 7)::BIGINT AS q, floor((event_id - 5000) / nullif({K_SQL} - 50, 0)::DOUBLE)::BIGINT AS p FROM events")
def math_div(t):
    return t.events.select("event_id", numbers.floor_div(C("value") - 50, F.lit(7.0)).alias("q"),
                           numbers.floor_div(C("event_id") - 5000, k_of() - 50, whole=True).alias("p"))


@plan("math_mod", f"""SELECT event_id, (event_id - 5000) - floor((event_id - 5000) / nullif({K_SQL} - 50, 0)::DOUBLE)::BIGINT * ({K_SQL} - 50) AS m FROM events""")
def math_mod(t):
    return t.events.select("event_id", numbers.floor_mod(C("event_id") - 5000, k_of() - 50).alias("m"))


@plan("math_basic", """SELECT c_custkey, floor(c_acctbal)::BIGINT AS f, ceil(c_acctbal)::BIGINT AS c, abs(c_acctbal) AS a,
  CASE WHEN c_acctbal >= 0 THEN sqrt(greatest(c_acctbal, 0)) END AS s FROM customer""")
def math_basic(t):
    b = C("c_acctbal")
    return t.customer.select("c_custkey", F.floor(b).alias("f"), F.ceil(b).alias("c"), F.abs(b).alias("a"),
                             numbers.safe_sqrt(b).alias("s"))


@plan("math_more", """SELECT c_custkey, trunc(c_acctbal) AS t, round(pow(c_acctbal / 1000, 2), 6) AS p,
  round(ln(abs(c_acctbal) + 1), 9) AS l, round(exp(c_acctbal / 10000), 9) AS e FROM customer""")
def math_more(t):
    b = C("c_acctbal")
    return t.customer.select("c_custkey", numbers.truncate(b).alias("t"), F.round(F.pow(b / 1000, F.lit(2.0)), 6).alias("p"),
                             F.round(F.ln(F.abs(b) + 1), 9).alias("l"), F.round(F.exp(b / 10000), 9).alias("e"))


@plan("arr_stats", """SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 9) AS mean, round(list_median(embedding::DOUBLE[]), 9) AS median,
  round(list_stddev_samp(embedding::DOUBLE[]), 9) AS stddev FROM embeddings""")
def arr_stats(t):
    a = C("embedding").cast("array<double>")
    return t.embeddings.select("vec_id", F.round(numbers.array_mean(a), 9).alias("mean"),
                               F.round(numbers.array_median(a), 9).alias("median"),
                               F.round(numbers.array_stddev(a), 9).alias("stddev"))


# --- arrays

@plan("arr_unnest", "SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS at, unnest(embedding)::DOUBLE AS x FROM embeddings")
def arr_unnest(t):
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("at", "x")).withColumn("x", C("x").cast("double"))


@plan("arr_agg_append_slice", """SELECT vec_id, len(list_append(embedding, 1.0::FLOAT))::INT AS longer,
  array_to_string(list_transform(embedding[1:3], lambda x: (round(x::DOUBLE * 1000))::BIGINT), '|') AS head FROM embeddings""")
def arr_agg_append_slice(t):
    head = F.transform(F.slice("embedding", 1, 3), lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string"))
    return t.embeddings.select("vec_id", F.size(F.array_append("embedding", F.lit(1.0).cast("float"))).alias("longer"),
                               F.array_join(head, "|").alias("head"))


@plan("arr_to_string", "SELECT p_partkey, array_to_string(string_split(p_name, ' '), '-') AS joined FROM part")
def arr_to_string(t):
    return t.part.select("p_partkey", F.array_join(F.split("p_name", " "), "-").alias("joined"))


# --- JSON

@plan("json_get", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_get(t):
    return t.events.select("event_id", jsons.get(C("props"), "k").alias("k"))


@plan("json_has_key", "SELECT event_id, json_exists(props, '$.k') AS has_k, json_exists(props, '$.z') AS has_z FROM events")
def json_has_key(t):
    return t.events.select("event_id", jsons.has_key(C("props"), "k").alias("has_k"),
                           jsons.has_key(C("props"), "z").alias("has_z"))


NESTED_SQL = """json_object('items', json_array(json_object('a', user_id), json_object('a', event_id)), 'type', event_type)"""


@plan("json_extract_path", f"""SELECT event_id, json_extract_string({NESTED_SQL}, '$.items[1].a') AS second, json_extract_string({NESTED_SQL}, '$.type') AS kind,
  NULL::VARCHAR AS absent FROM events""")
def json_extract_path(t):
    doc = F.to_json(F.struct(F.array(F.struct(C("user_id").alias("a")), F.struct(C("event_id").alias("a"))).alias("items"),
                             C("event_type").alias("type")))
    return t.events.select("event_id", jsons.extract_path(doc, "items[1].a").alias("second"),
                           jsons.extract_path(doc, "type").alias("kind"), jsons.extract_path(doc, "no.such").alias("absent"))


@plan("json_build", "SELECT event_id, json_merge_patch(props::JSON, json_object('user', user_id))::VARCHAR AS doc FROM events")
def json_build(t):
    extra = F.to_json(F.struct(C("user_id").alias("user")))
    return t.events.select("event_id", jsons.merge(C("props"), extra).alias("doc"))


@plan("json_parse_safe", """SELECT event_id, event_id % 2 = 0 AS parsed FROM events""")
def json_parse_safe(t):
    doc = F.when(C("event_id") % 2 == 0, C("props")).otherwise(F.concat(F.lit("{"), C("props")))
    return t.events.select("event_id", jsons.parse_safe(doc).isNotNull().alias("parsed"))


@plan("json_flatten", "SELECT event_id, json_extract_string(props, '$.k') AS props_k FROM events")
def json_flatten(t):
    return jsons.flatten(t.events, "props", "props_", ["k"]).select("event_id", "props_k")


@plan("json_validate_schema", "SELECT event_id, true AS ok, false AS bad_type FROM events")
def json_validate_schema(t):
    return t.events.select("event_id", jsons.matches_schema(C("props"), {"k": "integer"}).alias("ok"),
                           jsons.matches_schema(C("props"), {"k": "boolean"}).alias("bad_type"))


@plan("compat_ratio_to_report", """SELECT c_mktsegment, round(sum(c_acctbal), 2) / sum(round(sum(c_acctbal), 2)::DECIMAL(18,2)) OVER ()::DOUBLE AS share
FROM customer GROUP BY 1""")
def compat_ratio_to_report(t):
    per = t.customer.groupBy("c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).cast("decimal(18,2)").alias("v"))
    # The total is one row; a window without a key would be one task.
    whole = per.join(F.broadcast(per.agg(F.sum("v").cast("double").alias("total"))), F.lit(True))
    return whole.select("c_mktsegment", F.when(C("total") == 0, 0.0)
                        .otherwise(C("v").cast("double") / F.nullif(C("total"), F.lit(0.0))).alias("share"))
