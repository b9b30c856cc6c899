"""Load, upsert and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakewright.operators import etl, quality, stats
from lakewright.operators.quality import Check
from lakewright.plans.registry import plan
from lakewright.plans.workloads import K_SQL, SERVICE_SQL, k_of, ntz, service
from lakewright.sources.tables import scratch_path
from lakewright.sources.versioned import VersionedTable, insert_ignore

C = F.col

# --- registries

JOBS_SQL = "SELECT 'load_' || source AS job, 'file' AS source_type, count(*) AS rows_known, false AS is_incremental FROM documents GROUP BY source"


def jobs(t):
    """One load job per document source."""
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("rows_known")).select(
        F.concat(F.lit("load_"), "source").alias("job"), F.lit("file").alias("source_type"), "rows_known",
        F.lit(False).alias("is_incremental"))


@plan("etl_register_job", """SELECT 'load_' || source AS job, CASE WHEN n > 0 THEN 'database' ELSE 'file' END AS source_type, rows_known, n > 0 AS is_incremental
FROM (SELECT source, count(*) AS rows_known, count(*) FILTER (n_chars > 60000) AS n FROM documents GROUP BY 1)""")
def etl_register_job(t):
    large = t.documents.where("n_chars > 60000").select(F.concat(F.lit("load_"), "source").alias("job")).distinct()
    known = jobs(t)
    changed = known.join(large, "job").withColumn("source_type", F.lit("database")).withColumn("is_incremental", F.lit(True))
    return etl.register(known, changed, ["job"])


@plan("etl_add_mapping", """SELECT 'load_' || source AS job, 'text_' || lang AS target, CASE WHEN max(n_chars) > 20000 THEN 'text' ELSE 'varchar(20000)' END AS type,
  count(*) AS rows_seen FROM documents GROUP BY source, lang""")
def etl_add_mapping(t):
    seen = t.documents.groupBy("source", "lang").agg(F.max("n_chars").alias("longest"), F.count(F.lit(1)).alias("rows_seen"))
    rows = seen.select(F.concat(F.lit("load_"), "source").alias("job"), F.concat(F.lit("text_"), "lang").alias("target"),
                       F.lit("varchar(20000)").alias("type"), "rows_seen", "longest")
    wider = rows.where("longest > 20000").withColumn("type", F.lit("text"))
    return etl.register(rows.drop("longest"), wider.drop("longest"), ["job", "target"])


# --- mapped loads

ORDER_MAPPINGS = (
    etl.Mapping("order_key", "bigint", "o_orderkey", nullable=False),
    etl.Mapping("status_code", "int", rule="CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END", default=9),
    etl.Mapping("total_amount", "double", "o_totalprice", nullable=False),
    etl.Mapping("net_amount", "double", rule="round(o_totalprice * 0.9, 3)"),
    etl.Mapping("priority", "int", rule="try_cast(substring(o_orderpriority, 1, 1) AS int)", nullable=False),
    etl.Mapping("order_date", "timestamp_ntz", "o_orderdate", nullable=False),
)
ORDER_MAPPED_SQL = """SELECT o_orderkey AS order_key, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 9 END::INT AS status_code,
  o_totalprice AS total_amount, round(o_totalprice * 0.9, 3) AS net_amount, left(o_orderpriority, 1)::INT AS priority, o_orderdate AS order_date FROM orders"""


@plan("etl_apply_mapping", ORDER_MAPPED_SQL)
def etl_apply_mapping(t):
    return etl.apply_mapping(t.orders, ORDER_MAPPINGS).where("NOT _rejected").drop("_rejected")


@plan("etl_create_target", ORDER_MAPPED_SQL)
def etl_create_target(t):
    path = scratch_path(t.spark, "target")
    etl.create_target(t.spark, ORDER_MAPPINGS, path)
    etl.load(t.orders, etl.Job("orders", ORDER_MAPPINGS), path)
    return etl.read_target(t.spark, path, ORDER_MAPPINGS)


EVENT_MAPPINGS = (
    etl.Mapping("event_key", "bigint", "event_id", nullable=False),
    etl.Mapping("kind", "string", rule="nullif(event_type, 'error')", nullable=False),
    etl.Mapping("amount", "decimal(18,2)", "value"),
    etl.Mapping("loaded_from", "timestamp_ntz", "ts"),
)


@plan("etl_batch_load", """SELECT count(*) AS rows_processed, count(*) FILTER (event_type <> 'error') AS rows_loaded,
  count(*) FILTER (event_type = 'error') AS rows_rejected, max(ts) AS last_value FROM events""")
def etl_batch_load(t):
    job = etl.Job("events", EVENT_MAPPINGS, incremental_column="ts")
    run = etl.load(t.events, job, scratch_path(t.spark, "target"))
    return t.spark.createDataFrame([(run.rows_processed, run.rows_loaded, run.rows_rejected, run.last_value)],
                                   "rows_processed long, rows_loaded long, rows_rejected long, last_value timestamp_ntz")


@plan("etl_incremental", "SELECT event_id AS event_key, event_type AS kind, value AS amount, ts AS loaded_from FROM events WHERE event_type <> 'error'")
def etl_incremental(t):
    job = etl.Job("events", EVENT_MAPPINGS, incremental_column="ts")
    path = scratch_path(t.spark, "target")
    first = etl.load(t.events.where(C("ts") < ntz("2024-01-16")), job, path)
    etl.load(t.events, job, path, last_value=first.last_value)
    return etl.read_target(t.spark, path, EVENT_MAPPINGS).withColumn("amount", C("amount").cast("double"))


@plan("etl_run_job", ORDER_MAPPED_SQL)
def etl_run_job(t):
    job = etl.Job("orders", ORDER_MAPPINGS, source_type="file", options={"format": "parquet", "path": t.path("orders")})
    path = scratch_path(t.spark, "target")
    etl.run_job(t.spark, job, path)
    return etl.read_target(t.spark, path, ORDER_MAPPINGS)


@plan("etl_copy_1to1", "SELECT * FROM orders")
def etl_copy_1to1(t):
    path = scratch_path(t.spark, "copy")
    t.orders.write.parquet(path)
    return t.spark.read.parquet(path)


# --- star-schema steps

DIM_SQL = "SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance FROM customer"


def dim_customers(t):
    return t.customer.select(C("c_custkey").alias("customer_id"), C("c_name").alias("name"),
                             C("c_mktsegment").alias("segment"), C("c_acctbal").alias("balance"))


STAGED_SQL = """SELECT user_id + 100 AS customer_id, 'Staged#' || user_id AS name, 'STAGED' AS segment, round(sum(value), 2) AS balance FROM events GROUP BY user_id
  UNION ALL SELECT s_suppkey + 1000000000, s_name, 'SUPPLIER', s_acctbal FROM supplier"""


def staged_customers(t):
    """Known customers with new values (from events) and new ones (from suppliers)."""
    active = t.events.groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("balance")).select(
        (C("user_id") + 100).alias("customer_id"), F.concat(F.lit("Staged#"), C("user_id").cast("string")).alias("name"),
        F.lit("STAGED").alias("segment"), "balance")
    return active.unionByName(t.supplier.select(
        (C("s_suppkey") + 1000000000).alias("customer_id"), C("s_name").alias("name"), F.lit("SUPPLIER").alias("segment"),
        C("s_acctbal").alias("balance")))


@plan("etl_upsert", f"""WITH d AS ({DIM_SQL}), s AS ({STAGED_SQL})
SELECT * FROM d WHERE customer_id NOT IN (SELECT customer_id FROM s) UNION ALL SELECT * FROM s""")
def etl_upsert(t):
    table = VersionedTable.create(t.spark, scratch_path(t.spark, "dim_customers"))
    table.replace(dim_customers(t))
    table.upsert(staged_customers(t), ["customer_id"])
    return table.read()


@plan("etl_insert_ignore", f"""WITH d AS ({DIM_SQL}), s AS ({STAGED_SQL})
SELECT * FROM d UNION ALL SELECT * FROM s WHERE customer_id NOT IN (SELECT customer_id FROM d)""")
def etl_insert_ignore(t):
    return insert_ignore(dim_customers(t), staged_customers(t), ["customer_id"])


SALES_SQL = """SELECT o_orderkey AS sale_id, o_orderdate AS sale_date, o_custkey AS customer_id, o_orderkey % 2000 AS product_id, 2 AS quantity, o_totalprice AS total_price FROM orders"""


def staged_sales(t):
    return t.orders.select(
        C("o_orderkey").alias("sale_id"), C("o_orderdate").alias("sale_date"), C("o_custkey").alias("customer_id"),
        (C("o_orderkey") % 2000).alias("product_id"), F.lit(2).alias("quantity"), C("o_totalprice").alias("total_price"))


@plan("etl_insert_new_facts", f"SELECT * FROM ({SALES_SQL})")
def etl_insert_new_facts(t):
    # The facts loaded so far are the finished orders; the step adds the rest.
    loaded = staged_sales(t).join(t.orders.where("o_orderstatus = 'F'"), C("sale_id") == C("o_orderkey"), "left_semi")
    return insert_ignore(loaded, staged_sales(t), ["sale_id"])


PROFIT_SQL = f"""SELECT sale_id, product_id, quantity, total_price, CASE WHEN total_price > 400000 THEN 0 ELSE round(total_price - p_retailprice * 0.6 * quantity, 3) END AS profit
FROM ({SALES_SQL}) LEFT JOIN part ON p_partkey = product_id"""


@plan("etl_derive_profit", PROFIT_SQL)
def etl_derive_profit(t):
    known = F.when(C("total_price") > 400000, F.lit(0.0))
    rows = staged_sales(t).select("sale_id", "product_id", "quantity", "total_price").withColumn("profit", known)
    products = t.part.select(C("p_partkey").alias("product_id"), (C("p_retailprice") * 0.6).alias("cost"))
    return etl.derive_profit(rows, products).select("sale_id", "product_id", "quantity", "total_price",
                                                    F.round("profit", 3).alias("profit"))


CUSTOMER_DIM_SQL = """SELECT c_custkey AS customer_id, coalesce(least(TIMESTAMP '1997-01-01', f), TIMESTAMP '1997-01-01') AS first_purchase_date,
  coalesce(greatest(TIMESTAMP '1997-01-01', l), TIMESTAMP '1997-01-01') AS last_purchase_date, round(coalesce(s, 0), 2) AS total_purchases
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS f, max(o_orderdate) AS l, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


def blank_customers(t):
    return t.customer.select(C("c_custkey").alias("customer_id"), ntz("1997-01-01").alias("first_purchase_date"),
                             ntz("1997-01-01").alias("last_purchase_date"), F.lit(0.0).alias("total_purchases"))


@plan("etl_update_customer_dim", CUSTOMER_DIM_SQL)
def etl_update_customer_dim(t):
    return etl.update_customers(blank_customers(t), staged_sales(t)).withColumn(
        "total_purchases", F.round("total_purchases", 2))


@plan("etl_full_run", CUSTOMER_DIM_SQL)
def etl_full_run(t):
    base = scratch_path(t.spark, "warehouse")
    customers, products, facts = (VersionedTable.create(t.spark, f"{base}/{n}") for n in ("customers", "products", "sales"))
    cost = t.part.select(C("p_partkey").alias("product_id"), (C("p_retailprice") * 0.6).alias("cost"))

    def load_sales():
        facts.replace(etl.derive_profit(staged_sales(t).withColumn("profit", F.lit(None).cast("double")), products.read()))
        customers.replace(etl.update_customers(customers.read(), facts.read()))

    etl.run_steps(t.spark, {"load_customers": lambda: customers.replace(blank_customers(t)),
                            "load_products": lambda: products.replace(cost), "load_sales": load_sales})
    return customers.read().withColumn("total_purchases", F.round("total_purchases", 2))


@plan("etl_star_customer", "SELECT c_custkey AS customer_key, c_name AS customer_number, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'N/A') AS phone_number FROM customer")
def etl_star_customer(t):
    return t.customer.select(C("c_custkey").alias("customer_key"), C("c_name").alias("customer_number"),
                             F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("N/A")).alias("phone_number"))


@plan("etl_star_orders", """SELECT o_orderkey AS order_key, c_name AS customer_number, o_orderdate AS order_date, o_totalprice AS total_amount,
  round(o_totalprice - d, 4) AS net_amount FROM orders JOIN customer ON o_custkey = c_custkey
JOIN (SELECT l_orderkey, round(sum(l_extendedprice * l_discount), 4) AS d FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def etl_star_orders(t):
    off = t.lineitem.groupBy("l_orderkey").agg(F.round(F.sum(C("l_extendedprice") * C("l_discount")), 4).alias("d"))
    return (t.orders.join(t.customer, C("o_custkey") == C("c_custkey")).join(off, C("l_orderkey") == C("o_orderkey"))
            .select(C("o_orderkey").alias("order_key"), C("c_name").alias("customer_number"), C("o_orderdate").alias("order_date"),
                    C("o_totalprice").alias("total_amount"), F.round(C("o_totalprice") - C("d"), 4).alias("net_amount")))


@plan("etl_star_items", """SELECT l_orderkey AS order_id, l_linenumber, l_partkey AS product_id, c_name AS customer_number, l_quantity AS quantity,
  l_extendedprice AS total_price, l_tax * (l_extendedprice / o_totalprice) AS item_tax_amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def etl_star_items(t):
    return (t.lineitem.join(t.orders, C("l_orderkey") == C("o_orderkey")).join(t.customer, C("o_custkey") == C("c_custkey"))
            .select(C("l_orderkey").alias("order_id"), "l_linenumber", C("l_partkey").alias("product_id"),
                    C("c_name").alias("customer_number"), C("l_quantity").alias("quantity"),
                    C("l_extendedprice").alias("total_price"),
                    (C("l_tax") * (C("l_extendedprice") / C("o_totalprice"))).alias("item_tax_amount")))


@plan("etl_daily_import", """SELECT 'order' AS source, o_orderkey AS id, o_totalprice AS amount FROM orders WHERE o_orderdate = TIMESTAMP '1998-10-03'
UNION ALL SELECT 'line', l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate = TIMESTAMP '1998-10-03'""")
def etl_daily_import(t):
    day = ntz("1998-10-03")
    a = t.orders.where(C("o_orderdate") == day).select(F.lit("order").alias("source"), C("o_orderkey").alias("id"), C("o_totalprice").alias("amount"))
    b = t.lineitem.where(C("l_shipdate") == day).select(F.lit("line").alias("source"), C("l_orderkey").alias("id"), C("l_extendedprice").alias("amount"))
    return a.unionByName(b)


# --- stored-table changes

@plan("dml_insert", f"WITH d AS ({DIM_SQL}), s AS ({STAGED_SQL}) SELECT * FROM d UNION ALL SELECT * FROM s WHERE segment = 'SUPPLIER'")
def dml_insert(t):
    table = VersionedTable.create(t.spark, scratch_path(t.spark, "dml"))
    table.replace(dim_customers(t))
    table.insert(staged_customers(t).where("segment = 'SUPPLIER'"))
    return table.read()


@plan("dml_update", f"SELECT customer_id, name, CASE WHEN balance < 0 THEN 'DEBTOR' ELSE segment END AS segment, CASE WHEN balance < 0 THEN 0 ELSE balance END AS balance FROM ({DIM_SQL})")
def dml_update(t):
    table = VersionedTable.create(t.spark, scratch_path(t.spark, "dml"))
    table.replace(dim_customers(t))
    table.update(C("balance") < 0, {"segment": F.lit("DEBTOR"), "balance": F.lit(0.0)})
    return table.read()


@plan("dml_delete", f"SELECT * FROM ({DIM_SQL}) WHERE balance >= 0")
def dml_delete(t):
    table = VersionedTable.create(t.spark, scratch_path(t.spark, "dml"))
    table.replace(dim_customers(t))
    table.delete(C("balance") < 0)
    return table.read()


@plan("dml_truncate", "SELECT count(*) AS removed, 0::BIGINT AS remaining FROM customer")
def dml_truncate(t):
    table = VersionedTable.create(t.spark, scratch_path(t.spark, "dml"))
    table.replace(dim_customers(t))
    removed = table.truncate()
    return table.read().agg(F.lit(removed).cast("long").alias("removed"), F.count(F.lit(1)).alias("remaining"))


# --- data quality

def checks(t):
    return [
        Check("segment_set", "null", ("segment",), threshold=30.0, severity="WARNING", mode="ratio"),
        Check("name_unique", "unique", ("name",)),
        Check("balance_range", "range", ("balance",), low=-900.0, high=9000.0),
        Check("name_format", "regex", ("name",), pattern=r"^(Customer|Supplier)#\d{9}$"),
        Check("known_nation", "referential", ("nation",), reference=t.nation, reference_column="n_nationkey"),
        Check("rich_seller", "custom", predicate="balance > 9990 AND segment IS NULL"),
    ]


def checked_rows(t):
    """Customers and suppliers as one account table; suppliers have no segment."""
    return (t.customer.select(C("c_name").alias("name"), C("c_mktsegment").alias("segment"), C("c_acctbal").alias("balance"), C("c_nationkey").alias("nation"))
            .unionByName(t.supplier.select(C("s_name").alias("name"), F.lit(None).cast("string").alias("segment"),
                                           C("s_acctbal").alias("balance"), C("s_nationkey").alias("nation"))))


ACCOUNTS_SQL = """accounts AS (SELECT c_name AS name, c_mktsegment AS segment, c_acctbal AS balance, c_nationkey AS nation FROM customer
  UNION ALL SELECT s_name, NULL, s_acctbal, s_nationkey FROM supplier)"""
DQ_SQL = {
    "segment_set": ("null", "WARNING", 30.0, "count(*) FILTER (segment IS NULL) * 100.0::DOUBLE / count(*) FROM accounts"),
    "name_unique": ("unique", "ERROR", 0.0, "count(*)::DOUBLE FROM (SELECT name FROM accounts GROUP BY 1 HAVING count(*) > 1)"),
    "balance_range": ("range", "ERROR", 0.0, "count(*)::DOUBLE FROM accounts WHERE balance NOT BETWEEN -900 AND 9000"),
    "name_format": ("regex", "ERROR", 0.0, r"count(*)::DOUBLE FROM accounts WHERE NOT regexp_matches(name, '^(Customer|Supplier)#\d{9}$')"),
    "known_nation": ("referential", "ERROR", 0.0, "count(*)::DOUBLE FROM accounts WHERE nation NOT IN (SELECT n_nationkey FROM nation)"),
    "rich_seller": ("custom", "ERROR", 0.0, "count(*)::DOUBLE FROM accounts WHERE balance > 9990 AND segment IS NULL"),
}


def dq_sql(*names):
    parts = [f"SELECT '{n}' AS check_name, '{DQ_SQL[n][0]}' AS kind, '{DQ_SQL[n][1]}' AS severity, {DQ_SQL[n][2]}::DOUBLE AS threshold, "
             f"(SELECT {DQ_SQL[n][3]}) AS value_checked" for n in names]
    return f"WITH {ACCOUNTS_SQL}, r AS ({' UNION ALL '.join(parts)}) SELECT *, value_checked <= threshold AS passed FROM r"


plan("dq_run", dq_sql(*DQ_SQL))(lambda t: quality.run_checks(checked_rows(t), checks(t)).drop("error"))


def one_check(name):
    return lambda t: quality.run_checks(checked_rows(t), [c for c in checks(t) if c.name == name]).drop("error")


for _key, _name in (("dq_null", "segment_set"), ("dq_unique", "name_unique"), ("dq_range", "balance_range"),
                    ("dq_regex", "name_format"), ("dq_referential", "known_nation"), ("dq_custom", "rich_seller")):
    plan(_key, dq_sql(_name))(one_check(_name))


@plan("dq_add_check", f"""SELECT 'dup_' || source AS check_name, CASE WHEN d > 0 THEN 'WARNING' ELSE 'ERROR' END AS severity, 0.0::DOUBLE AS threshold, n AS rows_known
FROM (SELECT source, count(*) AS n, count(*) - count(DISTINCT text) AS d FROM documents GROUP BY 1)""")
def dq_add_check(t):
    known = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("rows_known"),
                                              (F.count(F.lit(1)) - F.countDistinct("text")).alias("d")).select(
        F.concat(F.lit("dup_"), "source").alias("check_name"), F.lit("ERROR").alias("severity"),
        F.lit(0.0).alias("threshold"), "rows_known", "d")
    softer = known.where("d > 0").withColumn("severity", F.lit("WARNING"))
    return etl.register(known.drop("d"), softer.drop("d"), ["check_name"])


@plan("dq_error_sample", """SELECT 'balance_range' AS check_name, least(count(*), 10) AS sampled, true AS all_bad FROM (SELECT c_acctbal AS b FROM customer UNION ALL SELECT s_acctbal FROM supplier) WHERE b NOT BETWEEN -900 AND 9000""")
def dq_error_sample(t):
    check = next(c for c in checks(t) if c.name == "balance_range")
    sample = quality.error_sample(checked_rows(t), check)
    balance = F.get_json_object("record", "$.balance").cast("double")
    return sample.groupBy("check_name").agg(F.count(F.lit(1)).alias("sampled"),
                                            F.every(~balance.between(-900, 9000)).alias("all_bad"))


@plan("dq_consistency", """SELECT 'orders' AS source, count(*) AS records FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'orders_with_lines', count(DISTINCT l_orderkey) FROM lineitem""")
def dq_consistency(t):
    return quality.source_counts({"orders": t.orders, "lineitem": t.lineitem,
                                  "orders_with_lines": t.lineitem.select("l_orderkey").distinct()})


@plan("dq_etl_checks", """SELECT 'missing_text' AS check_name, count(*) FILTER (text IS NULL OR trim(text) = '') AS issues FROM documents
UNION ALL SELECT 'invalid_amount', count(*) FILTER (o_totalprice <= 0) FROM orders
UNION ALL SELECT 'duplicate_text', count(*) - count(DISTINCT text) FROM documents""")
def dq_etl_checks(t):
    missing = t.documents.agg(F.count_if(C("text").isNull() | (F.trim("text") == "")).alias("issues"))
    invalid = t.orders.agg(F.count_if(C("o_totalprice") <= 0).alias("issues"))
    repeated = t.documents.agg((F.count("text") - F.countDistinct("text")).alias("issues"))
    rows = [df.select(F.lit(n).alias("check_name"), "issues") for n, df in (
        ("missing_text", missing), ("invalid_amount", invalid), ("duplicate_text", repeated))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@plan("dq_report", """SELECT 'part' AS table_name, '{"p_type":{"distinct_count":"' || count(DISTINCT p_type) || '","max_value":"' || max(p_type) || '","min_value":"' || min(p_type) || '","null_count":"' || count(*) FILTER (p_type IS NULL) || '"},"p_size":{"distinct_count":"' || count(DISTINCT p_size) || '","max_value":"' || max(p_size) || '","min_value":"' || min(p_size) || '","null_count":"' || count(*) FILTER (p_size IS NULL) || '"}}' AS report FROM part""")
def dq_report(t):
    facts = stats.profile(t.part, ["p_type", "p_size"])
    per = facts.groupBy("column_name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))
    entries = F.sort_array(F.collect_list(F.struct("column_name", F.map_entries("m").alias("m"))), asc=False)
    back = F.transform(entries, lambda e: F.struct(e["column_name"].alias("k"), F.map_from_entries(e["m"]).alias("v")))
    return per.agg(F.to_json(F.map_from_entries(back)).alias("report")).select(F.lit("part").alias("table_name"), "report")


# --- run history

RUNS_SQL = f"""runs AS (SELECT {SERVICE_SQL} AS job, event_id AS run_id, ts AS start_time, ts + to_microseconds((round(value * 100)::BIGINT * 10000)) AS end_time,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'SUCCESS' ELSE 'success' END AS status, {K_SQL} + 1 AS rows_processed, {K_SQL} // 10 AS rows_rejected FROM events)"""


def runs(t):
    """Job runs from the event stream: value is the run time in seconds, an error a failed run."""
    return t.events.select(
        service().alias("job"), C("event_id").alias("run_id"), C("ts").alias("start_time"),
        (C("ts") + F.make_dt_interval(secs=C("value").cast("decimal(18,6)"))).alias("end_time"),
        F.when(C("event_type") == "error", "failed").when(C("event_type") == "click", "SUCCESS").otherwise("success").alias("status"),
        (k_of() + 1).alias("rows_processed"), F.floor(k_of() / 10).alias("rows_rejected"))


@plan("etl_active_jobs", f"""WITH {RUNS_SQL} SELECT job, count(*) AS total_runs, max(start_time) AS last_run,
  count(DISTINCT status) AS column_count, count(DISTINCT rows_rejected) AS quality_checks FROM runs GROUP BY 1""")
def etl_active_jobs(t):
    r = runs(t)
    mappings = r.select("job", C("status").alias("target"))
    rules = r.select("job", C("rows_rejected").alias("check_name"))
    return etl.active_jobs(r.select("job").distinct(), r, mappings, rules)


@plan("etl_job_statistics", f"""WITH {RUNS_SQL}, s AS (SELECT *, (epoch_us(end_time) - epoch_us(start_time)) / 1000000.0::DOUBLE AS secs FROM runs)
SELECT job, count(*) AS total_runs, round(sum(secs), 2) / count(*) AS avg_runtime_seconds, max(secs) AS max_runtime_seconds, min(secs) AS min_runtime_seconds,
  sum(rows_processed)::BIGINT AS total_rows_processed, sum(rows_rejected)::BIGINT AS total_rows_rejected,
  sum(rows_rejected) * 100.0::DOUBLE / nullif(sum(rows_processed), 0) AS rejection_rate_percent,
  count(*) FILTER (upper(status) = 'SUCCESS') AS successful_runs, count(*) FILTER (upper(status) = 'FAILED') AS failed_runs,
  count(*) FILTER (upper(status) = 'SUCCESS') * 100.0::DOUBLE / count(*) AS success_rate_percent FROM s GROUP BY 1""")
def etl_job_statistics(t):
    r = runs(t)
    out = etl.job_statistics(r.select("job").distinct(), r)
    return out.withColumn("avg_runtime_seconds", F.round(C("avg_runtime_seconds") * C("total_runs"), 2) / C("total_runs"))


@plan("etl_last_run", f"""WITH {RUNS_SQL} SELECT job, run_id, start_time, end_time, status, rows_processed, rows_rejected, 2::BIGINT AS checks,
  1 + (rows_rejected <= 5)::BIGINT AS passed_checks, '[{{"check_name":"loaded","passed":true}},{{"check_name":"rejected","passed":' || (rows_rejected <= 5)::VARCHAR || '}}]' AS check_results
FROM runs QUALIFY row_number() OVER (PARTITION BY job ORDER BY start_time DESC, run_id DESC) = 1""")
def etl_last_run(t):
    r = runs(t)
    results = r.select("run_id", F.explode(F.array(
        F.struct(F.lit("loaded").alias("check_name"), (C("rows_processed") > 0).alias("passed")),
        F.struct(F.lit("rejected").alias("check_name"), (C("rows_rejected") <= 5).alias("passed")))).alias("c")).select("run_id", "c.*")
    return etl.last_runs(r, results)
