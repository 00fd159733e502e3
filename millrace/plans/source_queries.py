"""Sources and scans (ids S). File formats the tables lack are first written from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import aggregates as agg
from millrace.plans.registry import QuerySet
from millrace.plans.sql_views import CUSTOMERS, EVENTS, LAST_EVENT, ORDERS
from millrace.sources import datasets as ds, generators as gen, readers
from millrace.sources.shared import shared_folder

Q = QuerySet()

_ORDER_SCHEMA = ("order_id BIGINT, customer_id BIGINT, order_date DATE, order_status STRING, "
                 "priority STRING, total_amount DECIMAL(12,2)")


def _orders_as_csv(spark, sf, *columns):
    path = shared_folder(spark, "orders-csv")
    o = ds.orders(spark, sf)
    (o.select(*columns) if columns else o).write.option("header", True).csv(path)
    return path


@Q.add("S1_csv_scan", "order_status str, row_count long, revenue dbl",
       f"""SELECT order_status, COUNT(*) AS row_count, SUM(total_amount) AS revenue
           FROM {ORDERS} AS o GROUP BY 1""")
def s1(spark, sf):
    rows = readers.read_csv(spark, _orders_as_csv(spark, sf), _ORDER_SCHEMA)
    return agg.revenue_by(rows, ["order_status"], count_name="row_count", total_name="revenue",
                          mean_name=None)


@Q.add("S2_multi_file_glob", "priority str, row_count long, revenue dbl",
       f"""SELECT priority, COUNT(*) AS row_count, SUM(total_amount) AS revenue
           FROM {ORDERS} AS o GROUP BY 1""")
def s2(spark, sf):
    base = shared_folder(spark, "orders-by-status")
    # One write lays out a folder per status, whatever values (or nulls) there are.
    ds.orders(spark, sf).withColumn("folder", F.col("order_status")).write.partitionBy("folder").option(
        "header", True).csv(base)
    rows = readers.read_csv(spark, f"{base}/folder=*", _ORDER_SCHEMA, pattern="*.csv")
    return agg.revenue_by(rows, ["priority"], count_name="row_count", total_name="revenue",
                          mean_name=None)


@Q.add("S3_union_by_name", "total_records long, with_status long, with_priority long, "
       "statuses long",
       f"""SELECT 2 * COUNT(*) AS total_records, COUNT(order_status) AS with_status,
           COUNT(priority) AS with_priority, COUNT(DISTINCT order_status) AS statuses
           FROM {ORDERS} AS o""")
def s3(spark, sf):
    left = readers.read_csv(spark, _orders_as_csv(spark, sf, "order_id", "order_status"),
                            "order_id BIGINT, order_status STRING")
    right = readers.read_csv(spark, _orders_as_csv(spark, sf, "priority", "order_id"),
                             "priority STRING, order_id BIGINT")
    return readers.union_by_name([left, right]).agg(
        F.count("*").alias("total_records"), F.count("order_status").alias("with_status"),
        F.count("priority").alias("with_priority"),
        F.countDistinct("order_status").alias("statuses"))


@Q.add("S3_union_by_header", "total_records long, with_status long, with_priority long, with_amount long, "
       "amount dbl, statuses long",
       f"""SELECT 3 * COUNT(*) AS total_records, 2 * COUNT(order_status) AS with_status,
           COUNT(priority) AS with_priority, COUNT(total_amount) AS with_amount, SUM(total_amount) AS amount,
           COUNT(DISTINCT order_status) AS statuses FROM {ORDERS} AS o""")
def s3_header(spark, sf):
    """One folder of files with three headers, their columns in other orders, read in one call."""
    base = shared_folder(spark, "orders-mixed")
    for i, columns in enumerate((["order_id", "order_status"], ["priority", "order_id"],
                                 ["total_amount", "order_status", "order_id"])):
        ds.orders(spark, sf).select(*columns).write.option("header", True).csv(f"{base}/{i}")
    return readers.read_csv_by_header(spark, f"{base}/*", _ORDER_SCHEMA, pattern="*.csv").agg(
        F.count("*").alias("total_records"), F.count("order_status").alias("with_status"),
        F.count("priority").alias("with_priority"), F.count("total_amount").alias("with_amount"),
        F.sum("total_amount").alias("amount"), F.countDistinct("order_status").alias("statuses"))


@Q.add("S4_parquet_scan", "order_id long, total_amount dbl",
       f"SELECT order_id, total_amount FROM {ORDERS} AS o WHERE order_date >= DATE '2001-01-01'")
def s4(spark, sf):
    return ds.orders(spark, sf, F.lit("2001-01-01").cast("timestamp_ntz")).select(
        "order_id", "total_amount")


@Q.add("S5_cross_format_union", "order_status str, row_count long, revenue dbl",
       f"""SELECT order_status, COUNT(*) AS row_count, SUM(total_amount) AS revenue FROM (
           SELECT * FROM {ORDERS} AS o UNION ALL SELECT * FROM {ORDERS} AS p) AS u GROUP BY 1""")
def s5(spark, sf):
    raw = readers.read_csv(spark, _orders_as_csv(spark, sf), ", ".join(
        f"{c.split()[0]} STRING" for c in _ORDER_SCHEMA.split(", ")))
    both = readers.aligned_union(ds.orders(spark, sf), raw)
    return agg.revenue_by(both, ["order_status"], count_name="row_count", total_name="revenue",
                          mean_name=None)


@Q.add("S6_bound_table_read", "country str, customers long",
       f"""SELECT country, COUNT(*) AS customers FROM {CUSTOMERS} AS c
           WHERE balance BETWEEN 1000 AND 5000 GROUP BY 1""")
def s6(spark, sf):
    return readers.bound_query(
        spark, "SELECT country, count(*) AS customers FROM {customers} "
        "WHERE balance BETWEEN :low AND :high GROUP BY country", {"low": 1000, "high": 5000},
        customers=ds.customers(spark, sf, country=True))


@Q.add("S7_registered_frame", "tier str, customers long",
       f"SELECT tier, COUNT(*) AS customers FROM {CUSTOMERS} AS c GROUP BY 1")
def s7(spark, sf):
    readers.register(ds.customers(spark, sf), "millrace_customers")
    return spark.sql("SELECT tier, count(*) AS customers FROM millrace_customers GROUP BY tier")


@Q.add("S8_file_listing", "file_name str, has_bytes bool",
       " UNION ALL ".join(f"SELECT '{t}.parquet' AS file_name, TRUE AS has_bytes" for t in (
           "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
           "documents", "embeddings", "pages", "benchmark", "labels", "conversations")))
def s8(spark, sf):
    return readers.list_files(spark, sf, "*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        (F.col("length") > 0).alias("has_bytes"))


@Q.add("S9_csv_preview", "order_id long, total_amount dbl",
       f"SELECT order_id, total_amount FROM {ORDERS} AS o ORDER BY order_id LIMIT 5")
def s9(spark, sf):
    path = _orders_as_csv(spark, sf, "order_id", "total_amount")
    return readers.preview_csv(spark, path, 5, ["order_id"])


@Q.add("S10_declared_rows", "tier str, discount dbl, customers long",
       f"""SELECT tier, discount, COUNT(*) AS customers FROM {CUSTOMERS} AS c JOIN (VALUES
           ('BUILDING', 0.1::DOUBLE), ('MACHINERY', 0.2::DOUBLE)) AS v(tier, discount) USING (tier)
           GROUP BY 1, 2""")
def s10(spark, sf):
    rates = spark.createDataFrame([("BUILDING", 0.1), ("MACHINERY", 0.2)],
                                  "tier STRING, discount DOUBLE")
    return ds.customers(spark, sf).join(rates, "tier").groupBy("tier", "discount").agg(
        F.count("*").alias("customers"))


@Q.add("S11_integer_series", "i long, lines long",
       """SELECT i, COUNT(*) AS lines FROM (SELECT UNNEST(range(1, l_linenumber + 1)) AS i
          FROM lineitem) AS s GROUP BY 1""")
def s11(spark, sf):
    return ds.table(spark, sf, "lineitem").select(
        F.explode(F.sequence(F.lit(1), F.col("l_linenumber"))).alias("i")).groupBy("i").agg(
        F.count("*").alias("lines"))


@Q.add("S12_sample_orders", "ship_city str, ship_state str, product_category str, rows long, quantity long, total dbl",
       """SELECT n_name AS ship_city, r_name AS ship_state, p_type AS product_category, COUNT(*) AS rows,
          SUM(l_quantity) AS quantity, SUM(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(l_quantity AS BIGINT)) AS total
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey
          JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
          JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2, 3""")
def s12(spark, sf):
    return gen.flat_orders(spark, sf).groupBy("ship_city", "ship_state", "product_category").agg(
        F.count("*").alias("rows"), F.sum("quantity").alias("quantity"), F.sum("total_amount").alias("total"))


@Q.add("S13_sample_events", "event_type str, rows long, users long, total dbl",
       f"""SELECT event_type, COUNT(*) AS rows, COUNT(DISTINCT user_id) AS users, SUM(value) AS total
           FROM {EVENTS} AS e GROUP BY 1""")
def s13(spark, sf):
    """Events as type and JSON payload, read back from the payload."""
    body = F.from_json("event_data", "user_id BIGINT, value DECIMAL(12,2)")
    return gen.payloads(ds.events(spark, sf), ["user_id", "value"]).select("event_type", body.alias("m")).groupBy(
        "event_type").agg(F.count("*").alias("rows"), F.countDistinct("m.user_id").alias("users"),
                          F.sum("m.value").alias("total"))


@Q.add("S14_date_category_grid", "date str, category str, value dbl, users long, sessions long",
       f"""SELECT CAST(d AS DATE) AS date, t.event_type AS category, COALESCE(SUM(e.value), 0) AS value,
           COUNT(DISTINCT e.user_id) AS users, COUNT(e.event_time) AS sessions FROM (
             SELECT UNNEST(generate_series(CAST({LAST_EVENT} AS DATE) - INTERVAL 29 DAY,
               CAST({LAST_EVENT} AS DATE), INTERVAL 1 DAY)) AS d) AS s
           CROSS JOIN (SELECT DISTINCT event_type FROM {EVENTS} AS x) AS t
           LEFT JOIN {EVENTS} AS e ON e.event_type = t.event_type AND CAST(e.event_time AS DATE) = CAST(d AS DATE)
           GROUP BY 1, 2""")
def s14(spark, sf):
    """The last 30 days of every event type, days without an event included."""
    return gen.date_category_grid(ds.events(spark, sf), "event_time", "event_type", 30, [
        F.sum("value").alias("value"), F.countDistinct("user_id").alias("users"), F.count("*").alias("sessions")])


@Q.add("S15_source_fallback", "source str, row_count long",
       "SELECT 'database' AS source, COUNT(*) AS row_count FROM orders")
def s15(spark, sf):
    missing = shared_folder(spark, "absent")
    picked = readers.read_first_nonempty([
        ("object store", lambda: spark.read.parquet(missing)),
        ("empty table", lambda: ds.orders(spark, sf).filter("total_amount < 0")),
        ("database", lambda: ds.orders(spark, sf)),
        ("generated", lambda: gen.sample_orders(ds.orders(spark, sf), "order_id"))])
    return picked.groupBy("source").agg(F.count("*").alias("row_count"))


@Q.add("S16_message_topic", "event_type str, row_count long, total dbl",
       """SELECT event_type, COUNT(*) AS row_count, SUM(CAST(value AS DECIMAL(12,2))) AS total
          FROM events GROUP BY 1""")
def s16(spark, sf):
    # Files of JSON lines stand in for the topic; parsing and the stream are the same.
    base = shared_folder(spark, "topic")
    ds.table(spark, sf, "events").select(F.to_json(F.struct(
        "event_id", "event_type", "value")).alias("value")).write.text(f"{base}/in")
    schema = "event_id BIGINT, event_type STRING, value DECIMAL(12,2)"
    stream = spark.readStream.text(f"{base}/in").select(
        readers.parse_message(F.col("value"), schema).alias("m")).select("m.*")
    (stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state")
     .trigger(availableNow=True).start(f"{base}/out").awaitTermination())
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(
        F.count("*").alias("row_count"), F.sum("value").alias("total"))
