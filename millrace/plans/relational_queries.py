"""Joins, aggregations, sorts and set operations (ids J, A, L, U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.scalars import size_class, trunc_date
from millrace.functions.scalars import bucket_label, json_has, json_int
from millrace.operators import aggregates as agg, joins, windows
from millrace.operators.ranking import most_frequent
from millrace.plans.registry import QuerySet
from millrace.plans.sql_views import (CUSTOMERS, EVENTS, FACTS, GRID, ITEMS, LAST_DAY, LAST_EVENT,
                                      LINES, ORDERS, SALES, mean)
from millrace.sources import datasets as ds

Q = QuerySet()

# Joins ---------------------------------------------------------------------------------------


@Q.add("J1_customer_orders", "customer_name str, country str, order_count long, total_amount dbl",
       f"""SELECT c.customer_name, c.country, COUNT(o.order_id) AS order_count,
           SUM(o.total_amount) AS total_amount FROM {CUSTOMERS} c
           LEFT JOIN {ORDERS} o ON c.customer_id = o.customer_id GROUP BY 1, 2""")
def j1(spark, sf):
    out = joins.parent_totals(ds.customers(spark, sf, country=True), ds.orders(spark, sf), "customer_id",
                              "customer_id", ["customer_name", "country"], "total_amount")
    return out.withColumnsRenamed({"child_count": "order_count", "total": "total_amount"})


@Q.add("J2_cross_source_customers",
       "customer_name str, country str, relational_total dbl, lake_count long, lake_total dbl",
       f"""WITH lake AS (SELECT customer_name, COUNT(total_amount) AS n, SUM(total_amount) AS t
             FROM {LINES} AS l GROUP BY 1),
           rel AS (SELECT c.customer_name, c.country, SUM(o.total_amount) AS relational_total
             FROM {CUSTOMERS} c LEFT JOIN {ORDERS} o ON c.customer_id = o.customer_id GROUP BY 1, 2)
           SELECT rel.*, COALESCE(lake.n, 0) AS lake_count, lake.t AS lake_total
           FROM rel LEFT JOIN lake USING (customer_name)""")
def j2(spark, sf):
    per_customer = ds.orders(spark, sf).groupBy("customer_id").agg(
        F.sum("total_amount").alias("amount"))
    relational = ds.customers(spark, sf, country=True).join(per_customer, "customer_id", "left")
    lake = ds.line_sums(spark, sf, "customer_name")
    return joins.cross_source_summary(relational, lake, "customer_name", "amount",
                                      "total_amount", "line_count", ["country"])


@Q.add("J3_orphan_orders", "order_id long, customer_id long",
       f"""SELECT o.order_id, o.customer_id FROM {ORDERS} o LEFT JOIN
           (SELECT customer_id FROM {CUSTOMERS} AS x WHERE balance >= 0) c
           ON o.customer_id = c.customer_id WHERE c.customer_id IS NULL""")
def j3(spark, sf):
    # The tables hold no orphans, so overdrawn accounts count as missing from the dimension.
    active = ds.customers(spark, sf).filter("balance >= 0")
    return joins.orphans(ds.orders(spark, sf), active, "customer_id", "customer_id")


_FACT_COLUMNS = ("order_date str, product_category str, customer_region str, order_count long, "
                 "total_revenue dbl, avg_order_value dbl")


@Q.add("J4_order_facts", _FACT_COLUMNS, f"SELECT * FROM {FACTS} AS f")
def j4(spark, sf):
    return ds.order_facts(spark, sf)


# Aggregations --------------------------------------------------------------------------------


@Q.add("A1_row_count", "row_count long", "SELECT COUNT(*) AS row_count FROM lineitem")
def a1(spark, sf):
    return ds.table(spark, sf, "lineitem").agg(F.count("*").alias("row_count"))


@Q.add("A2_category_revenue", "product_category str, order_count long, revenue dbl, "
       "avg_order_value dbl",
       f"""SELECT product_category, COUNT(*) AS order_count, SUM(total_amount) AS revenue,
           {mean('total_amount')} AS avg_order_value FROM {LINES} AS l GROUP BY 1
           ORDER BY revenue DESC""")
def a2(spark, sf):
    sums = ds.line_sums(spark, sf, "product_category")
    return agg.revenue_by(sums, ["product_category"], total_name="revenue", rows="line_count").orderBy(
        F.desc_nulls_last("revenue"))


@Q.add("A3_category_revenue_renamed", "product_category str, total_revenue dbl, order_count long",
       f"""SELECT product_category, SUM(total_amount) AS total_revenue, COUNT(*) AS order_count
           FROM {LINES} AS l GROUP BY 1""")
def a3(spark, sf):
    sums = ds.line_sums(spark, sf, "product_category")
    return (sums.groupBy("product_category").agg({"total_amount": "sum", "line_count": "sum"})
            .withColumnsRenamed({"sum(total_amount)": "total_revenue",
                                 "sum(line_count)": "order_count"}))


@Q.add("A4_product_region_sales", "product_name str, ship_state str, total_sales dbl, "
       "sale_count long",
       f"""SELECT product_name, ship_state, SUM(total_amount) AS total_sales,
           COUNT(*) AS sale_count FROM {LINES} AS l GROUP BY 1, 2""")
def a4(spark, sf):
    sums = ds.line_sums(spark, sf, "product_name", "ship_state")
    return agg.revenue_by(sums, ["product_name", "ship_state"], count_name="sale_count",
                          total_name="total_sales", mean_name=None, rows="line_count")


@Q.add("A5_region_totals", "ship_state str, total_sales dbl, sale_count long",
       f"""SELECT ship_state, SUM(total_amount) AS total_sales, COUNT(*) AS sale_count
           FROM {LINES} AS l GROUP BY 1""")
def a5(spark, sf):
    sums = ds.line_sums(spark, sf, "ship_state")
    return agg.revenue_by(sums, ["ship_state"], count_name="sale_count",
                          total_name="total_sales", mean_name=None, rows="line_count")


def _trend_sql(unit: str) -> str:
    return f"""SELECT CAST(DATE_TRUNC('{unit}', order_date) AS DATE) AS period,
        COUNT(*) AS order_count, SUM(total_amount) AS total_revenue,
        {mean('total_amount')} AS avg_order_value FROM {ORDERS} AS o GROUP BY 1"""


@Q.add("A6_monthly_trend", "period str, order_count long, total_revenue dbl, avg_order_value dbl",
       _trend_sql("month"))
def a6(spark, sf):
    return agg.trend(ds.orders(spark, sf), "month", "order_date").orderBy("period")


@Q.add("A7_daily_trend", "period str, order_count long, total_revenue dbl, avg_order_value dbl",
       _trend_sql("day"))
def a7(spark, sf):
    return agg.trend(ds.orders(spark, sf), "day", "order_date").orderBy("period")


@Q.add("A8_hourly_trend", "hour ts, row_count long, amount dbl",
       f"""SELECT DATE_TRUNC('hour', event_time) AS hour, COUNT(*) AS row_count,
           SUM(value) AS amount FROM {EVENTS} AS e
           WHERE CAST(event_time AS DATE) = CAST({LAST_EVENT} AS DATE) GROUP BY 1""")
def a8(spark, sf):
    return agg.hourly_trend(ds.events(spark, sf), "event_time", ds.last_event_time(spark, sf),
                            "value").orderBy("hour")


@Q.add("A9_product_performance", "product_name str, order_count long, total_quantity long, "
       "total_revenue dbl, avg_price dbl",
       f"""SELECT product_name, COUNT(*) AS order_count, SUM(quantity) AS total_quantity,
           SUM(total_amount) AS total_revenue, {mean('unit_price')} AS avg_price
           FROM {LINES} AS l GROUP BY 1""")
def a9(spark, sf):
    return agg.product_performance(ds.line_sums(spark, sf, "product_name", "unit_price"))


@Q.add("A10_country_analytics", "country str, customer_count long, total_orders long, "
       "total_revenue dbl, avg_order_value dbl",
       f"""SELECT c.country, COUNT(DISTINCT c.customer_id) AS customer_count,
           COUNT(o.order_id) AS total_orders, SUM(o.total_amount) AS total_revenue,
           {mean('o.total_amount', 'COUNT(o.order_id)')} AS avg_order_value
           FROM {CUSTOMERS} c LEFT JOIN {ORDERS} o ON c.customer_id = o.customer_id GROUP BY 1""")
def a10(spark, sf):
    out = joins.parent_totals(ds.customers(spark, sf, country=True), ds.orders(spark, sf), "customer_id",
                              "customer_id", ["country"], "total_amount")
    return out.withColumnsRenamed({
        "parent_count": "customer_count", "child_count": "total_orders",
        "total": "total_revenue", "mean": "avg_order_value"})


@Q.add("A11_city_summary", "city str, customer_count long, distinct_customers long, "
       "total_orders long, total_revenue dbl, avg_order_value dbl",
       f"""SELECT c.country AS city, COUNT(c.customer_id) AS customer_count,
           COUNT(DISTINCT c.customer_id) AS distinct_customers,
           COUNT(o.order_id) AS total_orders, COALESCE(SUM(o.total_amount), 0) AS total_revenue,
           COALESCE({mean('o.total_amount', 'COUNT(o.order_id)')}, 0) AS avg_order_value
           FROM {CUSTOMERS} c LEFT JOIN {ORDERS} o ON c.customer_id = o.customer_id GROUP BY 1""")
def a11(spark, sf):
    out = joins.parent_totals(ds.customers(spark, sf, country=True), ds.orders(spark, sf), "customer_id",
                              "customer_id", ["country"], "total_amount")
    return out.select(
        F.col("country").alias("city"), F.col("joined_rows").alias("customer_count"),
        F.col("parent_count").alias("distinct_customers"),
        F.col("child_count").alias("total_orders"),
        F.coalesce("total", F.lit(0)).alias("total_revenue"),
        F.coalesce("mean", F.lit(0.0)).alias("avg_order_value"))


@Q.add("A12_global_distinct", "total_records long, categories long, total_revenue dbl",
       f"""SELECT COUNT(*) AS total_records, COUNT(DISTINCT product_category) AS categories,
           SUM(total_amount) AS total_revenue FROM {LINES} AS l""")
def a12(spark, sf):
    sums = ds.line_sums(spark, sf, "product_category")
    return agg.distinct_totals(sums, "product_category", "total_amount", rows="line_count").withColumnRenamed(
        "distinct_values", "categories")


@Q.add("A13_day_comparison", "product_category str, today_revenue dbl, yesterday_revenue dbl, "
       "pct_change dbl6",
       f"""SELECT product_category,
           SUM(CASE WHEN batch_date = {LAST_DAY} THEN new_revenue ELSE 0 END) AS today_revenue,
           SUM(CASE WHEN batch_date = {LAST_DAY} - 1 THEN new_revenue ELSE 0 END)
             AS yesterday_revenue,
           CAST(SUM(CASE WHEN batch_date = {LAST_DAY} THEN new_revenue ELSE -new_revenue END)
             AS DOUBLE) / NULLIF(CAST(SUM(CASE WHEN batch_date = {LAST_DAY} - 1
             THEN new_revenue ELSE 0 END) AS DOUBLE), 0) * 100 AS pct_change
           FROM {SALES} AS s WHERE batch_date IN ({LAST_DAY}, {LAST_DAY} - 1)
           GROUP BY 1 HAVING SUM(CASE WHEN batch_date = {LAST_DAY} - 1 THEN new_revenue
             ELSE 0 END) > 0""")
def a13(spark, sf):
    last = ds.last_order_day(spark, sf)
    return agg.compare_days(ds.category_sales(spark, sf, last - F.expr("INTERVAL 1 DAY")),
                            last.cast("date"))


_BATCH_BOUNDS = [(8, "Original Batch"), (16, "Second Batch")]
_BATCH_SQL = ("CASE WHEN c_nationkey < 8 THEN 'Original Batch' WHEN c_nationkey < 16 "
              "THEN 'Second Batch' ELSE 'New Batch' END")


@Q.add("A14_batch_ranges", "batch str, record_count long, min_id long, max_id long",
       f"""SELECT {_BATCH_SQL} AS batch, COUNT(*) AS record_count, MIN(customer_id) AS min_id,
           MAX(customer_id) AS max_id FROM {CUSTOMERS} AS c GROUP BY 1""")
def a14(spark, sf):
    batch = bucket_label(F.col("c_nationkey"), _BATCH_BOUNDS, "New Batch")
    return ds.customers(spark, sf).groupBy(batch.alias("batch")).agg(
        F.count("*").alias("record_count"), F.min("customer_id").alias("min_id"),
        F.max("customer_id").alias("max_id")).orderBy("min_id")


@Q.add("A15_id_lists", "batch str, page long, records long, ids str",
       f"""SELECT {_BATCH_SQL} AS batch, customer_id // 1000 AS page, COUNT(*) AS records,
           STRING_AGG(CAST(customer_id AS VARCHAR), ', ' ORDER BY customer_id) AS ids
           FROM {CUSTOMERS} AS c GROUP BY 1, 2""")
def a15(spark, sf):
    batch = bucket_label(F.col("c_nationkey"), _BATCH_BOUNDS, "New Batch")
    return agg.id_pages(ds.customers(spark, sf).withColumn("batch", batch), "batch",
                        "customer_id")


@Q.add("A16_table_profile", "total_records long, unique_tiers long, with_email long, "
       "min_id long, max_id long",
       f"""SELECT COUNT(*) AS total_records, COUNT(DISTINCT tier) AS unique_tiers,
           COUNT(CASE WHEN email LIKE '%@%' THEN 1 END) AS with_email,
           MIN(customer_id) AS min_id, MAX(customer_id) AS max_id FROM {CUSTOMERS} AS c""")
def a16(spark, sf):
    return ds.customers(spark, sf).agg(
        F.count("*").alias("total_records"), F.countDistinct("tier").alias("unique_tiers"),
        F.count_if(F.col("email").like("%@%")).alias("with_email"),
        F.min("customer_id").alias("min_id"), F.max("customer_id").alias("max_id"))


_ALL_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@Q.add("A17_table_sizes", "table_name str, record_count long, size_category str",
       " UNION ALL ".join(
           f"SELECT '{t}' AS table_name, COUNT(*) AS record_count, CASE WHEN COUNT(*) < 1000 "
           f"THEN 'Small' WHEN COUNT(*) < 10000 THEN 'Medium' ELSE 'Large' END AS size_category "
           f"FROM {t}" for t in _ALL_TABLES))
def a17(spark, sf):
    # Unioning the counts lets all tables be counted in one job.
    counts = None
    for name in _ALL_TABLES:
        one = ds.table(spark, sf, name).agg(F.count("*").alias("record_count")).select(
            F.lit(name).alias("table_name"), "record_count")
        counts = one if counts is None else counts.union(one)
    return counts.withColumn("size_category", size_class(F.col("record_count")))


@Q.add("A18_category_summary", "category str, total dbl, average dbl, row_count long",
       f"""SELECT event_type AS category, SUM(value) AS total, {mean('value')} AS average,
           COUNT(*) AS row_count FROM {EVENTS} AS e GROUP BY 1""")
def a18(spark, sf):
    return agg.revenue_by(ds.events(spark, sf), [F.col("event_type").alias("category")], "value",
                          "row_count", "total", "average")


@Q.add("A19_date_category_series", "date str, category str, value dbl",
       f"SELECT date, category, SUM(value) AS value FROM {GRID} AS g GROUP BY 1, 2")
def a19(spark, sf):
    e = ds.events(spark, sf).select(F.col("event_time").cast("date").alias("date"),
                                    F.col("event_type").alias("category"), "value")
    return windows.series_by(e, ["date", "category"], "value")


@Q.add("A20_kpi_totals", "total_value dbl, total_sessions long, avg_users dbl",
       f"""SELECT SUM(value) AS total_value, SUM(sessions) AS total_sessions,
           {mean('users')} AS avg_users FROM {GRID} AS g""")
def a20(spark, sf):
    return agg.kpi_totals(ds.day_grid(spark, sf), ["value", "sessions"], "users")


@Q.add("A21_value_counts", "field str, value str, row_count long",
       f"""SELECT 'category' AS field, category AS value, COUNT(*) AS row_count
           FROM {ITEMS} AS i GROUP BY 2 UNION ALL
           SELECT 'domain', domain, COUNT(*) FROM {ITEMS} AS i GROUP BY 2""")
def a21(spark, sf):
    return agg.value_counts(ds.items(spark, sf), "category", "domain").orderBy(
        "field", F.desc("row_count"), "value")


_MATURITY_BOUNDS = [(13, "Emerging"), (26, "Growing"), (39, "Mature")]
_MATURITY_SQL = ("CASE WHEN complexity < 13 THEN 'Emerging' WHEN complexity < 26 THEN 'Growing' "
                 "WHEN complexity < 39 THEN 'Mature' ELSE 'Declining' END")


@Q.add("A22_dataset_summary", "field str, value str, amount dbl",
       f"""WITH i AS (SELECT *, {_MATURITY_SQL} AS maturity FROM {ITEMS} AS x)
           SELECT 'items' AS field, '' AS value, COUNT(*)::DOUBLE AS amount FROM i
           UNION ALL SELECT 'categories', '', COUNT(DISTINCT category) FROM i
           UNION ALL SELECT 'domains', '', COUNT(DISTINCT domain) FROM i
           UNION ALL SELECT 'avg_complexity', '', {mean('complexity')} FROM i
           UNION ALL SELECT 'avg_cost', '', {mean('cost')} FROM i
           UNION ALL SELECT 'maturity', maturity, COUNT(*) FROM i GROUP BY 2
           UNION ALL SELECT 'domain', domain, COUNT(*) FROM i GROUP BY 2""")
def a22(spark, sf):
    items = ds.items(spark, sf).withColumn(
        "maturity", bucket_label(F.col("complexity"), _MATURITY_BOUNDS, "Declining"))
    return agg.item_summary(items, {"category": "categories", "domain": "domains"},
                            ["complexity", "cost"], ["maturity", "domain"])


@Q.add("A23_hierarchy_totals", "level long, maturity str, domain str, category str, total dbl, "
       "item_count long",
       f"""SELECT GROUPING(maturity, domain, category) AS level, maturity, domain, category,
           SUM(cost) AS total, COUNT(*) AS item_count
           FROM (SELECT *, {_MATURITY_SQL} AS maturity FROM {ITEMS} AS x) AS i
           GROUP BY ROLLUP (maturity, domain, category)""")
def a23(spark, sf):
    items = ds.items(spark, sf).withColumn(
        "maturity", bucket_label(F.col("complexity"), _MATURITY_BOUNDS, "Declining"))
    return agg.hierarchy_totals(items, ["maturity", "domain", "category"], "cost")


@Q.add("A24_histogram", "bin long, row_count long",
       """WITH s AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders)
          SELECT LEAST(FLOOR((o_totalprice - lo) / ((hi - lo) / 15)), 14) AS bin,
          COUNT(*) AS row_count FROM orders CROSS JOIN s GROUP BY 1""")
def a24(spark, sf):
    return agg.histogram(ds.table(spark, sf, "orders"), "o_totalprice", 15).orderBy("bin")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"]


@Q.add("A25_correlation_matrix", "measure_a str, measure_b str, correlation dbl6",
       " UNION ALL ".join(
           f"SELECT '{a}' AS measure_a, '{b}' AS measure_b, 1.0::DOUBLE AS correlation" if a == b
           else f"SELECT '{a}' AS measure_a, '{b}' AS measure_b, CORR({a}, {b}) AS correlation "
           "FROM lineitem JOIN part ON l_partkey = p_partkey"
           for a in _MEASURES for b in _MEASURES))
def a25(spark, sf):
    line = ds.table(spark, sf, "lineitem")
    part = ds.table(spark, sf, "part")
    return agg.correlation_matrix(line.join(part, line.l_partkey == part.p_partkey), _MEASURES)


@Q.add("A26_dominant_value", "domain str, dominant_category str",
       f"""SELECT domain, category AS dominant_category FROM (
             SELECT domain, category, ROW_NUMBER() OVER (
               PARTITION BY domain ORDER BY COUNT(*) DESC, category) AS rn
             FROM {ITEMS} AS i GROUP BY 1, 2) AS r WHERE rn = 1""")
def a26(spark, sf):
    return most_frequent(ds.items(spark, sf), ["domain"], "category", "dominant_category")


@Q.add("A27_daily_facts", "order_date str, total_orders long, daily_revenue dbl, avg_value dbl4",
       f"""SELECT order_date, SUM(order_count) AS total_orders,
           SUM(total_revenue) AS daily_revenue, AVG(avg_order_value) AS avg_value
           FROM {FACTS} AS f GROUP BY 1""")
def a27(spark, sf):
    return ds.order_facts(spark, sf).groupBy("order_date").agg(
        F.sum("order_count").alias("total_orders"), F.sum("total_revenue").alias("daily_revenue"),
        F.avg("avg_order_value").alias("avg_value")).orderBy(F.desc("order_date"))


def _category_report(facts):
    return facts.groupBy("product_category").agg(
        F.count("*").alias("days_with_data"), F.sum("order_count").alias("total_orders"),
        F.sum("total_revenue").alias("category_revenue"),
        F.avg("avg_order_value").alias("avg_order_value"))


@Q.add("A28_category_performance", "product_category str, days_with_data long, "
       "total_orders long, category_revenue dbl, avg_order_value dbl4",
       f"""SELECT product_category, COUNT(*) AS days_with_data, SUM(order_count) AS total_orders,
           SUM(total_revenue) AS category_revenue, AVG(avg_order_value) AS avg_order_value
           FROM {FACTS} AS f GROUP BY 1""")
def a28(spark, sf):
    return _category_report(ds.order_facts(spark, sf)).orderBy(F.desc("category_revenue"))


@Q.add("A29_daily_sales_summary", "order_date str, product_category str, customer_region str, "
       "total_orders long, total_revenue dbl, avg_order_value dbl4, record_count long",
       f"""SELECT order_date, product_category, customer_region, SUM(order_count) AS total_orders,
           SUM(total_revenue) AS total_revenue, AVG(avg_order_value) AS avg_order_value,
           COUNT(*) AS record_count FROM {FACTS} AS f GROUP BY 1, 2, 3""")
def a29(spark, sf):
    return ds.order_facts(spark, sf).groupBy(
        "order_date", "product_category", "customer_region").agg(
        F.sum("order_count").alias("total_orders"), F.sum("total_revenue").alias("total_revenue"),
        F.avg("avg_order_value").alias("avg_order_value"), F.count("*").alias("record_count"))


def facts_since(spark, sf, interval):
    since = ds.last_order_day(spark, sf) - F.expr(f"INTERVAL {interval}")
    return ds.order_facts(spark, sf, since)


@Q.add("A30_recent_daily_revenue", "order_date str, daily_revenue dbl, categories_sold long",
       f"""SELECT order_date, SUM(total_revenue) AS daily_revenue,
           COUNT(DISTINCT product_category) AS categories_sold FROM {FACTS} AS f
           WHERE order_date >= {LAST_DAY} - INTERVAL 30 DAY GROUP BY 1""")
def a30(spark, sf):
    return facts_since(spark, sf, "30 days").groupBy("order_date").agg(
        F.sum("total_revenue").alias("daily_revenue"),
        F.countDistinct("product_category").alias("categories_sold")).orderBy("order_date")


@Q.add("A31_top_categories_week", "product_category str, category_revenue dbl, "
       "total_orders long, avg_order_value dbl4",
       f"""SELECT product_category, SUM(total_revenue) AS category_revenue,
           SUM(order_count) AS total_orders, AVG(avg_order_value) AS avg_order_value
           FROM {FACTS} AS f WHERE order_date >= {LAST_DAY} - INTERVAL 7 DAY
           GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a31(spark, sf):
    return _category_report(facts_since(spark, sf, "7 days")).orderBy(
        F.desc("category_revenue"), "product_category").limit(10)


@Q.add("A32_recent_regions", "region str, revenue dbl, order_count long, avg_order_value dbl4",
       f"""SELECT customer_region AS region, SUM(total_revenue) AS revenue,
           COUNT(*) AS order_count, AVG(avg_order_value) AS avg_order_value FROM {FACTS} AS f
           WHERE order_date >= {LAST_DAY} - INTERVAL 30 DAY GROUP BY 1""")
def a32(spark, sf):
    return facts_since(spark, sf, "30 days").groupBy(
        F.col("customer_region").alias("region")).agg(
        F.sum("total_revenue").alias("revenue"), F.count("*").alias("order_count"),
        F.avg("avg_order_value").alias("avg_order_value")).orderBy(F.desc("revenue"))


@Q.add("A33_day_category_since", "day str, product_category str, orders long, revenue dbl",
       f"""SELECT CAST(DATE_TRUNC('day', order_date) AS DATE) AS day, product_category,
           COUNT(*) AS orders, SUM(total_revenue) AS revenue FROM {FACTS} AS f
           WHERE order_date >= DATE '1998-01-01' GROUP BY 1, 2""")
def a33(spark, sf):
    facts = ds.order_facts(spark, sf, F.lit("1998-01-01").cast("timestamp_ntz"))
    return facts.groupBy(trunc_date("day", "order_date").alias("day"), "product_category").agg(
        F.count("*").alias("orders"), F.sum("total_revenue").alias("revenue")).orderBy(
        F.desc("day"), F.desc("revenue"))


@Q.add("A34_one_category_daily", "order_date str, revenue dbl, orders long",
       f"""SELECT order_date, SUM(total_revenue) AS revenue, SUM(order_count) AS orders
           FROM {FACTS} AS f WHERE product_category = 'PROMO'
           AND order_date >= {LAST_DAY} - INTERVAL 30 DAY GROUP BY 1""")
def a34(spark, sf):
    facts = facts_since(spark, sf, "30 days").filter(F.col("product_category") == "PROMO")
    return facts.groupBy("order_date").agg(F.sum("total_revenue").alias("revenue"),
                                           F.sum("order_count").alias("orders")).orderBy(
        "order_date")


@Q.add("A35_events_last_day", "event_type str, event_count long",
       f"""SELECT event_type, COUNT(*) AS event_count FROM events
           WHERE ts >= {LAST_EVENT} - INTERVAL 1 DAY GROUP BY 1""")
def a35(spark, sf):
    fresh = windows.recent(ds.events(spark, sf), "event_time", ds.last_event_time(spark, sf),
                           "1 day")
    return fresh.groupBy("event_type").agg(F.count("*").alias("event_count")).orderBy(
        F.desc("event_count"), "event_type")


@Q.add("A36_daily_event_stats", "analysis_date str, total_events long, unique_users long, "
       "session_share dbl",
       f"""SELECT CAST(event_time AS DATE) AS analysis_date, COUNT(*) AS total_events,
           COUNT(DISTINCT CAST(json_extract_string(event_data, '$.k') AS BIGINT)) AS unique_users,
           SUM(CASE WHEN json_extract_string(event_data, '$.session_id') IS NOT NULL THEN 1.0
             ELSE 0.0 END)::DOUBLE / COUNT(*) AS session_share
           FROM {EVENTS} AS e GROUP BY 1""")
def a36(spark, sf):
    return (ds.events(spark, sf).groupBy(F.col("event_time").cast("date").alias("analysis_date"))
            .agg(F.count("*").alias("total_events"),
                 F.countDistinct(json_int("event_data", "$.k")).alias("unique_users"),
                 F.avg(json_has("event_data", "$.session_id")).alias("session_share")))


# Sorts, limits, set operations ------------------------------------------------------------------


@Q.add("L1_multi_key_order", "month str, product_category str, monthly_revenue dbl",
       f"""SELECT CAST(DATE_TRUNC('month', order_date) AS DATE) AS month, product_category,
           SUM(total_revenue) AS monthly_revenue FROM {FACTS} AS f GROUP BY 1, 2
           ORDER BY 1 DESC, 3 DESC NULLS LAST""")
def l1(spark, sf):
    return ds.order_facts(spark, sf).groupBy(
        trunc_date("month", "order_date").alias("month"), "product_category").agg(
        F.sum("total_revenue").alias("monthly_revenue")).orderBy(
        F.desc("month"), F.desc_nulls_last("monthly_revenue"))


@Q.add("L2_preview", "order_id long, customer_id long, total_amount dbl",
       f"SELECT order_id, customer_id, total_amount FROM {ORDERS} AS o ORDER BY order_id LIMIT 20")
def l2(spark, sf):
    return ds.orders(spark, sf).orderBy("order_id").limit(20)


@Q.add("L3_most_recent_rows", "order_id long, order_date str, total_amount dbl",
       f"""SELECT order_id, order_date, total_amount FROM {ORDERS} AS o
           ORDER BY order_date DESC, order_id LIMIT 1000""")
def l3(spark, sf):
    return ds.orders(spark, sf).orderBy(F.desc("order_date"), "order_id").limit(1000)


@Q.add("L4_order_by_hidden_aggregate", "tier str, customers long",
       f"""SELECT tier, COUNT(*) AS customers FROM {CUSTOMERS} AS c GROUP BY 1
           ORDER BY MIN(customer_id)""")
def l4(spark, sf):
    return ds.customers(spark, sf).groupBy("tier").agg(
        F.count("*").alias("customers"), F.min("customer_id").alias("first_id")).orderBy(
        "first_id").drop("first_id")


@Q.add("U1_labelled_union", "timepoint str, record_count long",
       f"""SELECT 'Current' AS timepoint, COUNT(*) AS record_count FROM {CUSTOMERS} AS c
           UNION ALL SELECT 'Historical', COUNT(*) FROM {CUSTOMERS} AS c WHERE c_nationkey < 8""")
def u1(spark, sf):
    c = ds.customers(spark, sf)
    count = lambda df, label: df.agg(F.count("*").alias("record_count")).select(
        F.lit(label).alias("timepoint"), "record_count")
    return count(c, "Current").union(count(c.filter("c_nationkey < 8"), "Historical"))
