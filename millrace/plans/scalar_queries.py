"""Projections, predicates and scalar functions (ids P, F)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from millrace.functions import scalars as sc
from millrace.operators import aggregates as agg, windows
from millrace.plans.registry import QuerySet
from millrace.plans.sql_views import CUSTOMERS, EVENTS, ITEMS, LAST_DAY, LINES, ORDERS
from millrace.sources import datasets as ds
from millrace.sources.readers import bound_query

Q = QuerySet()


@Q.add("P1_projection", "id long, name str, country str",
       f"SELECT customer_id AS id, customer_name AS name, country FROM {CUSTOMERS} AS c")
def p1(spark, sf):
    return ds.customers(spark, sf, country=True).select(F.col("customer_id").alias("id"),
                                          F.col("customer_name").alias("name"), "country")


@Q.add("P2_comparison", "order_id long, total_amount dbl",
       f"""SELECT order_id, total_amount FROM {ORDERS} AS o
           WHERE total_amount >= 250000 AND order_date < DATE '1997-01-01'""")
def p2(spark, sf):
    o = ds.table(spark, sf, "orders").filter(
        (F.col("o_totalprice") >= 250000)
        & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")))
    return o.select(F.col("o_orderkey").alias("order_id"),
                    sc.money("o_totalprice").alias("total_amount"))


_SESSION = "json_extract_string(event_data, '$.session_id')"


@Q.add("P3_null_predicates", "has_session bool, has_user bool, row_count long",
       f"""SELECT {_SESSION} IS NOT NULL AS has_session,
           json_extract_string(event_data, '$.k') IS NOT NULL AS has_user, COUNT(*) AS row_count
           FROM {EVENTS} AS e GROUP BY 1, 2""")
def p3(spark, sf):
    at = lambda path: F.get_json_object("event_data", path).isNotNull()
    return ds.events(spark, sf).groupBy(
        at("$.session_id").alias("has_session"), at("$.k").alias("has_user")).agg(
        F.count("*").alias("row_count"))


@Q.add("P4_membership", "order_id long, order_status str, priority str",
       f"""SELECT order_id, order_status, priority FROM {ORDERS} AS o
           WHERE order_status IN ('F', 'P') AND (priority IS NULL
             OR priority NOT IN ('5-LOW', '4-NOT SPECIFIED'))""")
def p4(spark, sf):
    o = ds.orders(spark, sf)
    return o.filter(F.col("order_status").isin("F", "P")
                    & sc.not_in(F.col("priority"), ["5-LOW", "4-NOT SPECIFIED"])).select(
        "order_id", "order_status", "priority")


@Q.add("P5_like", "customer_id long, email str",
       f"SELECT customer_id, email FROM {CUSTOMERS} AS c WHERE email NOT LIKE '%@%'")
def p5(spark, sf):
    return ds.customers(spark, sf).filter(~F.col("email").like("%@%")).select(
        "customer_id", "email")


@Q.add("P6_ilike", "doc_id long, lang str",
       "SELECT doc_id, lang FROM documents WHERE text ILIKE '%LICENSE%'")
def p6(spark, sf):
    return ds.table(spark, sf, "documents").filter(F.col("text").ilike("%LICENSE%")).select(
        "doc_id", "lang")


@Q.add("P7_case_bucket", "tier str, size_label str, name_label str, row_count long",
       f"""SELECT tier, CASE WHEN balance < 1000 THEN 'Low' WHEN balance < 5000 THEN 'Middle'
             ELSE 'High' END AS size_label,
           CASE WHEN email LIKE '%@%' THEN 'Has Email' ELSE 'No Email' END AS name_label,
           COUNT(*) AS row_count FROM {CUSTOMERS} AS c GROUP BY 1, 2, 3""")
def p7(spark, sf):
    size = sc.bucket_label(F.col("balance"), [(1000, "Low"), (5000, "Middle")], "High")
    named = F.when(F.col("email").like("%@%"), "Has Email").otherwise("No Email")
    return ds.customers(spark, sf).groupBy("tier", size.alias("size_label"),
                                           named.alias("name_label")).agg(
        F.count("*").alias("row_count"))


_SPANS = ["1 days", "7 days", "30 days", "60 days", "90 days", "12 months"]


@Q.add("P8_relative_dates", "span str, orders long",
       " UNION ALL ".join(
           f"SELECT '{s}' AS span, COUNT(*) AS orders FROM orders "
           f"WHERE o_orderdate >= {LAST_DAY} - INTERVAL '{s}'" for s in _SPANS))
def p8(spark, sf):
    # One scan of the widest span; each row lands in every span that holds it.
    last = ds.last_order_day(spark, sf)
    o = windows.recent(ds.table(spark, sf, "orders"), "o_orderdate", last, "12 months")
    hit = [F.when(F.col("o_orderdate") >= last - F.expr(f"INTERVAL {s}"), F.lit(s))
           for s in _SPANS]
    return o.select(F.explode(F.array_compact(F.array(*hit))).alias("span")).groupBy(
        "span").agg(F.count("*").alias("orders"))


@Q.add("P9_having", "product_name str, big_lines long",
       f"""SELECT product_name, SUM(CASE WHEN total_amount > 90000 THEN 1 ELSE 0 END) AS big_lines
           FROM {LINES} AS l GROUP BY 1
           HAVING SUM(CASE WHEN total_amount > 90000 THEN 1 ELSE 0 END) > 0""")
def p9(spark, sf):
    big = ds.order_lines(spark, sf).withColumn("total_amount", F.when(
        F.col("total_amount") > 90000, F.lit(1).cast("decimal(12,2)")))
    return ds.line_sums(spark, sf, "product_name", lines=big).groupBy("product_name").agg(
        F.sum("total_amount").alias("big_lines")).filter("big_lines > 0")


@Q.add("P10_dropdown_filter", "domain str, item_count long, total_cost dbl",
       f"""SELECT domain, COUNT(*) AS item_count, SUM(cost) AS total_cost FROM {ITEMS} AS i
           WHERE domain IN (SELECT MIN(domain) FROM {ITEMS} AS j) GROUP BY 1""")
def p10(spark, sf):
    items = ds.items(spark, sf)
    options = items.select("domain").distinct()
    picked = options.agg(F.min("domain")).scalar()
    return items.filter(F.col("domain") == picked).groupBy("domain").agg(
        F.count("*").alias("item_count"), F.sum("cost").alias("total_cost"))


@Q.add("P11_bound_parameters", "order_date str, order_status str, revenue dbl",
       f"""SELECT order_date, order_status, SUM(total_amount) AS revenue FROM {ORDERS} AS o
           WHERE order_date >= DATE '1996-03-01' AND order_date <= DATE '1996-09-30'
           AND order_status = 'O' GROUP BY 1, 2""")
def p11(spark, sf):
    return bound_query(
        spark,
        """SELECT order_date, order_status, sum(total_amount) AS revenue FROM {orders}
           WHERE order_date BETWEEN :first_day AND :last_day AND order_status = :picked
           GROUP BY order_date, order_status ORDER BY order_date, revenue DESC""",
        {"first_day": datetime.date(1996, 3, 1), "last_day": datetime.date(1996, 9, 30),
         "picked": "O"}, orders=ds.orders(spark, sf))


@Q.add("P12_composed_query", "priority str, order_count long, revenue dbl",
       f"""SELECT priority, COUNT(*) AS order_count, SUM(total_amount) AS revenue
           FROM {ORDERS} AS o WHERE total_amount > 100000 AND order_status <> 'F' GROUP BY 1""")
def p12(spark, sf):
    return agg.composed(ds.orders(spark, sf), ["total_amount > 100000", "order_status <> 'F'"],
                        ["priority"], [F.count("*").alias("order_count"),
                                       F.sum("total_amount").alias("revenue")])


# Scalar functions ------------------------------------------------------------------------------


@Q.add("F1_round", "order_id long, rounded dbl, thousands dbl",
       f"""SELECT order_id, ROUND(total_amount, 1) AS rounded,
           FLOOR(total_amount / 1000) AS thousands FROM {ORDERS} AS o""")
def f1(spark, sf):
    return ds.orders(spark, sf).select(
        "order_id", F.round("total_amount", 1).alias("rounded"),
        F.floor(F.col("total_amount") / 1000).alias("thousands"))


@Q.add("F2_null_default", "country str, big_order_revenue dbl",
       f"""SELECT c.country, COALESCE(SUM(o.total_amount), 0) AS big_order_revenue
           FROM {CUSTOMERS} c LEFT JOIN (SELECT * FROM {ORDERS} AS x WHERE total_amount > 499000) o
           ON c.customer_id = o.customer_id GROUP BY 1""")
def f2(spark, sf):
    big = ds.orders(spark, sf).filter("total_amount > 499000").groupBy("customer_id").agg(
        F.sum("total_amount").alias("amount"))
    return ds.customers(spark, sf, country=True).join(big, "customer_id", "left").groupBy("country").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).alias("big_order_revenue"))


@Q.add("F3_safe_division", "event_type str, error_share dbl, per_error dbl",
       f"""SELECT event_type,
           SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::DOUBLE
             / NULLIF(COUNT(*), 0) * 100 AS error_share,
           COUNT(*)::DOUBLE / NULLIF(SUM(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 0)
             AS per_error FROM {EVENTS} AS e GROUP BY 1""")
def f3(spark, sf):
    errors, rows = F.count_if(F.col("event_type") == "error"), F.count("*")
    return ds.events(spark, sf).groupBy("event_type").agg(
        (sc.ratio(errors, rows) * 100).alias("error_share"),
        sc.ratio(rows, errors).alias("per_error"))


@Q.add("F4_absolute", "customer_id long, owed dbl",
       f"SELECT customer_id, ABS(balance) AS owed FROM {CUSTOMERS} AS c WHERE balance < 0")
def f4(spark, sf):
    return ds.customers(spark, sf).filter("balance < 0").select(
        "customer_id", F.abs("balance").alias("owed"))


@Q.add("F5_casts", "event_id long, k long, k_text str, day str, whole dbl",
       f"""SELECT event_id, CAST(json_extract_string(event_data, '$.k') AS INTEGER) AS k,
           CAST(user_id AS VARCHAR) AS k_text,
           CAST(strftime(event_time, '%Y-%m-%d') AS DATE) AS day, FLOOR(value) AS whole
           FROM {EVENTS} AS e""")
def f5(spark, sf):
    return ds.events(spark, sf).select(
        "event_id", sc.json_int("event_data", "$.k").alias("k"),
        F.col("user_id").cast("string").alias("k_text"),
        F.date_format("event_time", "yyyy-MM-dd").try_cast("date").alias("day"),
        F.floor("value").cast("int").alias("whole"))


@Q.add("F6_truncate", "hour ts, day str, month str, row_count long",
       f"""SELECT DATE_TRUNC('hour', event_time) AS hour, CAST(DATE_TRUNC('day', event_time) AS DATE)
           AS day, CAST(DATE_TRUNC('month', event_time) AS DATE) AS month, COUNT(*) AS row_count
           FROM {EVENTS} AS e GROUP BY 1, 2, 3""")
def f6(spark, sf):
    return ds.events(spark, sf).groupBy(
        F.date_trunc("hour", "event_time").alias("hour"),
        sc.trunc_date("day", "event_time").alias("day"),
        sc.trunc_date("month", "event_time").alias("month")).agg(F.count("*").alias("row_count"))


@Q.add("F7_calendar_parts", "order_date str, day_of_week long, week_of_year long",
       f"""SELECT DISTINCT order_date, EXTRACT(DOW FROM order_date) AS day_of_week,
           EXTRACT(WEEK FROM order_date) AS week_of_year FROM {ORDERS} AS o""")
def f7(spark, sf):
    return ds.orders(spark, sf).select("order_date").distinct().select(
        "order_date", sc.day_of_week(F.col("order_date")).alias("day_of_week"),
        F.weekofyear("order_date").alias("week_of_year"))


@Q.add("F8_date_arithmetic", "yesterday str, order_count long",
       f"""SELECT {LAST_DAY} - 1 AS yesterday, COUNT(*) AS order_count FROM {ORDERS} AS o
           WHERE order_date = {LAST_DAY} - 1""")
def f8(spark, sf):
    last = ds.last_order_day(spark, sf)
    yesterday = F.date_sub(last.cast("date"), 1)
    o = ds.table(spark, sf, "orders")
    return o.filter((F.col("o_orderdate") >= last - F.expr("INTERVAL 1 DAY"))
                    & (F.col("o_orderdate") < last)).agg(
        F.count("*").alias("order_count")).select(yesterday.alias("yesterday"), "order_count")


@Q.add("F9_concat", "customer_id long, label str",
       f"SELECT customer_id, 'Customer ' || customer_id || ' from ' || country AS label "
       f"FROM {CUSTOMERS} AS c")
def f9(spark, sf):
    return ds.customers(spark, sf, country=True).select("customer_id", F.concat(
        F.lit("Customer "), F.col("customer_id").cast("string"), F.lit(" from "),
        F.col("country")).alias("label"))


@Q.add("F10_json_extract", "k long, row_count long, total dbl",
       f"""SELECT CAST(json_extract_string(event_data, '$.k') AS INTEGER) AS k,
           COUNT(*) AS row_count, SUM(value) AS total FROM {EVENTS} AS e GROUP BY 1""")
def f10(spark, sf):
    return ds.events(spark, sf).groupBy(sc.json_int("event_data", "$.k").alias("k")).agg(
        F.count("*").alias("row_count"), F.sum("value").alias("total"))


@Q.add("F11_json_defaults", "event_id long, k long, width long",
       f"""SELECT event_id, COALESCE(CAST(json_extract_string(event_data, '$.k') AS BIGINT), 0) AS k,
           COALESCE(CAST(json_extract_string(event_data, '$.width') AS BIGINT), 0) AS width
           FROM {EVENTS} AS e""")
def f11(spark, sf):
    parsed = F.from_json("event_data", "k BIGINT, width BIGINT")
    return ds.events(spark, sf).select("event_id", parsed.alias("p")).select(
        "event_id", F.coalesce("p.k", F.lit(0)).alias("k"),
        F.coalesce("p.width", F.lit(0)).alias("width"))


@Q.add("F12_array_functions", "vec_id long, dims long, head_sum dbl6, label_path str",
       """SELECT vec_id, len(embedding) AS dims,
          list_sum(CAST(embedding[1:10] AS DOUBLE[])) AS head_sum,
          array_to_string(['label', CAST(label AS VARCHAR)], ', ') AS label_path
          FROM embeddings""")
def f12(spark, sf):
    return ds.table(spark, sf, "embeddings").select(
        "vec_id", F.size("embedding").alias("dims"),
        F.aggregate(F.slice("embedding", 1, 10), F.lit(0.0), lambda acc, x: acc + x).alias(
            "head_sum"),
        F.array_join(F.array(F.lit("label"), F.col("label").cast("string")), ", ").alias(
            "label_path"))


@Q.add("F13_text_prefix", "doc_id long, preview str",
       "SELECT doc_id, substr(text, 1, 100) AS preview FROM documents")
def f13(spark, sf):
    return ds.table(spark, sf, "documents").select(
        "doc_id", F.substring("text", 1, 100).alias("preview"))


@Q.add("F14_lower_equality", "id long, text str",
       f"SELECT id, text FROM {ITEMS} AS i WHERE lower(text) = lower('Red WIDGET')")
def f14(spark, sf):
    return ds.items(spark, sf).filter(F.lower("text") == "red widget").select("id", "text")


@Q.add("F15_array_to_rows", "vec_id long, position long, value dbl",
       """SELECT vec_id, UNNEST(range(0, len(embedding))) AS position,
          UNNEST(CAST(embedding AS DOUBLE[])) AS value FROM embeddings""")
def f15(spark, sf):
    return ds.vectors(spark, sf).select(
        F.col("id").alias("vec_id"), F.posexplode("vector").alias("position", "value"))


@Q.add("F16_parse_format_dates", "order_id long, iso str, month_label str",
       f"""SELECT order_id, CAST(strptime(strftime(order_date, '%Y-%m-%d'), '%Y-%m-%d') AS DATE)
           AS iso, strftime(order_date, '%m/%Y') AS month_label FROM {ORDERS} AS o""")
def f16(spark, sf):
    text = F.date_format("order_date", "yyyy-MM-dd")
    return ds.orders(spark, sf).select(
        "order_id", F.to_timestamp(text, "yyyy-MM-dd").cast("date").alias("iso"),
        F.date_format("order_date", "MM/yyyy").alias("month_label"))


_STATUSES = ["Pending", "Shipped", "Delivered", "Cancelled"]


@Q.add("F17_repeatable_random", "customer_id long, known bool, in_range bool, repeated bool",
       f"""SELECT customer_id, TRUE AS known, TRUE AS in_range, TRUE AS repeated
           FROM {CUSTOMERS} AS c""")
def f17(spark, sf):
    # Spark's hash has no SQL twin; range and repeatability of the drawn values have.
    def drawn(rows):
        return rows.select("customer_id", sc.hash_pick(_STATUSES, F.col("customer_id")).alias("picked"),
                           sc.hash_below(100, F.col("customer_id"), F.lit("value")).alias("v"))

    again = drawn(ds.customers(spark, sf).repartition(7, "tier")).select(
        "customer_id", F.struct("picked", "v").alias("again"))
    return drawn(ds.customers(spark, sf)).join(again, "customer_id").select(
        "customer_id", F.col("picked").isin(_STATUSES).alias("known"),
        F.col("v").between(0, 99).alias("in_range"),
        (F.struct("picked", "v") == F.col("again")).alias("repeated"))


_HEX = "instr('0123456789abcdef', substr(h, {p}, 1)) - 1"


@Q.add("F18_hash_bytes", "customer_id long, first_cell dbl, last_cell dbl",
       f"""SELECT customer_id, (({_HEX.format(p=1)}) * 16 + {_HEX.format(p=2)})::DOUBLE / 255
             AS first_cell, (({_HEX.format(p=31)}) * 16 + {_HEX.format(p=32)})::DOUBLE / 255
             AS last_cell
           FROM (SELECT customer_id, md5(customer_name) AS h FROM {CUSTOMERS} AS c) AS x""")
def f18(spark, sf):
    v = sc.md5_vector(F.col("customer_name"), 16)
    return ds.customers(spark, sf).select("customer_id", v.alias("v")).select(
        "customer_id", F.element_at("v", 1).alias("first_cell"),
        F.element_at("v", -1).alias("last_cell"))
