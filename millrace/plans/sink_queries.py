"""Sinks and table creation (ids K): write, read back, compare."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions.scalars import json_has, json_int
from millrace.operators import aggregates as agg, joins
from millrace.plans.registry import QuerySet
from millrace.plans.sql_views import CUSTOMERS, EVENTS, ITEMS, LINES, ORDERS
from millrace.sources import datasets as ds, sinks
from millrace.sources.shared import shared_folder

Q = QuerySet()

_CATEGORY_SQL = f"""SELECT product_category, COUNT(*) AS order_count, SUM(total_amount) AS
    total_revenue FROM {LINES} AS l GROUP BY 1"""
_CATEGORY_COLUMNS = "product_category str, order_count long, total_revenue dbl"


def _category_revenue(spark, sf):
    return agg.revenue_by(ds.line_sums(spark, sf, "product_category"), ["product_category"],
                          mean_name=None, rows="line_count")


def _new_name(label):
    return f"millrace_{label}_{uuid.uuid4().hex[:12]}"


@Q.add("K1_overwrite_parquet", _CATEGORY_COLUMNS, _CATEGORY_SQL)
def k1(spark, sf):
    return sinks.overwrite_parquet(_category_revenue(spark, sf), shared_folder(spark, "k1"))


@Q.add("K2_csv_report", "city str, customer_count long, total_revenue dbl",
       f"""SELECT c.country AS city, COUNT(c.customer_id) AS customer_count,
           COALESCE(SUM(o.total_amount), 0) AS total_revenue FROM {CUSTOMERS} c
           LEFT JOIN {ORDERS} o ON c.customer_id = o.customer_id GROUP BY 1""")
def k2(spark, sf):
    report = joins.parent_totals(ds.customers(spark, sf, country=True), ds.orders(spark, sf), "customer_id",
                                 "customer_id", ["country"], "total_amount").select(
        F.col("country").alias("city"), F.col("joined_rows").alias("customer_count"),
        F.coalesce("total", F.lit(0)).alias("total_revenue"))
    return sinks.write_csv_report(report, shared_folder(spark, "k2"))


@Q.add("K3_append_results", "id long, prediction dbl, batch long",
       f"""SELECT id, cost * 2 AS prediction, 1 AS batch FROM {ITEMS} AS i WHERE domain = 'PROMO'
           UNION ALL SELECT id, cost * 2, 2 FROM {ITEMS} AS i WHERE domain IS DISTINCT FROM 'PROMO'""")
def k3(spark, sf):
    path = shared_folder(spark, "k3")
    scored = ds.items(spark, sf).select("id", (F.col("cost") * 2).alias("prediction"), "domain")
    promo = F.col("domain").eqNullSafe("PROMO")  # never null, so both sides hold every row
    sinks.append_parquet(scored.filter(promo).withColumn("batch", F.lit(1)), path)
    sinks.append_parquet(scored.filter(~promo).withColumn("batch", F.lit(2)), path)
    return spark.read.parquet(path)


@Q.add("K4_partitioned_tables", "layout str, part str, row_count long",
       f"""SELECT 'identity' AS layout, order_status AS part, COUNT(*) AS row_count
           FROM {ORDERS} AS o GROUP BY 2 UNION ALL
           SELECT 'day', CAST(CAST(event_time AS DATE) AS VARCHAR), COUNT(*)
           FROM {EVENTS} AS e GROUP BY 2 UNION ALL
           SELECT 'bucket', 'rows', COUNT(*) FROM {CUSTOMERS} AS c""")
def k4(spark, sf):
    by_status = sinks.write_partitioned(ds.orders(spark, sf), shared_folder(spark, "k4-status"),
                                        ["order_status"])
    by_day = sinks.write_partitioned(sinks.by_day(ds.events(spark, sf), "event_time"),
                                     shared_folder(spark, "k4-day"), ["event_day"])
    bucketed = sinks.save_bucketed(ds.customers(spark, sf), _new_name("users"),
                                   shared_folder(spark, "k4-bucket"), "customer_id", 16)

    def count(df, layout, part):
        return df.groupBy(part.cast("string").alias("part")).agg(
            F.count("*").alias("row_count")).select(F.lit(layout).alias("layout"), "part",
                                                    "row_count")

    return (count(by_status, "identity", F.col("order_status"))
            .union(count(by_day, "day", F.col("event_day")))
            .union(count(bucketed, "bucket", F.lit("rows"))))


@Q.add("K5_create_then_append", "priority str, row_count long",
       f"SELECT priority, COUNT(*) AS row_count FROM {ORDERS} AS o GROUP BY 1")
def k5(spark, sf):
    o, table, path = ds.orders(spark, sf), _new_name("orders"), shared_folder(spark, "k5")
    small = F.coalesce(F.col("total_amount") < 250000, F.lit(False))  # never null: both sides hold every row
    sinks.create_or_append(o.filter(small), table, path)
    sinks.create_or_append(o.filter(~small), table, path)
    return spark.table(table).groupBy("priority").agg(F.count("*").alias("row_count"))


@Q.add("K6_replace_table", _CATEGORY_COLUMNS, _CATEGORY_SQL)
def k6(spark, sf):
    return sinks.replace_table(_category_revenue(spark, sf), _new_name("revenue"),
                               shared_folder(spark, "k6"))


@Q.add("K7_dashboard_view", "product_category str, month str, orders long, revenue dbl",
       f"""SELECT product_category, CAST(DATE_TRUNC('month', order_date) AS DATE) AS month,
           COUNT(*) AS orders, SUM(total_amount) AS revenue FROM {LINES} AS l GROUP BY 1, 2""")
def k7(spark, sf):
    sums = ds.line_sums(spark, sf, "product_category", "order_date")
    summary = agg.revenue_by(
        sums, ["product_category", F.date_trunc("month", "order_date").cast("date")
                .alias("month")], count_name="orders", total_name="revenue", mean_name=None,
        rows="line_count")
    return sinks.replace_view(spark, "millrace_sales_summary", summary)


@Q.add("K8_guarded_append", "total_events long, unique_users long, session_share dbl",
       f"""SELECT COUNT(*) AS total_events,
           COUNT(DISTINCT CAST(json_extract_string(event_data, '$.k') AS BIGINT)) AS unique_users,
           AVG(CASE WHEN json_extract_string(event_data, '$.session_id') IS NOT NULL THEN 1.0
             ELSE 0.0 END) AS session_share FROM {EVENTS} AS e""")
def k8(spark, sf):
    path, e = shared_folder(spark, "k8"), ds.events(spark, sf)

    def summary(rows):
        return rows.agg(F.count("*").alias("total_events"),
                        F.countDistinct(json_int("event_data", "$.k")).alias("unique_users"),
                        F.avg(json_has("event_data", "$.session_id")).alias("session_share"))

    sinks.append_if_any(summary(e), "total_events", path)
    sinks.append_if_any(summary(e.filter("event_type = 'absent'")), "total_events", path)
    return spark.read.parquet(path)


@Q.add("K9_named_metrics", "metric_name str, metric_value dbl",
       f"""SELECT 'orders' AS metric_name, COUNT(*)::DECIMAL(14,2) AS metric_value
           FROM {ORDERS} AS o UNION ALL SELECT 'revenue', SUM(total_amount) FROM {ORDERS} AS o""")
def k9(spark, sf):
    path, o = shared_folder(spark, "k9"), ds.orders(spark, sf)
    value = lambda name, c: F.struct(F.lit(name).alias("metric_name"),
                                     c.cast("decimal(20,2)").alias("metric_value"))
    metrics = o.agg(F.count("*").alias("n"), F.sum("total_amount").alias("t")).select(
        F.inline(F.array(value("orders", F.col("n")), value("revenue", F.col("t"))))
    ).withColumn("created_at", F.current_timestamp())
    sinks.append_parquet(metrics.filter("metric_name = 'orders'"), path)
    sinks.append_new_keys(metrics, spark.read.parquet(path), ["metric_name"], path)
    return spark.read.parquet(path)


@Q.add("K10_fan_out", "destination str, product_category str, total_revenue dbl",
       f"""SELECT d AS destination, product_category, SUM(total_amount) AS total_revenue
           FROM {LINES} AS l CROSS JOIN (VALUES ('table'), ('report')) AS v(d) GROUP BY 1, 2""")
def k10(spark, sf):
    table, report = shared_folder(spark, "k10-table"), shared_folder(spark, "k10-report")
    sinks.fan_out(_category_revenue(spark, sf),
                  lambda df: sinks.overwrite_parquet(df, table),
                  lambda df: sinks.write_csv_report(df, report))
    back = spark.read.parquet(table)
    rows = spark.read.option("header", True).schema(back.schema).csv(report)
    return (back.withColumn("destination", F.lit("table"))
            .union(rows.withColumn("destination", F.lit("report"))))
