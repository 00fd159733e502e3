"""Complete jobs and extension points (ids E, X)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.operators import joins, quality
from millrace.operators.vectors import append_records
from millrace.plans import etl
from millrace.plans.registry import QuerySet
from millrace.plans.sql_views import CUSTOMERS, EVENTS, ITEMS, LINES, ORDERS, mean
from millrace.sources import datasets as ds, readers, sinks
from millrace.sources.shared import shared_folder

Q = QuerySet()

_ORDER_SCHEMA = ("order_id BIGINT, customer_id BIGINT, order_date DATE, order_status STRING, "
                 "priority STRING, total_amount DECIMAL(12,2)")


@Q.add("E1_configured_job", "destination str, order_status str, order_count long, revenue dbl",
       f"""SELECT d AS destination, order_status, COUNT(*) AS order_count,
           SUM(total_amount) AS revenue FROM {ORDERS} AS o
           CROSS JOIN (VALUES ('parquet'), ('csv')) AS v(d)
           WHERE total_amount > 1000 GROUP BY 1, 2""")
def e1(spark, sf):
    base = shared_folder(spark, "e1")
    ds.orders(spark, sf).write.option("header", True).csv(f"{base}/in")
    etl.run_job(
        spark, {"type": "csv", "path": f"{base}/in", "schema": _ORDER_SCHEMA},
        [lambda df: df.filter("total_amount > 1000"),
         lambda df: df.groupBy("order_status").agg(F.count("*").alias("order_count"),
                                                   F.sum("total_amount").alias("revenue"))],
        [{"type": "parquet", "path": f"{base}/table"}, {"type": "csv", "path": f"{base}/report"}])
    table = etl.extract(spark, {"type": "parquet", "path": f"{base}/table"})
    report = etl.extract(spark, {"type": "csv", "path": f"{base}/report", "schema": table.schema})
    return (table.withColumn("destination", F.lit("parquet"))
            .unionByName(report.withColumn("destination", F.lit("csv"))))


@Q.add("E2_end_to_end", "city str, customer_count long, total_orders long, total_revenue dbl, "
       "avg_order_value dbl, failed_checks long",
       f"""SELECT c.country AS city, COUNT(c.customer_id) AS customer_count,
           COUNT(o.order_id) AS total_orders, COALESCE(SUM(o.total_amount), 0) AS total_revenue,
           COALESCE({mean('o.total_amount', 'COUNT(o.order_id)')}, 0) AS avg_order_value,
           (SELECT CASE WHEN COUNT(*) > 0 THEN 1 ELSE 0 END FROM {CUSTOMERS} AS x
             WHERE email NOT LIKE '%@%') AS failed_checks
           FROM {CUSTOMERS} c LEFT JOIN {ORDERS} o ON c.customer_id = o.customer_id GROUP BY 1""")
def e2(spark, sf):
    base = shared_folder(spark, "e2")
    people, addresses = quality.watched(
        ds.customers(spark, sf, country=True).select("customer_id", "customer_name", "email", "country"),
        {"email format": quality.violations(~F.col("email").like("%@%"))})
    people.write.option("header", True).csv(f"{base}/customers")
    sold, amounts = quality.watched(ds.orders(spark, sf), {
        "order amount positive": quality.violations(F.col("total_amount") <= 0)})
    sold.write.option("header", True).csv(f"{base}/orders")
    customers = readers.read_csv(spark, f"{base}/customers", "customer_id BIGINT, "
                                 "customer_name STRING, email STRING, country STRING")
    orders = readers.read_csv(spark, f"{base}/orders", _ORDER_SCHEMA)
    checks = quality.suite(
        addresses(), amounts(),
        quality.run_checks(customers, {"customer id unique": quality.duplicates("customer_id")}),
        quality.referential_check("order has customer", orders, customers, "customer_id",
                                  "customer_id"))
    failed = checks.agg(F.count_if(~F.col("passed"))).scalar()
    summary = joins.parent_totals(customers, orders, "customer_id", "customer_id", ["country"],
                                  "total_amount").select(
        F.col("country").alias("city"), F.col("joined_rows").alias("customer_count"),
        F.col("child_count").alias("total_orders"),
        F.coalesce("total", F.lit(0)).alias("total_revenue"),
        F.coalesce("mean", F.lit(0.0)).alias("avg_order_value"))
    return sinks.write_csv_report(summary, f"{base}/reports/city_summary").withColumn(
        "failed_checks", failed)


@Q.add("E3_load_and_embed", "destination str, row_count long, dims long",
       f"""SELECT 'table' AS destination, COUNT(*) AS row_count, 0 AS dims FROM {ITEMS} AS i
           WHERE complexity > 10 UNION ALL SELECT 'vectors', COUNT(*), 128 FROM {ITEMS} AS i
           WHERE complexity > 10""")
def e3(spark, sf):
    base = shared_folder(spark, "e3")

    def embed(df):
        return append_records(None, df.select(
            "id", "text", "category", F.lit(None).cast("array<double>").alias("vector"),
            F.col("id").alias("arrival")), "arrival")

    etl.run_job(spark, {"type": "parquet", "path": f"{sf}/part.parquet"},
                [ds.as_items, lambda df: df.filter("complexity > 10")],
                [{"type": "parquet", "path": f"{base}/table"},
                 {"type": "vectors", "path": f"{base}/vectors", "transform": embed}])
    count = lambda path, name, dims: spark.read.parquet(path).agg(
        F.count("*").alias("row_count"), dims.alias("dims")).select(
        F.lit(name).alias("destination"), "row_count", "dims")
    return count(f"{base}/table", "table", F.lit(0)).union(
        count(f"{base}/vectors", "vectors", F.max(F.size("vector"))))


@Q.add("E4_export", "data_set str, row_count long, verified bool",
       """SELECT 'customer' AS data_set, COUNT(*) AS row_count, TRUE AS verified FROM customer
          UNION ALL SELECT 'orders', COUNT(*), TRUE FROM orders""")
def e4(spark, sf):
    root = shared_folder(spark, "exports")
    made = [etl.export(ds.table(spark, sf, name), root, name, "export-1",
                       datetime.datetime(2024, 5, 1)) for name in ("customer", "orders")]
    return made[0].unionByName(made[1])


@Q.add("E4_retention", "export_id str, row_count long",
       """SELECT 'new' AS export_id, COUNT(*) AS row_count FROM supplier""")
def e4_retention(spark, sf):
    root, supplier = shared_folder(spark, "retention"), ds.table(spark, sf, "supplier")
    for export_id, day in (("old", 1), ("new", 20)):
        etl.export(supplier, root, "supplier", export_id, datetime.datetime(2024, 5, day))
    now = F.lit("2024-05-25 00:00:00").cast("timestamp")
    return etl.kept_exports(spark.read.parquet(f"{root}/manifest"), now, 10)


@Q.add("E4_expired_removed", "export_id str, listed long, row_count long",
       """SELECT 'new' AS export_id, 1 AS listed, COUNT(*) AS row_count FROM supplier""")
def e4_expired(spark, sf):
    """Two exports expire and go; what is still listed and what is still on disk are the third."""
    root, supplier = shared_folder(spark, "expired"), ds.table(spark, sf, "supplier")
    for export_id, day in (("older", 1), ("old", 10), ("new", 20)):
        etl.export(supplier, root, "supplier", export_id, datetime.datetime(2024, 5, day))
    etl.remove_expired(spark, root, F.lit("2024-05-25 00:00:00").cast("timestamp"), 10)
    listed = etl.live_exports(spark, root).groupBy("export_id").agg(F.count("*").alias("listed"))
    on_disk = spark.read.parquet(f"{root}/*/supplier").groupBy(
        F.element_at(F.split("_metadata.file_path", "/"), -3).alias("export_id")).agg(F.count("*").alias("row_count"))
    return listed.join(on_disk, "export_id", "full")


@Q.add("E5_restore", "customer_id long, name str, balance dbl",
       f"""SELECT customer_id, customer_name AS name, balance FROM {CUSTOMERS} AS c""")
def e5(spark, sf):
    root = shared_folder(spark, "restore")
    etl.export(ds.table(spark, sf, "customer"), root, "customer", "export-1",
               datetime.datetime(2024, 5, 1))
    back = etl.restore(spark, root, "customer", "export-1", f"{root}/restored")
    return back.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
                       F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))


@Q.add("X1_files_as_table", "file_name str, in_use bool",
       """SELECT 'orders.parquet' AS file_name, COUNT(*) > 0 AS in_use FROM orders""")
def x1(spark, sf):
    listed = readers.list_files(spark, sf, "ord*.parquet").select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"))
    used = ds.table(spark, sf, "orders").groupBy(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name")).agg(
        (F.count("*") > 0).alias("in_use"))
    return listed.join(used, "file_name")


@Q.add("X1_sql_table_function", "event_type str, key str, row_count long, total long",
       f"""SELECT event_type, key, COUNT(*) AS row_count,
           SUM(CAST(json_extract_string(event_data, '$.' || key) AS BIGINT)) AS total FROM (
             SELECT event_type, event_data, UNNEST(json_keys(event_data)) AS key FROM {EVENTS} AS e) AS k
           GROUP BY 1, 2""")
def x1_sql(spark, sf):
    tables.register(spark)
    return spark.sql("""SELECT event_type, p.key, COUNT(*) AS row_count, SUM(CAST(p.value AS BIGINT)) AS total
                        FROM {events} AS e, LATERAL json_pairs(e.event_data) AS p GROUP BY 1, 2""",
                     events=ds.events(spark, sf))


@Q.add("X2_batch_scoring", "id long, prediction dbl6",
       f"""SELECT id, (SELECT regr_intercept(CAST(cost AS DOUBLE), complexity) FROM {ITEMS} AS f)
           + complexity * (SELECT regr_slope(CAST(cost AS DOUBLE), complexity) FROM {ITEMS} AS g) AS prediction
           FROM {ITEMS} AS i""")
def x2(spark, sf):
    """Prices by a regression that is fitted, stored, loaded again and applied."""
    base, items = shared_folder(spark, "x2"), ds.items(spark, sf)
    etl.fit_and_store(items, ["complexity"], "cost", f"{base}/model")
    sinks.append_parquet(etl.score_stored(items, "id", f"{base}/model"), f"{base}/predictions")
    return spark.read.parquet(f"{base}/predictions")


@Q.add("X3_transformation_list", "product_category str, big_lines long, revenue dbl",
       f"""SELECT product_category, COUNT(*) AS big_lines, SUM(total_amount) AS revenue
           FROM {LINES} AS l WHERE total_amount > 50000 GROUP BY 1""")
def x3(spark, sf):
    return etl.apply_all(ds.order_lines(spark, sf), [
        lambda df: df.filter("total_amount > 50000"),
        lambda df: ds.line_sums(spark, sf, "product_category", lines=df),
        lambda df: df.groupBy("product_category").agg(F.sum("line_count").alias("big_lines"),
                                                      F.sum("total_amount").alias("revenue")),
        lambda df: df.orderBy(F.desc("revenue"), "product_category")])
