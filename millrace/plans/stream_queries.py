"""Streaming (ids R): the event and line tables arrive as file streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.scalars import json_int, md5_vector, money
from millrace.operators.aggregates import kpi_totals
from millrace.plans.registry import QuerySet
from millrace.plans.sql_views import EVENTS, ORDERS, SALES
from millrace.sources import datasets as ds
from millrace.sources.shared import shared_folder
from millrace.streaming import events as st

Q = QuerySet()


_BATCHES = 3


def _arrivals(spark, table, key, late=True):
    """Deal a table into files as they would come in; yield a stream of each arrival.

    The first arrival has files enough for several batches. Then, where
    ``late`` rows are wanted, a quarter of all rows, from all times, arrives in
    files of its own, and the stream goes on from its checkpoint.
    """
    base, deal = shared_folder(spark, "arrivals"), F.pmod(F.xxhash64(*key), F.lit(_BATCHES + 1))
    rows = table.withColumn("deal", deal if late else deal % _BATCHES)
    rows.where(F.col("deal") < _BATCHES).write.partitionBy("deal").parquet(f"{base}/first")
    files = len(spark.read.parquet(f"{base}/first").inputFiles())
    yield st.file_stream(spark, f"{base}/*/*", table.schema, -(-files // _BATCHES))
    if late:
        rows.where(F.col("deal") == _BATCHES).write.partitionBy("deal").parquet(f"{base}/late")
        yield st.file_stream(spark, f"{base}/*/*", table.schema, -(-files // _BATCHES))


def _event_streams(spark, sf, late=True):
    for raw in _arrivals(spark, ds.table(spark, sf, "events"), ["event_id"], late):
        yield raw.select("event_id", "event_type", F.col("props").alias("event_data"),
                         F.col("ts").alias("event_time"), money("value").alias("value"))


def _run(streams, path, write):
    for stream in streams:  # the second starts where the first one's checkpoint ends
        st.run_batches(stream, path, write)


@Q.add("R1_ingest", "event_type str, row_count long, ids long, total dbl",
       f"""SELECT event_type, COUNT(*) AS row_count, COUNT(DISTINCT event_id) AS ids,
           SUM(value) AS total FROM {EVENTS} AS e GROUP BY 1""")
def r1(spark, sf):
    path = shared_folder(spark, "r1")
    for events in _event_streams(spark, sf):
        messages = events.select(F.to_json(F.struct(
            "event_id", "event_type", "event_data", "value")).alias("value"))
        st.ingest(messages, "event_id BIGINT, event_type STRING, event_data STRING, "
                  "value DECIMAL(12,2)", path)
    return st.stored(spark, path).groupBy("event_type").agg(
        F.count("*").alias("row_count"), F.countDistinct("event_id").alias("ids"),
        F.sum("value").alias("total"))


_ROLLING_SQL = f"""SELECT DATE_TRUNC('hour', event_time) - h * INTERVAL 1 HOUR AS window_start,
    event_type, COUNT(*) AS event_count FROM {EVENTS} AS e CROSS JOIN range(24) AS s(h)
    GROUP BY 1, 2"""
_ROLLING_COLUMNS = "window_start ts, event_type str, event_count long"


@Q.add("R2_rolling_counts", _ROLLING_COLUMNS, _ROLLING_SQL)
def r2(spark, sf):
    path = shared_folder(spark, "r2")
    _run(_event_streams(spark, sf, late=False), path, st.hourly_batches(path))
    return st.rolling_counts(st.merged(st.stored(spark, path), ["hour", "event_type"],
                                       ["event_count"]))


@Q.add("R2_rolling_counts_with_late_rows", _ROLLING_COLUMNS, _ROLLING_SQL)
def r2_late(spark, sf):
    """As before, with a quarter of all rows in files that arrive when their hours are long over."""
    path = shared_folder(spark, "r2-late")
    _run(_event_streams(spark, sf), path, st.hourly_batches(path))
    return st.rolling_counts(st.merged(st.stored(spark, path), ["hour", "event_type"],
                                       ["event_count"]))


_DAY_SQL = f"""SELECT CAST(event_time AS DATE) AS analysis_date, COUNT(*) AS total_events,
    COUNT(DISTINCT CAST(json_extract_string(event_data, '$.k') AS BIGINT)) AS unique_users,
    SUM(CASE WHEN json_extract_string(event_data, '$.session_id') IS NOT NULL THEN 1.0 ELSE 0.0 END)
      ::DOUBLE / COUNT(*) AS session_share FROM {EVENTS} AS e GROUP BY 1"""


@Q.add("R3_day_stats", "analysis_date str, total_events long, unique_users long, "
       "session_share dbl", _DAY_SQL)
def r3(spark, sf):
    path = shared_folder(spark, "r3")
    _run(_event_streams(spark, sf), path, st.user_day_batches(path))
    return st.day_stats(st.merged(st.stored(spark, path), ["analysis_date", "user_key"],
                                  ["events", "with_session"]))


@Q.add("R4_summary_log", "total_events long, unique_users long, total dbl",
       f"""SELECT COUNT(*) AS total_events, COUNT(DISTINCT CAST(json_extract_string(event_data,
           '$.k') AS BIGINT)) AS unique_users, SUM(value) AS total FROM {EVENTS} AS e""")
def r4(spark, sf):
    path = shared_folder(spark, "r4")

    def summary(user_rows):
        return st.merged(user_rows, ["user_key"], ["events", "total"]).agg(
            F.sum("events").alias("total_events"), F.count("user_key").alias("unique_users"),
            F.sum("total").alias("total"))

    _run(_event_streams(spark, sf), path, st.summary_log(
        [json_int("event_data", "$.k").alias("user_key")],
        [F.count("*").alias("events"), F.sum("value").alias("total")], summary, path))
    log = st.stored(spark, path)
    return log.orderBy(F.desc("created_at"), F.desc("batch_id")).limit(1)


@Q.add("R5_serve_and_vectors", "destination str, row_count long, ids long",
       f"""SELECT 'serve' AS destination, COUNT(*) AS row_count, COUNT(DISTINCT event_id) AS ids
           FROM {EVENTS} AS e UNION ALL SELECT 'vectors', COUNT(*), COUNT(DISTINCT event_id)
           FROM {EVENTS} AS e WHERE event_type = 'purchase'""")
def r5(spark, sf):
    path = shared_folder(spark, "r5")

    def transform(batch):
        return batch.withColumn("text", F.concat_ws(" ", "event_type", "event_data"))

    def embed(rows):
        return rows.select("event_id", "text", md5_vector(F.col("text")).alias("vector"))

    _run(_event_streams(spark, sf), path, st.serve_and_refresh(
        transform, F.col("event_type") == "purchase", embed, path))
    vectors = st.newest_per_key(st.stored(spark, f"{path}/vectors"), ["event_id"])
    count = lambda df, name: df.agg(
        F.count("*").alias("row_count"), F.countDistinct("event_id").alias("ids")).select(
        F.lit(name).alias("destination"), "row_count", "ids")
    return count(st.stored(spark, f"{path}/serve"), "serve").union(count(vectors, "vectors"))


def _sales_store(spark, sf, path, arrived=None):
    """Order lines as they come in, stored batch by batch; a quarter of them arrives late."""
    parts = ds.table(spark, sf, "part").select("p_partkey",
                                               F.col("p_type").alias("product_category"))
    heads = ds.orders(spark, sf).select("order_id", F.col("order_date").alias("batch_date"))

    def enrich(batch):
        return batch.join(parts, "p_partkey").join(heads, "order_id")

    lines = ds.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    for raw in _arrivals(spark, lines, ["l_orderkey", "l_linenumber"]):
        st.run_batches(raw.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("p_partkey"), "l_linenumber",
            money("l_extendedprice").alias("total_amount")), path, st.sales_batches(enrich, path, arrived))
    return st.stored(spark, path)


@Q.add("R6_sales_batches", "batch_date str, product_category str, new_orders long, "
       "new_revenue dbl, avg_new_order_value dbl", f"SELECT * FROM {SALES} AS s")
def r6(spark, sf):
    return st.sales(_sales_store(spark, sf, shared_folder(spark, "r6")))


@Q.add("R6_sales_big_number", "total_new_revenue dbl, total_new_orders long, "
       "avg_avg_new_order_value dbl6",
       f"""SELECT SUM(new_revenue) AS total_new_revenue, SUM(new_orders) AS total_new_orders,
           AVG(avg_new_order_value) AS avg_avg_new_order_value FROM {SALES} AS s
           WHERE batch_date = (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders)""")
def r6_reader(spark, sf):
    sales = st.sales(_sales_store(spark, sf, shared_folder(spark, "r6")))
    today = sales.filter(F.col("batch_date") == ds.last_order_day(spark, sf).cast("date"))
    return kpi_totals(today, ["new_revenue", "new_orders"], "avg_new_order_value")


@Q.add("A8_intraday_sales", "hour ts, new_orders long, new_revenue dbl",
       f"""SELECT CAST(o.order_date AS TIMESTAMP) + l_linenumber * INTERVAL 1 HOUR AS hour,
           COUNT(DISTINCT o.order_id) AS new_orders, SUM(CAST(l_extendedprice AS DECIMAL(12,2))) AS new_revenue
           FROM {ORDERS} AS o JOIN lineitem ON l_orderkey = o.order_id JOIN part ON p_partkey = l_partkey
           WHERE o.order_date = (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders) GROUP BY 1""")
def a8_sales(spark, sf):
    """The newest batch day by arrival hour; a line counts as arrived as many hours into it as its number."""
    path = shared_folder(spark, "a8")
    arrived = F.col("batch_date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("l_linenumber").cast("int"))
    rows = _sales_store(spark, sf, path, arrived)
    return st.hourly_sales(rows, ds.last_order_day(spark, sf).cast("date"))
