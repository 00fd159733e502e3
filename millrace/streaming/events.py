"""Structured Streaming jobs over event and sales streams.

Every job takes a streaming frame and a folder, runs until its trigger ends and
leaves Parquet behind. Batches are written to a folder named after their id and
overwrite it when they are repeated after a failure, so each result counts once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from millrace.functions.scalars import json_has, json_int, ratio
from millrace.operators.ranking import top_n_per_group

LATENESS = "1 hour"


def file_stream(spark: SparkSession, path: str, schema: StructType | str,
                files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files under a path as an unbounded table.

    The path may be a pattern. A plain path is given to Spark as a pattern that
    matches it alone: a pattern may name one file as well as a folder, a plain
    stream path only a folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path if "*" in path else f"{path[:-1]}[{path[-1]}]")


def with_event_time(df: DataFrame, column: str, lateness: str = LATENESS) -> DataFrame:
    """Zoned event time with a watermark, which bounds the state of the windows below.

    Rows later than the watermark are left out of windows that are already closed.
    """
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def run_batches(stream: DataFrame, path: str, write: Callable[[DataFrame, int], None],
                mode: str = "append", interval: str | None = None) -> StreamingQuery:
    """Hand every micro-batch to ``write``; all available input once, or every ``interval``."""
    writer = (stream.writeStream.outputMode(mode).foreachBatch(write)
              .option("checkpointLocation", f"{path}/checkpoint"))
    trigger = ({"processingTime": interval} if interval else {"availableNow": True})
    query = writer.trigger(**trigger).start()
    if not interval:
        query.awaitTermination()
    return query


def store_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that replaces the folder of its own batch id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
    return write


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows")


def newest_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The latest version of each key of a store that updates were appended to."""
    newest = top_n_per_group(df, list(keys), [F.desc("batch_id")], 1, F.col("batch_id"), "_newest")
    return newest.select(*[c for c in df.columns if c != "batch_id"])


def ingest(messages: DataFrame, schema: StructType | str, path: str) -> None:
    """JSON messages (column ``value``) to typed rows with arrival time, appended once each.

    The file sink keeps its own log of finished batches. The id comes with the
    message; a message without one gets a hash of its text.
    """
    parsed = messages.select("value", F.from_json("value", schema).alias("m")).select(
        "m.*", F.xxhash64("value").alias("message_hash"),
        F.current_timestamp().alias("arrived_at"))
    (parsed.writeStream.format("parquet").outputMode("append")
     .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
     .start(f"{path}/rows").awaitTermination())


def hourly_counts(events: DataFrame) -> DataFrame:
    """Events per type and hour as stream state: one row per pair, not 24 as sliding windows keep.

    Rows that arrive more than ``LATENESS`` after a window closed are not in it;
    ``hourly_batches`` counts those too.
    """
    return (with_event_time(events, "event_time")
            .groupBy(F.window("event_time", "1 hour").alias("w"), "event_type")
            .agg(F.count("*").alias("event_count"))
            .select(F.col("w.start").alias("hour"), "event_type", "event_count"))


def rolling_counts(hours: DataFrame, length: int = 24) -> DataFrame:
    """Sliding windows of ``length`` hours, one starting every hour, from hourly counts."""
    starts = F.sequence(F.col("hour") - F.make_dt_interval(hours=F.lit(length - 1)),
                        F.col("hour"), F.expr("INTERVAL 1 HOUR"))
    return (hours.select(F.explode(starts).alias("window_start"), "event_type", "event_count")
            .groupBy("window_start", "event_type")
            .agg(F.sum("event_count").alias("event_count")))


def partial_batches(keys: Sequence[Column], sums: Sequence[Column], path: str
                    ) -> Callable[[DataFrame, int], None]:
    """A batch writer that stores each batch's own sums per key.

    Sums of batches add up, so no state is kept between them and no late row is
    ever left out; ``merged`` adds them when they are read.
    """
    store = store_batch(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        store(batch.groupBy(*keys).agg(*sums), batch_id)
    return write


def merged(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The sums per key over all stored batches."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def hourly_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Events per type and hour, batch by batch."""
    return partial_batches([F.date_trunc("hour", "event_time").alias("hour"), F.col("event_type")],
                           [F.count("*").alias("event_count")], path)


def user_day_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Events and session flags per day and user, batch by batch.

    A stream cannot count distinct values exactly. One row per (day, user) makes
    the number of users a row count, and spreads a busy day over its users.
    """
    return partial_batches(
        [F.col("event_time").cast("date").alias("analysis_date"),
         json_int("event_data", "$.k").alias("user_key")],
        [F.count("*").alias("events"),
         F.sum(json_has("event_data", "$.session_id")).alias("with_session")], path)


def day_stats(user_rows: DataFrame) -> DataFrame:
    """Totals, distinct users and share of events with a session, per day."""
    return user_rows.groupBy("analysis_date").agg(
        F.sum("events").alias("total_events"), F.count("user_key").alias("unique_users"),
        ratio(F.sum("with_session"), F.sum("events")).alias("session_share"))


def approximate_day_stats(events: DataFrame) -> DataFrame:
    """Day totals with an estimated user count, in one stateful aggregate."""
    return (with_event_time(events, "event_time").groupBy(F.window("event_time", "1 day").alias("w"))
            .agg(F.count("*").alias("total_events"),
                 F.approx_count_distinct(json_int("event_data", "$.k")).alias("approx_users"))
            .select(F.col("w.start").cast("date").alias("analysis_date"), "total_events",
                    "approx_users"))


def summary_log(keys: Sequence[Column], sums: Sequence[Column],
                summary: Callable[[DataFrame], DataFrame], path: str
                ) -> Callable[[DataFrame, int], None]:
    """A batch writer that appends, per batch, one timed summary of all batches so far.

    Each batch's sums per key are stored, and ``summary`` gets the stored rows
    of this batch and those before it, so the newest row covers everything.
    """
    partials = f"{path}/partials"
    store_partial, store = partial_batches(keys, sums, partials), store_batch(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        store_partial(batch, batch_id)
        so_far = stored(batch.sparkSession, partials).filter(F.col("batch_id") <= batch_id)
        store(summary(so_far).withColumn("created_at", F.current_timestamp()), batch_id)
    return write


def serve_and_refresh(transform: Callable[[DataFrame], DataFrame], needs_vector: Column,
                      embed: Callable[[DataFrame], DataFrame], path: str
                      ) -> Callable[[DataFrame, int], None]:
    """A batch writer for two destinations: the serving table and, if needed, the vectors."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = transform(batch).persist()
        try:
            store_batch(f"{path}/serve")(rows, batch_id)
            store_batch(f"{path}/vectors")(embed(rows.filter(needs_vector)), batch_id)
        finally:
            rows.unpersist()
    return write


def sales_batches(enrich: Callable[[DataFrame], DataFrame], path: str, arrived: Column | None = None
                  ) -> Callable[[DataFrame, int], None]:
    """A batch writer for sales per day and category of the newly arrived order lines.

    ``enrich`` joins the batch to its dimensions and yields ``order_id,
    batch_date, product_category, total_amount``. It runs inside the batch,
    where adaptive execution may broadcast a small side or split a hot key,
    which a plan of the stream itself could not. A row per order is stored, so
    an order whose lines arrive in several batches still counts once; ``sales``
    adds the batches up when they are read. ``arrived`` says when a line came
    in, by default the time of its batch; rows are kept apart by the hour of it.
    """
    store = store_batch(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        lines = enrich(batch).withColumn("at", F.current_timestamp() if arrived is None else arrived)
        store(lines.groupBy("batch_date", "product_category", "order_id", F.date_trunc("hour", "at").alias("hour")).agg(
            F.sum("total_amount").alias("amount"), F.max("at").alias("processed_at")), batch_id)
    return write


def hourly_sales(order_rows: DataFrame, day: Column) -> DataFrame:
    """Orders and revenue of one batch day by the hour their lines came in, over all stored batches.

    An order whose lines arrive in two hours counts in both, with the revenue
    that came in each; several batches and categories of one hour count it once.
    """
    per_order = order_rows.where(F.col("batch_date") == day).groupBy("hour", "order_id").agg(
        F.sum("amount").alias("amount"))
    return per_order.groupBy("hour").agg(F.count("*").alias("new_orders"), F.sum("amount").alias("new_revenue"))


def sales(order_rows: DataFrame) -> DataFrame:
    """One row per day and category over all stored batches."""
    days = ["batch_date", "product_category"]
    per_order = order_rows.groupBy(*days, "order_id").agg(
        F.sum("amount").alias("amount"), F.max("processed_at").alias("processed_at"))
    return per_order.groupBy(*days).agg(
        F.count("*").alias("new_orders"), F.sum("amount").alias("new_revenue"),
        F.max("processed_at").alias("processed_at")).withColumn(
        "avg_new_order_value", ratio(F.col("new_revenue"), F.col("new_orders")))
