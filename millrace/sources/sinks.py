"""Writers. Each one takes a frame and a place, and returns nothing or the read-back frame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def overwrite_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def append_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_csv_report(df: DataFrame, path: str) -> DataFrame:
    """Write an aggregate as CSV with a header and read it back, which proves it arrived."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.option("header", True).schema(df.schema).csv(path)


def append_to_database(df: DataFrame, url: str, table: str, **options: str) -> None:
    """Append to a relational table over JDBC, one connection per partition."""
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, **options).save()


def by_day(df: DataFrame, timestamp: str, name: str = "event_day") -> DataFrame:
    """Adds the day column a time-partitioned table is laid out by."""
    return df.withColumn(name, F.col(timestamp).cast("date"))


def write_partitioned(df: DataFrame, path: str, partition_by: Sequence[str],
                      rows_per_file: int = 5_000_000) -> DataFrame:
    """Write a partitioned table in few files for each value.

    The rows are rebalanced by the partition values: adaptive execution joins
    small shuffle partitions and splits those of a heavy value by their size,
    so that it is written by as many tasks as it needs.
    """
    laid_out = df.hint("rebalance", *[F.col(c) for c in partition_by])
    laid_out.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(
        *partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def save_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """A bucketed and sorted table: joins and aggregates on ``key`` then need no shuffle.

    The rows are shuffled by bucket first, so that each bucket is one file.
    """
    (df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", path).saveAsTable(table))
    return df.sparkSession.table(table)


def create_or_append(df: DataFrame, table: str, path: str) -> None:
    """Create a catalog table at ``path``, or append by column name if it is there already."""
    if df.sparkSession.catalog.tableExists(table):
        df.select(*df.sparkSession.table(table).columns).write.mode("append").insertInto(table)
    else:
        df.writeTo(table).using("parquet").option("path", path).create()


def replace_table(df: DataFrame, table: str, path: str) -> DataFrame:
    """Create-or-replace a table as the result of a query."""
    df.write.mode("overwrite").format("parquet").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def replace_view(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    """Create-or-replace a session view that dashboards query by name."""
    df.createOrReplaceTempView(name)
    return spark.table(name)


def append_if_any(summary: DataFrame, count_column: str, path: str) -> None:
    """Append a summary row only if it counted any input."""
    append_parquet(summary.filter(F.col(count_column) > 0), path)


def append_new_keys(df: DataFrame, existing: DataFrame, keys: Sequence[str], path: str) -> None:
    """Append the rows whose key the target lacks, one row per key; null keys match each other."""
    known = existing.select(*[F.col(k).alias(f"_known_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_known_{k}")) for k in keys]
    append_parquet(df.dropDuplicates(list(keys)).join(known, same, "left_anti"), path)


def fan_out(df: DataFrame, *writers: Callable[[DataFrame], object]) -> None:
    """Hand one result to several destinations, computing it once.

    The result is persisted with spill to disk; if an executor is lost its part
    is recomputed from the source.
    """
    df = df.persist()
    try:
        for write in writers:
            write(df)
    finally:
        df.unpersist()
