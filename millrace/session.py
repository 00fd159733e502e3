"""Session builder with the settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app_name: str = "millrace", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Return a session in UTC and ANSI mode with adaptive execution.

    Adaptive execution splits hot join partitions and merges small ones, so
    ``shuffle_partitions`` may be set high on a cluster. ``master`` stays unset
    on a cluster, where spark-submit names it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Keyed stream state of any size lives on local disk and is checkpointed, not on the heap.
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
