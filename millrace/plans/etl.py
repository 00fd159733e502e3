"""Jobs put together from sources, operators and sinks."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from millrace.sources import readers, sinks

Transform = Callable[[DataFrame], DataFrame]


def apply_all(df: DataFrame, transforms: Iterable[Transform]) -> DataFrame:
    """A list of transformations in order; the plan stays one lazy plan."""
    return reduce(DataFrame.transform, transforms, df)


def extract(spark: SparkSession, source: Mapping[str, Any]) -> DataFrame:
    """Read a source by its ``type``: csv, parquet, table or jdbc."""
    kind = source["type"]
    if kind == "csv":
        return readers.read_csv(spark, source["path"], source.get("schema"))
    if kind == "parquet":
        return spark.read.parquet(source["path"])
    if kind == "table":
        return spark.table(source["name"])
    if kind == "jdbc":
        return readers.read_table(spark, source["url"], source["name"], **source.get("options", {}))
    raise ValueError(f"unknown source type {kind}")


def load(df: DataFrame, sink: Mapping[str, Any]) -> None:
    """Write to a sink by its ``type``: csv, parquet, vectors or jdbc."""
    kind = sink["type"]
    if "transform" in sink:
        df = df.transform(sink["transform"])
    if kind == "csv":
        df.write.mode("overwrite").option("header", True).csv(sink["path"])
    elif kind in ("parquet", "vectors"):
        df.write.mode(sink.get("mode", "overwrite")).parquet(sink["path"])
    elif kind == "jdbc":
        sinks.append_to_database(df, sink["url"], sink["name"], **sink.get("options", {}))
    else:
        raise ValueError(f"unknown sink type {kind}")


def run_job(spark: SparkSession, source: Mapping[str, Any], transforms: Sequence[Transform],
            targets: Sequence[Mapping[str, Any]]) -> None:
    """Extract, transform and load to every target, computing the result once."""
    result = apply_all(extract(spark, source), transforms)
    sinks.fan_out(result, *[lambda df, t=t: load(df, t) for t in targets])


def fit_and_store(df: DataFrame, features: Sequence[str], label: str, path: str) -> None:
    """Fit a linear regression on all rows, by its normal equations, and store the whole pipeline."""
    steps = [VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip"),
             LinearRegression(featuresCol="_features", labelCol="_label", predictionCol="prediction", solver="normal")]
    known = df.withColumn("_label", F.col(label).cast("double")).where("_label IS NOT NULL")
    Pipeline(stages=steps).fit(known).write().overwrite().save(path)


def score_stored(df: DataFrame, key: str, path: str) -> DataFrame:
    """Predictions of a stored pipeline: key, prediction, time. Rows that lack a feature have none."""
    model = PipelineModel.load(path)
    scored = model.transform(df).select(key, "prediction")
    return scored.withColumn("prediction_timestamp", F.current_timestamp())


def score_batches(df: DataFrame, key: str, features: Sequence[str],
                  predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Predictions of an opaque model, in Arrow batches: key, prediction, time.

    The model sees the feature columns only, as a matrix; nothing else travels
    to Python.
    """
    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            values = batch[list(features)].to_numpy(dtype=float)
            yield pd.DataFrame({key: batch[key], "prediction": predict(values)})

    kind = df.schema[key].dataType.simpleString()
    inputs = df.select(key, *[F.col(f).cast("double") for f in features])
    scored = inputs.mapInPandas(run, f"{key} {kind}, prediction double")
    return scored.withColumn("prediction_timestamp", F.current_timestamp())


# Data-set export ---------------------------------------------------------------------------------

MANIFEST = ("export_id STRING, data_set STRING, exported_at TIMESTAMP, row_count BIGINT, "
            "fingerprint DECIMAL(38,0), options STRING")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a sum of row hashes that does not depend on row order."""
    return df.agg(F.count("*").alias("row_count"),
                  F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")),
                             F.lit(0).cast("decimal(38,0)")).alias("fingerprint"))


def export(df: DataFrame, root: str, data_set: str, export_id: str,
           exported_at: datetime.datetime, options: str = "") -> DataFrame:
    """Copy a data set, compare the copy with the source, then record it in the manifest.

    Returns the manifest row with ``verified``. A copy that differs gets no
    manifest row, so it can never be restored.
    """
    spark = df.sparkSession
    target = f"{root}/{export_id}/{data_set}"
    df.write.mode("overwrite").parquet(target)
    # Two one-row frames meet in one row; the literal key keeps this an equi-join.
    source = fingerprint(df).withColumn("k", F.lit(1))
    copy = fingerprint(spark.read.parquet(target)).select(
        F.lit(1).alias("k"), F.col("row_count").alias("copied"), F.col("fingerprint").alias("seal"))
    row = source.join(copy, "k").select(
        F.lit(export_id).alias("export_id"), F.lit(data_set).alias("data_set"),
        F.lit(exported_at).cast("timestamp").alias("exported_at"), "row_count", "fingerprint",
        F.lit(options).alias("options"),
        ((F.col("row_count") == F.col("copied"))
         & (F.col("fingerprint") == F.col("seal"))).alias("verified"))
    result = spark.createDataFrame(row.collect(), row.schema)  # one row
    sinks.append_parquet(result.filter("verified").drop("verified"), f"{root}/manifest")
    return result


def kept_exports(manifest: DataFrame, now: Column, days: int) -> DataFrame:
    """The exports a retention of ``days`` keeps."""
    return manifest.filter(F.col("exported_at") >= now - F.make_dt_interval(days=F.lit(days)))


def _place(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system of a path and the path, as Spark's own Hadoop client sees them."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    files, place = _place(spark, path)
    return files.exists(place)


def live_exports(spark: SparkSession, root: str) -> DataFrame:
    """The manifest without the exports that ``remove_expired`` has retired."""
    manifest = spark.read.parquet(f"{root}/manifest")
    if not _exists(spark, f"{root}/retired"):
        return manifest
    retired = spark.read.parquet(f"{root}/retired").select("export_id").distinct()
    return manifest.join(retired, "export_id", "left_anti").select(*manifest.columns)


def remove_expired(spark: SparkSession, root: str, now: Column, days: int) -> DataFrame:
    """Remove the exports whose every data set is older than ``days``; returns their ids.

    An export is retired in a log before its folder is deleted, so a job that
    stops halfway leaves nothing that could be restored by halves, and the next
    run deletes what the log still names. Only folders named in the manifest, directly
    below ``root``, are touched. The driver holds one id for each export.
    """
    manifest, kept = spark.read.parquet(f"{root}/manifest"), kept_exports(live_exports(spark, root), now, days)
    named = (F.col("export_id").rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$")
             & ~F.col("export_id").isin("manifest", "retired"))
    gone = manifest.where(named).select("export_id").distinct().join(
        kept.select("export_id").distinct(), "export_id", "left_anti")
    ids = sorted(r["export_id"] for r in gone.collect())
    log = spark.createDataFrame([(i,) for i in ids], "export_id STRING").withColumn("retired_at", now)
    if ids:
        sinks.append_parquet(log.coalesce(1), f"{root}/retired")
    for export_id in ids:
        files, place = _place(spark, f"{root}/{export_id}")
        if files.exists(place):
            files.delete(place, True)
    return log


def restore(spark: SparkSession, root: str, data_set: str, export_id: str,
            target: str) -> DataFrame:
    """Restore a data set from a recorded export.

    The export is checked against the manifest before ``target`` is touched, so
    a damaged export leaves the data as they were; the copy is checked after.
    """
    recorded = live_exports(spark, root).filter(
        (F.col("export_id") == export_id) & (F.col("data_set") == data_set))
    if recorded.isEmpty():
        raise LookupError(f"no export {export_id} of {data_set}")
    def check(df: DataFrame, what: str) -> None:
        if fingerprint(df).join(recorded, ["row_count", "fingerprint"]).isEmpty():
            raise ValueError(f"{what} {data_set} differs from its manifest")

    exported = spark.read.parquet(f"{root}/{export_id}/{data_set}")
    check(exported, "exported")
    exported.write.mode("overwrite").parquet(target)
    restored = spark.read.parquet(target)
    check(restored, "restored")
    return restored
