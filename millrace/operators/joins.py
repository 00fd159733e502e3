"""Joins between a dimension and its facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millrace.functions.scalars import mean_of


def parent_totals(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str,
                  groups: Sequence[str], amount: str) -> DataFrame:
    """``parents LEFT JOIN children`` summed per group, parents without children included.

    The children are summed per key before the join. A parent that owns a large
    part of all children then costs one row, on the side of an outer join that
    adaptive execution could not split.

    Columns: ``joined_rows`` (what COUNT(parent.id) over the join counts),
    ``parent_count`` (distinct parents), ``child_count``, ``total`` (NULL where
    no child exists) and ``mean``.
    """
    per_key = children.groupBy(child_key).agg(
        F.count("*").alias("_n"), F.sum(amount).alias("_total")
    ).withColumnRenamed(child_key, "_key")
    joined = parents.join(per_key, parents[parent_key] == F.col("_key"), "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    out = joined.groupBy(*groups).agg(
        F.sum(F.greatest(n, F.lit(1))).alias("joined_rows"),
        F.count("*").alias("parent_count"), F.sum(n).alias("child_count"),
        F.sum("_total").alias("total"))
    return out.withColumn("mean", mean_of(F.col("total"), F.col("child_count")))


def orphans(children: DataFrame, parents: DataFrame, child_key: str,
            parent_key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents, children[child_key] == parents[parent_key], "left_anti")


def cross_source_summary(relational: DataFrame, lake: DataFrame, key: str,
                         relational_amount: str, lake_amount: str, lake_rows: str,
                         also: Sequence[str]) -> DataFrame:
    """Per-key totals of a relational source beside those of presummed lake files.

    Both sides are reduced to one row per key before they meet, which gives the
    same sums as joining the lake rows and grouping afterwards.
    """
    left = relational.groupBy(key, *also).agg(F.sum(relational_amount).alias("relational_total"))
    right = lake.groupBy(key).agg(F.sum(lake_rows).alias("_n"),
                                  F.sum(lake_amount).alias("lake_total"))
    return left.join(right, key, "left").withColumn(
        "lake_count", F.coalesce("_n", F.lit(0))).drop("_n")
