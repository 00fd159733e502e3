"""Top rows per group, dense row numbers and shares, without piling rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_SLICES = 64


def top_n_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int,
                    spread: Column, rank_name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group under ``order``, with their rank.

    A group may hold a large part of the data, so it is ranked in two rounds:
    every group is cut into slices by a hash of ``spread`` (a row id) and each
    slice keeps its own first ``n`` rows; only those meet in the second round.
    Spark applies the row-number limit before each of the two shuffles as well.
    ``order`` must end in a unique column so that ties have one outcome.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(spread), F.lit(_SLICES)))
    first = Window.partitionBy(*groups, "_slice").orderBy(*order)
    kept = sliced.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n)
    final = Window.partitionBy(*groups).orderBy(*order)
    return (kept.drop("_n", "_slice").withColumn(rank_name, F.row_number().over(final))
            .filter(F.col(rank_name) <= n))


def best_per_id(df: DataFrame, key: str, order: Sequence[Column], limit: int,
                spread: Column) -> DataFrame:
    """Keep each id's best row, then the ``limit`` best of those."""
    best = top_n_per_group(df, [key], order, 1, spread, "_best").drop("_best")
    return best.orderBy(*order).limit(limit)


def dense_row_number(df: DataFrame, key: str, name: str = "row_id",
                     block: int = 1_000_000) -> DataFrame:
    """Number rows 1..n by a unique integer key, with no single-task sort of the rows.

    Rows are numbered inside blocks of ``block`` consecutive key values, which
    hold at most that many rows since the key is unique. A block starts after
    the rows of the blocks before it, which are counted the same way inside
    groups of ``block`` blocks. One task sums the group counts only: with the
    default block fewer than twenty million rows for any 64-bit keys.
    """
    blocked = df.withColumn("_block", F.expr(f"`{key}` div {block}"))
    counts = blocked.groupBy("_block").agg(F.count("*").alias("_size")).withColumn(
        "_group", F.expr(f"_block div {block}"))
    before = Window.orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_group").agg(F.sum("_size").alias("_total")).select(
        "_group", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    earlier = Window.partitionBy("_group").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = counts.join(groups, "_group").select(
        "_block", (F.col("_start") + F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .alias("_offset"))
    inside = Window.partitionBy("_block").orderBy(key)
    return (blocked.join(offsets, "_block")
            .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
            .drop("_block", "_offset"))


def share_of_total(counts: DataFrame, value: str, name: str = "percentage",
                   places: int = 1) -> DataFrame:
    """Percentage of the total; the total is a scalar subquery, not a whole-set window."""
    total = counts.agg(F.sum(value)).scalar()
    exact = F.col(value).cast("decimal(20,2)") * 100 / total
    return counts.withColumn(name, F.round(exact, places))


def latest_row(df: DataFrame, keys: Sequence[str], order_by: str, tie: str | None = None) -> DataFrame:
    """The newest row per key (or of the whole input).

    Of rows of the same time the one with the largest ``tie`` counts. Each task
    keeps its newest row of a key before the shuffle.
    """
    order = [F.desc(order_by), *([F.desc(tie)] if tie else [])]
    if not keys:
        return df.orderBy(*order).limit(1)
    return top_n_per_group(df, keys, order, 1, F.col(tie or order_by), "_n").drop("_n")


def most_frequent(df: DataFrame, groups: Sequence[str], value: str, name: str,
                  weight: str | None = None) -> DataFrame:
    """The most frequent value per group, lowest on ties; ``weight`` counts a row several times.

    Counting (group, value) pairs first keeps the state of a group with very
    many distinct values out of a single aggregation buffer.
    """
    count = F.count("*") if weight is None else F.sum(weight)
    pairs = df.groupBy(*groups, value).agg(count.alias("_n"))
    pick = F.min_by(F.col(value), F.struct(-F.col("_n"), F.col(value)))
    return pairs.groupBy(*groups).agg(pick.alias(name))
