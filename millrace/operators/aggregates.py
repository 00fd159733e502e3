"""Grouped summaries. All of them aggregate partially before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.functions.scalars import mean_of, percent_change, trunc_date


def revenue_by(df: DataFrame, keys: Sequence[str | Column], amount: str = "total_amount",
               count_name: str = "order_count", total_name: str = "total_revenue",
               mean_name: str | None = "avg_order_value", rows: str | None = None) -> DataFrame:
    """Row count, exact total and mean of an amount per key.

    ``rows`` names a column that says how many rows a presummed row stands for.
    """
    count = F.count("*") if rows is None else F.sum(rows)
    out = df.groupBy(*keys).agg(count.alias(count_name), F.sum(amount).alias(total_name))
    if mean_name:
        out = out.withColumn(mean_name, mean_of(F.col(total_name), F.col(count_name)))
    return out


def trend(df: DataFrame, unit: str, when: str, amount: str = "total_amount") -> DataFrame:
    """Orders, revenue and mean per day, month or other calendar unit."""
    return revenue_by(df, [trunc_date(unit, when).alias("period")], amount)


def hourly_trend(df: DataFrame, when: str, day: Column, amount: str) -> DataFrame:
    """Count and sum per hour of one day.

    The day is a range test on the bare column: its bounds are cast to the
    column's type, not the column to theirs, so that it reaches the scan.
    """
    start = F.date_trunc("day", day).cast(df.schema[when].dataType)
    one_day = df.filter((F.col(when) >= start) & (F.col(when) < start + F.expr("INTERVAL 1 DAY")))
    return one_day.groupBy(F.date_trunc("hour", when).alias("hour")).agg(
        F.count("*").alias("row_count"), F.sum(amount).alias("amount"))


def product_performance(sums: DataFrame) -> DataFrame:
    """Lines, quantity, revenue and mean line price per product name, from sums of order lines."""
    out = sums.groupBy("product_name").agg(
        F.sum("line_count").alias("order_count"), F.sum("quantity").alias("total_quantity"),
        F.sum("total_amount").alias("total_revenue"),
        F.sum(F.col("unit_price") * F.col("line_count")).alias("_prices"))
    return out.withColumn("avg_price", mean_of(F.col("_prices"), F.col("order_count"))).drop(
        "_prices")


def kpi_totals(df: DataFrame, sums: Sequence[str], mean: str) -> DataFrame:
    """One row: a total per listed column and the mean of one more."""
    row = df.agg(*[F.sum(c).alias(f"total_{c}") for c in sums],
                 F.sum(mean).alias("_sum"), F.count(mean).alias("_count"))
    return row.withColumn(f"avg_{mean}", mean_of(F.col("_sum"), F.col("_count"))).drop(
        "_sum", "_count")


def distinct_totals(df: DataFrame, distinct: str, amount: str, approximate: bool = False,
                    rows: str | None = None) -> DataFrame:
    """Rows, distinct values of a column and total; the estimate spares a shuffle of the values.

    ``rows`` names a column that says how many rows a presummed row stands for.
    """
    total = F.count("*") if rows is None else F.sum(rows)
    count = F.approx_count_distinct(distinct) if approximate else F.countDistinct(distinct)
    return df.agg(total.alias("total_records"), count.alias("distinct_values"),
                  F.sum(amount).alias("total_revenue"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Row count per value of each column, in long form, from one scan.

    Exploding the few column names keeps the result a plain aggregate, so a
    column with many values grows rows, not one map.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
        for c in columns])).alias("cell")
    return df.select(cells).groupBy("cell.field", "cell.value").agg(
        F.count("*").alias("row_count"))


def item_summary(df: DataFrame, distinct: dict[str, str], means: Sequence[str],
                 spreads: Sequence[str]) -> DataFrame:
    """Row count, distinct counts, means and value distributions as (field, value, amount) rows.

    ``distinct`` maps columns to the field name of their distinct count. The data
    is read once: it is summed per combination of the named columns, those sums per
    single value, and every figure comes from the latter.
    """
    columns = list(dict.fromkeys([*distinct, *spreads]))
    cube = df.groupBy(*columns).agg(F.count("*").alias("n"),
                                    *[F.sum(m).alias(f"sum_{m}") for m in means])
    kinds = F.array(F.struct(F.lit("").alias("kind"), F.lit("").alias("value")), *[
        F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value"))
        for c in columns])
    sums = ["n"] + [f"sum_{m}" for m in means]
    per_value = cube.select(F.explode(kinds).alias("k"), *sums).groupBy("k.kind", "k.value").agg(
        *[F.sum(c).alias(c) for c in sums])

    def row(kind, field, value, amount):
        return F.when(F.col("kind") == kind, F.struct(
            F.lit(field).alias("field"), value.alias("value"),
            amount.cast("double").alias("amount")))

    rows = [row("", "items", F.lit(""), F.col("n"))]
    rows += [row("", f"avg_{m}", F.lit(""), mean_of(F.col(f"sum_{m}"), F.col("n"))) for m in means]
    rows += [row(c, field, F.lit(""), F.lit(1))
             for c, field in distinct.items()]
    rows += [row(c, c, F.col("value"), F.col("n")) for c in spreads]
    return per_value.select(F.explode(F.array_compact(F.array(*rows))).alias("r")).groupBy(
        "r.field", "r.value").agg(F.sum("r.amount").alias("amount"))


def compare_days(sales: DataFrame, day: Column) -> DataFrame:
    """Revenue of a day against the day before, for categories that sold on both sides."""
    today, yesterday = F.col("batch_date") == day, F.col("batch_date") == F.date_sub(day, 1)
    zero = F.lit(0).cast("decimal(12,2)")
    out = sales.filter(today | yesterday).groupBy("product_category").agg(
        F.sum(F.when(today, F.col("new_revenue")).otherwise(zero)).alias("today_revenue"),
        F.sum(F.when(yesterday, F.col("new_revenue")).otherwise(zero)).alias("yesterday_revenue"))
    return out.filter("yesterday_revenue > 0").withColumn(
        "pct_change", percent_change(F.col("today_revenue"), F.col("yesterday_revenue")))


def id_pages(df: DataFrame, group: str, key: str, page: int = 1000) -> DataFrame:
    """Ordered comma lists of a unique integer id per group, one page per ``page`` id values.

    A page holds at most ``page`` ids, so a group of any size stays spread over
    rows; the pages of a group read in order give its whole list.
    """
    return (df.groupBy(group, F.expr(f"`{key}` div {page}").alias("page"))
            .agg(F.count("*").alias("records"),
                 F.array_join(F.sort_array(F.collect_list(key)), ", ").alias("ids")))


def hierarchy_totals(df: DataFrame, levels: Sequence[str], value: str) -> DataFrame:
    """Totals at every level of a hierarchy; the leaves are summed before the roll-up."""
    leaves = df.groupBy(*levels).agg(F.sum(value).alias("_v"), F.count("*").alias("_n"))
    return leaves.rollup(*levels).agg(F.grouping_id().alias("level"),
                                      F.sum("_v").alias("total"), F.sum("_n").alias("item_count"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width histogram; the top edge belongs to the last bin, empty bins are absent."""
    v = F.col(value).cast("double")
    ends = df.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("ends")).scalar()
    width = (ends["hi"] - ends["lo"]) / bins
    place = F.when(width > 0, F.floor(F.try_divide(v - ends["lo"], width))).otherwise(0)
    binned = df.filter(v.isNotNull()).select(F.least(place, F.lit(bins - 1)).alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("row_count"))


def correlation_matrix(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Pearson correlations in long form, every pair from one aggregate row."""
    pairs = list(combinations(measures, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                   for a, b in pairs])
    cell = lambda a, b, c: F.struct(F.lit(a).alias("measure_a"), F.lit(b).alias("measure_b"),
                                    c.alias("correlation"))
    cells = [cell(m, m, F.lit(1.0)) for m in measures]
    for a, b in pairs:
        cells += [cell(a, b, F.col(f"`{a}|{b}`")), cell(b, a, F.col(f"`{a}|{b}`"))]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def composed(df: DataFrame, conditions: Sequence[str] = (), keys: Sequence[str] = (),
             aggregations: Sequence[Column] = ()) -> DataFrame:
    """A table, AND-joined SQL conditions and an optional aggregation."""
    for condition in conditions:
        df = df.filter(F.expr(condition))
    return df.groupBy(*keys).agg(*aggregations) if aggregations else df
