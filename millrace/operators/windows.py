"""Trends, rankings, cohorts and anomalies over aggregated series.

Windows without a partition key run over day-grain series only: one row per
calendar day, a few tens of thousands for a century, whatever the row count of
the facts behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from millrace.functions.scalars import day_of_week, percent_change, ratio, trunc_date


def recent(df: DataFrame, column: str, as_of: Column, interval: str) -> DataFrame:
    """Rows from ``interval`` (such as '30 days') before ``as_of`` on, on the bare column."""
    return df.filter(F.col(column) >= as_of - F.expr(f"INTERVAL {interval}"))


def daily_series(facts: DataFrame, day: str = "order_date",
                 amount: str = "total_revenue") -> DataFrame:
    """One row per day."""
    return facts.groupBy(day).agg(F.sum(amount).alias("daily_revenue"))


def trailing_mean(series: DataFrame, order: str, value: str, rows: int, name: str) -> DataFrame:
    """Mean of the current row and the ``rows - 1`` before it (rows, not days)."""
    frame = Window.orderBy(order).rowsBetween(-(rows - 1), 0)
    return series.withColumn(name, ratio(F.sum(value).over(frame), F.count(value).over(frame)))


def week_over_week(series: DataFrame, order: str, value: str, rows: int = 7) -> DataFrame:
    """The value ``rows`` rows earlier and the percent change from it."""
    before = F.lag(value, rows).over(Window.orderBy(order))
    return (series.withColumn("revenue_week_ago", before)
            .withColumn("week_over_week_pct",
                        percent_change(F.col(value), F.col("revenue_week_ago"))))


def rank_in_month(facts: DataFrame) -> DataFrame:
    """Categories ranked by revenue inside each month."""
    monthly = facts.groupBy(trunc_date("month", "order_date").alias("month"),
                            "product_category").agg(F.sum("total_revenue").alias("monthly_revenue"))
    order = Window.partitionBy("month").orderBy(F.desc("monthly_revenue"))
    return monthly.withColumn("category_rank", F.rank().over(order))


def monthly_cohorts(facts: DataFrame) -> DataFrame:
    """Revenue, active days and month-over-month growth per region."""
    cohorts = facts.groupBy(trunc_date("month", "order_date").alias("cohort_month"),
                            "customer_region").agg(
        F.sum("total_revenue").alias("cohort_revenue"),
        F.countDistinct("order_date").alias("active_days"))
    order = Window.partitionBy("customer_region").orderBy("cohort_month")
    return (cohorts.withColumn("prev_month_revenue", F.lag("cohort_revenue", 1).over(order))
            .withColumn("mom_growth_pct", percent_change(F.col("cohort_revenue"),
                                                         F.col("prev_month_revenue"))))


def seasonality(facts: DataFrame) -> DataFrame:
    """Daily revenue with 7- and 30-row means and calendar parts."""
    series = daily_series(facts)
    series = trailing_mean(series, "order_date", "daily_revenue", 7, "revenue_7day_ma")
    series = trailing_mean(series, "order_date", "daily_revenue", 30, "revenue_30day_ma")
    return (series.withColumn("day_of_week", day_of_week(F.col("order_date")))
            .withColumn("week_of_year", F.weekofyear("order_date")))


def anomalies(series: DataFrame, value: str = "daily_revenue", unusual: float = 1.5,
              anomalous: float = 2.0) -> DataFrame:
    """Rows further than ``unusual`` sample deviations from the mean, with z-score and label.

    The series is small, one row per day, while what it was aggregated from is
    not: a window over the series reads that once, where a subquery for the mean
    and deviation would run the joins behind it a second time.
    """
    v = F.col(value).cast("double")
    whole = Window.partitionBy()
    gap = F.abs(v - F.col("average"))
    scored = (series.withColumn("average", ratio(F.sum(value).over(whole),
                                                 F.count(value).over(whole)))
              .withColumn("deviation", F.stddev_samp(v).over(whole))
              .withColumn("z_score", ratio(gap, F.col("deviation")))
              .withColumn("status", F.when(gap > anomalous * F.col("deviation"), "ANOMALY")
                          .when(gap > unusual * F.col("deviation"), "UNUSUAL")
                          .otherwise("NORMAL")))
    return scored.filter(gap > unusual * F.col("deviation"))


def stacked_series(df: DataFrame, at: str, layer: str, value: str) -> DataFrame:
    """Running total over the layers of each point in time, as a stacked area draws it."""
    layers = df.groupBy(at, layer).agg(F.sum(value).alias("value"))
    frame = Window.partitionBy(at).orderBy(layer).rowsBetween(Window.unboundedPreceding, 0)
    return layers.withColumn("stacked_value", F.sum("value").over(frame))


def series_by(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("value"))
