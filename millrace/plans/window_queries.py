"""Window functions (ids W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import ranking, windows
from millrace.plans.registry import QuerySet
from millrace.plans.relational_queries import facts_since
from millrace.plans.sql_views import CUSTOMERS, EVENTS, FACTS, GRID, LAST_DAY
from millrace.sources import datasets as ds

Q = QuerySet()

_DAILY = f"(SELECT order_date, SUM(total_revenue) AS daily_revenue FROM {FACTS} AS f GROUP BY 1)"


def _trailing(rows: int) -> str:
    frame = f"OVER (ORDER BY order_date ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    return (f"CAST(SUM(daily_revenue) {frame} AS DOUBLE) / COUNT(daily_revenue) {frame}")


@Q.add("W1_trailing_mean", "order_date str, daily_revenue dbl, revenue_7day_avg dbl",
       f"SELECT *, {_trailing(7)} AS revenue_7day_avg FROM {_DAILY} AS d")
def w1(spark, sf):
    return windows.trailing_mean(windows.daily_series(ds.order_facts(spark, sf)), "order_date",
                                 "daily_revenue", 7, "revenue_7day_avg")


@Q.add("W2_week_over_week", "order_date str, daily_revenue dbl, revenue_week_ago dbl, "
       "week_over_week_pct dbl6",
       f"""SELECT *, CAST(daily_revenue - revenue_week_ago AS DOUBLE)
             / NULLIF(CAST(revenue_week_ago AS DOUBLE), 0) * 100 AS week_over_week_pct
           FROM (SELECT *, LAG(daily_revenue, 7) OVER (ORDER BY order_date) AS revenue_week_ago
                 FROM {_DAILY} AS d) AS x""")
def w2(spark, sf):
    return windows.week_over_week(windows.daily_series(ds.order_facts(spark, sf)), "order_date",
                                  "daily_revenue")


@Q.add("W3_rank_in_month", "month str, product_category str, monthly_revenue dbl, "
       "category_rank long",
       f"""SELECT CAST(DATE_TRUNC('month', order_date) AS DATE) AS month, product_category,
           SUM(total_revenue) AS monthly_revenue, RANK() OVER (
             PARTITION BY CAST(DATE_TRUNC('month', order_date) AS DATE)
             ORDER BY SUM(total_revenue) DESC) AS category_rank
           FROM {FACTS} AS f GROUP BY CAST(DATE_TRUNC('month', order_date) AS DATE),
             product_category""")
def w3(spark, sf):
    return windows.rank_in_month(ds.order_facts(spark, sf)).orderBy(F.desc("month"),
                                                                    "category_rank")


@Q.add("W4_monthly_cohorts", "cohort_month str, customer_region str, cohort_revenue dbl, "
       "active_days long, prev_month_revenue dbl, mom_growth_pct dbl6",
       f"""WITH m AS (SELECT CAST(DATE_TRUNC('month', order_date) AS DATE) AS cohort_month,
             customer_region, SUM(total_revenue) AS cohort_revenue,
             COUNT(DISTINCT order_date) AS active_days FROM {FACTS} AS f
             WHERE order_date >= {LAST_DAY} - INTERVAL 12 MONTH GROUP BY 1, 2),
           p AS (SELECT *, LAG(cohort_revenue, 1) OVER (PARTITION BY customer_region
             ORDER BY cohort_month) AS prev_month_revenue FROM m)
           SELECT *, CAST(cohort_revenue - prev_month_revenue AS DOUBLE)
             / NULLIF(CAST(prev_month_revenue AS DOUBLE), 0) * 100 AS mom_growth_pct FROM p""")
def w4(spark, sf):
    return windows.monthly_cohorts(facts_since(spark, sf, "12 months")).orderBy(
        F.desc("cohort_month"), F.desc("cohort_revenue"))


@Q.add("W5_seasonality", "order_date str, daily_revenue dbl, revenue_7day_ma dbl, "
       "revenue_30day_ma dbl, day_of_week long, week_of_year long",
       f"""SELECT order_date, daily_revenue, {_trailing(7)} AS revenue_7day_ma,
           {_trailing(30)} AS revenue_30day_ma, EXTRACT(DOW FROM order_date) AS day_of_week,
           EXTRACT(WEEK FROM order_date) AS week_of_year FROM {_DAILY} AS d
           WHERE order_date >= {LAST_DAY} - INTERVAL 90 DAY""")
def w5(spark, sf):
    return windows.seasonality(facts_since(spark, sf, "90 days")).orderBy("order_date")


def _anomaly_sql(where: str) -> str:
    return f"""WITH s AS (SELECT order_date, daily_revenue,
          CAST(SUM(daily_revenue) OVER () AS DOUBLE) / COUNT(*) OVER () AS average,
          STDDEV_SAMP(CAST(daily_revenue AS DOUBLE)) OVER () AS deviation
          FROM {_DAILY} AS d {where})
        SELECT order_date, daily_revenue, average,
          ABS(daily_revenue::DOUBLE - average) / NULLIF(deviation, 0) AS z_score,
          CASE WHEN ABS(daily_revenue::DOUBLE - average) > 2 * deviation THEN 'ANOMALY'
               ELSE 'UNUSUAL' END AS status
        FROM s WHERE ABS(daily_revenue::DOUBLE - average) > 1.5 * deviation"""


_ANOMALY_COLUMNS = ("order_date str, daily_revenue dbl, average dbl4, z_score dbl6, status str")


@Q.add("W6_anomalies", _ANOMALY_COLUMNS,
       _anomaly_sql(f"WHERE order_date >= {LAST_DAY} - INTERVAL 60 DAY"))
def w6(spark, sf):
    series = windows.daily_series(facts_since(spark, sf, "60 days"))
    return windows.anomalies(series).orderBy(F.desc("z_score"))


@Q.add("W6_anomalies_all_days", _ANOMALY_COLUMNS, _anomaly_sql(""))
def w6_all(spark, sf):
    series = windows.daily_series(ds.order_facts(spark, sf))
    return windows.anomalies(series).orderBy(F.desc("z_score"))


@Q.add("W7_share_of_total", "tier str, customers long, percentage dbl",
       f"""SELECT tier, COUNT(*) AS customers,
           ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 1) AS percentage
           FROM {CUSTOMERS} AS c GROUP BY 1""")
def w7(spark, sf):
    counts = ds.customers(spark, sf).groupBy("tier").agg(F.count("*").alias("customers"))
    return ranking.share_of_total(counts, "customers").orderBy(F.desc("customers"), "tier")


@Q.add("W8_stacked_series", "date str, category str, value dbl, stacked_value dbl",
       f"""SELECT date, category, SUM(value) AS value, SUM(SUM(value)) OVER (
             PARTITION BY date ORDER BY category
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stacked_value
           FROM {GRID} AS g GROUP BY date, category""")
def w8(spark, sf):
    e = ds.events(spark, sf).select(F.col("event_time").cast("date").alias("date"),
                                    F.col("event_type").alias("category"), "value")
    return windows.stacked_series(e, "date", "category", "value")


@Q.add("W9_latest_row", "event_type str, event_id long, event_time ts, value dbl",
       f"""SELECT event_type, event_id, event_time, value FROM (SELECT *, ROW_NUMBER() OVER (
             PARTITION BY event_type ORDER BY event_time DESC, event_id DESC) AS rn FROM {EVENTS} AS e) AS r
           WHERE rn = 1""")
def w9(spark, sf):
    e = ds.events(spark, sf).select("event_type", "event_id", "event_time", "value")
    return ranking.latest_row(e, ["event_type"], "event_time", tie="event_id")


@Q.add("W10_top_rows_per_group", "tier str, rank long, customer_id long, balance dbl",
       f"""SELECT * FROM (SELECT tier, ROW_NUMBER() OVER (PARTITION BY tier
             ORDER BY balance DESC, customer_id) AS rank, customer_id, balance
             FROM {CUSTOMERS} AS c) AS r WHERE rank <= 3""")
def w10(spark, sf):
    return ranking.top_n_per_group(ds.customers(spark, sf), ["tier"],
                                   [F.desc("balance"), F.col("customer_id")], 3,
                                   F.col("customer_id"))
