"""Data quality (ids Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import quality
from millrace.plans.registry import QuerySet
from millrace.plans.sql_views import CUSTOMERS, ORDERS
from millrace.sources import datasets as ds

Q = QuerySet()

_UNIQUE = f"SELECT COUNT(*) - COUNT(DISTINCT customer_id) FROM {CUSTOMERS} AS c"
_EMAIL = f"SELECT COUNT(*) FROM {CUSTOMERS} AS c WHERE email NOT LIKE '%@%'"
_AMOUNT = f"SELECT COUNT(*) FROM {ORDERS} AS o WHERE total_amount <= 0"
_ORPHANS = f"""SELECT COUNT(*) FROM {ORDERS} o LEFT JOIN (SELECT * FROM {CUSTOMERS} AS x
    WHERE balance >= 0) c ON o.customer_id = c.customer_id WHERE c.customer_id IS NULL"""

_CHECK_COLUMNS = "check_name str, observed long, expected long, passed bool"


def _one(name: str, sql: str) -> str:
    return (f"SELECT '{name}' AS check_name, observed, 0 AS expected, observed = 0 AS passed "
            f"FROM (SELECT ({sql}) AS observed) AS x")


def _customer_checks(spark, sf):
    return quality.run_checks(ds.customers(spark, sf), {
        "customer id unique": quality.duplicates("customer_id"),
        "email format": quality.violations(~F.col("email").like("%@%"))})


def _order_checks(spark, sf):
    return quality.run_checks(ds.orders(spark, sf), {
        "order amount positive": quality.violations(F.col("total_amount") <= 0)})


def _reference_check(spark, sf):
    return quality.referential_check(
        "order has customer", ds.orders(spark, sf),
        ds.customers(spark, sf).filter("balance >= 0"), "customer_id", "customer_id")


_SUITE_SQL = " UNION ALL ".join([
    _one("customer id unique", _UNIQUE), _one("email format", _EMAIL),
    _one("order amount positive", _AMOUNT), _one("order has customer", _ORPHANS)])


@Q.add("Q1_existence", "table_name str, row_count long, status str",
       """SELECT 'orders' AS table_name, COUNT(*) AS row_count, CASE WHEN COUNT(*) > 0
          THEN 'has_data' ELSE 'no_data' END AS status FROM orders""")
def q1(spark, sf):
    return quality.existence(ds.table(spark, sf, "orders")).withColumn(
        "table_name", F.lit("orders"))


@Q.add("Q2_uniqueness", _CHECK_COLUMNS, _one("customer id unique", _UNIQUE))
def q2(spark, sf):
    return quality.run_checks(ds.customers(spark, sf),
                              {"customer id unique": quality.duplicates("customer_id")})


@Q.add("Q3_format", _CHECK_COLUMNS, _one("email format", _EMAIL))
def q3(spark, sf):
    return quality.run_checks(ds.customers(spark, sf), {
        "email format": quality.violations(~F.col("email").like("%@%"))})


@Q.add("Q4_range", _CHECK_COLUMNS, _one("order amount positive", _AMOUNT))
def q4(spark, sf):
    return _order_checks(spark, sf)


@Q.add("Q5_referential", _CHECK_COLUMNS, _one("order has customer", _ORPHANS))
def q5(spark, sf):
    return _reference_check(spark, sf)


@Q.add("Q6_check_suite", _CHECK_COLUMNS, _SUITE_SQL)
def q6(spark, sf):
    return quality.suite(_customer_checks(spark, sf), _order_checks(spark, sf),
                         _reference_check(spark, sf))


@Q.add("Q7_score_alert", "passed long, total long, score dbl, alert bool",
       f"""SELECT SUM(CASE WHEN passed THEN 1 ELSE 0 END) AS passed, COUNT(*) AS total,
           SUM(CASE WHEN passed THEN 1 ELSE 0 END) * 100.0 / COUNT(*) AS score,
           SUM(CASE WHEN passed THEN 1 ELSE 0 END) * 100.0 / COUNT(*) < 95 AS alert
           FROM ({_SUITE_SQL}) AS s""")
def q7(spark, sf):
    return quality.score(q6(spark, sf))
