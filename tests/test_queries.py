"""Every named query against its SQL in DuckDB, and its plan."""

import contextlib
import glob
import io
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans import catalog

QUERIES, SQL = catalog.all_queries(), catalog.all_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else repr(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        df.explain()
    assert "CartesianProduct" not in plan.getvalue()
    assert "BroadcastNestedLoopJoin" not in plan.getvalue()
    assert "BatchEvalPython" not in plan.getvalue()
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    got = duck.execute(SQL[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == names
    theirs = sorted(tuple(plain(v) for _, v in sorted(zip(columns, row))) for row in got.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", ["A2_category_revenue", "A4_product_region_sales", "A9_product_performance",
                                  "J2_cross_source_customers", "K7_dashboard_view", "P9_having"])
def test_lines_are_summed_below_the_joins(name, spark, sf_dir):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset(limit)
    below, depth = plan.splitlines(), None
    at = next(i for i, line in enumerate(below) if "lineitem.parquet" in line)
    for line in reversed(below[:at]):  # the nearest operator above the scan that is no projection or filter
        if "Aggregate" in line or "Join" in line:
            depth = line
            break
    assert "HashAggregate" in depth


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["order_date", "daily_revenue", "average", "z_score", "status"]
    assert df.count() > 0
