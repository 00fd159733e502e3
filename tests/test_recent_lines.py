"""Lines of recent orders are picked without sorting the lines of all orders."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.sources import datasets as ds


@pytest.mark.parametrize("build", [ds.order_facts, ds.category_sales])
def test_lines_stream_past_hashed_orders(build, spark, sf_dir):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(limit, "-1")
    try:
        plan = build(spark, sf_dir, F.lit("1998-01-01").cast("timestamp_ntz"))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset(limit)
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert len(semi) == 1 and "ShuffledHashJoin" in semi[0] and "BuildRight" in semi[0]


def test_repeated_and_null_orders_pick_a_line_once(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    day, old = dt.datetime(1998, 5, 1), dt.datetime(1990, 1, 1)
    put("orders", [(1, 7, day, "O", "p", 1.0), (1, 7, day, "O", "p", 1.0), (2, 7, old, "O", "p", 1.0), (None, 7, day, "O", "p", 1.0)],
        "o_orderkey LONG, o_custkey LONG, o_orderdate TIMESTAMP_NTZ, o_orderstatus STRING, o_orderpriority STRING, o_totalprice DOUBLE")
    put("lineitem", [(1, 5, 1.0, 10.0), (1, 5, 1.0, 2.5), (2, 5, 1.0, 99.0), (None, 5, 1.0, 50.0)],
        "l_orderkey LONG, l_partkey LONG, l_quantity DOUBLE, l_extendedprice DOUBLE")
    put("part", [(5, "n", "PROMO", 1.0)], "p_partkey LONG, p_name STRING, p_type STRING, p_retailprice DOUBLE")
    got = ds._order_amounts(spark, str(tmp_path), F.lit("1998-01-01").cast("timestamp_ntz")).collect()
    assert [(r["order_id"], r["product_category"], float(r["amount"])) for r in got] == [(1, "PROMO", 12.5)]
