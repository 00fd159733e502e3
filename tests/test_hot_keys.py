"""Queries on tables in which one key, text or type holds a third of all rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

HOT = {
    "lineitem": """SELECT CASE WHEN (l_linenumber + l_orderkey) % 3 = 0 THEN 7 ELSE l_orderkey END
        AS l_orderkey, CASE WHEN (l_orderkey + l_suppkey) % 3 = 0 THEN 11 ELSE l_partkey END
        AS l_partkey, * EXCLUDE (l_orderkey, l_partkey) FROM '{p}'""",
    "orders": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 5 ELSE o_custkey END
        AS o_custkey, * EXCLUDE (o_orderkey, o_custkey) FROM '{p}'""",
    "customer": """SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE c_nationkey
        END AS c_nationkey, * EXCLUDE (c_custkey, c_name, c_nationkey) FROM '{p}'""",
    "documents": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN (SELECT text FROM '{p}'
        WHERE doc_id = 1) ELSE text END AS text, * EXCLUDE (doc_id, text) FROM '{p}'""",
    "embeddings": """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN (SELECT embedding FROM '{p}'
        WHERE vec_id = 1) ELSE embedding END AS embedding,
        CASE WHEN vec_id % 3 = 0 THEN 3 ELSE label END AS label FROM '{p}'""",
    "events": """SELECT event_id, ts, user_id, CASE WHEN event_id % 3 = 0 THEN 'click'
        ELSE event_type END AS event_type, value, CASE WHEN event_id % 3 = 0
        THEN '{{"k": 1}}' ELSE props END AS props FROM '{p}'""",
}
NAMES = ["A2_category_revenue", "A4_product_region_sales", "A9_product_performance",
         "K7_dashboard_view", "X3_transformation_list", "J1_customer_orders", "J2_cross_source_customers", "J3_orphan_orders", "J4_order_facts",
         "A10_country_analytics", "A15_id_lists", "A26_dominant_value", "A36_daily_event_stats",
         "W10_top_rows_per_group", "Q6_check_suite", "V2_nearest", "V8_tfidf",
         "V11_semantic_search", "V13_similarity_blocks", "V19_cluster_profile", "R3_day_stats",
         "R6_sales_batches"]


@pytest.fixture(scope="module")
def hot(sf_dir, tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("hot"), duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        rows = HOT.get(name, "SELECT * FROM '{p}'").format(p=path)
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_hot_key(name, spark, hot):
    folder, con = hot
    df = entry.queries()[name](spark, folder)
    names = sorted(df.columns)
    mine = sorted(tuple(repr(r[c]) for c in names) for r in df.collect())
    got = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    theirs = sorted(tuple(repr(v) for _, v in sorted(zip(columns, row))) for row in got.fetchall())
    assert mine == theirs
