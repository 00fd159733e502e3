"""Versions of the customer table (ids T, J6), derived from the given tables.

    1-3  customers of nations 0-7, 8-15 and the rest, the last with a phone column
    4    upsert: overdrawn customers get the tier 'Review', suppliers are inserted
    5    delete of rows with a balance over 9000
    6    rollback to version 3
"""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from millrace.operators import versioned as vt
from millrace.plans.registry import QuerySet
from millrace.plans.sql_views import CUSTOMERS
from millrace.sources import datasets as ds
from millrace.sources.shared import shared_folder

Q = QuerySet()

_START = datetime.datetime(2024, 3, 1)
_OPERATIONS = ["append", "append", "append", "merge", "delete", "rollback"]
_RICH = "balance > 9000"


def _first_version():
    """The version that appended a customer; those without a nation came last."""
    nation = F.col("c_nationkey")
    return F.when(nation < 8, 1).when(nation < 16, 2).otherwise(3)


def _appended(spark, sf, until=3):
    """The state after the first ``until`` versions, from one scan; ``_first`` is a row's version."""
    rows = ds.customers(spark, sf).withColumn("_first", _first_version())
    phone = F.when(F.col("_first") == 3, F.concat(F.lit("+1-"), F.col("customer_id").cast("string")))
    if until < 3:
        rows = rows.filter(F.col("_first") <= until)
    return rows.select("customer_id", F.col("customer_name").alias("name"), "email", "tier", "balance",
                       phone.alias("phone"), "_first")


def _merge_source(spark, sf):
    overdrawn = _appended(spark, sf).filter("balance < 0").drop("_first", "phone").withColumn(
        "tier", F.lit("Review"))
    suppliers = ds.table(spark, sf, "supplier").select(
        (F.lit(1_000_000_000_000) + F.col("s_suppkey")).alias("customer_id"),
        F.col("s_name").alias("name"), F.lit(None).cast("string").alias("email"),
        F.lit("Supplier").alias("tier"), F.col("s_acctbal").cast("decimal(12,2)").alias("balance"))
    return overdrawn.unionByName(suppliers)


def _state(spark, sf, version):
    """The customer table at a version."""
    if version <= 3 or version == 6:
        return _appended(spark, sf, min(version, 3)).drop("_first")
    merged = vt.upsert(_state(spark, sf, 3), _merge_source(spark, sf), "customer_id", ["tier"])
    return merged if version == 4 else vt.delete_where(merged, F.expr(_RICH))


def _log(spark, sf, until=6):
    """The change rows of the first ``until`` versions."""
    state = lambda version: _state(spark, sf, version)
    log = vt.puts(_appended(spark, sf, min(until, 3)), F.col("_first")).drop("_first")
    if until >= 4:
        log = log.unionByName(vt.puts(vt.merge_rows(
            state(3), _merge_source(spark, sf), "customer_id", ["tier"]), 4))
    if until >= 5:
        log = log.unionByName(vt.deletes(state(4).filter(_RICH), 5))
    if until >= 6:
        log = log.unionByName(vt.rollback_changes(state(3), state(5), "customer_id", 6))
    return log


def _commits(spark):
    """When each version was made, and by what."""
    return spark.createDataFrame(
        [(v, _START + datetime.timedelta(days=v), op) for v, op in enumerate(_OPERATIONS, 1)],
        "version BIGINT, committed_at TIMESTAMP, operation STRING")


def _state_sql(version: int) -> str:
    version = 3 if version == 6 else version
    bound = {1: 8, 2: 16}.get(version, 1000)
    tier = "CASE WHEN balance < 0 THEN 'Review' ELSE tier END" if version >= 4 else "tier"
    sql = f"""SELECT customer_id, customer_name AS name, email, {tier} AS tier, balance,
        CASE WHEN COALESCE(c_nationkey, 24) >= 16 THEN '+1-' || customer_id END AS phone
        FROM {CUSTOMERS} AS c WHERE COALESCE(c_nationkey, 24) < {bound}"""
    if version >= 4:
        sql += """ UNION ALL SELECT 1000000000000 + s_suppkey, s_name, NULL, 'Supplier',
            CAST(s_acctbal AS DECIMAL(12,2)), NULL FROM supplier"""
    if version == 5:
        sql = f"SELECT * FROM ({sql}) AS m WHERE balance <= 9000"
    return f"({sql})"


_ROW = "customer_id long, name str, email str, tier str, balance dbl, phone str"


@Q.add("T1_history", "version long, operation str, committed_at ts, rows_put long, "
       "rows_deleted long",
       f"""WITH n(version, operation, rows_put, rows_deleted) AS (
           SELECT 1, 'append', COUNT(*), 0 FROM {CUSTOMERS} AS c WHERE c_nationkey < 8
           UNION ALL SELECT 2, 'append', COUNT(*), 0 FROM {CUSTOMERS} AS c
             WHERE c_nationkey >= 8 AND c_nationkey < 16
           UNION ALL SELECT 3, 'append', COUNT(*), 0 FROM {CUSTOMERS} AS c WHERE COALESCE(c_nationkey, 24) >= 16
           UNION ALL SELECT 4, 'merge', COUNT(*), 0 FROM {_state_sql(4)} AS s
             WHERE tier IN ('Review', 'Supplier')
           UNION ALL SELECT 5, 'delete', 0, COUNT(*) FROM {_state_sql(4)} AS s
             WHERE balance > 9000
           UNION ALL SELECT 6, 'rollback',
             (SELECT COUNT(*) FROM {_state_sql(3)} AS s WHERE balance < 0 OR balance > 9000),
             (SELECT COUNT(*) FROM supplier WHERE s_acctbal <= 9000))
           SELECT *, TIMESTAMP '2024-03-01' + version * INTERVAL 1 DAY AS committed_at FROM n""")
def t1(spark, sf):
    return vt.history(_log(spark, sf), _commits(spark)).orderBy("version")


@Q.add("T2_file_inventory", "table_name str, file_format str, has_files bool, record_count long",
       " UNION ALL ".join(f"SELECT '{t}' AS table_name, 'parquet' AS file_format, TRUE AS has_files, "
                          f"COUNT(*) AS record_count FROM {t}" for t in ("customer", "supplier", "orders")))
def t2(spark, sf):
    files = vt.evolve(*[vt.file_inventory(ds.table(spark, sf, t)).withColumn("table_name", F.lit(t))
                        for t in ("customer", "supplier", "orders")])
    return files.groupBy("table_name", "file_format").agg(
        (F.count("*") > 0).alias("has_files"), F.sum("record_count").alias("record_count"))


@Q.add("T3_version_as_of", _ROW, f"SELECT * FROM {_state_sql(2)} AS s")
def t3(spark, sf):
    return vt.as_of_version(_log(spark, sf), "customer_id", 2)


@Q.add("T4_timestamp_as_of", _ROW, f"SELECT * FROM {_state_sql(4)} AS s")
def t4(spark, sf):
    moment = F.lit("2024-03-05 12:00:00").cast("timestamp")
    return vt.as_of_timestamp(_log(spark, sf), _commits(spark), "customer_id", moment)


@Q.add("T5_compare_versions", "timepoint str, record_count long",
       f"""SELECT 'Current' AS timepoint, COUNT(*) AS record_count FROM {_state_sql(5)} AS s
           UNION ALL SELECT 'Historical', COUNT(*) FROM {_state_sql(1)} AS s""")
def t5(spark, sf):
    return vt.compare_counts({"Current": _state(spark, sf, 5), "Historical": _state(spark, sf, 1)})


@Q.add("T5_version_diff", "change str, row_count long",
       f"""WITH o AS (SELECT * FROM {_state_sql(3)} AS s), n AS (SELECT * FROM {_state_sql(5)} AS s)
           SELECT change, COUNT(*) AS row_count FROM (
             SELECT CASE WHEN o.customer_id IS NULL THEN 'added' WHEN n.customer_id IS NULL
               THEN 'removed' WHEN o.tier <> n.tier THEN 'changed' END AS change
             FROM o FULL OUTER JOIN n ON o.customer_id = n.customer_id) AS d
           WHERE change IS NOT NULL GROUP BY 1""")
def t5_diff(spark, sf):
    return vt.diff(_state(spark, sf, 3), _state(spark, sf, 5), "customer_id").groupBy("change").agg(
        F.count("*").alias("row_count"))


def _evolved(spark, sf):
    """Old rows without the phone column and new rows with it, read as one table."""
    first, rows = F.col("_first"), _appended(spark, sf)
    return vt.evolve(rows.filter(first < 3).drop("_first", "phone"), rows.filter(first == 3).drop("_first"))


@Q.add("T6_added_column", "has_phone bool, row_count long",
       f"""SELECT phone IS NOT NULL AS has_phone, COUNT(*) AS row_count
           FROM {_state_sql(3)} AS s GROUP BY 1""")
def t6(spark, sf):
    return _evolved(spark, sf).groupBy(F.col("phone").isNotNull().alias("has_phone")).agg(
        F.count("*").alias("row_count"))


@Q.add("T7_renamed_column", "customer_id long, revenue dbl",
       f"SELECT customer_id, balance AS revenue FROM {_state_sql(6)} AS s")
def t7(spark, sf):
    return vt.renamed(_state(spark, sf, 6), {"balance": "revenue"}).select("customer_id", "revenue")


@Q.add("T8_evolved_append", "customer_id long, name str, email str, phone str",
       f"""SELECT customer_id, name, email, phone FROM {_state_sql(3)} AS s
           WHERE phone IS NOT NULL""")
def t8(spark, sf):
    return _evolved(spark, sf).filter(F.col("phone").isNotNull()).select("customer_id", "name", "email", "phone")


@Q.add("T9_upsert", _ROW, f"SELECT * FROM {_state_sql(4)} AS s")
def t9(spark, sf):
    return vt.upsert(_state(spark, sf, 3), _merge_source(spark, sf), "customer_id", ["tier"])


@Q.add("J6_merge_key_match", "customer_id long, tier str",
       f"""SELECT customer_id, tier FROM {_state_sql(4)} AS s
           WHERE tier IN ('Review', 'Supplier')""")
def j6(spark, sf):
    return vt.merge_rows(_state(spark, sf, 3), _merge_source(spark, sf), "customer_id", ["tier"])


@Q.add("T10_rollback", _ROW, f"SELECT * FROM {_state_sql(6)} AS s")
def t10(spark, sf):
    return vt.as_of_version(_log(spark, sf), "customer_id", 6)


@Q.add("T10_rollback_preview", "action str, records long",
       f"""WITH o AS (SELECT * FROM {_state_sql(3)} AS s), n AS (SELECT * FROM {_state_sql(5)} AS s)
           SELECT CASE WHEN o.customer_id IS NULL THEN 'Would Remove' WHEN n.customer_id IS NULL
             THEN 'Would Restore' WHEN o.tier <> n.tier THEN 'Would Revert' ELSE 'Would Keep' END
             AS action, COUNT(*) AS records
           FROM o FULL OUTER JOIN n ON o.customer_id = n.customer_id GROUP BY 1""")
def t10_preview(spark, sf):
    return vt.rollback_preview(_state(spark, sf, 3), _state(spark, sf, 5), "customer_id")


@Q.add("T11_predicate_delete", _ROW, f"SELECT * FROM {_state_sql(5)} AS s")
def t11(spark, sf):
    return vt.delete_where(_state(spark, sf, 4), F.expr(_RICH))


@Q.add("T12_compaction", "file_count_ok bool, record_count long",
       f"""SELECT TRUE AS file_count_ok, COUNT(*) AS record_count FROM {_state_sql(6)} AS s""")
def t12(spark, sf):
    path = shared_folder(spark, "compacted")
    _state(spark, sf, 6).hint("rebalance").write.parquet(path)  # files of the advisory size, however many that makes
    files = vt.file_inventory(spark.read.parquet(path))
    return files.agg(((F.count("*") <= 4) | (F.avg("record_count") >= 10_000)).alias("file_count_ok"),
                     F.sum("record_count").alias("record_count"))


@Q.add("T13_expire_snapshots", "version long, row_count long, state_rows long",
       f"""SELECT 3 AS version, COUNT(*) AS row_count, (SELECT COUNT(*) FROM {_state_sql(5)} AS s)
             AS state_rows FROM {_state_sql(3)} AS s
           UNION ALL SELECT 4, COUNT(*), (SELECT COUNT(*) FROM {_state_sql(5)} AS s)
             FROM {_state_sql(4)} AS s WHERE tier IN ('Review', 'Supplier')
           UNION ALL SELECT 5, COUNT(*), (SELECT COUNT(*) FROM {_state_sql(5)} AS s)
             FROM {_state_sql(4)} AS s WHERE balance > 9000""")
def t13(spark, sf):
    kept = vt.expire(_log(spark, sf, 5), "customer_id", 3)
    rows = vt.as_of_version(kept, "customer_id").agg(F.count("*")).scalar()
    return kept.groupBy(F.col("_version").alias("version")).agg(
        F.count("*").alias("row_count")).withColumn("state_rows", rows)


_ORDER_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
                ("o_orderpriority", "string")]


@Q.add("T14_table_columns", "column_name str, data_type str, is_nullable bool, filled_rows long",
       " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS data_type, TRUE AS is_nullable, "
                          f"COUNT({c}) AS filled_rows FROM orders" for c, t in _ORDER_TYPES))
def t14(spark, sf):
    orders = ds.table(spark, sf, "orders")
    orders.createOrReplaceTempView("millrace_orders_raw")
    filled = orders.agg(*[F.count(c).alias(c) for c in orders.columns]).unpivot(
        [], orders.columns, "column_name", "filled_rows")
    return vt.describe(spark, "millrace_orders_raw").join(filled, "column_name")
