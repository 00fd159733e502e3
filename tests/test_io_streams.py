"""Readers, writers, generators, jobs and streams."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.scalars import json_int
from millrace.plans import etl
from millrace.sources import generators as gen, readers, sinks
from millrace.sources.shared import shared_folder
from millrace.streaming import events as st


def test_union_of_different_headers(spark):
    base = shared_folder(spark, "test-union")
    spark.createDataFrame([(1, "a")], "x INT, y STRING").write.option("header", True).csv(f"{base}/1")
    spark.createDataFrame([("b", 2, 0.5)], "y STRING, x INT, z DOUBLE").write.option(
        "header", True).csv(f"{base}/2")
    both = readers.union_by_name([readers.read_csv(spark, f"{base}/1", "x INT, y STRING"),
                                  readers.read_csv(spark, f"{base}/2", "y STRING, x INT, z DOUBLE")])
    assert sorted(map(tuple, both.collect())) == [(1, "a", None), (2, "b", 0.5)]


def test_preview_infers_types(spark):
    path = shared_folder(spark, "test-preview")
    spark.range(30).withColumn("v", F.col("id") / 2).write.option("header", True).csv(path)
    df = readers.preview_csv(spark, path, 3, ["id"])
    assert [tuple(r) for r in df.collect()] == [(0, 0.0), (1, 0.5), (2, 1.0)]


def test_bound_values_are_not_text(spark):
    df = spark.createDataFrame([("a' OR '1'='1",), ("b",)], "s STRING")
    got = readers.bound_query(spark, "SELECT * FROM {t} WHERE s = :v", {"v": "a' OR '1'='1"}, t=df)
    assert got.count() == 1


def test_no_source_left(spark):
    with pytest.raises(LookupError, match="one: empty"):
        readers.read_first_nonempty([("one", lambda: spark.range(0)),
                                     ("two", lambda: spark.read.parquet("/nonexistent"))])


def test_generators_repeat_themselves(spark):
    ids = spark.range(500)
    one, two = gen.sample_orders(ids).collect(), gen.sample_orders(ids.repartition(5)).collect()
    assert sorted(one) == sorted(two)
    assert {r["product_category"] for r in one} == set(gen.PRODUCTS)
    for r in one:
        assert r["product_name"] in gen.PRODUCTS[r["product_category"]]
        assert gen.CITIES[r["ship_city"]] == r["ship_state"]
        assert r["total_amount"] == r["unit_price"] * r["quantity"] and 10 <= r["unit_price"] <= 500
        assert 1 <= r["quantity"] <= 5
    for r in gen.sample_events(ids).collect():
        assert 1 <= json.loads(r["event_data"])["user_id"] <= 1000
    assert gen.number_series(spark, 1, 4).count() == 4


def test_partitioned_write_splits_a_heavy_value(spark):
    df = spark.range(4000).withColumn("p", F.when(F.col("id") < 3900, "hot").otherwise("cold"))
    path = shared_folder(spark, "test-partitioned")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "4KB")  # so that these few rows count as a heavy value
    try:
        back = sinks.write_partitioned(df.repartition(16), path, ["p"])
    finally:
        spark.conf.unset(size)
    files = back.groupBy("p").agg(F.countDistinct(F.col("_metadata.file_path")).alias("n"))
    counts = {r["p"]: r["n"] for r in files.collect()}
    assert counts["hot"] > counts["cold"] and counts["hot"] >= 2 and back.count() == 4000


def test_append_new_keys_only(spark):
    path = shared_folder(spark, "test-keys")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k STRING, v INT")
    sinks.append_parquet(rows, path)
    sinks.append_new_keys(spark.createDataFrame([("b", 9), ("c", 3)], "k STRING, v INT"),
                          spark.read.parquet(path), ["k"], path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [
        ("a", 1), ("b", 2), ("c", 3)]
    for _ in range(2):
        sinks.append_new_keys(spark.createDataFrame([(None, 5), (None, 5), ("c", 4)], "k STRING, v INT"),
                              spark.read.parquet(path), ["k"], path)
    assert spark.read.parquet(path).filter("k IS NULL").count() == 1
    assert spark.read.parquet(path).count() == 4


def test_export_refuses_unknown_and_changed_copies(spark):
    root = shared_folder(spark, "test-export")
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    row = etl.export(df, root, "numbers", "e1", datetime.datetime(2024, 1, 1)).first()
    assert row["verified"] and row["row_count"] == 100
    assert etl.restore(spark, root, "numbers", "e1", f"{root}/back").count() == 100
    with pytest.raises(LookupError):
        etl.restore(spark, root, "numbers", "e2", f"{root}/back2")
    df.filter("id < 99").write.mode("append").parquet(f"{root}/e1/numbers")
    with pytest.raises(ValueError, match="differs"):
        etl.restore(spark, root, "numbers", "e1", f"{root}/back")
    assert spark.read.parquet(f"{root}/back").count() == 100  # a damaged export touches nothing


def test_fingerprint_ignores_order_but_not_repeats(spark):
    df = spark.range(50).withColumn("v", F.col("id") % 7)
    same = etl.fingerprint(df.orderBy(F.rand(3))).first()
    assert etl.fingerprint(df).first() == same
    assert etl.fingerprint(df.union(df)).first() != same


def test_job_rejects_unknown_types(spark):
    with pytest.raises(ValueError):
        etl.extract(spark, {"type": "magic"})
    with pytest.raises(ValueError):
        etl.load(spark.range(1), {"type": "magic"})


EVENT_SCHEMA = ("event_id LONG, event_type STRING, event_data STRING, event_time TIMESTAMP_NTZ")


@pytest.fixture(scope="module")
def event_files(spark):
    """Three days of events, one file each, so that a stream takes three batches."""
    path, rows = shared_folder(spark, "test-events"), []
    for day in range(3):
        for i in range(40):
            at = datetime.datetime(2024, 1, 1 + day, i // 2, 5)
            body = {"k": i % 7} | ({"session_id": "s"} if i % 4 == 0 else {})
            rows.append((day * 100 + i, ["view", "purchase"][i % 2], json.dumps(body), at))
        part = spark.createDataFrame(rows[-40:], EVENT_SCHEMA).coalesce(1)
        part.write.mode("append").parquet(path)
    return path, rows


def test_stream_in_batches_equals_batch(spark, event_files):
    path, rows = event_files
    out = shared_folder(spark, "test-r3")
    stream = st.file_stream(spark, path, EVENT_SCHEMA, files_per_batch=1)
    st.run_batches(stream, out, st.user_day_batches(out))
    assert st.stored(spark, out).select("batch_id").distinct().count() == 3
    stats = st.day_stats(st.merged(st.stored(spark, out), ["analysis_date", "user_key"],
                                   ["events", "with_session"]))
    for r in stats.collect():
        assert (r["total_events"], r["unique_users"], r["session_share"]) == (40, 7, 0.25)
    assert stats.count() == 3


def test_late_rows_count_in_partial_sums(spark, event_files):
    """A batch of old events that arrives last is added, and a repeated batch is not."""
    out = shared_folder(spark, "test-late")
    rows = spark.createDataFrame(event_files[1], EVENT_SCHEMA)
    write = st.user_day_batches(out)
    write(rows.filter("event_time >= '2024-01-03'"), 0)
    write(rows.filter("event_time < '2024-01-03'"), 1)
    write(rows.filter("event_time < '2024-01-03'"), 1)
    merged = st.merged(st.stored(spark, out), ["analysis_date", "user_key"],
                       ["events", "with_session"])
    assert {r["total_events"] for r in st.day_stats(merged).collect()} == {40}


def test_order_over_two_batches_counts_once(spark):
    out = shared_folder(spark, "test-sales")
    lines = spark.createDataFrame(
        [(1, "2024-01-01", "a", 10), (1, "2024-01-01", "a", 5), (2, "2024-01-01", "a", 1), (1, "2024-01-01", "b", 2)],
        "order_id LONG, batch_date STRING, product_category STRING, total_amount LONG")
    write = st.sales_batches(lambda batch: batch, out)
    for i, part in enumerate(("total_amount = 10", "total_amount = 5", "total_amount < 5")):
        write(lines.filter(part), i)
    write(lines.filter("total_amount < 5"), 2)  # a repeated batch
    got = st.sales(st.stored(spark, out)).select("product_category", "new_orders", "new_revenue").collect()
    assert sorted(map(tuple, got)) == [("a", 2, 16), ("b", 1, 2)]


def test_newest_summary_covers_all_batches(spark, event_files):
    path, rows = event_files
    out = shared_folder(spark, "test-summary")

    def summary(user_rows):
        return st.merged(user_rows, ["user_key"], ["events"]).agg(
            F.sum("events").alias("events"), F.count("user_key").alias("users"))

    st.run_batches(st.file_stream(spark, path, EVENT_SCHEMA, files_per_batch=1), out, st.summary_log(
        [json_int("event_data", "$.k").alias("user_key")], [F.count("*").alias("events")], summary, out))
    log = st.stored(spark, out).orderBy("batch_id").collect()
    assert [(r["events"], r["users"]) for r in log] == [(40, 7), (80, 7), (120, 7)]


def test_splits_keep_null_rows(spark):
    rows = spark.createDataFrame([(1, "PROMO", 5), (2, None, None), (3, "x", 300000)], "id INT, domain STRING, a INT")
    promo = F.col("domain").eqNullSafe("PROMO")
    small = F.coalesce(F.col("a") < 250000, F.lit(False))
    for side in (promo, small):
        assert rows.filter(side).count() + rows.filter(~side).count() == 3


def test_restarted_stream_adds_nothing(spark, event_files):
    path, rows = event_files
    out = shared_folder(spark, "test-restart")
    for _ in range(2):
        stream = st.file_stream(spark, path, EVENT_SCHEMA)
        st.run_batches(stream, out, st.store_batch(out))
    assert st.stored(spark, out).count() == len(rows)


def test_repeated_batch_replaces_itself(spark):
    out = shared_folder(spark, "test-repeat")
    write = st.store_batch(out)
    write(spark.range(5), 0)
    write(spark.range(5), 0)
    write(spark.range(5, 8), 1)
    assert st.stored(spark, out).count() == 8


def test_rolling_counts_equal_brute_force(spark, event_files):
    path, rows = event_files
    out = shared_folder(spark, "test-r2")
    stream = st.file_stream(spark, path, EVENT_SCHEMA, files_per_batch=1)
    st.run_batches(st.hourly_counts(stream), out, st.store_batch(out), "update")
    hours = st.newest_per_key(st.stored(spark, out), ["hour", "event_type"])
    for r in st.rolling_counts(hours).collect():
        end = r["window_start"] + datetime.timedelta(hours=24)
        assert r["event_count"] == sum(
            r["window_start"] <= at < end and kind == r["event_type"] for _, kind, _, at in rows)


def test_approximate_users(spark, event_files):
    path, _ = event_files
    out = shared_folder(spark, "test-approx")
    stream = st.file_stream(spark, path, EVENT_SCHEMA)
    st.run_batches(st.approximate_day_stats(stream), out, st.store_batch(out), "update")
    for r in st.newest_per_key(st.stored(spark, out), ["analysis_date"]).collect():
        assert r["total_events"] == 40 and 6 <= r["approx_users"] <= 8


def test_message_that_does_not_parse(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("not json",)], "value STRING")
    got = df.select(readers.parse_message(F.col("value"), "a INT").alias("m")).select("m.a")
    assert sorted((r["a"] is None, r["a"]) for r in got.collect()) == [(False, 1), (True, None)]


def test_shared_folder_follows_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert base is None or shared_folder(spark, "x").startswith(base.rstrip("/"))
