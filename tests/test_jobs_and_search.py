"""Header discovery, streams of several batches, postings, stored models, watched writes, k-means starts."""

import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.operators import quality, text as tx, vectors as vx
from millrace.plans import etl, stream_queries as sq
from millrace.sources import datasets as ds, readers
from millrace.sources.shared import shared_folder
from millrace.streaming import events as st


def _lines(spark, path, *lines):
    spark.createDataFrame([(line,) for line in lines], "value STRING").coalesce(1).write.text(path)


def test_files_of_unlike_headers(spark):
    base = shared_folder(spark, "headers")
    _lines(spark, f"{base}/a [1]", "id,name", "1,x", "2,y")
    _lines(spark, f"{base}/b", "name,id,amount", "z,3,1.5")
    _lines(spark, f"{base}/c", "id,name", "4,w")
    _lines(spark, f"{base}/d", "Amount,\"odd, name\",id", "2.5,q,5")
    _lines(spark, f"{base}/e")
    headers = {r["header"]: len(r["files"]) for r in readers.file_headers(spark, f"{base}/*", "*.txt").collect()}
    assert headers == {"id,name": 2, "name,id,amount": 1, 'Amount,"odd, name",id': 1}
    got = readers.read_csv_by_header(spark, f"{base}/*", "id BIGINT, name STRING, amount DOUBLE", "*.txt")
    assert got.columns == ["id", "name", "amount", "odd, name"]
    assert sorted(map(tuple, got.collect())) == [(1, "x", None, None), (2, "y", None, None), (3, "z", 1.5, None),
                                                 (4, "w", None, None), (5, None, 2.5, "q")]


def test_types_of_unlike_headers_are_found(spark):
    base = shared_folder(spark, "headers")
    _lines(spark, f"{base}/a", "id,v", "1,2")
    _lines(spark, f"{base}/b", "v,id,w", "2.5,30000000000,x")
    got = readers.read_csv_by_header(spark, f"{base}/*")
    assert [t for _, t in got.dtypes] == ["bigint", "double", "string"]
    assert sorted(map(tuple, got.collect())) == [(1, 2.0, None), (30000000000, 2.5, "x")]


def test_arrivals_make_several_batches_and_a_restart(spark, sf_dir):
    path, seen = shared_folder(spark, "arrivals-test"), []
    write = st.hourly_batches(path)
    events = ds.table(spark, sf_dir, "events")
    for stream in sq._event_streams(spark, sf_dir):
        query = st.run_batches(stream, path, write)
        seen.append([p.batchId for p in query.recentProgress if p.numInputRows])
    assert len(seen[0]) >= 3 and seen[1] and min(seen[1]) > max(seen[0])  # goes on from the checkpoint
    rows = st.stored(spark, path)
    by_batch = {r["batch_id"]: (r["hour"], r["n"]) for r in rows.groupBy("batch_id").agg(
        F.min("hour").alias("hour"), F.sum("event_count").alias("n")).collect()}
    newest = rows.where(F.col("batch_id") <= max(seen[0])).agg(F.max("hour")).first()[0]
    assert by_batch[seen[1][0]][0] < newest  # late rows
    assert sum(n for _, n in by_batch.values()) == events.count()


def test_order_that_arrives_in_two_hours(spark):
    rows = spark.createDataFrame([("d", "h1", 1, 10), ("d", "h1", 1, 5), ("d", "h2", 1, 7), ("d", "h2", 2, 1), ("e", "h1", 3, 9)],
                                 "batch_date STRING, hour STRING, order_id INT, amount INT")
    assert sorted(map(tuple, st.hourly_sales(rows, F.lit("d")).collect())) == [("h1", 1, 15), ("h2", 2, 8)]


def test_newest_of_a_hot_key(spark):
    rows = spark.range(3000).selectExpr("if(id < 2900, 0, id) AS k", "id AS batch_id", "id * 2 AS v")
    got = {r["k"]: r["v"] for r in st.newest_per_key(rows, ["k"]).collect()}
    assert got[0] == 5798 and len(got) == 101


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randrange(0, 30))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts + [None, texts[0]])], "id LONG, text STRING")
    return tx.fit_weighed(docs, "text", 50, stop_words=["w3"])


def test_postings_find_what_scoring_all_finds(spark, corpus):
    weighted, model = corpus
    queries = {"common": "w0 w1 w2", "rare": "w44 w45 w47", "mixed": "w0 w30", "one": "w9", "none": "zzz w3", "empty": ""}
    want = {}
    for r in tx.score(weighted.select("id", "weights"), queries, model).collect():
        want.setdefault(r["query_id"], []).append((-r["similarity"], r["id"]))
    for k in (1, 3, 20):
        got = {}
        for r in tx.search(weighted, "id", queries, model, k).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], -r["similarity"], r["id"]))
        for q in queries:
            assert [(s, i) for _, s, i in sorted(got[q])] == [(s + 0.0, i) for s, i in sorted(want[q])[:k]], q


def test_prefix_filter_misses_no_pair(spark, corpus):
    weighted, model = corpus
    classes, members = tx.vector_classes(weighted, "id")
    vectors = {r["id"]: r["weights"] for r in weighted.collect() if r["weights"]}
    of = {r["id"]: r["class_id"] for r in members.collect()}
    assert set(of) == set(vectors) and of[401] == of[0] == 0
    reps = sorted(set(of.values()))
    for threshold in (0.5, 0.8):
        got = {(r["class_a"], r["class_b"]): r["similarity"] for r in tx.similar_classes(classes, model, threshold).collect()}
        dots = {(a, b): sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items()) for a in reps for b in reps if a < b}
        assert set(got) == {p for p, d in dots.items() if round(d, 8) >= threshold}
        assert got and all(abs(got[p] - dots[p]) < 1e-7 for p in got)
    near = {(r["class_a"], r["class_b"]) for r in tx.similar_classes(classes, model, 0.9955).collect()}  # joined by cells
    assert near == {p for p, d in dots.items() if round(d, 8) >= 0.9955}


def test_only_postings_of_the_query_are_read(spark, corpus):
    weighted, model = corpus
    path = shared_folder(spark, "postings-test")
    tx.write_postings(weighted, "id", path, champions=8)
    plan = tx.search_postings(weighted.select("id"), "id", path, {"q": "w5 w6"}, model, 3)._jdf.queryExecution(
        ).executedPlan().toString()
    assert "In(term, [w5,w6])" in plan and "GreaterThanOrEqual(weight" in plan


def test_texts_are_tokenised_once(spark, corpus):
    plan = corpus[0]._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan  # weights come from the stored counts


def test_table_function_in_sql(spark):
    tables.register(spark)
    rows = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, None), (3, "no json"), (4, "[1]"), (5, '{"c": {"d": 2}}')],
                                 "id INT, props STRING")
    got = spark.sql("SELECT id, p.* FROM {t} AS t, LATERAL json_pairs(t.props) AS p", t=rows).collect()
    assert sorted(map(tuple, got)) == [(1, "a", "1"), (1, "b", "x"), (5, "c", '{"d": 2}')]


def test_stored_model(spark):
    rows = spark.createDataFrame([(i, float(i), 3.0 * i + 2) for i in range(50)] + [(50, None, 1.0), (51, 4.0, None)],
                                 "id INT, x DOUBLE, y DOUBLE")
    path = shared_folder(spark, "model-test")
    etl.fit_and_store(rows, ["x"], "y", path)
    got = {r["id"]: r["prediction"] for r in etl.score_stored(rows, "id", path).collect()}
    assert set(got) == set(range(50)) | {51}
    assert all(abs(p - (3.0 * (4 if i == 51 else i) + 2)) < 1e-6 for i, p in got.items())


def test_checks_of_the_writing_pass(spark):
    rows = spark.range(100).withColumn("v", F.col("id") - 3)
    kept, results = quality.watched(rows, {"not negative": quality.violations(F.col("v") < 0),
                                           "small": quality.violations(F.col("v") > 1000)})
    path = shared_folder(spark, "watched")
    kept.write.parquet(path)
    assert sorted((r["check_name"], r["observed"], r["passed"]) for r in results().collect()) == [
        ("not negative", 3, False), ("small", 0, True)]
    assert spark.read.parquet(path).count() == 100


def test_starts_are_never_worse_than_one(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(6, 5))[rng.integers(0, 6, 300)] * 4 + 0.2 * rng.normal(size=(300, 5))
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)] + [(999, None)],
                                 "id LONG, vector ARRAY<DOUBLE>").repartition(5)
    clustered, centers, costs = vx.kmeans_starts(rows, 6)
    got = clustered.collect()
    assert len(got) == 301 and [r["cluster"] for r in got if r["id"] == 999] == [None]
    total = sum(r["distance"] for r in got if r["distance"] is not None)
    assert abs(total - min(costs)) < 1e-6 * total and len(costs) == 10
    assert total <= vx.kmeans_starts(rows, 6, starts=1)[2][0] + 1e-9
    exact = sum(min(((p - np.array(c["vector"])) ** 2).sum() for c in centers.collect()) for p in points)
    assert abs(exact - total) < 1e-6 * total
    assert vx.kmeans_starts(rows.where("id < 0"), 3)[2] == []


def _exports(spark, *days):
    root = shared_folder(spark, "exports")
    data = spark.range(5)
    for day in days:
        for name in ("a", "b"):
            etl.export(data, root, name, f"day-{day}", datetime.datetime(2024, 5, day))
    return root


def test_expired_exports_are_removed(spark):
    root, now = _exports(spark, 1, 2, 20), F.lit("2024-05-25 00:00:00").cast("timestamp")
    etl.export(spark.range(3), root, "b", "day-2", datetime.datetime(2024, 5, 21))  # renews a part of day-2
    assert [r["export_id"] for r in etl.remove_expired(spark, root, now, 10).collect()] == ["day-1"]
    assert not os.path.exists(f"{root}/day-1") and os.path.exists(f"{root}/day-2/a")
    assert {r["export_id"] for r in etl.live_exports(spark, root).collect()} == {"day-2", "day-20"}
    with pytest.raises(LookupError):
        etl.restore(spark, root, "a", "day-1", f"{root}-back")
    assert etl.restore(spark, root, "a", "day-20", f"{root}-back").count() == 5
    assert etl.remove_expired(spark, root, now, 100).count() == 1  # the log still names day-1, and only it
    assert {r["export_id"] for r in etl.live_exports(spark, root).collect()} == {"day-2", "day-20"}


def test_a_stopped_removal_is_finished_by_the_next(spark):
    root, now = _exports(spark, 1, 20), F.lit("2024-05-25 00:00:00").cast("timestamp")
    spark.sql("SELECT 'day-1' AS export_id, current_timestamp() AS retired_at").write.parquet(f"{root}/retired")
    assert os.path.exists(f"{root}/day-1")
    etl.remove_expired(spark, root, now, 10)
    assert not os.path.exists(f"{root}/day-1") and os.path.exists(f"{root}/day-20")


def test_names_outside_the_root_are_never_removed(spark):
    root, now = _exports(spark, 20), F.lit("2025-05-25 00:00:00").cast("timestamp")
    row = spark.read.parquet(f"{root}/manifest").limit(1)
    for name in ("../other", "..", ".", "", "manifest", "a/b"):
        row.withColumn("export_id", F.lit(name)).write.mode("append").parquet(f"{root}/manifest")
    assert [r["export_id"] for r in etl.remove_expired(spark, root, now, 10).collect()] == ["day-20"]
    assert os.path.exists(f"{root}/manifest")


def test_columns_and_list_of_vector_tables(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], None), (2, None, "x"), (None, [1.0], "y")],
                                 "id long, vector array<double>, `a.b` string")
    got = [tuple(r) for r in vx.table_columns(rows).orderBy("place").collect()]
    assert got == [(0, "id", "bigint", 2), (1, "vector", "array<double>", 2), (2, "a.b", "string", 2)]
    path = shared_folder(spark, "db")
    database = f"db_{path.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{path}'")
    assert vx.table_list(spark, database).collect() == []
    rows.select("id", "vector").write.saveAsTable(f"{database}.held", path=f"{path}/held")
    spark.range(3).withColumnRenamed("id", "vector").write.saveAsTable(f"{database}.plain", path=f"{path}/plain")
    (only,) = vx.table_list(spark, database).collect()
    assert (only["table_name"], only["row_count"], only["max_dims"]) == ("held", 3, 2)
    assert only["schema"] == "struct<id:bigint,vector:array<double>>"
