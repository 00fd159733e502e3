"""Vectors and text against brute force in numpy and plain Python."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.scalars import md5_vector
from millrace.operators import text as tx, vectors as vx
from millrace.operators.small_sets import as_array

TEXTS = ["Spark joins large tables on a cluster", "large tables need partitions", "",
         "the cluster runs joins and joins again", "SPARK joins large tables on a cluster",
         "vectors and tables are different"]
STOP = ["the", "and", "on", "a", "are"]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(60, 8))
    m[7] = m[3]
    rows = [(i, m[i].tolist(), int(i % 4)) for i in range(60)]
    return m, spark.createDataFrame(rows, "id LONG, vector ARRAY<DOUBLE>, category INT")


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.mark.parametrize("dims", [16, 20, 128])
def test_md5_vector(spark, dims):
    texts = ["", "abc", "żółć", "x" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for row in df.select("t", md5_vector(F.col("t"), dims).alias("v")).collect():
        cells = [b / 255.0 for b in hashlib.md5(row["t"].encode()).digest()]
        assert row["v"] == [cells[i % 16] for i in range(dims)]


def test_nearest(vectors):
    m, df = vectors
    q = {"q1": m[3].tolist(), "q2": [1.0] * 8}
    got = vx.nearest(df, q, 5).orderBy("query_id", "rank").collect()
    for name, v in q.items():
        d = ((m - np.array(v)) ** 2).sum(1).round(9)
        want = sorted(range(60), key=lambda i: (d[i], i))[:5]
        assert [r["id"] for r in got if r["query_id"] == name] == want
    inside = vx.nearest(df, q, 3, category=2).collect()
    assert len(inside) == 6 and all(r["id"] % 4 == 2 for r in inside)


def test_first_rows_and_more_like_first(vectors):
    m, df = vectors
    assert [r["id"] for r in vx.nearest_or_first(df, None, 4).collect()] == [0, 1, 2, 3]
    assert vx.nearest_or_first(df, m[9].tolist(), 2).filter("rank = 1").first()["id"] == 9
    assert vx.more_like_first(df, 3).first()["id"] == 0


def test_matrix_statistics_equal_the_full_matrix(vectors):
    m, df = vectors
    full = unit(m) @ unit(m).T
    row = vx.mean_similarity(df).first()
    assert row["mean_similarity"] == pytest.approx(full.mean())
    assert row["mean_between_distinct"] == pytest.approx((full.sum() - 60) / (60 * 59))
    for r in vx.mean_similarity_per_row(df).collect():
        assert r["mean_similarity"] == pytest.approx(full[r["id"]].mean())
    for r in vx.similarity_blocks(df).collect():
        block = full[r["category_a"]::4, r["category_b"]::4]
        assert r["pairs"] == block.size
        assert r["mean_similarity"] == pytest.approx(block.mean())


def test_zero_vector_has_no_similarity(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], 1), (1, [1.0, 0.0], 1)],
                               "id LONG, vector ARRAY<DOUBLE>, category INT")
    got = {r["id"]: r["similarity"] for r in vx.query_product(df, {"q": [1.0, 0.0]}).collect()}
    assert got == {0: 0.0, 1: 1.0}
    assert vx.mean_similarity(df).first()["mean_similarity"] == pytest.approx(0.25)


def test_kmeans_rows_sit_at_their_nearest_centre(vectors):
    m, df = vectors
    rows, centers = vx.kmeans_clusters(df, 4)
    c = np.array([r["vector"] for r in centers.orderBy("category").collect()])
    assert c.shape == (4, 8)
    for r in rows.collect():
        gaps = ((c - m[r["id"]]) ** 2).sum(1)
        assert gaps[r["cluster"]] == pytest.approx(gaps.min())
    again = vx.assign_nearest(df, centers).select("id", "cluster").orderBy("id").collect()
    assert again == rows.select("id", "cluster").orderBy("id").collect()
    assert vx.kmeans_clusters(df.filter("id < 2"), 4)[1].count() == 2


def test_principal_plane(vectors):
    m, df = vectors
    rows, variance = vx.principal_plane(df, 2)
    p = np.array([r["point"] for r in rows.orderBy("id").collect()])
    assert np.allclose(p.mean(0), 0)
    assert abs(p[:, 0] @ p[:, 1]) < 1e-8
    s = np.linalg.svd(m - m.mean(0), compute_uv=False) ** 2
    assert variance == pytest.approx((s / s.sum())[:2].tolist())
    assert np.allclose((p ** 2).sum(0), s[:2])


def test_append_numbers_and_embeds(spark):
    old = spark.createDataFrame([(5, "a", [0.1], "x")],
                                "id LONG, text STRING, vector ARRAY<DOUBLE>, category STRING")
    new = spark.createDataFrame([(None, "b", None, "x", 2), (None, "c", [9.0], "y", 1),
                                 (40, "d", None, "y", 3)],
                                "id LONG, text STRING, vector ARRAY<DOUBLE>, category STRING, k LONG")
    rows = {r["text"]: r for r in vx.append_records(old, new, "k", 16).collect()}
    assert (rows["d"]["id"], rows["c"]["id"], rows["b"]["id"]) == (40, 41, 42)
    assert rows["c"]["vector"] == [9.0] and len(rows["b"]["vector"]) == 16


def test_small_set_guard(spark):
    small = spark.range(5)
    assert spark.range(1).select(as_array(small, 5).alias("a")).first()["a"] is not None
    with pytest.raises(Exception, match="more than 4 rows"):
        spark.range(1).select(as_array(small, 4).alias("a")).collect()


def brute_tfidf(texts, max_features, bigrams, max_df):
    docs = []
    for t in texts:
        words = [w for w in re.findall(r"(?u)\b\w\w+\b", t.lower()) if w not in STOP]
        docs.append(words + ([f"{a} {b}" for a, b in zip(words, words[1:])] if bigrams else []))
    n, df, total = len(docs), Counter(), Counter()
    for d in docs:
        df.update(set(d))
        total.update(d)
    terms = sorted((t for t in df if df[t] <= max_df * n), key=lambda t: (-total[t], t))
    vocabulary = terms[:max_features]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}
    out = []
    for d in docs:
        w = {t: c * idf[t] for t, c in Counter(d).items() if t in idf}
        size = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / size for t, x in w.items()})
    return out


@pytest.mark.parametrize("bigrams,max_df,features", [(False, 1.0, 128), (True, 0.5, 12)])
def test_tfidf(spark, bigrams, max_df, features):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id INT, text STRING")
    model = tx.fit(docs, "text", features, bigrams, max_df, STOP)
    got = {r["id"]: r["weights"] for r in tx.weigh(docs, "text", model).collect()}
    for i, want in enumerate(brute_tfidf(TEXTS, features, bigrams, max_df)):
        assert got[i] == pytest.approx(want)


def test_search_and_recommendation(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id INT, text STRING")
    model = tx.fit(docs, "text", 128, stop_words=STOP)
    weighted = tx.weigh(docs, "text", model)
    hits = tx.search(weighted, "id", {"q": TEXTS[0], "none": "zzz"}, model, 2)
    assert [r["id"] for r in hits.filter("query_id = 'q'").orderBy("rank").collect()] == [0, 4]
    assert {r["similarity"] for r in hits.filter("query_id = 'none'").collect()} == {0.0}
    rec = tx.recommend(weighted, "id", "text", TEXTS[0], model, 2).collect()
    assert not {r["id"] for r in rec} & {0, 4}


def test_dense_vectors_of_weights(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (9, None)], "id INT, text STRING")
    model = tx.fit(docs, "text", 128, stop_words=STOP)
    weighted = tx.weigh(docs, "text", model)
    terms = sorted(model.idf)
    for r in tx.dense(weighted, model).collect():
        assert r["vector"] == [(r["weights"] or {}).get(t, 0.0) for t in terms]
    norms = {r["id"]: r["norm"] for r in vx.norms(tx.dense(weighted, model)).collect()}
    assert norms[0] == pytest.approx(1) and norms[2] == 0 and norms[9] == 0


def test_text_query_finds_its_own_row(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id LONG, text STRING").withColumn(
        "vector", md5_vector(F.col("text"), 32))
    hits = vx.nearest_to_text(df, {"q": TEXTS[3]}, 2, 32).orderBy("rank").collect()
    assert (hits[0]["id"], hits[0]["distance"]) == (3, 0.0) and len(hits) == 2


def test_default_stop_words_are_removed(spark):
    docs = spark.createDataFrame([(1, "the cluster and the tables")], "id INT, text STRING")
    assert set(tx.fit(docs, "text").idf) == {"cluster", "tables"}


def test_vectors_of_the_wrong_size_are_an_error(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0], 1)],
                               "id LONG, vector ARRAY<DOUBLE>, category INT").coalesce(1)
    with pytest.raises(Exception, match="vectors of"):
        vx.norms(df).collect()
    with pytest.raises(Exception, match="where 3 is wanted"):
        vx.nearest(df.filter("id = 0"), {"q": [0.0, 0.0, 0.0]}, 1).collect()


def test_more_centroids_than_a_block(spark, vectors, monkeypatch):
    m, df = vectors
    centers = df.select(F.col("id").cast("int").alias("category"), "vector")
    whole = {r["id"]: (r["cluster"], r["distance"]) for r in vx.assign_nearest(df, centers).collect()}
    blocks = vx.similarity_blocks(df.withColumn("category", F.col("id")))
    want = {(r["category_a"], r["category_b"]): r["mean_similarity"] for r in blocks.collect()}
    monkeypatch.setattr(vx, "BLOCK", 7)
    assert {r["id"]: (r["cluster"], r["distance"]) for r in vx.assign_nearest(df, centers).collect()} == whole
    again = vx.similarity_blocks(df.withColumn("category", F.col("id"))).collect()
    assert len(again) == 3600
    assert {(r["category_a"], r["category_b"]): r["mean_similarity"] for r in again} == pytest.approx(want)
    assert whole[7] == (3, 0.0)


def test_similarity_statistics_of_queries(vectors):
    m, df = vectors
    got = vx.similarity_stats(df, {"q": m[5].tolist()}).first()
    near = (unit(m) @ unit(m)[5]).round(9)
    assert got["mean_similarity"] == pytest.approx(near.mean())
    assert got["max_below_one"] == pytest.approx(near[near < 1].max())
    assert got["min_similarity"] == pytest.approx(near.min())


def test_missing_vectors_are_not_scored(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, None, 1)],
                               "id LONG, vector ARRAY<DOUBLE>, category INT")
    scores = {r["id"]: r["similarity"] for r in vx.query_product(df, {"q": [1.0, 2.0]}).collect()}
    assert scores == {0: 1.0, 1: None}
    assert {r["id"]: r["norm"] is None for r in vx.norms(df).collect()} == {0: False, 1: True}
    placed = vx.assign_nearest(df, vx.category_centroids(df)).collect()
    assert {r["id"]: r["cluster"] for r in placed} == {0: 1, 1: None}
    assert {r["id"]: r["mean_similarity"] for r in vx.mean_similarity_per_row(df).collect()}[1] is None
    assert vx.similarity_blocks(df.limit(0)).collect() == []
    assert vx.assign_nearest(df, vx.category_centroids(df.limit(0))).filter("cluster IS NULL").count() == 2
    assert [r["id"] for r in vx.nearest(df, {"q": [0.0, 0.0]}, 5).collect()] == [0]
    assert vx.category_centroids(df).first()["size"] == 1
