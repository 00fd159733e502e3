"""Weights of a fitted corpus are computed once, whatever reads them."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import text as tx, vectors as vx


@pytest.fixture(scope="module")
def fitted(spark):
    texts = ["w1 w2 w2 w3", "w2 w4", "", None, "w5 w1 w1", "zz"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id LONG, text STRING")
    return docs, *tx.fit_weighed(docs, "text", 5, stop_words=["zz"])


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("read", [
    lambda w, m: vx.norms(tx.dense(w, m)), lambda w, m: tx.vector_classes(w, "id")[0],
    lambda w, m: tx.vector_classes(w, "id")[1], lambda w, m: vx.category_centroids(
        tx.dense(w, m).join(w.select("id", F.lit("a").alias("category")), "id"))])
def test_no_reader_weighs_again(fitted, read):
    """A lambda over weights that are still an expression evaluates it for every term of every document."""
    _, weighted, model = fitted
    assert "term_counts" not in plan(read(weighted, model))


def test_stored_weights_are_those_of_weigh(fitted):
    docs, weighted, model = fitted
    assert weighted.columns == ["id", "text", "weights"]
    want = {r["id"]: r["weights"] for r in tx.weigh(docs, "text", model).collect()}
    got = {r["id"]: r["weights"] for r in weighted.collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert (got[key] or {}) == pytest.approx(want[key] or {})


def test_only_asked_columns_are_kept(fitted):
    docs, weighted, _ = fitted
    kept = tx.fit_weighed(docs, "text", 5, stop_words=["zz"], columns=["id"])[0]
    assert kept.columns == ["id", "weights"]
    assert {r["id"]: r["weights"] for r in kept.collect()} == {r["id"]: r["weights"] for r in weighted.collect()}
