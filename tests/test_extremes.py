"""Highest and lowest similarity of a matrix against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import extremes as ex, text as tx


def brute(weighted, key="id"):
    rows = [r["weights"] or {} for r in weighted.select(key, "weights").collect()]
    dots = [round(sum(w * b.get(t, 0.0) for t, w in a.items()), ex.PLACES) for a in rows for b in rows]
    return len(rows), max((d for d in dots if d < 1), default=None), min(dots, default=None)


def run(weighted, model, key="id"):
    return ex.similarity_extremes(weighted, key, model).first()


def fitted(spark, texts, features=50):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "id LONG, text STRING, class_id INT, size INT")
    return tx.fit_weighed(docs, "text", features, stop_words=[])


def drawn(rng, n, low, high, always=()):
    words = [f"w{i}" for i in range(60)]
    return [" ".join([*always, *rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randrange(low, high))])
            for _ in range(n)]


@pytest.mark.parametrize("always", [(), ("aa",), ("aa", "bb", "aa", "aa")])
def test_equals_all_pairs(spark, always):
    """Without a word in all texts counts prove the 0; with one, bounds of groups and scored pairs find the lowest."""
    weighted, model = fitted(spark, drawn(random.Random(4), 300, 2, 30, always))
    got = run(weighted, model)
    assert (got["row_count"], round(got["max_below_one"], 6), round(got["min_similarity"], 6)) == tuple(
        round(x, 6) for x in brute(weighted))
    assert (got["min_similarity"] == 0) == (always == ())
    assert got["pairs_scored"] < 300 * 299 / 2


def test_groups_that_cannot_go_lower_are_not_scored(spark):
    rng = random.Random(9)
    texts = [" ".join(["aa"] * rng.randrange(9, 12) + ["bb"] * rng.randrange(9, 12) + ["cc"] * rng.randrange(3)) for _ in range(200)]
    texts += ["aa bb " + "dd " * k for k in range(1, 30)] + ["aa bb " + "ee " * k for k in range(1, 30)]
    weighted, model = fitted(spark, texts)
    got = run(weighted, model)
    assert (round(got["max_below_one"], 6), round(got["min_similarity"], 6)) == tuple(round(x, 6) for x in brute(weighted)[1:])
    assert got["min_similarity"] > 0


@pytest.mark.parametrize("texts", [
    [], [None], ["aa"], ["aa", "aa aa"], ["aa", "bb"], ["aa bb", "bb aa", None], ["aa", "", "aa bb"], ["aa bb", "aa", "aa cc"]])
def test_few_rows(spark, texts):
    """Empty tables, one row, equal rows only, rows without a term."""
    weighted, model = fitted(spark, texts)
    got, want = run(weighted, model), brute(weighted)
    assert (got["row_count"], got["max_below_one"], got["min_similarity"]) == pytest.approx(want, abs=1e-6)


def test_hot_class_and_repeated_ids(spark):
    """A text that a third of all rows share is one class; ids may repeat."""
    texts = drawn(random.Random(2), 60, 3, 20) + ["w1 w2 w5"] * 40
    weighted, model = fitted(spark, texts)
    weighted = weighted.unionByName(weighted.limit(5)).withColumn("id", F.col("id") % 70)
    got, want = run(weighted, model), brute(weighted)
    assert (got["row_count"], got["max_below_one"], got["min_similarity"]) == pytest.approx(want, abs=1e-6)


def test_no_pair_is_joined_where_the_floor_cannot_be_beaten(spark, monkeypatch):
    """0.9999999 is the highest that rounds below one: neighbours that have it settle the highest."""
    monkeypatch.setattr(ex, "likely_pairs", lambda *a: pytest.fail("joined"))
    texts = drawn(random.Random(3), 80, 3, 20) + ["aa " * 1400, "aa " * 1400 + "zz"] + ["zz w1"] * 9
    weighted, model = fitted(spark, texts)
    assert run(weighted, model)["max_below_one"] == brute(weighted)[1] == 0.9999999


@pytest.mark.parametrize("other", [300, 900, 1300])
def test_nearly_equal_rows_meet_in_narrow_cells(spark, other):
    """The best pair differs by little and the floor lies just under it."""
    texts = drawn(random.Random(6), 80, 3, 20) + ["aa " * other + "bb " * 7, "aa " * other + "bb " * 8, "aa " * other + "bb " * 9 + "cc"]
    weighted, model = fitted(spark, texts)
    got, want = run(weighted, model), brute(weighted)
    assert (got["row_count"], got["max_below_one"], got["min_similarity"]) == pytest.approx(want, abs=1e-9)
