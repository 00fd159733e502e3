"""Pairs above a threshold, met in slices of the classes under a term."""

import random

import pytest

from millrace.operators import text as tx


@pytest.fixture(scope="module")
def classes(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(40)], k=rng.randrange(1, 25))) for _ in range(500)]
    docs = spark.createDataFrame([(i % 480, t) for i, t in enumerate(texts)] + [(None, "w1 w7 w9")], "id LONG, text STRING")
    weighted, model = tx.fit_weighed(docs, "text", 30, stop_words=[])
    return tx.vector_classes(weighted, "id")[0].persist(), model


@pytest.mark.parametrize("size", [7, 60, 8192])
def test_slices_lose_no_pair_and_repeat_none(classes, size, monkeypatch):
    monkeypatch.setattr(tx, "_SLICE", size)
    found, model = classes
    rows = [(r["class_id"], r["size"], {e["term"]: e["w"] for e in r["entries"]}) for r in found.collect()]
    for threshold in (0.3, 0.8):
        want = []
        for k, n, v in rows:
            for l, m, w in rows:
                dot = round(sum(x * w.get(t, 0.0) for t, x in v.items()), 8)
                if k is not None and l is not None and k < l and dot >= threshold:
                    want.append((k, l, n, m, dot))
        got = [tuple(r) for r in tx.similar_classes(found, model, threshold).collect()]
        assert sorted(g[:4] for g in got) == sorted(w[:4] for w in want) and got
        assert [g[4] for g in sorted(got)] == pytest.approx([w[4] for w in sorted(want)], abs=2e-8)


def test_candidate_pairs_are_no_rows(classes):
    """A join on the term would make a row, with both vectors, of every pair that shares it."""
    plan = tx.similar_classes(*classes, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
