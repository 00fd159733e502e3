import hashlib
import math

import duckdb
import pytest
from pyspark.errors import SparkRuntimeException

from millrace.llm import integer_clusters as op

KIND = "vec_id long, embedding array<double>, cluster string, q int, own int, v int, distance int"


def brute(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in named[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rounds if centroids else 0):
        near = assign()
        for n in range(len(centroids)):
            own = [q for (_, q), (_, m) in zip(kept, near) if m == n]
            if own:
                centroids[n] = [sum(c) // len(own) for c in zip(*own)]
    near = assign() if centroids else []
    spread = {n: sum(d for d, m in near if m == n) for n in range(len(centroids))}
    marks = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, spread[n], sum(spread.values()), marks[n]) for (i, _), (d, n) in zip(kept, near)), key=str)


def run(frame, **options):
    return sorted(map(tuple, op.cluster(frame, **options).collect()), key=str)


def test_matches_brute_force_and_sql(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = run(table)
    assert got == brute([(r["vec_id"], r["embedding"]) for r in table.collect()])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    assert got == sorted(con.execute(op.sql()).fetchall(), key=str)


def test_odd_vectors(spark):
    """Wrong lengths, nulls, NaN and infinity stay out; ties, repeats, null ids and clashing columns don't harm."""
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, -0.1]), (1, [0.1, -0.1]), (1, [0.3, 0.2]), (2, [0.1, -0.1]), (3, [nan, 0.0]), (4, [inf, 0.0]),
            (5, [None, 1.0]), (6, None), (7, []), (8, [1.0]), (9, [1.0, 2.0, 3.0]), (None, [5.0, 5.0]), (10, [0.0, 0.0]),
            (11, [1 / 64, 0.0]), (12, [-1 / 128, 0.0]), (13, [1e-300, -1e-300]), (-4, [2.0, -3.0])]
    frame = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], KIND)
    for k in (1, 3, 16):
        assert run(frame, k=k, dims=2) == brute(rows, k=k, dims=2)
    assert run(frame.where("vec_id is null"), dims=2) == []
    assert run(frame.limit(0)) == []


def test_too_large_components_are_an_error(spark):
    with pytest.raises(SparkRuntimeException):
        run(spark.createDataFrame([(1, [3e7, 0.0])], "vec_id long, embedding array<double>"), dims=2)


def test_no_vector_is_shuffled(spark, sf_dir):
    points = op.integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 64)
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
