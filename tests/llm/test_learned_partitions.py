import numpy as np

from millrace.llm import learned_partitions as op

KIND = "vec_id long, embedding array<double>, v int, gid int, ids int, part int, hits int, query_id int, label int"


def brute(rows, k=20):
    """Rows of (query_id, rank, vec_id, score) from all pairs; a query leaves out one row, its own."""
    used = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (i, q) in enumerate(used):
        if i % 20:
            continue
        near = sorted((-(np.array(q) * np.array(v)).sum(), j) for to, (j, v) in enumerate(used)
                      if to != at and len(v) == len(q))
        out += [(i, rank, j, -far) for rank, (far, j) in enumerate(near[:k], 1)]
    return sorted(out)


def test_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want, got = brute(rows), sorted(map(tuple, op.search(table).collect()))
    assert len(got) == len(want)
    pairs = {(q, v) for q, _, v, _ in got}
    assert len(pairs & {(q, v) for q, _, v, _ in want}) >= 0.9 * len(want)
    by_id = dict(rows)
    for query, _, vec, score in got:
        assert abs(score - float(np.dot(np.array(by_id[query]), np.array(by_id[vec])))) < 1e-9
    for query in {q for q, *_ in got}:
        own = [(-s, v) for q, _, v, s in sorted(got) if q == query]
        assert own == sorted(own) and query not in {v for _, v in own}
        assert [r for q, r, *_ in sorted(got) if q == query] == list(range(1, 21))


def test_odd_vectors(spark):
    """Few vectors have one partition, so the search is exact: copies, repeats, ties, other lengths, no vectors."""
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0, -0.5]) for i in range(0, 45)] + [(100 + i, [2.0, 2.0, 2.0]) for i in range(60)]
    rows += [(20, [9.0, 0.0, 0.0]), (20, [0.0, 1.0, -0.5]), (40, [1.0, 2.0]), (41, [3.0, 1.0]), (60, [1.0, nan, 0.0]),
             (80, [0.0, 0.0, 0.0]), (80, None), (81, []), (82, [inf, 1.0, 1.0]), (83, [None, 1.0, 1.0]),
             (None, [3.0, 3.0, 3.0]), (-20, [0.5, 0.5, 0.5]), (0, [-0.0, 1.0, -0.5]), (2000, [4.0, 4.0, 4.0, 4.0])]
    frame = spark.createDataFrame([(*r, *range(7)) for r in rows], KIND)
    assert sorted(map(tuple, op.search(frame).collect())) == brute(rows)
    assert sorted(map(tuple, op.search(frame, k=3).collect())) == brute(rows, 3)
    assert op.search(frame.limit(0)).collect() == []
    assert op.search(frame.where("vec_id % 20 <> 0")).collect() == []


def test_blocks_and_partitions_lose_nothing(spark, monkeypatch):
    """With every partition visited the result is exact, however partitions are dealt into blocks."""
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(700, 8)).tolist())]
    rows += [(1000 + i, rows[5][1]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(op, "BLOCK_ROWS", 17)
    monkeypatch.setattr(op, "_MAX_PAIRS", 40)
    got = sorted(map(tuple, op.search(frame, partitions=8, target=1.1).collect()))
    want = brute(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-12)


def test_partition_is_balanced_and_cuts_fewer_edges():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    graph = op.neighbour_graph(x, 10)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    assert all(set(graph[i]) == set(np.argsort(-scores[i])[:10]) for i in range(1500))
    part = op.balanced_partition(x, graph, 12)
    start = np.zeros(1500, int)
    op._halved(x, np.arange(1500), 0, 12, start)
    assert np.bincount(part).max() <= np.ceil(1.1 * 1500 / 12)
    cut = [(p[graph] != p[:, None]).mean() for p in (start, part)]
    assert cut[1] < cut[0]


def test_router_meets_its_target():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 24))
    x = centres[rng.integers(0, 16, 2000)] + 0.2 * rng.normal(size=(2000, 24))
    router = op.learn(x, 16)
    assert router.expected >= op.TARGET and router.probes <= 4
    assert op.learn(x[:20], 16).probes == 1
