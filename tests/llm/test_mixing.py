import numpy as np

from millrace.llm import mixing as op


def brute_rake(cells, targets, rounds=300):
    axes = [sorted({c[i] for c in cells}) for i in range(3)]
    n = np.zeros([len(a) for a in axes])
    for *key, tokens in cells:
        n[tuple(axes[i].index(k) for i, k in enumerate(key))] += tokens
    w = n / n.sum()
    for _ in range(rounds):
        for axis in range(3):
            now = w.sum(axis=tuple(a for a in range(3) if a != axis))
            want = np.array([targets[axis][k] for k in axes[axis]])
            shape = [1] * 3
            shape[axis] = -1
            w = w * (want / now).reshape(shape)
    return {(s, l, t): w[i, j, k] * n.sum() / n[i, j, k] for i, s in enumerate(axes[0]) for j, l in enumerate(axes[1])
            for k, t in enumerate(axes[2]) if n[i, j, k]}


def test_rake_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    cells = [(f"s{i}", f"l{j}", k, int(rng.integers(1, 1000))) for i in range(6) for j in range(3) for k in range(4)
             if rng.random() < 0.8]
    frame = spark.createDataFrame(cells, "source string, lang string, topic int, tokens long")
    targets = {"lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}, "topic": {k: 0.25 for k in range(4)},
               "source": {f"s{i}": 1 / 6 for i in range(6)}}
    raked, fit = op.rake(frame, targets, rounds=200, tolerance=1e-9)
    got = {(r["source"], r["lang"], r["topic"]): r["ratio"] for r in raked.collect()}
    want = brute_rake(cells, [targets["source"], targets["lang"], targets["topic"]])
    assert fit.error < 1e-9 and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_default_margins_are_met(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op.mix(docs, max_ratio=1e9).collect()
    assert len(got) == docs.count()
    total = sum(r["tokens"] for r in got)
    for name, temper in op.TEMPER.items():
        seen, wanted = {}, {}
        for r in got:
            seen[r[name]] = seen.get(r[name], 0) + r["tokens"]
            wanted[r[name]] = wanted.get(r[name], 0) + r["tokens"] * r["ratio"] / total
        whole = sum(v ** temper for v in seen.values())
        assert all(abs(wanted[k] - seen[k] ** temper / whole) < 1e-4 for k in seen)
    assert max(r["probability"] for r in got) == 1
    expected = sum(r["probability"] for r in got)
    assert abs(sum(r["kept"] for r in got) - expected) < 4 * np.sqrt(expected)


def skewed(spark):
    """One source of a third of all tokens and a long tail of small ones, with one rare topic."""
    rng = np.random.default_rng(9)
    cells = [("big", f"l{j}", k, 40_000 // (1 + 30 * (k == 3))) for j in range(3) for k in range(4)]
    cells += [(f"s{i}", f"l{j}", k, int(rng.integers(1, 9))) for i in range(300) for j in range(3) for k in range(4)]
    return spark.createDataFrame(cells, "source string, lang string, topic int, tokens long").groupBy(
        "source", "lang", "topic").sum("tokens").withColumnRenamed("sum(tokens)", "tokens")


def test_bound_within_the_raking(spark):
    """At the production bound no ratio exceeds it, and the margins that can be met are met."""
    frame = skewed(spark)
    free, _ = op.rake(frame)
    top = max(r["ratio"] for r in free.collect())
    assert top > op.MAX_RATIO
    raked, fit = op.rake(frame, max_ratio=op.MAX_RATIO, rounds=12)
    rows = raked.collect()
    assert max(r["ratio"] for r in rows) <= op.MAX_RATIO * (1 + 1e-9)
    total = sum(r["tokens"] for r in rows)
    worst = {}
    for name, temper in op.TEMPER.items():
        seen, got = {}, {}
        for r in rows:
            seen[r[name]] = seen.get(r[name], 0) + r["tokens"]
            got[r[name]] = got.get(r[name], 0) + r["tokens"] * r["ratio"] / total
        whole = sum(v ** temper for v in seen.values())
        reached = sum(got.values()) if name != "source" else 1  # small sources at the bound can't reach their share
        worst[name] = max(abs(got[k] / reached - seen[k] ** temper / whole) for k in seen)
    assert worst["lang"] < 0.015 and worst["topic"] < 0.015 and worst["source"] < 0.001, (worst, fit)


def test_bound_beyond_all_ratios_changes_nothing(spark):
    frame = skewed(spark)
    a, b = ({(r["source"], r["lang"], r["topic"]): r["ratio"] for r in op.rake(frame, max_ratio=m)[0].collect()}
            for m in (float("inf"), 1e6))
    assert all(abs(a[k] - b[k]) < 1e-9 * a[k] for k in a)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"some longer words number {i}", "en", "s", 1, 2) for i in range(40)],
                                 "doc_id long, text string, lang string, source string, __topic int, __probability int")
    assert op.sampled(docs).columns == docs.columns


def test_odd_rows(odd_docs, no_docs):
    got = op.mix(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        want = [op.topic_and_size((d["text"] or "").encode()) for d in odd_docs.where(
            f"doc_id <=> {r['doc_id'] if r['doc_id'] is not None else 'null'}").collect()]
        assert (r["topic"], r["tokens"]) in want
        assert 0 <= r["probability"] <= 1 and (r["tokens"] or r["kept"])
    kept = op.sampled(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["kept"])
    assert op.mix(no_docs).collect() == [] and op.sampled(no_docs).collect() == []
