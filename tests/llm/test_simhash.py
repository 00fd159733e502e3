import random
import re

import xxhash

from millrace.llm import components as cc, simhash as op


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, distance=3):
    """rows: (doc_id, fingerprint) -> smallest id reachable, per row."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [least.get(root(i)) for i in range(len(rows))]


def check(docs):
    rows = [(r["doc_id"], brute_print(r["text"])) for r in docs.select("doc_id", "text").collect()]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows))), key=repr)
    got = op.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == want


def test_matches_brute_force(documents):
    check(documents)


def test_odd_texts(odd_docs):
    check(odd_docs)


def test_empty_table(no_docs):
    assert op.near_duplicates(no_docs).collect() == []


def test_links_find_every_pair_in_dense_clusters(spark):
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 400:
        x = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {(a, b) for a in signed for b in signed
            if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3}
    for segments in (2, 4):
        got = op.links(fps, 3, segments).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_components_of_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in cc.components(edges, "test").collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert cc.components(edges.limit(0), "test").collect() == []


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    a, b, c = ("first text about rivers and long bridges", "second one on quiet forests at night", "third on high hills")
    rows = [(1, a, "x"), (1, b, "x"), (2, b, "x"), (2, c, "x"), (3, c, "x"), (3, c, "x"), (4, a, "x"), (1, a, "y"), (5, a, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, __row string")
    for parts in (1, 5):
        kept = op.one_per_group(frame.repartition(parts))
        assert kept.columns == frame.columns
        got = sorted((r["doc_id"], r["text"]) for r in kept.collect())
        assert got == sorted([(1, a), (1, b), (2, c)])
    equal = spark.createDataFrame([(7, a)] * 3 + [(None, a)], "doc_id long, text string")
    assert sorted(op.one_per_group(equal).collect(), key=str) == sorted(equal.distinct().collect(), key=str)


def test_one_document_of_each_group_stays(odd_docs):
    kept = op.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids == [1, 3, 5, 7, 8]  # 2 and 4 are empty like 1; both rows of 6 copy 5
    assert kept.where("doc_id is null").count() == 2
