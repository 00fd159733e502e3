import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from millrace.llm import queries, url_rules as op

URLS = ["http://A.org/x", "https://b.ORG", "http://example.org/es/1", "http://www.example.org/en/17?x=/de/", None, "",
        "no scheme", "http://x.com/fr/a", "http://x.com/de/", "http://com/de/q#f", "xorg://notorg/es/", "://org/",
        "http://org/a://b", "http://é.net/en/5/a-b.html?utm=1&y=2#t", "http://example.org.evil/", "http://myexample.org/es/"]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    stop = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    return host, tail[:stop]


def brute_rule(host, path):
    fits = [r for r in op.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def check_base(rows):
    for r in rows:
        host, path = brute_parts(r["url"])
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.name), r
        if rule:
            assert r["verdict"] == rule.verdict
        assert r["verdict"] in ("allow", "block")


def test_hosts_paths_and_rules(spark, sf_dir, no_labels):
    odd = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = op.judge(odd, no_labels).join(odd.select("page_id", "url"), "page_id").collect()
    assert len(got) == len(URLS)
    check_base(got)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = queries.op5_url_rules(spark, sf_dir).join(pages.select("page_id", "url"), "page_id").collect()
    assert len(got) == pages.count()
    check_base(got)


def brute_mine(rows, min_support, min_confidence):
    n = len(rows)
    found = {}
    tokens = sorted({t for ts, _ in rows for t in ts})
    base = {v: sum(w == v for _, w in rows) / n for v in ("allow", "block")}
    for size in range(1, 5):
        for ante in combinations(tokens, size):
            fits = [v for ts, v in rows if set(ante) <= set(ts)]
            for verdict in ("allow", "block"):
                hits = fits.count(verdict)
                if hits and hits / n >= min_support - 1e-12 and hits / len(fits) >= min_confidence \
                        and hits / len(fits) / base[verdict] > 1:
                    found[ante, verdict] = hits / len(fits)
    return {(a, v): c for (a, v), c in found.items() if not any(
        found.get((a[:i] + a[i + 1:], v), 0) >= c for i in range(len(a)))}


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for i in range(120):
        tokens = [t for j, t in enumerate(("a", "b", "c", "d")) if (i * 7 + j * 3) % (j + 2) == 0] or ["z"]
        rows.append((tokens, "block" if {"b", "c"} <= set(tokens) or i % 11 == 0 else "allow"))
    return rows, spark.createDataFrame(rows, "tokens array<string>, verdict string")


def test_mined_rules_match_brute_force(labelled):
    rows, frame = labelled
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"]
           for r in op.mine(frame, op.token_classes(frame, 0.05), 0.05, 0.6).collect()}
    want = brute_mine(rows, 0.05, 0.6)
    assert got.keys() == want.keys() and got
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_index_finds_what_a_scan_finds(labelled, spark):
    rows, frame = labelled
    classes = op.token_classes(frame, 0.05)
    mined = op.mine(frame, classes, 0.05, 0.6)
    rules = mined.collect()
    urls = spark.createDataFrame([(f"u{i}", list(c)) for i, c in enumerate(
        c for n in range(1, 6) for c in combinations("abcdz", n))], "url string, tokens array<string>")
    got = {r["url"]: (r["verdict"], r["antecedent"]) for r in op.match(urls, op.index(mined, classes), classes).collect()}
    for u in urls.collect():
        fits = [(r["confidence"], r["support"], " ".join(r["antecedent"]), r["verdict"]) for r in rules
                if set(r["antecedent"]) <= set(u["tokens"])]
        best = max(fits, default=None)
        assert got.get(u["url"]) == (best and (best[3], best[2]))


def test_tokens_that_stand_together_are_one_item(spark):
    rows = [([t for t in "abcd" if (i * 7 + ord(t) * 3) % (ord(t) - 95) == 0] + ["all"], "block" if i % 4 else "allow")
            for i in range(80)]
    rows = [(ts + ["p", "q"] * ("b" in ts and "c" in ts) + ["r"] * ("b" in ts and "c" in ts), v) for ts, v in rows]
    frame = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    classes = op.token_classes(frame, 0.05)
    item = {r["token"]: r["item"] for r in classes.collect()}
    held = {t: frozenset(i for i, (ts, _) in enumerate(rows) if t in ts) for ts, _ in rows for t in ts}
    assert item == {t: min(u for u in held if held[u] == held[t]) for t in held if 4 <= len(held[t]) < 80}
    assert item["q"] == item["r"] == "p" and "all" not in item
    got = {(tuple(r["antecedent"]), r["verdict"]): r["confidence"] for r in op.mine(frame, classes, 0.05, 0.6).collect()}
    want = {(tuple(sorted({item.get(t, t) for t in a})), v): c for (a, v), c in brute_mine(rows, 0.05, 0.6).items()}
    assert got and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    urls = spark.createDataFrame([("u", ["r", "x"]), ("v", ["x"])], "url string, tokens array<string>")
    listed = spark.createDataFrame([(["p"], "block", 0.9, 0.5, "p")],
                                   "antecedent array<string>, verdict string, confidence double, support double, item string")
    assert [tuple(r) for r in op.match(urls, listed, classes).collect()] == [("u", "block", 0.9, "p")]


def test_forty_shared_tokens(spark):
    """Mining does not enumerate the subsets of tokens that always stand together."""
    path = "/".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    pages = spark.createDataFrame([(i, f"http://q.net/{path}/{i % 7}" if i % 2 else f"http://q.net/other/{i % 5}")
                                   for i in range(200)], "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 200, 3)], "doc_id long, quality int")
    start = time.time()
    verdicts = {(r["page_id"] % 2, r["verdict"]) for r in op.judge(pages, labels).collect()}
    assert verdicts == {(0, "block"), (1, "allow")}
    assert time.time() - start < 30


def test_empty_tables(spark, no_labels):
    assert op.judge(spark.createDataFrame([], "page_id long, url string, html string"), no_labels).collect() == []


def test_repeated_urls_and_no_python(spark, sf_dir):
    pages = spark.createDataFrame([(1, "http://q.net/a")] * 3 + [(None, "http://q.net/a")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = op.judge(pages, labels)
    assert df.count() == 4
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan
