import re
from collections import Counter

import duckdb

from millrace.llm import queries, quality_rules as op


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), failed)


def rows(df):
    return sorted(tuple(r) for r in df.select("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                              "n_repeat_words", "base_failed").collect())


def test_counts_match_brute_force(documents):
    assert rows(op.judge(documents)) == sorted(brute(r["text"]) for r in documents.select("text").collect())


def test_odd_texts(odd_docs, spark):
    texts = ["a b c d e f g h " * 3, "x " * 30, "a\na\n\n \n b\nb\nb", "\x0bα\x0cβ\r#<|>γ\x00δ ε\x85ζ", "w" * 200_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df in (docs, odd_docs):
        assert rows(op.judge(df)) == sorted(brute(r["text"]) for r in df.select("text").collect())


def test_empty_table_and_columns(no_docs):
    assert op.judge(no_docs).collect() == []


def test_kept_needs_every_rule(odd_docs):
    for r in op.judge(odd_docs).collect():
        assert r["kept"] == (not r["failed_rules"])
        assert not (r["base_failed"] and r["kept"])


def test_good_documents_stay_and_junk_goes(spark, sf_dir):
    got = op.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    table = {(r["quality"], r["kept"]): r["count"] for r in got.join(labels, "doc_id").groupBy(
        "quality", "kept").count().collect()}
    good = table[1, True] / (table[1, True] + table.get((1, False), 0))
    junk = table.get((0, False), 0) / (table.get((0, False), 0) + table.get((0, True), 0))
    assert good > 0.97 and junk > 0.9


def test_no_python_in_plan(documents):
    plan = op.judge(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = con.execute(queries.SQL["op1_quality_rules"])
    names = [d[0] for d in got.description]
    theirs = sorted(map(repr, (tuple(v for _, v in sorted(zip(names, r))) for r in got.fetchall())))
    mine = queries.op1_quality_rules(spark, sf_dir)
    assert theirs == sorted(repr(tuple(r)) for r in mine.select(*sorted(mine.columns)).collect())
