import random

from hypothesis import given, settings, strategies as st

from millrace.llm import decontaminate as op


def brute_distance(pattern, text):
    """Least edit distance of a pattern to any stretch of a text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute_leaks(docs, items, max_error=0.2, min_words=8):
    found = []
    for doc, text in docs:
        words = op.words_of(text)
        for item, other in items:
            own = op.words_of(other)
            if len(own) >= min_words:
                d = brute_distance(own, words)
                if d <= int(len(own) * max_error + 1e-9):
                    found.append((doc, item, d))
    return sorted(found, key=repr)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), st.lists(st.sampled_from("abcd"), max_size=20))
def test_bit_parallel_distance(pattern, text):
    masks = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    distance, end = op.best_match(masks, len(pattern), text)
    assert distance == brute_distance(pattern, text)
    assert brute_distance(pattern, text[:end + 1]) == distance


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = "CHANGED"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, "more")
    return words


def test_edited_items_are_found(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 80)))) for i in range(30)] + [
        (90, None), (91, ""), (92, "too short"), (93, " ".join(["same"] * 12)), (1, "a repeated id " * 5)]
    docs = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 200))
        for item, text in rng.sample(items[:30], rng.randint(0, 2)):
            own = text.split()
            at = rng.randint(0, len(words))
            words[at:at] = edited(own, rng.randint(0, max(1, len(own) // 4)), rng)
        docs.append((i, ", ".join(words).replace("w1", "W1")))
    docs += [(200, None), (201, ""), (None, items[0][1]), (202, "same " * 5000), (5, docs[5][1])]
    docs_df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    want = brute_leaks(docs, items)
    assert len(want) > 30
    for block in (20_000, 7):
        got = op.leaks(docs_df, bench, block_items=block).select("doc_id", "item_id", "distance").collect()
        assert sorted(map(tuple, got), key=repr) == want
    kept = op.clean(docs_df, bench, block_items=7)
    assert kept.columns == docs_df.columns
    dirty = {repr(d) for d, _, _ in want}
    assert sorted((repr(r["doc_id"]) for r in kept.collect())) == sorted(
        repr(d) for d, _ in docs if repr(d) not in dirty)


def test_empty_tables(spark, no_docs, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert op.leaks(documents, bench).collect() == []
    assert op.clean(documents, bench).count() == documents.count()
    assert op.leaks(no_docs, bench.union(spark.createDataFrame([(1, "a b c d e f g h i")], bench.schema))).collect() == []


def test_planted_items(spark, documents, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items, docs = bench.collect(), documents.collect()
    exact = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in op.leaks(documents, bench).collect()}
    assert exact and exact <= got
    assert got == {(d, i) for d, i, _ in brute_leaks([(d["doc_id"], d["text"]) for d in docs if len(
        d["text"]) < 2000 or d["doc_id"] in {x for x, _ in got}], [(i["item_id"], i["text"]) for i in items])}


def test_repeated_items_count_once(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "none of it")], "doc_id LONG, text STRING")
    items = spark.createDataFrame([(5, item)] * 3, "item_id LONG, text STRING")
    assert [(r["doc_id"], r["item_id"]) for r in op.leaks(docs, items).collect()] == [(1, 5)]
    assert [r["doc_id"] for r in op.clean(docs, items).collect()] == [2]


def test_short_items_are_found_word_for_word(spark, tmp_path):
    import corpus_pipeline
    from millrace.llm import queries
    docs = spark.createDataFrame([(1, "so: What is TWO plus two? four"), (2, "what is two plus three"),
                                  (3, "two two two"), (4, "what is is two plus two"), (5, None), (6, "")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(7, "What is two plus two?"), (8, "two two"), (9, ""), (10, None)],
                                  "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], r["item_id"], r["distance"], r["item_words"])
                 for r in queries.op8_decontamination(spark, str(tmp_path)).collect())
    assert got == [(1, 7, 0, 5), (3, 8, 0, 2)]
    kept = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6]
