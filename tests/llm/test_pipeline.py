import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from millrace.llm import decontaminate, mixing, pu_quality, queries, simhash

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark):
    """Each stage against a plain recomputation over its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    seen = []
    for name, stage in pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        after = stage(spark, docs, SF)
        if name != pipeline.STAGES[-1][0]:
            assert after.schema == docs.schema
        rows = after.collect()
        kept = {r["doc_id"] for r in rows}
        assert len(kept) == len(rows)
        seen.append(len(rows))
        if name == "quality_classifier":
            model = pu_quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            x = {d: model.score(np.array([pu_quality.features(r["text"].encode())]))[0] for d, r in before.items()}
            assert kept == {d for d, s in x.items() if s >= 0.3}
        elif name == "simhash_near_dedup":
            prints = [(d, simhash.fingerprint(r["text"].encode()) & (2 ** 64 - 1)) for d, r in sorted(before.items())]
            group = {d: d for d, _ in prints}
            changed = True
            while changed:
                changed = False
                for a, x in prints:
                    for b, y in prints:
                        if (x ^ y).bit_count() <= 3 and group[b] < group[a]:
                            group[a], changed = group[b], True
            assert kept == {d for d in group if group[d] == d}
        elif name == "benchmark_decontamination":
            matcher = decontaminate.Matcher([(i["item_id"], i["text"]) for i in bench], 0.2, 8)
            assert kept == {d for d, r in before.items() if not list(matcher.find(r["text"]))}
            assert not any(i["text"] in r["text"] for r in rows for i in bench)
        elif name == "source_mixing":
            assert kept == {r["doc_id"] for r in mixing.mix(docs).collect() if r["kept"]}
        else:
            tokenizer = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
            start = 0
            for r in sorted(rows, key=lambda r: r["doc_id"]):
                ids = tokenizer.encode(before[r["doc_id"]]["text"], add_special_tokens=False).ids + [2]
                assert tuple(r) == (r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
                start += len(ids)
        docs = after
    assert seen == sorted(seen, reverse=True) and seen[-1] > 20


def test_odd_documents_pass_through(odd_docs, spark):
    frame = odd_docs
    for name, stage in pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == odd_docs.columns
    pipeline.STAGES[-1][1](spark, frame, SF).collect()


def test_empty_documents(no_docs, spark):
    frame = no_docs
    for _, stage in pipeline.STAGES:
        frame = stage(spark, frame, SF)
    assert frame.collect() == []
