"""From raw documents to token files: the stages of a training-data pipeline.

Each stage takes the documents its predecessor kept and returns a frame that is
written as Parquet and read again for the next one. All stages but the last
return the columns of ``documents`` as they came. Null and empty texts, null
ids, repeated rows, extra columns and empty tables pass every stage, as the
operator of each says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, mixing, pu_quality, queries, simhash, token_files
from millrace.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts score alike, repeats each on their own."""
    return pu_quality.keep_good(docs, pu_quality.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; empty texts are one, rows without an id stay."""
    return simhash.one_per_group(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), short_exact=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics; empty texts weigh nothing and stay."""
    return mixing.sampled(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32; an empty text is the end id alone."""
    return token_files.read_tokens(token_files.write_tokens(
        docs, public_tokenizers.path(queries.TOKENIZER), queries.END_ID))


STAGES = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("token_output", tokens),
]

#: A learned classifier, fingerprint components and tokenizers have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each result written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
