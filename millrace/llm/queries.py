"""The registered queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import (archives, conversation_repair, decontaminate, integer_clusters, languages,
                          learned_partitions, licenses, mixing, pu_quality, quality_rules, simhash,
                          token_files, url_rules)
from millrace.llm.common import table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of the threshold table for every document."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded, written to seekable token files and read back."""
    manifest = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), END_ID)
    return token_files.read_tokens(manifest)


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a legacy ARC archive, converted to WARC and read back."""
    legacy = archives.write_arc(table(spark, sf_dir, "pages"), version=2)
    return archives.page_records(archives.read_warc(archives.convert_arc(legacy)))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL: explicit rules, then rules mined by FP-growth."""
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, labels and score of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PU-learned quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return pu_quality.scores(docs, pu_quality.learn(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, within a fifth of their words of edits; short items word for word."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short_exact=True)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked weight, probability and draw of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return languages.identify(docs, languages.learn(docs))


def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found of every twentieth vector."""
    return learned_partitions.search(table(spark, sf_dir, "embeddings"))


def op12_integer_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distances and centroid digest of every vector."""
    return integer_clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every damaged conversation."""
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_simhash, op3_token_files, op4_arc_to_warc, op5_url_rules, op6_license_scan,
    op7_quality_classifier, op8_decontamination, op9_mixing, op10_language_id, op11_learned_partitions,
    op12_integer_clusters, op13_conversation_repair)}


def _quality_sql() -> str:
    words = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
    stops = ", ".join(f"'{w}'" for w in sorted(set(" ".join(quality_rules.STOP_WORDS.values()).split())))

    def fails(rule: quality_rules.Rule) -> str:
        per = "1" if rule.per == "one" else rule.per
        sign = "<" if rule.bound == "min" else ">"
        return f"CASE WHEN 100 * {rule.measure} {sign} {rule.percent} * {per} THEN '{rule.name}' END"

    listed = ", ".join(map(fails, quality_rules.BASE_RULES + quality_rules.RULES))
    base = ", ".join(f"'{r.name}'" for r in quality_rules.BASE_RULES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT r, doc_id, text, {words} AS words,
                 [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
    win AS (SELECT r, i, words[i:i + 7] AS v FROM (
              SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, v) AS n FROM win) WHERE n > 1),
    rep AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (
              SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
    m AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                 length(regexp_replace(text, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper,
                 len([x FOR x IN words IF lower(x) IN ({stops})]) AS n_stop_words,
                 len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                 coalesce(rep.n, 0) AS n_repeat_words
          FROM w LEFT JOIN rep USING (r)),
    j AS (SELECT *, [x FOR x IN [{listed}] IF x IS NOT NULL] AS failed FROM m)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
           CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
           list_has_any(failed, [{base}]) AS base_failed, len(failed) = 0 AS kept,
           array_to_string(failed, ',') AS failed_rules
    FROM j"""


_WARC_SQL = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(encode(html)) AS payload_digest FROM p),
    m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
    FROM m"""

SQL: dict[str, str] = {"op1_quality_rules": _quality_sql(), "op4_arc_to_warc": _WARC_SQL,
                       "op12_integer_clusters": integer_clusters.sql()}
