"""SimHash near-duplicates by multi-index hashing over fingerprint segments."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import as_bytes, unused, written
from millrace.llm.components import components

SEED = 42
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text.

    Bytes ``lower`` and ``split`` touch ASCII only, which is the word rule.
    A text without words, empty or null, has fingerprint zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) \
        if len(words) >= shingle else iter([b" ".join(words)])
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _BLOCK):
        block = np.ascontiguousarray(hashes[at:at + _BLOCK].astype(">u8")).view(np.uint8)
        ones += np.unpackbits(block).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                 extra: str | None = None) -> DataFrame:
    """Return (doc_id, fp) of every row of ``docs``, and the long column ``extra``; whole texts, no shuffle."""
    more = [extra] if extra else []
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *more)

    def batches(rows):
        for batch in rows:
            fps = [fingerprint(t, shingle) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), *batch.columns[2:]],
                                             names=["doc_id", "fp", *more])

    return source.mapInArrow(batches, ", ".join(["doc_id long", "fp long", *(f"`{c}` long" for c in more)]))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _ball(width: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` bits within a segment of ``width`` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _segment(fp: str, index: int, width: int) -> Column:
    return F.shiftrightunsigned(F.col(fp), index * width).bitwiseAND(F.lit((1 << width) - 1))


def links(fps: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Return each pair (a, b), a < b, of distinct fingerprints at ``distance`` or fewer bits, once.

    ``fps`` holds one row per fingerprint. The table of segment ``i`` lists
    fingerprints under the value of that segment. By the pigeonhole principle
    two linked fingerprints differ by at most ``distance // segments`` bits in
    one segment, so each fingerprint looks up all values of that small Hamming
    ball, in every table, and the whole distance is verified inside the join.
    A pair met in several tables is kept by the first only. Pairs stay few:
    equal fingerprints were merged before, and a ball of ``distance`` bits
    holds a bounded number of others.
    """
    if 64 % segments or not 1 <= segments <= 32:
        raise ValueError("segments must divide 64")
    width, radius = 64 // segments, distance // segments
    masks = F.array(*[F.lit(m).cast("long") for m in _ball(width, radius)])
    listed = fps.select(F.col("fp").alias("b"), F.posexplode(F.array(
        *[_segment("fp", i, width) for i in range(segments)])).alias("segment", "value"))
    asked = fps.select(F.col("fp").alias("a"), F.posexplode(F.array(
        *[_segment("fp", i, width) for i in range(segments)])).alias("segment", "value")).select(
        "a", "segment", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))).alias("value"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.lit(True)
    for i in reversed(range(segments)):
        part = F.bit_count(F.shiftrightunsigned(differ, i * width).bitwiseAND(F.lit((1 << width) - 1)))
        first = F.when(part <= radius, F.col("segment") == i).otherwise(first)
    return asked.join(listed, ["segment", "value"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & first).select("a", "b")


def _rooted(nodes: DataFrame, distance: int, segments: int) -> DataFrame:
    """``nodes``, one row per fingerprint, with the root of each one's component."""
    roots = components(links(nodes.select("fp"), distance, segments), "simhash")
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 3, segments: int = 2) -> DataFrame:
    """Return doc_id, fingerprint (hex), component_id and group_size for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links, the row's own
    included. Rows with equal fingerprints are one node, so a group of copies,
    however large, costs one row. Null and empty texts share fingerprint zero
    and are linked like any other. A null doc_id is never smallest; a component
    of null ids alone has a null component_id. Repeated rows come back each.
    """
    marked = written(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    rooted = written(_rooted(nodes, distance, segments), "roots")
    groups = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size"))
    named = rooted.select("fp", "root").join(groups, "root").select("fp", "component_id", "group_size")
    return marked.join(named, "fp").select(
        "doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id", "group_size")


def one_per_group(docs: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """Keep one row of each near-duplicate group: the one with the smallest doc_id, all columns as they were.

    A row is judged by its own text: rows that repeat a doc_id with unlike
    texts belong to different groups and may both stay. Of rows of one group
    that share the smallest id, the one whose columns hash lowest stays; of
    rows equal in every column, one. Rows without a doc_id have no identity to
    be chosen by and are kept as they are, though their texts link others.
    """
    row = unused(docs, "__row")
    hashed = docs.withColumn(row, F.xxhash64(*docs.columns))
    rows = written(fingerprints(hashed, extra=row).groupBy("fp", "doc_id", row).agg(F.count("*").alias("n")),
                   "fingerprints")
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", row, "n"))
    nodes = written(rows.groupBy("fp").agg(F.min(named).alias("first")), "nodes")
    winners = written(_rooted(nodes, distance, segments).groupBy("root").agg(F.min("first").alias("first")).where(
        "first is not null").select("first.*"), "winners")
    once, more = winners.where("n = 1").drop("n"), winners.where("n > 1").drop("n")
    kept = hashed.join(once, ["doc_id", row], "left_semi").select(*docs.columns)
    equal = hashed.join(more, ["doc_id", row], "left_semi").dropDuplicates(["doc_id", row]).select(*docs.columns)
    return kept.unionByName(equal).unionByName(docs.where(F.col("doc_id").isNull()))
