"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from millrace.llm.common import as_bytes, unused, written

NONE = "(none)"
N_TOPICS = 8
_CONTENT = re.compile(rb"[a-z\x80-\xff]{6,}")
#: Exponents that temper observed token shares to default targets: 1 keeps them, 0 levels them.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.5}
#: No cell weighs more than this many times its mean share; others make up for it as far as margins allow.
MAX_RATIO = 8.0
#: Times that a source's factor is found anew while more of its cells reach the bound.
_FILLS = 4


def topic_and_size(text: bytes | None) -> tuple[int, int]:
    """Topic and number of words of a text.

    Topics are groups of a hashed vocabulary: the group that most of the
    longer words fall into, the lowest on ties; 0 without such words.
    """
    data = (text or b"").lower()
    long_words = _CONTENT.findall(data)
    if not long_words:
        return 0, len(data.split())
    groups = np.fromiter(map(zlib.crc32, long_words), np.uint32, len(long_words)) % N_TOPICS
    return int(np.argmax(np.bincount(groups, minlength=N_TOPICS))), len(data.split())


def _key(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(NONE))


def profile(docs: DataFrame) -> DataFrame:
    """Return doc_id, source, lang, topic, tokens and a draw in [0, 1) for every row.

    Nulls in source and lang count as one value of their own. The draw is a
    hash of id and text: the same row always draws the same.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key("source").alias("source"),
                         _key("lang").alias("lang"), _draw(F.col("doc_id"), F.col("text")).alias("draw"),
                         F.col("text").alias("text"))

    def batches(rows):
        for batch in rows:
            found = [topic_and_size(t) for t in as_bytes(batch.column(4))]
            topics, sizes = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(topics, pa.int32()), pa.array(sizes, pa.int64()), batch.column(3)],
                names=["doc_id", "source", "lang", "topic", "tokens", "draw"])

    return source.mapInArrow(batches, "doc_id long, source string, lang string, topic int, tokens long, draw double")


def _draw(doc_id: Column, text: Column, seed: int = 2024) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(doc_id.cast("long"), text, F.lit(seed)), 11)
    return bits.cast("double") / float(1 << 53)


@dataclass
class Fit:
    """The factors of lang and topic, and how far the margins were off at the end."""

    lang: dict[str, float]
    topic: dict[int, float]
    rounds: int
    error: float


def _shares(totals: Mapping, temper: float) -> dict:
    powers = {k: float(v) ** temper for k, v in totals.items() if v > 0}
    whole = sum(powers.values())
    return {k: v / whole for k, v in powers.items()}


def _factors(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def rake(cells: DataFrame, targets: Mapping[str, Mapping] | None = None, rounds: int = 50,
         tolerance: float = 1e-6, max_pairs: int = 100_000, max_ratio: float = float("inf")) -> tuple[DataFrame, Fit]:
    """Fit cell weights to the source, language and topic margins, none above ``max_ratio`` times the mean.

    ``cells`` holds (source, lang, topic, tokens) with one row per cell and
    positive tokens. ``targets`` gives shares for a margin; one left out is the
    observed one, tempered. Returns (source, lang, topic, tokens, ratio), where
    ``ratio`` is the wanted share of a cell's tokens over the mean, and the fit.

    Sources may be many: each is one row with its own small array of (lang,
    topic) cells, and its factor is found in that row: cells at the bound keep
    it, and the factor of the others makes up for them. A source or value whose
    cells are all at the bound falls short of its target, and ``Fit.error``
    says by how much at most. Only the sums per (lang, topic) reach the driver,
    which scales the two short margins; more than ``max_pairs`` of them is an
    error. A round is one small aggregation.
    """
    if cells.isEmpty():
        return cells.select("source", "lang", "topic", "tokens", F.lit(1.0).alias("ratio")), Fit({}, {}, 0, 0.0)
    targets = dict(targets or {})
    pairs = cells.groupBy("lang", "topic").agg(F.sum("tokens").alias("tokens")).limit(max_pairs + 1).collect()
    if len(pairs) > max_pairs:
        raise ValueError(f"more than {max_pairs} pairs of language and topic")
    for name in ("lang", "topic"):
        totals: dict = {}
        for row in pairs:
            totals[row[name]] = totals.get(row[name], 0) + row["tokens"]
        targets.setdefault(name, _shares(totals, TEMPER[name]))
    by_source = cells.groupBy("source").agg(
        F.sum("tokens").alias("n"), F.collect_list(F.struct("lang", "topic", "tokens")).alias("cells"))
    if "source" in targets:
        wanted = F.coalesce(_factors(targets["source"])[F.col("source")], F.lit(0.0))
    else:
        wanted = F.pow(F.col("n").cast("double"), TEMPER["source"])
    by_source = written(by_source.select("source", "cells", wanted.alias("wanted")), "mix-sources")
    whole = by_source.agg(F.sum("wanted")).first()[0]
    by_source = by_source.withColumn("wanted", F.col("wanted") / whole)

    fit = Fit({k: 1.0 for k in targets["lang"]}, {k: 1.0 for k in targets["topic"]}, 0, float("inf"))

    total = sum(r["tokens"] for r in pairs)

    def fitted() -> DataFrame:
        lang, topic = _factors(fit.lang), _factors(fit.topic)

        def share(c: Column) -> Column:
            return c["tokens"] * F.coalesce(lang[c["lang"]], F.lit(0.0)) * F.coalesce(topic[c["topic"]], F.lit(0.0))

        def summed(values: Column) -> Column:
            return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)

        def over(c: Column) -> Column:
            return c["share"] * F.col("factor") > c["top"]

        now = by_source.select("source", "wanted", F.transform("cells", lambda c: F.struct(
            c["lang"].alias("lang"), c["topic"].alias("topic"), c["tokens"].alias("tokens"), share(c).alias("share"),
            (c["tokens"] / total * max_ratio).alias("top"))).alias("cells"))
        now = now.withColumn("factor", F.try_divide("wanted", summed(F.transform("cells", lambda c: c["share"]))))
        for _ in range(_FILLS if max_ratio < float("inf") else 0):
            left = F.col("wanted") - summed(F.transform(F.filter("cells", over), lambda c: c["top"]))
            open_share = summed(F.transform(F.filter("cells", lambda c: ~over(c)), lambda c: c["share"]))
            now = now.withColumn("factor", F.greatest("factor", F.try_divide(left, open_share)))
        return now.select("source", F.explode(F.transform("cells", lambda c: F.struct(
            c["lang"].alias("lang"), c["topic"].alias("topic"), c["tokens"].alias("tokens"),
            F.when(c["share"] > 0, F.least(c["share"] * F.col("factor"), c["top"])).otherwise(0.0).alias("weight")
        ))).alias("cell")).select("source", "cell.*")

    for fit.rounds in range(1, rounds + 1):
        sums = {(r["lang"], r["topic"]): r["weight"] for r in fitted().groupBy("lang", "topic").agg(
            F.sum("weight").alias("weight")).collect()}
        before, fit.error = fit.error, 0.0
        for name, at in (("lang", 0), ("topic", 1)):
            now: dict = {}
            for pair, weight in sums.items():
                now[pair[at]] = now.get(pair[at], 0.0) + weight
            factors = getattr(fit, name)
            steps = {k: targets[name][k] / now[k] if now.get(k) else 1.0 for k in factors}
            fit.error = max(fit.error, *(abs(now.get(k, 0.0) - v) for k, v in targets[name].items()))
            for k, step in steps.items():
                factors[k] *= step
            sums = {pair: weight * steps.get(pair[at], 1.0) for pair, weight in sums.items()}
        if fit.error < tolerance or abs(before - fit.error) < tolerance / 100:  # met, or as near as the bound lets it
            break
    return fitted().select("source", "lang", "topic", "tokens",
                           (F.col("weight") * float(total) / F.col("tokens")).alias("ratio")), fit


def rates(profiled: DataFrame, targets: Mapping[str, Mapping] | None = None,
          max_ratio: float = MAX_RATIO) -> DataFrame:
    """Return (source, lang, topic, ratio, probability) per cell of profiled documents.

    Probabilities are ratios over the largest, so kept tokens have the fitted
    shares in expectation. Ratios are fitted with ``max_ratio`` as a bound;
    without one, a tiny cell that is wanted often would thin out all others.
    Cells of empty texts have no token to weigh and are kept whole.
    """
    counted = profiled.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    counted = written(counted, "mix-cells")
    def fitted(bound: float) -> tuple[DataFrame, float]:
        raked = written(rake(counted.where("tokens > 0"), targets, max_ratio=bound)[0], "mix-rates")
        return raked, raked.agg(F.max("ratio")).first()[0] or 1.0

    raked, top = fitted(float("inf"))
    if top > max_ratio:  # a bound beyond all ratios changes none, so it need not be carried through the rounds
        raked, top = fitted(max_ratio)
    weighed = raked.select("source", "lang", "topic", "ratio", (F.col("ratio") / top).alias("probability"))
    bare = counted.where("tokens = 0").select("source", "lang", "topic", F.lit(1.0).alias("ratio"),
                                              F.lit(1.0).alias("probability"))
    return weighed.unionByName(bare)


def mix(docs: DataFrame, targets: Mapping[str, Mapping] | None = None,
        max_ratio: float = MAX_RATIO) -> DataFrame:
    """Profile, weigh and sample every document.

    Returns doc_id, source, lang, topic, tokens, ratio, probability and kept
    (the row's draw lies below its probability) for every row of ``docs``.
    """
    profiled = written(profile(docs), "mix-profile")
    rated = rates(profiled, targets, max_ratio)
    return profiled.join(rated, ["source", "lang", "topic"]).select(
        "doc_id", "source", "lang", "topic", "tokens", "ratio", "probability",
        (F.col("draw") < F.col("probability")).alias("kept"))


def sampled(docs: DataFrame, targets: Mapping[str, Mapping] | None = None,
            max_ratio: float = MAX_RATIO) -> DataFrame:
    """The sampled rows of ``docs``, all columns as they were.

    Topics are found again where the text is read, which costs less than
    shuffling whole texts to a join by id. Nulls in source and lang are a value
    of their own, null and empty texts are kept whole, and rows that repeat an
    id and a text are kept or dropped together. No row, no sample.
    """
    names = [unused(docs, n) for n in ("__source", "__lang", "__topic", "__probability")]
    by_source, by_lang, by_topic, chance = names
    rated = rates(profile(docs), targets, max_ratio).select(
        F.col("source").alias(by_source), F.col("lang").alias(by_lang), F.col("topic").alias(by_topic),
        F.col("probability").alias(chance))
    at = docs.columns.index("text")

    def batches(rows):
        for batch in rows:
            topics = [topic_and_size(t)[0] for t in as_bytes(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(topics, pa.int32())],
                                             names=[*batch.schema.names, by_topic])

    schema = f"{_ddl(docs)}, `{by_topic}` int"
    with_topic = docs.mapInArrow(batches, schema).withColumns({by_source: _key("source"), by_lang: _key("lang")})
    return with_topic.join(rated, names[:3]).where(
        _draw(F.col("doc_id"), F.col("text")) < F.col(chance)).select(*docs.columns)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
