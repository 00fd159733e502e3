"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: Frequent function words by which running prose is told from lists and noise.
STOP_WORDS = {
    "en": "the of and to in is that it for was on are as with be by at this have from or an",
    "de": "der die das und ist in zu den von mit sich auf für dem nicht ein eine als im an",
    "fr": "le la les de des et est un une du en que qui dans pour pas sur au avec par",
    "es": "el la los las de y que en un una es se no por con para del al lo su",
}
GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """``100 * measure`` must be at least (or at most) ``percent * per``."""

    name: str
    measure: str
    bound: str
    percent: int
    per: str


#: The base of every verdict.
BASE_RULES = (
    Rule("too_few_words", "n_words", "min", 2000, "one"),
    Rule("repeated_passages", "n_repeat_words", "max", 30, "n_words"),
)
#: Further rules; the bounds are those commonly published for web prose, given per hundred.
RULES = (
    Rule("short_words", "word_chars", "min", 200, "n_words"),
    Rule("long_words", "word_chars", "max", 1500, "n_words"),
    Rule("symbols", "n_symbols", "max", 10, "n_words"),
    Rule("few_stop_words", "n_stop_words", "min", 1, "n_words"),
    Rule("upper_case", "n_upper", "max", 30, "word_chars"),
    Rule("repeated_lines", "n_dup_lines", "max", 50, "n_lines"),
)


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text",
             stop_words: Sequence[str] | None = None) -> DataFrame:
    """Return ``key`` and the counts the rules use, a row per row of ``docs``.

    Each step is a projection of its own, so that arrays used more than once
    are built once. Nothing is shuffled. A null text counts as empty, whose
    counts are all zero; other columns of ``docs`` are ignored, whatever their
    names. Equal windows are told by 64-bit hashes compared within one text.
    """
    stops = sorted(set(stop_words if stop_words is not None
                       else " ".join(STOP_WORDS.values()).split()))
    split = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).select(
        key, "_text", F.array_remove(F.split("_text", GAP), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(NOT_GAP)).alias("_lines"))
    windows = F.when(F.size("_words") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>"))
    counted = split.select(
        key, F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("_windows"))
    kept = ["n_words", "word_chars", "n_symbols", "n_upper", "n_stop_words", "n_lines", "n_dup_lines"]
    # Texts without a repeated window, nearly all, stop here: the sort is never evaluated.
    ordered = counted.select(key, *kept, F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    ).alias("_ordered"))
    repeated = ordered.select(key, *kept, F.array_sort(F.transform(F.filter(
        F.transform("_ordered", lambda w, k: F.struct(
            w["i"].alias("i"),
            (F.coalesce(F.get("_ordered", k - 1)["h"] == w["h"], F.lit(False))
             | F.coalesce(F.get("_ordered", k + 1)["h"] == w["h"], F.lit(False))).alias("twice"))),
        lambda w: w["twice"]), lambda w: w["i"])).alias("_starts"))
    covered = F.aggregate(F.transform("_starts", lambda s, k: F.least(
        F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - s, F.lit(WINDOW)))),
        F.lit(0), lambda total, n: total + n)
    return repeated.select(key, *kept, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _fails(rule: Rule) -> Column:
    value = F.lit(100) * F.col(rule.measure)
    bound = F.lit(rule.percent) * (F.lit(1) if rule.per == "one" else F.col(rule.per))
    return value < bound if rule.bound == "min" else value > bound


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text",
          rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measure every text and apply the threshold table.

    Adds ``base_failed``, ``kept`` and ``failed_rules`` (names, in table order,
    an empty array if none) to the counts. A null or empty text fails by
    ``too_few_words``. Repeated rows are judged each on its own.
    """
    base = [F.when(_fails(r), F.lit(r.name)) for r in BASE_RULES]
    more = [F.when(_fails(r), F.lit(r.name)) for r in rules]
    judged = measures(docs, key, text).withColumn("failed_rules", F.array_compact(F.array(*base, *more)))
    names = [r.name for r in BASE_RULES]
    return judged.withColumn("base_failed", F.arrays_overlap(
        F.col("failed_rules"), F.array(*map(F.lit, names)))).withColumn("kept", F.size("failed_rules") == 0)
