"""Benchmark decontamination: pigeonhole pieces, exact hits, bit-parallel verification."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from millrace.llm.common import worker_state

_WORD = re.compile(r"\w+")
LEAKS = "doc_id long, item_id long, distance long, item_words long, last_word long"


def words_of(text: str | None) -> list[str]:
    """Lower-case words; punctuation and spacing do not count."""
    return _WORD.findall(text.lower()) if text else []


def budget(n_words: int, max_error: float) -> int:
    """How many word edits (insert, delete, replace) an item of ``n_words`` words may take."""
    return int(n_words * max_error + 1e-9)


def pieces(words: list[str], errors: int) -> list[tuple[int, list[str]]]:
    """Split into ``errors + 1`` pieces (start, words): whatever the edits, one piece stays whole."""
    cuts = [len(words) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(masks: dict[str, int], size: int, text: list[str]) -> tuple[int, int]:
    """Least edit distance of a pattern of ``size`` words to any stretch of ``text``, and its last word.

    The bit-parallel column step of Myers; ``masks`` holds, per word, the
    positions of the pattern where it stands. Of equal distances the first end
    counts; -1 stands for the empty stretch.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, -1
    for i, word in enumerate(text):
        eq = masks.get(word, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(horizontal | plus)), plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, i
    return best, end


@dataclass
class _Item:
    item_id: int
    size: int
    errors: int
    masks: dict[str, int]


class Matcher:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple[int, str | None]], max_error: float, min_words: int,
                 short_exact: bool = False) -> None:
        import ahocorasick

        self._items: list[_Item] = []
        listed: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            short = len(words) < min_words
            if not words or short and not short_exact:
                continue
            masks: dict[str, int] = {}
            for i, word in enumerate(words):
                masks[word] = masks.get(word, 0) | 1 << i
            errors = 0 if short else budget(len(words), max_error)
            for start, piece in pieces(words, errors):
                listed.setdefault(f" {' '.join(piece)} ", []).append((len(self._items), start))
            self._items.append(_Item(item_id, len(words), errors, masks))
        self._automaton = ahocorasick.Automaton() if listed else None
        for piece, places in listed.items():
            self._automaton.add_word(piece, (len(piece), places))
        if listed:
            self._automaton.make_automaton()

    def find(self, text: str | None) -> Iterator[tuple[int, int, int, int]]:
        """(item_id, distance, words of the item, last word of the match) for each item in the text."""
        words = words_of(text) if self._automaton else []
        if not words:
            return
        places: dict[int, set[int]] = {}
        begins = None
        for end, (length, listed) in self._automaton.iter(f" {' '.join(words)} "):
            if begins is None:
                begins = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
            at = int(np.searchsorted(begins, end - length + 1))
            for item, start in listed:
                places.setdefault(item, set()).add(at - start)
        for i, offsets in places.items():
            item, found = self._items[i], None
            for low, high in _windows(sorted(offsets), item.size, item.errors, len(words)):
                distance, end = best_match(item.masks, item.size, words[low:high])
                if distance <= item.errors and (found is None or distance < found[0]):
                    found = distance, low + end
                    if not distance:
                        break
            if found:
                yield item.item_id, found[0], item.size, found[1]


def _windows(offsets: list[int], size: int, errors: int, n: int) -> Iterator[tuple[int, int]]:
    """Stretches of the text that hold every match a hit can belong to; overlapping ones are merged."""
    low = high = None
    for offset in offsets:
        a, b = max(0, offset - errors), min(n, offset + size + errors)
        if low is not None and a <= high:
            high = max(high, b)
            continue
        if low is not None:
            yield low, high
        low, high = a, b
    if low is not None:
        yield low, high


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple[int, str | None]]]:
    """The distinct items in blocks of about ``block_items``, dealt out by a hash of their id and text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.col("text").alias("text")).distinct()
    n = -(-items.count() // block_items)
    for i in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=str)


def leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.2, min_words: int = 8,
          block_items: int = 20_000, short_exact: bool = False) -> DataFrame:
    """Return (doc_id, item_id, distance, item_words, last_word) for each item found in a document.

    An item counts as found if some stretch of the document is within
    ``max_error`` times its words of word edits. The benchmark is the stated
    query set: it is held in blocks of ``block_items`` items, each matched
    against all documents in one pass without a shuffle. The hits of an item's
    pieces give the stretches to verify, so nothing within the budget is missed.
    Items of fewer than ``min_words`` words are matched word for word if
    ``short_exact`` is set, and not at all otherwise; null and empty texts hold
    no item and are none. A document
    comes back once per item and text of an item, repeated documents each on
    their own; a repeated item counts once.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    found = None
    for items in _blocks(benchmark, block_items):
        part = source.mapInArrow(_finder(
            _Block(spark, items), max_error, min_words, short_exact), LEAKS)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], LEAKS)


def _matcher(items, *options) -> Matcher:
    """The matcher of a block of items, built once per worker and kept until another block comes."""
    state, mark = worker_state(), (items.id, *options)
    if state.get("matcher", (None,))[0] != mark:
        state["matcher"] = mark, Matcher(items.items.value, *options)
    return state["matcher"][1]


class _Block:
    """A broadcast block of items and a name of its own for it."""

    def __init__(self, spark, items: list) -> None:
        self.items, self.id = spark.sparkContext.broadcast(items), uuid.uuid4().hex


def _finder(items, max_error: float, min_words: int, short_exact: bool):
    schema = pa.schema([(f.split()[0], pa.int64()) for f in LEAKS.split(", ")])

    def batches(rows):
        matcher = _matcher(items, max_error, min_words, short_exact)
        for batch in rows:
            hits = [(doc, item, distance, size, last)
                    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for item, distance, size, last in matcher.find(text)]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*hits)], schema=schema)

    return batches


def clean(docs: DataFrame, benchmark: DataFrame, max_error: float = 0.2, min_words: int = 8,
          block_items: int = 20_000, short_exact: bool = False) -> DataFrame:
    """The rows of ``docs`` that hold no item, as in ``leaks``, all columns as they were; one pass per block."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    for items in _blocks(benchmark, block_items):
        shared = _Block(spark, items)

        def batches(rows, shared=shared):
            matcher = _matcher(shared, max_error, min_words, short_exact)
            for batch in rows:
                yield batch.filter(pa.array([next(matcher.find(t), None) is None
                                             for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(batches, docs.schema)
    return docs
