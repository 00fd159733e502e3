"""Token ids of a corpus in seekable zstandard files, in global document order."""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from millrace.llm.common import file_system, new_file, new_folder, worker_state, written
from millrace.llm.seekable import Entry, TokenFileReader, TokenFileWriter, crc32

MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, first_doc long, last_doc long"


#: Signs that may stand behind a word; neither an apostrophe nor ``<``, which can begin tokens of their own.
_TAIL = ".,;:!?#%&*$|"
#: Letters that stay single letters when normalised and lower-cased, whatever ASCII sign follows: ASCII and Latin-1.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = f"^[{_LETTERS}]+[{_TAIL}]*$"
_GROUP_BYTES = 8 << 20

# The layout of a tokenizer file for which texts encode chunk by chunk and words regardless of case.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Encoder:
    """Token ids of texts, equal to those of encoding each text whole.

    Tokenizers of one layout (NFC, lower case, white space dropped, words and
    signs apart) are run on the distinct chunks between spaces only: a chunk of
    letters and signs behind it has the ids of the lower-case letters and those
    of the signs. Any other tokenizer encodes every text as it is.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            layout = json.load(source)
        pre = (layout["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        added = [t for t in layout["added_tokens"] if t["normalized"] or not t["content"].startswith("<")]
        self._by_chunk = not added and layout["post_processor"] is None and (
            (layout["normalizer"] or {}).get("normalizers") == _NORMALIZERS) and (
            pre[0].get("pattern") == {"Regex": _SPLIT} and [p["type"] for p in pre] == ["Split", "ByteLevel"])

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        texts = texts.fill_null("")
        size, low = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
        while low < len(texts):
            before = size[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(size, before + _GROUP_BYTES, "right")))
            group = texts.slice(low, high - low)
            if self._by_chunk:
                yield from self._group(group)
            else:
                yield from (_pack(i) for i in self._ids(group.to_pylist()))
            low = high

    def _ids(self, texts: list[str]) -> Iterator[list[int]]:
        for at in range(0, len(texts), 5000):
            for code in self._tokenizer.encode_batch_fast(texts[at:at + 5000], add_special_tokens=False):
                yield code.ids

    def _group(self, texts: pa.Array) -> Iterator[bytes]:
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = chunks.flatten().dictionary_encode()
        flat, lengths = self._distinct(coded.dictionary)
        ids, ends = _gather(flat, lengths, coded.indices.to_numpy())
        bounds = np.concatenate([[0], ends])[chunks.offsets.to_numpy()]
        for low, high in itertools.pairwise(bounds):
            yield ids[low:high].tobytes()

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, one after the other, and how many each has."""
        worded = pc.match_substring_regex(chunks, _WORD)
        heads = pc.if_else(worded, pc.utf8_lower(pc.utf8_rtrim(chunks, _TAIL)), chunks)
        tails = pc.if_else(worded, pc.replace_substring_regex(chunks, f"^[{_LETTERS}]+", ""), "")
        parts = pa.concat_arrays([heads, tails]).dictionary_encode()
        units = parts.dictionary
        plain = pc.match_substring_regex(units, "^[a-z]+$").to_numpy(zero_copy_only=False)
        units, tokenize, lists = units.to_pylist(), self._tokenizer.model.tokenize, [None] * len(units)
        rest = np.flatnonzero(~plain)
        for at, ids in zip(rest, self._ids([units[i] for i in rest])):
            lists[at] = ids
        for at in np.flatnonzero(plain):  # one word as it is: the model's part of encoding alone
            lists[at] = [token.id for token in tokenize(units[at])]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(lengths.sum()))
        pairs = parts.indices.to_numpy().reshape(2, -1).T.ravel()  # head and tail of each chunk in turn
        ids, _ = _gather(flat, lengths, pairs)
        return ids, lengths[pairs].reshape(-1, 2).sum(axis=1)


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


def _gather(flat: np.ndarray, lengths: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` numbered ``wanted``, joined, and where each ends."""
    starts, own = np.cumsum(lengths) - lengths, lengths[wanted]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) - np.repeat(ends - own - starts[wanted], own)].astype("<u4"), ends


def encoder(tokenizer_path: str) -> Encoder:
    """The encoder of a tokenizer file, loaded once per worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    state = worker_state()
    if ("encoder", tokenizer_path) not in state:
        state["encoder", tokenizer_path] = Encoder(tokenizer_path)
    return state["encoder", tokenizer_path]


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id",
                 text: str = "text", partitions: int | None = None, file_tokens: int = 1 << 25,
                 frame_bytes: int = 1 << 18) -> DataFrame:
    """Write the ids of every text, ``end_id`` appended, and return the manifest.

    Files hold documents in ascending order of ``key`` (nulls first, ties by a
    hash of the text), also across files when read by (part, seq). The order
    comes from one range exchange on (key, hash), so rows that repeat one key
    spread by their text. A task writes files of at most about ``file_tokens``
    ids and holds one frame and one file's index at a time. A null text counts
    as empty: the end id alone. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    source = docs.select(F.col(key).cast("long").alias("doc_id"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = source.repartitionByRange(n, *order).sortWithinPartitions(*order)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches):
        encode, part, seq = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        out = writer = first = last = uri = None

        def close():
            writer.finish()
            out.close()
            return pa.RecordBatch.from_pylist([{
                "part": part, "seq": seq, "path": uri, "n_docs": writer.docs, "n_tokens": writer.tokens,
                "first_doc": first, "last_doc": last}], schema=manifest)

        manifest = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()),
                              ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
                              ("first_doc", pa.int64()), ("last_doc", pa.int64())])
        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1))):
                if writer is None:
                    uri, out = new_file(folder, f"tokens-{part:06d}-{seq:04d}", ".zst")
                    writer, first = TokenFileWriter(out, frame_bytes), doc
                writer.add(doc, ids + end)
                last = doc
                if writer.tokens >= file_tokens:
                    yield close()
                    writer, seq = None, seq + 1
        if writer is not None:
            yield close()

    return written(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: doc_id, start, n_tokens, ids_crc32 per document.

    ``start`` counts the ids of all documents before. File starts are a running
    sum over the manifest, one row per file; documents are read file by file in
    parallel, and every frame is checked against its checksum.
    """
    whole = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(whole), F.lit(0)).alias("start"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = file_system(uri)
                with fs.open_input_file(path) as source:
                    rows = []
                    for entry, ids in TokenFileReader(source).documents():
                        rows.append((entry.doc_id, start + entry.start, entry.n_tokens, crc32(ids)))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                    yield _rows(rows)

    return placed.repartition(n).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])


def directory(manifest: DataFrame) -> DataFrame:
    """Where each document lies: (doc_id, path, first, n_tokens); only index frames are read."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("doc_id", pa.int64()), ("path", pa.string()), ("first", pa.int64()),
                        ("n_tokens", pa.int64())])

    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = file_system(uri)
                with fs.open_input_file(path) as source:
                    entries = list(TokenFileReader(source).entries())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e.doc_id for e in entries], pa.int64()), pa.array([uri] * len(entries)),
                     pa.array([e.start for e in entries], pa.int64()),
                     pa.array([e.n_tokens for e in entries], pa.int64())], schema=schema)

    return manifest.select("path").repartition(n).mapInArrow(
        read, "doc_id long, path string, first long, n_tokens long")


def fetch(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The token ids of the requested documents only: (doc_id, ids).

    ``doc_ids`` has the wanted ids in its first column. Of each file only the
    index and the frames of wanted documents are decompressed.
    """
    wanted = doc_ids.select(F.col(doc_ids.columns[0]).cast("long").alias("doc_id")).distinct()
    asked = directory(manifest).hint("merge").join(wanted, "doc_id").select("path", "doc_id", "first", "n_tokens")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def read(batches):
        opened = reader = None
        for batch in batches:
            for uri, doc, first, count in zip(*(c.to_pylist() for c in batch.columns)):
                if uri != opened:
                    fs, path = file_system(uri)
                    reader, opened = TokenFileReader(fs.open_input_file(path)), uri
                ids = reader.ids(Entry(doc, first, count)).astype(np.int64)
                yield pa.RecordBatch.from_pylist([{"doc_id": doc, "ids": ids}], schema=schema)

    return asked.repartition(n, "path").sortWithinPartitions("path", "first").mapInArrow(
        read, "doc_id long, ids array<long>")
