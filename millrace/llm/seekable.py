"""The seekable zstandard layout: independent frames and a trailing seek table.

Every data frame is an ordinary zstandard frame. The file ends in a skippable
frame that lists, per frame, its compressed size, its decompressed size and the
low 32 bits of the XXH64 (seed 0) of its decompressed bytes, so any zstandard
reader can decompress the whole file and a seeking one only the frames it needs.
The last data frame of a token file is the index of its documents.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
import zstandard

# Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER, FOOTER_SIZE = "<IBI", 9
ENTRY, ENTRY_SIZE = "<III", 12


def _checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, 0) & 0xFFFFFFFF


class FrameWriter:
    """Writes frames to a binary sink and the seek table at the end."""

    def __init__(self, sink, level: int = 3) -> None:
        self._sink, self._entries = sink, []
        self._compressor = zstandard.ZstdCompressor(level=level)
        self.written = 0

    def frame(self, data: bytes) -> None:
        packed = self._compressor.compress(data)
        self._sink.write(packed)
        self._entries.append(struct.pack(ENTRY, len(packed), len(data), _checksum(data)))
        self.written += len(packed)

    def finish(self) -> None:
        body = b"".join(self._entries) + struct.pack(FOOTER, len(self._entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self._sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class FrameReader:
    """Reads single frames of a seekable file; a wrong checksum is an error."""

    def __init__(self, source) -> None:
        self._source, size = source, source.size()
        n, flags, magic = struct.unpack(FOOTER, source.read_at(FOOTER_SIZE, size - FOOTER_SIZE))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        table = source.read_at(n * ENTRY_SIZE, size - FOOTER_SIZE - n * ENTRY_SIZE)
        entries = np.frombuffer(table, np.dtype("<u4")).reshape(n, 3).astype(np.int64)
        self.sizes, self._sums = entries[:, 1], entries[:, 2]
        self._packed = entries[:, 0]
        self._at = np.concatenate([[0], np.cumsum(entries[:, 0])])
        #: Where each frame starts among the decompressed bytes.
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self._decompressor = zstandard.ZstdDecompressor()
        self.frames_read = 0

    def __len__(self) -> int:
        return len(self.sizes)

    def frame(self, i: int) -> bytes:
        packed = self._source.read_at(int(self._packed[i]), int(self._at[i]))
        data = self._decompressor.decompress(packed, max_output_size=int(self.sizes[i]))
        if len(data) != self.sizes[i] or _checksum(data) != self._sums[i]:
            raise ValueError(f"frame {i} does not match its checksum")
        self.frames_read += 1
        return data

    def range(self, start: int, end: int) -> bytes:
        """Decompressed bytes ``start`` to ``end``, from the frames that hold them only."""
        if end <= start:
            return b""
        first = int(np.searchsorted(self.starts, start, "right")) - 1
        last = int(np.searchsorted(self.starts, end, "left"))
        data = b"".join(self.frame(i) for i in range(first, last))
        return data[start - self.starts[first]:end - self.starts[first]]


@dataclass(frozen=True)
class Entry:
    """A document of a token file: its id (or none), first token in the file, number of tokens."""

    doc_id: int | None
    start: int
    n_tokens: int


class TokenFileWriter:
    """Collects the ids of documents into frames of about ``frame_bytes``."""

    def __init__(self, sink, frame_bytes: int = 1 << 18) -> None:
        self._frames, self._limit = FrameWriter(sink), frame_bytes
        self._parts, self._held = [], 0
        self._ids, self._lengths = [], []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids`` are little-endian unsigned 32-bit integers."""
        self._ids.append(doc_id)
        self._lengths.append(len(ids) // 4)
        self.tokens += len(ids) // 4
        self._parts.append(ids)
        self._held += len(ids)
        if self._held >= self._limit:
            self._flush()

    def _flush(self) -> None:
        data = b"".join(self._parts)
        for at in range(0, len(data), self._limit):
            self._frames.frame(data[at:at + self._limit])
        self._parts, self._held = [], 0

    @property
    def docs(self) -> int:
        return len(self._ids)

    def finish(self) -> None:
        self._flush()
        known = np.array([i is not None for i in self._ids], np.uint8)
        ids = np.array([i or 0 for i in self._ids], "<i8")
        self._frames.frame(struct.pack("<Q", len(ids)) + ids.tobytes()
                           + np.array(self._lengths, "<i8").tobytes() + known.tobytes())
        self._frames.finish()


class TokenFileReader:
    def __init__(self, source) -> None:
        self._frames = FrameReader(source)
        index = self._frames.frame(len(self._frames) - 1)
        (n,) = struct.unpack_from("<Q", index)
        ids = np.frombuffer(index, "<i8", n, 8)
        self._lengths = np.frombuffer(index, "<i8", n, 8 + 8 * n)
        known = np.frombuffer(index, np.uint8, n, 8 + 16 * n)
        self._ids = [int(i) if k else None for i, k in zip(ids, known)]
        self._starts = np.concatenate([[0], np.cumsum(self._lengths)])

    @property
    def frames_read(self) -> int:
        return self._frames.frames_read

    def entries(self) -> Iterator[Entry]:
        for i, doc in enumerate(self._ids):
            yield Entry(doc, int(self._starts[i]), int(self._lengths[i]))

    def ids(self, entry: Entry) -> np.ndarray:
        """The token ids of one document."""
        return np.frombuffer(self._frames.range(4 * entry.start, 4 * (entry.start + entry.n_tokens)), "<u4")

    def documents(self) -> Iterator[tuple[Entry, bytes]]:
        """Every document in file order; each frame is decompressed once."""
        held, at, frame = b"", 0, 0
        for entry in self.entries():
            size = 4 * entry.n_tokens
            parts, have = [held[at:]], len(held) - at
            if have >= size:
                yield entry, held[at:at + size]
                at += size
                continue
            while have < size:
                held = self._frames.frame(frame)
                frame += 1
                parts.append(held)
                have += len(held)
            at = len(held) - (have - size)
            yield entry, b"".join(parts)[:size]


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
