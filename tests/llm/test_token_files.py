import io
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from millrace.llm import queries, token_files as op
from millrace.llm.common import file_system
from millrace.llm.seekable import FrameReader, TokenFileReader, TokenFileWriter

PATH = public_tokenizers.path(queries.TOKENIZER)
TOKENIZER = Tokenizer.from_file(PATH)


def whole(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def coded(*texts, path=PATH):
    return [np.frombuffer(ids, "<u4").tolist() for ids in op.encoder(path)(pa.array(texts, pa.string()))]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x1c\x85\xa0'sStTeEΣσİ́<|endoftext|>0aéÀÿ×.,;:!?#%&*$|̸"), st.characters(
    exclude_categories=("Cs",))), max_size=40), max_size=4))
def test_chunks_encode_like_whole_texts(texts):
    assert coded(*texts) == [whole(t) for t in texts]


def test_every_letter_before_every_sign():
    """Also those that lower-casing or normalising turns into a letter and a mark."""
    texts = [" ".join(f"{chr(c)}{sign} x{chr(c)}{sign}{sign}" for sign in op._TAIL)
             for c in range(sys.maxunicode + 1) if chr(c).isalpha() and not 0xD800 <= c < 0xE000]
    found = coded(*texts)
    expected = TOKENIZER.encode_batch_fast(texts, add_special_tokens=False)
    assert [t for t, ids, want in zip(texts, found, expected) if ids != want.ids] == []


def test_turkish_hindi_and_hebrew_lines():
    texts = ["BAKİ, x. İ. İZMİR; ISPARTA!", "क़. ख़, ग़; पढ़ो! हिन्दी में.", "שׁ. בּ, כּל! יִ;", None, "", "ﬁn. ǅ, ŉ! ẞ?"]
    assert coded(*texts) == [whole(t) for t in texts]


def test_groups_of_texts(monkeypatch):
    texts = ["The the.", "", "and x!! " * 50, "or, if", "<|endoftext|> it's"] * 3
    monkeypatch.setattr(op, "_GROUP_BYTES", 12)
    assert coded(*texts) == [whole(t) for t in texts]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, texts = Tokenizer.from_file(path), ["BIG big Big.", " two  spaces\n", "", "<|endoftext|>"]
    assert coded(*texts, path=path) == [own.encode(t, add_special_tokens=False).ids for t in texts]


def brute(docs):
    start, out = 0, []
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = whole(text) + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_matches_brute_force(documents, spark):
    manifest = op.write_tokens(documents, PATH, 2, file_tokens=20_000, frame_bytes=4096)
    assert manifest.count() > 8
    assert sorted(map(tuple, op.read_tokens(manifest).collect())) == brute(documents)
    wanted = spark.createDataFrame([(5,), (77,), (999_999,)], "id long")
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    got = {r["doc_id"]: r["ids"] for r in op.fetch(manifest, wanted).collect()}
    assert got == {i: whole(texts[i]) + [2] for i in (5, 77)}


def test_odd_rows(odd_docs):
    got = op.read_tokens(op.write_tokens(odd_docs, PATH, 2)).collect()
    want = brute(odd_docs)
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (d or 0, n, c) for d, _, n, c in want)
    ordered = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in ordered]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))


def test_empty_table(no_docs):
    assert op.read_tokens(op.write_tokens(no_docs, PATH, 2)).collect() == []


def packed(*ids):
    return np.array(ids, "<u4").tobytes()


def test_format(documents):
    sink = io.BytesIO()
    writer = TokenFileWriter(sink, frame_bytes=64)
    texts = {1: packed(*range(50)), 2: packed(7), None: b"", 3: packed(*range(40))}
    for doc, ids in texts.items():
        writer.add(doc, ids)
    writer.finish()
    data = sink.getvalue()
    # any zstandard reader can read the whole stream
    stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert stream.startswith(b"".join(texts.values()))
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    assert (flags, magic) == (0x80, 0x8F92EAB1)
    sizes = struct.unpack(f"<{3 * n}I", data[-9 - 12 * n:-9])
    assert struct.unpack("<II", data[-17 - 12 * n:-9 - 12 * n]) == (0x184D2A5E, 12 * n + 9)
    assert sum(sizes[0::3]) == len(data) - 17 - 12 * n
    first = zstandard.ZstdDecompressor().decompress(data[:sizes[0]])
    assert xxhash.xxh64_intdigest(first) & 0xFFFFFFFF == sizes[2]
    reader = TokenFileReader(pa.BufferReader(data))
    entries = {e.doc_id: e for e in reader.entries()}
    assert reader.frames_read == 1  # the index alone
    assert reader.ids(entries[2]).tolist() == [7]
    assert reader.frames_read == 2  # and one frame for one short document
    assert [(e.doc_id, ids) for e, ids in reader.documents()] == list(texts.items())


def test_damage_is_found(documents):
    manifest = op.write_tokens(documents.limit(5), PATH, 2, partitions=1)
    fs, path = file_system(manifest.first()["path"])
    data = bytearray(fs.open_input_file(path).read())
    with pytest.raises(ValueError):
        data[-1] ^= 1
        FrameReader(pa.BufferReader(bytes(data)))
    data[-1] ^= 1
    data[10] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        FrameReader(pa.BufferReader(bytes(data))).frame(0)
