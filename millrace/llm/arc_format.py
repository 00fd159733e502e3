"""Legacy ARC and WARC records as bytes: parsing, writing, converting one record."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

# The field lists of the two ARC versions, as a version block declares them.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location",
        "Offset", "Filename", "Archive-length"),
}
WARC_VERSION = b"WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
END = b"\r\n\r\n"
_SPACE = re.compile(r"[\x00-\x20\x7f]")


def pack(record: bytes) -> bytes:
    """A record as a gzip member of its own, so that readers can start at any record."""
    return gzip.compress(record, compresslevel=4, mtime=0)


class Members:
    """Iterates over (offset, length, data) of the gzip members of a stream."""

    def __init__(self, source, block: int = 1 << 18) -> None:
        self._source, self._block = source, block

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        offset, rest = 0, self._source.read(self._block)
        while rest:
            engine, parts, used = zlib.decompressobj(31), [], 0
            while True:
                parts.append(engine.decompress(rest))
                used += len(rest)
                if engine.eof:
                    used -= len(engine.unused_data)
                    rest = engine.unused_data or self._source.read(self._block)
                    break
                rest = self._source.read(self._block)
                if not rest:
                    raise ValueError(f"the gzip member at {offset} is cut off")
            yield offset, used, b"".join(parts)
            offset += used


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    block: bytes
    extra: dict[str, str] = field(default_factory=dict)


def _word(value: str | None) -> str:
    """A header field of an ARC line: blanks are percent-encoded, nothing is written as a dash."""
    return _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else "-"


def arc_record(record: ArcRecord, version: int = 1) -> bytes:
    common = [record.url, record.ip, record.date, record.content_type]
    if version == 2:
        common += [record.extra.get(k, "-") for k in ARC_FIELDS[2][4:9]]
    line = " ".join([*map(_word, common), str(len(record.block))])
    return line.encode() + b"\n" + record.block + b"\n"


def arc_header(name: str, version: int = 1, date: str = "19960101000000") -> bytes:
    """The version block that opens an ARC file."""
    body = f"{version} 0 millrace\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return arc_record(ArcRecord(f"filedesc://{name}", "0.0.0.0", date, "text/plain", body), version)


def parse_arc(data: bytes, fields: tuple[str, ...] | None) -> tuple[ArcRecord, tuple[str, ...]]:
    """Parse one ARC record; return it and the field list that holds from here on.

    A ``filedesc`` record declares the version of the file: its own line and
    all that follow have the fields of that version. Fields are counted from
    the right, so that blanks in an old URL do no harm, and the declared length
    decides where the block ends. A wrong or missing length is an error.
    """
    line, found, rest = data.lstrip(b"\r\n").partition(b"\n")
    if not found:
        raise ValueError("an ARC record without a header line")
    text = line.rstrip(b"\r").decode("utf-8", "replace")
    if text.startswith("filedesc://"):
        length = int(text.rsplit(" ", 1)[1])
        version = int(rest[:length].split(None, 1)[0])
        if version not in ARC_FIELDS:
            raise ValueError(f"unknown ARC version {version}")
        fields = ARC_FIELDS[version]
    elif fields is None:
        raise ValueError("an ARC file without a version block")
    values = text.rsplit(" ", len(fields) - 1)
    if len(values) != len(fields):
        raise ValueError(f"expected {len(fields)} header fields: {text[:200]}")
    named = dict(zip(fields, values))
    length = int(named["Archive-length"])
    if len(rest) < length:
        raise ValueError(f"{length} bytes are declared, {len(rest)} are there: {text[:200]}")
    return ArcRecord(named["URL"], named["IP-address"], named["Archive-date"], named["Content-type"],
                     rest[:length], {k: named[k] for k in fields[4:-1]}), fields


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The HTTP header (empty if the block has none) and the payload of a block."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    for mark in (b"\r\n\r\n", b"\n\n"):
        head, found, payload = block.partition(mark)
        if found and (mark == b"\r\n\r\n" or b"\r\n\r\n" not in head):
            return head + found, payload
    return block, b""


def http_field(head: bytes, name: str) -> str | None:
    for line in head.split(b"\n")[1:]:
        key, found, value = line.partition(b":")
        if found and key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hex_digest(labelled: str) -> str:
    return base64.b32decode(labelled.removeprefix("sha1:")).hex()


def warc_date(arc_date: str) -> str:
    """The WARC form of a 14-digit ARC date; shorter ones are filled up, others become 1970."""
    digits = (arc_date + "00010101000000"[len(arc_date):])[:14] if arc_date.isdigit() else ""
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return datetime.fromtimestamp(0, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(*parts: object) -> str:
    """An identifier that is the same each time the same record is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def warc_record(kind: str, rid: str, date: str, block: bytes, fields: dict[str, str | None]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, "WARC-Date": date, **fields,
            "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    lines = [WARC_VERSION] + [f"{k}: {v}".encode() for k, v in head.items() if v is not None]
    return b"\r\n".join(lines) + END + block + END


def convert(arc: ArcRecord, rid: str, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record: warcinfo, response, resource, or revisit of ``refers_to``."""
    date = warc_date(arc.date)
    if arc.url.startswith("filedesc://"):
        return warc_record("warcinfo", rid, date, arc.block, {
            "WARC-Filename": arc.url.removeprefix("filedesc://"), "Content-Type": "text/plain"})
    head, payload = split_http(arc.block)
    fields = {"WARC-Target-URI": arc.url, "WARC-IP-Address": None if arc.ip in ("-", "0.0.0.0") else arc.ip,
              "WARC-Payload-Digest": digest(payload)}
    if refers_to:
        return warc_record("revisit", rid, date, head, fields | {
            "WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": refers_to,
            "Content-Type": "application/http; msgtype=response"})
    if head:
        return warc_record("response", rid, date, arc.block,
                           fields | {"Content-Type": "application/http; msgtype=response"})
    kind = "response" if arc.url.startswith("dns:") else "resource"
    return warc_record(kind, rid, date, arc.block,
                       fields | {"Content-Type": "application/octet-stream" if arc.content_type in ("", "-")
                                 else arc.content_type})


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one WARC record; its digest and length are checked."""
    head, found, rest = data.partition(END)
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        fields[key.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
    block = rest[:int(fields["content-length"])]
    if digest(block) != fields["warc-block-digest"]:
        raise ValueError(f"wrong block digest: {fields.get('warc-record-id')}")
    return fields, block
