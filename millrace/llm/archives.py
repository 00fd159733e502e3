"""Legacy ARC archives of web pages, and their conversion to WARC."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from millrace.llm import arc_format as arc
from millrace.llm.common import file_system, new_file, new_folder, written

FETCH_DATE = "19990101000000"
ARC_FILES = "path string, n_records long"
RECORDS = ("path string, offset long, length long, fields string, record_id string, url string, "
           "page_id long, payload_digest string, payload_bytes long")


def write_arc(pages: DataFrame, version: int = 1, file_bytes: int = 1 << 26) -> DataFrame:
    """Write an ARC record per row of ``pages`` (page_id, url, html); return the files.

    The block is an HTTP response whose payload is the page in UTF-8 (null:
    empty) and whose header carries the page id, if there is one. Records are
    gzip members of their own. Tasks write the rows they read, in files of
    about ``file_bytes``; nothing is shuffled. Other columns are ignored.
    """
    folder = new_folder(pages.sparkSession, "arc")
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))

    def write(batches):
        part, out, uri, size, n = TaskContext.get().partitionId(), None, None, 0, 0
        for batch in batches:
            for page, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    uri, out = new_file(folder, f"legacy-{part:06d}", ".arc.gz")
                    size, n = out.write(arc.pack(arc.arc_header(uri.rpartition("/")[2], version))), 0
                own = "" if page is None else f"X-Page-Id: {page}\r\n"
                head = (f"HTTP/1.0 200 OK\r\n{own}Content-Type: text/html; charset=utf-8\r\n"
                        f"Content-Length: {len(html)}\r\n\r\n").encode()
                size += out.write(arc.pack(arc.arc_record(arc.ArcRecord(
                    url, "0.0.0.0", FETCH_DATE, "text/html", head + html), version)))
                n += 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield _batch([(uri, n)], ARC_FILES)
        if out is not None:
            out.close()
            yield _batch([(uri, n)], ARC_FILES)

    return written(source.mapInArrow(write, ARC_FILES), "arc-files")


_TYPES = {"string": pa.string(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)],
                                      names=[f for f, _ in fields])


def scan_arc(files: DataFrame) -> DataFrame:
    """One row per record of the ARC files in ``path``: place, field list, id, page id, payload digest."""
    n = _tasks(files)

    def scan(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = file_system(uri)
                fields, rows = None, []
                with fs.open_input_stream(path, compression=None) as source:
                    for offset, length, data in arc.Members(source):
                        record, fields = arc.parse_arc(data, fields)
                        head, payload = arc.split_http(record.block)
                        page = arc.http_field(head, "X-Page-Id")
                        known = page is not None and page.lstrip("-").isdigit()
                        info = record.url.startswith("filedesc://")
                        rows.append((
                            uri, offset, length, " ".join(fields),
                            arc.record_id(uri.rpartition("/")[2], offset, record.url, record.date),
                            record.url, int(page) if known else None,
                            None if info else arc.digest(payload), None if info else len(payload)))
                        if len(rows) == 5_000:
                            yield _batch(rows, RECORDS)
                            rows = []
                yield _batch(rows, RECORDS)

    return files.select("path").repartition(n).mapInArrow(scan, RECORDS)


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_originals(records: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Add ``original``: the record id of the response that a record revisits, else null.

    Of records with equal payloads of at least ``min_bytes`` the one with the
    largest page id is the response; ties fall to the record that stands last
    by (path, offset), and missing page ids rank lowest. Only the digests of
    repeated payloads are aggregated and joined, one row each.
    """
    large = F.col("payload_bytes") >= min_bytes
    best = records.where(large).groupBy("payload_digest").agg(
        F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("page"), "path", "offset", "record_id")
              ).alias("best"), F.count("*").alias("n")).where("n > 1").select(
        "payload_digest", F.col("best.record_id").alias("original"))
    joined = records.join(best, "payload_digest", "left")
    return joined.withColumn("original", F.when(large & (F.col("original") != F.col("record_id")),
                                                F.col("original")))


def convert_arc(files: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Convert ARC files to WARC files, one for one, and return the WARC files (path, n_records).

    Two reads of the archives: the first takes the digest of every payload, the
    second copies. Payloads are never shuffled: only each record's place and
    what it revisits goes to the task that converts its file.
    """
    spark = files.sparkSession
    folder = new_folder(spark, "warc")
    plan = with_originals(written(scan_arc(files), "arc-records"), min_bytes)
    placed = plan.select("path", "offset", "length", "fields", "record_id", "original").repartition(
        _tasks(files), "path").sortWithinPartitions("path", "offset")

    def convert(batches):
        current = source = out = uri = None
        n = 0
        for batch in batches:
            for path, offset, length, fields, rid, original in zip(*(c.to_pylist() for c in batch.columns)):
                if path != current:
                    if out is not None:
                        out.close()
                        yield _batch([(uri, n)], ARC_FILES)
                    fs, at = file_system(path)
                    source, current, n = fs.open_input_file(at), path, 0
                    stem = path.rpartition("/")[2].removesuffix(".arc.gz")
                    uri, out = new_file(folder, stem, ".warc.gz")
                data = arc.zlib.decompress(source.read_at(length, offset), 31)
                record, _ = arc.parse_arc(data, tuple(fields.split()))
                out.write(arc.pack(arc.convert(record, rid, original)))
                n += 1
        if out is not None:
            out.close()
            yield _batch([(uri, n)], ARC_FILES)

    return written(placed.mapInArrow(convert, ARC_FILES), "warc-files")


WARC_ROWS = ("record_id string, record_type string, uri string, page_id long, payload_bytes long, "
             "payload_digest string, refers_to_id string")


def read_warc(files: DataFrame, check_payload: bool = True) -> DataFrame:
    """Read WARC files back, a row per response, resource or revisit record.

    ``payload_bytes`` and ``payload_digest`` are those of the
    full payload; for a revisit they come from its kept HTTP header and its
    digest field. The digest is given as bare lower-case hex. ``check_payload`` compares stored payloads with their digest.
    """
    def read(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = file_system(uri)
                rows = []
                with fs.open_input_stream(path, compression=None) as source:
                    for _, _, data in arc.Members(source):
                        fields, block = arc.parse_warc(data)
                        if fields["warc-type"] == "warcinfo":
                            continue
                        head, payload = arc.split_http(block)
                        size = len(payload)
                        if fields["warc-type"] == "revisit":
                            size = int(arc.http_field(head, "Content-Length") or 0)
                        elif check_payload and arc.digest(payload) != fields["warc-payload-digest"]:
                            raise ValueError(f"wrong payload digest: {fields['warc-record-id']}")
                        page = arc.http_field(head, "X-Page-Id")
                        rows.append((fields["warc-record-id"], fields["warc-type"], fields["warc-target-uri"],
                                     None if page is None else int(page), size,
                                     arc.hex_digest(fields["warc-payload-digest"]), fields.get("warc-refers-to")))
                        if len(rows) == 5_000:
                            yield _batch(rows, WARC_ROWS)
                            rows = []
                yield _batch(rows, WARC_ROWS)

    return files.select("path").repartition(_tasks(files)).mapInArrow(read, WARC_ROWS)


def page_records(records: DataFrame) -> DataFrame:
    """Per page: payload size, hex digest, record type and the page id that a revisit refers to.

    The planner knows the records only by the size of their file list, so the
    join is told not to broadcast them.
    """
    targets = records.where("record_type <> 'revisit'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).hint("merge")
    asked = records.where("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    plain = records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long"))
    both = asked.select(*plain.columns).unionByName(plain)
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
