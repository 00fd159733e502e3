import gzip
import hashlib
import io

import duckdb
import pytest

from millrace.llm import arc_format as arc, archives as op, queries
from millrace.llm.common import new_file, new_folder


def brute(pages):
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in pages.select("page_id", "html").collect()]
    best = {}
    for page, html in rows:
        if len(html) >= 1000:
            best[html] = max(best.get(html, page), page)
    return sorted((p, len(h), hashlib.sha1(h).hexdigest(),
                   "revisit" if h in best and best[h] != p else "response",
                   best[h] if h in best and best[h] != p else None) for p, h in rows)


@pytest.fixture(scope="module")
def odd_pages(spark):
    big, other = "<p>ä</p>" * 200, "\r\n\r\nHTTP/1.1\n\n" * 100
    rows = [(1, "http://a.org/x y", big), (2, None, big), (3, "http://b.org/", None), (4, "", ""),
            (5, "http://c.org/\n", other), (9, "http://c.org/", other), (6, "u", "short"), (7, "u", "short"),
            (8, "http://d.org/", big), (10, "http://é.org/", "WARC/1.0\r\n" * 5)]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows],
                                 "page_id long, url string, html string, path string, offset int")


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip_matches_brute_force(spark, sf_dir, odd_pages, version):
    for pages in (spark.read.parquet(f"{sf_dir}/pages.parquet"), odd_pages):
        warc = op.convert_arc(op.write_arc(pages, version, file_bytes=50_000))
        assert sorted(map(tuple, op.page_records(op.read_warc(warc)).collect())) == brute(pages)


def test_ties_and_missing_ids(spark):
    big = "x" * 2000
    pages = spark.createDataFrame([(5, "u", big), (5, "u", big), (None, "u", big), (None, "v", None)],
                                  "page_id long, url string, html string")
    got = op.page_records(op.read_warc(op.convert_arc(op.write_arc(pages)))).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in got) == [
        ("5", "response", "None"), ("5", "revisit", "5"), ("None", "response", "None"), ("None", "revisit", "5")]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert op.page_records(op.read_warc(op.convert_arc(op.write_arc(pages)))).collect() == []


def test_hand_written_archives(spark):
    folder = new_folder(spark, "hand")
    dns, page = b"19960923142103\nexample.org. 300 IN A 192.0.2.1\n", b"HTTP/1.0 200 OK\nServer: x\n\n<html>hi</html>"
    text = (b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Someone\n"
            b"URL IP-address Archive-date Content-type Archive-length\n\n" + b"\n")
    body = text.partition(b"\n")[2].rstrip(b"\n") + b"\n"
    text = b"filedesc://old.arc 0.0.0.0 19960923142103 text/plain %d\n" % len(body) + body + b"\n"
    uri, out = new_file(folder, "old", ".arc.gz")
    for member in (text, b"dns:example.org 192.0.2.9 19960923142103 text/dns %d\n%s\n" % (len(dns), dns),
                   b"http://example.org/a b 192.0.2.1 199609 text/html %d\n%s\n" % (len(page), page),
                   b"ftp://example.org/f 192.0.2.1 x - 3\nabc\n"):
        out.write(gzip.compress(member))
    out.close()
    files = spark.createDataFrame([(uri, 3)], op.ARC_FILES)
    warc = op.convert_arc(files).collect()
    fs, path = op.file_system(warc[0]["path"])
    data = [arc.parse_warc(d) for _, _, d in arc.Members(fs.open_input_stream(path, compression=None))]
    kinds = [(f["warc-type"], f["content-type"], f["warc-date"], f.get("warc-target-uri"), b) for f, b in data]
    assert kinds[0][0] == "warcinfo"
    assert kinds[1:] == [
        ("response", "text/dns", "1996-09-23T14:21:03Z", "dns:example.org", dns),
        ("response", "application/http; msgtype=response", "1996-09-01T00:00:00Z", "http://example.org/a b", page),
        ("resource", "application/octet-stream", "1970-01-01T00:00:00Z", "ftp://example.org/f", b"abc")]
    assert arc.hex_digest(data[2][0]["warc-payload-digest"]) == hashlib.sha1(b"<html>hi</html>").hexdigest()


def test_bad_records_are_errors():
    head = (1, arc.ARC_FIELDS[1])[1]
    with pytest.raises(ValueError):
        arc.parse_arc(b"http://a/ 1.1.1.1 19990101000000 text/html 10\nabc\n", head)
    with pytest.raises(ValueError):
        arc.parse_arc(b"http://a/ 1.1.1.1 19990101000000 text/html 3\nabc\n", None)
    with pytest.raises(ValueError):
        list(arc.Members(io.BytesIO(gzip.compress(b"x" * 100)[:-4])))


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    got = con.execute(queries.SQL["op4_arc_to_warc"])
    names = [d[0] for d in got.description]
    mine = queries.op4_arc_to_warc(spark, sf_dir).select(*names).collect()
    assert sorted(got.fetchall()) == sorted(map(tuple, mine))
