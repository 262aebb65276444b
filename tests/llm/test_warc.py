import base64
import gzip
import hashlib

import pytest

from codesieve.llm import warc
from codesieve.llm.common import new_folder
from codesieve.llm.queries import LLM_QUERIES
from llm.conftest import SF


def plain(pages, least=0):
    first, taken = {}, set()
    for i, html in pages:
        old = first.get(html or "")
        first[html or ""] = i if old is None else old if i is None else min(old, i)
    out = []
    for i, html in pages:
        text = html or ""
        raw = text.encode()
        # One of the records with the smallest page id is the response.
        stays = len(raw) < least or first[text] == i and text not in taken
        if stays:
            taken.add(text)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                    "response" if stays else "revisit", None if stays else first[text]))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in df.collect()), key=str)


def test_query(spark):
    pages = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert found(LLM_QUERIES["op6_warc"](spark, SF)) == plain(pages)


ROWS = [(3, "u", "same"), (1, "u v\n", "same"), (2, None, "same"), (4, "é", None), (5, "x", ""), (6, "x", "\r\n\r\nWARC/1.1\r\n"),
        (7, "x", "a\n\nhttp://x 0 0 0 5\n"), (8, "x", "é🙂" * 50_000), (None, "x", "same"), (9, "x", "q"), (9, "x", "q"),
        (None, "x", "none"), (None, "x", "none")]


@pytest.mark.parametrize("least", [0, 3])
def test_odd_rows(spark, least):
    pages = spark.createDataFrame([(*r, "c") for r in ROWS], "page_id long, url string, html string, digest string")
    assert found(warc.convert_pages(pages, least)) == plain([(r[0], r[2]) for r in ROWS], least)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.convert_pages(pages).count() == 0


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_many_files(spark, monkeypatch, broadcast):
    """Files of a few records each, and both ways to look up shared payloads."""
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rows = [(i, f"http://x/{i}", "y" * (i % 17 * 20)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    assert found(warc.convert_pages(pages)) == plain([(r[0], r[2]) for r in rows])


def test_arc_versions(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    pages = spark.createDataFrame([(i, "http://a/b c", f"<p>{i}") for i in range(40)], "page_id long, url string, html string")
    folder = new_folder(spark, "arc")
    warc.write_arc(pages, folder)
    rows = warc.read_arc(spark, folder).collect()
    assert {(r["page_id"], r["url"], r["payload"]) for r in rows} == {(i, "http://a/b%20c", f"<p>{i}".encode()) for i in range(40)}
    assert {r["status"] for r in rows} == {None, "200"}  # version 1 has no result code


def test_parse_by_hand():
    one = (b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain 69\n1 0 me\nURL IP-address Archive-date Content-type "
           b"Archive-length\n\n\nhttp://x/ 1.2.3.4 20010203040507 text/html 9\nline\nend\n\n")
    one = one.replace(b" 69\n", b" %d\n" % len(b"1 0 me\nURL IP-address Archive-date Content-type Archive-length\n\n"))
    records = list(warc.parse_arc(one))
    assert records[1].fields["IP-address"] == "1.2.3.4" and records[1].content == b"line\nend\n"
    assert warc._warc_date("20010203040507") == "2001-02-03T04:05:07Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(one[:-6]))


def test_foreign_records(spark, tmp_path):
    """Bytes of any encoding, a picture, an answer of DNS and a response without a page id or length."""
    gif, latin = b"GIF89a\x00\xff\xfe\r\n\r\n\x80", "caf\xe9".encode("latin-1")
    http = b"HTTP/1.0 200 OK\r\nX-Name: \xe9\r\n\r\n"
    records = [("http://x/a.gif", "image/gif", http + gif), ("http://x/\xe9", "text/html", http + latin),
               ("dns:x.org", "text/dns", b"20010203040506\nx.org. 1 IN A 1.2.3.4\n"),
               ("ftp://x/readme", "text/plain", b"plain\xff"), ("http://x/b", "text/html", http + latin)]
    intro = b"1 0 me\nURL IP-address Archive-date Content-type Archive-length\n"
    data = b"filedesc://a.arc 0.0.0.0 20010203040506 text/plain %d\n%s\n" % (len(intro), intro)
    for url, mime, body in records:
        data += f"{url} 1.2.3.4 20010203040506 {mime} {len(body)}\n".encode("latin-1") + body + b"\n"
    arc = tmp_path / "arc"
    arc.mkdir()
    (arc / "a.arc.gz").write_bytes(gzip.compress(data))
    folder = new_folder(spark, "warc")
    warc.arc_to_warc(spark, str(arc), folder)
    rows = {r["url"]: r for r in warc.read_warc(spark, folder).collect()}
    digest = lambda raw: base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert {u: (r["record_type"], r["payload_bytes"], r["payload_digest"]) for u, r in rows.items()} == {
        "http://x/a.gif": ("response", len(gif), digest(gif)), "http://x/\xe9": ("response", 4, digest(latin)),
        "dns:x.org": ("response", len(records[2][2]), digest(records[2][2])),
        "ftp://x/readme": ("resource", 6, digest(b"plain\xff")), "http://x/b": ("revisit", 4, digest(latin))}
    assert rows["http://x/b"]["refers_to_record"] == rows["http://x/\xe9"]["record_id"]
    assert len({r["record_id"] for r in rows.values()}) == 5


def test_files_are_cut_by_bytes(spark, monkeypatch):
    """A run of long pages makes many files, none much over the limit."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, "u", "z" * (30 if i < 900 else 15_000)) for i in range(1000)]
    folder = new_folder(spark, "arc")
    warc.write_arc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content").collect()
    sizes = [len(gzip.decompress(f["content"])) for f in files]
    assert len(sizes) > 50 and max(sizes) < 37_000 and warc.read_arc(spark, folder).count() == 1000
