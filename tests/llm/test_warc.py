import base64
import hashlib
import time
from html.parser import HTMLParser

import pytest

from palimpsest.llm.warc import derive, op6_warc, parse_warc, read, read_warc, responses_of, serialized, write_warc

HTML = '<html lang="EN"><head><title>A &amp; B</title><script>x("<p>")</script></head><body><p>One&nbsp;two<br>three</p><a href="/x?a=1&amp;b">go</a> <a href=\'y\'>é</a><!-- no --></body></html>'


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain(html):
    return read(html)[3]


class Brute(HTMLParser):
    """Visible text by the standard library's parser, a line for each block."""

    BLOCKS = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead tr ul".split())
    GONE = set("script style noscript template title svg iframe textarea".split())

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.out, self.inside = "", 0
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag in self.GONE
        self.out += "\n" if tag in self.BLOCKS and not self.inside else ""

    def handle_endtag(self, tag):
        self.inside -= tag in self.GONE
        self.out += "\n" if tag in self.BLOCKS and not self.inside else ""

    def handle_data(self, data):
        self.out += data.replace("\n", " ") if not self.inside else " "


@pytest.mark.parametrize("text", ["<a " * 350_000, "<a" * 500_000 + ">", "<title" * 150_000, "<script>" * 120_000, "<!--" * 250_000, "<" * 1_000_000, "<a href=" * 120_000 + ">", "</script " * 100_000, "<p>" * 300_000], ids=lambda t: t[:8])
def test_linear(text):
    began = time.perf_counter()
    read(text)
    assert time.perf_counter() - began < 10


def test_plain():
    assert plain(HTML) == "One\xa0two\nthree\ngo é" and plain("") == "" and plain("a < b") == "a < b"


def test_records(spark):
    rows = [(1, "<urn:uuid:1>", "http://h/é", "2024-01-02T03:04:05Z", "HTTP/1.1 200 OK\r\nX-A: b  c\r\n", HTML, "no"), (2, None, None, None, None, None, "no"), (1, "<urn:uuid:1>", "http://h/é", "2024-01-02T03:04:05Z", "HTTP/1.1 200 OK\r\nX-A: b  c\r\n", HTML, "no")]
    got = derive(spark.createDataFrame(rows, "key long, record_id string, uri string, date string, headers string, payload string, block string")).collect()
    assert len(got) == 6 and sorted(r.key for r in got) == [1, 1, 1, 1, 2, 2]
    by = {(r.key, r.record_type): r for r in got}
    meta, text = by[1, "metadata"], by[1, "conversion"]
    assert meta.refers_to == text.refers_to == "<urn:uuid:1>" and meta.record_id != text.record_id and meta.target_uri == "http://h/é" and meta.date == text.date == "2024-01-02T03:04:05Z"
    assert meta.payload_digest == text.payload_digest == sha1(HTML.encode()) and all(r.block_digest == sha1(r.block.encode()) and r.content_length == len(r.block.encode()) for r in got)
    assert text.block == plain(HTML) and meta.block.split("\r\n")[:-1] == [
        "title: A & B", "language: en", f"source-payload-digest: {sha1(HTML.encode())}", f"source-content-length: {len(HTML.encode())}", "source-header: HTTP/1.1 200 OK", "source-header: X-A: b c", "outlink: /x?a=1&b", "outlink: y",
    ]
    assert by[2, "conversion"].block == "" and by[2, "conversion"].refers_to == "" and by[2, "metadata"].payload_digest == sha1(b"")


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", HTML * i) for i in range(1, 8)], "page_id long, url string, html string")
    records = derive(responses_of(pages))
    for name, compress in (("a", False), ("b", True)):
        write_warc(records, f"file://{tmp_path}/{name}", compress)
        got = {(r.record_id, r.record_type, r.refers_to, r.target_uri, bytes(r.block)) for r in read_warc(spark, f"file://{tmp_path}/{name}").collect()}
        assert got == {(r.record_id, r.record_type, r.refers_to, r.target_uri, r.block.encode()) for r in records.collect()}
    one = records.where("record_type = 'conversion'").select(serialized(records)).first()[0].encode() + b"\r\n\r\n"
    fields, block = next(parse_warc(one))
    assert fields["warc-block-digest"] == sha1(block) and fields["warc-refers-to"].startswith("<urn:uuid:") and fields["warc-refers-to-target-uri"] == fields["warc-target-uri"] and int(fields["content-length"]) == len(block)


def test_whole_table(spark, sf):
    got = op6_warc(spark, sf)
    rows = got.collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    assert {(r.page_id, r.record_type) for r in rows} == {(i, k) for i in pages for k in ("metadata", "conversion")}
    for r in rows:
        assert r.payload_digest == sha1((pages[r.page_id].html or "").encode()) and r.block_digest == sha1(r.block.encode())
        if r.record_type == "conversion":
            words = [" ".join(x.split()) for x in Brute(pages[r.page_id].html or "").out.split("\n")]
            assert [" ".join(x.split()) for x in r.block.split("\n")] == [x for x in words if x]
    assert sorted(r.record_id for r in op6_warc(spark, sf).collect()) == sorted(r.record_id for r in rows)
    assert derive(responses_of(spark.read.parquet(f"{sf}/pages.parquet").limit(0))).collect() == []
