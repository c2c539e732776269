"""WARC derivatives: for each response, a metadata record and a plain-text conversion record that refer to it.

Both carry WARC-Refers-To (the response's record id), WARC-Refers-To-Target-URI and -Date, the source's HTTP status and
headers (the metadata record in its block, the conversion its content type), and digests: the source's payload digest, and the block
digest of the derivative. Record ids are name-based on the source's id, so reruns agree. Each row is derived by itself.

Null payloads count as empty; null uris become the empty one. Repeated rows give repeated records. Payloads are decoded as UTF-8,
bad bytes replaced. Very long payloads are read whole, in one pass. Empty tables give an empty result. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import small_batches, table

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:palimpsest:warc")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "title", "svg", "iframe", "textarea")}
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section select table tbody td tfoot th thead tr ul".split())
LANG = re.compile(r"\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SCHEMA = "key {key}, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, content_length long, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(10).join(names))}>"


def read(html: str) -> tuple[str, str, list[str], str]:
    """(title, language, links, visible text with a line for each block that has any) of a page, in one pass from tag to tag."""
    title, lang, links, out, at = None, None, [], [], 0
    while (start := html.find("<", at)) >= 0:
        mark = html[start + 1 : start + 2]
        m = NAME.match(html, start)
        if not m and mark not in ("!", "?"):
            out.append(html[at : start + 1].replace("\n", " "))
            at = start + 1
            continue
        out.append(html[at:start].replace("\n", " "))
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            out.append(" ")
            at = end + 3 if end >= 0 else len(html)
            continue
        end = html.find(">", start)
        if end < 0:  # no tag ends from here on
            at = start
            break
        at = end + 1
        if not m:
            out.append(" ")
            continue
        name, opens = m[1].lower(), mark != "/"
        if opens and name in RAW:
            stop = RAW[name].search(html, at)
            if name == "title" and title is None:
                title = html[at : stop.start() if stop else len(html)]
            at = stop.end() if stop else len(html)
            out.append(" ")
        elif name in BLOCK:
            out.append("\n")
        if opens and name == "a" and (x := HREF.search(html, m.end(), end)):
            links.append(x[1] or x[2] or x[3] or "")
        if opens and name == "html" and lang is None and (x := LANG.search(html, m.end(), end)):
            lang = x[1].lower()
    out.append(html[at:].replace("\n", " "))
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return title or "", lang or "", links, "\n".join(unescape(x) for x in lines if x)


def field(value: str) -> str:
    return " ".join(value.split())


def derive_one(source: str, uri: str, date: str, headers: str, payload: str) -> list[tuple]:
    """The two records of a response: (type, id, refers to, uri, date, content type, payload digest, block digest, length, block)."""
    own = digest(payload.encode("utf-8", "replace"))
    title, lang, links, text = read(payload)
    about = [("title", field(unescape(title))), ("language", lang), ("source-payload-digest", own), ("source-content-length", str(len(payload.encode("utf-8", "replace"))))]
    about += [("source-header", field(h)) for h in headers.split("\r\n") if h.strip()]
    about += [("outlink", field(unescape(x))) for x in links if x]
    out = []
    for kind, content, block in (("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in about if v)), ("conversion", "text/plain; charset=utf-8", text)):
        data = block.encode("utf-8", "replace")
        out.append((kind, record_id(source, kind), source, uri, date, content, own, digest(data), len(data), block))
    return out


def derive(responses: DataFrame) -> DataFrame:
    """(key, record_id, uri, date, headers, payload) of responses -> two records each, as columns of SCHEMA."""
    small_batches(responses.sparkSession)

    def build(batches):
        for batch in batches:
            keys, rows = [], []
            for key, *values in zip(*[batch.column(c).to_pylist() for c in ("key", "record_id", "uri", "date", "headers", "payload")], strict=True):
                for row in derive_one(*(v or "" for v in values)):
                    keys.append(key)
                    rows.append(row)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.string()] * 8 + [pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["key", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "content_length", "block"])

    rows = responses.select("key", *[F.col(c).cast("string").alias(c) for c in ("record_id", "uri", "date", "headers", "payload")])
    return rows.mapInArrow(build, SCHEMA.format(key=dict(rows.dtypes)["key"]))


def responses_of(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Pages as responses: ids from the key and url, HTTP headers of a plain 200 answer."""
    name = F.md5(F.concat_ws("\n", F.lit("response"), F.col(key).cast("string"), F.col(url)))
    dashed = F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce(F.col(html), F.lit(""))).cast("string"), F.lit("\r\n"))
    return pages.select(F.col(key).alias("key"), F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">")).alias("record_id"), F.col(url).alias("uri"), F.lit(date).alias("date"), head.alias("headers"), F.col(html).alias("payload"))


def serialized(records: DataFrame):
    """One column: each record as WARC text, but for the two line ends after it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    optional = lambda name, value: F.when(value.isNotNull() & (value != ""), line(name, F.regexp_replace(value, r"\s+", " "))).otherwise(F.lit(""))
    c = F.col
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", c("record_type")), line("WARC-Record-ID", c("record_id")), line("WARC-Date", c("date")), optional("WARC-Target-URI", c("target_uri")),
        optional("WARC-Refers-To", c("refers_to")), optional("WARC-Refers-To-Target-URI", c("target_uri")), optional("WARC-Refers-To-Date", c("date")), line("WARC-Block-Digest", c("block_digest")),
        optional("WARC-Source-Payload-Digest", c("payload_digest")), line("Content-Type", c("content_type")), line("Content-Length", c("content_length").cast("string")), F.lit("\r\n"), c("block"),
    )


def write_warc(records: DataFrame, path: str, compress: bool = True) -> None:
    """Records of derive() as WARC files, one a partition, through Spark's own writer."""
    out = records.select(serialized(records).alias("value")).write.option("lineSep", "\r\n\r\n")
    (out.option("compression", "gzip") if compress else out).text(path)


def parse_warc(data: bytes):
    """(header dict, block bytes) of each record."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        if head < 0:
            return
        fields = {}
        for x in data[at:head].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = x.partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields.get("content-length", 0))
        yield fields, data[head + 4 : head + 4 + length]
        at = head + 4 + length + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_type, record_id, refers_to, target_uri, headers map, block binary) of WARC files, gzipped or not; a file a task."""

    def read(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
                for fields, block in parse_warc(data):
                    yield pa.RecordBatch.from_arrays([*(pa.array([fields.get(k)], pa.string()) for k in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri")), pa.array([list(fields.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], ["record_type", "record_id", "refers_to", "target_uri", "headers", "block"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, "record_type string, record_id string, refers_to string, target_uri string, headers map<string,string>, block binary")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses_of(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")
