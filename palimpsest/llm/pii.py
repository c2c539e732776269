"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, URL schemes, plus signs and cue words of accounts and
secrets; where the text has digits, one linear scan finds the runs of digits, which are the anchors of ip, card and iban. From
each anchor a deterministic parser reads outward to the boundaries of the item and validates it. Parsers never read back what
they have taken, and what one anchor's parser reads ends before the next anchor of its kind, so time is linear in the text
whatever it holds: very long texts, of one character or one cue too, are scanned whole.

Base kinds (email, ip, card, phone) equal a leftmost, non-overlapping scan with the documented expressions; a span that
fails its check is dropped without a retry inside it. Kinds of the method's own, which never remove base spans:
  url      after http://, https://, ftp:// or www.: up to white space, quotes or brackets, less final punctuation
  iban     two capitals, two check digits and 11 to 30 more, in groups of at most four or not, with a valid remainder modulo
           97; of groups the most with which it holds
  account  an identifier of 6 to 34 letters and digits with 5 digits or more after a cue (account, acct, konto, ssn,
           passport, ...), or a national number ddd-dd-dddd after one
  secret   a value of 16 or more unbroken characters after token, secret, password, api key, ... and : or =
Offsets are code points, the end exclusive. Null texts count as empty. Ties: by start, then in the order of KINDS. Repeated rows
are scanned each for itself; empty tables give an empty result; other columns pass untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .runtime import fresh, small_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account", "secret")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = re.compile("[0-9]+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"(?:https?://|ftp://|www\.)[^\s<>\"'`{}|\\^\[\]]+", re.I)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{1,4}+(?![A-Za-z0-9])){3,8}+)(?![A-Za-z0-9])")
ACCOUNT = re.compile(r"\s*+(?:no\.?|number|num|nr\.?|id|#)?+\s*+[:=#]?+\s*+([A-Za-z0-9]++(?:[ -][0-9]++)*)(?![A-Za-z0-9])", re.I)
SECRET = re.compile(r"\s*+[:=]\s*+[\"']?+([A-Za-z0-9+/_.=-]{16,}+)")
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta", "passport", "ssn", "social security", "routing", "iban", "tax id", "nif", "dni")
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access_key", "access key", "bearer")


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("@", 1))
    a.add_word("+", ("+", 1))
    for x in ("http://", "https://", "ftp://", "www."):
        a.add_word(x, ("url", len(x)))
    for x in ACCOUNT_CUES:
        a.add_word(x, ("account", len(x)))
    for x in SECRET_CUES:
        a.add_word(x, ("secret", len(x)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """Lower case with offsets kept: where a letter would become two, of A-Z alone."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOW)


_LOW = {c: c + 32 for c in range(65, 91)}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


VALUES = {ord(c): str(int(c, 36)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def iban_at(text: str, start: int) -> int:
    """The end of a valid IBAN at start, or 0: of one in groups the most groups that are valid."""
    m = IBAN.match(text, start)
    if not m:
        return 0
    head, *groups = m[0].split(" ")
    head, groups = (head[:4], [head[4:], *groups]) if len(head) > 4 else (head, groups)
    rest, size, at, last, end = 0, 4, start + 4, head.translate(VALUES), 0
    for group in groups:
        rest = int(f"{rest}{group.translate(VALUES)}") % 97
        size, at = size + len(group), at + len(group) + (m[0][4:5] == " ")
        if 15 <= size <= 34 and int(f"{rest}{last}") % 97 == 1:
            end = at
    return end


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def find(text: str | None, ac: ahocorasick.Automaton) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of every span, in order."""
    if not text:
        return []
    out = []

    def add(kind: str, start: int, end: int) -> None:
        out.append((start, KINDS.index(kind), kind, end))

    done = {k: 0 for k in KINDS}
    low = lowered(text)
    for at, (what, length) in ac.iter(low):
        start = at - length + 1
        if what == "@":
            if start < done["email"]:
                continue
            m = DOMAIN.match(text, start)
            if m:
                left = start
                while left > done["email"] and text[left - 1] in LOCAL:
                    left -= 1
                if left < start:
                    add("email", left, m.end())
                    done["email"] = m.end()
        elif what == "+":
            if start < done["phone"]:
                continue
            m = PHONE.match(text, start)
            if m:
                done["phone"] = m.end()
                if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    add("phone", start, m.end())
        elif what == "url":
            if start >= done["url"] and (m := URL.match(text, start)):
                end = start + len(m[0].rstrip(".,;:!?)*&%$#"))
                if end > at + 1:
                    add("url", start, end)
                    done["url"] = end
        elif start and low[start - 1].isalnum() or low[at + 1 : at + 2].isalnum():
            continue
        elif what == "account":
            if start >= done["account"] and (m := ACCOUNT.match(text, at + 1)):
                bare = m[1].replace(" ", "").replace("-", "")
                if 6 <= len(bare) <= 34 and sum(c.isdigit() for c in bare) >= 5:
                    add("account", m.start(1), m.end(1))
                    done["account"] = m.end(1)
        elif start >= done["secret"] and (m := SECRET.match(text, at + 1)):
            add("secret", m.start(1), m.end(1))
            done["secret"] = m.end(1)
    for run in DIGITS.finditer(text):
        start, end = run.span()
        if start >= done["ip"] and text[end : end + 1] == "." and (m := IP.match(text, start)):
            done["ip"] = m.end()
            if all(map(small, m[0].split("."))):
                add("ip", start, m.end())
        if start >= done["card"] and (m := CARD.match(text, start)):
            done["card"] = m.end()
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - start >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                add("card", start, m.end())
        if start - 2 >= done["iban"] and text[start - 2 : start].isupper() and not text[max(0, start - 3) : start - 2].isalnum() and (stop := iban_at(text, start - 2)):
            add("iban", start - 2, stop)
            done["iban"] = stop
    return sorted(out)


SPAN = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column spans (prefixed by _ where docs has one): structs of kind, start, end."""
    small_batches(docs.sparkSession)
    (name,) = fresh(docs, "spans")

    def scan(batches):
        ac = automaton()
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for s, _, k, e in find(t, ac)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, SPAN_ARROW)], [*batch.schema.names, name])

    return docs.mapInArrow(scan, StructType([*docs.schema.fields, StructField(name, SPAN)]))


def masked(text: str | None, spans: list[tuple[int, int, str, int]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not spans or text is None:
        return text
    out, at, end = [], 0, -1
    for start, _, kind, stop in spans:
        if start >= end:
            out += [text[at:start], f"<{kind.upper()}>"]
            end = stop
        end = max(end, stop)
        at = end
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, same columns, with the personal data in the text masked."""
    small_batches(docs.sparkSession)

    def mask(batches):
        ac = automaton()
        for batch in batches:
            i = batch.schema.get_field_index(text)
            clean = pa.array([masked(t, find(t, ac)) for t in batch.column(i).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:i], clean, *batch.columns[i + 1 :]], batch.schema.names)

    return docs.mapInArrow(mask, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    small_batches(spark)

    def digest(batches):
        ac = automaton()
        for batch in batches:
            counts: dict[str, list[int]] = {k: [] for k in BASE}
            sha, every = [], []
            for t in batch.column("text").to_pylist():
                spans = find(t, ac)
                base = [x for x in spans if x[1] < len(BASE)]
                for k in BASE:
                    counts[k].append(sum(x[2] == k for x in base))
                said = [",".join(f"{k}:{s}:{e}" for s, _, k, e in part) for part in (base, spans)]
                sha.append(hashlib.sha256(said[0].encode()).hexdigest())
                every.append(said[1])
            arrays = [batch.column("doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(sha, pa.string()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(digest, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
