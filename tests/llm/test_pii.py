"""Base kinds against the documented expressions, and the method's own kinds."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm.pii import automaton, find, iban_at, luhn, masked, op4_pii, redacted, with_spans

AC = automaton()
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(s):
    return re.sub("[^0-9]", "", s)


def passes(kind, s):
    d = digits(s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def brute(text):
    spans = [(m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return sorted(spans)


PIECES = ["a@b.c", "@", "x.y+z%w@d-e.f.g", "..", ".", "+", "1.2.3.4", "256.1.1.1", "001.2.3.255.9", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111", "+49 (30) 1234-5678", "+1 2", "+12345678901", "5", " ", "é", "😀", "-", "@@", "a@b", "K@x.y", "İ@a.b"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text("abz@.+-19 (", max_size=8)), max_size=14).map("".join))
def test_base_spans(text):
    assert [x for x in find(text, AC) if x[1] < 4] == brute(text)


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("see https://a.example/x?y=1, now", "url", "https://a.example/x?y=1"),
        ("WWW.Example.org.", "url", "WWW.Example.org"),
        ("IBAN DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
        ("to DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "iban", "DE89 3704 0044 0532 0130 00"),
        ("account \t  number :  12345678-9ab", "account", "12345678"),
        ("account no: 12345678 closed", "account", "12345678"),
        ("SSN 123-45-6789", "account", "123-45-6789"),
        ("api_key = 'abcdefghij0123456789'", "secret", "abcdefghij0123456789"),
    ],
)
def test_own_kinds(text, kind, value):
    assert value in [text[s:e] for s, _, k, e in find(text, AC) if k == kind]


def brute_ibans(text):
    """By trying every end of every start."""
    out, last = [], 0
    for i in range(len(text)):
        for j in range(len(text), i, -1):
            plain = text[i:j].replace(" ", "")
            shaped = re.fullmatch(r"[A-Z]{2}[0-9]{2}([A-Z0-9]{11,30}|( [A-Z0-9]{1,4}){3,8})", text[i:j])
            if i >= last and shaped and not text[j : j + 1].isalnum() and not text[max(0, i - 1) : i].isalnum() and 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
                out.append(text[i:j])
                last = j
                break
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", " ", "BIC", "A", "x", "12", ",", "DE89", "FR14 2004 1010 0505 0001 3M02 606"]), max_size=6).map("".join))
def test_ibans(text):
    assert [text[s:e] for s, _, k, e in find(text, AC) if k == "iban"] == brute_ibans(text)


MEGABYTE = ["account" + " " * 1_000_000 + "!", "1" * 1_000_000, "1." * 500_000, "1 " * 500_000, "+" * 1_000_000, "+1 " * 300_000, "@" * 1_000_000, "a@b." * 250_000, "www." * 250_000, "token" + " " * 1_000_000, "token:" * 160_000, "account no " * 90_000, "DE89 " * 200_000, "A" * 1_000_000, "account " + "1 " * 500_000, "+1" + "(" * 1_000_000]


@pytest.mark.parametrize("text", MEGABYTE, ids=lambda t: t[:12])
def test_linear(text):
    began = time.perf_counter()
    spans = find(text, AC)
    assert time.perf_counter() - began < 10
    if len(spans) < 10:
        assert [x for x in spans if x[1] < 4] == []


def test_checks():
    assert luhn("4111111111111111") and not luhn("4111111111111112") and iban_at("GB82WEST12345698765432", 0) == 22 and not iban_at("GB82WEST12345698765433", 0)


def test_mask():
    text = "a b@c.d e +49 30 12345678"
    assert masked(text, find(text, AC)) == "a <EMAIL> e <PHONE>" and masked(None, []) is None and masked("", []) == ""


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op4_pii(spark, sf).collect()
    assert len(rows) == len(docs) and any(r.n_email for r in rows)
    for r in rows:
        spans = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[2] == k for x in spans) for k in PATTERNS]
        said = [f"{k}:{s}:{e}" for s, _, k, e in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r.spans.split(","))


def test_edges(spark):
    long = "x " * 300_000 + "a@b.cd"
    rows = [(1, None, "s"), (2, "", "s"), (3, "a@b.cd", None), (3, "a@b.cd", None), (None, long, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = with_spans(docs).collect()
    assert sorted((r.doc_id or 0, r.spans or "", [tuple(x) for x in r._spans]) for r in out) == [(0, "s", [("email", 600_000, 600_006)]), (1, "s", []), (2, "s", []), (3, "", [("email", 0, 6)]), (3, "", [("email", 0, 6)])]
    assert sorted((r.doc_id or 0, (r.text or "")[-7:]) for r in redacted(docs).collect()) == [(0, "<EMAIL>"), (1, ""), (2, ""), (3, "<EMAIL>"), (3, "<EMAIL>")]
    assert with_spans(docs.limit(0)).collect() == [] and redacted(docs.limit(0)).collect() == []
