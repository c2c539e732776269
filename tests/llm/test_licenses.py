import re

import pytest

from palimpsest.llm.license_rules import STEMS, rules
from palimpsest.llm.licenses import PHRASES, op8_licenses, scan


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def base(words):
    places = {lab: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, lab in PHRASES}
    every = sorted(sum(places.values(), []))
    return len(every), (every or [None])[0], (every or [None])[-1], {lab for lab, x in places.items() if x}


def brute(text):
    """All matches of all rules, less those within another of at least their priority."""
    norm = " " + " ".join(words_of(text)) + " "
    found = []
    for order, (label, priority, _, expression) in enumerate(rules()):
        for m in re.finditer(f"(?<= )(?:{expression})(?= )", norm):
            found.append((m.start(), -m.end(), -priority, order, label))
    kept = []
    for d in sorted(found):
        if not any(k[0] <= d[0] and -k[1] >= -d[1] and -k[2] >= -d[2] for k in kept):
            kept.append(d)
    return {k[4] for k in kept}, max((-k[2] for k in kept), default=0)


def check(rows, texts):
    for r in rows:
        words = words_of(texts[r.doc_id])
        n, first, last, labels = base(words)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), n, first, last, ",".join(sorted(labels)))
        own, top = brute(texts[r.doc_id])
        assert r.labels == ",".join(sorted(labels | own)) and r.score == max(top, 2 * bool(labels)) / 4


def test_rules_are_gated():
    assert len(rules()) > 250
    for label, priority, keyword, expression in rules():
        assert label and 1 <= priority <= 4 and any(s in keyword for s in STEMS), keyword
        re.compile(expression)


TEXTS = [
    "Licensed under the MIT License.", "MIT-license MIT LICENSE mit license", "the Apache License, Version 2.0 (the License)", "GNU General Public License as published by the Free Software Foundation; either version 3",
    "GNU Lesser General Public License v2.1 and the GNU Affero General Public License", "BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted", "xmit license apache licenses",
    "SPDX-License-Identifier: CC-BY-SA-4.0", "general public general public license license", "É mit license É", None, "", "---", "mit license " * 3000, "a Kelvin K mit\x0blicense", "İmit license", "creative commons attribution noncommercial sharealike 4.0 international license",
]


def test_texts(spark):
    texts = dict(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts.items()], "doc_id long, text string, n_words int, norm string")
    out = scan(docs)
    assert out.columns[:5] == ["doc_id", "text", "n_words", "norm", "_n_words"]
    rows = out.drop("n_words").withColumnRenamed("_n_words", "n_words").collect()
    assert len(rows) == len(TEXTS)
    check(rows, texts)
    assert "mit" in rows[0].labels and "lgpl-2.1" in rows[4].labels.split(",") and "bsd-3-clause" in rows[5].labels.split(",") and rows[6].labels == ""
    assert scan(docs.limit(0)).collect() == []


def test_very_many_detections(spark):
    """More than one run of matches, and text before and after them."""
    texts = {0: "x " * 50_000 + "mit license " * 1500 + "apache license version 2.0 " * 300 + "y"}
    check(scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect(), texts)


@pytest.mark.parametrize("rule", rules()[::9])
def test_keywords_are_in_every_match(rule):
    label, priority, keyword, expression = rule
    plain = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", expression))
    plain = re.sub(r"\[(.)[^\]]*\]", r"\1", re.sub(r"(.)\?", r"\1", plain))
    assert keyword in plain or not re.fullmatch(expression, plain)


def test_whole_table(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = op8_licenses(spark, sf).collect()
    assert len(rows) == len(texts) and any(r.n_base for r in rows)
    check(rows, texts)
