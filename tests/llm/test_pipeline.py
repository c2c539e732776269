"""The stages against plain Python, each on its own input, and the whole run."""

from collections import Counter, defaultdict

import corpus_pipeline as P
from palimpsest.llm.decontaminate import COVERAGE
from palimpsest.llm.pii import automaton, find, masked

from .brute import classes
from .test_decontaminate import covered, words_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return Counter(tuple(r) for r in df.select(*COLUMNS).collect())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language id", "near-dedup", "decontamination", "pii", "mix"] and docs.columns == COLUMNS
    now, out = docs, []
    for _, stage in P.STAGES:
        now = P.materialize(stage(spark, now, sf))
        out.append(now)
    # Language: what has letters stays.
    kept = rows_of(out[0])
    assert not kept - rows_of(docs) and all(not any(c.isalpha() for c in r[1] or "") for r in rows_of(docs) - kept)
    # Near duplicates: the first of each class.
    by = {r[0]: r for r in kept}
    c = classes([(i, r[1]) for i, r in by.items()])
    assert rows_of(out[1]) == Counter(by[i] for i in by if c[i] == i)
    # Decontamination.
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = defaultdict(set)
    for n, t in enumerate(items):
        w = words_of(t)
        for x in range(len(w) - 4):
            grams[tuple(w[x : x + 5])].add(n)

    def leaks(text):
        w = words_of(text)
        near = set().union(*(grams.get(tuple(w[x : x + 5]), ()) for x in range(len(w) - 4)))
        return any(covered(text, items[n])[1] / len(words_of(items[n])) >= COVERAGE for n in near)

    expected = Counter(r for r in rows_of(out[1]) if not leaks(r[1]))
    assert rows_of(out[2]) == expected and len(expected) < len(rows_of(out[1]))
    # Personal data.
    ac = automaton()
    clean = [(i, masked(t, find(t, ac)), la, s) for i, t, la, s, _ in expected]
    assert rows_of(out[3]) == Counter((i, t, la, s, len(t)) for i, t, la, s in clean)
    # Mix: copies of whole documents, twice at most.
    mixed = out[4]
    assert mixed.columns == [*COLUMNS, "copy"]
    copies = Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= {i for i, *_ in clean} and max(copies.values()) <= 2 and not rows_of(mixed).keys() - rows_of(out[3]).keys()


def test_run(spark, sf):
    assert P.ORACLE_SQL is None and P.run(spark, sf).count() > 0


def test_edges(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "some words here", "en", None, None), (4, "some words here", "en", "b", 5), (4, "some words here", "en", "b", 5), (5, "reach me at a@b.cd or else", "en", "b", 9), (6, "z " * 100_000, "de", "b", 9)]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() > 0
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    kept = {r.doc_id for r in P.identify_language(spark, docs, str(tmp_path)).collect()}
    assert kept >= {None, 4, 5} and not kept & {1, 2}
