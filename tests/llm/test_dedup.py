import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import dedup, graph
from palimpsest.llm.dedup import REGISTERS, deduplicated, near_duplicates, op1_dedup, overlaps, signatures
from palimpsest.llm.graph import closed, components

from .brute import classes, jaccard, shingles


def words(n, seed):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(base, at):
    out = list(base)
    for i in at:
        out[i] = f"z{i}"
    return " ".join(out)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 48, 60, dtype=np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    agree = []
    for s in range(60):
        k = h ^ np.uint64(s * 7919)
        sig = signatures(np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]), np.concatenate([k[a > 0], k[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - exact) < 4 * (exact * (1 - exact) / (60 * REGISTERS)) ** 0.5


def test_overlaps_are_exact():
    texts = ["a b c d e f g a b c d e f g", "a b c d e f g", "A  b c d e\nf g", "x", "", "x y z", "X"]
    a, b = zip(*[(s, t) for s in texts for t in texts], strict=True)
    got = overlaps(pa.array(a), pa.array(b))
    assert got.tolist() == pytest.approx([jaccard(shingles(s), shingles(t)) for s, t in zip(a, b, strict=True)])


@pytest.mark.parametrize("local", [0, 10**6])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(130)]
    ids, label = closed(*(np.array(x) for x in zip(*[e for e in edges if e[0] != e[1]], strict=True)))
    got = {r.id: r["class"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict(zip(ids.tolist(), label.tolist(), strict=True))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_whole_table_against_all_pairs(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in op1_dedup(spark, sf).collect()}
    assert got == classes(docs) and any(a != b for a, b in got.items())


def made(spark):
    base = words(60, 1)
    chain = [edited(base, range(3 * i, 3 * i)) for i in range(1)]
    for i in range(1, 40):  # each like the one before it, the ends unlike
        chain.append(edited(base, range(i)))
    other = words(80, 2)
    rows = [(100 + i, t) for i, t in enumerate(chain)]
    rows += [(300 + i, " ".join(other)) for i in range(30)] + [(400 + i, edited(other, [i])) for i in range(30)]
    rows += [(500 + i, " ".join(words(50, 900 + i))) for i in range(20)]
    rows += [(600, None), (601, ""), (602, " \n"), (603, "short text"), (604, "Short  TEXT"), (605, "short texts"), (606, " ".join(words(60_000, 5))), (607, " ".join(words(60_000, 5)[1:]))]
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_groups_and_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    rows = made(spark)
    found, links = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.id: r["class"] for r in found.collect()}
    expected = {i: c for i, c in classes(rows).items() if shingles(dict(rows)[i])}
    assert got == expected
    text = dict(rows)
    assert all(jaccard(shingles(text[r.a]), shingles(text[r.b])) >= 0.8 for r in links.collect())


def test_one_of_each_class_stays(spark):
    rows = made(spark) + [(None, "short text"), (605, "short texts")]
    docs = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, class string, id int").drop("id").withColumn("ID", F.lit(1))
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    c = classes(rows)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i in c if c[i] == i)  # the row without an id is a copy of another
    other, again = " ".join(words(30, 80)), " ".join(words(30, 81))
    rows = [(1, other), (1, again), (1, other), (2, again + " x"), (None, other), (None, None), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("map", F.create_map(F.lit("a"), F.col("doc_id")))
    assert Counter((r.doc_id, r.text) for r in deduplicated(docs).collect()) == Counter([(1, other), (1, again), (None, None), (3, None), (3, "")])
    assert deduplicated(docs.limit(0)).collect() == []
    assert near_duplicates(docs.limit(0))[0].collect() == []


def test_ids_of_several_texts(spark):
    a, b = " ".join(words(30, 8)), " ".join(words(30, 9))
    found, _ = near_duplicates(spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (4, "other words here now yes")], "doc_id long, text string"))
    assert {r.id: r["class"] for r in found.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
