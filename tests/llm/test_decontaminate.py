import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from palimpsest.llm.decontaminate import COVERAGE, MIN_TILE, clean, judged, op5_decontaminate, rounds, tiles
from palimpsest.llm.tokens import ALNUM, Words

from .brute import tiling, words_of


def covered(text, item):
    sides = [Words(pa.array([t]), ALNUM) for t in (text, item)]
    wins = [w.windows(MIN_TILE)[1] for w in sides]
    found = tiles(sides[0].hash, sides[1].hash, *wins)
    return found, sum(x[0] for x in found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=25))
def test_tiles_do_not_overlap_and_are_true(a, b):
    found, total = covered(" ".join(a), " ".join(b))
    used_a, used_b = set(), set()
    for n, i, j in found:
        assert n >= MIN_TILE and a[i : i + n] == b[j : j + n]
        assert not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))
    assert bool(total) == bool(tiling(" ".join(a), " ".join(b))[0])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.lists(st.sampled_from("ab"), max_size=40))
def test_rounds_give_the_same_tiles(a, b):
    sides = [Words(pa.array([" ".join(t)]), ALNUM).hash for t in (a, b)]
    assert rounds(*sides) == covered(" ".join(a), " ".join(b))[0]


def test_sides_that_repeat_themselves():
    text, item = "a " * 60_000, "a " * 3000 + "b"
    assert covered(text, item)[0] == [(3000, 0, 0)]
    assert covered("x y z " * 30_000, "y z x " * 2000)[1] >= 5999


def test_tiling_by_definition():
    rng = random.Random(3)
    item = [f"w{i}" for i in range(40)]
    for _ in range(40):
        parts = [item[i : i + 8] for i in range(0, 40, 8)]
        rng.shuffle(parts)
        text = " ".join(" ".join(p) + f" x{rng.random()}" for p in parts[: rng.randrange(6)])
        assert (covered(text, " ".join(item))[1], 40) == tiling(text, " ".join(item))


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    grams = {}
    for i, t in items.items():
        w = words_of(t)
        for x in range(len(w) - MIN_TILE + 1):
            grams.setdefault(tuple(w[x : x + MIN_TILE]), set()).add(i)
    expected = {}
    for d, t in docs.items():
        w = words_of(t)
        near = set().union(*(grams.get(tuple(w[x : x + MIN_TILE]), ()) for x in range(len(w) - MIN_TILE + 1)))
        scores = {i: covered(t, items[i])[1] / len(words_of(items[i])) for i in near}
        held = {i: s for i, s in scores.items() if s >= COVERAGE}
        expected[d] = (bool(held), min(held, key=lambda i: (-held[i], i), default=None), len(held))
    got = {r.doc_id: (r.contaminated, r.item_id, r.n_items) for r in op5_decontaminate(spark, sf).collect()}
    assert got == expected and any(x[0] for x in got.values()) and not all(x[0] for x in got.values())


def test_reordered_passages_and_edges(spark):
    item = " ".join(f"w{i}" for i in range(40))
    swapped = "intro " + " ".join(f"W{i}," for i in range(20, 40)) + " middle " + " ".join(f"w{i}" for i in range(20))
    rows = [(1, swapped), (2, " ".join(f"w{i}" for i in range(15))), (3, None), (4, ""), (5, "nothing at all of the kind"), (5, item), (6, "y " * 200_000 + item), (None, item), (7, item), (7, item)]
    docs = spark.createDataFrame([(i, t, 1.5, "h") for i, t in rows], "doc_id long, text string, coverage double, k string")
    items = spark.createDataFrame([(9, item), (8, item), (3, None), (4, "too short"), (None, "")], "item_id long, text string")
    kept = clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]
    assert {(r.item_id, r.coverage, r.n_items) for r in judged(docs, items).collect()} == {(8, 1.0, 2)}
    short = spark.createDataFrame([(1, "Too, short!"), (2, "it is too short"), (3, "too"), (4, "too short ones")], "doc_id long, text string")
    assert [r.doc_id for r in clean(short, items).collect()] == [2, 3, 4]  # an item of a few words is contained in its copies alone
    assert clean(docs.limit(0), items).collect() == [] and clean(docs, items.limit(0)).count() == len(rows)
