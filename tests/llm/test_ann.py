import math

import numpy as np
import pytest

from palimpsest.llm import ann
from palimpsest.llm.ann import encode, op10_ann, rotation, search


def brute(rows, k):
    """query's place -> (id, [(id, score)] of the k nearest, exactly)."""
    out = {}
    ids = np.array([i for i, _ in rows])
    vectors = np.array([v for _, v in rows], float)
    for n, q in enumerate(ids):
        if q % 20 == 0:
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                scores = np.einsum("ij,j->i", vectors, vectors[n])
            near = sorted((-s, int(i)) for m, (i, s) in enumerate(zip(ids, scores)) if m != n)[:k]
            out[n] = (int(q), [(i, -s) for s, i in near])
    return out


def test_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    expected = dict(brute(rows, 20).values())
    found = {}
    for r in op10_ann(spark, sf).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == expected.keys()
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in expected[q]}) for q in expected)
    assert hits >= 0.99 * sum(map(len, expected.values()))
    exact = dict(rows)
    for q, near in found.items():
        assert len(near) == 20 and all(math.isclose(s, float(np.dot(np.array(exact[q], float), np.array(exact[i], float))), rel_tol=1e-12, abs_tol=1e-12) for i, s in near)
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))


def test_blocks_agree(spark, sf, monkeypatch):
    whole = op10_ann(spark, sf).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(ann, "ROWS_A_BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BYTES", 4000)
    monkeypatch.setattr(ann, "ROWS_A_TASK", 50)
    assert [(r.query_id, r.vec_id) for r in op10_ann(spark, sf).orderBy("query_id", "rank").collect()] == [(r.query_id, r.vec_id) for r in whole]


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(0)
    for dim in (64, 100, 7):
        x, q = rng.standard_normal((4000, dim)), rng.standard_normal((1, dim))
        words, norm, fit = encode(x, rotation(dim))
        one = ann.Queries(np.array([-1]), np.array([0]), q, 20)
        guess = one.estimate(0, words.T, np.bitwise_count(words).sum(axis=1, dtype=np.int64)) / fit
        error = guess - (x / norm[:, None]) @ q[0] / np.linalg.norm(q)
        signs = np.unpackbits(words.view(np.uint8), axis=1)[:, :dim] * 2.0 - 1
        exact = signs @ (q[0] / np.linalg.norm(q) @ rotation(dim)) / dim**0.5
        assert (np.abs(guess * fit - exact) <= one.off[0] + 1e-9).all()
        assert abs(error.mean()) < 0.02 and (np.abs(error) <= ann.WIDTH * np.sqrt(1 - fit**2) / fit / np.sqrt(dim - 1) + one.off[0] / fit).mean() > 0.999


@pytest.mark.parametrize("size", [1e25, 1e-200, 1e150, 1e-30, 5e-324])
def test_magnitudes(spark, size):
    """Finite vectors of any size have their results, as by brute force; so have rows that share an id."""
    rng = np.random.default_rng(3)
    rows = [(n % 90, (rng.standard_normal(24) * (size if n % 3 else 1.0)).tolist()) for n in range(120)]
    rows = [(i, v) for i, v in rows if any(v)]
    out = {}
    for r in search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1), "vec_id", "embedding", lambda i: i % 20 == 0, 5).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.score))
    expected = {}
    for q, near in brute(rows, 5).values():
        expected.setdefault(q, []).extend((k + 1, s) for k, (_, s) in enumerate(near))
    assert out.keys() == expected.keys()
    for q in out:
        got, want = sorted(out[q]), sorted(expected[q])
        assert [k for k, _ in got] == [k for k, _ in want]
        assert np.array([s for _, s in got]) == pytest.approx(np.array([s for _, s in want]), rel=1e-9, abs=0)


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]), (7, [float("inf"), 0.0]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (40, [1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    out = [tuple(r) for r in search(df, "vec_id", "embedding", lambda i: i % 20 == 0, 2).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0)]
    assert search(df.limit(0), "vec_id", "embedding", lambda i: i % 20 == 0).collect() == []
