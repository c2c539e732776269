import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import lm
from palimpsest.llm.lm import STRIDE, TOKENIZER, Model, Subwords, load_ranks, op7_lm, scored
from palimpsest.llm.tokens import Words


@pytest.fixture(params=[0.3, 8.0])
def model(request):
    """Of 40 subwords one is not in training; large weights take the way with shifted logits."""
    out = Model(np.arange(40)[::-1].copy(), 5)
    rng = np.random.default_rng(0)
    for k, v in out.p.items():
        out.p[k] = (v + request.param * rng.standard_normal(v.shape)).astype(np.float32)
    return out


def log_share(z, c):
    return z[c] - z.max() - math.log(np.exp(z - z.max()).sum())


def naive(m, ids):
    """Token by token: attention over the token's block so far and the whole block before it."""
    p, classes = {k: v.astype(float) for k, v in m.p.items()}, [int(c) for c in m.to_class[ids]] + [m.end]
    q, k, v = np.split(p["in"], [lm.KEYS, 2 * lm.KEYS], axis=1)
    inputs, total = [m.begin, *classes[:-1]], 0.0
    for t, target in enumerate(classes):
        at = range(max(0, (t // STRIDE - 1) * STRIDE), t + 1)
        x = np.array([p["E"][inputs[u]] for u in at])
        s = np.array([(x[-1] @ q) @ (y @ k) + p["far"][t - u] for u, y in zip(at, x)])
        a = np.exp(s - s.max())
        h = np.append(x[-1] + (a / a.sum()) @ (x @ v) @ p["out"], 1)
        c = int(m.cluster[target])
        total += log_share(p["G"] @ h, c) + log_share(p["O"][m.edges[c] : m.edges[c + 1]] @ h, target - m.edges[c])
    return (total + sum(m.within[i] for i in ids)) / math.log(10)


def test_each_token_is_scored_once(model):
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 40, n) for n in (0, 1, STRIDE - 1, STRIDE, STRIDE + 1, 5 * STRIDE + 3)]
    sizes = lambda x: np.array([len(t) for t in x])
    got = model.score(np.concatenate(texts), sizes(texts))
    assert got == pytest.approx([naive(model, t) for t in texts], rel=1e-3)
    many = [texts[5], texts[1]] * 400  # more blocks than are scored at once
    assert model.score(np.concatenate(many), sizes(many)) == pytest.approx(np.tile(got[[5, 1]], 400), rel=1e-5)


def test_probabilities_sum_to_one(model):
    """Over all next tokens, those of the class of others included."""
    assert model.classes == 41 and model.to_class[39] == model.other and model.edges[-1] == 41
    assert sorted(set(range(41)) - set(model.to_class.tolist())) == [model.end]
    assert Model(np.array([5, 0, 0, 2]), 1).within.tolist() == pytest.approx([0, -math.log(2), -math.log(2), 0])
    h, _ = model.attend(np.full((1, STRIDE), 2), np.array([True]))
    assert np.exp(model.distribution(h)).sum(axis=1) == pytest.approx(1, rel=1e-4)


def test_gradients():
    m = Model(np.arange(1, 40), 3)
    rng = np.random.default_rng(2)
    for k, v in m.p.items():
        m.p[k] = v + 0.1 * rng.standard_normal(v.shape)
    own, targets, _, first = lm.blocks(m.to_class[rng.integers(0, 39, 60)], np.array([40, 0, 20]), m.begin, m.end, m.pad)
    _, g = m.gradients(own, targets, first)
    for name in m.p:
        for at in [np.unravel_index(np.abs(g[name]).argmax(), g[name].shape), np.unravel_index(7, g[name].shape)]:
            save = m.p[name][at]
            sides = []
            for e in (1e-5, -1e-5):
                m.p[name][at] = save + e
                sides.append(m.gradients(own, targets, first)[0])
            m.p[name][at] = save
            assert (sides[0] - sides[1]) / 2e-5 == pytest.approx(g[name][at], rel=1e-3, abs=1e-7), name


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_subwords():
    texts = ["Hello world, naïve Ünï code", "", "hello"]
    s = Subwords(load_ranks(TOKENIZER))
    expected = [[i for w in words_of(t) for i in s.encode(" " + w)] for t in texts]
    for _ in range(2):  # the second time all words are known
        ids, sizes, _ = s.of(Words(pa.array(texts)))
        assert ids.tolist() == sum(expected, []) and sizes.tolist() == [len(e) for e in expected]


def test_subwords_forget(monkeypatch):
    monkeypatch.setattr(lm, "REMEMBERED", 10)
    s = Subwords(load_ranks(TOKENIZER), lambda h: np.arange(len(h)))
    for n in range(20):
        t = f"word{n} more{n} still{n} again{n}"
        ids, sizes, noted = s.of(Words(pa.array([t, ""])))
        assert ids.tolist() == s.encode(" " + t) and sizes.tolist() == [len(ids), 0] and len(noted) == 4


def test_word_counts(spark):
    texts = ["a b Abc abc", None, "", "née\xa0x don't", "abc " * 5000]
    counts = lm.word_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    assert {bytes(r.word).decode(): r.n for r in counts.collect()} == Counter(w for t in texts for w in words_of(t))


def test_all_texts_and_subwords_train(spark):
    """Each subword of training is a class, and each text, having a subword of its own, moves that subword's weights; the split into tasks makes no difference."""
    kind = np.dtype(np.uint16)
    rows = [(n * 7919, np.full(3, n, kind).tobytes()) for n in range(900)]
    train = spark.createDataFrame(rows, "h long, ids binary")
    m, again = (Model(np.full(900, 3), 900) for _ in range(2))
    assert m.classes == 902
    before, moved = m.p["E"].copy(), m.to_class[:900]
    after = lm.learned(m, train.repartition(3), 3600, kind).p
    assert (np.abs(after["E"] - before)[moved].max(axis=1) > 1e-5).all()
    other = lm.learned(again, train.repartition(7), 3600, kind).p
    for k in after:
        assert other[k] == pytest.approx(after[k], abs=1e-6)


def test_whole_table(spark, sf, monkeypatch):
    """With all settings as shipped but for the bound on what is broadcast, so that most words go the way of the join."""
    monkeypatch.setattr(lm, "FREQUENT_BITS", 6)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    c = Counter()
    for i, t in docs:
        if not held[i]:
            c.update(words_of(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    log = lambda k: math.log10((c[k] + 0.5) / (n + 0.5 * (v + 1)))
    got = {r.doc_id: r for r in op7_lm(spark, sf).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        tokens = [*words_of(t), None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens), sum(c[k] > 0 for k in tokens), n)
        assert r.base_score == pytest.approx(sum(map(log, tokens)), rel=1e-9)
    away = [r for r in got.values() if r.held_out]
    assert all(r.score < 0 for r in got.values())
    # Held out, training gains much on the frequencies of subwords alone, which the model starts from.
    monkeypatch.setattr(lm, "learned", lambda model, *_: model)
    start = sum(r.score for r in op7_lm(spark, sf).collect() if r.held_out)
    assert sum(r.score for r in away) > 0.8 * start


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, False), (2, "", True), (3, "a b", False), (3, "a b", False), (None, "z " * 200_000, True)], "doc_id long, text string, held_out boolean")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in scored(docs).collect()))
    assert got == [(0, 200_001, 1, 7), (1, 1, 1, 7), (2, 1, 1, 7), (3, 3, 3, 7), (3, 3, 3, 7)]
    bare = scored(docs.withColumn("held_out", F.lit(True))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in bare)
    assert scored(docs.limit(0)).collect() == []


def test_least_count(spark, monkeypatch):
    """As many words are broadcast as the bound allows, not only those with their share of all tokens."""
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 9 + [2] * 3 + [5, 3000])], "h long, n long")
    got = []
    for bits in (0, 1, 2, 3, 4):
        monkeypatch.setattr(lm, "FREQUENT_BITS", bits)
        got.append(lm.least_count(counts, 3020))
    assert got == [6, 3, 3, 2, 1]
    monkeypatch.setattr(lm, "FREQUENT_BITS", 1)
    assert lm.least_count(counts.union(counts).where("n > 4").union(counts.where("n > 4")), 9015) == 4508


def test_counts_without_words(spark):
    docs = spark.createDataFrame([(t,) for t in ["a b Abc abc", None, "", " ", "abc " * 5000]], "text string").repartition(3)
    named, bare = lm.word_counts(docs).collect(), lm.word_counts(docs, named=False)
    assert bare.columns == ["h", "n"] and {(r.h, r.n) for r in bare.collect()} == {(r.h, r.n) for r in named}


def test_gradients_in_pieces(model, monkeypatch):
    """Pieces of the attention and of the softmax change neither loss nor gradients, with shifted logits too."""
    rng = np.random.default_rng(4)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    own, targets, _, first = lm.blocks(model.to_class[rng.integers(0, 40, 300)], np.array([150, 0, 33, 117]), model.begin, model.end, model.pad)
    loss, whole = model.gradients(own, targets, first)
    for rows, piece in ((1, 7), (3, 64)):
        monkeypatch.setattr(lm, "ROWS", rows)
        monkeypatch.setattr(lm, "PIECE", piece)
        again, parts = model.gradients(own, targets, first)
        assert again == pytest.approx(loss, rel=1e-9)
        for k in whole:
            assert parts[k] == pytest.approx(whole[k], rel=1e-6, abs=1e-9), k
