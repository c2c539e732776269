import numpy as np
import pyarrow as pa

from palimpsest.llm.langid import Filters, grams, identify, learn, op2_langid
from palimpsest.llm.tokens import U, mixed


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op2_langid(spark, sf).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_grams_by_hand():
    texts = ["Ab c", "", None, "é1é", "--"]
    row, h, count = grams(pa.array(texts))
    expected = [(0, " ab"), (0, "ab "), (0, " c "), (3, " é "), (3, " é ")]
    code = lambda s: int(mixed(np.array([sum((0 if c == " " else ord(c)) << (42 - 21 * i) for i, c in enumerate(s))], U))[0])
    assert [(int(r), int(x)) for r, x in zip(row, h, strict=True)] == [(r, code(s)) for r, s in expected] and count.tolist() == [3, 0, 0, 2, 0]


def test_filters_return_all_languages_and_correct_false_positives():
    rng = np.random.default_rng(2)
    sets = [rng.integers(1, 1 << 60, 3000, dtype=np.uint64) for _ in range(70)]  # more than one word of languages
    sets[69] = np.concatenate([sets[69], sets[0][:500]])
    f = Filters([f"l{i:02d}" for i in range(70)], [(g, i) for i, g in enumerate(sets)])
    other = rng.integers(1, 1 << 60, 20_000, dtype=np.uint64)
    probe = np.concatenate([sets[0][:500], sets[33], other])
    row = np.repeat([0, 1, 2], [500, 3000, 20_000])
    c = f.counts(row, probe, 3)
    assert c[0, 0] == 500 and c[0, 69] == 500 and c[1, 33] == 3000 and abs(np.delete(c[1], 33)).max() < 100
    assert c[2].max() < 6 * (20_000 * f.false.max()) ** 0.5 + 5


def test_edges(spark):
    train = spark.createDataFrame([("en", "the quick brown fox and the dog"), ("de", "der schnelle braune fuchs und der hund"), ("de", None)], "lang string, text string")
    f = learn(train)
    rows = [(1, None, 9), (2, "", 9), (3, "12 -- 7", 9), (4, "the dog", 9), (4, "the dog", 9), (None, "der hund " * 50_000, 9), (6, "ΩΩΩ", 9)]
    out = identify(spark.createDataFrame(rows, "doc_id long, text string, score int"), f)
    assert out.columns == ["doc_id", "text", "score", "lang_pred", "_score"]
    got = sorted((r.doc_id or 0, r.lang_pred, r._score > 0) for r in out.collect())
    assert got == [(0, "de", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (4, "en", True), (6, "de", False)]
    assert identify(out.limit(0).drop("lang_pred", "_score"), f).collect() == []
    nothing = learn(train.limit(0))
    assert [r.lang_pred for r in identify(train.select("text"), nothing).collect()] == ["und"] * 3
