import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mix as M
from palimpsest.llm.mix import ORACLE_SQL, mix, mix_copies, op3_mix


def targets(words):
    """Water-filling by repeated resharing; words: source -> total, in order of preference."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(words)}
    left, open_, out = 1.5 * sum(words.values()), set(words), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= 2 * words[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = 2.0 * words[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def check(rows, docs):
    """rows of op3 against docs: (doc_id, source, text)."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, _, t in docs}
    source = {i: s for i, s, _ in docs}
    words = defaultdict(int)
    for i in size:
        words[source[i]] += size[i]
    order = sorted((s for s in words if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in words)
    target = targets({s: words[s] for s in order})
    taken = defaultdict(int)
    assert sorted(r.doc_id for r in rows) == sorted(size)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == words[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) <= 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[source[r.doc_id]] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max((size[i] for i in size if source[i] == s), default=0)


def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    rows = op3_mix(spark, sf).collect()
    check(rows, docs)
    again = {r.doc_id: r.taken for r in op3_mix(spark, sf).repartition(7).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


@pytest.mark.parametrize("table", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_sql_twin(spark, table):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{table}/documents.parquet')")
    said = db.execute(ORACLE_SQL)
    names = [c[0] for c in said.description]
    assert names == op3_mix(spark, table).columns
    assert sorted(tuple(r) for r in op3_mix(spark, table).collect()) == sorted(said.fetchall())


def test_hot_values_are_split(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(M, "PART", 10)
    rows = [(i, "hot" if i % 3 else ("b", "c", None)[i % 9 // 3], "w " * (4 if i % 2 else i % 7)) for i in range(700)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(op3_mix(spark, str(tmp_path)).collect(), rows)


def test_edges(spark):
    rows = [(1, None, None, 1), (2, "", "", 2), (3, "a", "x y z", 3), (3, "a", "x y z", 3), (None, "a", "u v", 4), (5, "b", "\x0bq\x0c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    out = mix(docs)
    assert out.columns == ["doc_id", "source", "text", "size", "_size", "source_size", "target", "taken", "copies"]
    got = out.collect()
    assert sorted((r.doc_id or 0, r.size, r._size, r.source_size) for r in got) == [(0, 4, 2, 8), (1, 1, 0, 0), (2, 2, 0, 0), (3, 3, 3, 8), (3, 3, 3, 8), (5, 5, 1, 1)]
    assert all(r.taken == r.copies * r._size for r in got)
    copies = mix_copies(docs.withColumn("copy", F.lit("c"))).collect()
    assert len(copies) == sum(r.copies for r in got) and {r["_copy"] for r in copies} <= {1, 2} and {r["copy"] for r in copies} == {"c"}
    assert mix(docs.limit(0)).collect() == [] and mix_copies(docs.limit(0)).collect() == []
