from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest import Date, Engine, Enum, Numeric, String
from palimpsest.operators import facets
from palimpsest.server import handle

INDICES = {"v": Numeric(), "kind": Enum(("even", "odd")), "day": Date(), "none": String()}


def numbers(spark, n):
    items = spark.range(n).select("id", (F.col("id") + 1_000_000_000).alias("v"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind"))
    return Engine.with_entities(spark, {"x": (items, "id", INDICES)})


def test_no_map_grows_with_its_field(spark):
    """400,000 values are more than one row holds; all of them are there once, and fields of few values stay one row."""
    n = 400_000
    maps = numbers(spark, n).option_maps('FROM x WHERE kind = "odd"').cache()
    sizes = [(r["field"], r["n"]) for r in maps.select("field", F.size("values").alias("n")).collect()]
    assert Counter(f for f, _ in sizes) == {"day": 1, "kind": 1, "none": 1, "v": 2} and max(k for _, k in sizes) < 0.6 * n
    values = maps.where("field = 'v'").select(F.explode("values").alias("value", "count"))
    assert values.agg(F.count("*"), F.count_distinct("value"), F.sum("count"), F.max("count")).first()[:] == (n, n, n // 2, 1)
    maps.unpersist()


@pytest.mark.parametrize("part", [1, 40, 1 << 22])
def test_parts_together_are_the_map(spark, monkeypatch, part):
    """However small the parts are: each value in one row, in order there, and one answer a field over HTTP."""
    monkeypatch.setattr(facets, "PART", part)
    engine = numbers(spark, 50)
    rows = engine.option_maps('FROM x WHERE kind = "odd"').select("field", F.map_keys("values").alias("values")).collect()
    assert [r["field"] for r in rows] == sorted(r["field"] for r in rows) and all(r["values"] == sorted(r["values"]) for r in rows)
    expected = {"day": {}, "kind": {"even": 0, "odd": 25}, "none": {}, "v": {str(1_000_000_000 + i): i % 2 for i in range(50)}}
    assert Counter(v for r in rows for v in r["values"]) == Counter(v for values in expected.values() for v in values)
    assert (len(rows) == len(expected)) == (part == 1 << 22)
    status, answer = handle(engine, "POST", "/options", {"query": 'FROM x WHERE kind = "odd"'})
    assert status == 200 and [a["field"] for a in answer] == sorted(expected) and {a["field"]: a["values"] for a in answer} == expected
