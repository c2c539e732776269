"""Every query with an SQL twin, against DuckDB on the same tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from palimpsest.catalogue import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return db


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, sf, name):
    found = QUERIES[name](spark, sf)
    said = duck.execute(ORACLES[name])
    columns = [c[0] for c in said.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, found.collect()) == rows(columns, said.fetchall())


def test_all_have_a_twin():
    assert QUERIES.keys() == ORACLES.keys()
