"""The driver's contract, and pushed-down plans."""

import __spark_entry__ as entry
from palimpsest import Query, all_of, between, eq, ge, gt, ne, negate
from palimpsest.catalogue import ORACLES, QUERIES, orders


def test_contract(spark):
    found, twins = entry.queries(), entry.oracle_sql()
    assert QUERIES.keys() <= found.keys() and ORACLES.keys() <= twins.keys() <= found.keys()
    out = entry.entry(spark)
    assert out.columns == ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"] and out.count() <= 10


def plan(df):
    return df._jdf.queryExecution().toString()


def pushed(df):
    return [x for x in plan(df).split("PushedFilters: ")[1:]][-1].split("]")[0]


def test_filters_reach_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    engine = orders(spark, sf)
    for f, what in [
        (ge("o_totalprice", 5), "GreaterThanOrEqual(o_totalprice,5.0)"), (eq("o_custkey", 5), "EqualTo(o_custkey,5)"), (ne("o_orderstatus", "F"), "Not(EqualNullSafe(o_orderstatus,F))"), (negate(gt("o_totalprice", 5)), "Or(IsNull(o_totalprice),LessThanOrEqual(o_totalprice,5.0))"),
        (eq("o_orderdate", "1998-03-05"), "LessThan(o_orderdate,1998-03-06T00:00)"), (all_of(between("o_totalprice", 1, 2), eq("o_orderpriority", "5-LOW")), "EqualTo(o_orderpriority,5-LOW)"),
    ]:
        assert what in pushed(Query("orders").where(f).hits(engine)), (f, pushed(Query("orders").where(f).hits(engine)))


def test_pages_are_top_k_and_facets_read_declared_columns(spark, sf):
    engine = orders(spark, sf)
    assert "TakeOrderedAndProject" in plan(Query("orders").order_by("o_totalprice").paged(10, 5).run(engine))
    scan = plan(engine.options("FROM orders WHERE o_totalprice > 5")).split("ReadSchema: ")[-1].splitlines()[0]
    assert "o_orderkey" not in scan and "o_orderstatus" in scan
