"""Facets: for every declared field, how many of the hits have each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column
from ..functions.labels import number_label
from ..types import Bool, Date, Index, Numeric

#: Bytes of values and counts in a row of rolled maps, about.
PART = 1 << 22


def label(index: Index, field: str, items: DataFrame) -> Column:
    value = index.read(field, items.schema[field].dataType)
    if isinstance(index, Numeric):
        return number_label(value)
    return value.cast("string") if isinstance(index, Bool) else value


def facets(items: DataFrame, hit: Column, indices: dict[str, Index]) -> DataFrame:
    """(field, value, count) over all items, hit or not: values that no hit has are listed with 0. Missing values aren't counted.

    One scan of the declared columns and one shuffle of partial counts. Date fields have no values (see `rolled`).
    """
    counted = [f for f, i in sorted(indices.items()) if not isinstance(i, Date) and f in items.columns]
    if not counted:
        return items.sparkSession.createDataFrame([], "field string, value string, count long")
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), label(indices[f], f, items).alias("value")) for f in counted])
    rows = items.select(F.coalesce(hit, F.lit(False)).alias("hit"), F.inline(pairs))
    return rows.where("value is not null").groupBy("field", "value").agg(F.count_if("hit").alias("count"))


def rolled(long: DataFrame, indices: dict[str, Index]) -> DataFrame:
    """(field, values: map of value to count) of every declared field, date fields with an empty map, fields and the values of a map in order.

    A field is one row up to about PART bytes of values and counts. One of more is several rows, dealt by a hash of the
    value: together they hold each value once, and no row grows with the field. The sizes come from the facets' own shuffle.
    """
    bare = long.sparkSession.createDataFrame([(f,) for f in sorted(indices)], "field string")
    rows = long.unionByName(bare.select("field", F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("count")))
    size = F.coalesce(F.sum(F.octet_length("value") + F.octet_length(F.col("count").cast("string"))), F.lit(0))
    parts = rows.groupBy("field").agg(F.greatest(F.ceil(size / PART), F.lit(1)).alias("parts"))
    dealt = rows.join(F.broadcast(parts), "field").withColumn("part", F.pmod(F.xxhash64("value"), "parts"))
    entries = dealt.groupBy("field", "part").agg(F.sort_array(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "count")))).alias("entries"))
    return entries.orderBy("field", "part").select("field", F.map_from_entries("entries").alias("values"))


def summary(long: DataFrame, k: int) -> DataFrame:
    """The k most frequent values of each field, ties by value: a top-k report for fields of many values."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("count"), "value"))
    return long.withColumn("rank", rank).where(column("rank") <= k).drop("rank")
