"""Writes as plans: upsert, remove."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import column, fresh


def last_of_each(items: DataFrame, id_column: str) -> DataFrame:
    """Of items with one id within a batch, the last. For batches that keep their order (lists of items)."""
    at, nth = fresh(items, "__place", "__last")
    place = items.withColumn(at, F.monotonically_increasing_id())
    last = F.row_number().over(Window.partitionBy(column(id_column)).orderBy(F.desc(at)))
    return place.withColumn(nth, last).where(F.col(nth) == 1).drop(at, nth)


def upsert(base: DataFrame, new: DataFrame, id_column: str) -> DataFrame:
    """base with the items of new in place of its own of the same ids. An item is replaced whole; columns are united."""
    return base.join(new.select(id_column), id_column, "left_anti").select(*map(column, base.columns)).unionByName(new, allowMissingColumns=True)


def remove(base: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """base without the items of the ids; unknown ids have no effect."""
    return base.join(ids.select(id_column), id_column, "left_anti").select(*map(column, base.columns))
