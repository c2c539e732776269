"""Order and page."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import MissingIndex
from ..functions.columns import column
from ..plans.query import Page, Sort
from ..types import Index


def ordered(items: DataFrame, id_column: str, sort: Sort | None, indices: dict[str, Index]) -> DataFrame:
    """By rising id, or by one declared field with missing values last and ties by rising id."""
    if sort is None:
        return items.orderBy(column(id_column).asc())
    if sort.field not in indices:
        raise MissingIndex(f"no index on {sort.field!r}")
    if sort.field not in items.columns:
        return items.orderBy(column(id_column).asc())
    key = indices[sort.field].sort_key(sort.field, items.schema[sort.field].dataType)
    return items.orderBy(key.desc_nulls_last() if sort.descending else key.asc_nulls_last(), column(id_column).asc())


def paged(items: DataFrame, page: Page) -> DataFrame:
    """After an order, planned as a top-k of start + size rows."""
    return items.offset(page.start).limit(page.size) if page.start else items.limit(page.size)
