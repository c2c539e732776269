"""Deltas: hypothetical changes of fields, kept as a long table and laid over the items when they are read."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput, MissingIndex
from ..functions.columns import column, fresh
from ..plans.query import Scope
from ..types import Date, Index

SCHEMA = "branch_key long, as_of date, seq long, id long, field string, v_str string, v_num double, v_bool boolean, v_date date"
VALUES = ("v_str", "v_num", "v_bool", "v_date")
TYPES = dict(c.split() for c in SCHEMA.split(", "))


@dataclass(frozen=True)
class Change:
    """The item's field is to have the value `after`."""

    id: int
    field: str
    after: Any


def rows_of(changes: Iterable[Change], scope: Scope, indices: dict[str, Index], first_seq: int) -> list[tuple]:
    """Rows of SCHEMA, values checked against the declarations. seq keeps the order of storing."""
    out = []
    for n, c in enumerate(changes):
        if c.field not in indices:
            raise MissingIndex(f"no index on {c.field!r}")
        if c.after is None:
            raise InvalidInput(f"a change of {c.field!r} needs a value")
        value = indices[c.field].value(c.after)
        cells = [value if indices[c.field].kind == v else None for v in VALUES]
        out.append((scope.branch_key, scope.date, first_seq + n, c.id, c.field, *cells))
    return out


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def wide(deltas: DataFrame, scope: Scope, indices: dict[str, Index]) -> DataFrame:
    """(__id, __after_0, ...): a row for each item changed in the scope, with what the latest change set for each field, in name order.

    Latest is by date, then by order of storing. A branch has its own deltas alone, main has main's. The filters reach the
    scan, the branch its partitions; one aggregate by item, whose partitioning the join with the items uses again.
    """
    fields = sorted(indices)
    seen = deltas.where((F.col("branch_key") == scope.branch_key) & (F.col("as_of") <= F.lit(scope.date)) & F.col("field").isin(fields))
    when = F.struct("as_of", "seq")
    picks = [F.max_by(indices[f].kind, F.when(F.col("field") == f, when)).alias(f"__after_{i}") for i, f in enumerate(fields)]
    return seen.groupBy(F.col("id").alias("__id")).agg(*picks)


def overlay(items: DataFrame, id_column: str, deltas: DataFrame, scope: Scope, indices: dict[str, Index]) -> DataFrame:
    """The items as the scope sees them: every declared field shows its latest change, in the declared type.

    Changes to unknown ids have no effect. Fields that nobody changes in the scope cost a coalesce, and filters on
    undeclared columns still reach the scan. Spark broadcasts the changes where it has measured them to be small.
    """
    return _laid(items, id_column, wide(deltas, scope, indices), indices, "left")


def overlaid_hits(items: DataFrame, id_column: str, deltas: DataFrame, scope: Scope, indices: dict[str, Index], hit: Callable[[DataFrame], Column]) -> DataFrame:
    """The items of an overlay that a filter takes: those without a change, whose own values it can see in the scan, and those with one, as changed."""
    changes = wide(deltas, scope, indices)
    key = fresh(items, "__changed")[0]
    same = items.where(hit(items)).join(changes.select(F.col("__id").alias(key)), column(id_column).cast("long") == F.col(key), "left_anti")
    same = same.select(*[_base(f, items, indices).alias(f) for f in items.columns], *[F.lit(None).cast(TYPES[indices[f].kind]).alias(f) for f in sorted(set(indices) - set(items.columns))])
    other = _laid(items, id_column, changes, indices, "inner")
    return same.union(other.where(hit(other)))


def _base(field: str, items: DataFrame, indices: dict[str, Index]) -> Column:
    return column(field) if field not in indices or isinstance(indices[field], Date) else indices[field].read(field, items.schema[field].dataType)


def _laid(items: DataFrame, id_column: str, changes: DataFrame, indices: dict[str, Index], how: str) -> DataFrame:
    """Items joined with wide() changes."""
    new = sorted(set(indices) - set(items.columns))
    ours = fresh(items, *changes.columns)
    changes = changes.toDF(*ours)
    where = dict(zip(sorted(indices), ours[1:], strict=True))
    joined = items.join(changes, column(id_column).cast("long") == F.col(ours[0]), how)
    out = []
    for f in items.columns:
        after = None
        if f in indices:
            after = F.col(where[f]).cast(items.schema[f].dataType) if isinstance(indices[f], Date) else F.col(where[f])
        out.append((F.coalesce(after, _base(f, items, indices)) if f in indices else column(f)).alias(f))
    return joined.select(*out, *[F.col(where[f]).alias(f) for f in new])
