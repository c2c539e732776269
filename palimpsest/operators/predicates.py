"""Filter trees as boolean Columns.

Logic is two-valued: a comparison on a missing value is false, and NOT is the complement. NOT is pushed down to the leaves,
where it becomes `isNull OR inverse`, which Parquet scans can use; `NOT coalesce(p, false)` couldn't be pushed.
"""

from __future__ import annotations

import datetime as dt
import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidInput, MissingIndex, MissingTermIndex, UnsupportedOperation
from ..functions.columns import column
from ..functions.text import contains, matches
from ..plans.filters import And, Filter, Leaf, Not, Or
from ..types import Date, Index, String

INVERSE = {"gt": "le", "ge": "lt", "lt": "ge", "le": "gt"}
APPLY = {"gt": Column.__gt__, "ge": Column.__ge__, "lt": Column.__lt__, "le": Column.__le__}


def lower(f: Filter, indices: dict[str, Index], schema: T.StructType, negated: bool = False) -> Column:
    """The Column of a filter; null counts as false. Raises for fields, operators and values that aren't declared."""
    match f:
        case Not(part):
            return lower(part, indices, schema, not negated)
        case And(parts) | Or(parts):
            if not parts:
                return F.lit(negated)
            join = Column.__and__ if isinstance(f, And) != negated else Column.__or__
            return balanced(join, [lower(p, indices, schema, negated) for p in chain(f)])
        case Leaf():
            return leaf(f, indices, schema, negated)
    raise InvalidInput(f"{f!r} is no filter")


def chain(f: And | Or) -> list[Filter]:
    """The parts, those of parts of the same kind in their place; an empty part stays, as it has no rows of its own."""
    todo, out = [f], []
    while todo:
        part = todo.pop()
        if type(part) is type(f) and part.parts:
            todo += reversed(part.parts)
        else:
            out.append(part)
    return out


def balanced(join, parts: list[Column]) -> Column:
    """Joined in pairs, so that a long chain makes no deep expression."""
    while len(parts) > 1:
        parts = [reduce(join, parts[i : i + 2]) for i in range(0, len(parts), 2)]
    return parts[0]


def leaf(f: Leaf, indices: dict[str, Index], schema: T.StructType, negated: bool) -> Column:
    index = indices.get(f.field)
    if index is None:
        raise MissingIndex(f"no index on {f.field!r}")
    if f.field not in schema.names:  # declared, but no item has the field
        return F.lit(negated)
    kind = schema[f.field].dataType
    if f.op in ("contains", "match") and isinstance(index, String):
        if not index.term:
            raise MissingTermIndex(f"the index on {f.field!r} has no terms, which {f.op} needs")
        hit = (contains if f.op == "contains" else matches)(column(f.field), index.value(f.value))
        return ~F.coalesce(hit, F.lit(False)) if negated else F.coalesce(hit, F.lit(False))
    if f.op in ("eq", "contains", "match"):
        return equal(index, f.field, kind, index.value(f.value), negated)
    if not index.ordered:
        raise UnsupportedOperation(f"{f.op} isn't defined for the {index.name} field {f.field!r}")
    if f.op == "between":
        low, high = (index.value(v) for v in f.value)
        if negated:
            return missing(index, f.field, kind) | compare(index, f.field, kind, "lt", low) | compare(index, f.field, kind, "gt", high)
        return compare(index, f.field, kind, "ge", low) & compare(index, f.field, kind, "le", high)
    value = index.value(f.value)
    if negated:
        return missing(index, f.field, kind) | compare(index, f.field, kind, INVERSE[f.op], value)
    return compare(index, f.field, kind, f.op, value)


def missing(index: Index, field: str, kind: T.DataType) -> Column:
    return index.read(field, kind).isNull()


def equal(index: Index, field: str, kind: T.DataType, value, negated: bool) -> Column:
    if isinstance(index, Date) and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        if negated:
            return column(field).isNull() | compare(index, field, kind, "lt", value) | compare(index, field, kind, "gt", value)
        return compare(index, field, kind, "ge", value) & compare(index, field, kind, "le", value)
    if isinstance(kind, T.IntegralType):
        if not value.is_integer() or abs(value) >= 2**63:  # no whole number is equal
            return F.lit(negated)
        return ~column(field).eqNullSafe(F.lit(int(value))) if negated else column(field) == F.lit(int(value))
    c = index.read(field, kind)
    return ~c.eqNullSafe(F.lit(value)) if negated else c == F.lit(value)


def compare(index: Index, field: str, kind: T.DataType, op: str, value) -> Column:
    """Days of timestamps are compared as ranges of the timestamp itself, which scans can use."""
    if isinstance(index, Date) and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        later = op in ("gt", "le")
        try:
            day = value + dt.timedelta(days=later)
        except OverflowError:  # no day after the calendar's last
            return column(field).isNotNull() & F.lit(op == "le")
        at = F.lit(day.isoformat()).cast("timestamp_ntz" if isinstance(kind, T.TimestampNTZType) else "timestamp")
        return column(field) >= at if op in ("gt", "ge") else column(field) < at
    if isinstance(kind, T.IntegralType):
        # With a whole number as the bound the scan can use the filter, which it can't below a cast to double. NaN is above all numbers.
        if math.isnan(value) or abs(value) >= 2**63:
            return column(field).isNotNull() & F.lit((op in ("lt", "le")) == (not value < 0))
        return APPLY[op](column(field), F.lit((math.floor if op in ("gt", "le") else math.ceil)(value)))
    return APPLY[op](index.read(field, kind), F.lit(value))
