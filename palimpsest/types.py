"""Index declarations: what a field means, and so which operators it has. Nothing is materialised for one."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidInput, UnknownEnumValue
from .functions.columns import column


@dataclass(frozen=True)
class Index:
    """Base of the declarations. kind: the delta table's value column that holds the field's values."""

    name = ""
    kind = ""
    ordered = False

    def accepts(self, data_type: T.DataType) -> bool:
        raise NotImplementedError

    def value(self, value):
        """The Python value checked and put in the field's type."""
        raise NotImplementedError

    def read(self, field: str, data_type: T.DataType) -> Column:
        """The field in the declared type."""
        return column(field)

    def sort_key(self, field: str, data_type: T.DataType) -> Column:
        return self.read(field, data_type)

    def to_json(self) -> dict:
        return {"type": self.name}


@dataclass(frozen=True)
class String(Index):
    term: bool = False
    name, kind = "string", "v_str"

    def accepts(self, data_type):
        return isinstance(data_type, (T.StringType, T.NullType))

    def value(self, value):
        if not isinstance(value, str):
            raise InvalidInput(f"a string is needed, not {value!r}")
        return value

    def to_json(self):
        return {"type": self.name, "term": self.term}


@dataclass(frozen=True)
class Numeric(Index):
    name, kind, ordered = "numeric", "v_num", True

    def accepts(self, data_type):
        return isinstance(data_type, (T.NumericType, T.NullType))

    def value(self, value):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise InvalidInput(f"a number is needed, not {value!r}")
        return float(value)

    def read(self, field, data_type):
        return column(field) if isinstance(data_type, T.DoubleType) else column(field).cast("double")


@dataclass(frozen=True)
class Date(Index):
    name, kind, ordered = "date", "v_date", True

    def accepts(self, data_type):
        return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType, T.NullType))

    def value(self, value):
        if isinstance(value, dt.datetime):
            return value.date()
        if isinstance(value, dt.date):
            return value
        try:
            return dt.date.fromisoformat(value)
        except (TypeError, ValueError):
            raise InvalidInput(f"an ISO 8601 date is needed, not {value!r}") from None

    def read(self, field, data_type):
        return column(field) if isinstance(data_type, T.DateType) else column(field).try_cast("date")


@dataclass(frozen=True)
class Bool(Index):
    name, kind = "bool", "v_bool"

    def accepts(self, data_type):
        return isinstance(data_type, (T.BooleanType, T.NullType))

    def value(self, value):
        if not isinstance(value, bool):
            raise InvalidInput(f"a boolean is needed, not {value!r}")
        return value


@dataclass(frozen=True)
class Enum(Index):
    """A string of a declared list; it sorts in the list's order."""

    values: tuple[str, ...] = ()
    name, kind = "enum", "v_str"

    def accepts(self, data_type):
        return isinstance(data_type, (T.StringType, T.NullType))

    def value(self, value):
        if not isinstance(value, str):
            raise InvalidInput(f"a string is needed, not {value!r}")
        if value not in self.values:
            raise UnknownEnumValue(f"{value!r} is none of {', '.join(self.values)}")
        return value

    def sort_key(self, field, data_type):
        place = F.lit(None).cast("int")
        for i in range(len(self.values) - 1, -1, -1):
            place = F.when(column(field) == self.values[i], i).otherwise(place)
        return place

    def to_json(self):
        return {"type": self.name, "values": list(self.values)}


def from_json(d: dict) -> Index:
    kind = str(d.get("type", "")).lower()
    if kind == "string":
        return String(term=bool(d.get("term", False)))
    if kind == "enum":
        return Enum(values=tuple(d.get("values", ())))
    try:
        return {"numeric": Numeric, "date": Date, "bool": Bool}[kind]()
    except KeyError:
        raise InvalidInput(f"unknown index type {d.get('type')!r}") from None
