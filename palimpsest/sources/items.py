"""JSON items: nested on the way in, flat with dotted keys on the way out."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidInput
from ..functions.columns import column


def flat(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested columns as dotted ones: objects give a column a leaf, arrays of objects an array a leaf, nested arrays joined.

    Nulls within arrays are left out; arrays without an element, and objects without a key, are missing. Where a dotted
    name comes up twice, the later column stays. Columns in keep aren't touched.
    """
    found: dict[str, Column] = {}
    for f in df.schema.fields:
        if f.name in keep:
            found[f.name] = column(f.name)
        else:
            _walk(f.name, column(f.name), f.dataType, found)
    return df.select(*[c.alias(n) for n, c in found.items()])


def _walk(name: str, value: Column, kind: T.DataType, out: dict[str, Column]) -> None:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            _walk(f"{name}.{f.name}", value.getField(f.name), f.dataType, out)
    elif isinstance(kind, T.ArrayType):
        _walk_array(name, F.filter(value, lambda x: x.isNotNull()), kind.elementType, out)
    else:
        out.pop(name, None)
        out[name] = value


def _walk_array(name: str, values: Column, kind: T.DataType, out: dict[str, Column]) -> None:
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            inner = F.filter(F.transform(values, _field(f.name)), lambda x: x.isNotNull())
            _walk_array(f"{name}.{f.name}", inner, f.dataType, out)
    elif isinstance(kind, T.ArrayType):
        _walk_array(name, F.filter(F.flatten(values), lambda x: x.isNotNull()), kind.elementType, out)
    else:
        out.pop(name, None)
        out[name] = F.when(F.size(values) > 0, values)


def _field(name: str):
    return lambda x: x.getField(name)


def read_json(spark: SparkSession, path: str, id_field: str = "id", fields: str = "fields", schema: T.StructType | str | None = None) -> DataFrame:
    """Lines of {"id": ..., "fields": {...}} as items. Give a schema for large inputs: inferring one reads them twice."""
    raw = (spark.read.schema(schema) if schema else spark.read).json(path)
    return flat(raw.select(column(id_field).cast("long").alias("id"), f"{fields}.*") if fields in raw.columns else raw.withColumn("id", column(id_field).cast("long")), keep=("id",))


def parse_column(df: DataFrame, source: str, schema: str) -> DataFrame:
    """A column of JSON text as dotted columns after its name (props -> props.k)."""
    parsed = df.withColumn(source, F.from_json(column(source), schema))
    return flat(parsed, keep=tuple(c for c in df.columns if c != source))


def to_json(items: DataFrame, id_column: str = "id") -> DataFrame:
    """One column `value`: {"id": ..., "fields": {...}} a row, keys in order, fields that an item lacks left out."""
    names = sorted(c for c in items.columns if c != id_column)
    return items.select(F.to_json(F.struct(column(id_column).alias("id"), F.struct(*[column(c).alias(c) for c in names]).alias("fields"))).alias("value"))


def write_json(items: DataFrame, path: str, id_column: str = "id") -> None:
    to_json(items, id_column).write.text(path)


def flatten(value: dict[str, Any]) -> dict[str, Any]:
    """One item's fields, flattened as `flat` does: for request bodies."""
    out: dict[str, Any] = {}
    for k, v in value.items():
        if v is not None:
            _flatten(k, v, out)
    return out


def _flatten(name: str, value: Any, out: dict[str, Any]) -> None:
    if value is None:
        raise InvalidInput(f"{name!r} holds a null")
    if isinstance(value, dict):
        for k, v in value.items():
            _flatten(f"{name}.{k}", v, out)
    elif isinstance(value, list):
        gathered: dict[str, list] = {}
        for x in value:
            inner: dict[str, Any] = {}
            _flatten(name, x, inner)
            for k, v in inner.items():
                gathered.setdefault(k, []).extend(v if isinstance(v, list) else [v])
        out.update(gathered)
    else:
        out[name] = value


def frame(spark: SparkSession, items: list[dict[str, Any]], base: T.StructType | None = None) -> DataFrame:
    """A DataFrame of {"id": n, "fields": {...}} items; fields in base take its types, whole numbers beside fractions are double."""
    rows = [{"id": int(i["id"]), **flatten(i.get("fields", {}))} for i in items]
    kinds: dict[str, T.DataType] = {"id": T.LongType()}
    for row in rows:
        for k, v in row.items():
            if k != "id":
                kinds[k] = _join(k, kinds.get(k), _type(k, v))
    for f in base.fields if base else ():
        if f.name in kinds and f.name != "id" and not (isinstance(f.dataType, T.LongType) and isinstance(kinds[f.name], T.DoubleType)):
            kinds[f.name] = _join(f.name, kinds[f.name], f.dataType)
    schema = T.StructType([T.StructField(k, t) for k, t in kinds.items()])
    return spark.createDataFrame([tuple(_cast(r.get(k), t) for k, t in kinds.items()) for r in rows], schema)


def _type(name: str, v: Any) -> T.DataType:
    if isinstance(v, list):
        kind: T.DataType | None = None
        for x in v:
            kind = _join(name, kind, _type(name, x))
        return T.ArrayType(kind or T.StringType())
    for python, spark in ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()), (str, T.StringType())):
        if isinstance(v, python):
            return spark
    raise InvalidInput(f"{name!r} holds a value of an unknown type")


def _join(name: str, a: T.DataType | None, b: T.DataType) -> T.DataType:
    if a is None or a == b:
        return b
    if {type(a), type(b)} == {T.LongType, T.DoubleType}:
        return T.DoubleType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_join(name, a.elementType, b.elementType))
    raise InvalidInput(f"{name!r} holds values of different types")


def _cast(v: Any, kind: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(v)
    return [_cast(x, kind.elementType) for x in v] if isinstance(kind, T.ArrayType) else v
