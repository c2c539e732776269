"""The catalogue of entities, and what can be asked of it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EntityAlreadyExists, EntityNotFound, InvalidInput, MissingIndex
from .functions.columns import column
from .operators import deltas as D
from .operators.facets import facets, rolled
from .operators.paging import ordered, paged
from .operators.predicates import lower
from .operators.upsert import last_of_each, remove, upsert
from .plans.query import Query, Scope
from .sources.items import flat, frame
from .sources.store import Store
from .types import Index


@dataclass
class Entity:
    """Items with an id, declarations of fields, and deltas; kept as plans, or in a store."""

    name: str
    items: DataFrame | None = None
    id_column: str = "id"
    indices: dict[str, Index] = field(default_factory=dict)
    deltas: DataFrame | None = None
    seq: int = 0
    store: Store | None = None

    def overlaid(self, scope: Scope | None) -> bool:
        return scope is not None and self.deltas is not None and bool(self.indices)

    def view(self, scope: Scope | None) -> DataFrame:
        """The items as a scope sees them; without a scope, the base."""
        if not self.overlaid(scope):
            return self.items
        return D.overlay(self.items, self.id_column, self.deltas, scope, self.indices)


class Engine:
    """With a root, entities are kept there and those found are opened; else they live as plans in the session. buckets: of new stored entities, instead of by their size."""

    def __init__(self, spark: SparkSession, root: str | None = None, buckets: int | None = None):
        self.spark, self.root, self.buckets = spark, root, buckets
        self.entities: dict[str, Entity] = {}
        for name in Store.entities(spark, root) if root else ():
            store = Store(spark, root, name).open()
            deltas = store.deltas() if store.meta["deltas"] else None
            self.entities[name] = Entity(name, store.items(), store.meta["id"], store.indices, deltas, store.meta["seq"], store)

    @staticmethod
    def with_entities(spark: SparkSession, entities: dict[str, tuple[DataFrame, str, dict[str, Index]]]) -> Engine:
        """From name: (items, id column, declarations)."""
        engine = Engine(spark)
        for name, (items, id_column, indices) in entities.items():
            engine.create_entity(name)
            engine.load(name, items, id_column, indices)
        return engine

    def create_entity(self, name: str) -> None:
        if name in self.entities:
            raise EntityAlreadyExists(name)
        self.entities[name] = Entity(name)
        if self.root:
            self.entities[name].store = Store(self.spark, self.root, name, self.buckets)
            self.entities[name].store.change(lambda meta: None)

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise EntityNotFound(name)
        return self.entities[name]

    # Writes.
    def load(self, name: str, items: DataFrame, id_column: str = "id", indices: dict[str, Index] | None = None) -> None:
        """Replace all items and declarations; deltas stay."""
        e = self.entity(name)
        if id_column not in items.columns:
            raise InvalidInput(f"no column {id_column!r}")
        self._validate(items, indices or {})
        if e.store:
            e.store.replace(items, id_column)
            items = e.store.items()
        e.items, e.id_column, e.indices = items, id_column, {}
        for f, i in (indices or {}).items():
            self.create_index(name, f, i)

    def add(self, name: str, items: DataFrame | list[dict[str, Any]] | dict[str, Any]) -> None:
        """Upsert by id: a DataFrame (ids unique, nested columns flattened), or {"id": n, "fields": {...}} items, the last of an id counting."""
        e = self.entity(name)
        if isinstance(items, dict):
            items = [items]
        if isinstance(items, list):
            if not items:
                return
            made = frame(self.spark, items, e.items.schema if e.items is not None else None)
            items = last_of_each(made.withColumnRenamed("id", e.id_column) if e.id_column != "id" else made, e.id_column)
        items = flat(items, keep=(e.id_column,))
        if e.items is not None:  # whole numbers that meet fractions become fractions
            have, come = dict(e.items.dtypes), dict(items.dtypes)
            for c in have.keys() & come.keys():
                if (have[c], come[c]) == ("bigint", "double"):
                    e.items = e.items.withColumn(c, F.col(f"`{c}`").cast("double"))
                elif have[c] != come[c]:
                    items = items.withColumn(c, F.col(f"`{c}`").cast(have[c]))
        self._validate(items, e.indices)
        if e.store:
            e.store.upsert(items, e.id_column)
            e.items = e.store.items()
        else:
            e.items = items if e.items is None else upsert(e.items, items, e.id_column)

    def remove(self, name: str, *ids: int | DataFrame) -> None:
        """Items by ids, or by a DataFrame of any size with the id column; unknown ids have no effect."""
        e = self.entity(name)
        if e.items is None or not ids:
            return
        frames = [i.select(column(e.id_column).cast("long").alias(e.id_column)) for i in ids if isinstance(i, DataFrame)]
        numbers = {int(i) for i in ids if not isinstance(i, DataFrame)}
        if numbers:
            frames.append(self.spark.createDataFrame([(i,) for i in numbers], f"`{e.id_column}` long"))
        gone = reduce(DataFrame.union, frames).distinct()
        if e.store:
            e.store.remove(gone, e.id_column)
            e.items = e.store.items()
        else:
            e.items = remove(e.items, gone, e.id_column)

    def clear(self, name: str) -> None:
        """No items and no declarations; deltas stay."""
        e = self.entity(name)
        if e.store:
            e.store.clear()
        e.items, e.indices = None, {}

    def create_index(self, name: str, field_name: str, index: Index) -> None:
        """Declare a field; a new declaration takes the old one's place. It holds whether or not an item has the field yet."""
        e = self.entity(name)
        if e.items is not None:
            self._validate(e.items, {field_name: index})
        e.indices[field_name] = index
        if e.store:
            e.store.declare(field_name, index)

    @staticmethod
    def _validate(items: DataFrame, indices: dict[str, Index]) -> None:
        for f, i in indices.items():
            if f in items.columns and not i.accepts(items.schema[f].dataType):
                raise InvalidInput(f"{f!r} is {items.schema[f].dataType.simpleString()}, which a {i.name} index doesn't take")

    def store_deltas(self, name: str, date: dt.date | str, changes: Iterable[D.Change], branch: int | None = None) -> None:
        """Keep changes under a branch (None: main) and a date; later ones win within a date too."""
        e = self.entity(name)
        scope = Scope(dt.date.fromisoformat(date) if isinstance(date, str) else date, branch)
        rows = D.rows_of(changes, scope, e.indices, e.seq)
        if rows:
            self.attach_deltas(name, self.spark.createDataFrame(rows, D.SCHEMA), len(rows))

    def attach_deltas(self, name: str, deltas: DataFrame, count: int = 0) -> None:
        """Append a table of the deltas' schema, of any size. Its seq is taken as it is; count: by how many seq goes on."""
        e = self.entity(name)
        new = deltas.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in D.SCHEMA.split(", ")])
        if e.store:
            e.store.append_deltas(new, count)
            e.deltas, e.seq = e.store.deltas(), e.store.meta["seq"]
        else:
            e.deltas = new if e.deltas is None else e.deltas.union(new)
            e.seq += count

    # Reads. Unknown entities, and those without items, have no items and no facets.
    def _nothing(self, schema: str = "id long") -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _hit(self, e: Entity, items: DataFrame, q: Query):
        return lower(q.filter, e.indices, items.schema) if q.filter is not None else F.lit(True)

    def hits(self, query: Query | str) -> DataFrame:
        q = Query.parse(query) if isinstance(query, str) else query
        e = self.entities.get(q.entity)
        if e is None or e.items is None:
            return self._nothing()
        if q.filter is not None and e.overlaid(q.scope):
            return D.overlaid_hits(e.items, e.id_column, e.deltas, q.scope, e.indices, lambda items: self._hit(e, items, q))
        items = e.view(q.scope)
        return items.where(self._hit(e, items, q)) if q.filter is not None else items

    def get(self, name: str, *ids: int, scope: Scope | None = None) -> DataFrame:
        """The items of some ids, by rising id; unknown ids are left out. The ids reach the scan as a filter."""
        e = self.entities.get(name)
        if e is None or e.items is None:
            return self._nothing()
        return e.view(scope).where(F.col(f"`{e.id_column}`").isin([int(i) for i in ids])).orderBy(f"`{e.id_column}`")

    def query(self, query: Query | str) -> DataFrame:
        q = Query.parse(query) if isinstance(query, str) else query
        e = self.entities.get(q.entity)
        if e is None or e.items is None:
            return self._nothing()
        if q.sort and q.sort.field not in e.indices:
            raise MissingIndex(f"no index on {q.sort.field!r}")
        return paged(ordered(self.hits(q), e.id_column, q.sort, e.indices), q.page)

    def options(self, query: Query | str) -> DataFrame:
        """(field, value, count), a row for each value of each declared field but dates."""
        q = Query.parse(query) if isinstance(query, str) else query
        e = self.entities.get(q.entity)
        if e is None or e.items is None:
            return self._nothing("field string, value string, count long")
        items = e.view(q.scope)
        return facets(items, self._hit(e, items, q), e.indices)

    def option_maps(self, query: Query | str) -> DataFrame:
        """(field, values): the same as one map a field, date fields with an empty one; a field of very many values is several rows, each value in one."""
        q = Query.parse(query) if isinstance(query, str) else query
        e = self.entities.get(q.entity)
        return rolled(self.options(q), e.indices) if e and e.indices else self._nothing("field string, values map<string,bigint>")
