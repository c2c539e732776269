"""Standing filters over a stream of items, and a stream as the writer of an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..engine import Engine
from ..operators.predicates import lower
from ..plans.filters import Filter
from ..types import Index


def watch(items: DataFrame, f: Filter, indices: dict[str, Index]) -> DataFrame:
    """The items of a stream that a filter takes: a stateless plan of the same expressions as a search."""
    return items.where(lower(f, indices, items.schema))


def feed(engine: Engine, name: str, items: DataFrame) -> DataStreamWriter:
    """A writer that upserts each micro-batch into an entity; ids are unique within a batch. Start it with a checkpoint location.

    A batch that is run again after a failure upserts the same items, so the result is the same.
    """
    return items.writeStream.foreachBatch(lambda batch, _: engine.add(name, batch))
