"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialize

#: So many edges or fewer (16 MB) are closed in one task.
LOCAL_EDGES = 1_000_000


def closed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id of each one's component), by pointer jumping."""
    ids, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        for side in (label[x], label[y]):
            np.minimum.at(label, side, low)
        label = np.minimum(label, label[label])
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            return ids, ids[label]


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (id, class) of every id that has a link; class is the component's smallest id.

    Alternating large-star and small-star steps, joins and partial aggregates all, rewire edges to the smallest neighbour
    until nothing changes, a logarithmic number of rounds. A list of at most LOCAL_EDGES edges, at first or after a round, is
    closed by one task, whose memory that count bounds.
    """
    edges = links.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    edges = materialize(edges)
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
    seen = mark(edges)
    while seen[0] > LOCAL_EDGES:
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        edges = materialize(small.where("u <> v").distinct())
        now = mark(edges)
        if now == seen:
            top = edges.groupBy("u").agg(F.min("v").alias("class")).select(F.col("u").alias("id"), "class")
            return top.union(edges.select(F.col("v").alias("id"), F.col("v").alias("class")).distinct())
        seen = now

    def close(batches):
        parts = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
        if parts:
            ids, label = closed(*(np.concatenate(p) for p in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label)], ["id", "class"])

    return edges.coalesce(1).mapInArrow(close, "id long, class long")
