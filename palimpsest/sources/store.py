"""Entities on shared storage: Parquet items in buckets of ids, Parquet deltas by branch, and one small file of metadata.

    <root>/<entity>/items/<write>/<bucket column>=<k>/...     <root>/<entity>/deltas/write=<write>/branch_key=<b>/...
    <root>/<entity>/meta/<version>

A write goes to a folder of its own and rewrites only the buckets that hold its ids; then it publishes a metadata file that
names each bucket's folder and the deltas' folders. Readers see the old or the new state, never a mixture, and folders that no
metadata names (of writers that died) are never read. Who finds that another writer has published meanwhile reads the new state
and makes its change again on that, so no update is lost. That two writers don't take one version rests on the file system's
rename not replacing a file, as HDFS and its like have it. Only Spark's own readers and writers and the cluster's file-system
interface touch the storage, so any that Spark knows will do.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import column, fresh
from ..operators.deltas import SCHEMA
from ..operators.upsert import remove, upsert
from ..types import Index, from_json

#: A load takes a bucket for so many items, BUCKETS at least; a bucket is written by up to FILES tasks, fewer where they would be small.
BUCKETS, ITEMS_A_BUCKET, FILES = 64, 1_000_000, 16
#: Tries to publish a change.
TRIES = 20


class Store:
    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int | None = None):
        self.spark, self.name, self.path, self.fixed = spark, name, f"{root.rstrip('/')}/{name}", buckets
        self.meta = {"version": 0, "buckets": buckets or BUCKETS, "bucket": "__bucket", "at": {}, "schema": None, "id": "id", "indices": {}, "seq": 0, "deltas": []}

    # The file system, by Spark's own interface.
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _ls(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    @staticmethod
    def entities(spark: SparkSession, root: str) -> list[str]:
        return sorted(n for n in Store(spark, root, "")._ls(root) if Store(spark, root, n)._versions())

    def _versions(self) -> list[int]:
        return sorted(int(v) for v in self._ls(f"{self.path}/meta") if v.isdecimal())

    def open(self) -> Store:
        versions = self._versions()
        if versions:
            self.meta = json.loads(self.spark.read.text(f"{self.path}/meta/{versions[-1]}", wholetext=True).first()[0])
        return self

    def change(self, make: Callable[[dict], None]) -> None:
        """Apply make to the metadata and publish it; where another writer came first, again on what that one left."""
        for _ in range(TRIES):
            meta = copy.deepcopy(self.meta)
            make(meta)
            meta["version"] += 1
            if self._published(meta):
                self.meta = meta
                return
            self.open()
        raise RuntimeError(f"other writers changed {self.name!r} {TRIES} times meanwhile")

    def _published(self, meta: dict) -> bool:
        """Write the metadata under its version: the file appears at once, and only if nobody else took the number."""
        fs, p = self._fs(f"{self.path}/meta/{meta['version']}")
        draft = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta/_{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(meta), "utf-8"))
        out.close()
        if not fs.exists(p) and fs.rename(draft, p):
            return True
        fs.delete(draft, False)
        return False

    @property
    def indices(self) -> dict[str, Index]:
        return {k: from_json(v) for k, v in self.meta["indices"].items()}

    def _bucket(self, id_column: str, meta: dict):
        return F.pmod(F.xxhash64(column(id_column).cast("long")), F.lit(meta["buckets"])).cast("int")

    def items(self, meta: dict | None = None, only: list[int] | None = None) -> DataFrame | None:
        """All items, or those of some buckets; None before the first write. One scan of the buckets' folders."""
        meta = meta or self.meta
        if not meta["schema"]:
            return None
        schema = T.StructType.fromJson(meta["schema"])
        at = {int(k): v for k, v in meta["at"].items() if only is None or int(k) in only}
        paths = [f"{self.path}/items/{v}" for _, v in sorted(at.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, meta: dict, items: DataFrame, id_column: str) -> None:
        write = uuid.uuid4().hex
        bucket, part = fresh(items, "__bucket", "__part")
        out = items.withColumn(bucket, self._bucket(id_column, meta)).withColumn(part, F.pmod(F.xxhash64(column(id_column), F.lit("part")), F.lit(FILES)))
        out.repartition(bucket, part).drop(part).write.partitionBy(bucket).parquet(f"{self.path}/items/{write}")
        written = [x for x in self._ls(f"{self.path}/items/{write}") if x.startswith(f"{bucket}=")]
        meta["schema"], meta["id"] = json.loads(items.schema.json()), id_column
        meta["at"] |= {x.split("=")[1]: f"{write}/{x}" for x in written}

    def replace(self, items: DataFrame, id_column: str) -> None:
        """All items anew; declarations go with the old ones, deltas stay."""
        buckets = self.fixed or max(BUCKETS, -(-items.count() // ITEMS_A_BUCKET))

        def make(meta: dict) -> None:
            meta |= {"at": {}, "indices": {}, "buckets": buckets}
            self._write(meta, items, id_column)

        self.change(make)

    def touched(self, ids: DataFrame, id_column: str, meta: dict) -> list[int]:
        """The buckets of the ids: as many numbers as there are buckets at most."""
        return [r[0] for r in ids.select(self._bucket(id_column, meta)).distinct().collect()]

    def upsert(self, new: DataFrame, id_column: str) -> None:
        def make(meta: dict) -> None:
            old = self.items(meta, self.touched(new, id_column, meta))
            self._write(meta, new if old is None else upsert(old, new, id_column), id_column)

        self.change(make)

    def remove(self, ids: DataFrame, id_column: str) -> None:
        def make(meta: dict) -> None:
            buckets = self.touched(ids, id_column, meta)
            old = self.items(meta, buckets)
            if old is not None:
                for b in buckets:
                    meta["at"].pop(str(b), None)
                self._write(meta, remove(old, ids, id_column), id_column)

        self.change(make)

    def clear(self) -> None:
        self.change(lambda meta: meta.update({"at": {}, "schema": None, "indices": {}}))

    def declare(self, field: str, index: Index) -> None:
        self.change(lambda meta: meta["indices"].update({field: index.to_json()}))

    def deltas(self) -> DataFrame:
        if not self.meta["deltas"]:
            return self.spark.createDataFrame([], SCHEMA)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/deltas").parquet(*[f"{self.path}/deltas/write={w}" for w in self.meta["deltas"]]).select(*names)

    def append_deltas(self, rows: DataFrame, count: int) -> None:
        """Deltas in a folder of their own, read once the metadata names it. count: of rows numbered from this store's seq, which go on from another writer's where one came first."""
        planned = self.meta["seq"]

        def make(meta: dict) -> None:
            write = uuid.uuid4().hex
            shifted = rows.withColumn("seq", F.col("seq") + (meta["seq"] - planned)) if count else rows
            shifted.write.partitionBy("branch_key").parquet(f"{self.path}/deltas/write={write}")
            meta["deltas"].append(write)
            meta["seq"] += count

        self.change(make)
