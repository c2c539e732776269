"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Each vector is scaled by its largest component, normalised, rotated by a seeded orthogonal matrix and kept as one sign bit a
dimension, packed in 64-bit words, with two correction scalars: its norm, and the inner product of code and rotated vector. The
rotated query is rounded to QUERY_BITS bits a dimension, kept as bit planes, so that its inner product with a code is a weighted
sum of popcounts of ANDed words. From that and the scalars an unbiased estimate of any inner product follows, with an error
bound. Every row is coded; nothing is fitted to the data.

Queries are compared with all rows in blocks: the queries are dealt by a hash into blocks of QUERY_BYTES at most on average, one
block is broadcast at a time, and each task goes over its rows, which never move, in blocks of ROWS_A_BLOCK. Every row whose upper
bound reaches the k-th best exact value so far is reranked by the exact inner product in double precision. The best k of each
task are merged by a bounded top-k per query. The number of passes grows with the queries, as all pairs are to be compared.

Null, empty and zero vectors, and vectors with null or non-finite components, take no part; null ids neither. Vectors of another
dimension than the query's are no candidates of it. Components may be of any finite size: where an inner product overflows or
vanishes, so does the score, and one that overflows both ways counts as -inf. Rows sharing an id are rows of their own, as queries and as candidates: a query's own row alone is
no candidate of it. Ties go to the smaller id. Empty tables give an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import materialize, small_batches, table

ROWS_A_BLOCK, QUERY_BYTES, QUERY_BITS = 8192, 32 << 20, 6
#: A task goes over so many rows at least where there are more tasks than cores, so that its results are few beside its rows.
ROWS_A_TASK = 1 << 20
#: Standard deviations of the estimate that the bound spans.
WIDTH = 3.5
U = np.uint64


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of finite ones that aren't zero, of any size, and their norms."""
    top = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / top
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    with np.errstate(over="ignore"):
        return vectors / norm, (norm * top)[:, 0]


def packed(bits: np.ndarray) -> np.ndarray:
    """(rows, dim) booleans as (rows, words) of 64 bits."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(U)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of sign bits, norm, and inner product of the unit code with the unit vector, of each row."""
    plain, norm = unit(vectors)
    turned = plain @ turn
    return packed(turned >= 0), norm, np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


class Queries:
    """Queries of one dimension, with the best k rows found so far."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.uid, self.ids, self.vectors, self.k = uid, ids, vectors, k
        n, dim = vectors.shape
        plain, self.norm = unit(vectors)
        turned = plain @ rotation(dim)
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << QUERY_BITS) - 1), 1e-300)
        levels = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = np.stack([packed((levels >> b) & 1 == 1) for b in range(QUERY_BITS)], axis=1)
        near = self.low[:, None] + self.step[:, None] * levels
        self.total, self.off = near.sum(axis=1), np.abs(turned - near).sum(axis=1) / np.sqrt(dim)
        self.best_ids, self.best = [np.zeros(0, np.int64)] * n, [np.zeros(0)] * n

    def estimate(self, i: int, words: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of the unit query i and unit codes; words: (words, rows), ones: the codes' bits that are set."""
        total = np.zeros(words.shape[1], np.int64)
        for b in range(QUERY_BITS):
            for w, plane in zip(words, self.planes[i, b], strict=True):
                total += np.bitwise_count(w & plane).astype(np.int64) << b
        return (2 * (self.low[i] * ones + self.step[i] * total) - self.total[i]) / np.sqrt(self.vectors.shape[1])

    def take(self, uid: np.ndarray, ids: np.ndarray, vectors: np.ndarray, words: np.ndarray, norm: np.ndarray, fit: np.ndarray) -> int:
        """Go over a block of rows; how many were reranked."""
        dim, again = vectors.shape[1], 0
        words = np.ascontiguousarray(words.T)
        ones = np.bitwise_count(words).sum(axis=0, dtype=np.int64)
        spread = WIDTH * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(dim - 1, 1)) + 1e-9
        own = dict(zip(uid.tolist(), range(len(uid)), strict=True))
        with np.errstate(over="ignore", invalid="ignore", under="ignore"):
            for i in range(len(self.uid)):
                guess = self.estimate(i, words, ones) / fit
                least = self.best[i][-1] if len(self.best[i]) == self.k else None
                mine = own.get(int(self.uid[i]))
                if least is None:  # a first bound from the rows with the best estimates
                    row = guess * norm
                    if mine is not None:
                        row[mine] = -np.inf
                    n = min(self.k, len(row) - (mine is not None))
                    first = np.argpartition(row, len(row) - n)[len(row) - n :] if n else np.zeros(0, np.int64)
                    scores = np.einsum("ij,j->i", vectors[first], self.vectors[i])
                    least = scores.min() if n == self.k and not np.isnan(scores).any() else -np.inf
                upper = (guess + spread + self.off[i] / fit) * norm * self.norm[i]
                at = np.flatnonzero(~(upper < least))
                if mine is not None:
                    at = at[at != mine]
                again += len(at)
                scores = np.einsum("ij,j->i", vectors[at], self.vectors[i])
                ids_, all_ = np.concatenate([self.best_ids[i], ids[at]]), np.concatenate([self.best[i], np.where(np.isnan(scores), -np.inf, scores)])
                top = best(ids_, all_, self.k)
                self.best_ids[i], self.best[i] = ids_[top], all_[top]
        return again


def vectors_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(uid, id, v, dim) of the rows that take part."""
    v = F.col("v")
    plain = df.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    plain = plain.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    return plain.withColumn("dim", F.size("v"))


def coded(rows: DataFrame) -> DataFrame:
    def code(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                words, norm, fit = encode(vectors_of(part.column("v"), int(dim)), rotation(int(dim)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("uid", "id", "v", "dim")), pa.array([w.tobytes() for w in words], pa.binary()), pa.array(norm), pa.array(fit)], ["uid", "id", "v", "dim", "code", "norm", "fit"])

    return rows.mapInArrow(code, "uid long, id long, v array<double>, dim int, code binary, norm double, fit double")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def compared(index: DataFrame, asks: DataFrame, k: int) -> DataFrame:
    """(asks, query_id, id, score): each task's best k of its rows for each query; asks: a block of queries, of bounded size."""
    t = asks.select("uid", "id", "dim", "v").toArrow().combine_chunks()
    dims = t.column("dim").to_numpy()
    groups = []
    for dim in np.unique(dims).tolist():
        part = t.filter(pa.array(dims == dim)).combine_chunks()
        groups.append((part.column("uid").to_numpy(), part.column("id").to_numpy(), vectors_of(part.column("v").combine_chunks(), dim)))
    shared = index.sparkSession.sparkContext.broadcast(groups)

    def search(batches):
        queries = {vectors.shape[1]: Queries(uid, ids, vectors, k) for uid, ids, vectors in shared.value}
        held: dict[int, list] = {}

        def spend(dim: int) -> None:
            t = pa.Table.from_batches(held.pop(dim)).combine_chunks()
            words = np.frombuffer(b"".join(t.column("code").to_pylist()), U).reshape(len(t), -1)
            queries[dim].take(t.column("uid").to_numpy(), t.column("id").to_numpy(), vectors_of(t.column("v").combine_chunks(), dim), words, t.column("norm").to_numpy(), t.column("fit").to_numpy())

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in queries:
                    held.setdefault(dim, []).append(batch.filter(pa.array(dims == dim)))
                    if sum(map(len, held[dim])) >= ROWS_A_BLOCK:
                        spend(dim)
        for dim in list(held):
            spend(dim)
        for q in queries.values():
            sizes = [len(x) for x in q.best]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q.uid, sizes)), pa.array(np.repeat(q.ids, sizes)), pa.array(np.concatenate(q.best_ids)), pa.array(np.concatenate(q.best))], ["asks", "query_id", "id", "score"])

    return index.mapInArrow(search, "asks long, query_id long, id long, score double")


def search(df: DataFrame, key: str, vector: str, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest rows of each row for which the column is_query, of the id, holds."""
    spark = df.sparkSession
    small_batches(spark)
    index = materialize(coded(usable(df, key, vector)))
    asks = index.where(is_query(F.col("id")))
    rows = index.coalesce(max(spark.sparkContext.defaultParallelism, -(-index.count() // ROWS_A_TASK)))
    size = asks.agg(F.sum(F.col("dim").cast("long") * 8 + 16)).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    block = F.pmod(F.xxhash64("uid"), F.lit(blocks))
    found = [compared(rows, asks.where(block == b), k) for b in range(blocks)]
    found = found[0] if blocks == 1 else reduce(DataFrame.union, [materialize(x) for x in found])
    rank = F.row_number().over(Window.partitionBy("query_id", "asks").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 20 == 0, 20)
