"""Benchmark decontamination by greedy string tiling.

Words are runs of ASCII letters and digits and of all non-ASCII characters, lower-cased. Seeds are the Karp-Rabin
hashes of all windows of MIN_TILE words. A Bloom filter of the benchmark's seeds, of bounded size whatever the benchmark's,
picks the texts that may share one; their seeds are joined with the benchmark's by a shuffled equi-join. For each pair of
text and item that shares a seed, the longest matches are marked repeatedly, each word of either side at most once, until
no match of MIN_TILE words is left. An item is contained if tiles cover at least COVERAGE of its words, in any order.

Null and empty texts hold nothing. Null items and items without a word are in no text. An item of fewer than MIN_TILE words,
which in a longer text can't be told from chance, is contained in texts of the same words and no others. Repeated rows are judged alike, each for itself; rows that share an id but not the text are judged by their own
texts. Ties go to the smaller item id. Empty tables give an empty result, or one without hits. Other columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import materialize, small_batches, table
from .tokens import ALNUM, P, P_INV, U, Words, slices

MIN_TILE, COVERAGE = 5, 0.5
#: Pairs of equal windows of a text and an item that are listed; where there are more, tiles are found without a list.
MOST_PAIRS = 1 << 20
#: The filter takes BITS_A_SEED bits a seed up to MOST_BITS (8 MB); beyond, it lets more through, and the join decides.
BITS_A_SEED, MOST_BITS, PROBES = 32, 1 << 26, 3


def matches(dw: np.ndarray, iw: np.ndarray, k: int) -> list[tuple[int, int, int]] | None:
    """Maximal common runs (-length, doc position, item position) of k words or more; dw, iw: hashes of the windows. None: too many pairs."""
    order = np.argsort(dw, kind="stable")
    ranked = dw[order]
    lo, hi = np.searchsorted(ranked, iw, "left"), np.searchsorted(ranked, iw, "right")
    n = hi - lo
    if n.sum() > MOST_PAIRS:
        return None
    j = np.repeat(np.arange(len(iw)), n)
    i = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    sort = np.lexsort((j, i - j))
    i, j = i[sort], j[sort]
    if not len(i):
        return []
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(i - j) != 0) | (np.diff(j) != 1)]))
    lengths = np.diff(np.append(starts, len(i))) + k - 1
    return list(zip((-lengths).tolist(), i[starts].tolist(), j[starts].tolist(), strict=True))


def tiles(doc: np.ndarray, item: np.ndarray, dw: np.ndarray, iw: np.ndarray, k: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """(length, doc position, item position) of the tiles, longest first, ties to the earlier in doc, then item."""
    heap = matches(dw, iw, k)
    if heap is None:
        return rounds(doc, item, k)
    heapq.heapify(heap)
    used_doc, used_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    while heap:
        length, i, j = heapq.heappop(heap)
        length = -length
        taken = used_doc[i : i + length] | used_item[j : j + length]
        if not taken.any():
            used_doc[i : i + length] = used_item[j : j + length] = True
            out.append((length, i, j))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= k:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def rounds(doc: np.ndarray, item: np.ndarray, k: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """The same tiles in memory linear in the words, for sides that repeat themselves: round by round, the longest length at
    which unmarked windows still match, found by bisection of running hashes, and all tiles of that length."""
    size = max(len(doc), len(item)) + 1
    up, down = (np.multiply.accumulate(np.concatenate([[U(1)], np.full(size, U(b))])) for b in (P, P_INV))
    sums = [np.concatenate([[U(0)], np.cumsum((x | U(1)) * up[: len(x)])]) for x in (doc, item)]
    free = [np.ones(len(x), bool) for x in (doc, item)]

    def windows(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        taken = np.concatenate([[0], np.cumsum(~free[side])])
        at = np.flatnonzero(taken[n:] == taken[:-n]) if n < len(taken) else np.zeros(0, np.int64)
        return at, (sums[side][at + n] - sums[side][at]) * down[at]

    def common(n: int) -> np.ndarray:
        return np.intersect1d(windows(0, n)[1], windows(1, n)[1])

    out = []
    high = min(len(doc), len(item))
    while high >= k:
        low, top = k - 1, high
        while low < top:
            mid = (low + top + 1) // 2
            low, top = (mid, top) if len(common(mid)) else (low, mid - 1)
        high = low
        if high < k:
            break
        both = common(high)
        places: dict[int, list[int]] = {}
        for j, h in zip(*(x[::-1].tolist() for x in windows(1, high)), strict=True):
            places.setdefault(h, []).append(j)
        at, hashes = windows(0, high)
        live = np.isin(hashes, both)
        for i, h in zip(at[live].tolist(), hashes[live].tolist(), strict=True):
            if not free[0][i] or not free[0][i + high - 1]:
                continue
            stack = places[h]
            while stack and not (free[1][stack[-1]] and free[1][stack[-1] + high - 1]):
                stack.pop()
            if stack:
                j = stack.pop()
                free[0][i : i + high] = free[1][j : j + high] = False
                out.append((high, i, j))
        high -= not len(common(high))
    return out


def probes(h: np.ndarray, bits: int):
    for i in range(PROBES):
        yield ((h + U(i) * ((h >> U(32)) | U(1))) & U(bits - 1)).astype(np.int64)


def seeds_of(items: DataFrame) -> DataFrame:
    """(item, h) of each distinct window."""

    def cut(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                words = Words(batch.column("text").slice(a, b - a), ALNUM)
                at, h = words.windows(MIN_TILE, short=True)
                yield pa.RecordBatch.from_arrays([batch.column("item").slice(a, b - a).take(pa.array(words.doc[at])), pa.array(h.view(np.int64))], ["item", "h"])

    return items.mapInArrow(cut, "item long, h long").distinct()


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """The Bloom filter, as bytes of bits. Each task sends its share once, MOST_BITS / 8 bytes at most."""
    bits = 1 << max(13, min(MOST_BITS.bit_length() - 1, int(seeds.count() * BITS_A_SEED).bit_length()))

    def build(batches):
        own = np.zeros(bits, bool)
        for batch in batches:
            for slot in probes(batch.column("h").to_numpy().view(U), bits):
                own[slot] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(own).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(bits // 8, np.uint8)
    for row in seeds.select("h").coalesce(8).mapInArrow(build, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def row_key(docs: DataFrame, key: str, text: str):
    """128 bits of id and text, null told from empty."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), docs[c].cast("string")), F.lit("-"))
    return F.md5(F.concat(part(key), F.lit("/"), part(text)))


def sharing(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(k, text) -> (k, text, hits: distinct seeds that pass the filter) of texts with any."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def probe(batches):
        has = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                words = Words(part.column("text"), ALNUM)
                at, h = words.windows(MIN_TILE, short=True)
                ok = np.ones(len(h), bool)
                for slot in probes(h, len(has)):
                    ok &= has[slot]
                if not ok.any():
                    continue
                doc, h = words.doc[at[ok]], h[ok]
                rows = np.unique(doc)
                lists = [np.unique(h[doc == r]).view(np.int64) for r in rows]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([part.column("k").take(take), part.column("text").take(take), pa.array(lists, pa.list_(pa.int64()))], ["k", "text", "hits"])

    return docs.mapInArrow(probe, "k string, text string, hits array<long>")


def tiled(pairs: DataFrame) -> DataFrame:
    """(k, text, item, item_text) -> (k, item, covered, words, tiles)."""

    def tile(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for a, b in slices(batch.column("text")):
                sides = [Words(batch.column(c).slice(a, b - a), ALNUM) for c in ("text", "item_text")]
                wins = [w.windows(MIN_TILE, short=True) for w in sides]
                cuts = [np.searchsorted(w.doc[at], np.arange(b - a + 1)) for w, (at, _) in zip(sides, wins, strict=True)]
                for r in range(b - a):
                    one = [(w.hash[w.first[r] : w.first[r] + w.count[r]], h[c[r] : c[r + 1]]) for w, (_, h), c in zip(sides, wins, cuts, strict=True)]
                    short = min(len(x) for x, _ in one) < MIN_TILE
                    found = [(len(one[0][0]), 0, 0)] * np.array_equal(one[0][0], one[1][0]) if short else tiles(one[0][0], one[1][0], one[0][1], one[1][1])
                    out[0].append(sum(x[0] for x in found))
                    out[1].append(len(one[1][0]))
                    out[2].append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("item"), *(pa.array(x, pa.int64()) for x in out)], ["k", "item", "covered", "words", "tiles"])

    return pairs.select("k", "text", "item", "item_text").mapInArrow(tile, "k string, item long, covered long, words long, tiles long")


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(k, item, covered, words, tiles) of every pair of a text (k: row_key) and an item that share a seed."""
    small_batches(docs.sparkSession)
    items = items.select(F.col(item).cast("long").alias("item"), F.lower(F.col(item_text).cast("string")).alias("text")).where("text is not null")
    seeds = materialize(seeds_of(items))
    texts = docs.select(row_key(docs, key, text).alias("k"), F.lower(F.col(text).cast("string")).alias("text"))
    hits = materialize(sharing(texts, seed_filter(seeds)).dropDuplicates(["k"]))
    pairs = hits.select("k", F.explode("hits").alias("h")).join(seeds, "h").select("k", "item").distinct()
    whole = items.select(F.col("item"), F.col("text").alias("item_text"))
    return tiled(pairs.join(whole, pairs["item"].eqNullSafe(whole["item"])).drop(whole["item"]).join(hits.select("k", "text"), "k"))


def judged(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, **columns) -> DataFrame:
    """(k, item_id, coverage, n_items) of the rows that hold an item: the one covered best, and how many are."""
    found = overlaps(docs, items, **columns).withColumn("coverage", F.col("covered") / F.col("words")).where(F.col("coverage") >= coverage)
    best = F.min(F.struct(-F.col("coverage"), F.col("item")))
    return found.groupBy("k").agg(best.alias("best"), F.count_distinct("item").alias("n_items")).select("k", F.col("best.item").alias("item_id"), (-F.col("best.col1")).alias("coverage"), "n_items")


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that hold a benchmark item."""
    bad = judged(docs, items, key=key, text=text).select("k")
    return docs.join(bad, row_key(docs, key, text) == bad["k"], "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, contaminated, item_id and coverage of the item covered best (null and 0 if none is contained), n_items contained."""
    docs = table(spark, sf_dir, "documents")
    found = judged(docs, table(spark, sf_dir, "benchmark"))
    each = docs.select("doc_id", row_key(docs, "doc_id", "text").alias("k")).join(found, "k", "left")
    return each.select("doc_id", F.col("coverage").isNotNull().alias("contaminated"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))
