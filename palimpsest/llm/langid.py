"""Language identification by language-bitmask n-gram filters.

Character trigrams of letters (words padded by a space, lower case) are counted by language over whole training texts, of
about TRAIN_ROWS rows of each language that a hash of the text picks (all, if there are fewer). A language's filter holds
the trigrams whose relative frequency in it is at least LEAST_RATE, so at most 1 / LEAST_RATE of them, and at least half
of the highest that any language has. The languages' Bloom filters are kept bit-sliced: one
array of words with one bit a language, so that ANDing a few entries returns at once all languages that contain an
n-gram. A text's n-grams are counted by language; each count is corrected for the filter's rate of false positives, which
follows from its fill, and the language with the largest count wins, ties going to the language seen more in training and
then by code point. The score is the winner's share of the corrected counts.

Null texts and texts without a letter give `und` and score 0; so does any text where nothing could be learned. A text
with letters none of whose n-grams is known gets the language seen most in training, with score 0. Any number
of languages is possible (one 64-bit word an entry for each 64). Whole texts are used, in training and prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .runtime import crc_fold, fresh, materialize, small_batches, table
from .tokens import U, mixed, slices

LENGTH = 3
LEAST_RATE = 2e-5
#: Bound on the rows of one language that filters are learned from.
TRAIN_ROWS = 5000
HASHES = 3
BITS_AN_ENTRY = 16

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point -> lower-case letter, 0 for what is no letter."""
    if not _letters:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash) of every trigram of the texts, in order; letters of each row."""
    texts = pc.fill_null(column.cast(pa.large_string()), "").to_pylist()
    points = np.frombuffer(("\x00" + "\x00\x00".join(texts) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    low = letters()[points]
    # Runs of what is no letter shrink to one 0, which pads words.
    keep = low > 0
    keep[1:] |= low[:-1] > 0
    keep[0] = True
    kept = np.cumsum(keep)
    edge = np.cumsum(lengths + 2) - lengths - 1  # where each text begins
    low = low[keep].astype(U)
    starts = kept[edge - 1]
    count = np.add.reduceat(np.append(low > 0, False).astype(np.int64), starts) if len(texts) else np.zeros(0, np.int64)
    count[lengths == 0] = 0
    a, b, c = low[:-2], low[1:-1], low[2:]
    at = np.flatnonzero((b > 0)) if len(low) > 2 else np.zeros(0, np.int64)
    row = np.searchsorted(starts, at + 1, "right") - 1
    return row, mixed((a[at] << U(42)) | (b[at] << U(21)) | c[at]), count


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, text) -> (lang, gram, n), each task's counts summed before the shuffle."""

    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                hashes, sums = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                keys, inverse = np.unique(hashes, return_inverse=True)
                n = np.bincount(inverse, weights=sums).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            for a, b in slices(batch.column("text")):
                row, h, _ = grams(batch.column("text").slice(a, b - a))
                names, code = np.unique(langs[a:b].astype(str), return_inverse=True)
                of = code[row]
                for i, name in enumerate(names):
                    keys, n = np.unique(h[of == i], return_counts=True)
                    held.setdefault(str(name), []).append((keys, n))
                    size += len(keys)
                if size > 2_000_000:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Filters:
    """Bit-sliced Bloom filters of all languages; langs in order of preference."""

    def __init__(self, langs: list[str], entries: list[tuple[np.ndarray, int]]):
        self.langs = langs
        total = sum(len(g) for g, _ in entries)
        self.size = 1 << max(10, int(np.ceil(np.log2(max(1, total) * BITS_AN_ENTRY))))
        self.masks = np.zeros((self.size, max(1, -(-len(langs) // 64))), U)
        for g, i in entries:
            for slot in self.slots(g):
                self.masks[slot, i // 64] |= U(1 << (i % 64))
        fill = np.array([np.count_nonzero(self.masks[:, i // 64] & U(1 << (i % 64))) for i in range(len(langs))]) / self.size
        self.false = fill**HASHES

    def slots(self, g: np.ndarray):
        second = (g >> U(32)) | U(1)
        for j in range(HASHES):
            yield ((g + U(j) * second) & U(self.size - 1)).astype(np.int64)

    def counts(self, row: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
        """(n, languages) corrected numbers of the n-grams that each language contains."""
        found = None
        for slot in self.slots(g):
            hit = self.masks[slot]
            found = hit if found is None else found & hit
        total = np.bincount(row, minlength=n)
        first = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else row
        have = row[first]
        out = np.zeros((n, len(self.langs)))
        for i in range(len(self.langs)):
            bit = (found[:, i // 64] >> U(i % 64)) & U(1)
            seen = np.zeros(n)
            if len(row):
                seen[have] = np.add.reduceat(bit.astype(np.int32), first)
            out[:, i] = np.maximum(0, (seen - total * self.false[i]) / max(1e-9, 1 - self.false[i]))
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        row, g, count = grams(column)
        n = len(column)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        c = self.counts(row, g, n)
        best, total = c.argmax(axis=1), c.sum(axis=1)
        score = np.where((count > 0) & (total > 0), c[np.arange(n), best] / np.maximum(total, 1e-9), 0.0)
        return [self.langs[b] if k else "und" for b, k in zip(best.tolist(), count.tolist(), strict=True)], score


def learn(rows: DataFrame) -> Filters:
    """Filters from (lang, text). What is collected is bounded: 1 / LEAST_RATE trigrams a language."""
    small_batches(rows.sparkSession)
    picked = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    many = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect() if r["count"] > TRAIN_ROWS}
    share = F.lit(1.0)
    for lang, n in sorted(many.items()):
        share = F.when(F.col("lang") == lang, TRAIN_ROWS / n).otherwise(share)
    counts = materialize(gram_counts(rows.where(picked < share)))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total")).where(F.col("rate") >= LEAST_RATE)
    peak = rated.groupBy("gram").agg(F.max("rate").alias("peak"))
    kept = rated.join(peak, "gram").where(F.col("rate") >= F.col("peak") / 2).groupBy("lang").agg(F.collect_list("gram").alias("grams"))
    known = {r.lang: r.total for r in totals.collect()}
    langs = sorted(known, key=lambda x: (-known[x], x))
    found = {r.lang: np.array(r.grams, np.int64).view(U) for r in kept.collect()}
    return Filters(langs, [(np.sort(found[x]), i) for i, x in enumerate(langs) if x in found])


def identify(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (prefixed by _ where docs has such columns). Batches go through Arrow; columns pass untouched."""
    small_batches(docs.sparkSession)
    names = fresh(docs, "lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def predict(batches):
        for batch in batches:
            for a, b in slices(batch.column(text)):
                part = batch.slice(a, b - a)
                lang, score = shared.value.predict(part.column(text))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*part.schema.names, *names])

    return docs.mapInArrow(predict, StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())]))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_fold("doc_id", 3) == 1
    filters = learn(docs.where(~held & F.col("lang").isNotNull()).select("lang", "text"))
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), filters).drop("text")
