"""Near-duplicate documents by BagMinHash over word shingles.

A document is the multiset of its 5-word shingles (words: runs without ASCII white space, lower-cased; a text of one
to four words is one shingle of all). A shingle that occurs w times covers the weight interval [0, w), discretised into
dyadic pieces [0,1), [1,2), [2,4), ... Each piece carries a Poisson process of rate registers x length, drawn from the
shingle's hash; a point of a piece that is only partly covered descends into the piece by its own bits and counts if it
lands below w. Each point falls on one register, which keeps the earliest. Points are drawn in order of time and a
process ends once it is later than all registers of its document, so the work is about linear in the shingles.
Two documents agree in a register with a probability of exactly their weighted Jaccard similarity.

Signatures are cut into bands. Texts of equal words are merged first. In each bucket of a band all documents are compared
with one hub, by the exact multiset overlap of the whole texts. In buckets that then still span several classes all rows of
different classes are compared, in blocks of bounded size: signatures first, of which each block passes on a forest of possible links, then, in
the clusters that these connect, exact overlaps, of which each block passes on a forest of true links. So all rows of a
bucket meet that aren't in one class yet, while what is passed on stays linear; links are closed to classes.

Null texts and texts without a word are in no group; null ids have a null class. Rows that share an id are one document,
all of whose texts count. Repeated rows, ties and empty tables are fine. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .runtime import fresh, materialize, small_batches, table
from .tokens import U, Words, mixed, slices

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 4 registers miss a pair of similarity 0.8 with a probability of 5e-8.
BANDS, ROWS = 32, 4
REGISTERS = BANDS * ROWS
#: Five standard deviations of the estimate below SIMILARITY.
LEAST_MATCHES = int((SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / REGISTERS) ** 0.5) * REGISTERS)
#: Rows of a bucket that are compared in one block.
BLOCK = 256


def bag(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, count) of each distinct shingle of each text."""
    at, h = words.windows(k, short=True)
    keys = np.sort((words.doc[at].astype(U) << U(48)) | (h >> U(16)))
    if not len(keys):
        return np.zeros(0, np.int64), keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    return (keys >> U(48)).astype(np.int64), keys & U((1 << 48) - 1), count


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """(n, m) earliest points. The elements (doc, h) have integer weights from 1."""
    lowest = np.full(n * m, np.inf)
    top = np.floor(np.log2(np.maximum(weight, 1))).astype(np.int64)
    pieces = np.where(weight > 1, top + 2 - (weight == (1 << top)), 1)
    of = np.repeat(np.arange(len(h)), pieces)
    level = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    d, w, span = doc[of], weight[of], np.maximum(low, 1)
    seed = mixed(h[of] * U(0x9FB21C651E98DF25) + level.astype(U) * U(0xA0761D6478BD642F))
    t, drawn = np.zeros(len(of)), np.zeros(len(of), U)
    while len(seed):
        j = int(max(1, min(64, 20000 // len(seed))))
        step = drawn[:, None] + np.arange(1, j + 1, dtype=U)
        r = mixed(seed[:, None] + step * U(0x9E3779B97F4A7C15))
        wait = -np.log1p(-((r >> U(11)).astype(np.float64) * 2.0**-53)) / (m * span[:, None])
        time = t[:, None] + np.cumsum(wait, axis=1)
        r = mixed(r ^ U(0xE7037ED1A0B428DB))
        slot = d[:, None] * m + ((r >> U(32)) % U(m)).astype(np.int64)
        if (span > 1).any():
            lands = low[:, None] + ((r & U(0xFFFFFFFF)) % span[:, None].astype(U)).astype(np.int64) < w[:, None]
            np.minimum.at(lowest, slot[lands], time[lands])
        else:
            np.minimum.at(lowest, slot.ravel(), time.ravel())
        t, drawn = time[:, -1], drawn + U(j)
        live = np.flatnonzero(t <= lowest.reshape(n, m).max(axis=1)[d])
        seed, t, drawn, d, w, low, span = (x[live] for x in (seed, t, drawn, d, w, low, span))
    return lowest.reshape(n, m)


def bands_of(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (n, BANDS) as int64, and one byte a register."""
    bits = mixed(sig.view(U) * U(0x9E3779B97F4A7C15))
    part = bits.reshape(len(sig), BANDS, ROWS)
    key = np.zeros(part.shape[:2], U)
    for i in range(ROWS):
        key = mixed(key * U(0xD6E8FEB86659FD93) + part[:, :, i])
    return key.view(np.int64), (bits & U(255)).astype(np.uint8)


def signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, p, q: hashes of the word sequence, n: shingles, bands, sig) of the documents that have words."""

    def sign(batches):
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words = Words(batch.column(1).slice(a, b - a))
                doc, h, count = bag(words)
                size = b - a
                sig = signatures(doc, h, count, size)
                have = np.flatnonzero(words.count)
                place = np.arange(len(words.doc)) - words.first[words.doc]
                prints = []
                for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
                    each = mixed(words.hash * U(salt) + place.astype(U) * U(0x9E3779B97F4A7C15))
                    prints.append(np.add.reduceat(each, words.first[have]).view(np.int64) if len(have) else np.zeros(0, np.int64))
                keys, byte = bands_of(sig[have])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                n = np.bincount(doc, weights=count, minlength=size)[have].astype(np.int64)
                ids = batch.column(0).slice(a, b - a).take(pa.array(have))
                yield pa.RecordBatch.from_arrays([ids, pa.array(prints[0]), pa.array(prints[1]), pa.array(n), lists, pa.array([x.tobytes() for x in byte], pa.binary())], ["id", "p", "q", "n", "bands", "sig"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.lower(F.col(text).cast("string")).alias("text")).where("id is not null")
    return rows.mapInArrow(sign, "id long, p long, q long, n long, bands array<long>, sig binary")


def overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of the texts a[i] and b[i]."""
    sides = []
    for side in (a, b):
        doc, h, count = bag(Words(side))
        sides.append(((doc.astype(U) << U(48)) | h, count))
    total = np.zeros(len(a))
    for keys, count in sides:
        total += np.bincount((keys >> U(48)).astype(np.int64), weights=count, minlength=len(a))
    shared, i, j = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    common = np.bincount((shared >> U(48)).astype(np.int64), weights=np.minimum(sides[0][1][i], sides[1][1][j]), minlength=len(a))
    return common / np.maximum(total - common, 1)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose whole texts overlap enough, with the similarity."""

    def verify(batches):
        for batch in batches:
            for x, y in pair_slices(batch):
                part = batch.slice(x, y - x)
                jaccard = overlaps(part.column("ta"), part.column("tb"))
                keep = pa.array(np.flatnonzero(jaccard >= SIMILARITY))
                yield pa.RecordBatch.from_arrays([part.column("a").take(keep), part.column("b").take(keep), pa.array(jaccard).take(keep)], ["a", "b", "jaccard"])

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return both.mapInArrow(verify, "a long, b long, jaccard double")


def pair_slices(batch: pa.RecordBatch):
    yield from slices(batch.column("ta") if batch.column("ta").nbytes >= batch.column("tb").nbytes else batch.column("tb"))


def whole_groups(batches, keys: list[str]):
    """Groups of batches that are sorted by keys; a group may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if batch.num_rows > 1 else np.zeros(0, np.int64)
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cut.tolist(), batch.num_rows]
        for s, e in zip(edges, edges[1:], strict=False):
            if s and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def homes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of groups whose rows are in several classes: keys, home (the class of the most rows), n_home, n_rest. Counted by class first."""
    counts = rows.groupBy(*keys, "class").agg(F.count("*").alias("n"))
    every = counts.groupBy(*keys).agg(F.max_by("class", F.struct("n", "class")).alias("home"), F.max("n").alias("n_home"), F.sum("n").alias("n_all"), F.count("*").alias("k"))
    return every.where("k > 1").select(*keys, "home", "n_home", (F.col("n_all") - F.col("n_home")).alias("n_rest"))


def blocked(rest: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of groups, joined with homes(), dealt so that any two rows of different classes meet in a block (keys, kind, x, y) of about 2 * BLOCK rows at most.

    Rows of the home class need only meet the others: they go to one block for each BLOCK of those, so a large class
    with a few rows beside it costs about its own size. kind 0: home against others, 1: others among themselves.
    """
    at_home = F.col("class") == F.col("home")
    homes_, rests = F.ceil(F.col("n_home") / BLOCK), F.ceil(F.col("n_rest") / BLOCK)
    rest = rest.withColumn("at_home", at_home).withColumn("mine", F.pmod(F.xxhash64("id"), F.when(at_home, homes_).otherwise(rests)))
    cell = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.cast("long").alias("x"), y.cast("long").alias("y"))
    mine, upto = F.col("mine"), lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    home_cells = F.transform(upto(rests), lambda r: cell(0, r, mine))
    rest_cells = F.concat(F.transform(upto(homes_), lambda h: cell(0, mine, h)), F.transform(upto(rests), lambda r: cell(1, F.least(mine, r), F.greatest(mine, r))))
    rest = rest.withColumn("cell", F.explode(F.when(at_home, home_cells).otherwise(rest_cells)))
    rest = rest.select("*", "cell.kind", "cell.x", "cell.y").drop("mine", "cell", "home", "n_home", "n_rest")
    return rest.repartition(*keys, "kind", "x", "y").sortWithinPartitions(*keys, "kind", "x", "y")


def spanning(linked: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a forest that connects what the symmetric boolean matrix connects."""
    unseen = np.ones(len(linked), bool)
    a, b = [], []
    for root in range(len(linked)):
        if not unseen[root]:
            continue
        unseen[root] = False
        todo = [root]
        while todo:
            u = todo.pop()
            found = np.flatnonzero(linked[u] & unseen).tolist()
            unseen[found] = False
            a += [u] * len(found)
            b += found
            todo += found
    return a, b


def alike(group: pa.Table) -> np.ndarray:
    """Which rows of a block are in different classes (of kind 0: at home and not) and may be similar enough, by size and signature."""
    n = group.column("n").to_numpy()
    side = group.column("class" if group.column("kind")[0].as_py() else "at_home").to_numpy()
    sig = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(n), -1)
    out = np.zeros((len(n), len(n)), bool)
    for i in range(len(n)):
        near = np.flatnonzero((side != side[i]) & (np.minimum(n[i], n) >= SIMILARITY * np.maximum(n[i], n)))
        out[i, near[(sig[near] == sig[i]).sum(axis=1) >= LEAST_MATCHES]] = True
    return out


def edges_of(ids: np.ndarray, forest: tuple[list[int], list[int]]) -> pa.RecordBatch:
    a, b = (ids[np.array(x, np.int64)] for x in forest)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def open_links(rest: DataFrame) -> DataFrame:
    """(band, key, id, class, n, sig; homes()) -> edges (a, b) of a forest over what may be similar, from all rows of each bucket; a row less than each block has rows."""
    keys = ["band", "key"]

    def compare(batches):
        for group in whole_groups(batches, [*keys, "kind", "x", "y"]):
            cls = group.column("class").to_numpy()
            if not (cls == cls[0]).all():
                yield edges_of(group.column("id").to_numpy(), spanning(alike(group)))

    return blocked(rest, keys).mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def shingled(texts: DataFrame) -> DataFrame:
    """(id, bag): the shingle multiset as sorted 8-byte hashes of (shingle, occurrence), so that overlaps of multisets are those of sets."""

    def cut(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                doc, h, count = bag(Words(batch.column("text").slice(a, b - a)))
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                each = mixed(np.repeat(h, count) * U(0x9FB21C651E98DF25) + nth.astype(U))
                ends = np.searchsorted(np.repeat(doc, count), np.arange(b - a + 1))
                bags = [each[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(bags, pa.binary())], ["id", "bag"])

    return texts.select("id", "text").mapInArrow(cut, "id long, bag binary")


def similar(group: pa.Table) -> np.ndarray:
    """Which rows of a block are in different classes and overlap enough, exactly."""
    linked = alike(group)
    some = np.flatnonzero(linked.any(axis=1))
    if not len(some):
        return linked
    column = group.column("bag")
    bags = [np.frombuffer(column[int(i)].as_py(), U) for i in some]
    size = np.array([len(x) for x in bags])
    row = np.repeat(np.arange(len(some)), size)
    _, code, often = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
    shared = often[code] > 1
    column_of = np.cumsum(often > 1) - 1
    words = max(1, -(-int((often > 1).sum()) // 64))
    bits = np.zeros((len(some), words), U)
    at = column_of[code[shared]]
    np.bitwise_or.at(bits, (row[shared], at // 64), U(1) << (at % 64).astype(U))
    for k, i in enumerate(some.tolist()):
        near = np.flatnonzero(linked[i, some])
        common = np.bitwise_count(bits[near] & bits[k]).sum(axis=1, dtype=np.int64)
        linked[i, some[near]] = common >= SIMILARITY * (size[near] + size[k] - common)
    return linked


def exact_links(rest: DataFrame) -> DataFrame:
    """(cluster, id, class, n, sig, bag; homes()) -> edges (a, b) of a forest over the true links, from all rows of each cluster."""
    keys = ["cluster"]

    def compare(batches):
        for group in whole_groups(batches, [*keys, "kind", "x", "y"]):
            cls = group.column("class").to_numpy()
            if not (cls == cls[0]).all():
                yield edges_of(group.column("id").to_numpy(), spanning(similar(group)))

    return blocked(rest, keys).mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, class) of every document that has words, and the exact links (a, b) between different texts that the classes rest on."""
    small_batches(docs.sparkSession)
    prints = materialize(signed(docs, key, text))
    first = prints.groupBy("p", "q").agg(F.min("id").alias("id"))
    members = prints.select("id", "p", "q").join(first.withColumnRenamed("id", "rep"), ["p", "q"]).select("id", "rep")
    members = materialize(members)
    # Each text once, under the smallest id that has it; the ids of one document's several texts are linked.
    reps = materialize(prints.join(first, ["p", "q", "id"]).groupBy("id", "p", "q").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    sigs = reps.select("id", "n", "sig")
    rows = reps.select("id", "n", F.posexplode("bands").alias("band", "key"))
    # Written before the join, so that it is a join of its own, whose large buckets Spark splits.
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("id"), F.col("id"), F.col("n"))).alias("hub")).where("size > 1")
    buckets = materialize(buckets)
    rows = materialize(rows.join(buckets, ["band", "key"]).select("band", "key", "id", "n", "size", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n")))
    star = rows.where(F.col("id") != F.col("hub")).where(F.least("n", "hub_n") >= SIMILARITY * F.greatest("n", "hub_n")).select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    side = lambda c: sigs.select(F.col("id").alias(c), F.col("sig").alias(f"s{c}"))
    star = materialize(likely(star.join(side("a"), "a").join(side("b"), "b")))
    ids = rows.select("id").distinct()
    texts = docs.select(F.col(key).cast("long").alias("id"), F.lower(F.col(text).cast("string")).alias("text")).join(ids, "id", "left_semi")
    texts = texts.join(repeated(docs, key), "id", "left_anti").union(texts.join(repeated(docs, key), "id", "left_semi").distinct())
    links = materialize(verified(star, texts))
    tied = members.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    classes = materialize(components(links.select("a", "b")))
    # What the hubs leave open: buckets of three or more whose documents are in several classes.
    open_rows = rows.where("size > 2").join(classes, "id", "left").select("band", "key", "id", "n", F.coalesce("class", "id").alias("class"))
    rest = open_rows.join(homes(open_rows, ["band", "key"]), ["band", "key"]).join(sigs.select("id", "sig"), "id")
    clusters = materialize(components(open_links(rest)).withColumnRenamed("class", "cluster"))
    bags = shingled(texts.join(clusters, "id", "left_semi"))
    rows = clusters.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    more = materialize(exact_links(rows.join(homes(rows, ["cluster"]), "cluster").join(sigs, "id").join(bags, "id")))
    links = links.select("a", "b").union(more)
    # Ids of one text share its representative's class; an id with several texts joins theirs.
    several = members.groupBy("id").agg(F.count_distinct("rep").alias("k")).where("k > 1").select("id")
    bridges = tied.join(several.withColumnRenamed("id", "a"), "a", "left_semi")
    classes = components(links.union(bridges)) if not more.isEmpty() or not bridges.isEmpty() else classes
    out = members.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("class", "rep").alias("class"))
    return out.groupBy("id").agg(F.min("class").alias("class")), links


def likely(pairs: DataFrame) -> DataFrame:
    """Of (a, b, sa, sb) the pairs whose signatures agree in LEAST_MATCHES registers."""

    def agree(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            keep = pa.array(np.flatnonzero((x == y).sum(axis=1) >= LEAST_MATCHES))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(keep), batch.column("b").take(keep)], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def repeated(docs: DataFrame, key: str) -> DataFrame:
    return docs.groupBy(F.col(key).cast("long").alias("id")).count().where("count > 1").select("id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class, that of the smallest id (null last); rows in no class stay.

    Every row is a document of its own, so rows that share an id but not the text are judged by their own texts, and of repeated
    rows one stays. Columns of any type pass untouched; rows are told apart by a number, not by their values.
    """
    (number,) = fresh(docs, "number")
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()))
    classes, _ = near_duplicates(numbered, number, text)
    order = F.struct(F.col(key).isNull(), F.col(key), F.xxhash64(text), F.col(number))
    mine, theirs = fresh(numbered, "in_class", "class")
    ranked = numbered.select(number, order.alias(mine)).join(classes.select(F.col("id").alias(number), F.col("class").alias(theirs)), number)
    first = ranked.groupBy(theirs).agg(F.min(mine).alias(mine)).select(F.col(mine)[number].alias(number))
    gone = classes.select(F.col("id").alias(number)).join(first, number, "left_anti")
    return numbered.join(gone, number, "left_anti").select(*[numbered[c] for c in docs.columns])


def op1_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, class_id (the smallest doc_id of its class; its own if in none)."""
    docs = table(spark, sf_dir, "documents")
    classes, _ = near_duplicates(docs)
    return docs.select("doc_id").join(classes.select(F.col("id").alias("doc_id"), "class"), "doc_id", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class_id"))
