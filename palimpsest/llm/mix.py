"""Mixing sources to target weights by entropy balancing.

Each source has a target of words. Among all document rates from 0 to the cap, the ones nearest to one copy each in relative
entropy that meet every target are exponentially tilted: rate = min(cap, exp(tilt * size)), with one tilt a source, the dual
variable of its constraint. The dual is convex; safeguarded Newton iterations solve it for all sources at once. Each is one
distributed aggregate of gradient and Hessian over the histogram of (source, size), in which a source has as many rows as it has
different sizes; no source's rows are collected. Where a target is the cap itself, all rates are the cap.

Rates are then rounded into whole copies. Rounding is systematic: a source's documents, by falling size, are dealt at evenly spaced
places of the running sum of their rates, which keeps the error under one document; then the smallest documents are flipped until
what is missing is less than the next of them. It works on cells of the histogram, of which a value with many documents is
split by a hash into parts of about PART documents. Running sums have two levels, within blocks of parts and over the blocks,
so no task gets all of a hot source.

Null text: size 0. Null source: a source of its own, last in order. Documents of size 0 take nothing. Very long texts are
counted whole. Repeated rows are separate documents, as are rows of one id or of none. Ties (equal size) go by a hash of the id.
An empty table gives an empty result. Other columns of the input, of any type, are kept by `mix` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import fresh, materialize, table

#: Documents of one (source, size) value that are ranked together; parts of one block of a running sum.
PART, BLOCK = 256, 1024
#: Newton steps at most, and the change of the tilt, by its size, that ends them (the error left is about its square); rates are kept in units of 1 / UNIT.
NEWTON_STEPS, CLOSE, UNIT = 100, 1e-10, 1 << 20


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(key, words) -> target: water-filling. In order of cap/weight, sources stop at their cap as long as the level reaches it."""
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("top", cap * F.col("words").cast("double")).withColumn("ratio", F.col("top") / F.col("w"))
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (share * F.sum("words").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levelled = ranked.withColumn("level", level).withColumn("full", F.col("level") >= F.col("ratio"))
    share_of = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return levelled.withColumn("target", F.when(F.col("full"), F.col("top")).otherwise(F.col("w") * share_of)).select("key", "words", "target")


def tilts(hist: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(key, size, n) and (key, words, target) -> (key, words, target, scale, tilt): the rate of a size is min(cap, exp(tilt * size / scale)).

    Newton's method on each token constraint, from tilt 0, within a bracket that each step narrows; a step that leaves it halves it.
    """
    scale = hist.groupBy("key").agg(F.max("size").cast("double").alias("scale"))
    top = F.col("target") >= cap * F.col("words")
    state = targets.join(scale, "key").select(
        "key", "words", "target", F.greatest(F.lit(1.0), "scale").alias("scale"), F.when(top, F.lit(float("inf"))).otherwise(F.lit(0.0)).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), (top | (F.col("target") <= 0)).alias("done"),
    )
    state = materialize(state.withColumn("tilt", F.when((F.col("target") <= 0) & (F.col("words") > 0), F.lit(float("-inf"))).otherwise(F.col("tilt"))))
    for _ in range(NEWTON_STEPS):
        if state.where(~F.col("done")).isEmpty():
            break
        x = F.exp(F.col("tilt") * F.col("size") / F.col("scale"))
        mass = F.col("n") * F.col("size")
        sums = hist.join(state.where(~F.col("done")).select("key", "tilt", "scale"), "key").groupBy("key")
        sums = sums.agg(F.sum(mass * F.least(F.lit(float(cap)), x)).alias("got"), F.sum(F.when(x < cap, mass * F.col("size") / F.col("scale") * x).otherwise(0.0)).alias("slope"))
        step = state.join(sums, "key", "left").withColumn("over", F.col("got") - F.col("target"))
        step = step.withColumn("low", F.when(F.col("over") <= 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("over") >= 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - F.col("over") / F.when(F.col("slope") > 0, F.col("slope"))
        wide = F.when(F.col("low") == float("-inf"), F.least(F.lit(-1.0), 2 * F.col("high"))).when(F.col("high") == float("inf"), F.greatest(F.lit(1.0), 2 * F.col("low"))).otherwise((F.col("low") + F.col("high")) / 2)
        to = F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(wide)
        step = step.withColumn("to", to)
        near = (F.col("over") == 0) | (F.abs(F.col("to") - F.col("tilt")) <= CLOSE * F.greatest(F.lit(1.0), F.abs("tilt")))
        state = materialize(step.select("key", "words", "target", "scale", F.when(F.col("done") | (F.col("over") == 0), F.col("tilt")).otherwise(F.col("to")).alias("tilt"), "low", "high", (F.col("done") | near).alias("done")))
    return state.select("key", "words", "target", "scale", "tilt")


def before(cells: DataFrame, value: str, largest_first: bool) -> DataFrame:
    """cells (key, size, sub, ...) with a column before: the sum of value over the source's cells before, by size and then sub. Two levels."""
    block = cells.withColumn("block", F.floor(F.col("sub") / BLOCK))
    sums = block.groupBy("key", "size", "block").agg(F.sum(value).alias("whole"))
    way = F.desc("size") if largest_first else F.asc("size")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("key", "size", "block", F.coalesce(F.sum("whole").over(upto(Window.partitionBy("key").orderBy(way, "block"))), F.lit(0)).alias("outer"))
    inner = F.coalesce(F.sum(value).over(upto(Window.partitionBy("key", "size", "block").orderBy("sub"))), F.lit(0))
    return block.withColumn("inner", inner).join(sums, ["key", "size", "block"]).withColumn("before", F.col("outer") + F.col("inner")).drop("inner", "outer", "block")


def plan(sized: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(doc_id, key, size, u: a hash that orders equal sizes) with one row a document -> the same with source_size, target, copies."""
    hist = materialize(sized.groupBy("key", "size").agg(F.count("*").alias("n")))
    targets = materialize(source_targets(hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("words")), weights, share, cap))
    rates = tilts(hist, targets, cap)
    hot = hist.where(F.col("n") > PART).select("key", "size", F.ceil(F.col("n") / PART).alias("parts"))
    dealt = sized.join(hot, ["key", "size"], "left")
    dealt = dealt.withColumn("sub", F.pmod(F.conv(F.substring("u", 1, 8), 16, 10).cast("long"), F.coalesce("parts", F.lit(1)))).drop("parts")
    dealt = dealt.repartition("key", "size", "sub")
    rate = F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("size") / F.col("scale"))))
    units = F.floor(rate * UNIT + 1e-3)
    cells = materialize(dealt.groupBy("key", "size", "sub").agg(F.count("*").alias("n")).join(rates, "key").withColumn("units", units))
    cells = cells.withColumn("base", F.floor(F.col("units") / UNIT)).withColumn("part", F.col("n") * F.pmod("units", F.lit(UNIT)))
    at = lambda c: F.floor((c + UNIT // 2) / UNIT)
    cells = before(cells, "part", True).withColumn("k", at(F.col("before") + F.col("part")) - at(F.col("before"))).drop("before", "part")
    cells = materialize(cells.withColumn("took", F.col("size") * (F.col("base") * F.col("n") + F.col("k"))))
    miss = cells.groupBy("key").agg((F.first("target") - F.sum("took")).alias("miss"))
    cells = cells.join(miss, "key")
    cells = cells.withColumn("free", F.when(F.col("size") == 0, 0).when(F.col("miss") > 0, F.when(F.col("base") < cap, F.col("n") - F.col("k")).otherwise(0)).otherwise(F.col("k"))).withColumn("room", F.col("free") * F.col("size"))
    cells = before(cells, "room", False)
    flips = F.when(F.col("size") == 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.col("free"), F.floor((F.abs("miss") - F.col("before")) / F.col("size")))))
    cells = cells.withColumn("picks", F.col("k") + F.when(F.col("miss") > 0, flips).otherwise(-flips))
    cells = cells.select("key", "size", "sub", "picks", "base", F.col("words").alias("source_size"), "target")
    rank = F.row_number().over(Window.partitionBy("key", "size", "sub").orderBy("u", "doc_id"))
    out = dealt.withColumn("rank", rank).join(cells, ["key", "size", "sub"])
    return out.withColumn("copies", F.col("base") + (F.col("rank") <= F.col("picks")).cast("long")).drop("rank", "picks", "base", "sub", "u")


def mix(docs: DataFrame, weights: list[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """All documents with columns size, source_size, target, taken, copies added (prefixed by _ where docs has such names).

    weights: of the sources by code point of their names, null last, repeating. share: of all words that the mix takes.
    cap: at most so many times a source's and a document's size.
    """
    added = fresh(docs, "size", "source_size", "target", "taken", "copies")
    # Rows carry a number of their own, so that those of one id, of none, or alike are told apart and no id gets all rows of a task.
    number, key, size, order, of, total, target, copies = fresh(docs, "number", "key", "size_", "u", "of", "total", "target_", "copies_")
    u = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"), F.xxhash64("source").cast("string")))
    numbered = materialize(docs.withColumns({number: F.monotonically_increasing_id(), key: key_of(docs), size: word_count(docs["text"]), order: u}))
    planned = plan(numbered.select(F.col(number).alias("doc_id"), F.col(key).alias("key"), F.col(size).alias("size"), F.col(order).alias("u")), list(weights), share, cap)
    planned = planned.select(F.col("doc_id").alias(of), F.col("source_size").alias(total), F.col("target").alias(target), F.col("copies").alias(copies))
    both = numbered.join(planned, numbered[number] == planned[of])
    values = [F.col(size), F.col(total), F.col(target), F.col(copies) * F.col(size), F.col(copies)]
    return both.select(*[F.col(c) for c in docs.columns], *[v.alias(a) for v, a in zip(values, added, strict=True)])


def key_of(docs: DataFrame) -> Column:
    return F.when(docs["source"].isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), docs["source"]))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    u = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = materialize(docs.select("doc_id", key_of(docs).alias("key"), word_count(F.col("text")).alias("size"), u.alias("u")))
    out = plan(sized, [3, 1, 2], 1.5, 2.0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix_copies(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as many times as it has copies, with the columns of docs and a column copy (from 1)."""
    (copy,) = fresh(docs, "copy")
    mixed = mix(docs, **how)
    copies = mixed.columns[-1]
    return mixed.where(F.col(copies) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy))


#: op3_mix in DuckDB's SQL. The tilts are found by halving a bracket instead of Newton's steps.
ORACLE_SQL = f"""
WITH RECURSIVE sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS u FROM documents),
hist AS (SELECT key, size, count(*) AS n FROM sized GROUP BY key, size),
totals AS (SELECT key, CAST(sum(n * size) AS BIGINT) AS words, greatest(1, CAST(max(size) AS DOUBLE)) AS scale, list({{'n': n, 'size': size}}) AS cells FROM hist GROUP BY key),
weighed AS (SELECT key, words, CAST([3, 1, 2][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS DOUBLE) AS w, 2 * CAST(words AS DOUBLE) AS top FROM totals),
levels AS (SELECT *, (CAST(1.5 AS DOUBLE) * sum(words) OVER () - coalesce(sum(top) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
    FROM weighed WINDOW before AS (ORDER BY top / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT key, words, CASE WHEN level >= top / w THEN top ELSE w * max(CASE WHEN level < top / w THEN level END) OVER () END AS target FROM levels),
halved AS (SELECT key, CAST(-1e6 AS DOUBLE) AS low, CAST(1e6 AS DOUBLE) AS high, 0 AS step FROM totals
    UNION ALL SELECT h.key, CASE WHEN got.v <= t.target THEN (low + high) / 2 ELSE low END, CASE WHEN got.v <= t.target THEN high ELSE (low + high) / 2 END, step + 1
    FROM halved h JOIN targets t ON h.key = t.key JOIN totals s ON h.key = s.key, LATERAL (SELECT list_sum(list_transform(s.cells, lambda c: c.n * c.size * least(CAST(2 AS DOUBLE), exp(least(CAST(700 AS DOUBLE), (low + high) / 2 * c.size / s.scale))))) AS v) got WHERE step < 90),
rates AS (SELECT t.key, t.words, t.target, h.size, CASE WHEN h.size = 0 THEN CAST(0 AS DOUBLE) WHEN t.target >= 2 * t.words THEN CAST(2 AS DOUBLE) ELSE least(CAST(2 AS DOUBLE), exp(least(CAST(700 AS DOUBLE), (low + high) / 2 * h.size / s.scale))) END AS rate
    FROM targets t JOIN totals s ON t.key = s.key JOIN halved x ON t.key = x.key AND x.step = 90 JOIN hist h ON h.key = t.key),
units AS (SELECT *, CAST(floor(rate * {UNIT} + CAST(1e-3 AS DOUBLE)) AS BIGINT) AS units FROM rates),
parts AS (SELECT key, size, words, target, units // {UNIT} AS base, units % {UNIT} AS part FROM units),
dealt AS (SELECT s.*, CASE WHEN n > {PART} THEN CAST('0x' || substr(u, 1, 8) AS BIGINT) % CAST(ceil(n / {PART}) AS BIGINT) ELSE 0 END AS sub FROM sized s JOIN hist USING (key, size)),
cells AS (SELECT d.key, d.size, sub, words, target, base, count(*) AS n, count(*) * p.part AS part FROM dealt d JOIN parts p ON d.key = p.key AND d.size = p.size GROUP BY d.key, d.size, sub, words, target, base, p.part),
seen AS (SELECT *, sum(part) OVER (PARTITION BY key ORDER BY size DESC, sub) AS upto FROM (SELECT key, size, sub, words, target, base, n, part FROM cells)),
spread AS (SELECT *, CAST((upto + {UNIT // 2}) // {UNIT} - (upto - part + {UNIT // 2}) // {UNIT} AS BIGINT) AS k FROM seen),
missing AS (SELECT *, target - sum(size * (base * n + k)) OVER (PARTITION BY key) AS miss FROM spread),
frees AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN miss > 0 THEN CASE WHEN base < 2 THEN n - k ELSE 0 END ELSE k END AS free FROM missing),
spent AS (SELECT *, coalesce(sum(free * size) OVER (PARTITION BY key ORDER BY size, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM frees),
picked AS (SELECT *, k + sign(miss) * CASE WHEN size = 0 THEN 0 ELSE greatest(0, least(free, floor((abs(miss) - gone) / size))) END AS picks FROM spent),
ranked AS (SELECT doc_id, key, size, sub, row_number() OVER (PARTITION BY key, size, sub ORDER BY u, doc_id) AS rank FROM dealt),
copied AS (SELECT r.doc_id, r.size, p.words, p.target, CAST(p.base + CASE WHEN r.rank <= p.picks THEN 1 ELSE 0 END AS BIGINT) AS copies FROM ranked r JOIN picked p ON r.key = p.key AND r.size = p.size AND r.sub = p.sub)
SELECT doc_id, size, words AS source_size, target, copies * size AS taken, copies FROM copied
"""
