"""Licence scan with ordered signature rules, in DataFrame functions alone.

The text is lower-cased and cut to words (runs of ASCII letters and digits and of non-ASCII characters) parted by single
spaces. A coarse gate of stems spares most texts the rules. In the others each rule's keyword is looked for, and only the
rules whose keyword is there run their expression, at word boundaries. A detection that lies within another of at least its
priority is suppressed, of equal intervals the higher priority stays, then the rule first in order; what is left gives the
labels and, by the strongest priority, the score. Three base phrases are counted apart and always keep their labels.

One narrow pass without a shuffle: every row is judged by itself. Null and empty texts have no words and no labels, and
score 0. Repeated rows are judged alike. Other columns of the input pass untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_rules import STEMS, rules
from .runtime import fresh, table

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
LEVELS = 4
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = 256


def normal(text: Column) -> Column:
    """Words parted by one space, one more at each end."""
    words = F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def phrase(norm: Column, words: Column, what: str) -> Column:
    """(n, first, last) of a phrase's places."""
    parts = F.split(norm, f" {what}(?= )", -1)
    size = len(what.split())
    found = F.struct((F.size(parts) - 1).cast("long").alias("n"), spaces(F.element_at(parts, 1)).alias("first"), (words - (spaces(F.element_at(parts, -1)) - 1) - size).alias("last"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    return F.when(F.contains(norm, F.lit(f" {what} ")), found).otherwise(none)


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def detections(norm: Column) -> Column:
    """Structs (start, -end, -priority, order, label) of all matches of all rules, sorted."""
    table_of = F.array(*[F.struct(F.lit(lab).alias("label"), F.lit(p).alias("priority"), F.lit(k).alias("keyword"), F.lit(f"(?<= )(?:{x})(?= )").alias("expression"), F.lit(i).alias("order")) for i, (lab, p, k, x) in enumerate(rules())])

    def places(r: Column) -> Column:
        """In runs of RUN matches, so that growing the list costs no square of their number."""
        kind = "array<struct<start:int,end:int,priority:int,order:int,label:string>>"

        def one(acc: Column, m: Column) -> Column:
            start = acc["at"] + m["gap"]
            end = start + m["size"]
            found = F.struct(start.alias("start"), (-end).alias("end"), (-r["priority"]).alias("priority"), r["order"].alias("order"), r["label"].alias("label"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

        def run(matches: Column):
            def step(acc: Column, i: Column) -> Column:
                inner = F.aggregate(F.slice(matches, i, RUN), F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), one)
                return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

            return step

        def listed(matches: Column) -> Column:
            start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
            runs = F.aggregate(F.sequence(F.lit(1), F.size(matches), F.lit(RUN)), start, run(matches))
            return F.when(F.size(matches) > 0, F.flatten(runs["out"])).otherwise(F.array().cast(kind))

        sizes = lambda texts: F.transform(texts, lambda x: F.length(x))
        found, gaps = sizes(F.regexp_extract_all(norm, r["expression"], F.lit(0))), sizes(F.split(norm, r["expression"], -1))
        matches = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("size")))
        return let(F.slice(matches, 1, F.size(matches) - 1), listed)  # what follows the last match is no match

    return F.sort_array(F.flatten(F.transform(F.filter(table_of, lambda r: F.contains(norm, r["keyword"])), places)))


def kept(found: Column) -> Column:
    """(labels, top priority) left by containment: going by start, longer and stronger first, a detection falls if one of its priority or more has reached as far."""
    start = F.struct(F.array(*[F.lit(-1)] * LEVELS).alias("reach"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("top"))

    def step(acc: Column, d: Column) -> Column:
        priority, end = -d["priority"], -d["end"]
        inside = F.array_max(F.slice(acc["reach"], priority, LEVELS)) >= end
        reach = F.transform(acc["reach"], lambda x, i: F.when(i == priority - 1, F.greatest(x, end)).otherwise(x))
        return F.when(inside, acc).otherwise(F.struct(reach.alias("reach"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"), F.greatest(acc["top"], priority).alias("top")))

    return F.aggregate(found, start, step)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score (prefixed by _ where docs has such names)."""
    names = fresh(docs, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    norm, words, a, b, c, rest = fresh(docs, "norm", "words", "p0", "p1", "p2", "rest")
    out = docs.withColumn(norm, normal(docs[text]))
    out = out.withColumn(words, F.when(F.length(norm) <= 2, F.lit(0).cast("long")).otherwise(spaces(F.col(norm)) - 1))
    for name, (what, _) in zip((a, b, c), PHRASES, strict=True):
        out = out.withColumn(name, phrase(F.col(norm), F.col(words), what))
    gate = F.lit(False)
    for stem in dict.fromkeys(STEMS):
        gate = gate | F.contains(F.col(norm), F.lit(stem))
    out = out.withColumn(rest, F.when(gate, kept(detections(F.col(norm)))))
    base = F.array_compact(F.array(*[F.when(F.col(x)["n"] > 0, F.lit(lab)) for x, (_, lab) in zip((a, b, c), PHRASES, strict=True)]))
    every = F.array_union(base, F.coalesce(F.col(rest)["labels"], F.array().cast("array<string>")))
    top = F.greatest(F.when(F.size(base) > 0, F.lit(2)).otherwise(F.lit(0)), F.coalesce(F.col(rest)["top"], F.lit(0)))
    values = [
        F.col(words),
        F.col(a)["n"] + F.col(b)["n"] + F.col(c)["n"],
        F.least(*[F.col(x)["first"] for x in (a, b, c)]),
        F.greatest(*[F.col(x)["last"] for x in (a, b, c)]),
        F.array_join(F.array_sort(base), ","),
        F.array_join(F.array_sort(every), ","),
        top / F.lit(float(LEVELS)),
    ]
    return out.select(*docs.columns, *[v.alias(n) for v, n in zip(values, names, strict=True)])


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
