"""The corpus pipeline: stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate, dedup, langid, pii
from palimpsest.llm.mix import mix_copies
from palimpsest.llm.runtime import crc_fold, fresh, materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a learned language is found. Those without letters, or without any known trigram, go.

    Filters are learned from the stage's own labelled documents, as in op2; without any label nothing can be judged, and all stay.
    """
    train = docs.where((crc_fold("doc_id", 3) != 1) & F.col("lang").isNotNull()).select("lang", "text")
    filters = langid.learn(train)
    if not filters.langs:
        return docs
    lang, score = fresh(docs, "lang_pred", "score")
    return langid.identify(docs, filters).where((F.col(lang) != "und") & (F.col(score) > 0)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id."""
    return dedup.deduplicated(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data masked and n_chars counted anew."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, with a column that numbers its copies."""
    return mix_copies(docs)


STAGES = [
    ("language id", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("mix", mix_sources),
]

#: Stages learn models, draw signatures and parse texts, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
