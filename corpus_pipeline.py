"""The corpus pipeline: language ID, near-dedup, secret scan, mixing and packing, each on all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm import language, mixing, neardup, packing, secrets
from tallyhound.llm.common import free, read, write_shared


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with that as ``lang``. Those without letters, and those that need more than
    ``language.REJECT_ABOVE`` times the phrases usual for the best language, go."""
    verdict = free("verdict", docs.columns)
    found = language.identify(docs, carry=verdict)
    kept = found.filter((F.col(f"{verdict}.lang_pred") != language.UNKNOWN) & (F.col(f"{verdict}.excess") <= language.REJECT_ABOVE))
    return kept.withColumn("lang", F.col(f"{verdict}.lang_pred")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more. Texts without words (null and empty ones) stay, and so do rows
    without doc_id."""
    return neardup.drop_near_duplicates(docs, words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in them are replaced by a mark. Null and empty texts stay as they are."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents up to their sources' targets, in queue order. Documents without words (null and empty texts) are never taken."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences; a null or empty text is one piece of the end token."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Neither cross-parsing, MinHash nor byte-pair merges can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``; every stage is stored in the shared folder before the next reads it."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_shared(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
