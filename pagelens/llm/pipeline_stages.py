"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame; all but the last return documents' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, near_dedup, packing, secrets
from .common import materialize, read_table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which language ID finds no language: null and empty texts and texts without a letter.

    The languages are learned from docs' own lang, which is left as it is. Each row is judged by its own text, whether
    its id is null or repeated. If no language can be learned, every document is dropped; an empty table stays empty.
    """
    return langid.with_language(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group, once.

    Of rows that repeat that id, the one of smallest text stays (null last; then by the other columns in their order).
    Rows without an id are linked with nothing, and all of them are kept; so are null and blank texts of ids of their own.
    An empty table stays empty.
    """
    kept = near_dedup.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    order = [F.col("text").isNull(), F.col("text"), *(F.col(c) for c in docs.columns if c not in ("doc_id", "text"))]
    least = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(order[0].alias("__null"), *order[1:])).alias("__row"))
    named = least.select(*(F.col(c) if c == "doc_id" else F.col("__row")[c].alias(c) for c in docs.columns))
    return named.union(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, those without an id or with a repeated one too; null and empty texts stay.

    An empty benchmark or an empty table leaves docs as they are.
    """
    return decontaminate.without_items(docs, read_table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text by [secret] and sets n_chars anew (null for null texts).

    Keeps every document, and masks each by its own text, those without an id or with a repeated one too.
    """
    masked = secrets.redact(docs, ratios=secrets.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' token pieces in sequences of at most 4096 tokens.

    Null and empty texts are one piece, their end; rows without an id or with a repeated one give pieces of their own.
    """
    return packing.pack(docs, capacity=4096, end_id=1)


def apply(stages: list[tuple[str, Callable]], spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again as the next one's documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in stages[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return stages[-1][1](spark, docs, sf_dir)
