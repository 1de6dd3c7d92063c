"""The corpus pipeline: five stages over documents, each one of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelens.llm import pipeline_stages as S

STAGES = [("language", S.keep_languages), ("near_duplicates", S.drop_near_duplicates), ("decontamination", S.drop_contaminated), ("secrets", S.mask_secrets), ("packing", S.pack_sequences)]

#: Language models and secret models are trained on the corpus, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.apply(STAGES, spark, sf_dir)
