"""Incremental audits: new page files are parsed and flagged as they arrive. An extension for growing corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagelens.plans.audit import PageAudit

PAGE = "page_id long, url string, html string"


def page_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Parquet files of pages in a folder, as a stream."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def audit_stream(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Scores of every batch of new pages, written under the batch's number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        PageAudit(batch).scores.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
