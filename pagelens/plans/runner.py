"""Corpus runs: cases of stored pages, audited together, as the results that baselines and drift work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.plans.audit import PageAudit
from pagelens.plans.scratch import materialize


def run_cases(corpus: DataFrame) -> DataFrame:
    """A result for every case (id, category, url, snapshot_html), by one audit of all their pages.

    Columns as in pagelens.operators.benchmark, and error_message. A case without a stored page is an error; its scores
    are null. The page of a case without a URL counts as lying at snapshot://id. Cases are audited together, so
    runtime_ms, which belongs to one, is null. Repeated ids give a result each.
    """
    url = F.coalesce("url", F.concat(F.lit("snapshot://"), F.col("id")))
    cases = materialize(corpus.select(F.monotonically_increasing_id().alias("page_id"), F.col("id").cast("string").alias("case_id"), "category", url.alias("url"), F.col("snapshot_html").alias("html")), "cases")
    audit = PageAudit(cases.where("html is not null"))
    scores = audit.scores.select("page_id", "final_score", "confidence", "contamination_type")
    metrics = audit.metric_rows.where("score is not null").groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "score"))).alias("metrics"))
    advice = audit.recommendations.groupBy("page_id").agg(F.array_sort(F.collect_set("message")).alias("recommendations"))
    absent = audit.stats.select("page_id", F.array_sort("absent").alias("absence"))
    rows = cases.select("page_id", "case_id", "category", F.col("html").isNotNull().alias("fine"))
    for part in (scores, metrics, advice, absent):
        rows = rows.join(part.hint("merge"), "page_id", "left")  # no case's advice goes through the driver
    status = F.when(F.col("fine"), "ok").otherwise("error")
    message = F.when(~F.col("fine"), F.concat(F.lit("No content available for case "), F.col("case_id")))
    none = F.array().cast("array<string>")
    return rows.select("case_id", "category", status.alias("status"), "final_score", "confidence", F.coalesce("metrics", F.create_map().cast("map<string,double>")).alias("metrics"), F.coalesce("recommendations", none).alias("recommendations"), F.coalesce("absence", none).alias("absence"), "contamination_type", F.lit(None).cast("double").alias("runtime_ms"), message.alias("error_message"))
