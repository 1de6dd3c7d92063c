"""What reports say about how a score came about: versions, formulas, missing evidence, and the pipeline's warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.operators.metrics import WEIGHTS, Metric

# Versions of the parts of a report, and what its scores and records are made by.
VERSIONS = {"evidence": "1.2.0", "normalization": "1.2.0", "scoring": "1.2.0", "metrics": "1.2.0", "weighting": "1.2.0", "reporting": "1.2.0", "schema": "1.0.0"}


def versions() -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in VERSIONS.items()))


def formula(weights: dict[str, float], result: Column) -> Column:
    """The parts with their weights and what they come to, with two decimals; null where there is no result."""
    parts = " + ".join(f"{name}×{weight:g}" for name, weight in weights.items())
    return F.concat(F.lit(f"{parts} = "), F.when(result.isNull(), "null").otherwise(F.format_string("%.2f", result)))


def metric_formulas(metric_rows: DataFrame, metrics: list[Metric]) -> DataFrame:
    """metric_rows with the formula of each score."""
    out = None
    for m in metrics:
        made, here = formula({k: w for k, (_, w) in m.parts.items()}, F.col("score")), F.col("metric") == m.name
        out = F.when(here, made) if out is None else out.when(here, made)
    return metric_rows.withColumn("formula", out)


def complete_metrics(pages: DataFrame, metric_rows: DataFrame) -> DataFrame:
    """(page_id, metric, score, confidence) of all twelve metrics, in order, for every page; null where there is no evidence."""
    rows = pages.select("page_id", F.posexplode(F.array(*map(F.lit, WEIGHTS))).alias("place", "metric"))
    return rows.join(metric_rows.select("page_id", "metric", "score", "confidence"), ["page_id", "metric"], "left")


def scoring_diagnostics(stats: DataFrame, metric_rows: DataFrame) -> DataFrame:
    """(page_id, missing, absence): what each page's metrics lacked, in their order, and what the page lacks, by name.

    stats has page_id and absent. Pages without metric rows lack nothing that was asked for.
    """
    places = F.create_map(*(F.lit(x) for i, m in enumerate(WEIGHTS) for x in (m, i)))
    lacking = F.array_sort(F.collect_list(F.when(F.col("score").isNull(), F.struct(places[F.col("metric")].alias("place"), F.concat(F.lit("["), "metric", F.lit("] insufficient evidence")).alias("text")))))
    per = metric_rows.groupBy("page_id").agg(F.transform(lacking, lambda x: x["text"]).alias("missing"))
    absent = F.transform(F.array_sort(F.coalesce("absent", F.array())), lambda a: F.concat(F.lit("[absence] "), a))
    return stats.select("page_id", absent.alias("absence")).join(per, "page_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>"))).select("page_id", "missing", "absence")


def report_diagnostics(scores: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """(page_id, warnings, skipped, skip_reason) of each page's score: what the pipeline has to say about it.

    scores: page_id, status and contamination_type; diagnostics: page_id and missing. A blocked page is skipped, with
    its contamination as the reason; others are told of a lack of evidence, of absence that decided the score, of
    contamination that lowered the confidence, and of how many metrics had too little evidence.
    """
    rows = scores.select("page_id", "status", "contamination_type").join(diagnostics.select("page_id", "missing"), "page_id", "left")
    kind, status = F.coalesce("contamination_type", F.lit("unknown")), F.col("status")
    n = F.coalesce(F.size("missing"), F.lit(0))
    lines = F.array_compact(
        F.array(
            F.when(status == "blocked", F.concat(F.lit("Scoring BLOCKED due to contamination: "), kind, F.lit(". All metric calculators were skipped. finalScore=null, confidence=null."))),
            F.when(status == "insufficient_evidence", "Pipeline result: insufficient evidence — final score is null"),
            F.when(status == "scored_absence_evidence", "Pipeline result: absence evidence dominance — final score set to 0"),
            F.when(F.col("contamination_type").isNotNull() & ~status.isin("blocked", "insufficient_evidence"), F.concat(F.lit("Pipeline warning: contamination ("), kind, F.lit(") affected scoring confidence"))),
            F.when(n > 0, F.format_string("Pipeline warning: %d metric(s) had insufficient evidence", n)),
        )
    )
    skipped = status == "blocked"
    return rows.select("page_id", lines.alias("warnings"), skipped.alias("skipped"), F.when(skipped, F.concat(F.lit("Scoring blocked due to contamination: "), kind)).alias("skip_reason"))
