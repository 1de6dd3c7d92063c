"""Recommendations, ranked, and reports as nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions.score import ratio
from pagelens.operators.diagnostics import versions
from pagelens.operators.metrics import WEIGHTS

# The recommendations by name: category, priority, message.
TEMPLATES = {
    "add_headings": ("structure", "high", "Add proper heading hierarchy (h1 → h2 → h3) to improve document structure for machine comprehension."),
    "fix_hierarchy": ("structure", "medium", "Fix heading hierarchy — avoid skipping levels (e.g., h1 → h3)."),
    "add_landmarks": ("structure", "medium", "Add semantic landmark elements (<main>, <nav>, <header>, <footer>) to improve structure."),
    "add_semantic_html": ("semantic", "high", "Use semantic HTML5 elements (<article>, <section>, <aside>, <nav>) instead of generic <div> wrappers."),
    "add_semantic_structure": ("semantic", "medium", "Add semantic structure with sectioning elements to create a clear content hierarchy."),
    "add_alt_text": ("accessibility", "high", "Add descriptive alt text to all informational images."),
    "add_aria_labels": ("accessibility", "medium", "Add ARIA labels to interactive elements without visible text."),
    "add_skip_link": ("accessibility", "low", "Add a skip-to-content link at the top of the page for keyboard navigation."),
    "add_form_labels": ("accessibility", "medium", "Associate all form inputs with <label> elements."),
    "reduce_noise": ("extractability", "high", "Reduce noise from boilerplate, ads, and navigation to improve content extractability."),
    "add_main_content": ("extractability", "high", "Wrap primary content in a <main> element to improve extractability."),
    "reduce_redundancy": ("extractability", "medium", "Remove or deduplicate repeated content blocks."),
    "improve_readability": ("content", "medium", "Shorten long sentences and simplify vocabulary to improve readability."),
    "add_content": ("content", "high", "Add more substantive content — current content is too sparse for machine comprehension."),
    "improve_clarity": ("content", "medium", "Use clear, unambiguous language and avoid jargon without context."),
    "add_json_ld": ("metadata", "high", "Add JSON-LD structured data with schema.org types to improve machine comprehension."),
    "add_meta_description": ("metadata", "medium", 'Add a descriptive <meta name="description"> tag.'),
    "add_canonical": ("metadata", "low", 'Add a <link rel="canonical"> to specify the preferred URL.'),
    "add_open_graph": ("metadata", "low", "Add Open Graph metadata (og:title, og:description, og:image) for social sharing."),
}
PRIORITY = {"high": 0, "medium": 1, "low": 2}


def rules() -> list[tuple[str, str, Column]]:
    """(metric, template, when) in the metrics' order."""
    c = F.col
    per = ratio(c("n_words"), c("n_sentences"))
    long = c("long_sentences") > 0
    lacks = lambda name: F.array_contains("absent", name)
    content = c("n_headings") + c("n_paragraphs") + c("n_lists") + c("n_tables") + c("n_links") + c("n_structured_data") + c("n_semantic_html")
    return [
        ("readability", "improve_readability", long | (per > 25)),
        ("readability", "add_content", c("n_words") < 100),
        ("structure", "add_headings", (c("h1") == 0) | (c("n_headings") < 3)),
        ("structure", "fix_hierarchy", c("skipped_levels") > 0),
        ("clarity", "improve_clarity", per > 25),
        ("semantic", "add_semantic_html", c("semantic_tags") < 3),
        ("semantic", "add_landmarks", c("has_main") == 0),
        ("semantic", "add_semantic_structure", c("n_semantic_structure") < 3),
        ("completeness", "add_content", content < 10),
        ("completeness", "add_meta_description", lacks("meta_description")),
        ("completeness", "add_json_ld", lacks("structured_data")),
        ("completeness", "add_canonical", lacks("canonical_url")),
        ("semanticStructure", "add_semantic_structure", c("structure_tags") < 3),
        ("structuredData", "add_json_ld", c("json_ld") == 0),
        ("extractability", "add_main_content", ~c("extractable") | (c("density") < 0.3)),
        ("extractability", "reduce_noise", c("noise") > 0.5),
        ("extractability", "reduce_redundancy", c("n_redundancy") > 3),
        ("accessibility", "add_alt_text", c("img_missing_alt") > 0),
        ("accessibility", "add_landmarks", c("landmarks") < 2),
        ("accessibility", "add_aria_labels", (c("aria_labels") == 0) & (c("accessibility_issues") > 0)),
        ("accessibility", "add_skip_link", c("skip_links") == 0),
        ("accessibility", "add_form_labels", c("accessibility_issues") > c("img_missing_alt")),
        ("machineComprehension", "add_json_ld", c("json_ld") == 0),
        ("machineComprehension", "add_main_content", ~c("extractable")),
        ("machineComprehension", "add_semantic_html", c("semantic_tags") < 3),
        ("machineComprehension", "fix_hierarchy", ~c("valid")),
    ]


def recommendations(stats: DataFrame, metric_rows: DataFrame) -> DataFrame:
    """All recommendations of scored metrics: id counts within a metric."""
    made = F.filter(F.array(*(F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(m).alias("metric"), F.lit(list(WEIGHTS).index(m)).alias("place"), F.lit(i).alias("i"), *(F.lit(v).alias(k) for k, v in zip(("category", "priority", "message"), TEMPLATES[t], strict=True)))) for i, (m, t, when) in enumerate(rules()))), lambda r: r.isNotNull())
    rows = stats.select("page_id", F.inline(made)).join(metric_rows.where("score is not null").select("page_id", "metric", "confidence"), ["page_id", "metric"])
    nth = F.row_number().over(W.partitionBy("page_id", "metric").orderBy("i")) - 1
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("priority"))
    return rows.withColumn("id", F.concat(F.col("metric"), F.lit("_rec_"), nth.cast("string"))).withColumn("rank", rank)


def distinct_recommendations(recs: DataFrame) -> DataFrame:
    """The first of each category and message of a page, in metric order."""
    w = W.partitionBy("page_id", "category", "message").orderBy("place", "i")
    return recs.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def top_recommendations(recs: DataFrame, n: int = 5) -> DataFrame:
    """The n most pressing of each page: by priority, least confident metric, category and message."""
    w = W.partitionBy("page_id").orderBy("rank", "confidence", "category", "message")
    return distinct_recommendations(recs).withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).select("page_id", "position", "id", "metric", "category", "priority", "message")


def full_report(scores: DataFrame, metric_rows: DataFrame, recs: DataFrame, n: int = 10) -> DataFrame:
    """One JSON document per page: score, metrics in order, top recommendations."""
    places = F.create_map(*(F.lit(x) for i, m in enumerate(WEIGHTS) for x in (m, i)))
    metrics = metric_rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.element_at(places, F.col("metric")).alias("place"), "metric", "score", "confidence", F.map_entries("parts").alias("parts")))).alias("metrics"))
    top = top_recommendations(recs, n).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "category", "priority", "message"))).alias("recommendations"))
    rows = scores.withColumnRenamed("metrics", "metric_count").join(metrics, "page_id", "left").join(top, "page_id", "left")
    scored = F.col("status").isin("scored", "scored_absence_evidence")
    body = F.struct("page_id", "final_score", "weighted_score", "confidence", "status", "grade", F.when(scored, F.col("metrics")).alias("metrics"), F.when(scored, F.col("recommendations")).alias("recommendations"), F.coalesce(F.col("contamination_type").isNotNull() | ~scored, F.lit(True)).alias("contamination"))
    return rows.select("page_id", F.to_json(body).alias("report"))


def weaknesses(stats: DataFrame, metric_rows: DataFrame, under: float = 60.0) -> DataFrame:
    """(page_id, metric, part, value): parts of metrics under a limit, the weakest first."""
    rows = metric_rows.where("score is not null").select("page_id", "metric", F.explode("parts").alias("part", "value")).where(F.col("value") < under)
    return rows.join(stats.select("page_id"), "page_id", "left_semi")


def summary_report(scores: DataFrame, recs: DataFrame, weak: DataFrame, n: int = 5) -> DataFrame:
    """One JSON document per page: versions, score, grade, distinct weaknesses in metric order, top recommendations.

    A blocked page has the reason as its only weakness, and neither it nor one without evidence has recommendations.
    """
    places = F.create_map(*(F.lit(x) for i, m in enumerate(WEIGHTS) for x in (m, i)))
    top = top_recommendations(recs, n).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", "priority", "message"))).alias("recommendations"))
    ordered = F.array_sort(F.collect_set(F.struct(places[F.col("metric")].alias("place"), F.concat_ws(".", "metric", "part").alias("text"))))
    parts = weak.groupBy("page_id").agg(F.transform(ordered, lambda x: x["text"]).alias("found"))
    rows = scores.join(top, "page_id", "left").join(parts, "page_id", "left")
    unscored = F.col("status").isin("blocked", "insufficient_evidence")
    reason = F.array(F.concat(F.lit("Scoring blocked: "), F.coalesce("contamination_type", F.lit("contamination detected"))))
    rows = rows.withColumn("weaknesses", F.when(unscored, reason).otherwise(F.coalesce("found", F.array().cast("array<string>")))).withColumn("recommendations", F.when(~unscored, F.col("recommendations")))
    return rows.select("page_id", F.to_json(F.struct(versions().alias("version"), "page_id", "final_score", "confidence", "status", "grade", "weaknesses", "recommendations")).alias("report"))


def developer_report(scores: DataFrame, metric_rows: DataFrame, diagnostics: DataFrame, warnings: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One JSON document per page for those who build on it: versions, signals by section before and after normalising, score, metrics, diagnostics.

    before and after are signals; diagnostics and warnings are those of scoring_diagnostics and report_diagnostics.
    """
    counts = lambda rows, name: rows.groupBy("page_id", "section").agg(F.count("*").alias("n")).groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "n")))).alias(name))
    places = F.create_map(*(F.lit(x) for i, m in enumerate(WEIGHTS) for x in (m, i)))
    metrics = metric_rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(places[F.col("metric")].alias("place"), "metric", "score", "confidence"))).alias("metrics"))
    rows = scores.withColumnRenamed("metrics", "metric_count")
    for part in (metrics, diagnostics, warnings, counts(before, "evidence"), counts(after, "normalized")):
        rows = rows.join(part, "page_id", "left")
    score = F.struct("final_score", "weighted_score", "confidence", "status", "grade", "contamination_type", "metrics")
    said = F.struct("missing", "absence", F.col("warnings").alias("pipeline_warnings"), "skipped", "skip_reason")
    return rows.select("page_id", F.to_json(F.struct(versions().alias("version"), "page_id", "evidence", "normalized", score.alias("score"), said.alias("diagnostics"))).alias("report"))


def absence_lists(signals: DataFrame) -> DataFrame:
    """What each page lacks, by severity."""
    of = lambda level: F.array_sort(F.collect_set(F.when(F.col("meta")["severity"] == level, F.col("value")))).alias(level)
    return signals.where("section = 'absence'").groupBy("page_id").agg(of("critical"), of("warning"), of("info"), F.count("*").alias("n"))
