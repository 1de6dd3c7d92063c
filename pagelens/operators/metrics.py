"""Twelve quality metrics as expressions over a page's stats; each gives a score of 0 to 100 and a confidence of 0 to 1."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.score import clamp_confidence, clamp_score, ladder, ratio

# Weights of the metrics, and penalties by severity of what contaminates a page.
WEIGHTS = {"readability": 0.06, "structure": 0.06, "clarity": 0.05, "consistency": 0.05, "semantic": 0.06, "completeness": 0.06, "semanticStructure": 0.10, "structuredData": 0.08, "extractability": 0.10, "accessibility": 0.08, "entityRecognition": 0.10, "machineComprehension": 0.20}
CRITICAL = ("hydration_shell", "script_only_dom", "dom_corruption")


def c(name: str) -> Column:
    return F.col(name)


def most(low: float, value: Column) -> Column:
    return F.greatest(F.lit(float(low)), value)


@dataclass
class Metric:
    """Parts with their weights, when there is too little evidence, and how confidence starts, falls and ends."""

    name: str
    parts: dict[str, tuple[Column, float]]
    missing: Column
    confidence: float
    losses: list[tuple[Column, float]] = field(default_factory=list)
    floor: float = 0.3
    affected_by: tuple[str, ...] = ()
    extra: Column | None = None


def text_metrics() -> list[Metric]:
    """Metrics that need text_numbers and n_paragraphs alone."""
    n, m, too_long = c("n_sentences"), c("n_words"), c("long_sentences")
    length, per = ratio(c("letters"), m), ratio(m, n)
    rare, vague = ratio(c("rare_words"), m), ratio(c("vague_words"), m)
    readability = Metric(
        "readability",
        {
            "sentence_length": (ratio(c("good_sentences"), n) * 100 - too_long * 5, 0.30),
            "word_complexity": (F.when((length >= 4) & (length <= 7), 90.0).when(length > 7, most(40, 90 - (length - 7) * 10)).otherwise(most(50, 90 - (4 - length) * 10)), 0.25),
            "words_per_sentence": (F.when((per >= 8) & (per <= 25), 95.0).when(per > 40, most(30, 95 - (per - 40) * 3)).when(per < 8, most(40, 95 - (8 - per) * 5)).otherwise(80.0), 0.25),
            "text_volume": (F.when(m > 2000, 95.0).when(m > 500, 80.0).when(m > 100, 60.0).otherwise(30.0), 0.20),
        },
        (n == 0) | (m == 0),
        0.85,
        [(too_long.cast("double"), 0.02)],
        affected_by=("script_only_dom", "encoding_failure"),
    )
    clarity = Metric(
        "clarity",
        {
            "sentence": (F.when((per >= 8) & (per <= 20), 90.0).when(per > 30, most(30, 90 - (per - 30) * 3)).when(per < 5, 60.0).otherwise(75.0), 0.30),
            "vocabulary": (F.when(rare < 0.05, 95.0).when(rare < 0.10, 85.0).when(rare < 0.20, 70.0).otherwise(most(30, 90 - rare * 100)), 0.25),
            "paragraph": (ladder(c("n_paragraphs"), [(5, 85), (2, 70), (1, 50)], 30), 0.25),
            "ambiguity": (F.when(vague < 0.05, 95.0).when(vague < 0.10, 80.0).when(vague < 0.20, 60.0).otherwise(most(25, 90 - vague * 150)), 0.20),
        },
        (n == 0) | (m == 0),
        0.82,
        affected_by=("script_only_dom", "encoding_failure", "boilerplate_only"),
    )
    return [readability, clarity]


def _deviation(sizes: Column) -> Column:
    """Standard deviation of an array, from its sums; the array is worked out once."""
    state = lambda x, xx, n: F.struct(x.alias("x"), xx.alias("xx"), n.alias("n"))
    mean = lambda a: a["x"] / a["n"]
    return F.aggregate(
        sizes,
        state(F.lit(0.0), F.lit(0.0), F.lit(0)),
        lambda a, x: state(a["x"] + x, a["xx"] + x * x, a["n"] + 1),
        lambda a: F.when(a["n"] > 0, F.sqrt(F.greatest(F.lit(0.0), a["xx"] / a["n"] - mean(a) * mean(a)))).otherwise(0.0),
    )


def page_metrics() -> list[Metric]:
    """Metrics over page_stats."""
    yes = lambda cond, a, b: F.when(cond, float(a)).otherwise(float(b))
    h, p = F.transform("heading_values", lambda x: x["value"]), F.transform("paragraph_values", lambda x: x["value"])
    nh, np_ = F.size(h), F.size(p)
    tokens = F.filter(F.flatten(F.transform(F.concat(h, p), lambda t: F.split(F.lower(t), r"\s+"))), lambda w: F.length(w) > 4)
    state = lambda word, again, n, unique: F.struct(word.alias("word"), again.alias("again"), n.alias("n"), unique.alias("unique"))
    terminology = F.aggregate(  # words are found and sorted once; n counts those that occur again
        F.sort_array(tokens),
        state(F.lit(""), F.lit(True), F.lit(0), F.lit(0)),
        lambda a, w: state(w, a["word"] == w, a["n"] + ((a["word"] == w) & ~a["again"]).cast("int"), a["unique"] + (a["word"] != w).cast("int")),
        lambda a: F.when(a["unique"] > 0, 50 + F.least(F.lit(50.0), 100 * ratio(a["n"], a["unique"]))).otherwise(40.0),
    )
    style = F.greatest(F.size(F.filter(h, lambda t: t.rlike("^[A-Z]"))), F.size(F.filter(h, lambda t: t.rlike("^[a-z]"))), F.size(F.filter(h, lambda t: (F.upper(t) == t) & (F.length(t) > 3))))
    word_counts = lambda texts: F.transform(texts, lambda t: F.size(F.split(t, r"\s+")).cast("double"))
    orphan_share = ratio(c("orphans"), c("tree_headings"))
    families = ["headings", "paragraphs", "lists", "tables", "links", "structured_data", "semantic_html"]
    total = sum((c(f"n_{x}") for x in families), F.lit(0))
    filled = sum(((c(f"n_{x}") > 0).cast("int") for x in families), F.lit(0))
    fields = ["title", "meta_description", "canonical_url", "open_graph_title", "language_declaration", "structured_data"]
    present = sum(((~F.array_contains("absent", x)).cast("int") for x in fields), F.lit(0))
    all_data = c("json_ld") + c("json_ld_invalid") + c("microdata")
    b, r, issues = c("boilerplate"), c("n_redundancy"), c("accessibility_issues")
    five = c("n_semantic_html") + c("n_headings") + c("n_structured_data") + c("n_entities") + c("n_semantic_structure")
    t, s, e, d = c("semantic_tags"), c("n_semantic_structure"), c("n_entities"), c("entity_kinds")
    return [
        Metric(
            "structure",
            {
                "presence": (ladder(c("n_headings"), [(10, 95), (5, 85), (3, 70), (1, 50)], 20), 0.30),
                "depth": (ladder(c("heading_levels"), [(4, 95), (3, 85), (2, 70), (1, 50)], 20) - yes(c("h1") == 0, 15, 0), 0.25),
                "validity": (F.when(c("valid"), 100 - 50 * orphan_share).when(c("n_headings") > 0, 40.0).otherwise(30.0), 0.25),
                "order": (F.when(c("skipped_levels") == 0, 95.0).when(c("skipped_levels") <= 2, 75.0).otherwise(most(30, 95.0 - c("skipped_levels") * 10)), 0.20),
            },
            (c("n_headings") == 0) & (c("n_hierarchy") == 0),
            0.85,
            [((c("h1") == 0).cast("double"), 0.1), ((c("skipped_levels") > 0).cast("double"), 0.05), ((c("orphans") > 0).cast("double"), 0.05)],
            affected_by=("hydration_shell", "malformed_dom", "truncated_html"),
        ),
        Metric(
            "consistency",
            {
                "heading_style": (F.when(nh > 0, style / nh * 100).otherwise(50.0), 0.30),
                "terminology": (F.coalesce(terminology, F.lit(40.0)), 0.25),
                "tone": (F.when(nh > 0, most(40, 95 - 10 * _deviation(word_counts(h)))).otherwise(50.0), 0.20),
                "format": (F.when(np_ > 0, most(40, 95 - 0.5 * _deviation(word_counts(p)))).otherwise(50.0), 0.25),
            },
            (nh == 0) & (np_ == 0),
            0.80,
            [((nh < 3).cast("double"), 0.1), ((np_ < 3).cast("double"), 0.1)],
            affected_by=("malformed_dom", "encoding_failure", "truncated_html"),
        ),
        Metric(
            "semantic",
            {
                "tags": (ladder(t, [(6, 95), (4, 85), (2, 70), (1, 50)], 25), 0.30),
                "diversity": (F.least(F.lit(100.0), 40.0 + 10 * c("semantic_kinds")), 0.25),
                "landmarks": (20.0 * sum((c(f"has_{x}") for x in ("main", "nav", "header", "footer", "article")), F.lit(0)), 0.20),
                "structure": (ladder(s, [(8, 90), (4, 75), (2, 60), (1, 45)], 30), 0.25),
            },
            (c("n_semantic_html") == 0) & (s == 0),
            0.83,
            [((c("has_main") == 0).cast("double"), 0.1), ((t < 2).cast("double"), 0.1)],
            affected_by=("hydration_shell", "shadow_dom"),
        ),
        Metric(
            "completeness",
            {
                "coverage": (F.when(total > 50, 95.0).when(total > 25, 85.0).when(total > 10, 70.0).when(total > 5, 55.0).otherwise(30.0), 0.35),
                "diversity": (filled / 7 * 100, 0.25),
                "media": (yes(c("n_lists") > 0, 35, 0) + yes(c("n_tables") > 0, 35, 0) + yes(c("n_structured_data") > 0, 30, 0), 0.15),
                "metadata": (present / 6 * 100, 0.25),
            },
            total == 0,
            0.80,
            [((total < 10).cast("double"), 0.15), ((filled < 3).cast("double"), 0.1)],
            affected_by=("boilerplate_only", "script_only_dom", "truncated_html"),
        ),
        Metric(
            "semanticStructure",
            {
                "depth": (ladder(c("max_depth"), [(5, 90), (3, 80), (2, 65), (1, 45)], 25), 0.25),
                "sectioning": (ladder(c("structure_tags"), [(5, 95), (3, 80), (2, 65), (1, 45)], 25), 0.30),
                "nesting": (ladder(c("tree_nodes"), [(20, 90), (10, 78), (5, 65), (2, 50)], 30), 0.20),
                "orphan": (F.when(c("tree_headings") > 0, 100 - 60 * orphan_share).otherwise(40.0), 0.25),
            },
            (s == 0) & (c("n_hierarchy") == 0),
            0.82,
            [((c("skipped_levels") + c("orphans") > 2).cast("double"), 0.15), ((c("orphans") > 0).cast("double"), 0.05)],
            affected_by=("hydration_shell", "malformed_dom", "truncated_html"),
        ),
        Metric(
            "structuredData",
            {
                "json_ld": (ladder(c("json_ld"), [(3, 95), (2, 88), (1, 75)], 20), 0.40),
                "microdata": (ladder(c("microdata"), [(2, 80), (1, 65)], 30), 0.20),
                "types": (ladder(c("schema_types"), [(4, 95), (3, 85), (2, 70), (1, 55)], 25), 0.20),
                "validity": (F.when(all_data == 0, 30.0).when(c("json_ld_invalid") == 0, 95.0).otherwise(ratio(all_data - c("json_ld_invalid"), all_data) * 100), 0.20),
            },
            c("n_structured_data") == 0,
            0.85,
            [((c("json_ld_invalid") > 0).cast("double"), 0.1), ((c("json_ld") == 0).cast("double"), 0.1), ((c("schema_types") == 0).cast("double"), 0.15)],
            affected_by=("malformed_dom", "truncated_html", "encoding_failure"),
        ),
        Metric(
            "extractability",
            {
                "density": (100 * c("density"), 0.30),
                "noise": (100 * (1 - c("noise")), 0.20),
                "boilerplate": (F.when(b == 0, 95.0).when(b <= 2, 80.0).when(b <= 5, 60.0).otherwise(most(25, 80.0 - (b - 2) * 10)), 0.15),
                "redundancy": (F.when((r == 0) & (c("max_repeats") == 0), 95.0).when((r <= 2) & (c("max_repeats") <= 2), 80.0).when(r <= 5, 60.0).otherwise(most(20, 80.0 - r * 8)), 0.15),
                "region": (ladder(c("regions"), [(3, 95), (2, 80), (1, 60)], 30), 0.20),
            },
            F.lit(False),
            0.82,
            [((~c("extractable")).cast("double"), 0.2), ((c("noise") > 0.5).cast("double"), 0.1), ((c("density") < 0.3).cast("double"), 0.1)],
            floor=0.25,
            affected_by=("hydration_shell", "shadow_dom", "boilerplate_only", "script_only_dom", "missing_main_content"),
            extra=F.when(~c("extractable") & (F.size("contamination") == 0), 0.7).otherwise(1.0),
        ),
        Metric(
            "accessibility",
            {
                "alt": (F.when(c("img_alt") + c("img_missing_alt") == 0, 70.0).otherwise(100 * ratio(c("img_alt"), c("img_alt") + c("img_missing_alt"))), 0.35),
                "landmark": (ladder(c("landmarks"), [(5, 95), (3, 80), (2, 65), (1, 45)], 25), 0.20),
                "aria": (ladder(c("aria_labels"), [(5, 90), (2, 75), (1, 60)], 40), 0.15),
                "issues": (F.when(issues == 0, 95.0).when(issues <= 2, 75.0).when(issues <= 5, 55.0).otherwise(most(20, 75.0 - (issues - 2) * 10)), 0.20),
                "skip": (yes(c("skip_links") > 0, 90, 50), 0.10),
            },
            (c("n_accessibility") == 0) & (c("n_semantic_html") == 0),
            0.82,
            [((c("img_missing_alt") > 0).cast("double"), 0.1), ((issues > 3).cast("double"), 0.1), ((c("landmarks") == 0).cast("double"), 0.1)],
            affected_by=("shadow_dom", "malformed_dom"),
        ),
        Metric(
            "entityRecognition",
            {
                "count": (ladder(e, [(20, 95), (10, 85), (5, 70), (2, 55)], 35), 0.30),
                "diversity": (ladder(d, [(5, 95), (4, 85), (3, 72), (2, 55), (1, 40)], 20), 0.30),
                "confidence": (100 * c("entity_confidence"), 0.20),
                "coverage": (d / 12 * 100, 0.20),
            },
            e == 0,
            0.83,
            [((e < 5).cast("double"), 0.1), ((d < 2).cast("double"), 0.1)],
            affected_by=("script_only_dom", "encoding_failure", "truncated_html"),
        ),
        Metric(
            "machineComprehension",
            {
                "semantic": (F.when((t >= 5) & (s >= 5), 95.0).when((t >= 3) & (s >= 3), 80.0).when(t >= 2, 60.0).when(t >= 1, 40.0).otherwise(20.0), 0.25),
                "structure": (F.when(c("valid") & (c("n_headings") >= 5), 90.0).when(c("valid") & (c("n_headings") >= 2), 72.0).when(c("n_headings") > 0, 50.0).otherwise(25.0), 0.20),
                "extract": (F.when(c("extractable") & (c("density") > 0.5), 90.0).when(c("extractable"), 70.0).when(c("density") > 0.3, 50.0).otherwise(25.0), 0.20),
                "structured": (F.when((c("json_ld_invalid") == 0) & (c("json_ld") >= 2) & (c("schema_types") >= 3), 95.0).when((c("json_ld_invalid") == 0) & (c("json_ld") >= 1), 75.0).when(c("n_structured_data") > 0, 50.0).otherwise(20.0), 0.20),
                "entity": (F.when((e >= 10) & (d >= 4), 90.0).when((e >= 5) & (d >= 2), 72.0).when(e >= 2, 50.0).when(e >= 1, 35.0).otherwise(15.0), 0.15),
            },
            five == 0,
            0.80,
            [((~c("extractable")).cast("double"), 0.15), ((c("json_ld") == 0).cast("double"), 0.1), ((e < 3).cast("double"), 0.1), ((~c("valid")).cast("double"), 0.1), ((t < 2).cast("double"), 0.05)],
            floor=0.25,
            affected_by=("hydration_shell", "script_only_dom", "shadow_dom", "malformed_dom", "boilerplate_only", "encoding_failure", "truncated_html", "missing_main_content"),
        ),
    ]


def penalty(metric: Metric) -> Column:
    """Factor on a contaminated page's score: .9, or by severity where its type is one that the metric minds."""
    kind = c("contamination_type")
    minded = F.when(kind.isin(*CRITICAL), 0.5).otherwise(0.8)
    return F.when(kind.isNull(), 1.0).when(kind.isin(list(metric.affected_by)), minded).otherwise(0.9)


def evaluate(metric: Metric, contaminated: bool = True) -> Column:
    """The metric as a struct: metric, score, confidence, parts; nulls where evidence is missing. Its parts are columns."""
    part = {k: F.col(f"`{metric.name}:{k}`") for k in metric.parts}
    score = clamp_score(sum((part[k] * w for k, (_, w) in metric.parts.items()), F.lit(0.0)))
    confidence = F.lit(metric.confidence)
    for times, loss in metric.losses:
        confidence = confidence - times * loss
    confidence = F.greatest(F.lit(metric.floor), confidence)
    if metric.extra is not None:
        score = score * metric.extra
    if contaminated:
        score = score * penalty(metric)
        confidence = F.when(c("contamination_type").isNotNull(), confidence * 0.6).otherwise(confidence)
    parts = F.create_map(*(x for k, v in part.items() for x in (F.lit(k), v.cast("double"))))
    has = ~metric.missing
    return F.struct(F.lit(metric.name).alias("metric"), F.when(has, clamp_score(score)).alias("score"), F.when(has, clamp_confidence(confidence)).alias("confidence"), F.when(has, parts).alias("parts"))


def metric_rows(stats: DataFrame, metrics: list[Metric], id_col: str = "page_id", contaminated: bool = True) -> DataFrame:
    """(id, metric, score, confidence, parts): a row for each metric. Parts are columns first, so that each is worked out once."""
    parts = {f"{m.name}:{k}": clamp_score(v) for m in metrics for k, (v, _) in m.parts.items()}
    each = F.array(*(evaluate(m, contaminated) for m in metrics))
    keep = [x for x in ("contamination_type",) if contaminated]
    return stats.withColumns(parts).select(id_col, *keep, F.inline(each))
