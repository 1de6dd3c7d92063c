"""Normalisation of signals: clean values, drop repeats, and the counts that scores are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import text as T

# Severities by contamination type.
SEVERITY = {"dom_corruption": "critical", "hydration_shell": "critical", "script_only_dom": "critical", "fetch_failure": "critical", "invalid_url": "critical", "unsupported_protocol": "critical"}


def normalize_signals(signals: DataFrame) -> DataFrame:
    """Clean values and drop repeats: per page, section and comparison key the most confident signal stays, at the first one's place.

    Values whose key is empty (nothing of ASCII in them) are dropped.
    """
    rows = signals.where(T.has_key(F.col("value"))).withColumn("value", T.normalize_text(F.col("value"))).withColumn("key", T.key_of_normal(F.col("value")))
    w = W.partitionBy("page_id", "section", "key")
    rows = rows.withColumn("first", F.min("pos").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("confidence"), "pos", "type"))).where("rank = 1")
    return rows.withColumn("pos", F.col("first")).drop("rank", "first")


def dedup_counts(signals: DataFrame, kept: DataFrame) -> DataFrame:
    """Signals of each section before and after, and how many went."""
    before = signals.groupBy("page_id", "section").agg(F.count("*").alias("original"))
    after = kept.groupBy("page_id", "section").agg(F.count("*").alias("kept"))
    return before.join(after, ["page_id", "section"], "left").fillna(0, ["kept"]).withColumn("removed", F.col("original") - F.col("kept"))


def section_content(kept: DataFrame) -> DataFrame:
    """Each section's values in order, one text."""
    values = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return kept.groupBy("page_id", "section").agg(F.array_join(F.transform(values, lambda v: v["value"]), " ").alias("content"))


def heading_issues(headings: DataFrame) -> DataFrame:
    """Headings with the level before them, and an issue where a level is skipped."""
    level = F.col("meta")["level"].cast("int")
    before = F.lag("level").over(W.partitionBy("page_id").orderBy("pos"))
    rows = headings.withColumn("level", level).withColumn("previous", before)
    return rows.withColumn("skips", F.coalesce(F.col("level") - F.col("previous") > 1, F.lit(False))).withColumn("issue", F.when(F.col("skips"), F.format_string("h%d follows h%d", "level", "previous")))


def cross_references(links: DataFrame) -> DataFrame:
    href = F.col("meta")["href"]
    return links.withColumn("reference", F.when(href.startswith("#"), "anchor").when(href.startswith("/") | href.startswith("./"), "relative").otherwise("external"))


def hierarchy_stats(signals: DataFrame) -> DataFrame:
    """Depth, nodes, headings and orphans of each page's kept tree; valid where orphans are under half the headings."""
    meta = F.col("meta")
    of = lambda name: F.sum(F.when(meta[name] == "true", 1).otherwise(0))
    per = signals.where("section = 'hierarchy'").groupBy("page_id").agg(F.max(meta["depth"].cast("int")).alias("max_depth"), F.count("*").alias("tree_nodes"), of("heading").alias("tree_headings"), of("orphan").alias("orphans"))
    return per.withColumn("valid", (F.col("tree_headings") > 0) & (F.col("orphans") < F.col("tree_headings") / 2))


def domain_ranking(signals: DataFrame) -> DataFrame:
    """Running score of domains in signal order, and the primary one."""
    rows = signals.where("section = 'domain_profile'").withColumn("score", F.col("meta")["score"].cast("double"))
    running = F.sum("score").over(W.partitionBy("page_id", "value").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    total = rows.withColumn("running", running)
    best = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("running"), "pos"))
    return total.withColumn("rank", best)


def contamination_rows(flags: DataFrame) -> DataFrame:
    """One row for each page's contamination type, in detection order, with its severity."""
    rows = flags.select("page_id", F.posexplode("contamination").alias("pos", "type"))
    severity = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv)), F.col("type")), F.lit("warning"))
    return rows.withColumn("severity", severity).withColumn("blocks", F.col("severity") == "critical")


def page_stats(kept: DataFrame, flags: DataFrame, extract: DataFrame) -> DataFrame:
    """The inputs of all scores, one row a page: conditional counts in a single grouping by page."""
    n = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    section, kind, meta = F.col("section"), F.col("type"), F.col("meta")
    tag = F.col("meta")["tag"]
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")  # noqa: E731  # small sets; distinct counts would expand every row seven times
    counts = kept.groupBy("page_id").agg(
        *(n(section == s).alias(f"n_{s}") for s in ("headings", "paragraphs", "lists", "tables", "links", "accessibility", "structured_data", "semantic_html", "semantic_structure", "entities", "redundancy", "absence", "hierarchy", "structured_content")),
        distinct(F.when(section == "headings", meta["level"])).alias("heading_levels"),
        n(kind == "heading_h1").alias("h1"),
        distinct(F.when(section == "semantic_html", tag)).alias("semantic_tags"),
        distinct(F.when(section == "semantic_structure", tag)).alias("structure_tags"),
        distinct(F.when(section.isin("semantic_html", "semantic_structure"), kind)).alias("semantic_kinds"),
        *(F.max(F.when((section == "semantic_html") & (tag == t), 1).otherwise(0)).alias(f"has_{t}") for t in ("main", "nav", "header", "footer", "article")),
        n(kind == "json_ld").alias("json_ld"),
        n(kind == "json_ld_invalid").alias("json_ld_invalid"),
        n(kind == "microdata").alias("microdata"),
        distinct(F.when((section == "structured_data") & F.col("value").isin(T.SCHEMA_TYPES), F.col("value"))).alias("schema_types"),
        n(kind == "img_alt").alias("img_alt"),
        n(kind == "img_missing_alt").alias("img_missing_alt"),
        n(kind.isin("aria_landmark", "semantic_landmark")).alias("landmarks"),
        n(kind == "aria_label").alias("aria_labels"),
        n(kind.isin("img_missing_alt", "unlabeled_input")).alias("accessibility_issues"),
        n(kind == "skip_link").alias("skip_links"),
        distinct(F.when(section == "entities", kind)).alias("entity_kinds"),
        F.avg(F.when(section == "entities", F.col("confidence"))).alias("entity_confidence"),
        F.max(F.when(section == "redundancy", meta["repeats"].cast("int"))).alias("max_repeats"),
        F.collect_set(F.when(section == "absence", F.col("value"))).alias("absent"),
        F.sort_array(F.collect_list(F.when(section == "headings", F.struct("pos", "value")))).alias("heading_values"),
        F.sort_array(F.collect_list(F.when(section == "paragraphs", F.struct("pos", "value")))).alias("paragraph_values"),
    )
    extract = extract.hint("merge")
    skips = heading_issues(kept.where("section = 'headings'")).groupBy("page_id").agg(n(F.col("skips")).alias("skipped_levels"))
    normal = flags.drop("element_text").withColumn("visible_text", T.normalize_text(F.col("visible_text")))  # once, for sentences and words
    listed = normal.withColumns({"sentence_list": T.sentences_of_normal(F.col("visible_text")), "word_list": T.words_of_normal(F.col("visible_text"))})
    numbers = T.text_numbers(listed).drop("visible_text", "sentence_list", "word_list")  # a page's text goes no further than its numbers
    rows = numbers.join(counts, "page_id", "left").join(skips, "page_id", "left").join(hierarchy_stats(kept), "page_id", "left").join(extract.drop("extractable"), "page_id", "left").join(extract.select("page_id", "extractable"), "page_id", "left")
    counted = [c for c, t in rows.dtypes if t in ("bigint", "int", "double") and c not in ("page_id", "entity_confidence")]
    rows = rows.fillna(0, counted).fillna(False, ["valid", "extractable"]).fillna(0.0, ["entity_confidence"])
    return rows.withColumn("absent", F.transform(F.coalesce("absent", F.array()), lambda a: F.replace(a, F.lit(" "), F.lit("_"))))


def flatten_items(lists: DataFrame) -> DataFrame:
    """Items of list signals, cleaned, a row each."""
    items = F.filter(F.transform(F.split("value", r"\s*\|\s*"), lambda i: T.normalize_text(i)), lambda i: i != "")
    return lists.select("page_id", "pos", F.posexplode(items).alias("at", "item"))


def word_matrix(signals: DataFrame) -> DataFrame:
    """Words of every signal's value: of paragraphs, list items or table rows."""
    return signals.select("page_id", "section", "pos", T.words(F.col("value")).alias("words"))


def structured_data_summary(kept: DataFrame) -> DataFrame:
    """Structured data by format after dedup, and the distinct types."""
    n = lambda kind: F.sum((F.col("type") == kind).cast("int")).alias(kind)
    return kept.where("section = 'structured_data'").groupBy("page_id").agg(n("json_ld"), n("json_ld_invalid"), n("microdata"), n("rdfa"), F.array_sort(F.collect_set("value")).alias("types"))


def accessibility_summary(kept: DataFrame) -> DataFrame:
    """Alt coverage (1 where there are no images), landmarks and issues of each page."""
    n = lambda *kinds: F.sum(F.col("type").isin(*kinds).cast("int"))
    per = kept.where("section = 'accessibility'").groupBy("page_id").agg(n("img_alt").alias("with_alt"), n("img_missing_alt").alias("without_alt"), F.countDistinct(F.when(F.col("type").isin("aria_landmark", "semantic_landmark"), F.col("value"))).alias("landmarks"), n("img_missing_alt", "unlabeled_input").alias("issues"))
    images = F.col("with_alt") + F.col("without_alt")
    return per.withColumn("alt_coverage", F.when(images > 0, F.col("with_alt") / images).otherwise(1.0))
