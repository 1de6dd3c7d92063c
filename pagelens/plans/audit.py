"""The audit of pages from end to end: nodes, flags, signals, stats, metrics, scores and reports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.operators import diagnostics, dom, evidence, metrics, normalize, reports, scoring
from pagelens.operators.entities import dedup_entities, extract_entities
from pagelens.plans.scratch import by_page, dealt, written_apart
from pagelens.sources.html import parse_dom


class PageAudit:
    """Lazy tables of one set of pages (page_id, url, html); what several others read is written once, in buckets by page.

    Pages and their nodes are dealt out by page once. All later tables lie as those do, so that nothing that is counted,
    ranked or joined within pages moves rows again; only containment joins' few rows do.
    """

    def __init__(self, pages: DataFrame, weights: dict[str, float] | None = None):
        self.given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
        self.weights = weights

    @cached_property
    def pages(self) -> DataFrame:
        return by_page(dealt(self.given), "pages")

    @cached_property
    def nodes(self) -> DataFrame:
        return by_page(parse_dom(dealt(self.given)), "nodes")  # pages move, not their many nodes

    @cached_property
    def flags(self) -> DataFrame:
        return by_page(dom.page_flags(self.nodes, self.pages), "flags")

    @cached_property
    def texts(self) -> DataFrame:
        return self.flags.select("page_id", "visible_text", "element_text")

    @cached_property
    def signals(self) -> DataFrame:
        return written_apart(evidence.extractors(self.pages, self.nodes, self.texts), "signals")

    @cached_property
    def kept(self) -> DataFrame:
        return by_page(normalize.normalize_signals(dealt(self.signals)), "kept")

    @cached_property
    def stats(self) -> DataFrame:
        extract = evidence.extractability(self.nodes, self.flags, self.pages)
        return by_page(normalize.page_stats(self.kept, self.flags, extract), "stats")

    @cached_property
    def metric_rows(self) -> DataFrame:
        """Blocked pages have no metrics."""
        return by_page(metrics.metric_rows(self.stats.where("not blocked"), metrics.text_metrics() + metrics.page_metrics()), "metrics")

    @cached_property
    def scores(self) -> DataFrame:
        return scoring.final_scores(self.metric_rows, self.stats, self.weights)

    @cached_property
    def recommendations(self) -> DataFrame:
        return reports.recommendations(self.stats, self.metric_rows)

    @cached_property
    def all_reports(self) -> DataFrame:
        """(page_id, full, developer, summary): the three reports of each page."""
        found = diagnostics.scoring_diagnostics(self.stats, self.metric_rows)
        said = diagnostics.report_diagnostics(self.scores, found)
        developer = reports.developer_report(self.scores, self.metric_rows, found, said, self.signals, self.kept)
        summary = reports.summary_report(self.scores, self.recommendations, reports.weaknesses(self.stats, self.metric_rows))
        named = [self.reports.withColumnRenamed("report", "full"), developer.withColumnRenamed("report", "developer"), summary.withColumnRenamed("report", "summary")]
        return named[0].join(named[1], "page_id").join(named[2], "page_id")

    @cached_property
    def reports(self) -> DataFrame:
        return reports.full_report(self.scores, self.metric_rows, self.recommendations)


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences, words and paragraphs of plain texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda p: p != "")
    normal = docs.select(id_col, T.normalize_text(text).alias("normal"), F.size(paragraphs).alias("n_paragraphs"))  # once, for sentences and words
    return T.text_numbers(normal.select(id_col, T.sentences_of_normal(F.col("normal")).alias("sentence_list"), T.words_of_normal(F.col("normal")).alias("word_list"), "n_paragraphs"))


def text_metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Readability and clarity of plain texts, a row each."""
    return metrics.metric_rows(text_stats(docs, id_col, text_col), metrics.text_metrics(), id_col, contaminated=False)


def text_entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    found = extract_entities(docs, id_col, text_col)
    return dedup_entities(found, id_col) if distinct else found
