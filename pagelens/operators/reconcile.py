"""What several extractors and the steps before them say of one page, held against each other and put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far counts of headings may be apart, flags that tell of a proxy and nothing else, and rendering flags that block a score.
APART = 2
PROXY_FLAGS = ["cors_proxy_fallback", "cors_block", "cors_proxy_used"]
BLOCKING = ["hydration_shell", "script_only_dom", "rendering_failed"]

RECORD = "struct<source:string,type:string,reason:string,severity:string,blocks:boolean>"
NO_FLAGS = "array<string>"


def consistency(signals: DataFrame, flags: DataFrame) -> DataFrame:
    """(page_id, headings, tree_headings, structure_signals, paragraphs, consistent, contradictions) of every page of flags.

    Headings are counted by their own extractor, in the kept tree, and as signals of sectioning; counts over APART from
    the first contradict each other, and so does a text that ends within a word. Pages without signals have counts of 0.
    """
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    section = F.col("section")
    per = signals.groupBy("page_id").agg(n(section == "headings").alias("headings"), n((section == "hierarchy") & (F.col("meta")["heading"] == "true")).alias("tree_headings"), n(section == "semantic_structure").alias("structure_signals"), n(section == "paragraphs").alias("paragraphs"))
    rows = flags.select("page_id", "mid_sentence_truncation").join(per, "page_id", "left").fillna(0, ["headings", "tree_headings", "structure_signals", "paragraphs"])
    agree = (F.abs(F.col("headings") - F.col("tree_headings")) <= APART) & (F.abs(F.col("headings") - F.col("structure_signals")) <= APART)
    mismatch = F.format_string("Heading count mismatch: extractor=%d, hierarchy=%d, semanticStructure=%d", "headings", "tree_headings", "structure_signals")
    contradictions = F.array_compact(F.array(F.when(~agree, mismatch), F.when(F.col("mid_sentence_truncation"), F.lit("Mid-sentence truncation detected in visible text"))))
    return rows.select("page_id", "headings", "tree_headings", "structure_signals", "paragraphs", agree.alias("consistent"), contradictions.alias("contradictions"))


def _record(source: Column | str, kind: Column, reason: Column, severity: Column, blocks: Column) -> Column:
    return F.struct((F.lit(source) if isinstance(source, str) else source).alias("source"), kind.alias("type"), reason.alias("reason"), severity.alias("severity"), blocks.alias("blocks"))


def merge_evidence(flags: DataFrame, fetches: DataFrame, renders: DataFrame) -> DataFrame:
    """Flags of pages with those of how they were fetched and rendered: (page_id, flags, contaminated, type, records, source, error).

    flags: page_flags; fetches: (page_id, fetch_flags, proxy, fetch_error); renders: (page_id, rendered, render_flags,
    render_error); pages may lack either. flags are the page's own, then the fetch's but those of a proxy, then the
    rendering's, repeats included; type is the first. records say where each later flag comes from, how severe it is and
    whether it blocks a score; the use of a proxy is a record of information alone. source is the html that was looked
    at, rendered or fetched. error tells why a page has no evidence: its parse, its fetch, or an empty response.
    """
    none = F.array().cast(NO_FLAGS)
    rows = flags.select("page_id", "contamination", "blank", "parse_error").join(fetches.select("page_id", "fetch_flags", "proxy", "fetch_error"), "page_id", "left").join(renders.select("page_id", "rendered", "render_flags", "render_error"), "page_id", "left")
    fetched = F.filter(F.coalesce("fetch_flags", none), lambda f: ~f.isin(PROXY_FLAGS))
    rendered = F.coalesce("render_flags", none)
    of_fetch = F.transform(F.filter(fetched, lambda f: f != "fetch_failure"), lambda f: _record("fetcher", f, F.concat(F.lit("Fetch contamination: "), f), F.lit("warning"), F.lit(False)))
    of_render = F.transform(rendered, lambda f: _record("evidence_layer", f, F.concat(F.lit("Rendering contamination: "), f), F.when(f.isin(BLOCKING), "critical").otherwise("warning"), f.isin(BLOCKING)))
    proxy = F.when(F.col("proxy").isNotNull(), F.array(_record("fetcher", F.lit("cors_proxy_fallback"), F.concat(F.lit("Fetched via CORS proxy: "), "proxy"), F.lit("info"), F.lit(False)))).otherwise(F.array().cast(f"array<{RECORD}>"))
    merged = F.concat("contamination", fetched, rendered)
    error = F.coalesce("parse_error", "fetch_error", F.when(F.col("blank"), "Empty response from server"))
    return rows.select("page_id", merged.alias("flags"), (F.size(merged) > 0).alias("contaminated"), F.get(merged, F.lit(0)).alias("type"), F.concat(of_fetch, of_render, proxy).alias("records"), F.when(F.coalesce("rendered", F.lit(False)), "rendered").otherwise("fetched").alias("source"), error.alias("error"), "render_error")


def empty_evidence(merged: DataFrame) -> DataFrame:
    """Of merge_evidence, the pages that have no evidence, each a critical record of its own: (page_id, error, flags, severity)."""
    return merged.where("error is not null").select("page_id", "error", "flags", F.lit("critical").alias("severity"))
