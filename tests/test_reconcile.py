"""Evidence of several steps put together, and signals without a page's evidence."""

from pyspark.sql import functions as F

from pagelens.operators import blocks, reconcile
from pagelens.sources.html import parse_dom


def flags(spark, rows):
    return spark.createDataFrame(rows, "page_id long, contamination array<string>, blank boolean, parse_error string, mid_sentence_truncation boolean")


def test_merge_of_pages_without_fetch_or_rendering(spark):
    own = flags(spark, [(1, [], False, None, False), (2, ["malformed_dom"], False, None, False), (3, ["parser_error"], False, "PageError: x", False), (4, ["parser_error"], True, None, False)])
    fetches = spark.createDataFrame([(1, ["cors_proxy_used", "cors_block"], "p", None), (2, None, None, None), (4, ["fetch_failure"], None, "HTTP 503")], "page_id long, fetch_flags array<string>, proxy string, fetch_error string")
    renders = spark.createDataFrame([(2, True, ["hydration_shell", "hydration_shell"], None), (1, None, None, "no frame")], "page_id long, rendered boolean, render_flags array<string>, render_error string")
    got = {r.page_id: r for r in reconcile.merge_evidence(own, fetches, renders).collect()}
    assert (got[1].flags, got[1].contaminated, got[1].type, got[1].source) == ([], False, None, "fetched")
    assert [(r.source, r.type, r.severity, r.blocks) for r in got[1].records] == [("fetcher", "cors_proxy_fallback", "info", False)]
    assert got[2].flags == ["malformed_dom", "hydration_shell", "hydration_shell"] and got[2].type == "malformed_dom" and got[2].source == "rendered"
    assert all(r.blocks and r.severity == "critical" for r in got[2].records) and len(got[2].records) == 2
    assert (got[3].error, got[4].error, got[4].flags, got[4].records) == ("PageError: x", "HTTP 503", ["parser_error", "fetch_failure"], [])
    merged = reconcile.merge_evidence(own, fetches.where("false"), renders.where("false"))
    assert {r.page_id: r.error for r in reconcile.empty_evidence(merged).collect()} == {3: "PageError: x", 4: "Empty response from server"}
    assert reconcile.merge_evidence(own.where("false"), fetches, renders).count() == 0


def test_consistency_of_pages_without_signals(spark):
    own = flags(spark, [(1, [], False, None, True), (2, [], False, None, False)])
    rows = [(1, "headings", {})] * 3 + [(1, "hierarchy", {"heading": "true"})] * 3 + [(1, "semantic_structure", {})] * 6
    signals = spark.createDataFrame(rows, "page_id long, section string, meta map<string,string>")
    got = {r.page_id: r for r in reconcile.consistency(signals, own).collect()}
    assert not got[1].consistent and got[1].contradictions == ["Heading count mismatch: extractor=3, hierarchy=3, semanticStructure=6", "Mid-sentence truncation detected in visible text"]
    assert got[2].consistent and got[2].contradictions == [] and got[2].headings == 0


def test_blocks_within_blocks_and_without_parts(spark):
    html = """<div class="pricing-card">a <div class="faq"><p>not its first</p><summary>Q one</summary></div><div class="plan-name">Gold</div> $12 then $5.00</div>
    <div class="faq"></div><div class="specs-x"><div class="spec-item">""" + "k" * 150 + """</div></div><div class="review">fine</div><table><thead><tr><th>A</th><th>B</th></tr></thead></table>"""
    nodes = parse_dom(spark.createDataFrame([(1, html), (2, None), (3, "<p>x")], "page_id long, html string"))
    found = blocks.structured_content(nodes)
    got = {}
    for r in blocks.render_blocks(found).orderBy("pos").collect():
        got.setdefault(r.type, []).append((r.value, r.meta))
    assert [v for v, _ in got["faq_block"]] == ["Q: Q one", "Q: "] and got["faq_block"][0][1]["answer"] == "not its first"
    (price,) = got["pricing_block"]
    assert price[1]["price"] == "$12" and price[1]["plan"] == "Gold" and price[0].startswith("Gold — $12 — a not its first")
    assert [m["items"] for _, m in got["specs_block"]] == ["k" * 100 + "…", ""]  # the item's own class names specifications too
    assert got["review_block"][0][0] == "fine" and "comparison_block" not in got
    assert found.where(F.col("page_id") != 1).count() == 0


def test_blocks_try_their_selectors_once_and_join_only_the_nodes_that_these_find(spark):
    """The selectors are not in the plan of the signals, and what is joined for blocks are their own and their parts' nodes."""
    html = "<body><div><div class='faq'><div class='faq-question'>Why?</div><span>x</span><p>So.</p></div></div><div class='pricing-card'><h3>Pro</h3><b>$5 a month</b></div></body>"
    nodes = parse_dom(spark.createDataFrame([(1, html), (2, "<body><div><b>nothing</b></div></body>")], "page_id long, html string"))
    found = blocks.structured_content(nodes)
    assert "pricing-table" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.page_id, r.pre) for r in blocks.candidates(nodes).collect()} == {(r.page_id, r.pre) for r in nodes.where("tag in ('p', 'h3') or attrs['class'] is not null").collect()}
    rows = {r.type: (r.value, r.meta) for r in found.collect()}
    assert rows["faq_block"][0] == "Why?" and rows["faq_block"][1]["answer"] == "So."
    assert rows["pricing_block"][1]["plan"] == "Pro" and rows["pricing_block"][1]["price"] == "$5"
