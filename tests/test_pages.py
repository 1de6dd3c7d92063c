import json

import pytest
from pyspark.sql import functions as F

from pagelens.operators import evidence, normalize
from pagelens.plans.audit import PageAudit
from pagelens.sources import corpus
from pagelens.sources.html import nodes_of, parse_dom

GOOD = """<!DOCTYPE html><html lang="en"><head><title>Shop guide</title><meta name="description" content="d"><meta property="og:title" content="t">
<link rel="canonical" href="https://a.com/x"><script type="application/ld+json">[{"@type":"Product"},{"@type":"Offer"}]</script></head><body>
<header>Top words stand here</header><nav><a href="/a">Home page</a><a href="https://b.com/">Other site</a></nav><main><h1>Guide to things</h1><h3>Skipped level</h3>
<p>This is the first paragraph of the guide, and it says a good deal. It goes on for a while so that a reader has text.</p>
<p>A second paragraph follows the first one here. It has two sentences as well.</p><ul><li>One</li><li>Two</li></ul>
<table><tr><th>K</th><th>V</th></tr><tr><td>a</td><td>1</td></tr></table><img src="x"><img src="y" alt="A dog"></main><footer>End of page</footer></body></html>"""
SHELL = '<html><body><div id="root"></div><script>window.__INITIAL_STATE__={}</script></body></html>'


@pytest.fixture(scope="module")
def audit(spark):
    rows = [(1, "https://a.com/x", GOOD), (2, "https://a.com/y", SHELL), (3, None, ""), (4, None, None), (5, "http://z", "<p>a<p>b</p><p>c")]
    return PageAudit(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("type", F.lit("clash")).withColumn("section", F.lit("x")))


def test_tree():
    show = lambda h: [(n["depth"], n["tag"] or n["text"]) for n in nodes_of(h)]
    assert show("<p>a<p>b") == [(0, "html"), (1, "head"), (1, "body"), (2, "p"), (3, "a"), (2, "p"), (3, "b")]
    assert show('<script>var t="</p>";</script>x')[2:4] == [(2, "script"), (3, 'var t="</p>";')]
    assert [t for _, t in show("<ul><li>1<li>2</ul>")].count("li") == 2
    assert [d for d, t in show("<table><tr><td>1<td>2<tr><td>3</table>") if t == "tr"] == [4, 4]
    assert nodes_of(None) == [] and nodes_of("  ") == []
    for n in nodes_of(GOOD):
        assert n["last"] >= n["pre"]


def test_visible_text_has_no_separator(audit):
    assert audit.texts.where("page_id = 5").first().visible_text == "abc"


def test_flags(audit):
    flags = {r.page_id: r for r in audit.flags.collect()}
    assert len(flags) == 5
    assert not flags[1].blocked and flags[1].contamination == []
    assert flags[2].blocked and flags[2].hydration_shell
    assert flags[3].blank and flags[4].blank and flags[3].blocked


def test_signals(audit):
    got = audit.signals.where("page_id = 1").collect()
    kinds = {}
    for s in got:
        kinds.setdefault(s.type, []).append(s.value)
    assert kinds["heading_h1"] == ["Guide to things"] and len(kinds["paragraph"]) == 2
    assert sorted(kinds["json_ld"]) == ["Offer", "Product"]
    assert kinds["internal_link"] == ["Home page"] and kinds["external_link"] == ["Other site"]
    assert kinds["unordered_list"] == ["One | Two"] and kinds["table"] == ["K | V / a | 1"]
    assert len(kinds["img_missing_alt"]) == 1 and kinds["img_alt"] == ["A dog"]
    assert "missing_main_landmark" not in kinds and "missing_viewport_meta" in kinds
    assert kinds["rdfa"] == ["og:title"]


def test_heading_levels(audit):
    rows = normalize.heading_issues(evidence.headings(audit.nodes).where("page_id = 1")).orderBy("pos").collect()
    assert [r.skips for r in rows] == [False, True] and rows[1].issue == "h3 follows h1"


def test_dedup_keeps_more_confident_at_first_place(spark):
    rows = [(1, "s", 3, "t", "Same one", 0.6), (1, "s", 1, "t", "same  one!", 0.5), (1, "s", 2, "t", "Привет", 0.9)]
    signals = spark.createDataFrame(rows, "page_id long, section string, pos int, type string, value string, confidence double").withColumn("meta", F.create_map().cast("map<string,string>"))
    kept = normalize.normalize_signals(signals)
    assert [(r.pos, r.confidence) for r in kept.collect()] == [(1, 0.6)]
    assert normalize.normalize_signals(kept.select(signals.columns)).count() == 1


def test_scores(audit):
    scores = {r.page_id: r for r in audit.scores.collect()}
    assert scores[1].status == "scored" and scores[1].final_score > 50 and 0 < scores[1].confidence <= 1
    assert scores[2].status == "blocked" and scores[2].final_score is None and scores[2].grade == "N/A"
    assert len(scores) == 5
    for m in audit.metric_rows.collect():
        assert m.score is None or 0 <= m.score <= 100
        assert m.confidence is None or 0 <= m.confidence <= 1


def test_absence_dominates(audit, spark):
    page = GOOD.replace("<main>", "<div>").replace("</main>", "</div>")
    row = PageAudit(spark.createDataFrame([(9, "https://a.com/", page)], "page_id long, url string, html string")).scores.first()
    assert row.final_score == 0 and row.confidence == 0.2 and row.weighted_score > 30 and row.status == "scored_absence_evidence"


def test_recommendations(audit):
    recs = audit.recommendations.where("page_id = 1").collect()
    assert "fix_hierarchy" not in recs and any("alt text" in r.message for r in recs) and any("skipping levels" in r.message for r in recs)
    report = json.loads(audit.reports.where("page_id = 1").first().report)
    ranks = [r["priority"] for r in report["recommendations"]]
    assert ranks == sorted(ranks, key=["high", "medium", "low"].index) and len({(r["category"], r["message"]) for r in report["recommendations"]}) == len(ranks)
    assert [m["place"] for m in report["metrics"]] == list(range(12))


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    a = PageAudit(none)
    assert a.scores.count() == 0 and a.signals.count() == 0 and a.reports.count() == 0


def test_text_markdown_json_pages(spark):
    docs = spark.createDataFrame([(1, "First & one.\n\nSecond."), (2, None)], "doc_id long, text string")
    rows = {r.page_id: r for r in corpus.text_pages(docs, "doc_id", "text").collect()}
    assert "<p>First &amp; one.</p>\n<p>Second.</p>" in rows[1].html and rows[2].input_flag == "empty_input"
    md = corpus.markdown_to_html("# T\n\ntext **b** [l](u)\n\n- a\n- b\n\n1. c\n\n```\n<x>\n```\n> q")
    for part in ("<h1>T</h1>", "<strong>b</strong>", '<a href="u">l</a>', "<ul>\n<li>\na\n</li>\n<li>\nb\n</li>\n</ul>", "<ol>", "&lt;x&gt;", "<blockquote>\nq\n</blockquote>"):
        assert part in md
    made = corpus.json_to_html('{"a": {"b": 1}, "l": [{"x": 1}, {"y": 2}], "s": ["u", "v"]}')
    assert "<h2>a</h2><p><strong>b:</strong> 1</p>" in made and "<th>x</th><th>y</th>" in made and "<li>u</li>" in made
    assert corpus.json_to_html("{") is None and corpus.json_to_html(None) is None
    assert corpus.json_to_html("[" * 100_000) is None and corpus.json_to_html('{"a":' * 3000 + "1" + "}" * 3000) is None
    cut = corpus.json_to_html(json.dumps([{"k": "&" * 300}]))
    assert "<td>" + "&amp;" * 200 + "</td>" in cut


@pytest.mark.parametrize(
    "text,want",
    [
        ("- a\n  - b\n    - c\n- d", "<ul><li>a<ul><li>b<ul><li>c</li></ul></li></ul></li><li>d</li></ul>"),
        ("3. x\n4. y", '<ol start="3"><li>x</li><li>y</li></ol>'),
        ("> a\n> - b\n> - c\n\nd", "<blockquote>a<ul><li>b</li><li>c</li></ul></blockquote><p>d</p>"),
        ("- a\n\n  para\n- b", "<ul><li>a<p>para</p></li><li>b</li></ul>"),
        ("1. a\n   ```\n   code\n   ```\n2. b", "<ol><li>a<pre><code>code</code></pre></li><li>b</li></ol>"),
        ("> > deep\n> one", "<blockquote><blockquote>deep</blockquote><p>one</p></blockquote>"),
        ("- a\n1. b", "<ul><li>a</li></ul><ol><li>b</li></ol>"),
        ("* * *", "<hr>"),
        ("a\nb", "<p>a</p><p>b</p>"),
        ("- \n- x", "<ul><li></li><li>x</li></ul>"),
        ("text\n- item\nmore", "<p>text</p><ul><li>item</li></ul><p>more</p>"),
        ("`a*b*` *c* __d__ _e_", "<p><code>a*b*</code> <em>c</em> <strong>d</strong> <em>e</em></p>"),
        ("```\nopen <b>", "<pre><code>open &lt;b&gt;</code></pre>"),
        ("> # h\n> p\nq", "<blockquote><h1>h</h1><p>p</p></blockquote><p>q</p>"),
        ("10) ten\n11) eleven\n    - sub", '<ol start="10"><li>ten</li><li>eleven<ul><li>sub</li></ul></li></ol>'),
        ("[a & b](http://x?y=1&z=2) <i>", '<p><a href="http://x?y=1&amp;z=2">a &amp; b</a> &lt;i&gt;</p>'),
        ("# one\r\n#two\n####### seven", "<h1>one</h1><p>#two</p><p>####### seven</p>"),
        ("", ""),
    ],
)
def test_markdown_blocks(text, want):
    made = corpus.markdown_to_html(text, "the title")
    assert made.partition("<main>\n")[2].partition("\n</main>")[0].replace("\n", "") == want
    assert f"<title>{'one' if text.startswith('# one') else 'the title'}</title>" in made and '<html lang="en">' in made


def test_every_part_has_a_product_page(spark, tmp_path):
    from pagelens.plans import catalog

    parts = [(i, f"name {i}", i % 50 + 1, f"Brand#{i % 7}") for i in (1, 3, 500, 501, 502, 20_000)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["product_page_evidence"](spark, str(tmp_path)).collect())
    assert got == [(i, size % 5 + 2, "Name | Value", 1, "Product", int(i % 3 > 0), 1) for i, _, size, _ in parts]


def test_pages_are_parsed_whole(spark):
    page = "<html><body><p>" + "x" * (10 << 20) + '</p><a href="/late">Late link</a>' + "<i>n</i>" * 15_000 + "</body></html>"
    rows = [(1, "u", page), (2, "u", "<p>short</p>"), (3, "u", None), (4, "u", "<b>last</b>")]
    nodes = parse_dom(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(r.page_id, r.tag): r.n for r in nodes.where("kind = 'element'").groupBy("page_id", "tag").agg(F.count("*").alias("n")).collect()}
    assert got[1, "a"] == 1 and got[1, "i"] == 15_000 and got[2, "p"] == 1 and got[4, "b"] == 1 and {p for p, _ in got} == {1, 2, 4}


def test_topics_of_paragraphs_are_their_most_frequent_long_words(spark):
    """Against a plain count, on paragraphs of words that repeat; ties go to the word that comes first."""
    import random
    from collections import Counter

    from pagelens.operators import evidence

    rnd, texts = random.Random(4), ["", "tiny", "aaaaa"]
    for n in range(400):
        vocabulary = ["".join(rnd.choice("abcé") for _ in range(rnd.randrange(3, 9))) for _ in range(30)]
        texts.append(" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 120))))
    rows = [(i, "paragraphs", 1, "paragraph", x, 0.9, {"words": str(len(x.split()))}) for i, x in enumerate(texts)]
    schema = "page_id long, section string, pos int, type string, value string, confidence double, meta map<string,string>"

    def topic(text):
        words = [w for w in text.split() if len(w) > 4]
        n = Counter(words)
        return ",".join(sorted(n, key=lambda w: (-n[w], words.index(w)))[:3])

    got = evidence.semantic_paragraphs(spark.createDataFrame(rows, schema)).select("page_id", F.col("meta")["topic"]).collect()
    assert {i: t for i, t in got} == {i: topic(x) for i, x in enumerate(texts)}
