"""Tree construction against trees that the HTML standard prescribes, and containment joins against brute force."""

import gc
import random
import time

import pytest
from pyspark.sql import functions as F

from pagelens.operators import containment
from pagelens.plans.audit import PageAudit
from pagelens.sources import html as H
from pagelens.sources import tree
from pagelens.sources.html import guarded, nodes_of, parse_dom


def show(e) -> str:
    if isinstance(e, tree.Text):
        return '"' + "".join(e.parts) + '"'
    return e.tag + (f"({' '.join(map(show, e.kids))})" if e.kids else "")


@pytest.mark.parametrize(
    "html,want",
    [
        ("<b><p>a</b>c</p>", 'b p(b("a") "c")'),
        ("<table>foo<tr>", '"foo" table(tbody(tr))'),
        ("<p>1<b>2<i>3</b>4</i>5", 'p("1" b("2" i("3")) i("4") "5")'),
        ("<b>1<p>2</b>3</p>", 'b("1") p(b("2") "3")'),
        ("<a>1<div>2<div>3</a>4</div>5</div>", 'a("1") div(a("2") div(a("3") "4") "5")'),
        ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", 'b b("bbb") table(tbody(tr(td("aaa")))) b("ccc")'),
        ("<b><em><foo><foo><aside></b></em>", "b(em(foo(foo))) em aside(em(b))"),
        ("<p>a<![foo[x]]>b</p>", 'p("ab")'),
        ("<p><![>y", 'p("y")'),
        ("<!DOCTYPE html><p><table></table>", "p table"),
        ("<p><table></table>", "p(table)"),
        ("<ul><li>1<li>2</ul>", 'ul(li("1") li("2"))'),
        ("<table><tr><td>1<td>2<tr><td>3</table>", 'table(tbody(tr(td("1") td("2")) tr(td("3"))))'),
        ("<select><option>a<option>b<optgroup><option>c</select>x", 'select(option("a") option("b") optgroup(option("c"))) "x"'),
        ("<svg><title>t</title><path/><g><p>x</g></svg>y", 'svg(title("t") path g) p("xy")'),
        ("</p></br>", "br"),
        ("x</p>", '"x" p'),
        ("<textarea>\n<b>&amp;</textarea>x", 'textarea("<b>&") "x"'),
        ("<button><p><button>x", 'button(p) button("x")'),
        ("<dl><dt>a<dd>b<dt>c</dl>", 'dl(dt("a") dd("b") dt("c"))'),
        ("<table><caption>c<tr><td>x</table>", 'table(caption("c") tbody(tr(td("x"))))'),
        ("<h1>a<h2>b</h1>c", 'h1("a") h2("b") "c"'),
        ("<b class=x><b class=x><b class=x><b class=x><p>y", 'b(b(b(b(p("y")))))'),
        ("<pre>\n\nx</pre>", 'pre("\nx")'),
        ("a<!-->b<!--x--!>c<?p?>d</>e", '"abcde"'),
        ("<a><table><td><a><table></table><a></tr><a></table><b>X</b>C<a>Y", 'a(a table(tbody(tr(td(a(table) a))))) a(b("X") "C") a("Y")'),
    ],
)
def test_bodies(html, want):
    root = tree.Builder().build(html)
    assert [k.tag for k in root.kids] == ["head", "body"]
    assert " ".join(map(show, root.kids[1].kids)) == want


def test_heads_frames_and_attributes():
    whole = lambda h: show(tree.Builder().build(h))
    assert whole("") == whole("<!-- x -->") == "html(head body)"
    assert whole("<script>a</script") == 'html(head(script("a</script")) body)'
    assert whole("<head><noscript><p>x</noscript>") == 'html(head(noscript) body(p("x")))'
    assert whole("<title>a<b></title><meta>t") == 'html(head(title("a<b>") meta) body("t"))'
    assert whole("<frameset><frame></frameset>x") == "html(head frameset(frame))"
    found = tree.Builder().build("<a href=1 HREF='2' x=\"a&lt;b\" y / z=>k").kids[1].kids[0]
    assert found.attrs == {"href": "1", "x": "a<b", "y": "", "z": ""}


def test_no_text_raises():
    rnd = random.Random(4)
    parts = [f"<{'/' * rnd.randrange(2)}{t}>" for t in "a b i p div table tr td th tbody caption col colgroup select option li ul dd h1 svg math mi title form button template html head body script style textarea br nobr object frameset frame noscript".split() for _ in range(2)] + ["x", " ", "&amp;", "&#x0;", "<!--", "-->", "<![CDATA[", "]]>", "<?", "<!", "<", "</", "='", '"', "\x00", "é", "\ud800"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 40)))
        columns, problem = guarded(text)
        assert problem is None, text
        pre, last, parent = columns[:3]
        assert pre == list(range(len(pre))) and all(p is None or p < i <= last[p] for i, p in zip(pre, parent))


def test_work_is_linear_in_nesting():
    for text in ("<div>" * 100_000 + "x", "<p><button>" + "<div>" * 50_000, "<ul><li>" * 30_000 + "some text", "<table><tr><td>" * 20_000, "<table>" + "<i>x" * 20_000):
        began = time.process_time()
        nodes = nodes_of(text)
        assert len(nodes) > 40_000 and time.process_time() - began < 30
    deep = nodes_of("<div>" * 100_000 + "x")
    assert deep[-1]["depth"] == 100_002 and deep[2]["last"] == 100_003 and deep[50_000]["within"] == ("body",)


def test_content_is_collapsed_and_counted():
    html = "<div> a \n b<p>" + "word " * 200 + "</p> z\t</div><p>é\U0001f600 x</p>"
    nodes = [n for n in nodes_of(html) if n["kind"] == "element" and n["content"] is not None]
    div, p, last = (next(n for n in nodes if n["tag"] == "div"), *(n for n in nodes if n["tag"] == "p"))
    whole = "a b" + "word " * 200 + "z"
    assert div["content"] == whole[:300].rstrip() and div["chars"] == len(whole)
    assert p["content"] == ("word " * 200).strip() and p["chars"] == len(p["content"]) and last["chars"] == len(last["content"]) == 4


def test_a_failing_page_is_a_row(spark, monkeypatch):
    """Formatting that would grow beyond measure fails its page alone; the audit returns all pages."""
    bomb = "<p>" + "".join(f"<font color={i}>" for i in range(3000)) + "<p>x" * 3000
    rows = [(1, "http://a", "<main><h1>Title of it</h1><p>One text of a page that is fine.</p></main>"), (2, "http://b", bomb), (3, "http://c", "<p>a<![foo[x]]>b</p>"), (4, "http://d", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    nodes = parse_dom(pages)
    assert [(r.page_id, "grows" in r.text) for r in nodes.where("kind = 'error'").collect()] == [(2, True)]
    flags = {r.page_id: r for r in PageAudit(pages).flags.collect()}
    assert sorted(flags) == [1, 2, 3, 4]
    assert flags[2].blocked and flags[2].parse_error.startswith("PageError") and flags[2].contamination[0] == "parser_error"
    assert flags[1].parse_error is None and flags[1].contamination_type != "parser_error"


@pytest.fixture(scope="module")
def random_nodes(spark):
    rnd, rows = random.Random(8), []
    for page in range(12):
        text = "".join(rnd.choice(["<div>", "<p>", "<ul><li>", "<h2>x</h2>", "</div>", "<h3>y</h3>", "<section>", "</section>"]) for _ in range(rnd.randrange(60)))
        rows.append((page, text))
    return parse_dom(spark.createDataFrame(rows, "page_id long, html string")).cache()


def test_containment_against_brute_force(random_nodes):
    n = random_nodes.collect()
    heading, box = (lambda r: r.tag in ("h2", "h3")), (lambda r: r.tag in ("div", "section", "li"))
    is_heading, is_box = F.col("tag").isin("h2", "h3"), F.col("tag").isin("div", "section", "li")
    inside = [(a, b) for a in n for b in n if a.page_id == b.page_id and a.pre < b.pre <= a.last]
    want = {(a.page_id, a.pre, b.pre) for a, b in inside if box(a) and heading(b)}
    assert {tuple(r) for r in containment.pairs(random_nodes, is_box, is_heading).collect()} == want and want
    assert {tuple(r) for r in containment.holding(random_nodes, is_box, is_heading).collect()} == {x[:2] for x in want}
    got = {(r.page_id, r.pre): (r.up, r.n, r.bits) for r in containment.enclosing(random_nodes, is_box, is_heading, F.shiftleft(F.lit(1), 3) + F.col("depth") % 2).collect()}
    for b in filter(heading, n):
        ups = [a for a, x in inside if x is b and box(a)]
        bits = 0
        for a in ups:
            bits |= 8 + a.depth % 2
        assert got[b.page_id, b.pre] == (max((a.pre for a in ups), default=None), len(ups), bits)


def test_containment_of_deep_nesting(spark):
    text = "<div>" * 100_000 + "<h1>x</h1>"
    nodes = parse_dom(spark.createDataFrame([(1, text)], "page_id long, html string"))
    assert containment.holding(nodes, F.col("tag") == "div", F.col("tag") == "h1").count() == 100_000
    assert containment.enclosing(nodes, F.col("tag") == "div", F.col("tag") == "h1").first().n == 100_000
    assert containment.pairs(nodes.where("false"), F.lit(True), F.lit(True)).count() == 0


def test_shown_text_lengths():
    rnd = random.Random(3)
    text = "".join(rnd.choice("ab  \n é") for _ in range(300))
    page = H._Shown(text)
    for _ in range(300):
        a = rnd.randrange(301)
        b = rnd.randrange(a, 301)
        want = H._BLANKS.sub(" ", text[a:b]).strip(" ")
        assert page.chars(a, b) == len(want) and page.head(a, b, None) == want and page.head(a, b, 9) == want[:9].rstrip(" ")


def test_pages_move_before_they_are_parsed(spark, monkeypatch):
    """Nodes are many times their pages' rows: the exchange stands below the parser."""
    from pagelens.plans import audit

    plans = {}
    monkeypatch.setattr(audit, "by_page", lambda df, name: plans.setdefault(name, df))
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b")], "page_id long, url string, html string")
    plan = PageAudit(pages).nodes._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("MapInArrow") < plan.index("RepartitionByExpression")
    assert plans["nodes"].where("tag = 'p'").count() == 2


def test_parsed_trees_leave_nothing_to_the_collector():
    guarded("<p>x")
    gc.collect()
    gc.disable()
    try:
        columns, problem = guarded("<table><b><tr><td>aaa</td></tr>bbb</table>ccc" + "<ul><li>x<b>y</b></ul>" * 200)
        left = gc.collect()
    finally:
        gc.enable()
    assert problem is None and len(columns[0]) > 1000 and left < 50
