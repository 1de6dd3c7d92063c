from pagelens.operators import benchmark as B
from pagelens.operators import evidence, inventory, normalize
from pagelens.sources.html import parse_dom
from tests.test_benchmark import frame, result

PAGE = """<html><body><div id="top" class="a b c"><p>x</p><p class="q r s">y</p></div><article>first</article><div role="main">second</div>
<img data-src="u.png"><img src="v.png" loading="lazy"><img src="w.png"><div class="elementor-section"><div class="elementor-widget elementor-widget-image"></div>
<div class="elementor-widget elementor-widget-heading"></div></div><ul><li>One | two</li></ul><form><label for="n">N</label><input id="n"><input name="m"></form></body></html>"""


def nodes(spark):
    return parse_dom(spark.createDataFrame([(1, PAGE), (2, None)], "page_id long, html string")).cache()


def test_selectors(spark):
    n = nodes(spark)
    got = {r.selector for r in inventory.selectors(n).join(n.where("tag = 'p' or tag = 'article'"), ["page_id", "pre"]).collect()}
    assert got == {"#top > p:nth-of-type(1)", "#top > p.q.r:nth-of-type(2)", "html > body > article"}


def test_main_content(spark):
    row = inventory.main_content(nodes(spark)).first()
    assert (row.tag, row.content) == ("div", "second")


def test_lazy_and_builder(spark):
    n = nodes(spark)
    lazy = inventory.lazy_media(n).first()
    assert (lazy.lazy, lazy.unloaded, lazy.observer) == (2, 1, False)
    built = inventory.builder_inventory(n).first()
    assert (built.section, built.widget, built.widget_types) == (1, 2, ["heading", "image"])


def test_items_and_labels(spark):
    n = nodes(spark)
    assert [r["item"] for r in normalize.flatten_items(evidence.lists(n)).orderBy("at").collect()] == ["One", "two"]
    assert [r.value for r in evidence.accessibility(n).where("type = 'unlabeled_input'").collect()] == ["m"]


def test_baseline_lines(spark):
    made = B.create_baseline(frame(spark, result("1"), result("2", None)), "h")
    lines = B.serialize_baseline(made).union(spark.createDataFrame([("{",), ('{"case_id":"9"}',)], "line string"))
    back = {(r.case_id, r.problem) for r in B.deserialize_baseline(lines, made.schema).collect()}
    assert back == {("1", None), ("2", None), (None, "invalid json"), ("9", "missing fields")}


def test_compare_or_store(spark, tmp_path):
    path = str(tmp_path / "base")
    assert B.compare_or_store(frame(spark, result("1")), path, "h") is None
    assert [r.type for r in B.compare_or_store(frame(spark, result("1", 70.0)), path, "h").collect()] == ["score"]
    assert B.compare_or_store(frame(spark, result("1")), path, "other") is None
