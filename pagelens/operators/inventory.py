"""Inventories of a page's elements: selectors, the main content, lazily loaded media, page-builder widgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.operators import containment, dom

# Selectors of lazily loaded elements, and classes and attributes of a page builder's parts.
LAZY_SELECTORS = ['[loading="lazy"]', "[data-lazy]", "[data-lazy-src]", "[data-src]", "[data-bg]", "[data-background]", "[data-lazyload]", "[data-ll-status]", "[data-was-processed]", "[data-elementor-type]", "[data-elementor-id]", ".lazy", ".lazyload", ".lazy-loading", ".lazyload-pending", ".lazyload-item"]
BUILDER_PARTS = {
    "section": ["elementor-section", "elementor-top-section", "elementor-inner-section", "elementor-section-wrap", "e-con", "e-con-inner", "e-con-boxed", "e-con-full"],
    "container": ["elementor-container", "elementor-widget-container", "elementor-element", "elementor-element-populated", "elementor-widget-wrap"],
    "column": ["elementor-column", "elementor-col-"],
    "widget": ["elementor-widget"],
}
BUILDER_ATTRIBUTES = ["data-elementor-type", "data-elementor-id", "data-elementor-settings", "data-elementor-post-type", "data-elementor-device-mode"]
BUILDER_SCRIPTS = ["elementor/frontend", "elementorFrontend", "elementor-webpack", "elementor-pro"]


def selectors(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, selector): #id where there is one, else the path of tags from the nearest id or the root.

    A tag takes :nth-of-type where a sibling has the same tag, and at most two of its classes.
    """
    element = nodes.where("kind = 'element'")
    same = W.partitionBy("page_id", "parent", "tag")
    rows = element.withColumn("nth", F.row_number().over(same.orderBy("pre"))).withColumn("alike", F.count("*").over(same))
    classes = F.slice("classes", 1, 2)
    id_ = F.col("attrs")["id"]
    step = F.concat(F.col("tag"), F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c)), ""), F.when(F.col("alike") > 1, F.concat(F.lit(":nth-of-type("), F.col("nth").cast("string"), F.lit(")"))).otherwise(""))
    rows = rows.select("page_id", "pre", "last", F.when(id_ != "", F.concat(F.lit("#"), id_)).alias("by_id"), step.alias("step"))
    steps = rows.select("page_id", F.col("pre").alias("up"), "by_id", "step")
    path = containment.pairs(rows, F.lit(True), F.lit(True)).union(rows.select("page_id", "pre", "pre"))
    joined = path.join(steps, ["page_id", "up"])
    ordered = joined.groupBy("page_id", "pre").agg(F.array_sort(F.collect_list(F.struct("up", "by_id", "step"))).alias("steps"))
    last = F.aggregate(F.sequence(F.lit(1), F.size("steps")), F.lit(1), lambda at, i: F.when(F.get("steps", i - 1)["by_id"].isNotNull(), i).otherwise(at))
    return ordered.withColumn("from", last).select("page_id", "pre", F.array_join(F.transform(F.slice("steps", F.col("from"), F.size("steps")), lambda s: F.coalesce(s["by_id"], s["step"])), " > ").alias("selector"))


def main_content(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, tag, content, chars) of the first main, element of role main, article or body of each page.

    content is the beginning of its text, chars the length of all of it.
    """
    prio = F.when(F.col("tag") == "main", 0).when(F.col("attrs")["role"] == "main", 1).when(F.col("tag") == "article", 2).when(F.col("tag") == "body", 3)
    best = nodes.where("kind = 'element'").withColumn("prio", prio).where("prio is not null").groupBy("page_id").agg(F.min_by(F.struct("pre", "tag", "content", "chars"), F.struct("prio", "pre")).alias("m"))
    return best.select("page_id", "m.*")


def lazy_media(nodes: DataFrame) -> DataFrame:
    """Per page: lazily loaded elements (lazy), those not loaded yet (unloaded), and whether scripts observe what is in view.

    Unloaded: images, frames and videos with a data source and no source; classes of pending loads without one of
    finished ones; pending states; and builder documents without a widget container. Pages without any have no row.
    """
    attrs = F.col("attrs")
    lower = F.coalesce(F.lower(attrs["class"]), F.lit(""))
    lazy = reduce(lambda x, y: x | y, [dom.matches(css) for css in LAZY_SELECTORS]) | dom.has_any(lower, dom.LAZY_CLASSES)
    media = F.col("tag").isin("img", "iframe", "video") & (attrs["data-src"].isNotNull() | attrs["data-lazy-src"].isNotNull()) & (F.trim(F.coalesce(attrs["src"], F.lit(""))) == "")
    waiting = (dom.matches(".lazy") | dom.matches(".lazyload") | dom.matches(".lazyload-pending")) & ~dom.matches(".lazy-loaded") & ~dom.matches(".lazyloaded")
    state = attrs["data-ll-status"].isin("pending", "loading")
    observer = F.coalesce(F.array_contains("within", "script") & F.contains("text", F.lit("IntersectionObserver")), F.lit(False))
    n = lambda *tests: sum((F.sum(F.coalesce(t, F.lit(False)).cast("int")) for t in tests), F.lit(0))
    per = nodes.groupBy("page_id").agg(n(lazy).alias("lazy"), n(media, waiting, state).alias("unloaded"), F.max(observer).alias("observer"))
    document = (F.col("kind") == "element") & attrs["data-elementor-type"].isNotNull()
    inside = containment.holding(nodes, document, dom.matches(".elementor-widget-container"))
    empty = nodes.where(document).select("page_id", "pre").join(inside, ["page_id", "pre"], "left_anti").groupBy("page_id").agg(F.count("*").alias("empty"))
    rows = per.join(empty, "page_id", "left").withColumn("unloaded", F.col("unloaded") + F.coalesce("empty", F.lit(0))).drop("empty")
    return rows.where((F.col("lazy") > 0) | (F.col("unloaded") > 0) | F.col("observer"))


def builder_inventory(nodes: DataFrame) -> DataFrame:
    """Per page that a page builder made: its sections, inner sections, containers, columns and widgets, and the widgets' types.

    A page is a builder's if a class, an attribute, a style or a script of it names the builder.
    """
    attrs = F.col("attrs")
    classes = F.coalesce(attrs["class"], F.lit(""))
    element = F.col("kind") == "element"
    n = lambda test, name: F.sum(F.when(element & test, 1).otherwise(0)).alias(name)
    inner = F.contains(classes, F.lit("elementor-inner-section")) | dom.class_has("e-con-inner")
    kind = F.regexp_extract(classes, r"elementor-widget-([\w-]+)", 1)
    script = F.array_contains("within", "script") & dom.has_any(F.col("text"), BUILDER_SCRIPTS) | (F.col("tag") == "script") & dom.has_any(attrs["src"], BUILDER_SCRIPTS)
    style = F.array_contains("within", "style") & F.contains("text", F.lit(".elementor-"))
    marked = reduce(lambda x, y: x | y, [attrs[a].isNotNull() for a in BUILDER_ATTRIBUTES])
    parts = [n(dom.has_any(classes, marks), name) for name, marks in BUILDER_PARTS.items()]
    per = nodes.groupBy("page_id").agg(*parts, n(inner, "inner_section"), F.array_sort(F.collect_set(F.when(element & (kind != ""), kind))).alias("widget_types"), F.max(F.coalesce(script | style | (element & marked), F.lit(False))).alias("marked"))
    some = reduce(lambda x, y: x | y, [F.col(name) > 0 for name in BUILDER_PARTS])
    return per.where(some | F.col("marked")).drop("marked")


def builder_text(nodes: DataFrame) -> DataFrame:
    """(page_id, widget, texts): texts of the headings, paragraphs, links, buttons and image descriptions of each builder widget."""
    widget = (F.col("kind") == "element") & F.contains(F.coalesce(F.col("attrs")["class"], F.lit("")), F.lit("elementor-widget"))
    text = F.when(F.col("tag").rlike("^(h[1-6]|p|a|button)$"), F.col("content")).when(F.col("tag") == "img", F.col("attrs")["alt"])
    inside = containment.pairs(nodes, widget, F.trim(text) != "").withColumnRenamed("up", "widget")
    parts = inside.join(nodes.select("page_id", "pre", F.trim(text).alias("text")), ["page_id", "pre"])
    return parts.groupBy("page_id", "widget").agg(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda t: t["text"]).alias("texts"))
