"""Evidence: signals extracted from the node table, one long table for all sections.

Every extractor returns (page_id, section, pos, type, value, confidence, meta); pos is the node's place in the page.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions.score import ratio
from pagelens.operators import containment, dom, inventory
from pagelens.operators.blocks import structured_content
from pagelens.operators.entities import extract_entities

META = "map<string,string>"

# Tags, roles, selectors and keywords that the extractors look for.
SEMANTIC_TAGS = ["main", "nav", "header", "footer", "article", "section", "aside", "figure", "figcaption", "details", "summary", "time", "mark", "address"]
ARIA_ROLES = ["banner", "navigation", "main", "contentinfo", "complementary", "search", "form", "region"]
LANDMARK_ROLE = {"header": "banner", "nav": "navigation", "main": "main", "footer": "contentinfo", "aside": "complementary", "section": "region", "article": "article"}
SECTION_TAGS = ["main", "article", "section", "aside", "nav", "header", "footer"]
BOILERPLATE = ["#cookie-banner", ".cookie-banner", "#gdpr", ".gdpr", "#sidebar", ".sidebar", "#comments", ".comments", "#related", ".related-posts", "#ad", ".advertisement"]
NOISE_TAGS = ["nav", "footer", "header", "aside"]
AMBIGUOUS_HEADINGS = ["click here", "read more", "more info", "details", "home", "welcome", "untitled", "lorem ipsum"]
AMBIGUOUS_ANCHORS = ["click here", "read more", "more", "here", "link", "this", "this page", "this link", "see more", "view more", "learn more", "continue", "go", "next", "prev", "previous"]
TECHNICAL = ["API", "SDK", "HTTP", "JSON", "SQL", "algorithm", "function", "parameter", "variable", "configure?", "deploy", "instance", "async"]
LIST_WORDS = {
    "definitions": ["definition", "meaning", "refers to", "is defined as", "describes"],
    "steps": ["step", "first", "second", "third", "then", "next", "finally", "install", "run", "execute"],
    "features": ["feature", "benefit", "advantage", "includes", "supports", "enables", "allows"],
    "attributes": ["property", "attribute", "setting", "option", "parameter", "field"],
}
TABLE_WORDS = {
    "pricing": ["price", "cost", "$", "€", "£", "plan", "monthly", "annual", "free", "premium", "starter", "pro"],
    "comparison": ["compare", "vs", "versus", "difference", "feature", "plan"],
    "specifications": ["spec", "specification", "dimension", "weight", "size", "color", "material", "model"],
}
SECTION_PARENTS = {"main": ["section", "article", "aside"], "article": ["section"], "section": ["section"], "body": ["section", "main", "article"]}
SECTION_CLASSES = ["elementor-section", "elementor-top-section", "elementor-inner-section", "elementor-container", "elementor-column", "elementor-widget", "elementor-element", "e-con", "e-con-inner", "e-con-boxed", "e-con-full", "wp-block", "wp-block-group", "wp-block-cover", "wp-block-columns", "wp-block-media-text", "entry-content", "post-content", "page-content", "content-area", "content-block", "content-section", "main-content", "primary-content", "module", "panel", "card", "tile", "feature", "hero", "hero-section", "banner", "container", "row", "col-", "section", "grid", "flex", "flex-col", "flex-row", "post-block", "article-body", "story-body"]
#: Absent selector, its usual name and severity.
ABSENCES = [
    ("title", "title", "critical"),
    ("meta:name=description", "meta_description", "critical"),
    ("h1", "primary_heading", "critical"),
    ("main", "main_landmark", "critical"),
    ("nav", "nav_landmark", "info"),
    ("article", "article_content", "warning"),
    ("script:type=application/ld+json", "structured_data", "warning"),
    ("meta:property=og:title", "open_graph_title", "warning"),
    ("meta:property=og:description", "open_graph_description", "warning"),
    ("meta:property=og:image", "open_graph_image", "info"),
    ("link:rel=canonical", "canonical_url", "warning"),
    ("img:alt", "image_alt_text", "info"),
    ("section", "semantic_sections", "info"),
    ("header", "header_landmark", "info"),
    ("footer", "footer_landmark", "info"),
    ("html:lang", "language_declaration", "warning"),
    ("meta:name=viewport", "viewport_meta", "info"),
    ("time", "time_elements", "info"),
    ("meta:name=robots", "robots_meta", "info"),
]
#: Domain, weight, selectors, keywords.
DOMAINS = [
    ("ecommerce", 1.0, [".add-to-cart", "[data-product-id]", ".price", ".product-price", "button[class*='cart']", ".shop", "[class*='product-card']"], ["add to cart", "buy now", "price", "checkout", "shipping", "cart", "wishlist", "in stock", "out of stock"]),
    ("blog", 1.0, ["article.post", ".blog-post", ".entry-content", ".post-content", "time.published", ".author-bio", ".blog"], ["blog", "post", "author", "published", "comments", "related posts", "share this", "category"]),
    ("documentation", 1.0, [".docs", "[class*='documentation']", ".api-reference", ".code-block", "pre code", ".markdown-body", "nav.docs-nav", ".table-of-contents"], ["documentation", "api", "reference", "guide", "tutorial", "example", "parameter", "returns", "endpoint", "method"]),
    ("product_page", 1.0, [".product-detail", "[class*='product-info']", ".product-gallery", ".product-specs", ".product-features"], ["product", "features", "specifications", "details", "gallery", "description", "reviews"]),
    ("landing_page", 1.0, [".hero", "[class*='hero']", ".cta", "[class*='cta']", ".value-prop", ".features-section", ".testimonials"], ["get started", "sign up", "try free", "learn more", "contact us", "our platform", "our solution", "get a demo"]),
    ("support_page", 1.0, [".faq", "[class*='faq']", ".help-center", ".support", ".ticket", ".contact-support", ".knowledge-base"], ["help", "support", "faq", "frequently asked", "contact us", "submit a ticket", "troubleshoot", "issue", "problem"]),
    ("documentation_alt", 0.8, [".md-content", "article.markdown", ".prose", "pre > code"], ["install", "configuration", "usage", "cli", "command", "options", "flags"]),
]


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def signal(frame: DataFrame, section: str, kind: Column | str, value: Column, confidence: Column | float, **meta: Column) -> DataFrame:
    pairs = [x for k, v in meta.items() for x in (F.lit(k), v.cast("string"))]
    made = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast(META)
    return frame.select("page_id", F.lit(section).alias("section"), F.col("pre").cast("int").alias("pos"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), value.alias("value"), (F.lit(float(confidence)) if not isinstance(confidence, Column) else confidence).alias("confidence"), made.cast(META).alias("meta"))


def with_text(nodes: DataFrame, tags: list[str]) -> DataFrame:
    """Elements of the tags; content is their visible text."""
    return nodes.where(F.col("tag").isin(tags))


def metadata(nodes: DataFrame) -> DataFrame:
    """One signal per metadata field: title, meta names and properties (the last of a name wins), charset, canonical, lang, icon."""
    head = nodes.where(F.col("tag").isin("meta", "link", "html"))
    name = F.lower(F.coalesce(attr("name"), attr("property")))
    field = F.when((F.col("tag") == "meta") & name.isNotNull() & attr("content").isNotNull(), name).when((F.col("tag") == "meta") & attr("charset").isNotNull(), "charset").when((F.col("tag") == "link") & F.array_contains(F.split(F.lower(attr("rel")), r"\s+"), "canonical"), "canonical").when((F.col("tag") == "link") & F.lower(attr("rel")).rlike("icon"), "favicon").when((F.col("tag") == "html") & attr("lang").isNotNull(), "lang")
    value = F.when(F.col("tag") == "link", attr("href")).when(F.col("tag") == "html", attr("lang")).otherwise(F.coalesce(attr("content"), attr("charset")))
    fields = head.select("page_id", "pre", field.alias("field"), F.trim(value).alias("value")).where("field is not null")
    title = with_text(nodes, ["title"]).select("page_id", "pre", F.lit("title").alias("field"), F.col("content").alias("value"))
    last = fields.union(title).groupBy("page_id", "field").agg(F.max_by("value", "pre").alias("value"), F.max("pre").alias("pre"))
    return signal(last, "metadata", F.concat(F.lit("meta_"), F.col("field")), F.col("value"), 1.0)


def headings(nodes: DataFrame) -> DataFrame:
    rows = with_text(nodes, ["h1", "h2", "h3", "h4", "h5", "h6"]).where("content <> ''")
    return signal(rows, "headings", F.concat(F.lit("heading_"), "tag"), T.truncate(F.col("content"), 300), 1.0, level=F.substring("tag", 2, 1))


def paragraphs(nodes: DataFrame) -> DataFrame:
    rows = with_text(nodes, ["p"]).where("content <> ''")
    return signal(rows, "paragraphs", "paragraph", F.col("content"), F.when(F.length("content") >= 20, 0.9).otherwise(0.6), words=F.size(F.split("content", r"\s+")))


def lists(nodes: DataFrame) -> DataFrame:
    """ol and ul with items: their first 20 items of at most 200 characters."""
    items = with_text(nodes, ["li"]).where("content <> ''").select("page_id", F.col("parent").alias("pre"), F.struct(F.col("pre").alias("at"), T.truncate(F.col("content"), 200).alias("item")).alias("item"))
    per = items.groupBy("page_id", "pre").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = nodes.where(F.col("tag").isin("ul", "ol")).join(per, ["page_id", "pre"])
    nested = F.arrays_overlap("within", F.array(F.lit("ul"), F.lit("ol")))
    return signal(rows, "lists", F.when(F.col("tag") == "ol", "ordered_list").otherwise("unordered_list"), F.array_join(F.transform(F.slice("items", 1, 20), lambda i: i["item"]), " | "), 0.9, items=F.size("items"), nested=nested)


def table_rows(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, rows) of every table: its rows in order, inner tables' too, as (row, first, head, cells of (pre, tag, content)).

    first: the row is its parent's first element; head: its parent is a thead.
    """
    cells = with_text(nodes, ["td", "th"]).select("page_id", F.col("parent").alias("row"), "pre", "tag", "content")
    inside = containment.pairs(nodes, F.col("tag") == "table", F.col("tag") == "tr").toDF("page_id", "table", "row")
    places = nodes.where("tag = 'tr'").select("page_id", F.col("pre").alias("row"), (F.col("sib") == 1).alias("first"), (F.col("parent_tag") == "thead").alias("head"))
    per_row = places.join(cells, ["page_id", "row"], "left").groupBy("page_id", "row", "first", "head").agg(F.array_sort(F.collect_list(F.when(F.col("pre").isNotNull(), F.struct("pre", "tag", "content")))).alias("cells"))
    return inside.join(per_row, ["page_id", "row"]).groupBy("page_id", F.col("table").alias("pre")).agg(F.array_sort(F.collect_list(F.struct("row", "first", "head", "cells"))).alias("rows"))


def tables(nodes: DataFrame) -> DataFrame:
    """Tables: headers, number of rows and a sample of five rows."""
    per = table_rows(nodes)
    of = lambda r: F.array_join(F.transform(r["cells"], lambda c: c["content"]), " | ")
    headers = F.transform(F.filter(F.col("rows")[0]["cells"], lambda c: c["tag"] == "th"), lambda c: c["content"])
    return signal(per, "tables", "table", F.array_join(F.transform(F.slice("rows", 1, 6), of), " / "), 0.9, rows=F.size("rows"), headers=F.array_join(headers, " | "), columns=F.array_max(F.transform("rows", lambda r: F.size(r["cells"]))))


def links(nodes: DataFrame, pages: DataFrame, most: int = 500) -> DataFrame:
    """a[href]: internal or external by host, nofollow; at most `most` signals a page (the limit is the feature)."""
    rows = with_text(nodes, ["a"]).where(attr("href").isNotNull()).join(pages.select("page_id", T.url_host(F.col("url")).alias("host")), "page_id")
    target = T.url_host(attr("href"))
    internal = (target == "") | (target == F.col("host"))
    kept = rows.withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("pre"))).where(F.col("n") <= most)
    return signal(kept, "links", F.when(internal, "internal_link").otherwise("external_link"), F.when(F.col("content") != "", T.truncate(F.col("content"), 200)).otherwise(attr("href")), 0.9, href=attr("href"), nofollow=F.coalesce(attr("rel").contains("nofollow"), F.lit(False)), link_class=T.classify_link(F.col("content"), attr("href")), has_text=F.col("content") != "")


def anchor_text(links_: DataFrame, nodes: DataFrame, most: int = 300) -> DataFrame:
    """Quality of links' texts: anchor_clear, anchor_ambiguous, anchor_plain, anchor_image_only or anchor_no_text.

    relevant tells whether a word of over three characters stands in the target's path; `most` signals a page are kept.
    """
    inside = containment.pairs(nodes, F.col("tag") == "a", F.col("tag") == "img").withColumnRenamed("up", "pos")
    image = inside.join(nodes.where("tag = 'img'").select("page_id", "pre", attr("alt").alias("alt")), ["page_id", "pre"]).groupBy("page_id", "pos").agg(F.min_by(F.coalesce("alt", F.lit("")), "pre").alias("alt"))
    rows = links_.join(image.hint("merge"), ["page_id", "pos"], "left")
    text = F.when(F.col("meta")["has_text"] == "true", F.col("value")).otherwise("")
    low, href = F.lower(text), F.lower(F.col("meta")["href"])
    path = F.regexp_replace(F.regexp_replace(href, r"^([a-z][a-z0-9+.-]*:)?//[^/?#]*", ""), r"[?#].*$", "")
    relevant = F.exists(F.split(low, r"\s+"), lambda w: (F.length(w) > 3) & F.contains(path, w))
    ambiguous = reduce(lambda x, y: x | y, [low.startswith(a) for a in AMBIGUOUS_ANCHORS])
    clear = ~ambiguous & text.rlike(r"\b[A-Z][a-z]+|\w{10,}") & (F.length(text) > 5)
    kind = F.when((text == "") & F.col("alt").isNotNull(), "anchor_image_only").when(text == "", "anchor_no_text").when(ambiguous, "anchor_ambiguous").when(clear, "anchor_clear").otherwise("anchor_plain")
    sure = F.create_map(*(F.lit(x) for kv in {"anchor_image_only": 0.5, "anchor_no_text": 0.3, "anchor_ambiguous": 0.4, "anchor_clear": 0.9, "anchor_plain": 0.65}.items() for x in kv))
    value = F.when(text != "", F.col("value")).otherwise(T.truncate(F.coalesce(F.when(F.col("alt") != "", F.col("alt")), F.col("meta")["href"]), 200))
    issue = F.when(kind == "anchor_image_only", "image_only_link").when(kind == "anchor_no_text", "no_anchor_text").when(ambiguous, "ambiguous_anchor_text").when(~F.coalesce(relevant, F.lit(False)), "potentially_irrelevant")
    meta = F.map_filter(F.create_map(F.lit("relevant"), F.coalesce(relevant, F.lit(False)).cast("string"), F.lit("issue"), issue), lambda k, v: v.isNotNull())
    n = F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    return rows.withColumn("n", n).where(F.col("n") <= most).select("page_id", F.lit("anchor_text").alias("section"), "pos", kind.alias("type"), value.alias("value"), sure[kind].alias("confidence"), meta.alias("meta"))


def accessibility(nodes: DataFrame) -> DataFrame:
    """Images with and without alt, ARIA and element landmarks, aria labels, skip links and inputs without a label."""
    element = nodes.where("kind = 'element'")
    images = element.where("tag = 'img'")
    labels = element.where("tag = 'label'").where(attr("for").isNotNull()).select("page_id", attr("for").alias("id")).distinct()
    inputs = element.where(F.col("tag").isin("input", "select", "textarea")).where(~F.coalesce(F.lower(attr("type")).isin("hidden", "submit", "button", "image", "reset"), F.lit(False)) & attr("aria-label").isNull() & attr("aria-labelledby").isNull() & ~F.array_contains("within", "label")).withColumn("id", attr("id"))
    parts = [
        signal(images, "accessibility", F.when(attr("alt").isNotNull(), "img_alt").otherwise("img_missing_alt"), F.coalesce(attr("alt"), attr("src"), F.lit("")), 0.95),
        signal(element.where(attr("role").isin(ARIA_ROLES)), "accessibility", "aria_landmark", attr("role"), 0.95),
        signal(element.where(F.col("tag").isin(*LANDMARK_ROLE)), "accessibility", "semantic_landmark", F.element_at(F.create_map(*(F.lit(x) for kv in LANDMARK_ROLE.items() for x in kv)), F.col("tag")), 0.9),
        signal(element.where(attr("aria-label").isNotNull()), "accessibility", "aria_label", attr("aria-label"), 0.9),
        signal(element.where((F.col("tag") == "a") & attr("href").rlike("^#(main|content|skip)")), "accessibility", "skip_link", attr("href"), 0.9),
        signal(inputs.join(labels, ["page_id", "id"], "left_anti"), "accessibility", "unlabeled_input", F.coalesce(attr("name"), attr("type"), F.col("tag")), 0.85),
    ]
    return reduce(DataFrame.union, parts)


def structured_data(nodes: DataFrame) -> DataFrame:
    """JSON-LD by @type (arrays flattened, bad JSON marked), microdata and RDFa."""
    script = nodes.where("tag = 'script'").where(F.lower(attr("type")) == "application/ld+json").select("page_id", "pre")
    body = nodes.where("kind = 'text'").select("page_id", F.col("parent").alias("pre"), "text")
    raw = script.join(body, ["page_id", "pre"], "left").withColumn("text", F.trim(F.coalesce("text", F.lit(""))))
    listed = lambda path: F.from_json(F.get_json_object("text", path), "array<string>")
    one = F.get_json_object("text", "$['@type']")
    types = F.when(raw["text"].startswith("["), listed("$[*]['@type']")).when(F.get_json_object("text", "$['@graph']").isNotNull(), listed("$['@graph'][*]['@type']")).when(one.startswith("["), F.from_json(one, "array<string>")).otherwise(F.array(one))
    valid = F.try_parse_json("text").isNotNull()
    typed = raw.withColumn("valid", valid).withColumn("type", F.explode_outer(F.when(F.col("valid"), types)))
    element = nodes.where("kind = 'element'")
    scope = attr("itemscope").isNotNull() | attr("itemtype").isNotNull()
    inside = containment.pairs(element, scope, attr("itemprop").isNotNull())
    props = inside.join(element.select("page_id", "pre", attr("itemprop").alias("prop")), ["page_id", "pre"]).groupBy("page_id", F.col("up").alias("pre")).agg(F.array_join(F.array_sort(F.collect_set("prop")), ",").alias("props"))
    scopes = element.where(scope).join(props, ["page_id", "pre"], "left")
    return reduce(
        DataFrame.union,
        [
            signal(typed, "structured_data", F.when(F.col("valid"), "json_ld").otherwise("json_ld_invalid"), F.coalesce(T.canonical_schema_type(F.col("type")), F.lit("unknown")), F.when(F.col("valid"), 0.95).otherwise(0.3), format=F.lit("json_ld")),
            signal(scopes, "structured_data", "microdata", T.canonical_schema_type(F.coalesce(attr("itemtype"), F.lit("unknown"))), 0.85, format=F.lit("microdata"), props=F.col("props")),
            signal(element.where(attr("typeof").isNotNull() | attr("property").isNotNull() | attr("vocab").isNotNull()), "structured_data", "rdfa", F.coalesce(attr("typeof"), attr("property"), attr("vocab")), 0.75, format=F.lit("rdfa")),
        ],
    )


def hierarchy(nodes: DataFrame, deepest: int = 15) -> DataFrame:
    """Kept tree nodes: headings, their ancestors, semantic tags and roles; depth counts kept ancestors."""
    heading = F.col("tag").rlike("^h[1-6]$")
    inner = nodes.where((F.col("kind") == "element") & F.array_contains("within", "body"))
    above = containment.holding(inner, F.lit(True), heading).withColumn("above", F.lit(True))
    sectioned = F.coalesce(F.lower(attr("class")).rlike("section|container|content|wrapper"), F.lit(False)) & (F.col("tag") == "div")
    kept = inner.join(above, ["page_id", "pre"], "left").where(heading | F.col("above") | F.col("tag").isin(SEMANTIC_TAGS) | attr("role").isNotNull() | sectioned).where(F.col("tag") != "body")
    depth = containment.enclosing(kept, F.lit(True), F.lit(True)).select("page_id", "pre", (F.col("n") + 1).cast("int").alias("kept_depth"))
    rows = kept.join(depth, ["page_id", "pre"]).where(F.col("kept_depth") <= deepest)
    orphan = F.col("tag").rlike("^h[3-6]$") & (F.col("kept_depth") > 1)
    return signal(rows, "hierarchy", "hierarchy_node", F.col("tag"), 1.0, depth=F.col("kept_depth"), heading=heading, orphan=orphan)


def semantic_html(nodes: DataFrame) -> DataFrame:
    return signal(nodes.where(F.col("tag").isin(SEMANTIC_TAGS)), "semantic_html", "semantic_tag", F.col("tag"), 0.95, tag=F.col("tag"))


def semantic_structure(nodes: DataFrame) -> DataFrame:
    """Sectioning elements in their usual parents, and divs of a sectioning class that hold a heading or over 50 characters."""
    up = F.col("parent_tag")
    box = reduce(lambda x, y: x | y, [(up == parent) & F.col("tag").isin(tags) for parent, tags in SECTION_PARENTS.items()])
    boxes = nodes.where("kind = 'element'").where(box)
    div = (F.col("tag") == "div") & dom.has_any(F.lower(attr("class")), SECTION_CLASSES)
    divs = nodes.where(div)
    with_heading = containment.holding(nodes, div, F.col("tag").rlike("^h[1-6]$"))
    long = divs.where("chars > 50").select("page_id", F.col("pre").cast("long").alias("pre"))
    chosen = divs.join(with_heading.union(long).distinct(), ["page_id", "pre"], "left_semi").select(*boxes.columns)
    return signal(boxes.union(chosen), "semantic_structure", F.when(F.col("tag") == "div", "structure_div").otherwise("structure_section"), F.concat_ws(" ", "tag", attr("class")), 0.85, tag=F.col("tag"), depth=F.col("depth"))


def semantic_headings(headings_: DataFrame, nodes: DataFrame) -> DataFrame:
    """Headings as heading_clear, heading_ambiguous or heading_plain, with their topic and whether their level fits.

    A level fits if it is at most one deeper than the deepest level above it among the headings that are children of the
    heading's ancestors; without one, if it is at most 2.
    """
    key, level = F.lower(F.trim("value")), F.col("meta")["level"].cast("int")
    ambiguous = dom.has_any(key, AMBIGUOUS_HEADINGS) | (F.length("value") < 5)
    kind = F.when(ambiguous, "heading_ambiguous").when(F.length("value") > 5, "heading_clear").otherwise("heading_plain")
    tags = nodes.where(F.col("tag").rlike("^h[1-6]$")).withColumn("level", F.substring("tag", 2, 1).cast("int"))
    beside = tags.groupBy("page_id", F.col("parent").alias("pre")).agg(F.bit_or(F.expr("shiftleft(1, level)")).alias("mask"))
    marked = nodes.where("kind = 'element'").select("page_id", "pre", "last", "tag", "parent").join(beside, ["page_id", "pre"], "left")
    above = containment.enclosing(marked, F.col("mask").isNotNull() & F.col("parent").isNotNull(), F.col("tag").rlike("^h[1-6]$"), F.col("mask"))
    lower = F.expr("bits & (shiftleft(1, level) - 1)")  # the levels above this one, a bit each
    found = above.join(tags.select("page_id", "pre", "level"), ["page_id", "pre"]).select("page_id", F.col("pre").alias("pos"), F.when(lower > 0, F.length(F.bin(lower)) - 1).alias("found"))
    rows = headings_.join(found, ["page_id", "pos"], "left")
    fits = F.when(F.col("found").isNull(), level <= 2).otherwise(level <= F.col("found") + 1)
    topic = F.when(kind == "heading_clear", F.array_join(F.slice(F.split("value", r"\s+"), 1, 5), " "))
    meta = F.map_filter(F.create_map(F.lit("hierarchy_correct"), fits.cast("string"), F.lit("topic"), topic), lambda k, v: v.isNotNull())
    return rows.select("page_id", F.lit("semantic_headings").alias("section"), "pos", kind.alias("type"), "value", F.when(kind == "heading_clear", 0.9).otherwise(0.5).alias("confidence"), meta.alias("meta"))


def semantic_paragraphs(paragraphs_: DataFrame, most: int = 200) -> DataFrame:
    """Paragraphs as clear (40 characters and over 10 words) or unclear, their technical terms and three most frequent long words."""
    clear = (F.length("value") >= 40) & (F.col("meta")["words"].cast("int") > 10)
    term = lambda t: F.regexp_extract("value", rf"(?i)\b{t}\b", 0)
    terms = F.filter(F.array(*map(term, TECHNICAL)), lambda t: t != "")
    words = F.filter(F.split(F.lower("value"), r"\s+"), lambda w: F.length(w) > 4)
    n = F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    rows = paragraphs_.withColumn("n", n).where(F.col("n") <= most).withColumn("terms", terms)
    # equal words side by side, the first of each before the others: each is counted by where the next begins
    rows = rows.withColumn("sorted", F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at")))))
    begins = F.filter(F.transform("sorted", lambda w, i: i), lambda i: (i == 0) | (F.get("sorted", i)["word"] != F.get("sorted", i - 1)["word"]))
    rows = rows.withColumn("begins", begins)
    ranked = F.array_sort(F.transform("begins", lambda i, k: F.struct((i - F.coalesce(F.get("begins", k + 1), F.size("sorted"))).alias("n"), F.get("sorted", i)["at"].alias("at"), F.get("sorted", i)["word"].alias("word"))))
    topic = F.array_join(F.transform(F.slice(ranked, 1, 3), lambda t: t["word"]), ",")
    sentences = F.size(F.regexp_extract_all("value", F.lit("[.!?]+"), F.lit(0)))
    meta = F.create_map(F.lit("technical"), (F.size("terms") > 0).cast("string"), F.lit("terms"), F.array_join("terms", ","), F.lit("topic"), topic, F.lit("sentences"), sentences.cast("string"))
    return rows.select("page_id", F.lit("semantic_paragraphs").alias("section"), "pos", F.when(clear, "paragraph_clear").otherwise("paragraph_unclear").alias("type"), T.truncate(F.col("value"), 500).alias("value"), F.when(clear, 0.85).otherwise(0.5).alias("confidence"), meta.alias("meta"))


def ordered_class(rules: list[tuple[Column, str, float]], otherwise: tuple[str, float]) -> Column:
    """(kind, confidence) of the first rule that holds."""
    out = None
    for holds, kind, sure in rules:
        made = F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence"))
        out = F.when(holds, made) if out is None else out.when(holds, made)
    return out.otherwise(F.struct(F.lit(otherwise[0]).alias("kind"), F.lit(otherwise[1]).alias("confidence")))


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words stands anywhere in a lower-case text: one pass of one compiled alternation."""
    return F.coalesce(text.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def semantic_lists(nodes: DataFrame) -> DataFrame:
    """ol, ul and dl with items (their own li and dt) as definitions, steps, features, attributes or general.

    The first class that fits counts: a dl or words of definition, an ol or words of steps, words of features, words of
    attributes, in the text of all items.
    """
    items = with_text(nodes, ["li", "dt"]).where("content <> ''").select("page_id", F.col("parent").alias("pre"), F.struct(F.col("pre").alias("at"), F.col("content").alias("item")).alias("item"))
    per = items.groupBy("page_id", "pre").agg(F.transform(F.array_sort(F.collect_list("item")), lambda i: i["item"]).alias("items"))
    rows = nodes.where(F.col("tag").isin("ul", "ol", "dl")).select("page_id", "pre", "tag").join(per, ["page_id", "pre"])
    text = F.lower(F.array_join("items", " "))
    rules = [((F.col("tag") == "dl") | holds_any(text, LIST_WORDS["definitions"]), "definitions", 0.85), ((F.col("tag") == "ol") | holds_any(text, LIST_WORDS["steps"]), "steps", 0.85), (holds_any(text, LIST_WORDS["features"]), "features", 0.8), (holds_any(text, LIST_WORDS["attributes"]), "attributes", 0.8)]
    rows = rows.withColumn("class", ordered_class(rules, ("general", 0.6)))
    return signal(rows, "semantic_lists", F.concat(F.lit("semantic_"), "tag"), T.truncate(F.array_join("items", " | "), 500), F.col("class.confidence"), items=F.size("items"), ordered=F.col("tag") == "ol", **{"class": F.col("class.kind")})


def semantic_tables(nodes: DataFrame) -> DataFrame:
    """Tables as pricing, comparison, specifications, key_value or general; the first class that fits counts.

    Headers are the cells of a thead and the th of rows that come first; columns their number, or that of the first
    row's cells. Words of prices and specifications count in the whole text, those of comparison in headers alone, and
    only with over two columns; two columns and over three rows are key and value.
    """
    texts = nodes.where("tag = 'table'").select("page_id", F.col("pre").cast("long").alias("pre"), F.lower(F.coalesce("content", F.lit(""))).alias("text"))
    captions = containment.holding(nodes, F.col("tag") == "table", F.col("tag") == "caption").withColumn("caption", F.lit(True))
    header = lambda r: F.transform(F.filter(r["cells"], lambda c: (r["head"] | (r["first"] & (c["tag"] == "th"))) & (c["content"] != "")), lambda c: c["content"])
    rows = texts.join(table_rows(nodes), ["page_id", "pre"], "left").join(captions, ["page_id", "pre"], "left").withColumn("rows", F.coalesce("rows", F.array()))
    rows = rows.withColumn("headers", F.flatten(F.transform("rows", header)))
    columns = F.when(F.size("headers") > 0, F.size("headers")).otherwise(F.coalesce(F.size(F.get("rows", F.lit(0))["cells"]), F.lit(0)))
    rows = rows.withColumn("columns", columns).withColumn("head_text", F.lower(F.array_join("headers", " ")))
    rules = [(holds_any(F.col("text"), TABLE_WORDS["pricing"]), "pricing", 0.85), (holds_any(F.col("head_text"), TABLE_WORDS["comparison"]) & (F.col("columns") > 2), "comparison", 0.85), (holds_any(F.col("text"), TABLE_WORDS["specifications"]), "specifications", 0.8), ((F.col("columns") == 2) & (F.size("rows") > 3), "key_value", 0.75)]
    rows = rows.withColumn("class", ordered_class(rules, ("general", 0.65)))
    value = F.concat(F.lit("["), F.col("class.kind"), F.lit("] "), F.array_join("headers", " | "))
    return signal(rows, "semantic_tables", "semantic_table", T.truncate(value, 300), F.col("class.confidence"), rows=F.size("rows"), columns=F.col("columns"), has_headers=F.size("headers") > 0, has_caption=F.coalesce("caption", F.lit(False)), **{"class": F.col("class.kind")})


def semantic_links(links_: DataFrame, most: int = 300) -> DataFrame:
    n = F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    return links_.withColumn("n", n).where(F.col("n") <= most).select("page_id", F.lit("semantic_links").alias("section"), "pos", F.concat(F.lit("link_"), F.col("meta")["link_class"]).alias("type"), "value", F.lit(0.75).alias("confidence"), "meta")


def entities(texts: DataFrame) -> DataFrame:
    """Entities of the pages' element text."""
    return extract_entities(texts, "page_id", "element_text").withColumn("meta", F.create_map(F.lit("kind"), F.col("type")))


def domain_profile(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Score of each domain: twice its weight for a selector that finds something, once for a keyword in the text."""
    seen = nodes.groupBy("page_id").agg(*(sum(dom.found(css) for css in marks).alias(d) for d, _, marks, _ in DOMAINS))
    low = F.col("low")
    scores = [(d, F.coalesce(F.col(d), F.lit(0)) * 2 * w + sum((F.contains(low, F.lit(k)).cast("int") for k in ks), F.lit(0)) * w) for d, w, _, ks in DOMAINS]
    lowered = texts.select("page_id", F.lower("element_text").alias("low"))  # once, not for every keyword
    rows = lowered.join(seen, "page_id", "left").select("page_id", F.posexplode(F.array(*(F.struct(F.lit(d).alias("d"), s.cast("double").alias("s")) for d, s in scores))).alias("pre", "e")).where("e.s > 0")
    return signal(rows, "domain_profile", "domain", F.col("e.d"), F.least(F.col("e.s") / 10, F.lit(1.0)), score=F.col("e.s"))


def extractability(nodes: DataFrame, flags: DataFrame, pages: DataFrame) -> DataFrame:
    """Content density, noise share, repeated blocks, boilerplate and main region of each page.

    density: the main content's characters over the body's; noise: those of nav, footer, header and aside outside each
    other; repeated: texts of over 30 characters, by their first 100, that several blocks have; boilerplate: how many of
    twelve selectors find something; regions: 1 if the main content has over 50 characters.
    """
    element = F.col("kind") == "element"
    outer = element & F.col("tag").isin(NOISE_TAGS) & ~F.arrays_overlap("within", F.array(*map(F.lit, NOISE_TAGS)))
    block = element & F.col("tag").isin("p", "div", "span", "li", "td")
    per = nodes.groupBy("page_id").agg(F.sum(F.when(outer, F.coalesce("chars", F.lit(0))).otherwise(0)).alias("noise_chars"), sum(dom.found(css) for css in BOILERPLATE).alias("boilerplate"), F.sum(F.when(block, 1).otherwise(0)).alias("blocks"))
    keys = nodes.where(block & (F.col("chars") > 30)).groupBy("page_id", F.xxhash64(F.substring("content", 1, 100)).alias("key")).count()
    repeated = keys.where("count > 1").groupBy("page_id").agg(F.count("*").alias("repeated"))
    main = inventory.main_content(nodes).select("page_id", F.when(F.col("tag") != "body", F.coalesce("chars", F.lit(0))).alias("main_chars"))
    rows = pages.select("page_id").join(flags.select("page_id", F.length("element_text").alias("text"), "contamination"), "page_id")
    for part in (per, repeated, main):
        rows = rows.join(part, "page_id", "left")
    rows = rows.withColumn("main_chars", F.coalesce("main_chars", "text")).fillna(0, ["noise_chars", "repeated", "blocks", "boilerplate"])
    density, share = ratio(F.col("main_chars"), F.col("text")), F.least(F.lit(1.0), ratio(F.col("noise_chars"), F.col("text")))
    ok = (density >= 0.3) & (share < 0.7) & (F.size("contamination") == 0)
    return rows.select("page_id", F.round(density, 4).alias("density"), F.round(share, 4).alias("noise"), "repeated", "blocks", "boilerplate", (F.col("main_chars") > 50).cast("long").alias("regions"), ok.alias("extractable"))


def redundancy(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of 30 characters and more of headings, paragraphs and divs without divs that occur twice or more, by their first 150, and navigation that stands in the text more than once."""
    holders = containment.holding(nodes, F.col("tag") == "div", F.col("tag") == "div").withColumn("holds", F.lit(True))
    blocks = nodes.where(F.col("tag").rlike("^(h[1-6]|p|div)$") & (F.col("chars") >= 30)).select("page_id", "pre", "tag", "content").join(holders, ["page_id", "pre"], "left").where("tag <> 'div' or holds is null")
    again = blocks.groupBy("page_id", F.substring(F.lower("content"), 1, 150).alias("key")).agg(F.count("*").alias("n"), F.min_by("tag", "pre").alias("tag"), F.min("pre").alias("pre")).where("n >= 2")
    menus = nodes.where("tag = 'nav'").where("chars > 20").groupBy("page_id", F.substring("content", 1, 100).alias("key")).agg(F.min("pre").alias("pre"))
    low = F.lower("element_text")
    menus = menus.join(texts.select("page_id", "element_text"), "page_id").withColumn("n", ((F.length(low) - F.length(F.replace(low, F.lower("key"), F.lit("")))) / F.length("key")).cast("long")).where("n > 1")
    severity = F.when(F.col("n") >= 5, "critical").when(F.col("n") >= 3, "warning").otherwise("info")
    content = F.when(F.col("tag").rlike("^h"), "heading").when(F.col("tag") == "p", "paragraph").otherwise("block")
    sure = F.least(F.lit(0.9), 0.5 + F.col("n") * 0.1)
    return signal(again, "redundancy", "redundant_content", T.truncate(F.col("key"), 200), sure, repeats=F.col("n"), severity=severity, content=content).union(signal(menus, "redundancy", "redundant_navigation", T.truncate(F.col("key"), 200), sure, repeats=F.col("n"), severity=severity, content=F.lit("navigation")))


def poor_content(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Absences of content: an empty first h1, an empty description, and a body of under 100 characters."""
    first = nodes.where("tag = 'h1' or (tag = 'meta' and attrs['name'] = 'description')").groupBy("page_id", "tag").agg(F.min("pre").alias("pre"), F.min_by(F.trim(F.coalesce(F.when(F.col("tag") == "h1", F.col("content")).otherwise(attr("content")), F.lit(""))), "pre").alias("text")).where("text = ''")
    name = F.when(F.col("tag") == "h1", "empty_h1").otherwise("empty_meta_description")
    short = texts.where(F.length("element_text").between(1, 99)).select("page_id", F.lit(0).alias("pre"), F.length("element_text").alias("chars"))
    return signal(first, "absence", name, name, 0.9, severity=F.lit("warning")).union(signal(short, "absence", "minimal_content", F.lit("minimal_content"), 0.85, severity=F.lit("warning"), chars=F.col("chars")))


def absence(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """What a page should have and has not: the rules anti-joined with what is there."""
    rules = F.array(*(F.struct(F.lit(i).alias("pre"), F.lit(s).alias("selector"), F.lit(n).alias("name"), F.lit(v).alias("severity")) for i, (s, n, v) in enumerate(ABSENCES)))
    there = [F.when(F.col("tag").isin(*{s.split(":")[0] for s, _, _ in ABSENCES if ":" not in s}), F.col("tag"))]
    for s, _, _ in ABSENCES:
        if ":" in s:
            tag, _, test = s.partition(":")
            name, eq, value = test.partition("=")
            there.append(F.when((F.col("tag") == tag) & ((F.lower(attr(name)) == value) if eq else attr(name).isNotNull()), s))
    present = nodes.where("kind = 'element'").select("page_id", F.explode(F.array_compact(F.array(*there))).alias("selector")).distinct()
    wanted = pages.select("page_id", F.inline(rules))
    missing = wanted.join(present, ["page_id", "selector"], "left_anti")
    return signal(missing, "absence", F.concat(F.lit("missing_"), "name"), F.col("name"), 0.95, severity=F.col("severity"))


def extractors(pages: DataFrame, nodes: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """All sections' signals, a table for each extractor."""
    a = links(nodes, pages)
    return [metadata(nodes), headings(nodes), paragraphs(nodes), lists(nodes), tables(nodes), a, accessibility(nodes), structured_data(nodes), hierarchy(nodes), semantic_html(nodes), semantic_structure(nodes), entities(texts), domain_profile(nodes, texts), structured_content(nodes), redundancy(nodes, texts), anchor_text(a, nodes), absence(nodes, pages), poor_content(nodes, texts)]


def summary(signals: DataFrame) -> DataFrame:
    return signals.groupBy("page_id", "section").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
