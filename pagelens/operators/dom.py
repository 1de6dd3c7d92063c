"""Structural predicates of pages, from the node table and from the raw string."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.operators import containment
from pagelens.sources.html import INSIDE

HIDDEN = ["script", "style", "template", "noscript", "svg"]

# Selectors and strings that tell an application shell, boilerplate, lazy loading and a page builder.
SHELL_SELECTORS = ["#root", "#app", "#__next", "#__nuxt", "[data-reactroot]", "[data-v-app]", "[ng-version]"]
HYDRATION_MARKS = ["data-reactroot", "data-react-helmet", "data-server-rendered", "data-n-hydration", "data-n-ssr", "ng-version", "data-v-"]
BOILERPLATE_SELECTORS = ["#cookie-banner", "#gdpr-banner", ".cookie-consent", ".gdpr-overlay", "#login-wall", ".paywall", ".skeleton", "[role='dialog']"]
LAZY_ATTRIBUTES = ["loading", "data-lazy", "data-lazy-src", "data-src", "data-bg", "data-background", "data-lazyload", "data-ll-status", "data-was-processed", "data-evaluated", "data-elementor-type", "data-elementor-id", "data-ll-state", "data-ll-loaded"]
LAZY_CLASSES = ["lazy", "lazyload", "lazy-load", "lazyloading", "lazy-loading", "lazyloaded", "lazy-loaded", "lazyload-item", "lazyload-pending", "lazyload-wrapper", "lozad", "blazy", "vanilla-lazyload", "elementor-lazy", "elementor-lazyload"]
SCROLL_MARKS = ["infinite-scroll", "infinite_scroll", "loadmore", "load-more", "auto-load", "scroll-pagination", "scroll-loader"]
RENDER_MARKS = ['id="root"', 'id="app"', 'id="__next"', 'id="__nuxt"', "data-reactroot", "data-react-root", "data-v-app", "ng-version"]
BUILDER_MARKS = ["elementor-section", "elementor-widget", "elementor-column", "elementor-container", "elementor-element", "e-con", "data-elementor-type", "data-elementor-id", "elementor/frontend", "elementorfrontend"]


MOJIBAKE_MARKS = ["\ufffd", "Ã©", "Ã¨", "Ã§", "Ã "]


_SELECTOR = re.compile(r"""([a-z][a-z0-9]*)|([#.])([\w-]+)|\[([\w-]+)(?:(\*?=)['"]?([^'"\]]*)['"]?)?\]""")


def matches(css: str) -> Column:
    """Whether a node is one that the selector finds: tag, id, class and attribute tests, after a parent (>) or ancestor tag."""
    *before, last = re.split(r"\s+", css.strip())
    tests = [F.col("kind") == "element"]
    if before:
        child = before[-1] == ">"
        up = before[-2] if child else before[-1]
        if not child and up not in INSIDE:
            raise ValueError(f"nodes do not tell whether they are within {up}")
        tests.append(F.col("parent_tag") == up if child else F.array_contains("within", up))
    for tag, mark, name, attribute, test, value in _SELECTOR.findall(last):
        if tag:
            tests.append(F.col("tag") == tag)
        elif mark == "#":
            tests.append(F.col("attrs")["id"] == name)
        elif mark == ".":
            tests.append(class_has(name))
        elif test == "=":
            tests.append(F.col("attrs")[attribute] == value)
        else:
            tests.append(F.contains(F.col("attrs")[attribute], F.lit(value)) if test else F.col("attrs")[attribute].isNotNull())
    return F.coalesce(reduce(lambda x, y: x & y, tests), F.lit(False))


def found(css: str) -> Column:
    """Aggregate: 1 if a group of nodes has one that the selector finds, else 0."""
    return F.max(matches(css).cast("int"))


def has_any(col: Column, marks: list[str]) -> Column:
    """Whether one of the marks stands in a text; a mark that holds another one says nothing more than that."""
    out = F.lit(False)
    for mark in (m for m in dict.fromkeys(marks) if not any(x in m for x in marks if x != m)):
        out = out | F.contains(col, F.lit(mark))
    return F.coalesce(out, F.lit(False))


def class_has(name: str) -> Column:
    return F.array_contains("classes", name)


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def element_text(nodes: DataFrame, wanted: DataFrame, hidden: list[str] | None = None) -> DataFrame:
    """(page_id, pre, content) of the wanted elements (page_id, pre): their visible text, by a containment join."""
    hidden = HIDDEN[:3] if hidden is None else hidden
    shown = (F.col("kind") == "text") & ~F.arrays_overlap("within", F.array(*map(F.lit, hidden)))
    near = nodes.join(wanted.select("page_id").distinct(), "page_id", "left_semi")  # pages without a wanted element go no further
    marked = near.join(wanted.select("page_id", "pre", F.lit(True).alias("wanted")), ["page_id", "pre"], "left")
    inside = containment.pairs(marked, F.col("wanted"), shown)
    texts = inside.join(near.where(shown).select("page_id", "pre", "text"), ["page_id", "pre"]).select("page_id", F.col("up").alias("pre"), F.col("pre").alias("at"), "text")
    found = texts.groupBy("page_id", "pre").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("parts"))
    return found.select("page_id", "pre", joined(F.col("parts")).alias("content")).withColumn("content", T.collapse_space(F.col("content")))


def page_text(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, visible_text, element_text) of every page: body text without hidden elements; the second keeps noscript and svg."""
    in_body = F.array_contains("within", "body")
    shown = in_body & ~F.arrays_overlap("within", F.array(*map(F.lit, HIDDEN)))
    kept = in_body & ~F.arrays_overlap("within", F.array(*map(F.lit, HIDDEN[:3])))
    part = F.struct("pre", "text", shown.alias("shown"))
    found = nodes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.when(kept & (F.col("kind") == "text"), part))).alias("parts"))
    # where no noscript or svg has text, the two are one, and are made once
    visible = F.when(F.exists("parts", lambda p: ~p["shown"]), joined(F.filter("parts", lambda p: p["shown"])))
    texts = found.select("page_id", joined(F.col("parts")).alias("element_text"), visible.alias("visible_text"))
    texts = texts.withColumns({c: T.collapse_space(F.col(c)) for c in ("element_text", "visible_text")})
    texts = texts.select("page_id", F.coalesce("visible_text", "element_text").alias("visible_text"), "element_text")
    return pages.select("page_id").join(texts, "page_id", "left").fillna("")


def page_flags(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """One row of predicates per page (page_id, html): what makes a page's evidence doubtful, and why; parse_error tells why a page has no nodes."""
    in_body = F.array_contains("within", "body")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    element = F.col("kind") == "element"
    per = nodes.groupBy("page_id").agg(
        count((F.col("kind") == "text") & in_body & (F.trim("text") != "")).alias("text_nodes"),
        count(element).alias("elements"),
        count(F.col("tag") == "script").alias("scripts"),
        count(F.col("tag") == "body").alias("bodies"),
        count((F.col("parent_tag") == "body") & element & ~F.col("tag").isin("script", "noscript", "template")).alias("body_children"),
        F.max(F.coalesce(F.array_contains("within", "script") & F.contains("text", F.lit("attachShadow")), F.lit(False))).alias("shadow_dom"),
        count(element & in_body & (F.col("pre") == F.col("last"))).alias("empty_leaves"),
        sum(found(css) for css in BOILERPLATE_SELECTORS).alias("banner_elements"),
        F.greatest(*(found(css) for css in SHELL_SELECTORS)).alias("shell_elements"),
        count(F.col("tag") == "parsererror").alias("parser_errors"),
        F.max(F.when(F.col("kind") == "error", F.col("text"))).alias("parse_error"),
    )
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "html", F.lower(html).alias("low")).join(per, "page_id", "left").join(page_text(nodes, pages).hint("merge"), "page_id", "left").fillna(0, ["text_nodes", "elements", "scripts", "bodies", "body_children", "empty_leaves", "banner_elements", "shell_elements", "parser_errors"]).fillna(False, ["shadow_dom"])
    text_len = F.length("visible_text")
    last_word = F.substring_index("visible_text", " ", -1)  # single blanks are all the space that is left in it
    rows = rows.withColumns(
        {
            "blank": F.trim(html) == "",
            "hydration_shell": (text_len < 80) & ((F.col("shell_elements") > 0) | has_any(html, HYDRATION_MARKS) | ((F.col("scripts") > 5) & (text_len < 50))),
            "script_only_dom": (F.col("body_children") == 0) | (text_len < 20),
            "boilerplate_only": text_len.between(100, 399) & (F.col("banner_elements") >= 2),
            "malformed_dom": (F.col("elements") < 3) | (F.col("bodies") == 0) | (F.col("parser_errors") > 0),
            "oversized_html": F.length(html) > 10 * 1024 * 1024,
            "encoding_failure": has_any(html, MOJIBAKE_MARKS) | html.rlike("[À-Ã][\\u0080-\\u00BF]"),
            "mid_sentence_truncation": (text_len >= 150) & ~F.substring("visible_text", -3, 3).rlike(r"[.!?:;]$") & last_word.rlike("^[A-Za-z]{4,}$") & last_word.rlike("(?i)[^aeiou]{2}$"),
            "truncated_html": (F.length(html) > 100) & ~(F.contains("low", F.lit("</html>")) & F.contains("low", F.lit("</body>"))),
            "lazy_load": has_any(F.col("low"), [*LAZY_ATTRIBUTES, *LAZY_CLASSES, "intersectionobserver", *SCROLL_MARKS]) | (F.contains("low", F.lit("pagination")) & F.contains("low", F.lit("scroll"))),
            "page_builder": has_any(F.col("low"), BUILDER_MARKS),
        }
    )
    rows = rows.withColumn("needs_rendering", F.col("lazy_load") | F.col("page_builder") | has_any(F.col("low"), RENDER_MARKS))
    corrupt = F.when(F.col("bodies") == 0, "no_body").when(F.col("text_nodes") < 3, "too_few_text_nodes").when(F.col("empty_leaves") > 12000, "too_many_empty_nodes").when(F.col("script_only_dom"), "script_only").when(F.col("hydration_shell"), "hydration_shell")
    rows = rows.withColumn("dom_corruption", corrupt)
    order = [F.when(F.col("blank") | F.col("parse_error").isNotNull(), "parser_error"), F.when(F.col("dom_corruption").isNotNull(), "dom_corruption")] + [F.when(F.col(c), c) for c in ("hydration_shell", "shadow_dom", "malformed_dom", "script_only_dom", "boilerplate_only", "oversized_html", "encoding_failure", "mid_sentence_truncation")]
    rows = rows.withColumn("contamination", F.array_compact(F.array(*order)))
    blocking = F.filter("contamination", lambda c: c.isin("dom_corruption", "hydration_shell", "script_only_dom"))
    return rows.withColumn("blocked", F.size(blocking) > 0).withColumn("contamination_type", F.coalesce(F.get(blocking, F.lit(0)), F.get("contamination", F.lit(0)))).drop("html", "low")
