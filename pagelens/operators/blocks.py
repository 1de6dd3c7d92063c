"""Content blocks of pages with what stands in them: questions and answers, prices and plans, specifications, features,
reviews, discussions and comparisons; and their renderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.operators import containment, dom
from pagelens.plans.scratch import by_page

# Kinds of content blocks, their selectors in order of precedence, and confidence.
BLOCKS = {
    "faq": ([".faq", "[class*='faq']", "[class*='frequently-asked']", "details > summary", ".accordion-item"], 0.85),
    "pricing": ([".pricing-table", ".pricing-card", "[class*='pricing']", ".plan-card", ".price-card", "[class*='plan-']"], 0.9),
    "specs": ([".product-specs", ".specifications", "[class*='spec']", ".tech-specs", ".product-details"], 0.85),
    "feature": ([".features-list", ".feature-list", "[class*='feature']", ".benefits-list", ".advantages"], 0.8),
    "review": ([".review", ".reviews", "[class*='review']", ".testimonial", ".testimonials", "[class*='testimonial']", ".rating", ".star-rating"], 0.8),
    "qa": ([".qa", ".q-a", "[class*='question-answer']", ".comment-question", ".discussion"], 0.75),
}
#: What stands in a block of a kind: the role, its selectors, and whether it must be the block's child.
ROLES = [
    ("faq", "question", ["summary", ".faq-question", ".accordion-title"], False),
    ("faq", "answer", [".faq-answer", ".accordion-content"], False),
    ("faq", "answer", ["p"], True),
    ("pricing", "plan", ["h3", "h4", ".plan-name"], False),
    ("specs", "items", ["tr", "dt", ".spec-row", ".spec-item"], False),
    ("feature", "items", ["li", ".feature-item", ".benefit-item"], False),
    ("review", "rating", ["[class*='star']", ".rating-value"], False),
    ("review", "author", [".review-author", ".testimonial-author", "[class*='author']"], False),
]
COMPARISON_WORDS = ["compare", "vs", "plan"]
#: Items of a block that are kept, and characters of each; headers of a comparison.
ITEMS, ITEM_CHARS, HEADERS = 15, 100, 10


def cut(n: int) -> Column:
    """A node's text, cut at n characters (at most those that nodes keep)."""
    return F.when(F.col("chars") <= n, F.col("content")).otherwise(F.concat(F.rtrim(F.substring("content", 1, n)), F.lit("…")))


def candidates(nodes: DataFrame) -> DataFrame:
    """Elements that a selector of a block or of a block's part finds, with what each finds (hits, roles).

    Written once, in buckets by page: the selectors are tried once a node, and no other node is joined, sorted or sent.
    """
    hits = F.array_compact(F.array(*(F.when(dom.matches(css), F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("prio"), F.lit(sure).alias("sure"))) for kind, (marks, sure) in BLOCKS.items() for i, css in enumerate(marks))))
    roles = F.array_compact(F.array(*(F.when(reduce(lambda x, y: x | y, map(dom.matches, marks)), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("role"), F.lit(child).alias("child"))) for kind, name, marks, child in ROLES)))
    rows = nodes.where("kind = 'element'").select("page_id", F.col("pre").cast("long").alias("pre"), "last", "parent", "content", "chars", hits.alias("hits"), roles.alias("roles"))
    return by_page(rows.where("size(hits) > 0 or size(roles) > 0"), "blocks")


def block_nodes(found: DataFrame) -> DataFrame:
    """(page_id, pre, kind, sure) of all blocks among the candidates: of each kind what the first of its selectors that finds any finds."""
    rows = found.select("page_id", "pre", F.explode("hits").alias("m")).select("page_id", "pre", "m.*")
    return rows.withColumn("first", F.min("prio").over(W.partitionBy("page_id", "kind"))).where("prio = first").select("page_id", "pre", "kind", "sure")


def block_parts(found: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, pre, kind) of each block with question, answer, plan, rating and author (the first of each) and items (all, in order)."""
    marked = found.join(blocks.select("page_id", "pre", F.lit(True).alias("is_block")).distinct(), ["page_id", "pre"], "left")
    inside = containment.pairs(marked, F.col("is_block"), F.size("roles") > 0)
    parts = inside.join(found.where("size(roles) > 0").select("page_id", "pre", "parent", "roles", "content", "chars"), ["page_id", "pre"]).withColumn("r", F.explode("roles")).where("not r.child or parent = up")
    parts = parts.select("page_id", F.col("up").alias("block"), F.col("r.kind").alias("kind"), F.col("r.role").alias("role"), "pre", "content", "chars")
    text = F.when(F.col("role") == "items", cut(ITEM_CHARS)).when(F.col("role") == "answer", cut(300)).otherwise(F.col("content"))
    first = lambda name: F.min_by(F.when(F.col("role") == name, F.coalesce(text, F.lit(""))), F.when(F.col("role") == name, F.col("pre"))).alias(name)
    items = F.array_sort(F.collect_list(F.when((F.col("role") == "items") & (F.col("content") != ""), F.struct("pre", text.alias("text")))))
    per = parts.groupBy("page_id", F.col("block").alias("pre"), "kind").agg(*map(first, ("question", "answer", "plan", "rating", "author")), F.transform(items, lambda i: i["text"]).alias("items"))
    return blocks.join(per, ["page_id", "pre", "kind"], "left")


def comparison_tables(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, headers) of tables with over two cells in their heads (inner tables' too) that speak of comparing."""
    heads = containment.pairs(nodes, F.col("tag") == "table", F.col("tag") == "thead").select("page_id", F.col("up").alias("table"), F.col("pre").alias("up"))
    cells = containment.pairs(nodes, F.col("tag") == "thead", F.col("tag").isin("th", "td"))
    named = cells.join(nodes.where("tag in ('th', 'td')").select("page_id", "pre", "content"), ["page_id", "pre"]).join(heads, ["page_id", "up"])
    cell = F.array_sort(F.collect_set(F.struct("pre", "content")))
    per = named.groupBy("page_id", F.col("table").alias("pre")).agg(F.transform(cell, lambda c: c["content"]).alias("headers"))
    return per.where((F.size("headers") > 2) & dom.has_any(F.lower(F.array_join("headers", " ")), COMPARISON_WORDS))


def structured_content(nodes: DataFrame) -> DataFrame:
    """Signals of all blocks, with what they hold in meta; items and headers are joined by bars there."""
    from pagelens.operators.evidence import signal

    some = candidates(nodes)
    found = block_nodes(some)
    rows = block_parts(some, found).join(some.select("page_id", "pre", "content", "chars"), ["page_id", "pre"])
    texts = dom.element_text(nodes, found.where("kind = 'pricing'").select("page_id", "pre")).select("page_id", "pre", F.col("content").alias("all_text"))
    rows = rows.join(texts, ["page_id", "pre"], "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    kind, items = F.col("kind"), F.coalesce("items", F.array().cast("array<string>"))
    price = F.when(kind == "pricing", F.nullif(F.regexp_extract(blank("all_text"), r"\$\d+(?:\.\d{2})?", 0), F.lit("")))
    listed = kind.isin("specs", "feature")
    value = F.when(kind == "faq", F.when(blank("question") != "", T.truncate(F.col("question"), 300)).otherwise("FAQ item")).when(listed, T.truncate(F.array_join(items, " | "), 300)).otherwise(cut(300))
    of = lambda name, *kinds: F.when(kind.isin(*kinds), F.col(name))
    asked = lambda name: F.when(kind == "faq", blank(name))
    signals = signal(rows, "structured_content", F.concat(kind, F.lit("_block")), value, F.col("sure"), price=price, question=asked("question"), answer=asked("answer"), plan=of("plan", "pricing"), rating=of("rating", "review"), author=of("author", "review"), count=F.when(listed, F.size(items)), items=F.when(listed, F.array_join(F.slice(items, 1, ITEMS), " | ")))
    tables = comparison_tables(nodes)
    compared = signal(tables, "structured_content", "comparison_block", T.truncate(F.lower(F.array_join("headers", " ")), 200), F.lit(0.85), count=F.size("headers"), items=F.array_join(F.slice("headers", 1, HEADERS), " | "))
    return signals.unionByName(compared)


def render_blocks(signals: DataFrame) -> DataFrame:
    """Block signals with their values in the kind's form: Q: question; plan, price and text; items by bars; author, rating and text; columns by vs."""
    meta, kind = F.col("meta"), F.col("type")
    clean = lambda c: T.normalize_text(F.coalesce(c, F.lit("")))
    joined = lambda mark, *parts: F.array_join(F.filter(F.array(*parts), lambda p: p != ""), mark)
    items = F.transform(F.split(F.coalesce(meta["items"], F.lit("")), r" \| "), lambda i: T.normalize_text(i))
    value = F.when(kind == "faq_block", F.concat(F.lit("Q: "), clean(F.coalesce(meta["question"], F.col("value")))))
    value = value.when(kind == "pricing_block", joined(" — ", clean(meta["plan"]), F.coalesce(meta["price"], F.lit("")), clean(F.col("value"))))
    value = value.when(kind.isin("specs_block", "feature_block"), F.array_join(items, " | ")).when(kind == "comparison_block", F.array_join(items, " vs "))
    value = value.when(kind == "review_block", joined(" — ", clean(meta["author"]), clean(meta["rating"]), clean(F.col("value")))).when(kind == "qa_block", clean(F.col("value"))).otherwise(F.col("value"))
    form = F.create_map(*(F.lit(x) for kv in {"faq_block": "question_answer", "pricing_block": "plan_price", "specs_block": "key_value_list", "feature_block": "feature_list", "review_block": "author_rating_content", "qa_block": "discussion_text", "comparison_block": "comparison_columns"}.items() for x in kv))
    return signals.where("section = 'structured_content'").withColumn("format", form[kind]).withColumn("value", value)
