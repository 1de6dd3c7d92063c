"""All queries of the library by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions.score import grade
from pagelens.operators import benchmark, blocks, diagnostics, evidence, inventory, normalize, reconcile, reports
from pagelens.operators.metrics import WEIGHTS
from pagelens.plans.audit import PageAudit, text_entities, text_metrics, text_stats
from pagelens.plans.runner import run_cases
from pagelens.plans.scratch import shared_dir
from pagelens.sources import corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files are fewer than those; larger inputs are read as they lie, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# ---- SQL pieces ----------------------------------------------------------------------------------------------

_QUOTED = "text"
for _old, _new in (T.MOJIBAKE | T.QUOTES).items():
    _QUOTED = f"replace({_QUOTED}, '{_old.replace(chr(39), chr(39) * 2)}', '{_new.replace(chr(39), chr(39) * 2)}')"
_SPACE = r"[ \t\n\r\f\v   -     　]"
#: clean.t is the normalised text of every document
CLEAN = f"""clean AS (SELECT doc_id, lang, source, n_chars, text,
    trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_QUOTED}, '!{{2,}}', '!', 'g'), '\\?{{2,}}', '?', 'g'), '{_SPACE}+([,.!?;:])', '\\1', 'g'), '([,.!?;:])([A-Za-z])', '\\1 \\2', 'g'), '{_SPACE}+', ' ', 'g')) AS t
    FROM (SELECT doc_id, lang, source, n_chars, coalesce(text, '') AS text FROM documents))"""
TOKENS = (
    CLEAN
    + """,
    tokens AS (SELECT *,
        list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+([A-ZÀ-ſ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS s,
        regexp_extract_all(lower(t), '\\b[a-zA-ZÀ-ſ]+(?:[''-][a-zA-ZÀ-ſ]+)*\\b') AS w FROM clean)"""
)
_CLAMP = "greatest(0.0, least(100.0, floor(({0}) * 100.0 + 0.5) / 100.0))"


# ---- text ----------------------------------------------------------------------------------------------------


@query(f"WITH {TOKENS} SELECT doc_id, len(s) AS n_sentences, len(w) AS n_words FROM tokens")
def text_tokens(spark, sf_dir):
    stats = text_stats(table(spark, sf_dir, "documents"))
    return stats.select("doc_id", F.size("sentence_list").cast("long").alias("n_sentences"), F.size("word_list").cast("long").alias("n_words"))


@query(f"WITH {CLEAN} SELECT doc_id, md5(t) AS normal_md5, CAST(length(t) AS INTEGER) AS normal_chars FROM clean")
def text_normalize(spark, sf_dir):
    t = T.normalize_text(F.coalesce(F.col("text"), F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t).alias("normal_md5"), F.length(t).alias("normal_chars"))


@query(f"WITH {CLEAN} SELECT k AS comparison_key, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(t), '[^A-Za-z0-9_\\s-]', '', 'g'), '\\s+', ' ', 'g'))) AS k FROM clean) GROUP BY k")
def text_comparison_keys(spark, sf_dir):
    key = F.md5(T.comparison_key(F.coalesce(F.col("text"), F.lit(""))))
    return table(spark, sf_dir, "documents").groupBy(key.alias("comparison_key")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {TOKENS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(w) AS word FROM tokens) GROUP BY word HAVING count(*) >= 50")
def text_frequent_words(spark, sf_dir):
    dealt = table(spark, sf_dir, "documents").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # texts move, once; their words do not
    # the outer explode lets no filter on the list's size be pushed down, which would find all words twice more
    words = text_stats(dealt).select("doc_id", F.explode_outer("word_list").alias("word")).where("word is not null")
    per_doc = words.groupBy("word", "doc_id").agg(F.count("*").alias("c"))
    return per_doc.groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("docs")).where("n >= 50")


_TEXT_FACTS = (
    TOKENS
    + """,
    facts AS (SELECT doc_id, lang, len(s) AS n, len(w) AS m, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS letters,
        len(list_filter(s, lambda x: len(regexp_split_to_array(trim(x), '\\s+')) BETWEEN 8 AND 25)) AS good,
        len(list_filter(s, lambda x: len(regexp_split_to_array(trim(x), '\\s+')) > 40)) AS toolong,
        len(list_filter(w, lambda x: length(x) > 10)) AS rare,
        len(list_filter(w, lambda x: list_contains(['"""
    + "','".join(T.VAGUE_WORDS)
    + """'], x))) AS vague,
        len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: trim(x, ' ') <> '')) AS paragraphs FROM tokens),
    ratios AS (SELECT *, letters / m::DOUBLE AS len_, m / n::DOUBLE AS per, rare / m::DOUBLE AS r, vague / m::DOUBLE AS v FROM facts)"""
)
_READABILITY = f"""{_CLAMP.format('+'.join(f"{_CLAMP.format(x)} * {w}" for x, w in [
    ("good / n::DOUBLE * 100 - toolong * 5", 0.30),
    ("CASE WHEN len_ BETWEEN 4 AND 7 THEN 90 WHEN len_ > 7 THEN greatest(40, 90 - (len_ - 7) * 10) ELSE greatest(50, 90 - (4 - len_) * 10) END", 0.25),
    ("CASE WHEN per BETWEEN 8 AND 25 THEN 95 WHEN per > 40 THEN greatest(30, 95 - (per - 40) * 3) WHEN per < 8 THEN greatest(40, 95 - (8 - per) * 5) ELSE 80 END", 0.25),
    ("CASE WHEN m > 2000 THEN 95 WHEN m > 500 THEN 80 WHEN m > 100 THEN 60 ELSE 30 END", 0.20)]))}"""
_CLARITY = f"""{_CLAMP.format('+'.join(f"{_CLAMP.format(x)} * {w}" for x, w in [
    ("CASE WHEN per BETWEEN 8 AND 20 THEN 90 WHEN per > 30 THEN greatest(30, 90 - (per - 30) * 3) WHEN per < 5 THEN 60 ELSE 75 END", 0.30),
    ("CASE WHEN r < 0.05 THEN 95 WHEN r < 0.10 THEN 85 WHEN r < 0.20 THEN 70 ELSE greatest(30, 90 - r * 100) END", 0.25),
    ("CASE WHEN paragraphs >= 5 THEN 85 WHEN paragraphs >= 2 THEN 70 WHEN paragraphs >= 1 THEN 50 ELSE 30 END", 0.25),
    ("CASE WHEN v < 0.05 THEN 95 WHEN v < 0.10 THEN 80 WHEN v < 0.20 THEN 60 ELSE greatest(25, 90 - v * 150) END", 0.20)]))}"""


@query(f"""WITH {_TEXT_FACTS} SELECT doc_id, CASE WHEN n > 0 AND m > 0 THEN {_READABILITY} END AS readability, CASE WHEN n > 0 AND m > 0 THEN greatest(0.3, floor((0.85 - toolong * 0.02) * 10000.0 + 0.5) / 10000.0) END AS confidence FROM ratios""")
def text_readability(spark, sf_dir):
    rows = text_metrics(table(spark, sf_dir, "documents")).where("metric = 'readability'")
    return rows.select("doc_id", F.col("score").alias("readability"), "confidence")


@query(f"""WITH {_TEXT_FACTS}, scored AS (SELECT doc_id, lang, CASE WHEN n > 0 AND m > 0 THEN {_CLARITY} END AS clarity FROM ratios)
SELECT doc_id, clarity, CASE WHEN clarity IS NULL THEN 'N/A' WHEN clarity >= 90 THEN 'A' WHEN clarity >= 80 THEN 'B' WHEN clarity >= 70 THEN 'C' WHEN clarity >= 60 THEN 'D' ELSE 'F' END AS grade FROM scored""")
def text_clarity(spark, sf_dir):
    rows = text_metrics(table(spark, sf_dir, "documents")).where("metric = 'clarity'")
    return rows.select("doc_id", F.col("score").alias("clarity"), grade(F.col("score")).alias("grade"))


@query(f"""WITH {_TEXT_FACTS}, scored AS (SELECT doc_id, CASE WHEN n > 0 AND m > 0 THEN {_READABILITY} END AS x FROM ratios)
SELECT CAST(l.quality AS INTEGER) AS quality, count(*) AS docs, round(avg(x), 6) AS mean_readability, median(x) AS median_readability FROM scored JOIN labels l USING (doc_id) GROUP BY ALL""")
def text_score_by_label(spark, sf_dir):
    rows = text_metrics(table(spark, sf_dir, "documents")).where("metric = 'readability'").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy(F.col("quality").cast("int").alias("quality")).agg(F.count("*").alias("docs"), F.round(F.avg("score"), 6).alias("mean_readability"), F.median("score").alias("median_readability"))


_EMAILS = "regexp_extract_all(text, '\\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}\\b')"


@query(
    f"""WITH found AS (
    SELECT doc_id, 'email' AS kind, unnest(list_distinct({_EMAILS})) AS value FROM documents UNION ALL
    SELECT doc_id, 'url', unnest(list_transform(list_distinct(regexp_extract_all(text, 'https?://[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}(?:/[^\\s]*)?')), lambda v: CASE WHEN length(v) <= 200 THEN v ELSE rtrim(v[1:200]) || '…' END)) FROM documents)
    SELECT doc_id, kind, count(*) AS n, min(value) AS first_value FROM found GROUP BY doc_id, kind"""
)
def text_contact_entities(spark, sf_dir):
    found = text_entities(table(spark, sf_dir, "documents")).where(F.col("type").isin("email", "url"))
    return found.groupBy("doc_id", F.col("type").alias("kind")).agg(F.count("*").alias("n"), F.min("value").alias("first_value"))


@query()
def text_entity_counts(spark, sf_dir):
    found = text_entities(table(spark, sf_dir, "documents"), distinct=True)
    return found.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.max("confidence").alias("confidence"))


@query("SELECT conv_id, role, count(*) AS turns, CAST(sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> ''))) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id, role")
def conversation_volume(spark, sf_dir):
    tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r]+"), lambda x: x != ""))
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.count("*").alias("turns"), F.sum(tokens).cast("long").alias("tokens"))


# ---- pages ---------------------------------------------------------------------------------------------------


def audit(spark, sf_dir) -> PageAudit:
    return PageAudit(table(spark, sf_dir, "pages"))


@query("SELECT page_id, len(regexp_extract_all(html, '<h1[ >]')) AS h1, len(regexp_extract_all(html, '<a href=')) AS links, len(regexp_extract_all(html, '<li[ >]')) AS items, len(regexp_extract_all(html, '<footer[ >]')) AS footers, len(regexp_extract_all(html, '<nav[ >]')) AS navs, len(regexp_extract_all(html, '<script[ >]')) AS scripts FROM pages")
def page_element_counts(spark, sf_dir):
    nodes = audit(spark, sf_dir).nodes
    n = lambda tag: F.sum(F.when(F.col("tag") == tag, 1).otherwise(0)).cast("long")
    return nodes.groupBy("page_id").agg(n("h1").alias("h1"), F.sum(F.when((F.col("tag") == "a") & F.col("attrs")["href"].isNotNull(), 1).otherwise(0)).cast("long").alias("links"), n("li").alias("items"), n("footer").alias("footers"), n("nav").alias("navs"), n("script").alias("scripts"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages")
def page_metadata(spark, sf_dir):
    fields = evidence.metadata(audit(spark, sf_dir).nodes)
    of = lambda name: F.max(F.when(F.col("type") == f"meta_{name}", F.col("value")))
    return fields.groupBy("page_id").agg(of("lang").alias("lang"), of("charset").alias("charset"))


@query(
    """WITH hrefs AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
    t AS (SELECT page_id, CASE WHEN lower(regexp_extract(href, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) IN ('', host) THEN 'internal_link' ELSE 'external_link' END AS kind FROM hrefs)
    SELECT page_id, kind, count(*) AS n FROM t GROUP BY page_id, kind"""
)
def page_links(spark, sf_dir):
    a = audit(spark, sf_dir)
    return evidence.links(a.nodes, a.pages).groupBy("page_id", F.col("type").alias("kind")).agg(F.count("*").alias("n"))


_PRESENT = {"title": "<title>", "meta:name=description": 'name="description"', "h1": "<h1[ >]", "main": "<main[ >]", "nav": "<nav[ >]", "article": "<article[ >]", "script:type=application/ld+json": "application/ld.json", "meta:property=og:title": "og:title", "meta:property=og:description": "og:description", "meta:property=og:image": "og:image", "link:rel=canonical": 'rel="canonical"', "img:alt": "<img[^>]* alt=", "section": "<section[ >]", "header": "<header[ >]", "footer": "<footer[ >]", "html:lang": "<html[^>]* lang=", "meta:name=viewport": 'name="viewport"', "time": "<time[ >]", "meta:name=robots": 'name="robots"'}


@query("SELECT page_id, name, severity FROM pages, (VALUES " + ", ".join(f"('{_PRESENT[s]}', '{n}', '{v}')" for s, n, v in evidence.ABSENCES) + ") AS r(pattern, name, severity) WHERE NOT regexp_matches(html, pattern)")
def page_absences(spark, sf_dir):
    a = audit(spark, sf_dir)
    return evidence.absence(a.nodes, a.pages).select("page_id", F.col("value").alias("name"), F.col("meta")["severity"].alias("severity"))


@query("SELECT page_id, length(html) > 100 AND NOT (contains(lower(html), '</html>') AND contains(lower(html), '</body>')) AS truncated_html, length(html) > 10485760 AS oversized_html FROM pages")
def page_source_flags(spark, sf_dir):
    return audit(spark, sf_dir).flags.select("page_id", "truncated_html", "oversized_html")


@query()
def page_contamination(spark, sf_dir):
    return normalize.contamination_rows(audit(spark, sf_dir).flags)


@query()
def page_evidence_summary(spark, sf_dir):
    return evidence.summary(audit(spark, sf_dir).signals)


@query()
def page_dedup_summary(spark, sf_dir):
    a = audit(spark, sf_dir)
    return normalize.dedup_counts(a.signals, a.kept)


@query()
def page_hierarchy(spark, sf_dir):
    return normalize.hierarchy_stats(evidence.hierarchy(audit(spark, sf_dir).nodes))


@query()
def page_domains(spark, sf_dir):
    a = audit(spark, sf_dir)
    return normalize.domain_ranking(evidence.domain_profile(a.nodes, a.texts)).where("rank = 1").select("page_id", F.col("value").alias("domain"), "running")


@query()
def page_semantics(spark, sf_dir):
    """Classes of headings, paragraphs, lists, tables, links and anchors."""
    a = audit(spark, sf_dir)
    h, p, k = evidence.headings(a.nodes), evidence.paragraphs(a.nodes), evidence.links(a.nodes, a.pages)
    rows = evidence.semantic_headings(h, a.nodes)
    for more in (evidence.semantic_paragraphs(p), evidence.semantic_lists(a.nodes), evidence.semantic_tables(a.nodes), evidence.semantic_links(k), evidence.anchor_text(k, a.nodes)):
        rows = rows.unionByName(more)
    return rows.groupBy("section", F.coalesce(F.col("meta")["class"], "type").alias("type")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


@query()
def page_metrics(spark, sf_dir):
    return audit(spark, sf_dir).metric_rows.select("page_id", "metric", "score", "confidence")


@query()
def score_pages(spark, sf_dir):
    return audit(spark, sf_dir).scores


@query()
def page_recommendations(spark, sf_dir):
    return reports.top_recommendations(audit(spark, sf_dir).recommendations)


@query()
def page_reports(spark, sf_dir):
    return audit(spark, sf_dir).reports


@query()
def documents_as_pages(spark, sf_dir):
    """Plain texts through the page audit."""
    return PageAudit(corpus.text_pages(table(spark, sf_dir, "documents"), "doc_id", "text")).scores


_HEAD = "'<!DOCTYPE html>' || chr(10) || '<html lang=\"en\">' || chr(10) || '<head>' || chr(10) || '<meta charset=\"UTF-8\">' || chr(10) || '<title>' || s_name || '</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || '<main>' || chr(10)"
_TAIL = "chr(10) || '</main>' || chr(10) || '</body>' || chr(10) || '</html>'"


@query(
    f"""SELECT s_suppkey AS page_id, {_HEAD} || array_to_string(['<h1>' || s_name || '</h1>', '<p>Of <strong>' || s_suppkey || '</strong> &amp; <code>a*b</code></p>',
        '<ol start="' || (s_suppkey % 5 + 2) || '">', '<li>', 'first', '<ul>', '<li>', 'inner ' || s_name, '</li>', '</ul>', '</li>', '<li>', 'second', '</li>', '</ol>',
        '<blockquote>', 'said', '<ul>', '<li>', '<a href="/x">it</a>', '</li>', '</ul>', '</blockquote>', '<pre><code>x &lt; ' || s_suppkey, '</code></pre>'], chr(10)) || {_TAIL} AS html FROM supplier"""
)
def made_markdown(spark, sf_dir):
    """Markdown of suppliers as pages: a list within a numbered one, a quote with a list, inline marks and code."""
    name, k = F.col("s_name"), F.col("s_suppkey")
    start = (k % 5 + 2).cast("string")
    parts = ["# ", name, "\n\nOf **", k.cast("string"), "** & `a*b`\n\n", start, ". first\n   - inner ", name, "\n", start, ". second\n\n> said\n> - [it](/x)\n\n```\nx < ", k.cast("string"), "\n```\n"]
    md = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    return table(spark, sf_dir, "supplier").select(k.alias("page_id"), corpus.markdown_pages(md).alias("html"))


@query(
    f"""SELECT s_suppkey AS page_id, {_HEAD} || '<h1>JSON Object</h1>' || array_to_string(['<p><strong>title:</strong> ' || s_name || '</p>', '<p><strong>key:</strong> ' || s_suppkey || '</p>', '<p><strong>none:</strong> null</p>',
        '<h2>tags</h2><ul><li>a</li><li>&lt;b&gt;</li></ul>', '<h2>rows</h2><table><thead><tr><th>x</th><th>y</th></tr></thead><tbody><tr><td>' || s_suppkey || '</td><td></td></tr><tr><td></td><td>z</td></tr></tbody></table>',
        '<h2>in</h2><h3>deep</h3><ul><li>1</li></ul>'], chr(10)) || {_TAIL} AS html FROM supplier"""
)
def made_json(spark, sf_dir):
    """JSON of suppliers as pages: fields, a list, a table of objects of unlike keys, and nesting."""
    name, k = F.col("s_name"), F.col("s_suppkey").cast("string")
    raw = F.concat(F.lit('{"title":"'), name, F.lit('","key":'), k, F.lit(',"none":null,"tags":["a","<b>"],"rows":[{"x":'), k, F.lit('},{"y":"z"}],"in":{"deep":[1]}}'))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), corpus.json_pages(raw).alias("html"))


@query("SELECT page_id, 'article' AS tag FROM pages")
def page_main_content(spark, sf_dir):
    return inventory.main_content(audit(spark, sf_dir).nodes).select("page_id", "tag")


@query()
def page_selectors(spark, sf_dir):
    return inventory.selectors(audit(spark, sf_dir).nodes)


@query("SELECT page_id, len(critical) AS critical, len(warning) AS warning, len(info) AS info FROM (SELECT page_id, list(name) FILTER (WHERE severity = 'critical') AS critical, list(name) FILTER (WHERE severity = 'warning') AS warning, list(name) FILTER (WHERE severity = 'info') AS info FROM (" + ORACLE_SQL["page_absences"] + ") GROUP BY page_id)")
def page_absence_counts(spark, sf_dir):
    a = audit(spark, sf_dir)
    per = reports.absence_lists(evidence.absence(a.nodes, a.pages))
    return per.select("page_id", *(F.size(c).cast("long").alias(c) for c in ("critical", "warning", "info")))


@query()
def page_summaries(spark, sf_dir):
    a = audit(spark, sf_dir)
    return reports.summary_report(a.scores, a.recommendations, reports.weaknesses(a.stats, a.metric_rows))


@query("SELECT page_id, CAST(count(*) AS BIGINT) AS items FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)) AS item FROM pages) WHERE trim(item) <> '' GROUP BY page_id")
def page_list_items(spark, sf_dir):
    return normalize.flatten_items(evidence.lists(audit(spark, sf_dir).nodes)).groupBy("page_id").agg(F.count("*").alias("items"))


# Constructed pages: what they hold is known from the columns that they are made of.


def product_pages(spark, sf_dir) -> DataFrame:
    """Pages of parts: a JSON-LD product, a table of facts, an image with or without alt."""
    p = table(spark, sf_dir, "part")
    ld = F.concat(F.lit('{"@context":"https://schema.org","@type":"Product","name":"'), F.col("p_name"), F.lit('"}'))
    rows = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 5 + 1), lambda i: F.concat(F.lit("<tr><td>row "), i.cast("string"), F.lit("</td><td>x"), i.cast("string"), F.lit("</td></tr>"))), "")
    img = F.when(F.col("p_partkey") % 3 == 0, '<img src="a.png">').otherwise(F.concat(F.lit('<img src="a.png" alt="'), F.col("p_name"), F.lit('">')))
    html = F.concat(F.lit('<html lang="en"><head><title>'), F.col("p_name"), F.lit('</title><script type="application/ld+json">'), ld, F.lit("</script></head><body><main><h1>"), F.col("p_name"), F.lit("</h1><h3>Facts</h3><table><tr><th>Name</th><th>Value</th></tr>"), rows, F.lit("</table>"), img, F.lit("<ul><li>Brand: "), F.col("p_brand"), F.lit("</li></ul></main></body></html>"))
    return p.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("https://shop.example/"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))


@query("SELECT p_partkey AS page_id, CAST(p_size % 5 + 2 AS INTEGER) AS table_rows, 'Name | Value' AS headers, 1 AS json_ld, 'Product' AS schema_type, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS with_alt, 1 AS skipped FROM part")
def product_page_evidence(spark, sf_dir):
    a = PageAudit(product_pages(spark, sf_dir))
    t = evidence.tables(a.nodes).select("page_id", F.col("meta")["rows"].cast("int").alias("table_rows"), F.col("meta")["headers"].alias("headers"))
    d = evidence.structured_data(a.nodes).where("type = 'json_ld'").groupBy("page_id").agg(F.count("*").cast("int").alias("json_ld"), F.min("value").alias("schema_type"))
    i = evidence.accessibility(a.nodes).groupBy("page_id").agg(F.sum(F.when(F.col("type") == "img_alt", 1).otherwise(0)).cast("int").alias("with_alt"))
    h = normalize.heading_issues(evidence.headings(a.nodes)).groupBy("page_id").agg(F.sum(F.col("skips").cast("int")).cast("int").alias("skipped"))
    return t.join(d, "page_id").join(i, "page_id").join(h, "page_id")


def supplier_pages(spark, sf_dir) -> DataFrame:
    """Pages of suppliers with noise, a sidebar of some domain, repeated paragraphs, and headings and links of every kind."""
    p, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    heading = F.element_at(F.array(*map(F.lit, ("Welcome to our home", "Tiny", "Terms", "Products of the year"))), (k % 4).cast("int") + 1)
    anchor = F.element_at(F.array(*map(F.lit, ("read more about it", "here", "Catalogue of goods"))), (k % 3).cast("int") + 1)
    text = F.concat(F.lit("This paragraph of "), F.col("s_name"), F.lit(" tells of its API and database, at some length."))
    paragraphs = F.array_join(F.array_repeat(F.concat(F.lit("<p>"), text, F.lit("</p>")), (k % 3).cast("int") + 1), "")
    aside = F.when(k % 2 == 0, '<div class="sidebar price">add to cart</div>').otherwise('<div class="sidebar faq">help and support</div>')
    html = F.concat(F.lit('<html lang="en"><head><title>'), F.col("s_name"), F.lit("</title></head><body><nav>"), F.col("s_name"), F.lit(" menu of pages</nav><main><h1>"), heading, F.lit("</h1>"), paragraphs, F.lit('<a href="/goods/'), k.cast("string"), F.lit('">'), anchor, F.lit("</a></main>"), aside, F.lit("<footer>"), F.col("s_name"), F.lit(" ends the page</footer></body></html>"))
    return p.select(k.alias("page_id"), F.concat(F.lit("https://made.example/"), k.cast("string")).alias("url"), html.alias("html"))


_MADE = """made AS (SELECT s_suppkey AS page_id, s_suppkey % 3 + 1 AS copies, s_suppkey % 2 AS odd, s_suppkey % 4 AS four, s_suppkey % 3 AS three,
    ['Welcome to our home', 'Tiny', 'Terms', 'Products of the year'][s_suppkey % 4 + 1] AS heading, ['read more about it', 'here', 'Catalogue of goods'][s_suppkey % 3 + 1] AS anchor,
    'This paragraph of ' || s_name || ' tells of its API and database, at some length.' AS p, CASE WHEN s_suppkey % 2 = 0 THEN 'add to cart' ELSE 'help and support' END AS aside, s_name AS name FROM supplier),
    sizes AS (SELECT *, length(heading) + copies * length(p) + length(anchor) AS main, 2 * length(name) + length(' menu of pages') + length(' ends the page') AS noise FROM made),
    shares AS (SELECT *, round(main / (main + noise + length(aside)), 4) AS density, round(noise / (main + noise + length(aside)), 4) AS share FROM sizes)"""
_REPEATS = "CASE copies WHEN 1 THEN 95.0 WHEN 2 THEN 80.0 ELSE 60.0 END"
_MADE_SCORE = _CLAMP.format(f"{_CLAMP.format('100 * density')} * 0.3 + {_CLAMP.format('100 * (1 - share)')} * 0.2 + 80.0 * 0.15 + {_REPEATS} * 0.15 + 60.0 * 0.2")


@query(f"WITH {_MADE} SELECT page_id, density, share AS noise, CASE WHEN copies > 1 THEN 1 ELSE 0 END::BIGINT AS repeated, 1::BIGINT AS regions, 1::BIGINT AS boilerplate, density >= 0.3 AND share < 0.7 AS extractable, {_MADE_SCORE} * CASE WHEN density >= 0.3 AND share < 0.7 THEN 1.0 ELSE 0.7 END AS score FROM shares")
def made_extractability(spark, sf_dir):
    """Density, noise, repeats, boilerplate and the extractability metric of made pages."""
    a = PageAudit(supplier_pages(spark, sf_dir))
    rows = evidence.extractability(a.nodes, a.flags, a.pages)
    scores = a.metric_rows.where("metric = 'extractability'").select("page_id", "score")
    return rows.join(scores, "page_id").select("page_id", "density", "noise", F.col("repeated").cast("long").alias("repeated"), F.col("regions").cast("long").alias("regions"), F.col("boilerplate").cast("long").alias("boilerplate"), "extractable", "score")


@query(
    f"""WITH {_MADE}, d AS (
    SELECT page_id, 'ecommerce' AS domain, CASE WHEN odd = 0 THEN 4.0 ELSE 0.0 END AS score FROM made UNION ALL
    SELECT page_id, 'support_page', CASE WHEN odd = 1 THEN 6.0 ELSE 0.0 END FROM made UNION ALL
    SELECT page_id, 'documentation', 1.0 FROM made UNION ALL
    SELECT page_id, 'product_page', CASE WHEN four = 3 THEN 1.0 ELSE 0.0 END FROM made)
    SELECT page_id, domain, score, least(score / 10, 1.0) AS confidence FROM d WHERE score > 0"""
)
def made_domains(spark, sf_dir):
    """Domains of made pages, by selectors and keywords."""
    a = PageAudit(supplier_pages(spark, sf_dir))
    return evidence.domain_profile(a.nodes, a.texts).select("page_id", F.col("value").alias("domain"), F.col("meta")["score"].cast("double").alias("score"), "confidence")


@query(
    f"""WITH {_MADE}
    SELECT page_id, 'semantic_headings' AS section, CASE four WHEN 2 THEN 'heading_plain' WHEN 3 THEN 'heading_clear' ELSE 'heading_ambiguous' END AS type, heading AS value, CASE four WHEN 3 THEN 0.9 ELSE 0.5 END AS confidence FROM made UNION ALL
    SELECT page_id, 'anchor_text', CASE three WHEN 2 THEN 'anchor_clear' ELSE 'anchor_ambiguous' END, anchor, CASE three WHEN 2 THEN 0.9 ELSE 0.4 END FROM made UNION ALL
    SELECT page_id, 'semantic_paragraphs', 'paragraph_clear', p, 0.85 FROM made, range(1, copies + 1) UNION ALL
    SELECT page_id, 'redundancy', 'redundant_content', lower(p), 0.5 + copies * 0.1 FROM made WHERE copies > 1 UNION ALL
    SELECT page_id, 'structured_content', 'faq_block', 'FAQ item', 0.85 FROM made WHERE odd = 1"""
)
def made_semantics(spark, sf_dir):
    """Classes of headings, anchors and paragraphs, repeats and content blocks of made pages."""
    a = PageAudit(supplier_pages(spark, sf_dir))
    n = a.nodes
    rows = evidence.semantic_headings(evidence.headings(n), n)
    for more in (evidence.anchor_text(evidence.links(n, a.pages), n), evidence.semantic_paragraphs(evidence.paragraphs(n)), evidence.redundancy(n, a.texts), evidence.structured_content(n)):
        rows = rows.unionByName(more)
    return rows.select("page_id", "section", "type", "value", F.round("confidence", 6).alias("confidence"))


@query(
    f"""WITH {_MADE} SELECT page_id, 'structure' AS metric, {_CLAMP.format("50.0 * 0.30 + 50.0 * 0.25 + 100.0 * 0.25 + 95.0 * 0.20")} AS score, 0.85 AS confidence FROM made UNION ALL
    SELECT page_id, 'accessibility', {_CLAMP.format("70.0 * 0.35 + 80.0 * 0.20 + 40.0 * 0.15 + 95.0 * 0.20 + 50.0 * 0.10")}, 0.82 FROM made UNION ALL
    SELECT page_id, 'semantic', {_CLAMP.format("70.0 * 0.30 + 60.0 * 0.25 + 60.0 * 0.20 + 45.0 * 0.25")}, 0.83 FROM made UNION ALL
    SELECT page_id, 'structuredData', NULL, NULL FROM made"""
)
def made_metrics(spark, sf_dir):
    """Metrics of made pages that follow from how they are made."""
    a = PageAudit(supplier_pages(spark, sf_dir))
    return a.metric_rows.where("metric in ('structure', 'accessibility', 'semantic', 'structuredData')").select("page_id", "metric", "score", "confidence")


#: Items of a made list by kind of list, what they are headed by, and the kind and confidence that follow; likewise tables.
_LISTS = [("dl", "dt", "Word of", "definitions", 0.85), ("ul", "li", "Refers to", "definitions", 0.85), ("ol", "li", "Good", "steps", 0.85), ("ul", "li", "Then do", "steps", 0.85), ("ul", "li", "Main benefit of", "features", 0.8), ("ul", "li", "One setting of", "attributes", 0.8), ("ul", "li", "Item by", "general", 0.6)]
_TABLES = [("Monthly", "k", 2, "pricing", 0.85), ("Versus", "b", 3, "comparison", 0.85), ("Versus", "b", 2, "key_value", 0.75), ("Weight", "kg", 1, "specifications", 0.8), ("Name", "k", 2, "key_value", 0.75), ("Name", "k", 1, "general", 0.65)]


def listed_pages(spark, sf_dir) -> DataFrame:
    """Pages of suppliers, each with a list within a list and a table in a cell of a table."""
    p, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    pick = lambda rows, i: F.element_at(F.array(*(F.lit(r[i]) for r in rows)), (k % len(rows)).cast("int") + 1)
    tag, item, head = (pick(_LISTS, i) for i in range(3))
    entry = lambda text: F.concat(F.lit("<"), item, F.lit(">"), text, F.lit("</"), item, F.lit(">"))
    listing = F.concat(F.lit("<"), tag, F.lit(">\n"), entry(F.concat(head, F.lit(" <b>"), F.lpad("s_name", 18, "x"), F.lit("</b>"))), F.lit(" \n "), entry(F.lit(" Another\n one ")), F.lit("</"), tag, F.lit(">"))
    name, cell, columns = (pick(_TABLES, i) for i in range(3))
    heads = F.concat(F.lit("<thead> <tr>"), F.array_join(F.array_repeat(F.concat(F.lit("<th>"), name, F.lit("</th>")), columns), ""), F.lit("</tr></thead>"))
    rows = F.array_join(F.array_repeat(F.concat(F.lit("<tr><td>"), cell, F.lit("</td></tr>")), 3), "\n")
    html = F.concat(F.lit("<!DOCTYPE html><title>t</title><ul><li>"), listing, F.lit("</ul><table><tr><td>"), F.lit("<table>"), heads, rows, F.lit("</table></table>"))
    return p.select(k.alias("page_id"), F.concat(F.lit("https://made.example/"), k.cast("string")).alias("url"), html.alias("html"))


def _value_sql(rows: list[tuple], key: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join([str(i)] + [repr(x) for x in row]) + ")" for i, row in enumerate(rows)) + f") AS {key}"


@query(
    f"""WITH l AS (SELECT s_suppkey AS page_id, tag, head || ' ' || lpad(s_name, 18, 'x') AS one, kind, confidence FROM supplier JOIN {_value_sql(_LISTS, 'v(i, tag, item, head, kind, confidence)')} ON i = s_suppkey % {len(_LISTS)}),
    t AS (SELECT s_suppkey AS page_id, name, n, kind, confidence FROM supplier JOIN {_value_sql(_TABLES, 'v(i, name, cell, n, kind, confidence)')} ON i = s_suppkey % {len(_TABLES)})
    SELECT page_id, 'semantic_' || tag AS type, one || ' | Another one' AS value, kind, confidence FROM l UNION ALL
    SELECT page_id, 'semantic_ul', one || ' Another one', CASE WHEN kind IN ('definitions', 'steps') AND one NOT LIKE 'Word of%' AND one NOT LIKE 'Good%' OR kind NOT IN ('definitions', 'steps') THEN kind ELSE 'general' END, CASE WHEN one LIKE 'Word of%' OR one LIKE 'Good%' THEN 0.6 ELSE confidence END FROM l UNION ALL
    SELECT page_id, 'semantic_table', '[' || kind || '] ' || array_to_string(list_transform(range(n), lambda j: name), ' | '), kind, confidence FROM t UNION ALL
    SELECT page_id, 'semantic_table', '[' || outer_kind || '] ' || array_to_string(list_transform(range(n), lambda j: name), ' | '), outer_kind, sure FROM (
        SELECT *, kind AS outer_kind, confidence AS sure FROM t)"""
)
def made_lists_and_tables(spark, sf_dir):
    """Classes of lists and tables within each other; a table's rows and headers are those of the tables in it too."""
    n = PageAudit(listed_pages(spark, sf_dir)).nodes
    rows = evidence.semantic_lists(n).unionByName(evidence.semantic_tables(n))
    return rows.select("page_id", "type", "value", F.col("meta")["class"].alias("kind"), "confidence")


#: Content blocks by kind, as SQL and Spark write them alike; @ is the supplier's name, # its key.
_BLOCK_PAGES = [
    '<div class="faq"><h3 class="faq-question">What is @?</h3><p>It is a firm .</p><p>More</p></div>',
    '<div class="pricing-card"><h4>Plan @</h4><b>$#.50</b> a month</div>',
    '<div class="product-specs"><dl><dt>Key of @</dt><dd>v</dd></dl><table><tr><td>A</td><td>#</td></tr></table></div>',
    '<div class="features-list"><ul><li>One of @</li><li> </li><li>Two !!</li></ul></div>',
    '<div class="review"><i class="stars">5 of 5</i> <b class="review-author">@</b> said so</div>',
    '<div class="qa">Ask @ !</div>',
    '<table><thead><tr><th>Plan</th><th>@</th><th>Other</th></tr></thead><tr><td>x</td></tr></table>',
]
#: Of each: type, value, rendered value, confidence, question, answer, price, plan, items, rating, author.
_BLOCK_FACTS = [
    ("faq_block", "What is @?", "Q: What is @?", 0.85, "What is @?", "It is a firm .", None, None, None, None, None),
    ("pricing_block", "Plan @$#.50 a month", "Plan @ — $#.50 — Plan @$#.50 a month", 0.9, None, None, "$#.50", "Plan @", None, None, None),
    ("specs_block", "Key of @ | A#", "Key of @ | A#", 0.85, None, None, None, None, "Key of @ | A#", None, None),
    ("feature_block", "One of @ | Two !!", "One of @ | Two!", 0.8, None, None, None, None, "One of @ | Two !!", None, None),
    ("review_block", "5 of 5 @ said so", "@ — 5 of 5 — 5 of 5 @ said so", 0.8, None, None, None, None, None, "5 of 5", "@"),
    ("qa_block", "Ask @ !", "Ask @!", 0.75, None, None, None, None, None, None, None),
    ("comparison_block", "plan ~ other", "Plan vs @ vs Other", 0.85, None, None, None, None, "Plan | @ | Other", None, None),
]


def block_pages(spark, sf_dir) -> DataFrame:
    p, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    body = F.element_at(F.array(*map(F.lit, _BLOCK_PAGES)), (k % len(_BLOCK_PAGES)).cast("int") + 1)
    html = F.concat(F.lit("<!DOCTYPE html><title>t</title><main>"), F.replace(F.replace(body, F.lit("@"), F.col("s_name")), F.lit("#."), F.concat(k.cast("string"), F.lit("."))), F.lit("</main>"))
    html = F.replace(html, F.lit("<td>#</td>"), F.concat(F.lit("<td>"), k.cast("string"), F.lit("</td>")))
    return p.select(k.alias("page_id"), F.lit(None).cast("string").alias("url"), html.alias("html"))


_FACT_NAMES = "type value rendered confidence question answer price plan items rating author".split()
_NAMED = lambda c: f"replace(replace(replace(replace({c}, '#', CAST(s_suppkey AS VARCHAR)), '@#', '@'), '@', s_name), '~', lower(s_name)) AS {c}"


@query(
    "SELECT s_suppkey AS page_id, type, confidence, "
    + ", ".join(_NAMED(c) for c in _FACT_NAMES if c not in ("type", "confidence"))
    + " FROM supplier JOIN (VALUES "
    + ", ".join("(" + ", ".join([str(i)] + ["CAST(NULL AS VARCHAR)" if x is None else repr(x) for x in row]) + ")" for i, row in enumerate(_BLOCK_FACTS))
    + f") AS f(i, {', '.join(_FACT_NAMES)}) ON i = s_suppkey % {len(_BLOCK_FACTS)}"
)
def made_blocks(spark, sf_dir):
    """Content blocks of all seven kinds, what is found in them, and their renderings."""
    found = blocks.structured_content(PageAudit(block_pages(spark, sf_dir)).nodes)
    shown = blocks.render_blocks(found).select("page_id", "pos", "type", F.col("value").alias("rendered"))
    meta = [F.col("meta")[c].alias(c) for c in _FACT_NAMES[4:]]
    return found.join(shown, ["page_id", "pos", "type"]).select("page_id", "type", "value", "rendered", "confidence", *meta)


def disputed_pages(spark, sf_dir) -> DataFrame:
    """Pages of suppliers on whose headings extractors agree (a third) or not; every tenth is blank."""
    p, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    heads = F.element_at(F.array(F.lit("<h2>One</h2><h2>Two</h2><h2>Three</h2><h2>Four</h2><h2>Five</h2>"), F.lit("<h1>Only one</h1>"), F.lit("<h2></h2><h2></h2><h2></h2><h2></h2>")), (k % 3).cast("int") + 1)
    text = F.concat(F.lit("<p>A text of "), F.col("s_name"), F.lit(" that is long enough to be one.</p><p>It goes on for another sentence, so that nothing is amiss.</p><p>The end.</p>"))
    html = F.concat(F.lit("<!DOCTYPE html><title>t</title><main>"), heads, text, F.lit("</main>"))
    return p.select(k.alias("page_id"), F.lit(None).cast("string").alias("url"), F.when(k % 10 != 9, html).otherwise("").alias("html"))


@query(
    """SELECT s_suppkey AS page_id, h AS headings, t AS tree_headings, s AS structure_signals, abs(h - t) <= 2 AND abs(h - s) <= 2 AS consistent,
        CASE WHEN abs(h - t) <= 2 AND abs(h - s) <= 2 THEN '' ELSE 'Heading count mismatch: extractor=' || h || ', hierarchy=' || t || ', semanticStructure=' || s END AS contradictions
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE [5, 1, 0][s_suppkey % 3 + 1] END::BIGINT AS h, CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE [5, 1, 4][s_suppkey % 3 + 1] END::BIGINT AS t, CASE WHEN s_suppkey % 10 = 9 THEN 0 ELSE 1 END::BIGINT AS s FROM supplier)"""
)
def made_consistency(spark, sf_dir):
    """Counts of headings by several extractors on made pages, and what they contradict each other in."""
    a = PageAudit(disputed_pages(spark, sf_dir))
    rows = reconcile.consistency(a.signals, a.flags)
    return rows.select("page_id", *(F.col(c).cast("long").alias(c) for c in ("headings", "tree_headings", "structure_signals")), "consistent", F.array_join("contradictions", ";").alias("contradictions"))


@query(
    """WITH p AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 9 THEN ['parser_error', 'dom_corruption', 'malformed_dom', 'script_only_dom'] ELSE []::VARCHAR[] END AS own,
        CASE s_suppkey % 5 WHEN 1 THEN ['rate_limited'] WHEN 3 THEN ['encoding_failure', 'fetch_failure'] ELSE []::VARCHAR[] END AS f,
        CASE s_suppkey % 4 WHEN 0 THEN ['hydration_shell'] WHEN 1 THEN ['partial', 'rendering_failed'] ELSE []::VARCHAR[] END AS r FROM supplier)
    SELECT k AS page_id, array_to_string(own || f || r, ',') AS flags, len(own || f || r) > 0 AS contaminated, (own || f || r)[1] AS type,
        array_to_string(list_transform(list_filter(f, lambda x: x <> 'fetch_failure'), lambda x: 'fetcher:' || x || ':warning:false') || list_transform(r, lambda x: 'evidence_layer:' || x || CASE WHEN x = 'partial' THEN ':warning:false' ELSE ':critical:true' END) || CASE WHEN k % 5 = 0 THEN ['fetcher:cors_proxy_fallback:info:false'] ELSE []::VARCHAR[] END, ',') AS records,
        CASE WHEN k % 4 = 0 THEN 'rendered' ELSE 'fetched' END AS source, CASE WHEN k % 5 = 3 THEN 'HTTP 500' WHEN k % 10 = 9 THEN 'Empty response from server' END AS error FROM p"""
)
def made_merge(spark, sf_dir):
    """Flags of pages, their fetches and their renderings, put together with where each comes from."""
    pages = disputed_pages(spark, sf_dir)
    k, flags = F.col("page_id"), lambda *names: F.array(*map(F.lit, names)).cast("array<string>")
    fetches = pages.where(k % 5 != 4).select("page_id", F.when(k % 5 == 0, flags("cors_proxy_used")).when(k % 5 == 1, flags("rate_limited")).when(k % 5 == 3, flags("cors_block", "encoding_failure", "fetch_failure")).otherwise(flags()).alias("fetch_flags"), F.when(k % 5 == 0, "p1").alias("proxy"), F.when(k % 5 == 3, "HTTP 500").alias("fetch_error"))
    renders = pages.where(k % 4 < 2).select("page_id", (k % 4 == 0).alias("rendered"), F.when(k % 4 == 0, flags("hydration_shell")).otherwise(flags("partial", "rendering_failed")).alias("render_flags"), F.lit(None).cast("string").alias("render_error"))
    merged = reconcile.merge_evidence(PageAudit(pages).flags, fetches, renders)
    record = lambda r: F.concat_ws(":", r["source"], r["type"], r["severity"], r["blocks"].cast("string"))
    return merged.select("page_id", F.array_join("flags", ",").alias("flags"), "contaminated", "type", F.array_join(F.transform("records", record), ",").alias("records"), "source", "error")


def supplier_cases(spark, sf_dir) -> DataFrame:
    p = supplier_pages(spark, sf_dir)
    return p.select(F.col("page_id").cast("string").alias("id"), F.concat(F.lit("kind_"), (F.col("page_id") % 4).cast("string")).alias("category"), "url", F.when(F.col("page_id") % 11 != 5, F.col("html")).alias("snapshot_html"))


@query("SELECT 'kind_' || (s_suppkey % 4) AS category, CASE WHEN s_suppkey % 11 = 5 THEN 'error' ELSE 'ok' END AS status, count(*) AS cases, CAST(sum(CASE WHEN s_suppkey % 11 = 5 THEN 0 ELSE 1 END) AS BIGINT) AS scored FROM supplier GROUP BY ALL")
def case_run(spark, sf_dir):
    """Audits of stored pages as results of a corpus run."""
    return run_cases(supplier_cases(spark, sf_dir)).groupBy("category", "status").agg(F.count("*").alias("cases"), F.count("final_score").alias("scored"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS case_id, CASE WHEN s_suppkey % 11 = 5 THEN false ELSE true END AS lower_score FROM supplier WHERE s_suppkey % 7 = 0 AND s_suppkey % 11 <> 5")
def case_regression(spark, sf_dir):
    """Drift of audited pages against a baseline of the same pages: those that have lost their main landmark, and no others."""
    cases = supplier_cases(spark, sf_dir)
    base = run_cases(cases)
    changed = F.replace(F.replace("snapshot_html", F.lit("<main>"), F.lit("<div>")), F.lit("</main>"), F.lit("</div>"))
    now = run_cases(cases.withColumn("snapshot_html", F.when(F.col("id").cast("long") % 7 == 0, changed).otherwise(F.col("snapshot_html"))))
    drifts = benchmark.drift(now, benchmark.create_baseline(base, "made"))
    return drifts.groupBy("case_id").agg(F.max((F.col("type") == "score") & (F.col("delta") < 0)).alias("lower_score"))


_SCORED = """s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'insufficient_evidence' WHEN 2 THEN 'scored_absence_evidence' ELSE 'scored' END AS status,
    CASE WHEN doc_id % 4 = 0 THEN 'hydration_shell' WHEN doc_id % 5 = 0 THEN 'shadow_dom' END AS kind, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 12 ELSE n_chars % 3 END AS lacking FROM documents)"""


@query(
    f"""WITH {_SCORED} SELECT doc_id AS page_id, array_to_string(list_filter([
        CASE WHEN status = 'blocked' THEN 'Scoring BLOCKED due to contamination: ' || kind || '. All metric calculators were skipped. finalScore=null, confidence=null.' END,
        CASE WHEN status = 'insufficient_evidence' THEN 'Pipeline result: insufficient evidence — final score is null' END,
        CASE WHEN status = 'scored_absence_evidence' THEN 'Pipeline result: absence evidence dominance — final score set to 0' END,
        CASE WHEN kind IS NOT NULL AND status LIKE 'scored%' THEN 'Pipeline warning: contamination (' || kind || ') affected scoring confidence' END,
        CASE WHEN lacking > 0 THEN 'Pipeline warning: ' || lacking || ' metric(s) had insufficient evidence' END], lambda x: x IS NOT NULL), '; ') AS warnings,
        status = 'blocked' AS skipped, CASE WHEN status = 'blocked' THEN 'Scoring blocked due to contamination: hydration_shell' END AS skip_reason, lacking::BIGINT AS missing FROM s"""
)
def score_diagnostics(spark, sf_dir):
    """Warnings of the pipeline about results of every status, with metrics that have no evidence."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    status = F.element_at(F.array(*map(F.lit, ("blocked", "insufficient_evidence", "scored_absence_evidence", "scored"))), (i % 4).cast("int") + 1)
    lacking = F.when(i % 4 == 0, 0).when(i % 4 == 1, 12).otherwise(F.col("n_chars") % 3)
    rows = d.select(i.alias("page_id"), status.alias("status"), F.when(i % 4 == 0, "hydration_shell").when(i % 5 == 0, "shadow_dom").alias("contamination_type"), F.array(F.lit("h1")).alias("absent"), lacking.alias("lacking"))
    named = rows.where("status <> 'blocked'").select("page_id", "lacking", F.posexplode(F.array(*map(F.lit, WEIGHTS))).alias("place", "metric"))
    metric_rows = named.select("page_id", "metric", F.when(F.col("place") >= F.col("lacking"), 50.0).alias("score"))
    found = diagnostics.scoring_diagnostics(rows, metric_rows)
    said = diagnostics.report_diagnostics(rows, found).join(found, "page_id")
    return said.select("page_id", F.array_join("warnings", "; ").alias("warnings"), "skipped", "skip_reason", F.size("missing").cast("long").alias("missing"))


# ---- corpora, baselines and drift ----------------------------------------------------------------------------


def cases(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("category"), F.concat(F.lit("https://example.com/"), F.col("source"), F.lit("/"), (F.col("doc_id") % 900).cast("string")).alias("url"), F.array("source", "lang").alias("tags"), F.col("source").alias("expected_type"))


_CASES = "cases AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang AS category, 'https://example.com/' || source || '/' || (doc_id % 900) AS url, source, doc_id FROM documents)"
_FNV = "lower(lpad(printf('%x', list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296)), 8, '0'))"


@query(f"WITH {_CASES} SELECT id, category, " + _FNV.format("id || '|' || category || '|' || url || '|0|' || source || '|' || source || ',' || category") + " AS case_hash FROM cases")
def corpus_case_hashes(spark, sf_dir):
    return benchmark.case_hashes(cases(spark, sf_dir))


@query()
def corpus_hash(spark, sf_dir):
    return benchmark.corpus_hash(cases(spark, sf_dir))


_LINES = "id || '|' || category || '|' || url || '|0|' || source || '|' || source || ',' || category"


@query(f"WITH {_CASES}, t AS (SELECT string_agg({_LINES}, chr(10) ORDER BY category, id) AS x, count(*) AS n FROM cases) SELECT {_FNV.format('x')} AS corpus_hash, n AS cases FROM t")
def corpus_fingerprint(spark, sf_dir):
    """One hash over all cases' lines in order."""
    return benchmark.corpus_fingerprint(cases(spark, sf_dir))


@query(
    """WITH c AS (SELECT s_suppkey, 'kind_' || (s_suppkey % 4) AS category, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS corpus, s_suppkey % 11 = 5 AS failed FROM supplier),
    v AS (SELECT *, 1 AS version FROM c UNION ALL SELECT *, 2 FROM c WHERE corpus = 'odd')
    SELECT corpus AS corpus_hash, version, version = max(version) OVER (PARTITION BY corpus) AS latest, category, count(*) AS cases, count(*) FILTER (WHERE NOT failed) AS ok, count(*) FILTER (WHERE failed AND version = 1 OR NOT failed AND version = 2 AND s_suppkey % 3 = 0) AS moved FROM v GROUP BY corpus, version, category"""
)
def stored_baselines(spark, sf_dir):
    """Two corpora of stored pages in one folder, one of them stored twice: all versions, read back.

    moved: cases that failed in the first version, or whose score the second version has changed.
    """
    runs = run_cases(supplier_cases(spark, sf_dir))
    path, rows = f"{shared_dir(spark)}/baselines-{uuid.uuid4().hex}", None
    of = {"even": runs.where("cast(case_id AS long) % 2 = 0"), "odd": runs.where("cast(case_id AS long) % 2 = 1")}
    for name, own in of.items():
        benchmark.store_baseline(benchmark.create_baseline(own.withColumn("second", F.lit(False)), name), path, name)
    again = F.coalesce((F.col("case_id").cast("long") % 3 == 0) & F.col("final_score").isNotNull(), F.lit(False))
    benchmark.store_baseline(benchmark.create_baseline(of["odd"].withColumn("second", again), "odd"), path, "odd")
    for name, version, latest in (("even", 1, True), ("odd", 1, False), ("odd", 2, True)):
        found = benchmark.load_baseline(spark, path, name, None if latest else version)
        found = found.select("corpus_hash", F.lit(version).alias("version"), F.lit(latest).alias("latest"), "category", "status", "second")
        rows = found if rows is None else rows.union(found)
    moved = ((F.col("version") == 1) & (F.col("status") == "error")) | F.col("second")
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("corpus_hash", "version", "latest", "category").agg(F.count("*").alias("cases"), n(F.col("status") == "ok").alias("ok"), n(moved).alias("moved"))


@query(f"WITH {_CASES} SELECT url, count(*) AS n FROM cases GROUP BY url HAVING count(*) > 1")
def corpus_duplicate_urls(spark, sf_dir):
    return benchmark.duplicates(cases(spark, sf_dir), "url")


@query("SELECT CAST(page_id AS VARCHAR) AS page_id, 'error' AS level, CASE WHEN page_id % 5 = 0 THEN 'Empty category' ELSE 'Invalid URL' END AS problem FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0 AND page_id % 5 <> 0 UNION ALL SELECT CAST(page_id AS VARCHAR), 'error', 'Invalid URL' FROM pages WHERE page_id % 35 = 0")
def corpus_csv_problems(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    rows = p.select(F.col("page_id").cast("string").alias("Page_ID"), F.when(F.col("page_id") % 5 == 0, " ").otherwise("web").alias("category"), F.when(F.col("page_id") % 7 == 0, "ftp:/x").otherwise(F.concat(F.lit("https://e.com/"), F.col("page_id").cast("string"))).alias("url"))
    return corpus.validate_csv(rows)


def results(spark, sf_dir, which: str) -> DataFrame:
    """Two runs over documents: the later one misses some cases, has new ones, errors and moved scores."""
    d = table(spark, sf_dir, "documents")
    now = which == "current"
    i = F.col("doc_id")
    score = (F.col("n_chars") % 1000) / 10.0 + (F.when(i % 7 == 0, 0.51).when(i % 7 == 1, 0.5).otherwise(0.0) if now else F.lit(0.0))
    metric = (i * 7 % 100).cast("double") + (F.when(i % 17 == 0, 3.0).otherwise(0.0) if now else F.lit(0.0))
    values = F.create_map(*(x for m in WEIGHTS for x in (F.lit(m), metric if m == "extractability" else F.lit(50.0))))
    rows = d.where(i % (11 if now else 13) != 0)
    return rows.select(
        i.cast("string").alias("case_id"),
        F.col("lang").alias("category"),
        F.when(i % (19 if now else 23) == 0, "error").otherwise("ok").alias("status"),
        score.alias("final_score"),
        F.lit(0.8).alias("confidence"),
        values.alias("metrics"),
        F.array(*([F.lit("a")] + ([F.when(i % 29 == 0, "b").otherwise("c")] if now else [F.lit("c")]))).alias("recommendations"),
        F.array(F.lit("main_landmark")).alias("absence"),
        F.when(i % 31 == 0, "shadow_dom").alias("contamination_type") if now else F.lit(None).cast("string").alias("contamination_type"),
        (F.col("n_chars") % 977).cast("double").alias("runtime_ms"),
    )


_RUNS = """cur AS (SELECT doc_id, lang, CASE WHEN doc_id % 19 = 0 THEN 'error' ELSE 'ok' END AS status, (n_chars % 1000) / 10.0::DOUBLE + CASE WHEN doc_id % 7 = 0 THEN 0.51 WHEN doc_id % 7 = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score, n_chars FROM documents WHERE doc_id % 11 <> 0),
    base AS (SELECT doc_id, lang, CASE WHEN doc_id % 23 = 0 THEN 'error' ELSE 'ok' END AS status, (n_chars % 1000) / 10.0::DOUBLE AS score FROM documents WHERE doc_id % 13 <> 0),
    j AS (SELECT coalesce(c.doc_id, b.doc_id) AS id, coalesce(c.lang, b.lang) AS category, c.doc_id AS ci, b.doc_id AS bi, c.status AS cs, b.status AS bs, c.score AS c1, b.score AS b1 FROM cur c FULL JOIN base b ON c.doc_id = b.doc_id),
    drifts AS (
        SELECT id, category, 'schema' AS type, CAST(NULL AS VARCHAR) AS metric FROM j WHERE ci IS NULL OR bi IS NULL OR cs <> bs
        UNION ALL SELECT id, category, 'score', NULL FROM j WHERE cs = 'ok' AND bs = 'ok' AND abs(c1 - b1) > 0.5
        UNION ALL SELECT id, category, 'metric', 'extractability' FROM j WHERE cs = 'ok' AND bs = 'ok' AND id % 17 = 0
        UNION ALL SELECT id, category, 'recommendation', NULL FROM j WHERE cs = 'ok' AND bs = 'ok' AND id % 29 = 0
        UNION ALL SELECT id, category, 'contamination', NULL FROM j WHERE cs = 'ok' AND bs = 'ok' AND id % 31 = 0)"""


def drifts(spark, sf_dir) -> DataFrame:
    return benchmark.drift(results(spark, sf_dir, "current"), results(spark, sf_dir, "baseline"))


@query(f"WITH {_RUNS} SELECT CAST(id AS VARCHAR) AS case_id, category, type, metric FROM drifts")
def regression_drifts(spark, sf_dir):
    return drifts(spark, sf_dir).select("case_id", "category", "type", "metric")


@query(f"WITH {_RUNS} SELECT type, count(*) AS records, count(DISTINCT id) AS cases FROM drifts GROUP BY type")
def regression_by_type(spark, sf_dir):
    return benchmark.drift_by(drifts(spark, sf_dir), "type")


@query(f"WITH {_RUNS}, k AS (SELECT category, count(*) AS cases, count(*) FILTER (WHERE id IN (SELECT id FROM drifts)) AS drifted FROM j WHERE ci IS NOT NULL AND bi IS NOT NULL GROUP BY category) SELECT category, cases, drifted, drifted / cases >= 0.05 AS drifts FROM k")
def regression_categories(spark, sf_dir):
    return benchmark.category_verdicts(results(spark, sf_dir, "current"), results(spark, sf_dir, "baseline"), drifts(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT 'schema' AS reason, true AS drifted, (SELECT count(DISTINCT id) FROM drifts) AS moved, (SELECT count(DISTINCT id) FROM drifts WHERE type = 'schema') AS schema_drifts, (SELECT count(*) FROM cur) AS cases")
def regression_verdict(spark, sf_dir):
    d = drifts(spark, sf_dir)
    return benchmark.corpus_verdict(results(spark, sf_dir, "current"), results(spark, sf_dir, "baseline"), d).select("reason", "drifted", "moved", "schema_drifts", "cases")


@query(f"WITH {_RUNS} SELECT lang AS category, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS passed, count(*) FILTER (WHERE status <> 'ok') AS failed, round(median(score), 6) AS median_score FROM cur GROUP BY ROLLUP (lang)")
def run_summary(spark, sf_dir):
    return benchmark.run_summary(results(spark, sf_dir, "current")).select("category", "total", "passed", "failed", F.round("median_score", 6).alias("median_score"))


@query("WITH r AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, CAST(n_chars % 977 AS DOUBLE) AS ms FROM documents WHERE doc_id % 11 <> 0) SELECT avg(ms) AS mean_ms, median(ms) AS median_ms, (SELECT case_id FROM r ORDER BY ms DESC, case_id LIMIT 1) AS slowest, (SELECT case_id FROM r ORDER BY ms, case_id LIMIT 1) AS fastest FROM r")
def run_runtimes(spark, sf_dir):
    return benchmark.runtime_stats(results(spark, sf_dir, "current"))


@query(f"WITH {_RUNS} SELECT CAST(doc_id AS VARCHAR) AS case_id, status, score AS final_score, 'h1' AS corpus_hash FROM base")
def baseline_round_trip(spark, sf_dir):
    """A baseline as JSON lines and back."""
    made = benchmark.create_baseline(results(spark, sf_dir, "baseline"), "h1")
    back = benchmark.deserialize_baseline(benchmark.serialize_baseline(made), made.schema)
    return back.where("problem is null").select("case_id", "status", "final_score", "corpus_hash")
