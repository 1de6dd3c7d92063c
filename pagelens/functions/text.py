"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that were UTF-8 and read as Latin-1, and punctuation variants.
MOJIBAKE = {"Ã¢": "â", "Ã©": "é", "Ã¨": "è", "Ãª": "ê", "Ã«": "ë", "Ã ": "à", "Ã¡": "á", "Ã­": "í", "Ã³": "ó", "Ã¶": "ö", "Ãº": "ú", "Ã¼": "ü", "Ã±": "ñ"}
QUOTES = {"‘": "'", "’": "'", "“": '"', "”": '"', " ": " ", "«": '"', "»": '"', "''": '"', "``": '"', "′": "'", "″": '"'}

#: White space, control and zero-width characters as regular expression classes that mean the same in every engine.
SPACE = r"[ \t\n\r\f\x0B   -     　﻿]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F​-‏‪-‮⁠﻿]"
#: A word boundary of ASCII word characters only, which \w stands for; written as ranges, in a negated class above all, they take many times as long.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: A word of a lower-case text: EDGE before a letter is one of ASCII after no word character, or another one after a word character.
WORD = rf"(?:(?<!\w)(?=[a-z])|(?<=\w)(?=[À-ſ]))[a-zÀ-ſ]+(?:['-][a-zÀ-ſ]+)*{EDGE}"
SENTENCE_BREAK = r"\s(?<=[.!?]\s)\s*(?=[A-ZÀ-ſ])"
VAGUE_WORDS = ["thing", "things", "stuff", "something", "anything", "everything", "various", "some", "many", "few", "several", "certain", "it", "they", "them", "this", "that", "these", "those"]

ODD_MARKS = "[" + "".join(sorted({c for q in QUOTES for c in q})) + "]"
#: What a text has if control characters, odd blanks, marks or letters are to be replaced in it; strings are looked for faster than classes.
#: ODD is all white space but blanks and \xa0, and more.
ODD = r"[^ -\u167F]"
RARE, RARE_STRINGS = r"[^ -\u167F\t\n\r]", ["\x7f", "Ã", "!!", "??", *sorted(q for q in QUOTES if max(q) < "\u1680" and q != "\xa0")]
PLAIN_SPACE = "\t\n\r\f\x0b\xa0"

# Schema.org type names.
SCHEMA_TYPES = ["Article", "NewsArticle", "BlogPosting", "Product", "Offer", "Organization", "LocalBusiness", "Person", "WebSite", "WebPage", "FAQPage", "HowTo", "Recipe", "Event", "Review", "AggregateRating", "BreadcrumbList", "ItemList", "ImageObject", "SoftwareApplication", "Course", "JobPosting", "QAPage", "Place"]


def replace_all(col: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def collapse_space(col: Column) -> Column:
    """Runs of white space as one blank, none at the ends; col is looked at several times, and had better be a column than an expression."""
    collapsed = F.regexp_replace(col, f"{SPACE}(?:(?<= ){SPACE}++|(?<! ){SPACE}*+)", " ")  # single blanks, most of all, are not matched
    return F.trim(F.when(reduce(lambda x, y: x | y, [F.contains(col, F.lit(x)) for x in ("  ", "\xa0")], col.rlike(ODD)), collapsed).otherwise(col))


def normalize_text(col: Column, case: str = "none") -> Column:
    """Text without control characters, with usual quotes, single marks and one blank after punctuation before a letter."""
    raw = col
    col = F.regexp_replace(col, CONTROL, "")
    col = F.when(F.contains(raw, F.lit("Ã")), replace_all(col, MOJIBAKE)).otherwise(col)
    col = F.when(raw.rlike(ODD_MARKS), replace_all(col, QUOTES)).otherwise(col)
    col = F.regexp_replace(F.regexp_replace(col, r"([!?])\1+", "$1"), SPACE, " ")
    rare = reduce(lambda x, y: x | y, [F.contains(raw, F.lit(x)) for x in RARE_STRINGS], raw.rlike(RARE))
    marks = {f" {mark}": mark for mark in ",.!?;:"}
    spaced = lambda c: replace_all(F.regexp_replace(replace_all(c, dict.fromkeys(PLAIN_SPACE, " ")), " {2,}", " "), marks)
    blanks = reduce(lambda x, y: x | y, [F.contains(raw, F.lit(x)) for x in PLAIN_SPACE], raw.rlike(" [ ,.!?;:]"))
    col = F.when(rare, spaced(col)).when(blanks, spaced(raw)).otherwise(raw)  # most texts have nothing of all that
    col = F.regexp_replace(col, r"([,.!?;:])(?=[A-Za-z])", "$1 ")
    if case == "lower":
        col = F.lower(col)
    elif case == "title":
        col = F.initcap(col)
    elif case == "sentence":
        parts = F.split(F.lower(col), r"(?<=[.!?])(?= )")
        col = F.array_join(F.transform(parts, lambda p: F.concat(F.regexp_extract(p, r"^(\s*)", 1), F.upper(F.substring(F.ltrim(p), 1, 1)), F.substring(F.ltrim(p), 2, 1 << 30))), "")
    return F.trim(col)


def sentences(col: Column) -> Column:
    """Sentences of a text: cut after . ! ? where a capital follows."""
    return sentences_of_normal(normalize_text(col))


def sentences_of_normal(col: Column) -> Column:
    """sentences of a text that is normalised already."""
    parts = F.transform(F.split(col, SENTENCE_BREAK), lambda x: F.trim(x))
    return F.coalesce(F.filter(parts, lambda s: s != ""), F.array().cast("array<string>"))


def words(col: Column) -> Column:
    """Lower-case words, with inner apostrophes and hyphens."""
    return words_of_normal(normalize_text(col))


def words_of_normal(col: Column) -> Column:
    """words of a text that is normalised already."""
    return F.coalesce(F.regexp_extract_all(F.lower(col), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def comparison_key(col: Column) -> Column:
    """Key by which values count as equal: lower case, no marks, single blanks; empty where nothing of ASCII is left."""
    return key_of_normal(normalize_text(col))


def key_of_normal(col: Column) -> Column:
    """comparison_key of a text that is normalised already."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col), r"[^\w -]+", ""), " {2,}", " "))


def has_key(col: Column) -> Column:
    """Whether a text's comparison_key is not empty: it has a character that stays, or one whose lower case has such.

    Told from the text as it is, so that a filter by it, wherever it is pushed, normalises nothing.
    """
    return col.rlike("[A-Za-z0-9_\u0130\u212A-]")


def join_fragments(fragments: Column) -> Column:
    return F.array_join(F.filter(F.transform(fragments, lambda x: normalize_text(x)), lambda x: x != ""), " ")


def truncate(col: Column, n: int) -> Column:
    return F.when(F.length(col) <= n, col).otherwise(F.concat(F.rtrim(F.substring(col, 1, n)), F.lit("…")))


def escape_html(col: Column) -> Column:
    return replace_all(col, {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;", "\n": "<br>"})


def url_host(col: Column) -> Column:
    return F.lower(F.regexp_extract(col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def is_valid_url(col: Column) -> Column:
    return F.coalesce(col.rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def canonical_schema_type(col: Column) -> Column:
    """A schema.org type's usual name; others stay as they are."""
    bare = F.regexp_replace(F.trim(col), r"(?i)^https?://schema\.org/", "")
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for t in SCHEMA_TYPES for x in (t.lower(), t))), F.lower(bare)), bare)


def classify_link(text: Column, href: Column) -> Column:
    """navigational, promotional, informational or contextual; the first that applies."""
    t, h = F.lower(F.trim(text)), F.lower(href)
    return (
        F.when(t.isin("home", "about", "contact", "menu", "login", "sign in", "register", "back", "next", "previous") | h.startswith("#"), "navigational")
        .when(t.rlike("buy|shop|order|subscribe|sign up|get started|try|download|free|deal|offer"), "promotional")
        .when(t.rlike("learn|read|more|guide|docs|documentation|how|what|why|article|blog"), "informational")
        .otherwise("contextual")
    )


def fnv1a(col: Column) -> Column:
    """32-bit FNV-1a over code points, as eight hex digits."""
    codes = F.transform(F.split(col, ""), lambda c: F.ascii(c).cast("long"))
    return F.lower(F.lpad(F.hex(F.aggregate(F.filter(codes, lambda c: c > 0), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)) % F.lit(4294967296))), 8, "0"))


def text_numbers(rows: DataFrame) -> DataFrame:
    """rows with what the text metrics count in sentence_list and word_list, each counted once."""
    sizes = F.transform("sentence_list", lambda s: F.size(F.split(F.trim(s), r"\s+")))
    many = lambda array, test: F.size(F.filter(array, test))
    rows = rows.withColumn("sentence_sizes", sizes)
    return rows.withColumns(
        {
            "n_sentences": F.size("sentence_list"),
            "n_words": F.size("word_list"),
            "good_sentences": many("sentence_sizes", lambda x: (x >= 8) & (x <= 25)),
            "long_sentences": many("sentence_sizes", lambda x: x > 40),
            "letters": F.length(F.array_join("word_list", "")),
            "rare_words": many("word_list", lambda w: F.length(w) > 10),
            "vague_words": many("word_list", lambda w: w.isin(VAGUE_WORDS)),
        }
    ).drop("sentence_sizes")
