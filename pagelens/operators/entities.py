"""Entities in text: patterns by kind, distinct values, and their summary."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions import text as T

# Patterns, confidence and limits of the entity kinds.
MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
COUNTRIES = "United States|USA|UK|United Kingdom|Canada|Australia|Germany|France|Japan|China|India|Brazil|Spain|Italy|Netherlands|Sweden|Norway|Denmark|Finland|Singapore|Switzerland|Austria|Belgium|Ireland|Portugal|Greece|Mexico|Argentina|South Africa|New Zealand|South Korea|Turkey|Russia|Poland|Czech Republic|Hungary|Romania|Bulgaria|Croatia|Slovakia|Slovenia|Lithuania|Latvia|Estonia"
CITIES = r"New York|Los Angeles|San Francisco|London|Paris|Berlin|Tokyo|Sydney|Toronto|Amsterdam|Stockholm|Singapore|Hong Kong|Dubai|Chicago|Boston|Seattle|Miami|Atlanta|Dallas|Houston|Denver|Phoenix|Portland|San Diego|Minneapolis|Detroit|Philadelphia|Washington|Las Vegas|Nashville|Memphis|Austin|San Antonio|Fort Worth|Baltimore|Charlotte|Orlando|Tampa|Pittsburgh|Cincinnati|Cleveland|St\. Louis|Kansas City|Milwaukee|Sacramento|Oakland|San Jose|Boulder|Aspen|Napa|Sonoma|Santa Barbara|Monterey|Carmel|Pebble Beach|Catalina|Santa Monica|Malibu|Beverly Hills|Hollywood|Burbank|Glendale|Pasadena|Anaheim|Long Beach|Irvine"
STATE_CODES = "AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC"
STATES = "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|Virginia|Washington|West Virginia|Wisconsin|Wyoming"
STREET = r"\d{1,5}\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+"
KINDS = [
    ("organization", 0.80, [r"\b(?:Inc|LLC|Ltd|Corp|Corporation|Company|Co|GmbH|S\.A\.|N\.V\.|BV|AG|Pty|PLC)\b", r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\s+(?:Inc|LLC|Ltd|Corp|Corporation|Company)\b"]),
    ("date", 0.90, [rf"\b{MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{4}-\d{2}-\d{2}\b", rf"\b\d{{1,2}}\s+{MONTH}\s+\d{{4}}\b", r"\b(?:20\d{2})\b"]),
    ("quantity", 0.85, [r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:kg|g|lb|oz|cm|mm|m|ft|in|km|mi|MB|GB|TB|KB|bytes?|Hz|MHz|GHz|W|kW|hp|°C|°F)\b", r"(?i)\b\d+(?:,\d{3})*\s*(?:people|users|customers|items|products|articles|posts|rooms|suites|guests|nights|days)\b", r"(?i)\b\d+\s*(?:min(?:utes)?|hours?|hrs?|seconds?|secs?)\b"]),
    ("money", 0.90, [r"\$\d+(?:,\d{3})*(?:\.\d{2})?", r"€\d+(?:,\d{3})*(?:\.\d{2})?", r"£\d+(?:,\d{3})*(?:\.\d{2})?", r"\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:USD|EUR|GBP|JPY|CAD|AUD)\b", r"(?i)\b\d+(?:,\d{3})*(?:\.\d+)?\s*(?:per\s+night|/night|nightly|per\s+day|daily)\b"]),
    ("product", 0.75, [r"\b(?:iPhone|iPad|MacBook|iMac|AirPods|Galaxy|Pixel|Surface|ThinkPad|Dell|HP|Lenovo)\b", r"\b[A-Z][a-zA-Z]+\s+(?:Pro|Max|Mini|Ultra|Plus|Lite|Air|X|S)\b"]),
    ("location", 0.80, [rf"\b(?:{COUNTRIES})\b", rf"\b(?:{CITIES})\b", rf"\b(?:{STATE_CODES})\b", rf"\b(?:{STATES})\b"]),
    ("phone", 0.85, [r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", r"\b\+?\d{1,3}[-.\s]?\d{1,4}[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b"]),
    ("email", 0.95, [r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"]),
    ("address", 0.80, [rf"\b{STREET}(?:Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Lane|Ln|Road|Rd|Court|Ct|Place|Pl|Way|Circle|Cir|Trail|Trl|Parkway|Pkwy|Highway|Hwy)\b", rf"\b{STREET}(?:Street|Avenue|Boulevard|Drive|Lane|Road|Court|Place|Way|Circle)\s+(?:North|South|East|West|N|S|E|W)\b"]),
    ("social", 0.70, [r"@[a-zA-Z0-9_]{3,30}"]),
    ("url", 0.90, [r"https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?:/[^\s]*)?"]),
    ("person", 0.70, [r"\b(?:by|author|written by|posted by|created by|chef|designer|architect|owner|founder|director|manager)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})\b"]),
]
#: Characters after which a kind's values are cut and end in an ellipsis.
MOST = {"organization": 100, "product": 100, "url": 200}


#: What a pattern's first character is one of, by the pattern's beginning; and what a text must contain for it to be found.
AHEAD = [(r"\b(?:Jan", "(?=[JFMASOND])"), (r"\b(?:20", "(?=2)"), (r"\b(?:iPhone", "(?=[A-Zi])"), (r"\b\(?", "(?=[(0-9])"), (r"\b\+?", "(?=[+0-9])"), (r"\b(?:by|", "(?=[a-z])")]
NEEDED = [(r"\b[a-zA-Z0-9._%+-]+@", "@"), ("@", "@"), (r"\$", "$"), ("€", "€"), ("£", "£"), ("http", "http")]
#: Kinds all of whose values have a digit.
NUMERIC = ("date", "quantity", "money", "phone", "address")
#: One of these stands before a person.
TITLES = ["by", "author", "chef", "designer", "architect", "owner", "founder", "director", "manager"]


def find_all(text: Column, pattern: str, kind: str) -> Column:
    """All that a pattern finds; a text without a string that all of it must contain is not searched."""
    found = F.regexp_extract_all(text, F.lit(bounded(pattern, kind)), F.lit(int(kind == "person")))
    needed = next((mark for start, mark in NEEDED if pattern.startswith(start)), None)
    return found if needed is None else F.when(F.contains(text, F.lit(needed)), found).otherwise(F.array().cast("array<string>"))


def bounded(pattern: str, kind: str) -> str:
    r"""The pattern with \b of ASCII words; where a word character is sure to stand at the edge, one look suffices."""
    sure = not pattern.startswith((r"\b\(?", r"\b\+?", r"\b[a-zA-Z0-9._%+-]"))
    start = r"(?<!\w)" if sure else T.EDGE
    end = T.EDGE if r"S\.A\." in pattern else r"(?!\w)"
    out, mode = pattern, ""
    if out.startswith("(?i)"):
        out, mode = out[4:], "(?i)"
    if out.startswith(r"\b"):
        first = re.match(r"\\b(\\d|\[A-Z\])", out)
        ahead = "(?=[A-Z])" if kind in ("organization", "location") or first and first[1] == "[A-Z]" else "(?=[0-9])" if first else next((a for p, a in AHEAD if out.startswith(p)), "")
        out = ahead + start + out[2:]  # a look at the next character rules most places out
    if out.endswith(r"\b"):
        out = out[:-2] + end
    return mode + out


def values_of(kind: str, text: Column) -> Column:
    """Distinct values of a kind, in the order its patterns find them; long ones are cut after that, none is dropped."""
    patterns = next(p for k, _, p in KINDS if k == kind)
    found = F.flatten(F.array(*(find_all(text, p, kind) for p in patterns)))
    found = F.array_distinct(F.transform(found, T.collapse_space) if kind == "person" else F.transform(found, lambda x: F.trim(x)))
    if kind == "phone":
        return F.filter(found, lambda v: F.length(v) >= 10)
    if kind == "social":
        return F.filter(found, lambda v: ~F.contains(text, F.concat(v, F.lit("."))))
    return F.transform(found, lambda v: T.truncate(v, MOST[kind])) if kind in MOST else found


def extract_entities(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Entity signals (id, section, pos, type, value, confidence): kinds in their order, values as found."""

    def signals(kind: str, confidence: float) -> Column:
        values = values_of(kind, F.col("__text"))
        if kind in gates:  # a text that lacks what all of a kind's values have is not searched for them
            values = F.when(gates[kind], values).otherwise(F.array().cast("array<string>"))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"), F.lit(confidence).alias("confidence")))

    text = F.coalesce(F.col(text_col), F.lit(""))
    titled = reduce(lambda x, y: x | y, [F.contains(F.col("__text"), F.lit(w)) for w in TITLES])
    gates = dict.fromkeys(NUMERIC, F.col("__digit")) | {"person": titled}
    each = F.flatten(F.array(*(signals(k, c) for k, c, _ in KINDS)))
    return rows.select(id_col, text.alias("__text")).withColumn("__digit", F.col("__text").rlike("[0-9]")).select(id_col, F.posexplode(each).alias("pos", "e")).select(id_col, F.lit("entities").alias("section"), "pos", "e.type", "e.value", "e.confidence")


def entity_counts(signals: DataFrame, id_col: str) -> DataFrame:
    return signals.groupBy(id_col, "type").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


def dedup_entities(signals: DataFrame, id_col: str) -> DataFrame:
    """One signal per comparison key: the most confident, at the first one's place; empty keys are dropped."""
    keyed = signals.where(T.has_key(F.col("value"))).withColumn("key", T.comparison_key(F.col("value")))
    w = W.partitionBy(id_col, "section", "key")
    best = F.row_number().over(w.orderBy(F.desc("confidence"), "pos"))
    return keyed.withColumn("first", F.min("pos").over(w)).withColumn("rank", best).where("rank = 1").drop("rank").withColumn("pos", F.col("first")).drop("first")
