"""Source divergence audit: how the terms of each (language, source) group depart from its language and its peers.

Every group, and every language as a whole, gives each kept term of the language a probability in billionths,
p = 1 + floor(10^9 * (count + 1) / (N + V)); a departure from q is f = floor((p - q)^2 / q). All arithmetic is exact, in
64-bit integers.

Terms: a group's terms lie in buckets by count. A bucket's largest p and the smallest language probability among its
terms bound f from above. Rounds evaluate the buckets of highest bound first and stop for a group once every bucket not
seen has a bound strictly below its k-th value, so that most postings are never evaluated.

Pairs: a sum over all kept terms is split into what one source's terms add against the other's probability of terms that
it lacks (from histograms of counts), and a correction from the terms that both have (from posting lists).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

BILLION = 1_000_000_000
#: Terms [^\x00-\x40\x5B-\x60\x7B-\x7F]+ of UTF-8 with A-Z lower-cased are what this leaves between blanks.
TERM_BYTES = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: A task hands its counts on when they hold so many terms of groups.
MAX_TERMS = 200_000
#: Bytes of a text whose terms are counted at once.
MAX_BYTES = 8 << 20
#: Pairs of sources that are looked at, and sums of pairs that a task holds, at once.
MAX_PAIRS = 1 << 20


def terms_of(text: bytes | None) -> Iterator[list[bytes]]:
    """All terms of a text, in lists of what about MAX_BYTES of it hold."""
    blank, at = (text or b"").translate(TERM_BYTES), 0
    while at < len(blank):
        to = len(blank) if len(blank) - at <= MAX_BYTES else blank.find(b" ", at + MAX_BYTES)
        to = to if to >= 0 else len(blank)
        yield blank[at:to].split()
        at = to


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of rows (text, lang, source): occurrences and rows that have the term, by task.

    Null texts, languages and sources are the empty text. Each occurring group has rows of no term (null) besides.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def close() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, rows) in groups.items():
                size = len(n) + 1
                columns = [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([None, *n], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *map(rows.__getitem__, n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        held = 0
        for batch in batches:
            for text, lang, source in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2)), strict=True):
                n, rows = groups.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for terms in terms_of(text.as_py()):
                    n.update(terms)
                    own.update(terms)
                rows.update(own)
                held += len(n) - before
                if held > MAX_TERMS:
                    yield from close()
                    held = 0
        yield from close()

    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(F.col("text").cast("binary").alias("text"), *columns).mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(count: str, total: str) -> str:
    """SQL of 1 + floor(10^9 * (count + 1) / total) by long division in three steps; total stays below 9 * 10^15."""
    rest, quotient = f"({count} + 1)", "0L"
    for _ in range(3):
        quotient = f"({quotient} * 1000L + ({rest} * 1000L) div {total})"
        rest = f"(({rest} * 1000L) % {total})"
    return f"1L + {quotient}"


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As share, of arrays."""
    rest, quotient = count + 1, np.zeros(len(count), np.int64)
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // total, rest % total
    return 1 + quotient


def departure(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def term_index(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """Posting lists of all kept terms: (lang, term, n, posts), posts an array of (source, n); materialized.

    A row without a term for each language lists all of its sources, with n = 0. A list is at most as long as the
    language has sources, whose square the result of pairs has.
    """
    counts = term_counts(docs)
    dealt = counts.repartition(F.col("lang"), F.col("term")).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    lists = dealt.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("posts"))
    return materialize(lists.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs"), "term-index")


def group_totals(index: DataFrame) -> DataFrame:
    """(lang, source, total, kept, lang_total) of every group: N, the language's V, and N of the whole language."""
    langs = index.groupBy("lang").agg(F.count("term").alias("kept"), F.sum("n").alias("lang_total"))
    posts = index.select("lang", F.explode("posts").alias("post"))
    return materialize(posts.groupBy("lang", "post.source").agg(F.sum("post.n").alias("total")).join(langs, "lang"), "term-groups")


def term_postings(index: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, term, p, q, bucket) of every term of every group; q is the language's; materialized.

    Counts below 16 have a bucket each, larger ones eight for each doubling.
    """
    posts = index.where("term is not null").select("lang", "term", F.col("n").alias("lang_n"), F.explode("posts").alias("post")).select("lang", "term", "lang_n", "post.source", "post.n")
    bits = "length(bin(n))"
    found = posts.join(groups, ["lang", "source"]).selectExpr("lang", "source", "term", f"{share('n', '(total + kept)')} AS p", f"{share('lang_n', '(lang_total + kept)')} AS q", f"cast({bits} * 16 + shiftright(n, greatest({bits} - 4, 0)) AS int) AS bucket")
    return materialize(found, "term-postings")


def top_terms(postings: DataFrame, k: int = 200, first: int = 4, growth: int = 8) -> tuple[DataFrame, dict[str, int]]:
    """The k terms of each group that stand out most: (lang, source, term, value, rank), and figures of the search.

    Round by round the buckets of highest bound, of about first * k terms a group and growth times as many in each later
    round, are evaluated, until all bounds left are strictly below the group's k-th value. Ties go to the smaller term.
    """
    by = W.partitionBy("lang", "source")
    bounds = postings.groupBy("lang", "source", "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count("*").alias("size")).where("p > q")
    bounds = bounds.selectExpr("lang", "source", "bucket", "size", "(p - q) * (p - q) div q AS bound")
    order = by.orderBy(F.desc("bound"), "bucket")
    bounds = materialize(bounds.select("*", F.row_number().over(order).alias("nth"), (F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")).alias("before")), "term-bounds")
    spark, quota, top, work = postings.sparkSession, first * k, None, {"rounds": 0, "evaluated": 0}
    state = spark.createDataFrame([], "lang string, source string, seen int, upto long, kth long")
    while True:
        open_ = bounds.join(state, ["lang", "source"], "left").where("nth > coalesce(seen, 0) and bound >= coalesce(kth, -1)")
        chosen = materialize(open_.where(F.col("before") - F.coalesce("upto", F.lit(0)) < quota).select("lang", "source", "bucket", "size", "nth", "before"), "term-chosen")
        work["evaluated"] += (size := chosen.agg(F.sum("size")).first()[0] or 0)
        if not size:
            break
        work["rounds"] += 1
        found = postings.join(chosen.select("lang", "source", "bucket"), ["lang", "source", "bucket"]).where("p > q").selectExpr("lang", "source", "term", "(p - q) * (p - q) div q AS value")
        found = found if top is None else found.unionByName(top.drop("rank"))
        top = materialize(found.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= k), "term-top")
        seen = chosen.groupBy("lang", "source").agg(F.max("nth").alias("seen"), F.max(F.col("before") + F.col("size")).alias("upto"))
        # groups without chosen buckets are done: their bounds left, if any, are below their k-th value
        state = materialize(seen.join(top.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth")), ["lang", "source"], "left").unionByName(state.join(seen, ["lang", "source"], "left_anti")), "term-state")
        quota *= growth
    if top is None:
        top = spark.createDataFrame([], "lang string, source string, term string, value long, rank int")
    return top, work


class _Groups:
    """Every group's number, probability of an absent term and total, the groups of a language next to each other."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r.lang, r.source))
        self.langs, self.sources = [r.lang for r in rows], pa.array([r.source for r in rows], pa.string())
        self.at = {(r.lang, r.source): i for i, r in enumerate(rows)}
        self.kept = np.array([r.kept for r in rows], np.int64)
        self.total = np.array([r.total for r in rows], np.int64) + self.kept
        self.absent = shares(np.zeros(len(rows), np.int64), np.maximum(self.total, 1))
        self.span: dict[str, tuple[int, int]] = {}
        for i, r in enumerate(rows):
            self.span[r.lang] = (self.span.get(r.lang, (i,))[0], i + 1)

    def batch(self, a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        lang = pa.array([self.langs[i] for i in a.tolist()], pa.string())
        return pa.RecordBatch.from_arrays([lang, self.sources.take(pa.array(a)), self.sources.take(pa.array(b)), pa.array(value, pa.int64())], names=["lang", "source", "item", "value"])


def _one_sided(groups: _Groups, at: int, p: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What group at, with n terms of each probability p, adds to its pairs with all others, both ways."""
    lo, hi = groups.span[groups.langs[at]]
    width = max(1, MAX_PAIRS // max(1, len(p)))
    for start in range(lo, hi, width):
        others = np.arange(start, min(hi, start + width))
        others = others[others != at]
        absent, own = groups.absent[others], groups.absent[at]
        out = departure(own, absent)
        there = ((departure(p[:, None], absent[None]) - out) * n[:, None]).sum(axis=0) + groups.kept[at] * out
        back = ((departure(absent[None], p[:, None]) - departure(absent, own)) * n[:, None]).sum(axis=0)
        mine = np.full(len(others), at)
        yield groups.batch(mine, others, there)
        yield groups.batch(others, mine, back)


def _two_sided(groups: _Groups, at: np.ndarray, p: np.ndarray, sizes: np.ndarray) -> Iterator[pd.Series]:
    """Corrections, by pair of groups, for terms that both have; posting lists of the given sizes lie one after the other."""
    starts, size = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
    absent, ends, lo = groups.absent[at], np.cumsum(size), 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MAX_PAIRS, "right")))
        each = size[lo:hi]
        a = np.repeat(np.arange(lo, hi), each)
        b = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each) + np.repeat(starts[lo:hi], each)
        a, b = a[a != b], b[a != b]
        value = departure(p[a], p[b]) - departure(p[a], absent[b]) - departure(absent[a], p[b]) + departure(absent[a], absent[b])
        yield pd.Series(value).groupby(at[a] * len(groups.langs) + at[b]).sum()
        lo = hi


def source_pairs(index: DataFrame, postings: DataFrame, groups: DataFrame) -> DataFrame:
    """Divergence of each group from each other source of its language: (lang, source, item, value).

    The groups go to the driver and to every task: they are the square root of the result's rows.
    """
    known = index.sparkSession.sparkContext.broadcast(_Groups(groups.select("lang", "source", "total", "kept").collect()))
    schema = "lang string, source string, item string, value long"
    counts = postings.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).groupBy("lang", "source").agg(F.collect_list("p").alias("p"), F.collect_list("n").alias("n"))
    counts = groups.select("lang", "source").join(counts, ["lang", "source"], "left")

    def one_sided(batches):
        table = known.value
        for batch in batches:
            for lang, source, p, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                yield from _one_sided(table, table.at[lang, source], np.array(p or [], np.int64), np.array(n or [], np.int64))

    def two_sided(batches):
        table, sums = known.value, []

        def close() -> Iterator[pa.RecordBatch]:
            whole = pd.concat(sums).groupby(level=0).sum() if sums else pd.Series(dtype=np.int64)
            sums[:] = [whole]
            if len(whole) > MAX_PAIRS:
                yield flush()

        def flush() -> pa.RecordBatch:
            whole = sums.pop()
            a, b = np.divmod(whole.index.to_numpy(np.int64), max(1, len(table.langs)))
            return table.batch(a, b, whole.to_numpy(np.int64))

        for batch in batches:
            posts = batch.column(1)
            flat, sizes = posts.flatten(), posts.value_lengths().to_numpy()
            langs = np.repeat(np.array(batch.column(0).to_pylist(), object), sizes)
            at = np.fromiter(map(table.at.__getitem__, zip(langs, flat.field(0).to_pylist(), strict=True)), np.int64, len(langs))
            sums += _two_sided(table, at, shares(flat.field(1).to_numpy(), table.total[at]), sizes.astype(np.int64))
            yield from close()
        if sums:
            yield flush()

    alone = counts.select("lang", "source", "p", "n").mapInArrow(one_sided, schema)
    both = index.where(F.col("term").isNotNull() & (F.size("posts") > 1)).select("lang", "posts").mapInArrow(two_sided, schema)
    return alone.unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, k: int = 200) -> DataFrame:
    """Divergence of sources: (lang, source, part, item, value, rank), part 'pair' or 'term'.

    pair: item is each other source of the language, value the sum of departures from its probabilities over all kept
    terms. term: item is a term that the group has more often than the language, at most k of them. Ranks count from 1
    by falling value, ties by item in UTF-8 order.

    A language keeps the terms of at least min_docs of its rows; rows that repeat are rows each. Null text, language and
    source are empty texts, and so groups of their own; a group without terms has its pairs (a language without kept
    terms has pairs of value 0), and a language of one source has none. Other columns are ignored; no rows give none.
    """
    own = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    index = term_index(own, min_docs)
    groups = group_totals(index)
    postings = term_postings(index, groups)
    pairs = source_pairs(index, postings, groups)
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    terms, _ = top_terms(postings, k)
    return pairs.selectExpr("lang", "source", "'pair' AS part", "item", "value", "rank").union(terms.selectExpr("lang", "source", "'term' AS part", "term", "value", "rank"))
