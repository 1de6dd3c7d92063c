"""MinHash near-duplicate removal with bottom-k sketches of one hash function.

Every document's set of word shingles is hashed once; the k smallest hashes are its sketch. Inverted lists of the
retained values give the candidates, the sketch of the union estimates a pair's similarity, and the full sets decide.

Equal sets are one class with one representative, so copies are never paired with each other. A list of a frequent
value is not expanded into pairs either: its most central member is compared with the others first (a star), the links
found are joined to components, and only lists that still hold more than one component are looked at again, through
exact prefix lists of the full sets, between components only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WordHashes, connected_components, id_and_text, long_lists, map_texts, materialize, shingles, words_of


#: Parts that a class of equal sets is dealt out in.
PARTS = 64


def sketches(docs: DataFrame, k: int, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch) of every row of docs (doc_id, text binary)."""

    def make():
        hashes = WordHashes()

        def call(ids, texts):
            sets = [np.unique(shingles(hashes.of(words_of(t)), size)) for t in texts]
            return [ids, [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], long_lists([s[:k] for s in sets])]

        return call

    return map_texts(docs, make, "doc_id long, n_shingles long, set_key binary, sketch array<long>")


def full_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, full): the whole shingle set of every row of docs."""

    def make():
        hashes = WordHashes()
        return lambda ids, texts: [ids, long_lists([np.unique(shingles(hashes.of(words_of(t)), size)) for t in texts])]

    return map_texts(docs, make, "doc_id long, full array<long>")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose full sets (doc_id, full) reach the threshold."""
    percent = round(100 * threshold)
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("full").alias("full_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("full").alias("full_b")), "b")
    inter = F.size(F.array_intersect("full_a", "full_b"))
    return joined.where(100 * inter >= percent * (F.size("full_a") + F.size("full_b") - inter)).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, k: int = 64, shingle_words: int = 5, slack_sigmas: float = 4.1, exact: bool = False) -> DataFrame:
    """Component of every row of docs: (doc_id, n_shingles, component_id, kept).

    Two rows are linked if the Jaccard similarity of their shingle sets is at least threshold; component_id is the
    smallest id reachable. A sketch estimate may be slack_sigmas standard errors under the threshold before a pair is
    let go (a miss has odds of about 2 in 100,000 at the threshold itself and vanishes above it). With exact, all sets
    of different components are also looked at through exact prefix lists, so that no link is missed, at a higher cost.

    Null, empty or blank texts have an empty set and no links. Rows that repeat an id are linked with each other and
    give a row each. A row without an id is linked with nothing and has a null component_id and kept true. Other
    columns of docs are ignored. An empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    t, slack = threshold, slack_sigmas * math.sqrt(threshold * (1 - threshold) / k)
    sketch = materialize(sketches(rows, k, shingle_words), "near-sketch")

    # a class of thousands of copies is dealt out by part, first for its least id and then to learn it
    dealt = sketch.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    parts = dealt.where("set_key is not null and doc_id is not null").groupBy("set_key", "part").agg(F.min("doc_id").alias("least"))
    classes = parts.join(parts.groupBy("set_key").agg(F.min("least").alias("rep")), "set_key").select("set_key", "part", "rep")
    member = dealt.join(classes, ["set_key", "part"], "left").drop("part")
    reps = materialize(member.where("rep = doc_id").select("rep", F.col("n_shingles").alias("n"), "sketch").dropDuplicates(["rep", "n"]), "near-reps")
    held = F.size("sketch")
    needed = F.when(F.col("n") <= t * k, F.ceil(t * F.col("n"))).otherwise(F.floor((t - slack) * held)).cast("int")
    posts = reps.select("rep", "n", held.alias("held"), needed.alias("needed"), F.explode("sketch").alias("value"))
    frequent = posts.select("value").groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    by_doc = W.partitionBy("rep")
    listed = (
        posts.join(frequent, "value")
        .withColumn("common", F.count("*").over(by_doc))
        .where("common >= needed")
        .withColumn("central", F.sum("df").over(by_doc))
        .withColumn("at", F.col("held") - F.col("common") + F.row_number().over(by_doc.orderBy("df", "value")))
        .where("at <= held - needed + 1")
        .select("value", "rep", "central")
    )
    listed = materialize(listed, "near-lists")
    asked = (reps if exact else listed).select(F.col("rep").alias("doc_id")).distinct()
    sets = materialize(full_sets(rows.join(asked, "doc_id", "left_semi"), shingle_words).dropDuplicates(["doc_id", "full"]), "near-sets")

    pivot = listed.groupBy("value").agg(F.max_by("rep", F.struct("central", -F.col("rep"))).alias("pivot"))
    star = listed.join(pivot, "value").where("pivot <> rep").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
    sk = reps.select("rep", "sketch")
    paired = star.join(sk.toDF("a", "sketch_a"), "a").join(sk.toDF("b", "sketch_b"), "b")
    union = F.slice(F.array_sort(F.array_union("sketch_a", "sketch_b")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("sketch_a", "sketch_b")))
    likely = paired.where(common >= (t - slack) * F.size(union)).select("a", "b")
    links = materialize(verified(likely, sets, t), "near-links")
    first = materialize(connected_components(links), "near-first")

    settled = listed.select("value", "rep").join(first.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = settled.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("value")
    open_docs = settled.join(mixed, "value", "left_semi").select(F.col("rep").alias("doc_id"), "component").distinct()
    if exact:
        open_docs = reps.select("rep").distinct().join(first.toDF("rep", "component"), "rep", "left").select(F.col("rep").alias("doc_id"), F.coalesce("component", "rep").alias("component"))
    more = materialize(_between_components(sets, open_docs, t), "near-links")

    same_id = member.where("rep <> doc_id").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = connected_components(first.select(F.col("node").alias("a"), F.col("component_id").alias("b")).union(more).union(same_id))
    out = member.join(final.toDF("rep", "component_id"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _between_components(sets: DataFrame, open_docs: DataFrame, t: float) -> DataFrame:
    """Links (a, b) between documents of different components, by exact prefix lists with size and position bounds."""
    docs = sets.join(open_docs, "doc_id").withColumn("n", F.size("full"))
    posts = docs.select("doc_id", "component", "n", F.explode("full").alias("value"))
    frequent = posts.groupBy("value").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("df > 1")
    by_doc = W.partitionBy("doc_id")
    # values of a single document are first in the order and make no pairs; the others' places follow them
    placed = (
        posts.join(frequent, "value")
        .withColumn("at", F.col("n") - F.count("*").over(by_doc) + F.row_number().over(by_doc.orderBy("df", "value")))
        .where(F.col("at") <= F.col("n") - F.ceil(t * F.col("n")) + 1)
        .where("lo < hi")
        .select("value", "doc_id", "component", "n", "at")
    )
    placed = materialize(placed, "near-prefix")
    x, y = (placed.select("value", *(F.col(c).alias(f"{c}_{s}") for c in ("doc_id", "component", "n", "at"))) for s in "ab")
    most = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    fits = (F.col("component_a") < F.col("component_b")) & (F.col("n_a") >= t * F.col("n_b")) & (F.col("n_b") >= t * F.col("n_a")) & ((1 + t) * most >= t * (F.col("n_a") + F.col("n_b")) - 1e-9)
    pairs = x.join(y, "value").where(fits).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
    return verified(pairs, sets, t)
