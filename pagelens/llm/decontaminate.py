"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by their number of shingles into size classes (powers of two). For each class a document is cut
into blocks of the class's largest size, and two neighbouring blocks form a window, so a passage of a class's item lies
inside some window whose size is at most a small multiple of the item's. A window's MinHash signature is the minimum of
its blocks' signatures; a window and an item that agree in one of the signature's rows are a candidate. Long documents
thus don't drown short items, whose similarity with the whole document would be near zero.

Candidates are verified in the same task with the document's whole shingle set. Items are the stated query set: their
signatures go to the tasks in blocks of bounded size, documents are read once for each block and never shuffled. A task
lays its documents' shingles end to end and cuts windows out of that; one that spans two documents stands for both.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, grams, id_and_text, map_rows, map_texts, materialize, mix64, words_of

#: Bytes of item text that go out together.
BLOCK_BYTES = 64 << 20


def _signatures(values: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """Minima of every hash function over blocks of `size` values: (functions, blocks)."""
    blocks = -(-len(values) // size)
    padded = np.full(blocks * size, values[-1], np.int64)
    padded[: len(values)] = values
    by_place = np.ascontiguousarray(padded.view(np.uint64).reshape(blocks, size).T)
    out, step = np.empty((len(seeds), blocks), np.uint64), max(1, (1 << 15) // size)
    with np.errstate(over="ignore"):
        for at in range(0, blocks, step):
            part = by_place[:, at : at + step]
            for i, seed in enumerate(seeds):
                x = part * seed
                x ^= x >> np.uint64(31)
                x.min(axis=0, out=out[i, at : at + step])
    return out


def _keys(signatures: np.ndarray) -> np.ndarray:
    """Signature values with their row worked in."""
    with np.errstate(over="ignore"):
        return signatures + np.arange(1, len(signatures) + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)


class Class:
    """The items of one size class: their signature keys, sorted, each one's item, and a table of the keys' low bits."""

    BITS = 18

    def __init__(self, size: int, members: list[int], values: list[np.ndarray], seeds: np.ndarray):
        keys = np.concatenate([_keys(_signatures(v, seeds, len(v))).ravel() for v in values])
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.members = size, keys[order], np.repeat(members, len(seeds))[order]
        self.low = np.zeros(1 << self.BITS, bool)
        self.low[(keys & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def hits(self, windows: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) that agree in a row of the signatures."""
        probes = _keys(windows)
        row, window = np.nonzero(self.low[(probes & np.uint64((1 << self.BITS) - 1)).astype(np.int64)])
        found = probes[row, window]
        left, right = np.searchsorted(self.keys, found, "left"), np.searchsorted(self.keys, found, "right")
        return [(w, m) for i in np.flatnonzero(left < right) for w in [int(window[i])] for m in self.members[left[i] : right[i]].tolist()]


def _index(items: list[tuple[int, np.ndarray]], seeds: np.ndarray) -> list[Class]:
    classes: dict[int, list[int]] = {}
    for at, (_, values) in enumerate(items):
        classes.setdefault(max(4, 1 << (len(values) - 1).bit_length()), []).append(at)
    return [Class(size, members, [items[m][1] for m in members], seeds) for size, members in sorted(classes.items())]


def _inverted(items: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """All items' values in ascending order, and the item that each is of."""
    values, owners = np.concatenate([v for _, v in items]), np.repeat(np.arange(len(items)), [len(v) for _, v in items])
    order = np.argsort(values, kind="stable")
    return values[order], owners[order]


def _overlaps(own: np.ndarray, values: np.ndarray, owners: np.ndarray) -> list[tuple[int, int]]:
    """(item, common values) of the items that share a value with own, distinct values."""
    left = np.searchsorted(values, own, "left")
    n = np.searchsorted(values, own, "right") - left
    at = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
    items, common = np.unique(owners[at], return_counts=True)
    return list(zip(items.tolist(), common.tolist(), strict=True))


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.75, shingle_words: int = 5, functions: int = 48, block: int = 50_000, exact: bool = False) -> DataFrame:
    """Items of which a document holds at least threshold of the distinct shingles.

    Returns (doc_id, item_id, item_shingles, found, containment), one row per document row and item row. At the
    threshold a window has a Jaccard similarity of at least 1/6 with its item, so 48 rows miss it with odds of 2 in
    10,000; the whole passage (similarity 1/4 and more) with 1 in 1,000,000. With exact, every document's shingles are
    looked up in an inverted list of the items' instead, and nothing is missed.

    Items of fewer words than shingle_words are looked for as one run of all their words. Items that are null or have
    no words are never found, documents without words hold none. A repeated item or document gives rows of its own.
    Null ids are kept as null. Empty tables give no rows. Other columns are ignored. Items are read to the driver in
    blocks of at most about `block` rows and BLOCK_BYTES of text, numbered by item hash, so that what a task holds is
    bounded by these and the longest item.
    """
    rows = id_and_text(docs, id_col, text_col)
    found = []
    for part in _blocks(items, item_id, item_text, block):
        hits = _search(rows.sparkSession, part, threshold, shingle_words, functions, exact)

        def make(hits=hits):
            search = hits()

            def call(ids, texts):
                out = [(ids[doc], *rest) for doc, *rest in search(texts)]
                return [list(c) for c in zip(*out, strict=True)] or [[]] * 5

            return call

        found.append(map_texts(rows, make, "doc_id long, item_id long, item_shingles long, found long, containment double"))
    return reduce(DataFrame.union, found)


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.75, shingle_words: int = 5, functions: int = 48, block: int = 50_000, exact: bool = False) -> DataFrame:
    """The rows of docs, with all their columns, whose text holds none of the items (see contained_items).

    Each row is judged by its own text, in one pass for each block of items and without a join, whether its id is null
    or repeated. Null and empty texts stay; without items all rows stay; an empty table gives no rows.
    """
    for part in _blocks(items, item_id, item_text, block):
        hits = _search(docs.sparkSession, part, threshold, shingle_words, functions, exact)

        def make(hits=hits):
            search = hits()

            def clean(texts):
                stays = np.ones(len(texts), bool)
                stays[[doc for doc, *_ in search(texts)]] = False
                return stays

            return clean

        docs = map_rows(docs, make, text_col)
    return docs


def _blocks(items: DataFrame, item_id: str, item_text: str, block: int) -> list[DataFrame]:
    """Items (item_id, text) in parts of about `block` rows and BLOCK_BYTES."""
    wanted = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("binary").alias("text")).where("text is not null")
    rows, size = wanted.agg(F.count("*"), F.sum(F.length("text"))).first()
    blocks = max(1, -(-rows // block), -(-(size or 0) // BLOCK_BYTES))
    if blocks == 1:
        return [wanted]
    numbered = materialize(wanted.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), "items")
    return [numbered.where(F.col("part") == i).select("item_id", "text") for i in range(blocks)]


def _search(spark: SparkSession, items: DataFrame, threshold: float, shingle_words: int, functions: int, exact: bool):
    """A function that a task calls once for a search: texts to (text's place, item_id, item_shingles, found, containment)."""
    hashes = WordHashes()
    seeds = mix64(np.arange(1, functions + 1, dtype=np.uint64)) | np.uint64(1)
    by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, text in items.collect():
        words = words_of(bytes(text))
        if words:
            length = min(shingle_words, len(words))
            by_length.setdefault(length, []).append((item, np.unique(grams(hashes.of(words), length))))
    shared = spark.sparkContext.broadcast([(n, its, _inverted(its) if exact else _index(its, seeds)) for n, its in sorted(by_length.items())])

    def make():
        known = WordHashes()

        def candidates(stream: np.ndarray, ends: np.ndarray, classes: list[Class]) -> set[tuple[int, int]]:
            """(document's place, item) of the windows over all documents' values in a row, whatever documents they touch."""
            width, blocks, out = classes[0].size, _signatures(stream, seeds, classes[0].size), set()
            for own in classes:
                while width < own.size:  # two blocks make one of the next class
                    blocks = np.minimum(blocks[:, ::2], np.concatenate((blocks[:, 1::2], blocks[:, -1:]), axis=1)[:, : (blocks.shape[1] + 1) // 2])
                    width *= 2
                for window, item in own.hits(np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks):
                    first, last = np.searchsorted(ends, (window * width, min((window + 2) * width, len(stream)) - 1), "right")
                    out.update((doc, item) for doc in range(first, last + 1))
            return out

        def search(texts):
            out: list[tuple] = []
            words = [known.of(words_of(t)) for t in texts]
            for length, its, classes in shared.value:
                values = [grams(w, length) for w in words]
                stream = np.concatenate(values)
                if not len(stream):
                    continue
                if exact:
                    for doc, own in enumerate(values):
                        for hit, common in _overlaps(np.unique(own), *classes):
                            item, size = its[hit][0], len(its[hit][1])
                            if common >= threshold * size:
                                out.append((doc, item, size, common, common / size))
                    continue
                whole: dict[int, np.ndarray] = {}
                for doc, hit in sorted(candidates(stream, np.cumsum([*map(len, values)]), classes)):
                    if doc not in whole:
                        whole[doc] = np.unique(values[doc])
                    item, own = its[hit]
                    if len(whole[doc]):
                        at = np.minimum(np.searchsorted(whole[doc], own), len(whole[doc]) - 1)
                        common = int((whole[doc][at] == own).sum())
                        if common >= threshold * len(own):
                            out.append((doc, item, len(own), common, common / len(own)))
            return out

        return search

    return make
