"""Language-model scores by an Elias-Fano trigram trie whose counts come from the whole corpus.

Documents are tokenized once into batches of bounded size, each with its own dictionary, written to files in the shared
folder. The model is made level by level: words, pairs, triples. At each level a batch sends its distinct n-grams (once
each, whatever their count) to shards, dealt by context, so that a context's successors meet; contexts of more than a
shard's tokens are dealt out by successor too. A shard adds up the batches' counts, builds a level of the trie, with the
smoothed probabilities quantised to two bytes, answers every batch from it by context-relative successor search, and
forgets it. Words get dense ids, the most frequent the smallest; a pair's id is its shard and its place in the level there:
ids are whole, no hashes of n-grams are compared. A batch numbers its words in the order of their ids, so that its n-grams
lie in the order in which it asks, and triples go to the shard that has their first two words. N-grams that lie in one
batch alone, learned and held-out documents alike, known from their parts, are never sent: the batch builds levels of its
own of them and asks those. So every n-gram that was learned is answered by a level of the trie, and only n-grams of
contexts that were not learned have nothing to ask.

The model: P(w|h) = (c(hw) + f(c(h)) * Q(w)) / (c(h) + f(c(h))) with f(c) = c**beta, where Q is the next shorter
context's P, and for no context base(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)); a proper distribution for every context up
to the quantisation of log10 P to steps of 0.0003. A text's tokens are its words and one end; the first follows a start.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, get_file, id_and_text, materialize, mix64, new_dir, put_file
from .elias_fano import Trie

START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))  # no word holds a space
STEP = 3e-4  # of log10 between neighbouring codes
NONE = 65_535  # the code of what a level does not have
SHARD, PAIR = 32, 1 << 32  # a pair's id is (1 + its shard) << SHARD | its place; words' ids are under PAIR
ASKED = "shard long, batch long, data binary"
_PROBABILITY = 10.0 ** (np.arange(NONE + 1) * -STEP)


def quantise(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log10(p) / -STEP), 0, NONE - 1).astype(np.uint16)


def probability(codes: np.ndarray) -> np.ndarray:
    return _PROBABILITY[codes]


def mass(counts: np.ndarray, beta: float) -> np.ndarray:
    """Pseudo-counts that a context gives to the shorter one's distribution."""
    return np.maximum(counts, 1.0) ** beta


def squeeze(array: np.ndarray, stepwise: bool = False) -> bytes:
    """The array in as many bytes a value as its values need, all first bytes before all second ones, compressed; after the width.

    stepwise: differences between neighbours stand for the values, modulo what the bytes hold.
    """
    array = array.astype("<u8")
    width = max(1, -(-int(array.max()).bit_length() // 8)) if len(array) else 1
    if stepwise:
        array = np.diff(array, prepend=np.uint64(0))
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width + 8 * stepwise]) + zstandard.ZstdCompressor(1).compress(planes.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    stepwise, width = divmod(data[0] - 1, 8)
    width += 1
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    whole = next(w for w in (1, 2, 4, 8) if w >= width)
    out = np.zeros((planes.shape[1], whole), np.uint8)
    out[:, :width] = planes.T
    out = out.view(f"<u{whole}").ravel()
    return np.cumsum(out, dtype=out.dtype) & out.dtype.type((1 << 8 * width) - 1) if stepwise else out


def pack(*arrays: np.ndarray, stepwise: tuple[int, ...] = ()) -> bytes:
    """Arrays of integers, one after the other; those at the places in stepwise as squeeze() says."""
    return b"".join(struct.pack("<I", len(part)) + part for part in (squeeze(x, i in stepwise) for i, x in enumerate(arrays)))


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        (n,) = struct.unpack_from("<I", data, at)
        out.append(unsqueeze(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return out


def steps(values: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Differences between neighbours; whole values where fresh."""
    return np.where(fresh, values, np.diff(values, prepend=0))


def sums(diffs: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The values that steps() was made of."""
    total = np.cumsum(diffs)
    at = np.flatnonzero(fresh)
    return total - np.repeat(total[at] - diffs[at], np.diff(np.append(at, len(diffs)))) if len(at) else total


def tokens_of(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of tokens, every token's place among the hashes, and those of the distinct words, of END and of START.

    Words [^\\x20\\x09-\\x0D]+ of UTF-8 texts with A-Z lower-cased, and one end. Hashes may repeat.
    """
    lengths, found = [], []
    for text in texts:
        text = text.view(pa.large_string() if pa.types.is_large_binary(text.type) else pa.string())
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
        words, cuts = lists.values, lists.offsets.to_numpy()
        some = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves empty ones
        before = np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
        lengths.append(before[cuts[1:]] - before[cuts[:-1]] + 1)
        found.append(words.filter(some))
    coded = pa.chunked_array(found).dictionary_encode().unify_dictionaries()
    words = coded.chunk(0).dictionary
    words = words.view(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary()).to_numpy(zero_copy_only=False)
    lengths = np.concatenate(lengths)
    places = np.full(lengths.sum(), len(words))
    inner = np.ones(len(places), bool)
    inner[np.cumsum(lengths) - 1] = False
    places[inner] = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    return lengths, places, np.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), [END, START])


def tokenize(rows: DataFrame, folder: str, batch_bytes: int) -> DataFrame:
    """Writes batches of rows (doc_id, text, held_out) to files in folder; returns (batch, tokens, learned) of each."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def close():
            nonlocal ids, held, texts, size, n
            number = (part << 32) + n
            lengths, places, hashes = tokens_of(texts)
            words, same = np.unique(hashes, return_inverse=True)
            times = np.bincount(same[np.append(places, len(hashes) - 1)], minlength=len(words))
            order = np.argsort(-times, kind="stable")  # frequent words have small places, which take little room
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            known = np.array([i is not None for i in ids])
            bare = np.array([i or 0 for i in ids], np.int64).view(np.uint64)
            put_file(f"{folder}/{number}", pack(lengths, rank[same][places], words[order], np.array(held, np.uint8), known, bare, stepwise=(2,)))
            learned = int(lengths[~np.array(held, bool)].sum())
            out = pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (number, int(lengths.sum()), learned)], names=["batch", "tokens", "learned"])
            ids, held, texts, size, n = [], [], [], 0, n + 1
            return out

        for batch in batches:
            begin, text = 0, batch.column(1)
            sizes = pc.fill_null(pc.binary_length(text), 0).to_pylist()
            for end, (i, length, out) in enumerate(zip(batch.column(0).to_pylist(), sizes, batch.column(2).to_pylist(), strict=True), 1):
                ids.append(i)
                held.append(out)
                size += length + 64
                if size >= batch_bytes:
                    texts.append(text.slice(begin, end - begin))
                    begin = end
                    yield close()
            if begin < len(text):
                texts.append(text.slice(begin))
        if ids:
            yield close()

    return rows.mapInArrow(run, "batch long, tokens long, learned long")


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in ascending order, and each value's place among them; sorts those alone."""
    codes, found = pd.factorize(values)
    order = np.argsort(found)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], rank[codes]


class Batch:
    """A batch's file: its documents, token places in the dictionary, and distinct n-grams with how often each was learned."""

    def __init__(self, folder: str, number: int, ranked: bool = True):
        """ranked: as rank() was last told for this batch, if it was."""
        lengths, places, self.words, held, known, bare = unpack(get_file(f"{folder}/{number}"))
        self.lengths, self.places, self.held = lengths.astype(np.int64), places.astype(np.int64), held.astype(bool)
        self.ids = [i if k else None for i, k in zip(bare.astype(np.uint64).view(np.int64).tolist(), known.tolist(), strict=True)]
        self.words = self.words.astype(np.uint64)
        self.start = int(np.flatnonzero(self.words == START)[0])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.learned = np.repeat(~self.held, self.lengths)
        self.counts = np.bincount(self.places[self.learned], minlength=len(self.words))
        self.counts[self.start] = (~self.held).sum()
        if ranked and (words := get_file(f"{folder}/words-{number}")):
            self.rank(*unpack(words))

    def rank(self, others: np.ndarray, word_ids: np.ndarray, vocabulary: np.ndarray) -> None:
        """Numbers the words in the order of their ids, and with them the n-grams.

        others: 1 more than how often each word was learned in other batches, 0 for those that no other batch has or nobody
        has learned; word_ids: of all but those, which come last.
        """
        shared = np.flatnonzero(others)
        by_id = np.argsort(word_ids)
        order = np.append(shared[by_id], np.flatnonzero(others == 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.places, self.start = place[self.places], int(place[self.start])
        self.words, self.counts = self.words[order], self.counts[order]
        self.word_ids, self.vocabulary = word_ids[by_id].astype(np.int64), int(vocabulary[0])
        self.shared = np.arange(len(order)) < len(shared)
        self.totals = self.counts + np.maximum(others[order].astype(np.int64) - 1, 0)

    def pairs(self) -> None:
        """first, second: places of every distinct pair's words; pair: every token's; pair_counts."""
        before = np.roll(self.places, 1)
        before[self.starts] = self.start
        found, self.pair = distinct(before * len(self.words) + self.places)
        self.first, self.second = np.divmod(found, len(self.words))
        self.pair_counts = np.bincount(self.pair[self.learned], minlength=len(found))

    def triples(self) -> None:
        """head, tail: the two pairs of every distinct triple; triple: every token's, -1 for the first of a document; triple_counts."""
        inner = self._inner()
        found, which = distinct(self.pair[inner - 1] * len(self.words) + self.places[inner])
        at = np.empty(len(found), np.int64)
        at[which] = np.arange(len(which))  # any occurrence tells a triple's pairs
        self.head, self.tail = self.pair[inner[at] - 1], self.pair[inner[at]]
        self._triples(inner, which, len(found))

    def triples_of_words(self) -> None:
        """triple and triple_counts alone, numbered alike, from the words' places where three of them fit 63 bits."""
        n = len(self.words)
        if n**3 >= 1 << 63:
            self.pairs()
            return self.triples()
        before = np.roll(self.places, 1)
        before[self.starts] = self.start
        inner = self._inner()
        found, which = distinct((before[inner - 1] * n + before[inner]) * n + self.places[inner])
        self._triples(inner, which, len(found))

    def _inner(self) -> np.ndarray:
        inner = np.ones(len(self.places), bool)
        inner[self.starts] = False
        return np.flatnonzero(inner)

    def _triples(self, inner: np.ndarray, which: np.ndarray, n: int) -> None:
        self.triple = np.full(len(self.places), -1)
        self.triple[inner] = which
        self.triple_counts = np.bincount(which[self.learned[inner]], minlength=n)


def shard_of(contexts: np.ndarray, successors: np.ndarray, totals: np.ndarray, shards: int, limit: int) -> np.ndarray:
    """Dealt by context, pairs' ids by the shard that is in them; one of more than `limit` occurrences is cut into as many parts by successor."""
    part = successors % -(-totals // limit).clip(1)
    with np.errstate(over="ignore"):
        to = (mix64(contexts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
    return np.where((contexts < PAIR) | (totals > limit), to, (contexts >> SHARD) - 1)


def by_shard(to: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts shard after shard and leaves it else as it is, and where shards begin."""
    order = np.argsort(to.astype(np.uint16 if shards <= 1 << 16 else np.int64), kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(to, minlength=shards)))


def asking_order(contexts: np.ndarray, successors: np.ndarray, totals: np.ndarray, shards: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams, which come by context and successor, shard after shard, and where shards begin."""
    return by_shard(shard_of(contexts, successors, totals, shards, limit), shards)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "batch", "data"])


def ask(batch: int, contexts: np.ndarray, successors: np.ndarray, totals: np.ndarray, counts: np.ndarray, lower: np.ndarray, shards: int, limit: int, by_successor: bool = False) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """(shard, batch, data) for n-grams of a level, the order in which answers will come, shard after shard, and where shards begin.

    N-grams come by context and successor. totals: the context's count; counts: the n-gram's in this batch; lower: the code
    of the shorter context's probability, with by_successor the same wherever the successor is, and sent once.
    A batch always sends a row, be it an empty one.
    """
    order, cuts = asking_order(contexts, successors, totals, shards, limit)
    out = []
    for s in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[s] : cuts[s + 1]]
        fresh = np.diff(contexts[own], prepend=-1) != 0
        heads = own[fresh]
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(own)))
        codes = lower[own]
        if by_successor:
            codes = codes[np.unique(successors[own], return_index=True)[1]]
        out.append((int(s), batch, pack(contexts[heads], sizes, totals[heads], steps(successors[own], fresh), counts[own], codes, stepwise=(0, 5) if by_successor else (0,))))
    return out or [(batch % shards, batch, b"")], order, cuts


def _answer(asked: pa.Table, beta: float, counted: bool, shards: int) -> pa.Table:
    """A shard's answers to every batch, in the order asked: codes, NONE where the level has none.

    With counted, contexts are words, otherwise pairs, and lower is told by successor. Then the answers are 1 more than how
    often other batches have learned each, 0 for those that no other batch has, learned or held out, or that nobody has
    learned; and codes and places of the others: the rest is the batch's own.
    """
    shard, batches = asked["shard"][0].as_py(), asked["batch"].to_pylist()
    parts: list[list[np.ndarray]] = [[] for _ in range(5)]
    for data in asked["data"]:
        got = [x.astype(np.int64) for x in unpack(data.as_py())] or [np.zeros(0, np.int64)] * 6
        if not counted:
            got[0] = (got[0] & (PAIR - 1)) * shards + (got[0] >> SHARD) - 1  # as evenly spread as their places
        fresh = np.zeros(len(got[3]), bool)
        fresh[np.cumsum(got[1]) - got[1]] = True
        successor = sums(got[3], fresh)
        lower = got[5][np.unique(successor, return_inverse=True)[1]] if counted else got[5]
        for list_, x in zip(parts, (np.repeat(got[0], got[1]), successor, np.repeat(got[2], got[1]), got[4], lower), strict=True):
            list_.append(x)
    ends = np.cumsum([len(x) for x in parts[0]])
    contexts, successors, totals, counts, lower = (np.concatenate(x) for x in parts)
    del parts
    order, fresh = in_groups(contexts, successors)
    first = np.flatnonzero(fresh)
    sum_ = np.add.reduceat(counts[order], first) if len(first) else np.zeros(0, np.int64)
    many = (np.diff(np.append(first, len(order))) > 1)[sum_ > 0]
    one = order[first][sum_ > 0]
    sum_ = sum_[sum_ > 0]
    del order, fresh, first
    f = mass(totals[one], beta)
    level = Trie(contexts[one], successors[one], quantise((sum_ + f * probability(lower[one])) / (totals[one] + f)), sum_)
    answers, begin = [], 0
    for end in ends.tolist():
        at, there = level(contexts[begin:end], successors[begin:end])
        if counted:
            shared = there & many[at] if len(many) else there
            at = at[shared]
            others = np.zeros(end - begin, np.int64)
            others[shared] = 1 + level.counts[at] - counts[begin:end][shared]
            answers.append(pack(others, level.codes[at], at, stepwise=(2,)))
        else:
            answers.append(pack(np.where(there, level.codes[at], NONE) if len(level.codes) else np.full(end - begin, NONE)))
        begin = end
    return pa.table({"shard": pa.array([shard] * len(batches), pa.int64()), "batch": pa.array(batches, pa.int64()), "data": pa.array(answers, pa.binary())})


def in_groups(contexts: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by context and successor, and where in it another pair of the two begins."""
    bits = int(successors.max()).bit_length() if len(successors) else 0
    least = contexts.min() if len(contexts) else 0
    if len(contexts) and int(contexts.max() - least).bit_length() + bits > 62:  # pairs' ids of several shards: their ranks take less room
        contexts, least = np.unique(contexts, return_inverse=True)[1], 0
    key = (contexts - least) << bits | successors
    order = np.argsort(key, kind="stable")  # what batches sent are sorted runs
    return order, np.diff(key[order], prepend=-1) != 0


def own_level(contexts: np.ndarray, successors: np.ndarray, totals: np.ndarray, counts: np.ndarray, lower: np.ndarray, beta: float) -> tuple[np.ndarray, np.ndarray]:
    """Codes, and whether they are there, of n-grams that one batch alone has, from a level of those that it has learned.

    Contexts and successors are places in the batch, ascending; n-grams that are not there get the code of their shorter
    context's probability, weighed by what the context leaves for it.
    """
    learned, f = counts > 0, mass(totals, beta)
    level = Trie(contexts[learned], successors[learned], quantise((counts + f * probability(lower)) / (totals + f))[learned], counts[learned])
    at, there = level(contexts, successors)
    codes = quantise(f * probability(lower) / (totals + f))
    codes[there] = level.codes[at[there]]
    return codes, there


def _count_words(asked: pa.Table, shards: int) -> pa.Table:
    """A shard's answers to every batch: others and word_ids as Batch.rank() wants them, in the order asked, and how many words of the shard were learned."""
    shard = asked["shard"][0].as_py()
    sent = [unpack(d.as_py()) for d in asked["data"]]
    found, which = distinct(np.concatenate([k[0].astype(np.uint64) for k in sent]))
    own = np.concatenate([k[1].astype(np.int64) for k in sent])
    counts = np.bincount(which, weights=own, minlength=len(found)).astype(np.int64)
    shared = (counts > 0) & (np.bincount(which, minlength=len(found)) > 1)
    others = np.where(shared[which], 1 + counts[which] - own, 0)
    order = np.flatnonzero(shared)
    ids = np.zeros(len(found), np.int64)
    ids[order[np.argsort(-counts[order], kind="stable")]] = np.arange(len(order)) * shards + shard
    cuts = np.cumsum([0, *(len(k[0]) for k in sent)])
    known = np.array([((counts > 0) & (found != START)).sum()])
    answers = [pack(others[a:b], ids[which[a:b][others[a:b] > 0]], known) for a, b in zip(cuts, cuts[1:])]
    return pa.table({"shard": pa.array([shard] * len(sent), pa.int64()), "batch": asked["batch"], "data": pa.array(answers, pa.binary())})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_of: int = 10, batch_bytes: int = 12 << 20, tokens_per_shard: int = 3_000_000, beta: float = 0.7) -> DataFrame:
    """Scores of all rows: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_found).

    The model learns from the documents whose crc32 of the id as text, modulo held_out_of, is not 0. base_score is the
    sum of log10 base(w), score that of log10 P(w|h); both run over all tokens and the end. n_found counts the tokens whose
    longest n-gram a level of the trie holds. A null or empty text is the
    end alone. A null id counts as the empty text, so it is held out. Repeated rows are learned and scored each; other
    columns are ignored; an empty table gives no rows. With nothing to learn from, every token has base 1.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("held_out", crc_mod("doc_id", held_out_of) == 0)
    spark = docs.sparkSession
    folder = new_dir(spark, "lm")
    batches = materialize(tokenize(rows, folder, batch_bytes), "lm-batches")
    tokens, train = batches.agg(F.sum("tokens"), F.sum("learned")).first()
    tokens, train = tokens or 0, train or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // tokens_per_shard))
    limit = -(-tokens_per_shard // 8)  # a word's triples go where its pairs do, so that its share of a shard is kept small

    def word_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(words)
        to, cuts = by_shard((mix64(words[order]) % np.uint64(shards)).astype(np.int64), shards)
        return order[to], cuts

    def ask_words(found):
        for rows in found:
            for number in rows.column(0).to_pylist():
                b = Batch(folder, number, ranked=False)
                order, cuts = word_order(b.words)
                own = [(s, order[cuts[s] : cuts[s + 1]]) for s in range(shards)]  # all, as each tells how many words it has
                yield _rows([(s, number, pack(b.words[at], b.counts[at], stepwise=(0,))) for s, at in own])

    def base_of(b: Batch) -> np.ndarray:
        return (b.totals + 0.1) / (train + 0.1 * (b.vocabulary + 1))

    def ask_pairs(answers: pa.Table) -> pa.Table:
        number = answers["batch"][0].as_py()
        b = Batch(folder, number, ranked=False)
        others, ids, vocabulary = np.zeros(len(b.words), np.int64), np.zeros(len(b.words), np.int64), np.zeros(1, np.int64)
        order, cuts = word_order(b.words)
        for s, data in zip(answers["shard"].to_pylist(), answers["data"], strict=True):
            at = order[cuts[s] : cuts[s + 1]]
            others[at], own, known = unpack(data.as_py())
            ids[at[others[at] > 0]] = own
            vocabulary += known.astype(np.int64)
        ids = ids[others > 0]
        put_file(f"{folder}/words-{number}", pack(others, ids, vocabulary))
        b.rank(others, ids, vocabulary)
        b.pairs()
        send = np.flatnonzero(b.shared[b.first] & b.shared[b.second])
        first, second = b.first[send], b.second[send]
        out, _, _ = ask(number, b.word_ids[first], b.word_ids[second], b.totals[first], b.pair_counts[send], quantise(base_of(b))[second], shards, limit, by_successor=True)
        return pa.Table.from_batches([_rows(out)])

    def in_order(answers: pa.Table, cuts: np.ndarray):
        """Each shard's answer and the places, in the order asked, that it stands for."""
        for s, data in zip(answers["shard"].to_pylist(), answers["data"], strict=True):
            if cuts[s + 1] > cuts[s]:
                yield s, slice(int(cuts[s]), int(cuts[s + 1])), unpack(data.as_py())

    def ask_triples(answers: pa.Table) -> pa.Table:
        number = answers["batch"][0].as_py()
        b = Batch(folder, number)
        b.pairs()
        context, low = b.totals[b.first], quantise(base_of(b))[b.second]
        send = np.flatnonzero(b.shared[b.first] & b.shared[b.second])
        order, cuts = asking_order(b.word_ids[b.first[send]], b.word_ids[b.second[send]], context[send], shards, limit)
        send = send[order]
        others, place = np.zeros(len(b.first), np.int64), np.zeros(len(b.first), np.int64)
        codes, hit = np.zeros(len(b.first), np.uint16), np.ones(len(b.first), bool)
        for s, at, (more, found, places) in in_order(answers, cuts):
            others[send[at]] = more
            to = send[at][more > 0]
            codes[to], place[to] = found, (s + 1 << SHARD) + places.astype(np.int64)
        closed = others == 0  # no other batch has the pair, or nobody has learned it
        codes[closed], hit[closed] = own_level(b.first[closed], b.second[closed], context[closed], b.pair_counts[closed], low[closed], beta)
        n = b.pair_counts + np.maximum(others - 1, 0)
        b.triples()
        own = closed[b.head] | closed[b.tail]
        context, low = n[b.head], codes[b.tail]
        exact = np.zeros(len(own), np.uint16)
        exact[own], _ = own_level(b.head[own], b.second[b.tail[own]], context[own], b.triple_counts[own], low[own], beta)
        rest = ~own & (b.triple_counts == 0)  # the level has a code for all that is sent and learned
        f = mass(context[rest], beta)
        exact[rest] = quantise(f * probability(low[rest]) / (context[rest] + f))
        send = np.flatnonzero(~own)
        out, order, cuts = ask(number, place[b.head[send]], b.word_ids[b.second[b.tail[send]]], context[send], b.triple_counts[send], low[send], shards, limit)
        to = np.empty(len(send), np.int64)
        to[order] = np.repeat(np.arange(shards), np.diff(cuts))
        put_file(f"{folder}/triples-{number}", pack(send, to, exact[own | rest], codes[b.pair[b.starts]], hit[b.pair[b.starts]].view(np.uint8), stepwise=(0,)))
        return pa.Table.from_batches([_rows(out)])

    def finish(answers: pa.Table) -> pa.Table:
        number = answers["batch"][0].as_py()
        b = Batch(folder, number)
        b.triples_of_words()
        send, to, exact, heads, hit = unpack(get_file(f"{folder}/triples-{number}"))
        send, (order, cuts) = send.astype(np.int64), by_shard(to.astype(np.int64), shards)
        known = (b.triple_counts > 0).astype(np.int64)
        kept = b.triple_counts == 0
        kept |= np.bincount(send, minlength=len(kept)) == 0
        codes = np.full(len(kept), NONE)
        codes[kept] = exact
        known[send] = 0  # those that the batch did not send it has found itself, if they were learned
        send = send[order]
        for _, at, (found,) in in_order(answers, cuts):
            there = found != NONE
            codes[send[at][there]], known[send[at][there]] = found[there], 1
        token, there = np.zeros(len(b.places)), np.zeros(len(b.places), np.int64)
        inner = b.triple >= 0
        token[inner], token[b.starts] = codes[b.triple[inner]] * -STEP, heads * -STEP
        there[inner], there[b.starts] = known[b.triple[inner]], hit
        base = np.log10(base_of(b))[b.places]
        seen = (b.totals[b.places] > 0).astype(np.int64)
        out = [b.ids, b.held, b.lengths, np.add.reduceat(seen, b.starts), np.add.reduceat(base, b.starts), np.add.reduceat(token, b.starts), np.add.reduceat(there, b.starts)]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_found"), out, kinds, strict=True)})

    words = batches.select("batch").mapInArrow(ask_words, ASKED).groupBy("shard").applyInArrow(lambda t: _count_words(t, shards), ASKED)
    level2 = words.groupBy("batch").applyInArrow(ask_pairs, ASKED).groupBy("shard").applyInArrow(lambda t: _answer(t, beta, True, shards), ASKED)
    level3 = level2.groupBy("batch").applyInArrow(ask_triples, ASKED).groupBy("shard").applyInArrow(lambda t: _answer(t, beta, False, shards), ASKED)
    scored = level3.groupBy("batch").applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_found long")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(train)).cast("long").alias("train_tokens"), "base_score", "score", "n_found")
