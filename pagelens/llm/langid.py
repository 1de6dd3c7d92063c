"""Language ID of mixed-language text: script ranges, per-word scores and Viterbi with a switching penalty.

A word's script leaves the languages that were seen to use it as candidates. Each candidate scores the word with a
character model (up to four characters, interpolated). Viterbi over a document's words then finds the labelling with
the highest total, where each change of language costs a penalty; neighbouring words with one label are a span.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_CACHE_BYTES, WORD_BYTES, id_and_text, map_rows, map_texts

WORD = re.compile(r"[^\W\d_]+")

#: Unicode block ranges of scripts.
SCRIPTS = (
    ("latin", 0x41, 0x24F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F),
    ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
)
ORDER = 4


def script_of(word: str) -> str:
    """Script of a word's first letter, by range; other for what is in none."""
    code = ord(word[0])
    return next((name for name, lo, hi in SCRIPTS if lo <= code <= hi), "other")


#: Characters that a model tells apart; a gram's key has 16 bits for each of its characters, 0 for those it does not know.
ALPHABET = (1 << 16) - 1


@dataclass
class Model:
    """Languages, their log shares, for each script which languages use it, and log P(last character | those before) by gram.

    alphabet: code points in ascending order. keys, logs: for each gram size the grams' keys in ascending order and their
    logs by language. floor: the log of a character never seen.
    """

    langs: list[str]
    prior: np.ndarray
    scripts: dict[str, np.ndarray]
    alphabet: np.ndarray
    keys: list[np.ndarray]
    logs: list[np.ndarray]
    floor: float


def _codes(text: str, alphabet: np.ndarray) -> np.ndarray:
    """Places of the text's characters in the alphabet, from 1; 0 for others."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
    return np.where(alphabet[at] == points, at + 1, 0).astype(np.uint64)


def _count_grams(words: list[str], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Character grams of one to ORDER characters of words between start and end marks, each with the words' counts summed."""
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet = np.unique(points)
    if len(alphabet) > ALPHABET and len(words) > 1:
        for half in (slice(0, len(words) // 2), slice(len(words) // 2, None)):
            yield from _count_grams(words[half], counts[half])
        return
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    place = np.arange(len(points)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes, weights = np.searchsorted(alphabet, points).astype(np.uint64), np.repeat(counts, sizes)
    keys = codes
    for size in range(1, ORDER + 1):
        ends = place >= max(1, size - 1)
        found, which = np.unique(keys[ends], return_inverse=True)
        chars = np.stack([alphabet[((found >> np.uint64(16 * back)) & np.uint64(0xFFFF)).astype(np.int64)] for back in range(size - 1, -1, -1)], axis=1)
        yield np.ascontiguousarray(chars.astype("<u4")).view(f"<U{size}").ravel().astype(object), np.bincount(which, weights=weights[ends]).astype(np.int64)
        if size < ORDER:
            keys = keys | (np.roll(codes, size) << np.uint64(16 * size))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs_per_lang: int = 1500) -> Model:
    """A model from docs' text and non-null language, of at most about max_docs_per_lang documents a language.

    Documents are taken by a hash of id and text, all of them where a language has fewer; all character grams of their
    whole texts count. Rows without a text or a language teach nothing; an empty table gives a model of no languages.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    totals = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(totals)
    if not langs:
        return Model([], np.zeros(0), {}, np.zeros(0, np.uint32), [], [], 0.0)
    scale = 1 << 20
    keep = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(scale, int(scale * max_docs_per_lang / totals[lang]) + 1)))))
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < keep[F.col("lang")])

    def count(batches):
        def close(words: Counter) -> Iterator[pa.RecordBatch]:
            for lang in sorted({lang for lang, _ in words}):
                own = {w: n for (x, w), n in words.items() if x == lang}
                kinds: Counter = Counter()
                for word, n in own.items():
                    kinds[script_of(word)] += n
                parts = [("script", np.array(list(kinds), object), np.array(list(kinds.values())))]
                parts += [("gram", *found) for found in _count_grams(list(own), np.fromiter(own.values(), np.int64, len(own)))]
                for kind, grams, counts in parts:
                    if len(grams):  # no word may be long enough for the longest grams
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array([kind] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "kind", "gram", "n"])

        for batch in batches:
            words: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words.update((lang, w) for w in WORD.findall(text.as_py().lower()))
                if len(words) > 100_000:
                    yield from close(words)
                    words.clear()
            yield from close(words)

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, kind string, gram string, n long").groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    found = counted.toArrow()  # the grams of the bounded sample
    lang_at, gram, n = found["lang"].to_pandas().map({x: i for i, x in enumerate(langs)}).to_numpy(), found["gram"].to_pandas(), found["n"].to_numpy()
    is_gram = found["kind"].to_pandas().to_numpy() == "gram"
    scripts: dict[str, np.ndarray] = {}
    seen = pd.DataFrame({"script": gram[~is_gram], "lang": lang_at[~is_gram], "n": n[~is_gram]})
    of_lang = seen.groupby("lang")["n"].transform("sum")
    for name, at, use in zip(seen["script"], seen["lang"], seen["n"] >= 0.01 * of_lang, strict=True):
        scripts.setdefault(name, np.zeros(len(langs), bool))[at] = use

    grams, at = np.unique(gram[is_gram].to_numpy(), return_inverse=True)
    counts = np.zeros((len(grams), len(langs)))
    counts[at, lang_at[is_gram]] = n[is_gram]
    index, sizes = pd.Index(grams), np.fromiter(map(len, grams), np.int64, len(grams))
    single = sizes == 1
    floor, weight = 1 / (int(single.sum()) + 200), 5.0
    usual = sorted(np.flatnonzero(single), key=lambda i: (-counts[i].sum(), grams[i]))[: ALPHABET - 1]
    alphabet = np.sort(np.array([ord(grams[i]) for i in usual] + [2], np.uint32))
    probs, keys, logs = np.zeros(counts.shape), [], []
    for size in range(1, ORDER + 1):
        own = np.flatnonzero(sizes == size)
        if size == 1:
            lower, context = np.full((len(own), len(langs)), floor), np.tile(counts[own].sum(axis=0), (len(own), 1))
        else:
            before = index.get_indexer([g[:-1] for g in grams[own]])
            after = index.get_indexer([g[1:] for g in grams[own]])
            lower = np.where((after >= 0)[:, None], probs[after], floor)
            context = np.where((before >= 0)[:, None], counts[before], 0.0)
        probs[own] = (counts[own] + weight * lower) / (np.maximum(context, counts[own]) + weight)
        codes = _codes("".join(grams[own]), alphabet).reshape(len(own), size)
        key = np.zeros(len(own), np.uint64)
        for i in range(size):
            key = (key << np.uint64(16)) | codes[:, i]
        order = np.argsort(key)
        order = order[(codes > 0).all(axis=1)[order]]
        keys.append(key[order])
        logs.append(np.log(probs[own][order]).astype(np.float32))
    shares = np.array([totals[lang] for lang in langs], float)
    return Model(langs, np.log(shares / shares.sum()), scripts, alphabet, keys, logs, math.log(floor))


class _Scripts(dict):
    """A character to the place of its script among the names, -1 for scripts that are not there."""

    def __init__(self, names: list[str]):
        self.names = names

    def __missing__(self, char: str) -> int:
        name = script_of(char)
        self[char] = at = self.names.index(name) if name in self.names else -1
        return at


class WordScores(dict):
    """Word to its row in a table of scores by language."""

    def __init__(self, model: Model):
        self.model, self.new, self.size = model, [], 0
        names = list(model.scripts)
        may = np.array([model.scripts[x] for x in names], bool).reshape(len(names), len(model.langs))
        self.masks = np.concatenate((np.where(may | ~may.any(axis=1, keepdims=True), 0, -30), np.zeros((1, len(model.langs))))).astype(np.float32)
        self.script = _Scripts(names)
        self.used, self.scores, self.letters = 0, np.zeros((1024, len(model.langs)), np.float32), np.zeros(1024, np.int32)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self.size += 4 * len(word) + WORD_BYTES + 8 * len(self.model.langs)
        self[word] = at = self.used + len(self.new) - 1
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def settle(self) -> None:
        """Scores of the words that are new since the last call."""
        if not self.new:
            return
        n, to = len(self.new), self.used + len(self.new)
        while to > len(self.letters):  # room for twice as many
            self.scores, self.letters = (np.concatenate((x, np.zeros_like(x))) for x in (self.scores, self.letters))
        lower = [w.lower() for w in self.new]
        script = np.fromiter((self.script[w[0]] for w in lower), np.int64, n)
        self.scores[self.used : to] = word_scores(lower, self.model) + self.masks[script]
        self.letters[self.used : to] = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in self.new]
        self.new, self.used = [], to


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Sums over each word's characters and its end of log P by the longest known gram that ends there, by language."""
    codes = _codes("".join(f"\x02{w}\x03" for w in words), model.alphabet)
    sizes = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    out = np.full((len(codes), len(model.langs)), model.floor, np.float32)
    keys, left = [codes], np.flatnonzero(place > 0)
    for back in range(1, ORDER):
        keys.append(keys[-1] | (np.roll(codes, back) << np.uint64(16 * back)))
    for size in range(ORDER, 0, -1):
        at = left[place[left] >= size - 1]
        known = model.keys[size - 1]
        if not len(known) or not len(at):
            continue
        found = np.minimum(np.searchsorted(known, keys[size - 1][at]), len(known) - 1)
        hit = known[found] == keys[size - 1][at]
        out[at[hit]] = model.logs[size - 1][found[hit]]
        done = np.zeros(len(codes), bool)
        done[at[hit]] = True
        left = left[~done[left]]
    out[starts] = 0
    return np.add.reduceat(out, starts, axis=0)


def viterbi(scores: np.ndarray, lengths: np.ndarray, prior: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word. scores: (words of all documents in turn, languages); all documents step together."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    lens = lengths[order]
    total, n = scores.shape
    switched, best_at = np.zeros((total, n), bool), np.zeros(total, np.int32)
    delta = np.tile(prior, (len(lens), 1))
    # documents that still have a word at step t
    active = len(lens) - np.searchsorted(lens[::-1], np.arange(lens[0] if len(lens) else 0), "right")
    for t, m in enumerate(active):
        rows, d = starts[:m] + t, delta[:m]
        if t:
            at = d.argmax(axis=1)
            jump = d[np.arange(m), at] - penalty
            over = jump[:, None] > d
            switched[rows], best_at[rows] = over, at
            d = np.where(over, jump[:, None], d)
        delta[:m] = d + scores[rows]
    labels, state = np.zeros(total, np.int32), delta.argmax(axis=1).astype(np.int32)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        rows, s = starts[:m] + t, state[:m]
        labels[rows] = s
        state[:m] = np.where(switched[rows, s], best_at[rows], s)
    return labels


def one_language(scores: np.ndarray, lengths: np.ndarray, prior: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Each document's best single language, and whether no labelling with a switch can have a higher total.

    Words of other languages gain over that one at most the best sum of neighbouring words' gains; where that is no more
    than one switch costs, Viterbi would give the one language too.
    """
    ends = np.cumsum(lengths)
    starts = ends - lengths
    some = np.flatnonzero(lengths)
    best, sure = np.zeros(len(lengths), np.int32), np.ones(len(lengths), bool)
    if not len(some):
        return best, sure
    own = scores.astype(np.float64)
    own[starts[some]] += prior
    best[some] = np.add.reduceat(own, starts[some], axis=0).argmax(axis=1)
    # the highest rise of the running sum within a document; documents are set apart by steps down that no sum exceeds
    other = np.where(np.arange(scores.shape[1])[None, :] == np.repeat(best, lengths)[:, None], -np.inf, own)
    rise = (other.max(axis=1) - own[np.arange(len(own)), np.repeat(best, lengths)]) if scores.shape[1] > 1 else np.full(len(own), -1.0)
    step = 2 * np.abs(rise).sum() + 1
    doc = np.repeat(np.arange(len(lengths)), lengths)
    total = np.cumsum(rise) - step * doc
    before = np.minimum.accumulate(total - rise)
    sure[some] = np.maximum.reduceat(total - before, starts[some]) <= penalty
    return best, sure


def _labeller(model: Model, penalty: float):
    """A function from texts (UTF-8) to their words' labels, letters by language, and the places where texts end among the words."""
    holder = [WordScores(model)]

    def label(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if holder[0].size > MAX_CACHE_BYTES:
            holder[0] = WordScores(model)
        known = holder[0]
        words = [known.rows(WORD.findall(t)) for t in texts]
        known.settle()
        lengths = np.array([len(w) for w in words])
        flat = np.concatenate(words) if words else np.zeros(0, np.int64)
        scores = known.scores[flat]
        best, sure = one_language(scores, lengths, model.prior, penalty)
        labels, mixed = np.repeat(best, lengths), np.repeat(~sure, lengths)
        if mixed.any():
            labels[mixed] = viterbi(scores[mixed], lengths[~sure], model.prior, penalty)
        doc = np.repeat(np.arange(len(words)), lengths)
        per = np.bincount(doc * len(model.langs) + labels, weights=known.letters[flat], minlength=len(words) * len(model.langs)).reshape(len(words), -1)
        return labels, per, np.cumsum(lengths)

    return label


def _chunk(model: Model) -> int:
    """Bytes of text that are labelled together: less for many languages, as a word has a score for each."""
    return (8 << 20) // max(4, len(model.langs))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = 12.0) -> DataFrame:
    """Language of every row: (doc_id, lang_pred, score, spans), spans an array of (start, end, lang) in code points.

    lang_pred has the most letters among the spans (ties: the first name), score is its share of the letters. Texts
    that are null or have no letter are `und` with score 0 and no spans, and so is everything if no language was
    learned. Repeated rows and null ids give a row each; other columns are ignored; an empty table gives no rows.
    Works on whole texts, in a single pass without a shuffle.
    """
    rows = id_and_text(docs, id_col, text_col)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        label = _labeller(model, penalty)

        def call(ids, raws):
            if not model.langs:
                return [ids, ["und"] * len(ids), [0.0] * len(ids), pa.array([[]] * len(ids), span_type)]
            texts = [r.decode() if r else "" for r in raws]
            labels, per, ends = label(texts)
            whole, best = per.sum(axis=1), per.argmax(axis=1)
            spans = []
            for i, text in enumerate(texts):
                own = labels[ends[i - 1] if i else 0 : ends[i]]
                if not whole[i]:
                    spans.append([])
                    continue
                cuts = np.flatnonzero(np.diff(own))
                if len(cuts):
                    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
                    bounds = [0, *(cuts + 1).tolist(), len(own)]
                    spans.append([{"start": at[a][0], "end": at[b - 1][1], "lang": model.langs[own[a]]} for a, b in zip(bounds, bounds[1:])])
                else:
                    spans.append([{"start": 0, "end": len(text), "lang": model.langs[own[0]]}])
            return [ids, [model.langs[b] if w else "und" for b, w in zip(best, whole)], [float(p[b] / w) if w else 0.0 for p, b, w in zip(per, best, whole)], pa.array(spans, span_type)]

        return call

    return map_texts(rows, make, "doc_id long, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>", _chunk(model))


def with_language(docs: DataFrame, model: Model, text_col: str = "text", languages: Sequence[str] | None = None, least_share: float = 0.5, penalty: float = 12.0) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in one of the languages (None: any that was learned).

    A text is rejected if it is null or has no letter, if its leading language is not among those, or if that language
    has less than least_share of its letters. Each row is judged by its own text, whatever its id; one pass, no join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        label = _labeller(model, penalty)
        wanted = np.array([languages is None or lang in languages for lang in model.langs], bool)

        def keep(raws):
            if not model.langs:
                return np.zeros(len(raws), bool)
            _, per, _ = label([r.decode() if r else "" for r in raws])
            whole, best = per.sum(axis=1), per.argmax(axis=1)
            return (whole > 0) & wanted[best] & (per.max(axis=1) >= least_share * whole)

        return keep

    return map_rows(docs, make, text_col, _chunk(model))
