"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

The two models are first-order Markov chains over the characters of keys (letters of both cases, digits and five marks).
A token is a secret if the mean log-likelihood ratio of its characters and the sum over the token both pass a limit.
Both chains are trained from labelled samples of bounded number. Random strings: the values that the fixed patterns mark
in the corpus, and draws over the usual alphabets of keys. Ordinary ones: the corpus' other words, its tokens of letters
and digits that several documents use, and identifiers composed from its words in the usual spellings. Samples of either
kind can be given besides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_CACHE_BYTES, WORD_BYTES, id_and_text, map_rows, map_texts

#: The fixed patterns, with the least length of the part that counts; letters of the first key in either case.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "markov")

#: The least length of a token that the models judge.
LEAST = 12
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, len(_SYMBOLS), np.int64)
_CODE[[ord(c) for c in _SYMBOLS]] = np.arange(len(_SYMBOLS))
_N = len(_SYMBOLS) + 1


#: Alphabets that keys are drawn from, for samples of random strings.
ALPHABETS = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", _SYMBOLS[:52], _SYMBOLS[:62], _SYMBOLS[:64], _SYMBOLS[:62] + "_-")
#: The shape of a UUID, which names things and opens none.
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")


def draws(n: int, rng: np.random.Generator) -> list[str]:
    """Samples of random strings: n of 12 to 40 characters, of every alphabet equally many."""
    return ["".join(ALPHABETS[i % len(ALPHABETS)][j] for j in rng.integers(0, len(ALPHABETS[i % len(ALPHABETS)]), rng.integers(12, 41))) for i in range(n)]


def identifiers(words: list[str], n: int, rng: np.random.Generator) -> list[str]:
    """Samples of ordinary identifiers: n of one to four of the words each, in usual spellings, some with a number."""
    join = (
        lambda w: w[0] + "".join(map(str.capitalize, w[1:])),
        lambda w: "".join(map(str.capitalize, w)),
        "_".join,
        "-".join,
        "/".join,
        lambda w: "_".join(w).upper(),
    )
    out = []
    for i in range(n if words else 0):
        own = [words[j].lower() for j in rng.integers(0, len(words), rng.integers(1, 5))]
        if rng.random() < 0.4:
            own[rng.integers(0, len(own))] += str(rng.integers(0, 10 ** rng.integers(1, 5)))
        out.append(join[i % len(join)](own))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in code points, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _pairs(token: str) -> np.ndarray:
    codes = _CODE[np.frombuffer(token.encode(), np.uint8)]
    return np.concatenate(([_N - 1], codes[:-1])) * _N + codes


def mixed(token: str) -> bool:
    """Long tokens of digits and letters, which are ordinary only if several documents use them."""
    return len(token) >= LEAST and any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token)


def uncovered(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of start to end beside spans, which are in order of their starts."""
    left = []
    for s, e in spans:
        if s >= end:
            break
        if s > start:
            left.append((start, s))
        start = max(start, e)
    return [*left, (start, end)] if start < end else left


def labelled_tokens(rows: DataFrame) -> DataFrame:
    """(label, token, n): values marked by the fixed patterns (1), other tokens of 6 characters and more (0), and how many rows have them."""

    def make():
        plain = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
        value = re.compile(r"[A-Za-z0-9+/_=-]{12,}")

        def call(ids, texts):
            seen: Counter = Counter()
            for raw in texts:
                text = raw.decode() if raw else ""
                at, rest, own = 0, [], set()
                for start, kind, end in base_spans(text):
                    inner = text[start:end]
                    inner = ASSIGN.match(inner)[2] if kind == 0 else inner
                    own.update((1, token) for token in value.findall(inner))
                    rest.append(text[at:start])
                    at = max(at, end)
                rest.append(text[at:])
                own.update((0, token) for token in plain.findall(" ".join(rest)))
                seen.update(own)
            return [[k[0] for k in seen], [k[1] for k in seen], list(seen.values())]

        return call

    return map_texts(rows, make, "label int, token string, n long").groupBy("label", "token").agg(F.sum("n").alias("n"))


def _counts(samples: list[str]) -> np.ndarray:
    counts = np.zeros(_N * _N)
    for at in range(0, len(samples), 4096):
        counts += np.bincount(np.concatenate([_pairs(t) for t in samples[at : at + 4096]]), minlength=_N * _N)
    return counts.reshape(_N, _N)


def fit(random: list[str], ordinary: list[str], mass: float = 1000.0) -> np.ndarray:
    """Log-likelihood ratios (random over ordinary) of character pairs, from labelled samples.

    After each character, the ordinary chain starts from `mass` counts in the shares that characters have in all of its
    samples, so that words unlike those of the samples still count as words.
    """
    counts = _counts(ordinary)
    usual = (counts.sum(axis=0) + 5) / (counts.sum() + 5 * _N)
    chains = []
    for grid in (_counts(random) + 0.5, counts + 0.5 + mass * usual):
        chains.append(np.log(grid / grid.sum(axis=1, keepdims=True)))
    return (chains[0] - chains[1]).ravel()


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = 4000, max_tokens: int = 20_000, random: Sequence[str] = (), ordinary: Sequence[str] = ()) -> np.ndarray:
    """Log-likelihood ratios (random over ordinary) of character pairs, from at most max_docs documents and the samples given.

    Documents are taken by a hash of id and text, all of them if there are fewer; of either label the max_tokens tokens
    of smallest hash count, each once, the ordinary ones in small letters too. As many identifiers are composed of the
    ordinary words, and as many random strings drawn (2,000 of either at least), by a fixed seed. Samples given hold one
    token each, of the characters of keys. An empty table leaves the draws and the samples given.
    """
    rows = id_and_text(docs, id_col, text_col)
    total = rows.count()
    scale = 1 << 20
    keep = scale if total <= max_docs else int(scale * max_docs / total)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < keep)
    tokens = labelled_tokens(sample)
    alone = (F.length("token") >= LEAST) & F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]") & (F.col("n") < 2)
    pick = lambda df: [t for (t,) in df.orderBy(F.xxhash64("token"), "token").limit(max_tokens).select("token").collect()]
    marked, plain = pick(tokens.where("label = 1")), pick(tokens.where("label = 0").where(~alone))
    rng = np.random.default_rng(11)
    n = max(2000, len(plain))
    names = identifiers([t for t in plain if t.isalpha()], n, rng)
    return fit([*marked, *draws(n, rng), *random], [*plain, *dict.fromkeys(t.lower() for t in plain), *names, *ordinary])


def is_random(token: str, ratios: np.ndarray, per_char: float, total: float) -> bool:
    """Whether the token's log-likelihood ratio says random string; tokens without a letter (bare numbers) and UUIDs never are."""
    if len(token) < LEAST or not any(c.isalpha() for c in token) or UUID.fullmatch(token):
        return False
    score = float(ratios[_pairs(token)].sum())
    return score >= total and score >= per_char * len(token)


def _finder(ratios: np.ndarray, per_char: float, total: float):
    """A function from a text to its spans (start, kind, end), which remembers tokens up to a bound."""
    known: dict[str, bool] = {}
    size = 0

    def random(token):
        nonlocal size
        if token not in known:
            size += len(token) + WORD_BYTES
            if size > MAX_CACHE_BYTES:
                known.clear()
                size = 0
            known[token] = is_random(token, ratios, per_char, total)
        return known[token]

    def spans(raw: bytes | None) -> list[tuple[int, int, int]]:
        text = raw.decode() if raw else ""
        found, extra = base_spans(text), []
        for m in TOKEN.finditer(text):
            if not found:
                extra += [(m.start(), 3, m.end())] if random(m[0]) else []
                continue
            for start, end in uncovered(m.start(), m.end(), [(s, e) for s, k, e in found if k == 0]):
                if random(text[start:end]):
                    extra += [(s, 3, e) for s, e in uncovered(start, end, [(s, e) for s, _, e in found])]
        return sorted(found + extra)

    return spans


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: np.ndarray | None = None, per_char: float = 0.6, total: float = 12.0) -> DataFrame:
    """Secrets of every row: (doc_id, spans), spans an array of (kind, start, end) by start, then kind.

    Kinds: the three fixed patterns, and markov for tokens of 12 characters and more that the models call random. What
    an assign span covers is cut off a token first; of a token that goes beyond an access or hex span, markov spans are
    the parts that no fixed pattern covers. Offsets are code points, the end exclusive. Null and empty texts have no spans;
    repeated rows and null ids give a row each; other columns are ignored; an empty table gives no rows. Needs no
    shuffle; the ratios, a table of fixed size, go along with the task.
    """
    rows = id_and_text(docs, id_col, text_col)
    ratios = train(docs, id_col, text_col) if ratios is None else ratios

    def make():
        import pyarrow as pa

        spans = _finder(ratios, per_char, total)
        kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return lambda ids, texts: [ids, pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t)] for t in texts], kind_type)]

    return map_texts(rows, make, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(docs: DataFrame, text_col: str = "text", ratios: np.ndarray | None = None, mask: str = "[secret]", per_char: float = 0.6, total: float = 12.0) -> DataFrame:
    """docs with every secret of the text replaced by mask; spans that overlap or touch count as one.

    Each row is masked by its own text, in one pass without a join: rows without an id or with a repeated one are masked
    like all others. Null texts stay null, texts without secrets stay as they are; an empty table gives no rows.
    """
    ratios = train(docs, docs.columns[0], text_col) if ratios is None else ratios

    def make():
        spans = _finder(ratios, per_char, total)

        def masked(raw):
            if raw is None:
                return None
            text, out, at = raw.decode(), [], -1
            for start, _, end in spans(raw):
                if start > at:
                    out += [text[max(at, 0) : start], mask]
                at = max(at, end)
            return "".join(out) + text[max(at, 0) :] if out else text

        return lambda texts: [masked(t) for t in texts]

    return map_rows(docs, make, text_col)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of find_secrets' rows."""
    text = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(text(base), 256).alias("base_sha256"), text("spans").alias("spans"), count("markov"))
