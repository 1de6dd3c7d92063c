"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are rows labelled 1; unlabelled text is any row that carries no label. The risk of a classifier g is
prior * E_P[loss(g)] + max(0, E_U[loss(-g)] - prior * E_P[loss(-g)]): the negative part is never let under zero. g is
linear over measures of the whole text, each cut into quantile bins, and over shares of hashed byte pairs and words; it
is fitted by Adam on a bounded sample. The class prior is estimated from the positives and the unlabelled texts alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts

MEASURES = ("bytes", "words", "word_bytes", "upper", "digit", "space", "wide", "symbol", "distinct", "top_word", "repeat", "lines", "same_lines", "marked_words", "short_words", "long_words", "same_pairs", "ends")
#: Buckets that byte pairs and words are hashed to.
PAIRS, WORDS = 192, 64
FEATURES = len(MEASURES) + PAIRS + WORDS
_PAIR = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(PAIRS)


def features(text: bytes | None) -> np.ndarray:
    """The measures of a text, then square roots of the shares of its hashed byte pairs and words; defined for empty texts too."""
    raw = np.frombuffer(text or b"", np.uint8)
    n = max(1, len(raw))
    count = np.bincount(raw, minlength=256)
    words = (text or b"").split()
    m = max(1, len(words))
    low = (text or b"").lower().split()
    seen: dict[bytes, int] = {}
    for w in low:
        seen[w] = seen.get(w, 0) + 1
    lines = (text or b"").split(b"\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    out = np.zeros(FEATURES, np.float32)
    out[: len(MEASURES)] = (
        np.log1p(len(raw)),
        np.log1p(len(words)),
        float(sizes.sum()) / m,
        count[65:91].sum() / max(1, letters),
        count[48:58].sum() / n,
        (count[32] + count[9:14].sum()) / n,
        count[128:].sum() / n,
        (count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()) / n,
        len(seen) / m,
        max(seen.values(), default=0) / m,
        sum(a == b for a, b in zip(low, low[1:])) / m,
        np.log1p(len(lines)) - np.log1p(len(words)),
        1 - len(set(lines)) / len(lines),
        sum(not w[-1:].isalpha() and w[-1] < 128 for w in words) / m,
        float((sizes <= 3).sum()) / m,
        float((sizes >= 12).sum()) / m,
        1 - len(set(zip(low, low[1:]))) / m,
        sum(line.rstrip()[-1:] in (b".", b"!", b"?", b":") for line in lines) / len(lines),
    )
    if len(raw) > 1:
        pairs = np.bincount(raw[:-1].astype(np.int64) << 8 | raw[1:], minlength=65536)
        out[len(MEASURES) : len(MEASURES) + PAIRS] = np.sqrt(np.bincount(_PAIR.astype(np.int64), weights=pairs, minlength=PAIRS) / (n - 1))
    if seen:
        buckets = np.fromiter((xxhash.xxh3_64_intdigest(w) % WORDS for w in seen), np.int64, len(seen))
        out[len(MEASURES) + PAIRS :] = np.sqrt(np.bincount(buckets, weights=np.fromiter(seen.values(), float, len(seen)), minlength=WORDS) / m)
    return out


@dataclass
class Model:
    cuts: np.ndarray  # (measures, bins - 1)
    weights: np.ndarray  # (measures * bins)
    hashed: np.ndarray  # (pairs + words)
    centre: np.ndarray  # means of the hashed shares
    bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of feature rows."""
        return self.weights[_binned(x, self.cuts)].sum(axis=1) + (x[:, len(MEASURES) :] - self.centre) @ self.hashed + self.bias


def _binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Place of every feature's bin in the weights: (rows, features)."""
    bins = cuts.shape[1] + 1
    return np.stack([np.searchsorted(c, x[:, j], "right") + j * bins for j, c in enumerate(cuts)], axis=1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk's positive part and its negative part before that is cut at zero, of log-odds on positives and unlabelled."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the non-negative risk by each log-odds; where the negative part is under zero, those that lead back up."""
    if risk(zp, zu, prior)[1] < 0:
        return prior * _sigmoid(zp) / len(zp), -_sigmoid(zu) / len(zu)
    return -prior * (1 - _sigmoid(zp)) / len(zp) - prior * _sigmoid(zp) / len(zp), _sigmoid(zu) / len(zu)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, bins: int = 12, steps: int = 2000, batch: int = 1024, rate: float = 0.05, decay: float = 2e-5, seed: int = 1) -> Model:
    """Minimises the non-negative unbiased risk with the logistic loss; positives and unlabelled are feature rows."""
    both = np.concatenate((positive, unlabelled))
    cuts = np.quantile(both[:, : len(MEASURES)], np.arange(1, bins) / bins, axis=0).T
    centre = both[:, len(MEASURES) :].mean(axis=0)
    p, u = _binned(positive, cuts), _binned(unlabelled, cuts)
    hp, hu = positive[:, len(MEASURES) :] - centre, unlabelled[:, len(MEASURES) :] - centre
    size, n = len(MEASURES) * bins, PAIRS + WORDS
    w, rng = np.zeros(size + n + 1), np.random.default_rng(seed)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        i, j = rng.integers(0, len(p), min(batch, len(p))), rng.integers(0, len(u), min(batch, len(u)))
        zp, zu = (w[x].sum(axis=1) + h @ w[size:-1] + w[-1] for x, h in ((p[i], hp[i]), (u[j], hu[j])))
        gp, gu = slopes(zp, zu, prior)
        grad = np.bincount(np.concatenate((p[i].ravel(), u[j].ravel())), weights=np.concatenate((np.repeat(gp, p.shape[1]), np.repeat(gu, u.shape[1]))), minlength=len(w))
        grad[size:-1] = gp @ hp[i] + gu @ hu[j]
        grad[-1] = gp.sum() + gu.sum()
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(cuts, w[:size], w[size:-1], centre, float(w[-1]), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.2) -> float:
    """The share of positives among unlabelled rows: the least ratio of the rates at which both pass a threshold.

    Whatever the threshold, unlabelled rows pass at least at prior times the positives' rate. A classifier of the one
    against the other, fitted on half of the rows, gives thresholds on the other half; those that under least_share of
    the positives pass are left out, and a ratio counts with its standard error, for the least of many is too low.
    """
    if min(len(positive), len(unlabelled)) < 20:
        return 0.5
    found = []
    for half in (0, 1):
        p, u = positive[half::2], unlabelled[half::2]
        model = fit(p, u, 0.5, steps=600)
        zp, zu = np.sort(model.margin(positive[1 - half :: 2])), np.sort(model.margin(unlabelled[1 - half :: 2]))
        limits = np.quantile(zp, np.linspace(0, 1 - least_share, 41))
        pass_p, pass_u = (1 - np.searchsorted(z, limits) / len(z) for z in (zp, zu))
        sure = np.sqrt(pass_u * (1 - pass_u) / len(zu) + (pass_u / pass_p) ** 2 * pass_p * (1 - pass_p) / len(zp)) / pass_p
        found.append(np.min(pass_u / pass_p + sure))
    return float(np.clip(np.mean(found), 0.05, 0.95))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positive: int = 20_000, max_unlabelled: int = 20_000) -> Model | None:
    """A model from documents and the labels that may be learned from; None if there is no positive or no other text.

    Of labelled positives and of unlabelled documents at most about the given numbers are taken, by a hash of the id.
    The class prior is estimated from both samples, and kept within 0.05 and 0.95; labels of 0 are not used.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    n, good = marks.agg(F.count("*"), F.sum((F.col("y") == 1).cast("int"))).first()
    if not good:
        return None
    total = docs.count()
    scale = 1 << 20
    share = lambda most, of: max(1, min(scale, int(scale * most / max(1, of))))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(scale))
    rows = id_and_text(docs, id_col, text_col)
    positive = rows.where(drawn < share(max_positive, good)).join(marks.where("y = 1").select("doc_id"), "doc_id", "left_semi")  # drawn before the shuffle
    unlabelled = rows.where(drawn < share(max_unlabelled, total - n)).join(marks.select("doc_id"), "doc_id", "left_anti")

    def matrix(df: DataFrame) -> np.ndarray:
        make = lambda: lambda ids, texts: [[features(t).tobytes() for t in texts]]
        rows = map_texts(df, make, "x binary").toArrow()["x"]
        return np.frombuffer(b"".join(sorted(x.as_py() for x in rows)), np.float32).reshape(-1, FEATURES)

    p, u = matrix(positive), matrix(unlabelled)
    if not len(u):
        return None
    rng = np.random.default_rng(3)
    p, u = rng.permutation(p), rng.permutation(u)
    return fit(p, u, estimate_prior(p, u))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row; score is in [0, 1], predicted 1 from threshold on.

    Null and empty texts are scored by their features like any other. Without a model every score is 0.5. Repeated
    rows and null ids give a row each; other columns are ignored; an empty table gives no rows. A single pass.
    """
    rows = id_and_text(docs, id_col, text_col)

    def make():
        def call(ids, texts):
            if model is None:
                s = np.full(len(ids), 0.5)
            else:
                s = _sigmoid(model.margin(np.stack([features(t) for t in texts])))
            return [ids, s, (s >= threshold).astype(np.int32)]

        return call

    return map_texts(rows, make, "doc_id long, score double, predicted int")
