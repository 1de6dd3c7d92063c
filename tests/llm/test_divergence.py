"""The source divergence audit against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, min_docs, k):
    """(lang, source, part, item, value, rank) of rows (text, lang, source), all terms against all groups."""
    docs = [(TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")), lang or "", source or "") for text, lang, source in rows]
    by_lang, by_group, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for words, lang, source in docs:
        by_lang[lang].update(words)
        by_group[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang in by_lang:
        kept = [t for t in by_lang[lang] if seen[lang][t] >= min_docs]
        prob = lambda n: {t: 1 + 10**9 * (n[t] + 1) // (sum(n[x] for x in kept) + len(kept)) for t in kept}  # noqa: E731,B023
        q = prob(by_lang[lang])
        groups = {source: prob(n) for (x, source), n in by_group.items() if x == lang}
        for source, p in groups.items():
            pairs = [(-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), other.encode()) for other, o in groups.items() if other != source]
            terms = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if by_group[lang, source][t] and p[t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, k)):
                out += [(lang, source, part, item.decode(), -value, i + 1) for i, (value, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def made():
    """Groups of very uneven size, terms of many counts, ties, and all that a text may hold or lack."""
    rnd, rows = random.Random(5), []
    for i in range(240):
        lang, source = ("en", "fr", None)[i % 3], ("hot", "hot", "b", "c", "ü", None)[rnd.randrange(6)]
        words = [f"{rnd.choice('abcdefgh')}{'xyz'[rnd.randrange(3)] * rnd.randrange(1, 4)}{source or ''}" if rnd.random() < 0.5 else f"w{chr(97 + int(rnd.expovariate(0.3)) % 26)}" for _ in range(rnd.randrange(80))]
        rows.append((" ".join(words), lang, source))
    rows += [(None, "en", "none"), ("", "en", "blank"), ("12 ?! _[]", "en", "marks"), ("Ünï ÜNÏ İ ſ K 漢字\U0001f600x", "fr", "ü"), ("only here", "de", "one"), (None, "it", "x"), (None, "it", "y")]
    return rows + rows[:3]


def spark_rows(spark, rows):
    return spark.createDataFrame([(t, x, s, 5, "v", 1.0, 7) for t, x, s in rows], "text string, lang string, source string, n long, term string, p double, bucket int")


@pytest.mark.parametrize("min_docs,k", [(3, 200), (1, 3)])
def test_audit_against_brute_force(spark, min_docs, k):
    rows = made()
    got = sorted(tuple(r) for r in D.audit(spark_rows(spark, rows), min_docs=min_docs, k=k).collect())
    assert got == brute(rows, min_docs, k)
    assert {(r[0], r[1]) for r in got} >= {("en", "none"), ("en", "marks"), ("", ""), ("it", "x")}


def test_rounds_stop_before_all_terms(spark):
    """The best few are found in several rounds, without evaluating every posting."""
    rnd = random.Random(9)
    rows = [(" ".join(f"{chr(97 + int(rnd.paretovariate(0.4)) % 26)}{chr(97 + int(rnd.paretovariate(0.2)) % 26)}" for _ in range(300)), "en", f"s{i % 4}") for i in range(60)]
    index = D.term_index(spark_rows(spark, rows).select("text", "lang", "source"))
    postings = D.term_postings(index, D.group_totals(index))
    top, work = D.top_terms(postings, k=5, first=1, growth=2)
    want = [r for r in brute(rows, 3, 5) if r[2] == "term"]
    assert sorted((r.lang, r.source, r.term, r.value, r["rank"]) for r in top.collect()) == [(r[0], r[1], r[3], r[4], r[5]) for r in want]
    assert work["rounds"] > 1 and work["evaluated"] < postings.count() / 2


def test_audit_of_nothing(spark):
    assert D.audit(spark_rows(spark, [("a", "b", "c")]).where("false")).count() == 0


def test_long_texts_and_full_tasks(spark, monkeypatch):
    text = "Alpha beta, " * 30 + "gamma"
    monkeypatch.setattr(D, "MAX_BYTES", 7)
    assert [w for part in D.terms_of(text.encode()) for w in part] == [w.lower().encode() for w in TERM.findall(text)]
    assert list(D.terms_of(b" ")) in ([], [[]]) and list(D.terms_of(None)) == []


def test_small_chunks_of_pairs_give_the_same_sums(monkeypatch):
    rng = np.random.default_rng(1)

    class Row:
        def __init__(self, lang, source, total):
            self.lang, self.source, self.total, self.kept = lang, source, total, 9

    groups = D._Groups([Row("en", f"s{i}", int(rng.integers(0, 50))) for i in range(7)])
    sizes = np.array([3, 1, 7, 2])
    at = np.concatenate([rng.permutation(7)[:n] for n in sizes])
    p = rng.integers(1, 10**9, len(at))
    whole = sum(s for x in D._two_sided(groups, at, p, sizes) for s in x.to_numpy())
    monkeypatch.setattr(D, "MAX_PAIRS", 5)
    assert sum(s for x in D._two_sided(groups, at, p, sizes) for s in x.to_numpy()) == whole


def test_shares_are_exact(spark):
    rng = random.Random(2)
    pairs = [(c := rng.randrange(10**e), c + rng.randrange(1, 10**e)) for e in range(1, 16) for _ in range(20)]
    want = [1 + 10**9 * (c + 1) // t for c, t in pairs]
    assert D.shares(np.array([c for c, _ in pairs]), np.array([t for _, t in pairs])).tolist() == want
    found = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(pairs)], "i int, c long, t long").select("i", F.expr(D.share("c", "t")).alias("p"))
    assert [r.p for r in found.orderBy("i").collect()] == want
