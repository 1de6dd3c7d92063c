"""Product codes of vectors against brute force in whole numbers of any size."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from pagelens.llm import vector_codes as V


def brute(rows, parts, entries, rounds):
    """{(vec_id, nth of that id): (code, error, label_error)} and the digest, by all distances."""
    rows = [(i, v, label) for i, v, label in rows if v is not None and None not in v and all(math.isfinite(x) for x in v)]
    width = -(-max(len(v) for _, v, _ in rows) // parts)
    whole = [[math.floor(Fraction(x) * 256) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in rows]
    cut = [[w[j * width : (j + 1) * width] for j in range(parts)] for w in whole]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    books = [[list(cut[i][j]) for i in order[:entries]] for j in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min((far(part, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for j, book in enumerate(books):
            own = {}
            for w in cut:
                own.setdefault(near(w[j], book)[1], []).append(w[j])
            for i, members in own.items():
                book[i] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    found = [[near(w[j], book) for j, book in enumerate(books)] for w in cut]
    most = (1 << 63) - 1
    error = [min(most, sum(f[0] for f in row)) for row in found]
    by_label = {}
    for (_, _, label), e in zip(rows, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{f[1]:02x}" for f in row), e, min(most, by_label[label])) for (i, _, label), row, e in zip(rows, found, error, strict=True)), digest


def table(spark, rows):
    schema = "vec_id long, embedding array<double>, label int, code string, x int, error long"
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], schema)


def vectors(n, width, scale, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width)) * scale
    rows = [(i, [float(x) for x in centres[i % 5] + rng.normal(size=width) * scale / 4], None if i % 3 == 0 else i % 4) for i in range(n)]
    rows += [(i + n, rows[i][1], 2) for i in range(10)]  # copies
    return rows + [(n + 10, None, 1), (n + 11, [1.0, None] * (width // 2), 1), (n + 12, [float("nan")] * width, 1), (n + 13, [float("inf")] * width, None), (None, rows[1][1], 9), (0, rows[2][1], None)]


@pytest.mark.parametrize("width,scale,parts,entries", [(64, 0.5, 16, 64), (10, 3.0, 2, 7), (7, 40.0, 3, 300 // 5), (16, 1e5, 16, 8), (8, 1e30, 4, 6), (6, 1e200, 2, 3)])
def test_codes_against_brute_force(spark, width, scale, parts, entries):
    rows = vectors(150, width, scale, width)
    random.Random(1).shuffle(rows)
    got = V.compress(table(spark, rows), parts=parts, entries=entries).collect()
    want, digest = brute(rows, parts, entries, 2)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_few_uneven_and_no_vectors(spark):
    rows = [(3, [1.0, -2.0], 1), (4, [], 1), (5, [0.5] * 5, None), (5, [0.5] * 5, None), (6, None, 1)]
    got = V.compress(table(spark, rows), parts=2).collect()
    want, digest = brute(rows, 2, 64, 2)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in got) == want and got[0].codebooks_sha256 == digest
    empty = V.compress(table(spark, [(1, [], None), (2, [], 4)])).collect()
    assert [(r.code, r.error, r.label_error) for r in empty] == [("00" * 16, 0, 0)] * 2
    assert V.compress(table(spark, rows[4:])).count() == 0 and V.compress(table(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        V.compress(table(spark, rows), entries=257)


@pytest.mark.parametrize("width,steps", [(1, 3), (2, 50), (4, 2), (13, 900), (32, 5)])
def test_bounds_keep_every_nearest_entry(width, steps):
    """Small ranges give many ties; the filter leaves out most exact distances on clustered parts."""
    rng = np.random.default_rng(width)
    entries, x = rng.integers(-steps, steps + 1, (64, width)), rng.integers(-steps, steps + 1, (2000, width))
    x[:500] = entries[rng.integers(0, 64, 500)]
    book = V.Codebook(entries, steps + 1)
    at, far = book.nearest(x)
    all_of = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (at == all_of.argmin(axis=1)).all() and (far == all_of.min(axis=1)).all()
    smooth = V.Codebook(np.sort(rng.integers(0, 1000, (64, 1)), axis=0) + rng.integers(0, 9, (64, width)), 1100)
    smooth.nearest(rng.integers(0, 1000, (2000, 1)) + rng.integers(0, 9, (2000, width)))
    assert smooth.exact < 0.2 * smooth.compared
