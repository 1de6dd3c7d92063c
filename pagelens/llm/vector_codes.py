"""Product codes of vectors, trained and assigned in whole numbers, with segment-mean lower bounds as the filter.

A vector is cut into equal parts; each part gets the index of the nearest entry of its position's codebook. A part is
looked at coarse to fine: the means of its blocks and the norms of what the blocks leave beside their means bound the
distance to an entry from below, |x - c|^2 >= sum over blocks of size * (mean_x - mean_c)^2 + (rest_x - rest_c)^2. Entries
whose bound is over the exact distance to the most promising one are out; blocks are halved for those left, and only
what survives all levels gets an exact distance. Bounds are floats with a slack above their rounding errors, so that no
nearest entry is lost; distances, sums and means are whole numbers throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Vectors that are assigned together, and the largest value of the codes' errors.
ROWS = 4096
MAX_LONG = (1 << 63) - 1
#: Sums are sent in digits of so many bits, one digit where all of them fit into 64.
DIGIT = 40


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, x, label) of the rows whose vector is there and has finite components only."""
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).alias("label"))
    return rows.where(F.col("x").isNotNull() & ~F.exists("x", bad))


class Scale:
    """How components become whole numbers: width of all vectors, their largest value, and the type that holds all sums."""

    def __init__(self, parts: int, longest: int, largest: float, scale: int):
        self.parts, self.scale = parts, scale
        self.width = -(-longest // parts)
        self.most = max(1, abs(int(largest)) * scale + scale)
        self.narrow = 4 * max(1, self.width) * self.most**2 < 1 << 54
        self.digits = 1 if self.narrow else self.most.bit_length() // DIGIT + 1

    def whole(self, column: pa.Array) -> np.ndarray:
        """floor(scale * x) of a batch of vectors as (rows, parts, width); shorter vectors end in zeros."""
        lengths = column.value_lengths().to_numpy().astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if self.narrow:
            values, out = np.floor(flat * self.scale).astype(np.int64), np.zeros((len(column), self.parts * self.width), np.int64)
        else:  # from 2^53 on a double is whole already
            values = np.array([int(x) * self.scale if abs(x) >= 1 << 53 else int(np.floor(x * self.scale)) for x in flat.tolist()], object)
            out = np.zeros((len(column), self.parts * self.width), object)
        out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
        return out.reshape(len(column), self.parts, self.width)


class Codebook:
    """The entries of one part position, (entries, width) whole numbers, with what the bounds need of them.

    compared counts pairs of part and entry, exact those whose distance was computed.
    """

    compared = exact = 0

    def __init__(self, entries: np.ndarray, most: int):
        self.entries, self.most = entries, most
        width, self.starts = entries.shape[1], []
        step = width
        while width and (step > 1 or not self.starts):
            self.starts.append(np.arange(0, width, step))
            step = -(-step // 2)
        self.sizes = [np.diff(np.append(s, width)) for s in self.starts]
        self.slack = width * 2.0**-44
        self.levels = self._levels(entries)

    def _levels(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each level the blocks' means and the norms of the rest, in shares of the largest component."""
        share, out = (x / self.most).astype(np.float64), []
        for starts, sizes in zip(self.starts, self.sizes, strict=True):
            means = np.add.reduceat(share, starts, axis=1) / sizes
            rest = share - np.repeat(means, sizes, axis=1)
            out.append((means, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))))
        return out

    def _bound(self, level: int, x: tuple[np.ndarray, np.ndarray], c: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return (self.sizes[level] * (x[0] - c[0]) ** 2 + (x[1] - c[1]) ** 2).sum(axis=-1)

    def _distance(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        gap = x - self.entries[at]
        return (gap * gap).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each row's nearest entry (ties: the lower one) and the squared distance."""
        n, k = len(x), len(self.entries)
        if not self.starts:
            return np.zeros(n, np.int64), np.zeros(n, x.dtype)
        levels = self._levels(x)
        bound = self._bound(0, tuple(y[:, None] for y in levels[0]), tuple(y[None] for y in self.levels[0]))
        limit = (self._distance(x, bound.argmin(axis=1)) / self.most**2).astype(np.float64) + self.slack
        row, at = np.nonzero(bound <= limit[:, None])
        for level in range(1, len(self.starts)):
            keep = self._bound(level, tuple(y[row] for y in levels[level]), tuple(y[at] for y in self.levels[level])) <= limit[row]
            row, at = row[keep], at[keep]
        self.compared += n * k
        self.exact += len(row) + n
        key = self._distance(x[row], at) * k + at
        best = np.minimum.reduceat(key, np.flatnonzero(np.diff(row, prepend=-1)))
        return (best % k).astype(np.int64), best // k


def _assigned(books: list[Codebook], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and distances of a batch."""
    found = [book.nearest(whole[:, j]) for j, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), ROWS):
            yield batch.slice(lo, ROWS)


def refine(kept: DataFrame, scale: Scale, entries: np.ndarray) -> np.ndarray:
    """One round: all parts are assigned to entries (parts, entries, width), used entries become their parts' floored mean."""
    parts, k, width = entries.shape
    names = [f"s{i}" for i in range(width * scale.digits)]

    def add_up(batches):
        books, total, n = [Codebook(e, scale.most) for e in entries], np.zeros_like(entries), np.zeros((parts, k), np.int64)
        for batch in _slices(batches):
            whole = scale.whole(batch.column(0))
            codes, _ = _assigned(books, whole)
            for j in range(parts):
                order = np.argsort(codes[:, j], kind="stable")
                used, first = np.unique(codes[order, j], return_index=True)
                if width:
                    total[j, used] += np.add.reduceat(whole[order, j], first, axis=0)
                n[j] += np.bincount(codes[:, j], minlength=k)
        slot = np.flatnonzero(n.ravel())
        left, columns = total.reshape(parts * k, width)[slot], []
        for _ in range(scale.digits - 1):
            columns += list((left & ((1 << DIGIT) - 1)).T)
            left = left >> DIGIT
        columns += list(left.T)
        yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(n.ravel()[slot]), *(pa.array(c.astype(np.int64)) for c in columns)], names=["slot", "n", *names])

    sums = kept.select("x").mapInArrow(add_up, ", ".join(["slot int", "n long", *(f"{c} long" for c in names)])).groupBy("slot").agg(F.sum("n"), *(F.sum(c) for c in names))
    out = entries.copy()
    for slot, n, *digits in sums.collect():  # a row for each entry that is used
        for i in range(width):
            out[slot // k, slot % k, i] = sum(d << (DIGIT * e) for e, d in enumerate(digits[i::width])) // n
    return out


def digest(entries: np.ndarray) -> str:
    """Lower-case hex SHA-256 of all components as decimal text, by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()


def train(kept: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[Scale, np.ndarray] | None:
    """Scale and codebooks (parts, entries, width) of kept_vectors; None where there are none.

    The entries start as the parts of the vectors of smallest id (of repeated ids the smaller vector first, null ids
    last), as many as there are; an entry that no part is assigned to stays.
    """
    size, largest = kept.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if size is None:
        return None
    how = Scale(parts, size, largest or 0.0, scale)
    seeds = kept.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()  # `entries` rows
    now = np.ascontiguousarray(how.whole(pa.array([r.x for r in seeds], pa.list_(pa.float64()))).transpose(1, 0, 2))
    for _ in range(rounds):
        now = refine(kept, how, now)
    return how, now


def assign(kept: DataFrame, scale: Scale, entries: np.ndarray) -> DataFrame:
    """(vec_id, code, error, label): each part's nearest entry as two hex digits, and the squared distances' sum."""
    hexes = np.array([f"{i:02x}" for i in range(256)])

    def run(batches):
        books = [Codebook(e, scale.most) for e in entries]
        for batch in _slices(batches):
            codes, far = _assigned(books, scale.whole(batch.column(1)))
            error = far.sum(axis=1) if scale.narrow else np.minimum(far.sum(axis=1), MAX_LONG)
            text = ["".join(row) for row in hexes[codes].tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(error.astype(np.int64)), batch.column(2)], names=["vec_id", "code", "error", "label"])

    label = next(f for f in kept.schema if f.name == "label").dataType.simpleString()
    return kept.select("vec_id", "x", "label").mapInArrow(run, f"vec_id long, code string, error long, label {label}")


def _long(total: Column) -> Column:
    return F.least(total, F.lit(MAX_LONG).cast("decimal(38,0)")).cast("long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """Codes of all vectors: (vec_id, code, error, label_error, codebooks_sha256).

    Rows whose vector is null or has null or non-finite components are dropped. Vectors are as long as the longest, up
    to a multiple of parts: shorter ones end in zeros. With fewer vectors than entries there are fewer entries. Rows that
    repeat, and rows without an id, are coded each. label_error adds up the errors of equal labels, nulls together;
    errors and sums beyond 64 bits are the largest long. Other columns are ignored; an empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    model = train(kept, parts, entries, rounds, scale)
    if model is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = materialize(assign(kept, *model), "vector-codes")
    sums = coded.groupBy("label").agg(_long(F.sum(F.col("error").cast("decimal(28,0)"))).alias("label_error")).withColumnRenamed("label", "of_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(model[1])).alias("codebooks_sha256"))
