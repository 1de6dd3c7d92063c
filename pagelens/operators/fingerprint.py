"""The 32-bit FNV-1a of all lines of a table in order, joined by line feeds, as if they were one text.

A character changes the hash by h -> ((h xor c) * prime) mod 2^32. The xor touches only the low bits that c has, so what
a run of characters does to a hash is known from what it does to each value of those low bits, and from prime to the
power of the run's length for all bits above: h -> table[low(h)] + (h - low(h)) * power. Such functions follow one
another in the same form. So ranges of lines are folded where they lie, each to a table of bounded size, and the tables
are joined in order, level by level; no text and no line goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.plans.scratch import materialize

# Fixed values of FNV-1a with 32 bits.
PRIME, BASIS = 0x01000193, 0x811C9DC5
ALL = (1 << 32) - 1
#: Lines that are folded at once, and tables that one step joins.
LINES, STEP = 512, 64


class Fold:
    """What a run of characters does to a hash: table over the low `bits` bits (8 or 16) and the power for those above."""

    def __init__(self, table: np.ndarray, power: int):
        self.table, self.power = table.astype(np.uint32), power & ALL

    @property
    def bits(self) -> int:
        return len(self.table).bit_length() - 1

    @staticmethod
    def none() -> Fold:
        return Fold(np.arange(256, dtype=np.uint32), 1)

    def wide(self) -> Fold:
        """The same over 16 bits."""
        if self.bits == 16:
            return self
        low = np.arange(1 << 16, dtype=np.uint32)
        return Fold(self.table[low & 255] + (low & np.uint32(0xFF00)) * np.uint32(self.power), self.power)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        low = h & np.uint32(len(self.table) - 1)
        return self.table[low] + (h - low) * np.uint32(self.power)

    def then(self, other: Fold) -> Fold:
        first, second = (self, other) if self.bits == other.bits else (self.wide(), other.wide())
        return Fold(second(first.table), first.power * second.power)


def fold_lines(lines: list[str]) -> Fold:
    """Of lines, each with a line feed before it; characters beyond 16 bits are two, as in UTF-16."""
    out = Fold.none()
    units = [np.frombuffer(("\n" + line).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32) for line in lines]
    sizes = np.array([len(u) for u in units], np.int64)
    narrow = np.array([not len(u) or u.max() < 256 for u in units])
    at = 0
    while at < len(units):
        if not narrow[at]:
            states = np.arange(1 << 16, dtype=np.uint32)
            for c in units[at]:
                states = (states ^ c) * np.uint32(PRIME)
            out, at = out.then(Fold(states, pow(PRIME, int(sizes[at]), 1 << 32))), at + 1
            continue
        to = at
        while to < len(units) and narrow[to] and to - at < LINES:
            to += 1
        order = np.argsort(-sizes[at:to], kind="stable")  # longest first: those that still have characters come first
        states = np.tile(np.arange(256, dtype=np.uint32), (to - at, 1))
        own = [units[at + i] for i in order]
        lengths = sizes[at:to][order]
        for i in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -i, "left"))
            states[:n] = (states[:n] ^ np.fromiter((u[i] for u in own[:n]), np.uint32, n)[:, None]) * np.uint32(PRIME)
        tables = states[np.argsort(order, kind="stable")]
        out = reduce(Fold.then, (Fold(t, pow(PRIME, int(n), 1 << 32)) for t, n in zip(tables, sizes[at:to], strict=True)), out)
        at = to
    return out


def ordered_fnv1a(df: DataFrame, line: Column, *order: str | Column) -> DataFrame:
    """(hash, lines) of a table's lines in order, joined by line feeds; lines that tie in the order are told apart by themselves.

    hash is eight hexadecimal digits; null lines are empty ones; no lines have the hash of the empty text.
    """
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    rows = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.coalesce(line.cast("string"), F.lit("")).alias("line"))
    by = [F.col(c).asc_nulls_first() for c in rows.columns]
    ranged = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("line")
    schema = "part long, n long, power long, fold binary"

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = Fold.none(), 0
        for batch in batches:
            lines = batch.column(0).to_pylist()
            out, n = out.then(fold_lines(lines)), n + len(lines)
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64()), "power": pa.array([out.power], pa.int64()), "fold": pa.array([out.table.tobytes()], pa.binary())})

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("part")
        folds = [Fold(np.frombuffer(t, np.uint32), int(p)) for t, p in zip(part["fold"], part["power"], strict=True)]
        out = reduce(Fold.then, folds)
        return pd.DataFrame({"part": [int(part["part"].iloc[0]) // STEP], "n": [int(part["n"].sum())], "power": [out.power], "fold": [out.table.tobytes()]})

    level = materialize(ranged.mapInArrow(fold, schema), "folds")
    widest = level.agg(F.max("part")).first()[0] or 0
    while widest >= STEP:
        level = level.groupBy(F.floor(F.col("part") / STEP)).applyInPandas(join, schema)
        widest //= STEP
    last = level.orderBy("part").collect()  # at most STEP tables
    # the hash that a line feed turns into the basis, so that the first line's line feed does not count
    before = ((BASIS * pow(PRIME, -1, 1 << 32)) & ALL) ^ 10
    state = np.array([before if last else BASIS], np.uint32)
    for r in last:
        state = Fold(np.frombuffer(r.fold, np.uint32), r.power)(state)
    return df.sparkSession.createDataFrame([(f"{int(state[0]):08x}", sum(r.n for r in last))], "hash string, lines long")
