"""Best-fit packing of token sequences: a configuration linear program over the length histogram.

A configuration says how many pieces of each length fill one sequence. The program (least sequences that cover every
length's count) is solved by multiplicative weights: each length has a price, a bounded knapsack dynamic program finds
the configurations of highest price for the lengths that are least covered, and the prices of what they cover fall,
until the solution's value is near its dual's. The fractional solution is rounded to whole configurations, the rest is
solved again, and the shortest pieces, set aside for that, fill the rooms that are left by best fit. All of this sees
only the histogram, of at most `capacity` lengths; pieces are assigned to configurations by their rank among the pieces
of equal length, a shuffle-free lookup.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text, map_texts, materialize
from .tokens import default_tokenizer, encoder


def pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): rank counts equal lengths within the partition part."""

    def make():
        encode, seen, part = encoder(tokenizer).encode, {}, TaskContext.get().partitionId()

        def call(ids, texts):
            flat, lengths = encode(texts)
            out, at = [], 0
            for doc, n in zip(ids, lengths.tolist(), strict=True):
                own = np.append(flat[at : at + n], np.uint32(end_id)).astype("<u4")
                at += n
                for i, start in enumerate(range(0, len(own), capacity)):
                    piece = own[start : start + capacity]
                    rank = seen.get(len(piece), 0)
                    seen[len(piece)] = rank + 1
                    out.append((doc, i, start, len(piece), zlib.crc32(piece.tobytes()), part, rank))
            return [list(c) for c in zip(*out, strict=True)] or [[]] * 7

        return call

    return map_texts(docs, make, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


class Knapsack:
    """Bounded knapsack over lengths: the best value of every capacity, and the pieces that make it."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[tuple[int, int]] = []  # (length's place, copies), copies split into powers of two
        for j, (length, n) in enumerate(zip(lengths.tolist(), counts.tolist(), strict=True)):
            left, copies = min(n, capacity // length), 1
            while left:
                take = min(copies, left)
                self.items.append((j, take))
                left -= take
                copies *= 2
        self.taken = np.zeros((len(self.items), capacity + 1), bool)

    def solve(self, prices: np.ndarray) -> np.ndarray:
        """The highest total price that fits in each capacity from 0 on."""
        best = np.zeros(self.capacity + 1)
        for i, (j, copies) in enumerate(self.items):
            size = int(self.lengths[j]) * copies
            other = best[:-size] + prices[j] * copies
            np.greater(other, best[size:], out=self.taken[i, size:])
            np.maximum(other, best[size:], out=best[size:])
        return best

    def configurations(self, rooms: np.ndarray) -> np.ndarray:
        """For each of the rooms (capacities), how many pieces of each length the last solution's best filling has."""
        out, rooms = np.zeros((len(rooms), len(self.lengths)), np.int64), rooms.copy()
        for i in range(len(self.items) - 1, -1, -1):
            j, copies = self.items[i]
            use = np.flatnonzero(self.taken[i, rooms])
            if len(use):
                out[use, j] += copies
                rooms[use] -= int(self.lengths[j]) * copies
        return out


@dataclass
class Program:
    """An approximate solution: configurations (places, pieces of each) with their fractions, its value and the dual's."""

    columns: dict[tuple[tuple[int, ...], tuple[int, ...]], float]
    value: float
    bound: float


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float, rounds: int, roots: int = 16, levels: int = 10, eta: float = 0.7) -> Program:
    """The configuration program by multiplicative weights, until value <= (1 + gap) * bound or the rounds are over.

    A length's price starts at its share of a sequence and falls by a factor for all that covers it beyond the least
    covered one. Prices over the dearest configuration's are a dual solution, whose value bounds the program from below.
    Each round takes the dearest configurations that hold one of the least covered lengths.
    """
    bag, rng = Knapsack(lengths, counts, capacity), np.random.default_rng(7)
    cover, columns, total, bound, value = np.zeros(len(lengths)), {}, 0.0, 0.0, np.inf
    for _ in range(rounds):
        prices = lengths / capacity * np.exp(-eta * levels * (cover - cover.min())) * (1 + 1e-6 * rng.random(len(lengths)))
        best = bag.solve(prices)
        bound = max(bound, float(counts @ prices) / best[capacity])
        least = np.argsort(cover, kind="stable")[:roots]
        configs = bag.configurations(capacity - lengths[least])
        configs[np.arange(len(least)), least] += 1
        configs = np.minimum(configs, counts)
        step = counts[least] / configs[np.arange(len(least)), least] / levels
        gain = step @ configs / counts
        shrink = min(1.0, 1.5 / levels / gain.max())
        cover, total = cover + gain * shrink, total + step.sum() * shrink
        for row, x in zip(configs, step * shrink, strict=True):
            places = np.flatnonzero(row)
            key = (tuple(places.tolist()), tuple(row[places].tolist()))
            columns[key] = columns.get(key, 0.0) + float(x)
        if cover.min() > 0:
            value = total / cover.min()
            if value <= bound * (1 + gap):
                break
    return Program({k: x / max(cover.min(), 1e-9) for k, x in columns.items()}, value, bound)


class Bins:
    """Lengths in descending order, in bins of about equally many pieces; a bin is as long as its longest piece."""

    def __init__(self, left: dict[int, int], bins: int):
        self.all = np.array(sorted((x for x, n in left.items() if n), reverse=True), np.int64)
        self.n = np.array([left[x] for x in self.all.tolist()], np.int64)
        ends = np.cumsum(self.n)
        self.first = np.flatnonzero(np.diff((ends - self.n) * bins // max(1, ends[-1] if len(ends) else 1), prepend=-1))
        self.lengths, self.counts = self.all[self.first], np.add.reduceat(self.n, self.first) if len(self.first) else self.n
        self.at = self.first.tolist()

    def spare(self) -> int:
        """What the pieces lack, in all, to be as long as their bins."""
        return int((self.lengths * self.counts).sum() - (self.all * self.n).sum())

    def take(self, bins: tuple[int, ...], pieces: tuple[int, ...], times: int) -> Iterator[tuple[dict[int, int], int]]:
        """Configurations of true lengths for `times` sequences with so many pieces of these bins, the longest pieces first."""
        while times:
            alike = min(int(self.n[self.at[b]]) // k for b, k in zip(bins, pieces, strict=True))
            alike, config = min(max(alike, 1), times), {}
            for b, k in zip(bins, pieces, strict=True):
                need = k * alike
                while need:
                    at = self.at[b]
                    used = min(need, int(self.n[at]))
                    length = int(self.all[at])
                    if used:
                        config[length] = config.get(length, 0) + used // alike
                        self.n[at] -= used
                        need -= used
                    if not self.n[at]:
                        self.at[b] = min(at + 1, len(self.all) - 1)
            yield config, alike
            times -= alike


@dataclass
class Plan:
    """Configurations ({length: pieces}, sequences) for exactly the given pieces.

    bound: no packing has fewer sequences; by_program: pieces whose place comes from the program; gap: how far the
    first program's value was over its dual's, as a share.
    """

    runs: list[tuple[dict[int, int], int]]
    pieces: int
    by_program: int
    bound: int
    gap: float

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.runs)


def solve(histogram: dict[int, int], capacity: int, bins: int = 96, gap: float = 0.02, rounds: int = 200, passes: int = 12) -> Plan:
    """A plan for a histogram of lengths, made in the same way at every size.

    Pieces of full length are alone. The shortest pieces (about a tenth of the tokens) are set aside, so many that their
    mean share of a sequence is about the longest of them, and the program leaves most of that room in each sequence. It
    is solved over bins of the other lengths and rounded: whole parts first, then one more of the configurations of
    largest remainder that still find their pieces. What is left is solved again, until it is a hundredth of the pieces.
    True lengths take the place of their bins', and best fit places those set aside and the last few in the rooms left.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    pieces, tokens = sum(left.values()), sum(length * n for length, n in left.items())
    runs = [({capacity: 1}, left.pop(capacity))] if capacity in left else []
    by_program = sum(times for _, times in runs)
    open_tokens = sum(length * n for length, n in left.items())
    aside: dict[int, int] = {}
    for length in sorted(left):  # until the longest of them fits the room that they fill
        if sum(k * n for k, n in aside.items()) * 1.15 >= open_tokens / capacity * max(aside, default=1):
            break
        aside[length] = left.pop(length)
    whole = sum(left.values())
    sequences = max(1.0, sum(length * n for length, n in left.items()) / capacity)
    room = max(0, sum(length * n for length, n in aside.items()) - Bins(left, bins).spare()) / (sequences + 1)
    limit, first_gap, bound = capacity - int(0.8 * room), 0.0, -(-tokens // capacity)
    for length in [x for x in left if x > limit]:  # no other piece may join those but by best fit
        runs.append(({length: 1}, left[length]))
        by_program += left.pop(length)
    for turn in range(passes):
        if sum(left.values()) <= 0.01 * whole or len(left) < 2:
            break
        table = Bins(left, bins)
        program = fractional(table.lengths, table.counts, limit, gap, rounds)
        if not turn:
            first_gap = program.value / program.bound - 1
        before, free = by_program, table.counts.copy()
        for part in (0, 1):
            order = sorted(program.columns.items(), key=lambda c: (-(c[1] % 1 if part else c[1]), c[0]))
            for (places, each), x in order:
                at, k = np.array(places), np.array(each)
                if part and (table.lengths[at] * k).sum() < 0.97 * limit:
                    continue
                times = min(1 if part else int(x), int((free[at] // k).min()))
                if times < 1:
                    continue
                free[at] -= k * times
                for config, alike in table.take(places, each, times):
                    runs.append((config, alike))
                    for length, n in config.items():
                        left[length] -= n * alike
                        by_program += n * alike
        left = {length: n for length, n in left.items() if n}
        if by_program == before:
            break
    for length, n in aside.items():
        left[length] = left.get(length, 0) + n
    return Plan(_best_fit(runs, left, capacity), pieces, by_program, bound, first_gap)


def _best_fit(runs: list[tuple[dict[int, int], int]], left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Runs with the pieces of left placed too, the longest first, each in the smallest room that it fits.

    Sequences that are alike get equal pieces together, so that the work depends on the number of runs and lengths.
    """
    runs = list(runs)
    rooms = sorted((capacity - sum(length * n for length, n in config.items()), i) for i, (config, _) in enumerate(runs))
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            at = bisect.bisect_left(rooms, (length, -1))
            if at < len(rooms):
                room, i = rooms.pop(at)
                config, times = runs[i]
            else:
                room, i, config = capacity, len(runs), {}
                times = -(-n // (capacity // length))
                runs.append((config, times))
            each = min(room // length, max(1, n // times))
            if n < times:
                runs.append((dict(config), times - n))
                bisect.insort(rooms, (room, len(runs) - 1))
                times, each = n, 1
            runs[i] = (config | {length: config.get(length, 0) + each}, times)
            n -= each * times
            if room > each * length:
                bisect.insort(rooms, (room - each * length, i))
    return runs


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Ranks of equal lengths to places: columns length, first (rank), per (pieces a sequence), sequence, offset."""
    rows, next_rank, sequence = [], {}, 0
    for config, times in plan:
        offset = 0
        for length, n in sorted(config.items(), reverse=True):
            first = next_rank.get(length, 0)
            rows.append((length, first, n, sequence, offset))
            next_rank[length] = first + n * times
            offset += length * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "per", "sequence", "offset"), table.T, strict=True))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Places of all documents' pieces: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A document is its token ids and end_id; only documents longer than capacity are cut, into pieces of capacity ids
    (the last may be shorter). A null or empty text is end_id alone. Repeated rows and null ids give pieces of their
    own; other columns are ignored; an empty table gives no rows. Sequences are gapless from offset 0.
    """
    own = materialize(pieces(id_and_text(docs, id_col, text_col), capacity, end_id, tokenizer or default_tokenizer()), "pieces")
    counts = own.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = counts.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).select("part", "length", "base")
    histogram = dict(own.groupBy("length").agg(F.count("*").alias("n")).collect())  # at most `capacity` rows
    places = own.sparkSession.sparkContext.broadcast(slots(solve(histogram, capacity).runs))

    def place(batches):
        table = places.value
        width = np.int64(1 << 44)
        keys = table["length"] * width + table["first"]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length * width + rank, "right") - 1
            nth = rank - table["first"][at]
            sequence = table["sequence"][at] + nth // table["per"][at]
            offset = table["offset"][at] + (nth % table["per"][at]) * length
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = own.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
