"""Exact top-k inner products by MaxScore over postings.

A query's terms are its dimensions. A shard of candidates has a posting list for each dimension: its rows in order of
their value there, so that the ends of the list are the lowest and the highest contribution that the term can make.
Terms whose contributions, all at their highest, leave a candidate under the k-th best score so far are non-essential.
The essential terms' postings are traversed from the best end; a candidate's non-essential terms are probed one by one,
those of widest bounds first, and only while it could still compete. The first limit comes from the heads of the widest
lists, later ones from the shards before. Lists of all shards are merged by a window over each query's few rows.

Vectors are dense: a list names every row, so traversal skips terms, and probing skips candidates, but few rows are
never seen at all. Queries lie in the shared folder in blocks of bounded size; a task reads a block and takes it past
its own vectors, shard by shard. Vectors are dealt out once, evenly, and never copied.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import get_file, materialize, new_dir, put_file

OUT = "query_id long, vec_id long, score long"


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component; vectors that are null or hold a null or non-finite one are left out."""
    x = F.col(vector_col).cast("array<double>")
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    return rows.where(~F.exists("x", bad)).select("vec_id", F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _kind(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The narrowest type that holds every sum exactly; floats are faster."""
    bound = 2.0 * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


class Shard:
    """Candidates and their postings: for each term the places of rows in ascending order of value, and those values.

    traversed and probed count the postings read and the components looked up beside them.
    """

    HEADS = 8  # terms whose best postings give the first limit

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, kind: type):
        self.ids, self.rows = ids, vectors.astype(kind)
        self.columns = np.ascontiguousarray(self.rows.T)
        self.places = np.argsort(self.columns, axis=1, kind="stable")
        self.values = np.take_along_axis(self.columns, self.places, 1)
        self.traversed = self.probed = 0

    def _head(self, term: int, weight, n: int) -> np.ndarray:
        return self.places[term, -n:] if weight > 0 else self.places[term, :n]

    def search(self, query: np.ndarray, own: int, k: int, limit: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of at most k rows of other ids, best first: all that score at least limit and are among the k best."""
        query = query.astype(self.rows.dtype)
        terms = np.flatnonzero(query)
        weights = query[terms]
        ends = weights[:, None] * self.values[terms][:, [0, -1]]
        least = ends.min(axis=1)
        spread = ends.max(axis=1) - least
        order = np.argsort(-spread, kind="stable")  # the widest bounds first
        terms, weights, least, spread = terms[order], weights[order], least[order], spread[order]
        floor = least.sum()
        remaining = np.append(np.cumsum(spread[::-1])[::-1], 0)  # what the terms from here on may add to their least
        if len(terms):
            seeds = np.unique(np.concatenate([self._head(t, w, 2 * k) for t, w in zip(terms[: self.HEADS].tolist(), weights)]))
            seeds = seeds[self.ids[seeds] != own]
            self.probed += len(seeds) * len(terms)
            if len(seeds) >= k:
                limit = max(limit, float(np.partition(self.rows[seeds] @ query, len(seeds) - k)[len(seeds) - k])) if self.rows.dtype != np.int64 else max(limit, int(np.sort(self.rows[seeds] @ query)[-k]))
        need = limit - floor if limit > -np.inf else -np.inf
        essential = int(np.argmax(remaining < need)) if remaining[-1] < need else len(terms)
        partial = np.zeros(len(self.ids), self.rows.dtype)
        for term, weight, low in zip(terms[:essential].tolist(), weights, least):
            values = self.values[term]
            s = slice(int(np.searchsorted(values, values[0], "right")), None) if weight > 0 else slice(0, int(np.searchsorted(values, values[-1], "left")))
            at = self.places[term, s]  # rows at the least contribution add nothing
            gain = weight * values[s]
            gain -= low
            partial[at] += gain
            self.traversed += len(at)
        alive = np.flatnonzero(partial >= need - remaining[essential]) if need > -np.inf else np.arange(len(partial))
        partial = partial[alive]
        for i in range(essential, len(terms)):
            gain = self.columns[terms[i]].take(alive) if len(alive) < len(self.ids) else self.columns[terms[i]] * 1
            gain *= weights[i]
            gain -= least[i]
            partial += gain
            self.probed += len(alive)
            keep = np.flatnonzero(partial >= need - remaining[i + 1])
            if len(keep) < 0.9 * len(alive):
                alive, partial = alive.take(keep), partial.take(keep)
        score, ids = partial + floor, self.ids[alive]
        keep = (score >= limit) & (ids != own)
        score, ids = score[keep], ids[keep]
        best = np.lexsort((ids, -score))[:k]
        return score[best], ids[best]


def max_score(queries: np.ndarray, query_ids: np.ndarray, shards, k: int):
    """For queries over (vectors, ids) of all shards in turn: every query's (scores, ids), at most k, best first."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
    for vectors, ids in shards:
        shard = Shard(vectors, ids, _kind(queries, vectors))
        for i, (query, own) in enumerate(zip(queries, query_ids.tolist())):
            had, had_ids = best[i]
            score, found = shard.search(query, own, k, int(had[-1]) if len(had) == k else -np.inf)
            if len(found):
                score, found = np.concatenate((had, score.astype(np.int64))), np.concatenate((had_ids, found))
                first = np.lexsort((found, -score))[:k]
                best[i] = score[first], found[first]
    return best


def _write_blocks(queries: DataFrame, folder: str, blocks: int) -> None:
    """Queries (vec_id, v) as Arrow files in folder, block-N, each of about the same size."""

    def write(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        put_file(f"{folder}/block-{block}", sink.getvalue().to_pybytes())
        return pa.table({"block": pa.array([block], pa.int64())})

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    materialize(queries.select("vec_id", "v", block.alias("block")).groupBy("block").applyInArrow(write, "block long"), "top-k-blocks")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: int = 64, shard_rows: int = 16_384, block_bytes: int = 32 << 20) -> DataFrame:
    """For each row whose id is divisible by `every`, its k best other rows: (query_id, rank, vec_id, score).

    Score is the integer inner product of floor(scale * x); ties go to the smaller vec_id. Rows without an id or with
    a null or non-finite component take no part; vectors of fewer components count as followed by zeros; rows that
    repeat an id are candidates each, of other queries than their own id, and the first of them by value is the query.
    Other columns are ignored; an empty table gives no rows. A task holds a shard and a block of queries.
    """
    rows = quantized(vectors, id_col, vector_col, scale)
    n, width, asked = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.col("vec_id") % every == 0)).first()
    spark = vectors.sparkSession
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    held = materialize(rows.repartition(max(1, -(-2 * n // shard_rows))), "top-k-vectors")
    queries = held.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks, folder, width = max(1, -(-asked * 8 * max(1, width) // block_bytes)), new_dir(spark, "top-k-queries"), max(1, width)
    _write_blocks(queries, folder, blocks)

    def search(path: str):
        def run(batches):
            data = get_file(path)
            if data is None:  # no query fell into this block
                return
            with pa.ipc.open_stream(data) as stream:
                table = stream.read_all().combine_chunks()
            ids, values = table["vec_id"].to_numpy(), table["v"].combine_chunks()
            own = _matrix(values if isinstance(values, pa.Array) else values.chunk(0), width)

            def shards():
                kept, size = [], 0
                for batch in batches:
                    for at in range(0, len(batch), shard_rows):
                        part = batch.slice(at, shard_rows)
                        if size + len(part) > shard_rows:
                            yield np.concatenate([m for m, _ in kept]), np.concatenate([i for _, i in kept])
                            kept, size = [], 0
                        kept.append((_matrix(part.column(1), width), part.column(0).to_numpy()))
                        size += len(part)
                if kept:
                    yield np.concatenate([m for m, _ in kept]), np.concatenate([i for _, i in kept])

            best = max_score(own, ids, shards(), k)
            for lo in range(0, len(ids), 4096):
                part = best[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[lo : lo + 4096], [len(s) for s, _ in part])), pa.array(np.concatenate([f for _, f in part])), pa.array(np.concatenate([s for s, _ in part]))], names=["query_id", "vec_id", "score"])

        return held.mapInArrow(run, OUT)

    found = search(f"{folder}/block-0")
    for block in range(1, blocks):
        found = found.union(search(f"{folder}/block-{block}"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
