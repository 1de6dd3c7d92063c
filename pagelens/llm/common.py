"""Helpers that the training-data operators share: the shared folder, word hashing and graph components."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word cache of a task is emptied when its words, with about 150 bytes each besides their own, take this many bytes.
MAX_CACHE_BYTES = 32 << 20
WORD_BYTES = 150


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; set here only where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_pagelens_scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-pagelens-")
        spark._pagelens_scratch = base
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator reads, as doc_id long and text binary (UTF-8); all others are left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of an id written as decimal text, modulo n; null ids count as the empty text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def shares(spark: SparkSession, total_bytes: float, target: int = 64 << 20) -> int:
    """How many partitions hold total_bytes at about target bytes each, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_bytes / target))


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; remembers what it has seen up to MAX_CACHE_BYTES."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        self.size += len(word) + WORD_BYTES
        if self.size > MAX_CACHE_BYTES:
            self.clear()
            self.size = 0
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a UTF-8 text with A-Z lower-cased."""
    return text.lower().split() if text else []


_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bits of x spread evenly (an invertible 64-bit finalizer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Signed 64-bit hashes of the runs of `size` words, in text order; fewer words than that: none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(size))
        for i in range(size):
            total += hashes[i : i + n] * _STEPS[i % 5] + (hashes[i : i + n] >> np.uint64(i + 7))
        return mix64(total).view(np.int64)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """As grams, but fewer words than that make one shingle of all; no words, none."""
    return grams(hashes, min(size, len(hashes))) if len(hashes) else np.zeros(0, np.int64)


def _chunks(column: pa.Array, chunk_bytes: int) -> Iterator[tuple[int, int]]:
    """Slices (start, rows) of a binary column with about chunk_bytes of text each, a row at least."""
    ends = np.cumsum(np.nan_to_num(np.array(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=float)) + 64)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk_bytes, "right")))
        yield at, to - at
        at = to


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], list[pa.Array]]], schema: str, chunk_bytes: int = 2 << 20) -> DataFrame:
    """df (doc_id, text binary) through a function made once a task, called on chunks of about chunk_bytes of text.

    The function gets ids and texts and returns the columns of schema.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, call = to_arrow_schema(names), make()
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for at, n in _chunks(column, chunk_bytes):
                out = call(ids.slice(at, n).to_pylist(), column.slice(at, n).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[list], np.ndarray | list]], text_col: str = "text", chunk_bytes: int = 2 << 20) -> DataFrame:
    """df with all its columns through a function made once a task, which gets a chunk's texts (UTF-8, null as None).

    An array of booleans that it returns says which rows stay; a list of texts takes the place of theirs.
    """
    at_text = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            column = batch.column(at_text)
            raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
            for at, n in _chunks(raw, chunk_bytes):
                out, part = call(raw.slice(at, n).to_pylist()), batch.slice(at, n)
                if isinstance(out, np.ndarray):
                    yield part if out.all() else part.filter(pa.array(out))
                else:
                    yield part.set_column(at_text, batch.schema.field(at_text), pa.array(out, column.type))

    return df.mapInArrow(run, df.schema)


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of int64 as one Arrow column of lists."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end (a) has one edge, and none of them is also a smaller end (b)."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("larger"), F.lit(0).alias("smaller")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller")).where("larger > 1 or larger = 1 and smaller = 1").isEmpty()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Component of every node of edges (a, b: long), as (node, component_id), the component's smallest node.

    Alternates large-star and small-star rounds, each a shuffle over the edges left, until the edges are stars around the
    smallest nodes; no round gathers a node's neighbours in one place. No edges: no rows.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not _stars(now):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(now.join(least, "a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        large = materialize(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = materialize(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    return now.groupBy("a").agg(F.min("b").alias("component_id")).select(F.col("a").alias("node"), "component_id").union(now.select("b", "b").distinct().toDF("node", "component_id"))


def put_file(uri: str, data: bytes) -> None:
    """Writes a file in the shared folder under its final name only when it is whole; a task that runs again writes it anew."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def get_file(uri: str) -> bytes | None:
    """The bytes of a file of put_file; None where there is none."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(path) as file:
        return file.read()


def read_files(spark: SparkSession, uri: str) -> DataFrame:
    """All files of a folder of put_file, as (path, content)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "[!._]*").load(uri).select("path", "content")
