"""Token-id files in patched frame-of-reference blocks.

A file holds whole documents in ascending id order. Its ids are cut into blocks of 128: the block's minimum is
subtracted, the rest is packed at the width that a percentile of the block's values needs, and the outliers stand in an
exception list (places and values). An index of block starts allows a reader to begin at any block.

Layout, little-endian: magic (8 bytes), file number (i64), documents, ids, blocks (u64 each); document ids (i64) and
a byte each for their presence; ids per document (u32); block starts (u64); blocks. A block: minimum (u32), width (u8),
exceptions (u8), 16 * width bytes of packed values, exception places (u8 each), exception values (u32 each).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text, map_texts, materialize, new_dir, put_file, read_files
from .tokens import default_tokenizer, encoder

MAGIC = b"PFORTOK1"
BLOCK = 128
HEAD = 6


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Packed blocks of ids (uint32) as bytes, and each block's start."""
    n = -(-len(ids) // BLOCK)
    padded = np.full(n * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(n, BLOCK)
    least = rows.min(axis=1) if n else np.zeros(0, np.uint32)
    rest = rows - least[:, None]
    width = _widths(np.partition(rest, int(BLOCK * percentile) - 1, axis=1)[:, int(BLOCK * percentile) - 1]) if n else np.zeros(0, np.int64)
    outlier = rest.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    exceptions = outlier.sum(axis=1)
    sizes = HEAD + width * (BLOCK // 8) + exceptions * 5
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(n, 4)
    out[starts + 4], out[starts + 5] = width, exceptions
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        for at in np.array_split(own, -(-len(own) // 4096)):
            low = np.where(outlier[at], 0, rest[at]).astype("<u4")
            bits = np.unpackbits(low.view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little", count=w)
            packed = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
            out[(starts[at] + HEAD)[:, None] + np.arange(packed.shape[1])] = packed
    block, place = np.nonzero(outlier)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    base = starts[block] + HEAD + width[block] * (BLOCK // 8)
    out[base + nth] = place
    values = rest[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(base + exceptions[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return out, starts


def decode_blocks(data: np.ndarray, starts: np.ndarray, n_ids: int) -> np.ndarray:
    """The ids again, of the blocks at starts; n_ids of them count."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32)
    starts = starts.astype(np.int64)
    least = data[starts[:, None] + np.arange(4)].copy().view("<u4").reshape(n)
    width, exceptions = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    rest = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        for at in np.array_split(own, -(-len(own) // 4096)):
            packed = data[(starts[at] + HEAD)[:, None] + np.arange(BLOCK // 8 * w)]
            bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
            full = np.zeros((len(at), BLOCK, 32), np.uint8)
            full[:, :, :w] = bits
            rest[at] = np.packbits(full, axis=2, bitorder="little").view("<u4").reshape(len(at), BLOCK)
    block = np.repeat(np.arange(n), exceptions)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    base = starts[block] + HEAD + width[block] * (BLOCK // 8)
    values = data[(base + exceptions[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    rest[block, data[base + nth]] = values
    return (rest + least[:, None]).reshape(-1)[:n_ids]


def encode_file(number: int, doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks, starts = encode_blocks(ids)
    head = np.array([number, len(doc_ids), len(ids), len(starts)], "<i8").tobytes()
    known = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join((MAGIC, head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), blocks.tobytes()))


def decode_file(raw: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """File number, document ids, ids per document, and all ids."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    number, docs, n_ids, blocks = np.frombuffer(raw, "<i8", 4, 8).tolist()
    at = 40
    doc_ids = np.frombuffer(raw, "<i8", docs, at).tolist()
    known = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs)
    lengths = np.frombuffer(raw, "<u4", docs, at := at + docs)
    starts = np.frombuffer(raw, "<u8", blocks, at := at + 4 * docs)
    ids = decode_blocks(np.frombuffer(raw, np.uint8, offset=at + 8 * blocks), starts, n_ids)
    return number, [d if k else None for d, k in zip(doc_ids, known, strict=True)], lengths.astype(np.int64), ids


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, tokenizer: str | None = None, ids_per_file: int = 1_000_000) -> DataFrame:
    """Writes all documents' ids, each with end_id, to files in folder; returns (file, docs, n_ids), a row per file.

    Files are numbered in ascending document order (null ids first); a file is closed once it has ids_per_file ids.
    Null and empty texts are end_id alone; repeated rows are written each; an empty table makes no file.
    """
    rows = id_and_text(docs, id_col, text_col)
    path = tokenizer or default_tokenizer()
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, file = encoder(path).encode, TaskContext.get().partitionId(), 0
        doc_ids, lengths, parts, size = [], [], [], 0

        def close():
            nonlocal doc_ids, lengths, parts, size, file
            number = (part << 24) + file
            put_file(f"{folder}/{number:020d}.tok", encode_file(number, doc_ids, np.array(lengths, np.int64), np.concatenate(parts)))
            out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([len(doc_ids)]), pa.array([size])], names=["file", "docs", "n_ids"])
            doc_ids, lengths, parts, size, file = [], [], [], 0, file + 1
            return out

        for batch in batches:
            for lo in range(0, len(batch), 512):
                ids, texts = batch.column(0).slice(lo, 512).to_pylist(), batch.column(1).slice(lo, 512).to_pylist()
                flat, sizes = encode(texts)
                ends = np.cumsum(sizes)
                flat = np.insert(flat, ends, np.uint32(end_id))
                doc_ids += ids
                lengths += (sizes + 1).tolist()
                parts.append(flat)
                size += len(flat)
                if size >= ids_per_file:
                    yield close()
        if doc_ids:
            yield close()

    return ordered.mapInArrow(write, "file long, docs long, n_ids long")


def read_token_files(files: DataFrame) -> DataFrame:
    """(file, doc_id, at, n_tokens, ids_crc32) of every document in files (path, content); at counts from the file's start."""

    def read(batches):
        for batch in batches:
            for raw in batch.column(1):
                number, doc_ids, lengths, ids = decode_file(raw.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                little = ids.astype("<u4")
                crcs = [zlib.crc32(little[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(doc_ids)), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crcs, pa.int64())], names=["file", "doc_id", "at", "n_tokens", "ids_crc32"])

    return files.mapInArrow(read, "file long, doc_id long, at long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes docs to files and reads those back: (doc_id, start, n_tokens, ids_crc32), start counted over all files.

    Documents are in ascending order of their ids, null ids first; rows that repeat an id, or have none, are written each
    and give a row each, one after the other in no set order. A null or empty text is the end id alone. Other columns
    are ignored; an empty table writes no file and gives no rows.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "tokens")
    written = materialize(write_token_files(docs, folder, **options), "token-index")
    # running sums of file sizes: over a part's files, and over the parts, which are as many as the write had tasks
    files = written.withColumn("part", F.shiftright("file", 24))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("all")).withColumn("before", F.sum("all").over(W.orderBy("part")) - F.col("all")).select("part", "before")
    own = F.sum("n_ids").over(W.partitionBy("part").orderBy("file")) - F.col("n_ids")
    starts = files.withColumn("own", own).join(parts, "part").select("file", (F.col("own") + F.col("before")).alias("base"))
    if written.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    back = read_token_files(read_files(spark, folder))
    return back.join(starts, "file").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
