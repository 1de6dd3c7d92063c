"""Sequences by power-of-two decomposition: each document is cut into pieces of binary lengths, a sequence each.

A document of n tokens becomes n // capacity pieces of full length and then one piece for each binary digit of the rest,
the longest first. Every piece is a sequence of its own, so that none crosses documents and none needs padding; pieces of
equal length form a bucket, from which batches are made. A document's cuts depend on its own length alone: nothing is
shuffled, and a task that runs again gives the same rows.

A sequence's number says its bucket (log2 of the length, from bit 56 on), its task (from bit 32 on) and its place among
the task's pieces of that length, so that buckets are runs of numbers.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, map_texts
from .tokens import default_tokenizer, encoder

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def binary_pieces(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which document each piece is of, its start there, and its length; documents in order, pieces of falling length."""
    bits = np.array([1 << b for b in range(capacity.bit_length() - 2, -1, -1)], np.int64)
    whole, digits = tokens // capacity, (tokens[:, None] & bits) > 0
    n = whole + digits.sum(axis=1)
    of = np.repeat(np.arange(len(tokens)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    length = np.full(len(of), capacity, np.int64)
    doc, digit = np.nonzero(digits)
    length[nth >= whole[of]] = bits[digit]
    ends = np.cumsum(length)
    return of, ends - length - np.repeat(np.cumsum(tokens) - tokens, n), length


def decompose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """All documents' pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), with_ids: ids besides.

    A document is its token ids and end_id; capacity is a power of two, and so is each length. offset is 0, since a piece
    is alone in its sequence. A null or empty text is end_id alone, in a sequence of one; repeated rows and null ids give
    sequences of their own; other columns are ignored; an empty table gives no rows.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = tokenizer or default_tokenizer()

    def make():
        encode, part, seen = encoder(path).encode, TaskContext.get().partitionId(), np.zeros(capacity.bit_length(), np.int64)

        def call(ids, texts):
            flat, sizes = encode(texts)
            flat = np.insert(flat, np.cumsum(sizes), np.uint32(end_id)).astype("<u4")
            of, start, length = binary_pieces(sizes + 1, capacity)
            ends, raw = np.cumsum(length), memoryview(flat).cast("B")
            crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), length.tolist(), strict=True)]
            bucket = np.log2(length).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            n = np.bincount(bucket, minlength=len(seen))
            rank = np.empty(len(of), np.int64)
            rank[order] = np.arange(len(of)) + np.repeat(seen - (np.cumsum(n) - n), n)
            seen[:] += n
            columns = [pa.array(ids, pa.int64()).take(pa.array(of)), start, length, crcs, (sizes + 1)[of], (bucket << 56) + (part << 32) + rank, np.zeros(len(of), np.int64)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(flat.astype(np.int32))))
            return columns

        return call

    return map_texts(id_and_text(docs, id_col, text_col), make, OUT + (", ids array<int>" if with_ids else ""), 8 << 20)


def write_buckets(docs: DataFrame, folder: str, **options) -> None:
    """Writes all sequences with their ids as Parquet, a folder for each length, as tasks cut them."""
    decompose(docs, with_ids=True, **options).select("sequence_id", "doc_id", "start", "ids", F.col("length")).write.partitionBy("length").parquet(folder)
