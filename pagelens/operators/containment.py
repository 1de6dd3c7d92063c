"""Containment joins: which nodes lie within which, in one pass over each page's nodes in document order.

A node's descendants have the places after its own up to its last. With nodes in order of place, those that a node lies
in form a stack: one that ends before the next node is popped for good. A pass costs the nodes that take part, and what
it puts out; no node carries its ancestors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _pass(nodes: DataFrame, outer: Column, inner: Column, payload: Column | None, schema: str, visit) -> DataFrame:
    """visit(stack, page, pre, last, is_outer, is_inner, payload) for the nodes of outer or inner in order; yields rows.

    stack holds the open outer nodes as lists [pre, last, their payloads' bits down to here, used], without the node itself.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    rows = nodes.select("page_id", "pre", "last", yes(outer).alias("o"), yes(inner).alias("i"), (F.lit(0) if payload is None else F.coalesce(payload, F.lit(0))).cast("long").alias("x")).where("o or i")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, stack = object(), []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[0] != page:
                    page, stack = row[0], []
                while stack and stack[-1][1] < row[1]:
                    stack.pop()
                out += visit(stack, *row)
                if row[3]:
                    stack.append([row[1], row[2], row[5] | (stack[-1][2] if stack else 0), False])
                if len(out) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    # a rank within pages puts each page's nodes together and in order, and moves nothing where they lie so already
    ordered = rows.withColumn("nth", F.row_number().over(W.partitionBy("page_id").orderBy("pre")))
    return ordered.mapInArrow(run, schema).hint("merge")


def pairs(nodes: DataFrame, outer: Column, inner: Column) -> DataFrame:
    """(page_id, up, pre): each node of inner with each node of outer that it lies in; as many rows as there are pairs."""
    return _pass(nodes, outer, inner, None, "page_id long, up long, pre long", lambda stack, page, pre, last, o, i, x: [(page, s[0], pre) for s in stack] if i else ())


def enclosing(nodes: DataFrame, outer: Column, inner: Column, mask: Column | None = None) -> DataFrame:
    """(page_id, pre, up, n, bits) of every node of inner: the nearest outer node that it lies in (null: none), how many there are, and their masks' bits together."""

    def visit(stack, page, pre, last, is_outer, is_inner, bits):
        if not is_inner:
            return ()
        return [(page, pre, stack[-1][0], len(stack), stack[-1][2])] if stack else [(page, pre, None, 0, 0)]

    return _pass(nodes, outer, inner, mask, "page_id long, pre long, up long, n long, bits long", visit)


def holding(nodes: DataFrame, outer: Column, inner: Column) -> DataFrame:
    """(page_id, pre) of the nodes of outer that hold a node of inner."""

    def visit(stack, page, pre, last, is_outer, is_inner, _):
        out, i = [], len(stack) - 1
        while is_inner and i >= 0 and not stack[i][3]:
            stack[i][3] = True
            out.append((page, stack[i][0]))
            i -= 1
        return out

    return _pass(nodes, outer, inner, None, "page_id long, pre long", visit)
