"""Tables written to the folder that driver and executors share, to be read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_pagelens_scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-pagelens-")
        spark._pagelens_scratch = base
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df, dealt out by page as buckets are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id")


@contextmanager
def lying_by_page(spark: SparkSession) -> Iterator[None]:
    """Joins that are planned meanwhile, by page and other columns too, leave what lies by page where it is, and move the other side alone."""
    key = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def by_page(df: DataFrame, name: str) -> DataFrame:
    """df, written in buckets by page_id: what is grouped, ranked or joined by page from it needs no exchange.

    A table that does not lie so yet must be dealt out first, or what it is made of. The table's name is forgotten at
    once, and its files stay in the shared folder. What is made of it is joined by merging: its files say little of its
    size, as texts alike are packed to a hundredth, and a broadcast of it would go through the driver.
    """
    spark = df.sparkSession
    n, table = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{name}_{uuid.uuid4().hex}"
    with lying_by_page(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").bucketBy(n, "page_id").saveAsTable(table)
    out = spark.table(table).hint("merge")
    out.schema  # resolved now, so that nothing asks for the name again
    spark.sql(f"DROP TABLE {table}")
    return out


def written_apart(parts: list[DataFrame], name: str, at_once: int = 6) -> DataFrame:
    """Tables of one schema, written by a job each, some at a time, and read as one.

    A union of many plans is one stage whose every task carries all of them; apart, a task carries its own.
    """
    spark, base = parts[0].sparkSession, f"{shared_dir(parts[0].sparkSession)}/{name}-{uuid.uuid4().hex}"
    schema = parts[0].schema
    write = inheritable_thread_target(spark)(lambda i: parts[i].select(schema.names).write.option("compression", "zstd").parquet(f"{base}/{i}"))
    with lying_by_page(spark), ThreadPoolExecutor(at_once) as pool:
        list(pool.map(write, range(len(parts))))
    return spark.read.schema(schema).parquet(*(f"{base}/{i}" for i in range(len(parts)))).hint("merge")
