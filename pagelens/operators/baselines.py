"""Stored baselines: a version of one corpus at a time, published at once, beside those of all other corpora.

A store is a folder. A version's rows are written aside, into a folder of their own; what makes them the baseline is a
small manifest, moved under the corpus' next number in one step that fails if another run has taken the number. So a
run that dies leaves nothing behind that readers see, and of two runs at a time each gets a version or finds the other's.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that drift needs of a baseline.
REQUIRED = ("case_id", "status", "final_score", "corpus_hash")


class Store:
    """Baselines in a folder that Spark can write to, by corpus hash and version (from 1)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._path = lambda *parts: self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("x").getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    @staticmethod
    def _folder(corpus_hash: str) -> str:
        return f"corpus={corpus_hash.encode().hex()}"

    def versions(self, corpus_hash: str) -> list[int]:
        """Published versions of a corpus, in order."""
        folder = self._path(self._folder(corpus_hash))
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, corpus_hash: str, version: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/{self._folder(corpus_hash)}/v{version:08d}.json").collect()
        return json.loads(rows[0].value)

    def load(self, corpus_hash: str, version: int | None = None) -> DataFrame | None:
        """The corpus' baseline of that version, the last one by default; None where there is none."""
        there = self.versions(corpus_hash)
        if not there or version is not None and version not in there:
            return None
        found = self.manifest(corpus_hash, version or there[-1])
        return self.spark.read.parquet(f"{self.path}/{self._folder(corpus_hash)}/{found['rows']}")

    def store(self, baseline: DataFrame, corpus_hash: str, version: int | None = None) -> int | None:
        """Publishes rows as the corpus' next version and returns its number; with a version given, None if that is taken.

        All rows must be of this corpus and have REQUIRED columns; ValueError otherwise, with nothing published.
        """
        lacking = [c for c in REQUIRED if c not in baseline.columns]
        if lacking:
            raise ValueError(f"a baseline needs {', '.join(lacking)}")
        folder, rows = self._folder(corpus_hash), f"rows-{uuid.uuid4().hex}"
        baseline.write.parquet(f"{self.path}/{folder}/{rows}")
        written = self.spark.read.schema(baseline.schema).parquet(f"{self.path}/{folder}/{rows}")
        cases, others = written.agg(F.count("*"), F.count(F.when(~F.col("corpus_hash").eqNullSafe(corpus_hash), 1))).first()
        if others:
            self._fs.delete(self._path(folder, rows), True)
            raise ValueError(f"{others} of {cases} rows are of another corpus")
        while True:
            number = version or max(self.versions(corpus_hash), default=0) + 1
            made = {"version": number, "corpus_hash": corpus_hash, "rows": rows, "cases": cases, "columns": baseline.columns}
            if self._publish(folder, f"v{number:08d}.json", json.dumps(made)):
                return number
            if version:
                self._fs.delete(self._path(folder, rows), True)
                return None

    def _publish(self, folder: str, name: str, text: str) -> bool:
        """Whether the text is now the file of that name; False if there was one."""
        aside = self._path(folder, f".{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            self._context.rename(aside, self._path(folder, name), self._options())
        except Py4JJavaError as problem:
            self._fs.delete(aside, False)
            if "FileAlreadyExistsException" in problem.java_exception.getClass().getName():
                return False
            raise
        return True

    def _options(self):
        """Rename without leave to overwrite."""
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        return options


def compatible(baseline: DataFrame, current: DataFrame) -> list[str]:
    """Why results cannot be compared with a baseline: columns that only one of them has, or has with another type."""
    ours, theirs = dict(current.dtypes), dict(baseline.drop("corpus_hash").dtypes)
    return sorted([f"missing {c}" for c in theirs if c not in ours] + [f"{c}: {theirs[c]} and {ours[c]}" for c in theirs if c in ours and ours[c] != theirs[c]])
