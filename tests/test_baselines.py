"""Stored baselines of several corpora and runs, and fingerprints against the hash of the whole text."""

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.operators import benchmark as B
from pagelens.operators import fingerprint
from pagelens.operators.baselines import Store, compatible
from tests.test_benchmark import frame, result


def made(spark, score, corpus):
    return B.create_baseline(frame(spark, result("1", score)), corpus)


def test_a_corpus_leaves_the_others_alone(spark, tmp_path):
    path = f"{tmp_path}/baselines"
    assert B.load_baseline(spark, path, "h1") is None
    assert B.store_baseline(made(spark, 50.0, "h1"), path, "h1") == 1
    assert B.store_baseline(made(spark, 60.0, "../h 2"), path, "../h 2") == 1
    assert B.store_baseline(made(spark, 70.0, "h1"), path, "h1") == 2
    score = lambda *of: B.load_baseline(spark, path, *of).first().final_score
    assert (score("h1"), score("h1", 1), score("../h 2")) == (70.0, 50.0, 60.0)
    assert B.load_baseline(spark, path, "h1", 3) is None
    manifest = Store(spark, path).manifest("h1", 2)
    assert manifest["cases"] == 1 and manifest["corpus_hash"] == "h1" and "final_score" in manifest["columns"]


def test_nothing_is_published_of_what_does_not_fit(spark, tmp_path):
    path = f"{tmp_path}/baselines"
    with pytest.raises(ValueError, match="another corpus"):
        B.store_baseline(made(spark, 50.0, "h1"), path, "h2")
    with pytest.raises(ValueError, match="status"):
        B.store_baseline(made(spark, 50.0, "h1").drop("status"), path, "h1")
    assert B.load_baseline(spark, path, "h1") is None and B.load_baseline(spark, path, "h2") is None
    B.store_baseline(made(spark, 50.0, "h1").where("false"), path, "h1")
    assert B.load_baseline(spark, path, "h1").count() == 0


def test_runs_at_the_same_time(spark, tmp_path):
    path = f"{tmp_path}/baselines"
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda i: B.store_baseline(made(spark, float(i), "h"), path, "h"), range(4)))
    assert sorted(got) == [1, 2, 3, 4]
    assert {B.load_baseline(spark, path, "h", v).first().final_score for v in got} == {0.0, 1.0, 2.0, 3.0}
    store = Store(spark, path)
    assert store.store(made(spark, 9.0, "h"), "h", version=2) is None and store.versions("h") == [1, 2, 3, 4]


def test_what_cannot_be_compared(spark, tmp_path):
    path = f"{tmp_path}/baselines"
    now = frame(spark, result("1", 50.0))
    assert B.compare_or_store(now, path, "h") is None
    assert B.compare_or_store(now, path, "h").count() == 0
    assert compatible(B.load_baseline(spark, path, "h"), now) == []
    with pytest.raises(ValueError, match="missing confidence"):
        B.compare_or_store(now.drop("confidence"), path, "h")


def fnv(text):
    h = 0x811C9DC5
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).tolist()
    for c in units:
        h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def test_folds_are_the_hash():
    rnd = random.Random(6)
    for alphabet in ("ab|,1 ", "aé\xff", "aŁ漢", "a\U0001f600b"):
        lines = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(40)]
        h = np.array([rnd.randrange(1 << 32) for _ in range(5)] + [fingerprint.BASIS], np.uint32)
        cut = rnd.randrange(40)
        whole, parts = fingerprint.fold_lines(lines), fingerprint.fold_lines(lines[:cut]).then(fingerprint.fold_lines(lines[cut:]))
        assert (whole(h) == parts(h)).all()
        assert f"{int(whole(h)[-1]):08x}" == fnv("".join("\n" + x for x in lines))


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_fingerprint_of_a_table(spark, parts):
    rnd = random.Random(parts)
    rows = [(f"{rnd.choice('abc')}", f"{i:04d}", rnd.choice(["x", "", None, "tag é", "漢字", "line\nfeed"]) and f"text {i}") for i in range(700)]
    rows = [(k, i, t if t is None or int(i) % 9 else t + "漢\U0001f600") for k, i, t in rows]
    df = spark.createDataFrame(rows, "k string, i string, t string")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = fingerprint.ordered_fnv1a(df, F.col("t"), "k", "i").first()
        none = fingerprint.ordered_fnv1a(df.where("false"), F.col("t"), "k", "i").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tuple(got) == (fnv("\n".join(t or "" for _, _, t in sorted(rows, key=lambda r: r[:2]))), 700)
    assert tuple(none) == (fnv(""), 0)
