"""Operators over pages and embeddings, the pipeline, and the registry."""

import hashlib
import random

import numpy as np
import pytest

from pagelens.llm import topk, warc
from pagelens.llm import pipeline_stages as S


def test_warc(spark):
    rnd = random.Random(1)
    shared = "<p>" + "x" * 1500 + "é"
    rows = [(i, f"https://www.{'abc'[i % 3]}.com/{i % 5}?q=1", rnd.choice([shared, "short", f"<b>{i}" * 400]), "clash") for i in range(60)]
    rows += [(100, None, None, ""), (101, "x\r\ny", "", ""), (None, "http://h.io", shared, ""), (59, "http://h.io", shared, ""), (102, "http://h.io/", "y" * 999, ""), (103, "http://h.io/", "y" * 999, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = sorted(warc.capture_index(pages, file_bytes=4000).collect(), key=lambda r: (r.range, r["rank"]))
    assert len(got) == len(rows)
    order = [(r.url_key, r.captured, -1 if r.page_id is None else r.page_id) for r in got]
    assert order == sorted(order)
    largest = {}
    for i, _, html, _ in rows:
        if i is not None and html is not None:
            largest[html] = max(largest.get(html, i), i)
    want = sorted((str(i), len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if (revisit := i is not None and len((h or "").encode()) >= 1000 and largest[h] != i) else "response", largest[h] if revisit else None) for i, _, h, _ in rows)
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert warc.capture_index(pages.where("false")).count() == 0


def test_ranges_follow_each_other(spark):
    rows = [(i, f"http://{'hot' if i % 3 else f's{i}'}.com/", f"{i}") for i in range(400)]
    runs = warc.capture_index(spark.createDataFrame(rows, "page_id long, url string, html string")).drop("range", "rank")
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    runs = runs.withColumn("file", F.col("page_id") % 7).withColumn("seq", F.row_number().over(W.partitionBy("file").orderBy("url_key", "captured", "page_id")).cast("long"))
    got = sorted(warc.merged_index(runs, rows_per_range=50).collect(), key=lambda r: (r.range, r["rank"]))
    keys = [(r.url_key, r.captured, r.page_id) for r in got]
    assert len(keys) == 400 and keys == sorted(keys) and len({r.range for r in got}) > 4


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 13])
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted((rnd.randint(0, 20), j, i) for i in range(rnd.randint(0, 9))) for j in range(k)]
    assert list(warc.merge(runs)) == sorted(x for r in runs for x in r)
    assert list(warc.merge([])) == []


@pytest.mark.parametrize("shard,block", [(16_384, 32 << 20), (37, 150)])
def test_top_k(spark, shard, block):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0) for i in range(200)]
    rows += [(i, list(rows[i % 5][1]), 0) for i in range(200, 260)]  # ties
    rows += [(300, None, 0), (320, [1.0, None, 0.0], 0), (340, [float("nan")], 0), (360, [float("inf"), 1.0], 0), (380, [], 0), (400, [1.0, -1.0], 0), (None, [1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {}
    for r in topk.top_k(table, shard_rows=shard, block_bytes=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {i: np.floor(64 * np.array([*v, *[0.0] * (6 - len(v))])).astype(int) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    for i in good:
        if i % 20 == 0:
            best = sorted((-int(v @ good[i]), j) for j, v in good.items() if j != i)[:20]
            assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert set(got) == {i for i in good if i % 20 == 0}


def test_top_k_of_few_and_none(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(table).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(table.where("false")).count() == 0


def test_large_components_stay_exact():
    x = np.array([[2**29, 1], [2**29, 2], [2**29, 3]])
    ((score, ids),) = topk.max_score(x[:1], np.array([0]), [(x, np.arange(3))], 2)
    assert score.tolist() == [2**58 + 3, 2**58 + 2] and ids.tolist() == [2, 1]


@pytest.mark.parametrize("top", [3, 400, 2**27])
def test_max_score_against_brute_force_and_its_work(top):
    """Ties, negative and zero components; the postings and components read are fewer than all."""
    rng = np.random.default_rng(top)
    x = np.rint(rng.normal(size=(3000, 32)) * top / 3).astype(np.int64)
    x[2000:2100] = x[:100]
    x[5] = 0
    ids = rng.permutation(3000)
    shards = [(x[:1700], ids[:1700]), (x[1700:], ids[1700:])]
    for q, (score, found) in enumerate(topk.max_score(x[:40], ids[:40], shards, 20)):
        want = sorted((-int(s), int(j)) for s, j in zip(x @ x[q], ids) if j != ids[q])[:20]
        assert list(zip((-score).tolist(), found.tolist())) == want
    shard = topk.Shard(x, ids, topk._kind(x, x))
    for q in range(6, 40):
        shard.search(x[q], int(ids[q]), 20)
    everything = 34 * x.size
    assert 0 < shard.traversed < 0.5 * everything and shard.traversed + shard.probed < 0.95 * everything


def test_pipeline_stages(spark, corpus, tmp_path):
    words = corpus.where("doc_id = 98").first().text.split()
    spark.createDataFrame([(1, " ".join(words[10:50]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = corpus.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id is not null")
    docs = docs.union(spark.createDataFrame([(500, "my password=abcdef123 stays here", "en", "s", 32)], docs.schema))
    one = S.keep_languages(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {92, 93, 94}
    two = S.drop_near_duplicates(spark, one, str(tmp_path))
    left = {r.doc_id for r in two.collect()}
    assert {95, 97, 500} <= left and not left & {91, 96, 99} and two.count() == len(left)
    three = S.drop_contaminated(spark, two, str(tmp_path))
    assert left - {r.doc_id for r in three.collect()} == {98}
    four = S.mask_secrets(spark, three, str(tmp_path))
    row = four.where("doc_id = 500").first()
    assert row.text == "my [secret] stays here" and row.n_chars == len(row.text) and four.count() == three.count() and four.columns == docs.columns
    five = S.pack_sequences(spark, four, str(tmp_path))
    assert five.select("doc_id").distinct().count() == four.count()


def test_registry():
    import __spark_entry__ as e
    import corpus_pipeline

    names = set(e.queries())
    assert {f"op{n}_" for n in range(1, 14)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(e.oracle_sql()) <= names and len(corpus_pipeline.STAGES) == 5


def test_pipeline_stages_keep_rows_without_an_id(spark, tmp_path):
    leak = " ".join(f"leak{i}" for i in range(40))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "the first of the texts"), (None, "my password=abcdef123 stays"), (None, leak), (None, None), (None, "12 ?!")]
    rows += [(7, "zebra text of a repeated id"), (7, "apple text of a repeated id"), (7, None), (8, "a plain text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    texts = lambda df: sorted((str(r.doc_id), r.text) for r in df.collect())
    one = S.keep_languages(spark, docs, str(tmp_path))
    assert texts(one) == sorted((str(i), t) for i, t in rows if t not in (None, "12 ?!"))
    two = S.drop_near_duplicates(spark, one, str(tmp_path))
    assert two.columns == docs.columns and texts(two) == [x for x in texts(one) if x[1] != "zebra text of a repeated id"]
    three = S.drop_contaminated(spark, two, str(tmp_path))
    assert texts(three) == [x for x in texts(two) if x[1] != leak]
    four = S.mask_secrets(spark, three, str(tmp_path))
    assert texts(four) == [("7", "apple text of a repeated id"), ("8", "a plain text"), ("None", "my [secret] stays"), ("None", "the first of the texts")]
    assert S.pack_sequences(spark, four, str(tmp_path)).count() == 4
