import re

import pytest
from pyspark.sql import functions as F

from pagelens.operators import benchmark as B
from pagelens.operators.metrics import WEIGHTS
from pagelens.sources import corpus

SCHEMA = "case_id string, category string, status string, final_score double, confidence double, metrics map<string,double>, recommendations array<string>, absence array<string>, contamination_type string, runtime_ms double"


def result(case, score=50.0, status="ok", category="a", **kw):
    row = {"case_id": case, "category": category, "status": status, "final_score": score, "confidence": 0.8, "metrics": dict.fromkeys(WEIGHTS, 50.0), "recommendations": ["r"], "absence": ["m"], "contamination_type": None, "runtime_ms": 1.0}
    row |= kw
    return tuple(row.values())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def records(spark, now, old):
    return sorted((r.case_id, r.type, r.metric or "") for r in B.drift(frame(spark, *now), frame(spark, *old)).collect())


def test_no_drift_against_itself(spark):
    rows = [result("1"), result("2", status="error"), result("3", None)]
    assert records(spark, rows, rows) == []


def test_tolerances(spark):
    assert records(spark, [result("1", 50.5)], [result("1")]) == []
    assert records(spark, [result("1", 50.51)], [result("1")]) == [("1", "score", "")]
    assert records(spark, [result("1", None)], [result("1")]) == [("1", "score", "")]
    assert records(spark, [result("1", metrics={**dict.fromkeys(WEIGHTS, 50.0), "clarity": 51.0})], [result("1")]) == [("1", "metric", "clarity")]


def test_schema_and_sets(spark):
    now = [result("1", status="error"), result("2"), result("4", recommendations=["x"]), result("5", contamination_type="shadow_dom"), result("6", absence=[])]
    old = [result("1"), result("3"), result("4"), result("5"), result("6")]
    assert records(spark, now, old) == [("1", "schema", ""), ("2", "schema", ""), ("3", "schema", ""), ("4", "recommendation", ""), ("5", "contamination", ""), ("6", "absence_evidence", "")]
    assert records(spark, [], old[:1]) == [("1", "schema", "")]


def test_verdicts(spark):
    old = frame(spark, *(result(str(i), category="ab"[i % 2]) for i in range(40)))
    now = frame(spark, *(result(str(i), 60.0 if i in (0, 1) else 50.0, category="ab"[i % 2]) for i in range(40)))
    d = B.drift(now, old)
    assert B.corpus_verdict(now, old, d).first().reason == "categories"
    assert B.corpus_verdict(old, old, B.drift(old, old)).first().drifted is False


def test_summary_and_runtimes(spark):
    rows = frame(spark, result("b", 10.0, runtime_ms=5.0), result("a", 30.0, runtime_ms=5.0), result("c", status="error", category="z", runtime_ms=1.0))
    got = {r.category: (r.total, r.passed, r.failed) for r in B.run_summary(rows).collect()}
    assert got == {"a": (2, 2, 0), "z": (1, 0, 1), None: (3, 2, 1)}
    t = B.runtime_stats(rows).first()
    assert (t.slowest, t.fastest, t.median_ms) == ("a", "c", 5.0)


def test_corpus_hash(spark):
    c = corpus.synthetic_corpus(spark)
    assert c.count() == 1600
    one = B.corpus_hash(c).first().corpus_hash
    assert one == B.corpus_hash(c.orderBy(F.rand(1))).first().corpus_hash
    assert one != B.corpus_hash(c.where("id <> 'blog_007'")).first().corpus_hash


def test_baseline(spark, tmp_path):
    rows = frame(spark, result("1"), result("2"))
    B.store_baseline(B.create_baseline(rows, "abc"), str(tmp_path / "b"), "abc")
    assert B.load_baseline(spark, str(tmp_path / "b"), "abc").count() == 2
    assert B.load_baseline(spark, str(tmp_path / "b"), "other") is None


def test_csv(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('page_id,category,url,tags,extra\np1,web,https://a.com/,"x; y",1\np2,,https://b.com/,,\n"p""3",web,ftp:/q,,\np1,web,https://a.com/,"line\nbreak",\n,web,,,\n')
    rows = corpus.read_csv(spark, str(path))
    got = sorted((r.problem, r.page_id or "") for r in corpus.validate_csv(rows).collect())
    assert got == [("Duplicate page_id", "p1"), ("Duplicate url", "p1"), ("Empty category", "p2"), ("Invalid URL", 'p"3'), ("Missing page_id", ""), ("Missing url", ""), ("Unsupported column: extra (will be ignored)", "")]
    cases = corpus.rows_to_corpus(rows).orderBy("id").collect()
    assert [c.id for c in cases] == ['p"3', "p1", "p1"] and ["x", "y"] in [c.tags for c in cases]
    assert corpus.validate_csv(spark.createDataFrame([("a",)], "x string")).count() == 3


def test_case_problems(spark):
    rows = spark.createDataFrame([("1", "c", "https://a.b"), (None, " ", None), ("3", "c", "x")], "id string, category string, url string")
    assert sorted(r.problem for r in B.validate_cases(rows).collect()) == ["empty category", "invalid url", "missing id", "missing url"]


def test_responses(spark):
    rows = spark.createDataFrame([(1, 200, "text/html", "<html>x"), (2, 403, None, ""), (3, 503, "image/png", "x"), (4, 418, "text/html", "x")], "page_id long, status int, content_type string, body string")
    got = {r.page_id: r.flags for r in corpus.classify_responses(rows).collect()}
    assert got == {1: [], 2: ["access_denied", "empty_response"], 3: ["server_unavailable", "unsupported_content_type"], 4: ["http_418"]}
    tries = spark.createDataFrame([(1, 2, 200, "<html>b"), (1, 1, 500, "<html>a"), (1, 3, 200, "<html>c"), (2, 1, 404, "x")], "page_id long, priority int, status int, body string")
    assert {r.page_id: (r.html, r.flag) for r in corpus.first_success(tries).collect()} == {1: ("<html>b", None), 2: (None, "fetch_failure")}


def test_corpus_hash_in_bounded_runs(spark):
    def fnv(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return f"{h:08x}"

    rows = [(f"{i:03}", "hot" if i % 10 else "cold", f"https://e.com/{i}") for i in range(100)]
    c = spark.createDataFrame(rows, "id string, category string, url string")
    for run in (3, 10, 1024):
        hashes = [fnv(f"{i}|{cat}|{url}|0||") for i, cat, url in sorted(rows, key=lambda r: (r[1], r[0]))]
        while len(hashes) > run:
            hashes = [fnv("\n".join(hashes[i : i + run])) for i in range(0, len(hashes), run)]
        for parts in (1, 7):
            assert tuple(B.corpus_hash(c.repartition(parts), run).first()) == (fnv("\n".join(hashes)), 100)
    assert tuple(B.corpus_hash(c.where("false")).first()) == (fnv(""), None)


def test_run_cases(spark):
    from pagelens.plans.runner import run_cases

    page = "<html lang='en'><head><title>T</title></head><body><main><h1>Some words</h1><p>A paragraph of a page that says enough to be read. It has two sentences.</p><p>Another one.</p></main></body></html>"
    cases = [("a", "x", "https://a.com/", page), ("b", "x", None, page), ("c", "y", "https://c.com/", None), ("d", "y", None, "")]
    got = {r.case_id: r for r in run_cases(spark.createDataFrame(cases, "id string, category string, url string, snapshot_html string")).collect()}
    assert [got[i].status for i in "abcd"] == ["ok", "ok", "error", "ok"] and got["c"].error_message == "No content available for case c"
    assert got["a"].final_score == got["b"].final_score > 0 and got["a"].metrics == got["b"].metrics and got["a"].recommendations
    assert got["c"].final_score is None and got["d"].final_score is None and got["d"].contamination_type
    rows = list(got.values())
    assert B.drift(spark.createDataFrame(rows, SCHEMA + ", error_message string"), spark.createDataFrame(rows, SCHEMA + ", error_message string")).count() == 0


def test_audits_and_runs_send_no_table_through_the_driver(spark):
    """Joins of an audit's tables merge, whatever their files' size; nodes stay where they lie."""
    from pagelens.operators import dom, evidence, normalize
    from pagelens.plans.audit import PageAudit
    from pagelens.plans.runner import run_cases
    from pagelens.plans.scratch import lying_by_page

    page = "<html><body><main><h1>Title of it</h1><p>Some text in a page that is long enough.</p><a href='/x'><img alt='y'></a></main></body></html>"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    a = PageAudit(spark.createDataFrame([(1, "http://a.b/", page)], "page_id long, url string, html string"))
    stats = normalize.page_stats(a.kept, a.flags, evidence.extractability(a.nodes, a.flags, a.pages))
    for part in (dom.page_flags(a.nodes, a.pages), *evidence.extractors(a.pages, a.nodes, a.texts), stats, a.scores, a.recommendations):
        assert "Broadcast" not in plan(part)
    with lying_by_page(spark):
        tree = plan(evidence.hierarchy(a.nodes))
    assert "SortMergeJoin" in tree and not re.search(r"hashpartitioning\(page_id#\d+L, (cast\()?pre", tree)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    cases = spark.createDataFrame([("1", "k", None, page), ("2", "k", None, None)], "id string, category string, url string, snapshot_html string")
    now = run_cases(cases)
    drifts = B.drift(now, B.create_baseline(run_cases(cases), "h"))
    assert "Broadcast" not in plan(drifts) and drifts.count() == 0 and now.count() == 2
