"""Diagnostics and reports over small tables of scores."""

import json

from pyspark.sql import functions as F

from pagelens.operators import diagnostics as D
from pagelens.operators import reports
from pagelens.operators.metrics import WEIGHTS, text_metrics

SCORES = "page_id long, final_score double, weighted_score double, confidence double, status string, grade string, metrics long, contamination_type string"


def tables(spark):
    scores = spark.createDataFrame([(1, 70.0, 70.0, 0.8, "scored", "C", 12, "shadow_dom"), (2, None, None, None, "blocked", "N/A", 0, "hydration_shell"), (3, 0.0, 50.0, 0.2, "scored_absence_evidence", "F", 12, None), (4, None, None, None, "insufficient_evidence", "N/A", 0, None)], SCORES)
    rows = [(i, m, None if m in gone else 55.0, 0.5, {"z": 40.0, "a": 41.0, "fine": 90.0}) for i, gone in ((1, ("clarity", "readability")), (3, ())) for m in reversed(WEIGHTS)]
    return scores, spark.createDataFrame(rows, "page_id long, metric string, score double, confidence double, parts map<string,double>")


def test_formula(spark):
    rows = spark.createDataFrame([("readability", 71.5), ("clarity", None)], "metric string, score double")
    got = {r.metric: r.formula for r in D.metric_formulas(rows, text_metrics()).collect()}
    assert got["readability"] == "sentence_length×0.3 + word_complexity×0.25 + words_per_sentence×0.25 + text_volume×0.2 = 71.50"
    assert got["clarity"].endswith(" = null")


def test_complete_metrics(spark):
    scores, rows = tables(spark)
    got = D.complete_metrics(scores, rows.where("metric <> 'semantic'")).orderBy("page_id", "place").collect()
    assert [r.metric for r in got] == [*WEIGHTS] * 4
    assert [r.score for r in got if r.page_id in (2, 4)] == [None] * 24 and sum(r.score is not None for r in got if r.page_id == 1) == 9


def test_diagnostics(spark):
    scores, rows = tables(spark)
    stats = scores.select("page_id", F.when(F.col("page_id") == 3, F.array(F.lit("main_landmark"), F.lit("h1"))).alias("absent"))
    found = D.scoring_diagnostics(stats, rows)
    got = {r.page_id: (r.missing, r.absence) for r in found.collect()}
    assert got[1] == (["[readability] insufficient evidence", "[clarity] insufficient evidence"], []) and got[2] == ([], [])
    assert got[3] == ([], ["[absence] h1", "[absence] main_landmark"])
    said = {r.page_id: r for r in D.report_diagnostics(scores, found).collect()}
    assert said[1].warnings == ["Pipeline warning: contamination (shadow_dom) affected scoring confidence", "Pipeline warning: 2 metric(s) had insufficient evidence"]
    assert said[2].skipped and said[2].skip_reason.endswith("hydration_shell") and not said[4].skipped and len(said[4].warnings) == 1
    assert D.report_diagnostics(scores.where("false"), found).count() == 0


def test_reports(spark):
    scores, rows = tables(spark)
    recs = spark.createDataFrame([], "page_id long, metric string, category string, priority string, message string, confidence double, rank int, place int, i int, id string")
    weak = reports.weaknesses(scores, rows)
    got = {r.page_id: json.loads(r.report) for r in reports.summary_report(scores, recs, weak).collect()}
    assert got[3]["weaknesses"][:4] == ["readability.a", "readability.z", "structure.a", "structure.z"] and len(got[3]["weaknesses"]) == 24
    assert got[1]["weaknesses"][0] == "structure.a" and got[2]["weaknesses"] == ["Scoring blocked: hydration_shell"]
    assert got[1]["version"] == D.VERSIONS and got[4]["weaknesses"] == ["Scoring blocked: contamination detected"]
    signals = spark.createDataFrame([(1, "links"), (1, "links"), (1, "lists")], "page_id long, section string")
    found = D.scoring_diagnostics(scores.withColumn("absent", F.array().cast("array<string>")), rows)
    made = reports.developer_report(scores, rows, found, D.report_diagnostics(scores, found), signals, signals.distinct())
    got = {r.page_id: json.loads(r.report) for r in made.collect()}
    assert got[1]["evidence"] == {"links": 2, "lists": 1} and got[1]["normalized"] == {"links": 1, "lists": 1}
    assert [m["metric"] for m in got[1]["score"]["metrics"]] == list(WEIGHTS) and got[2]["diagnostics"]["skipped"] is True
