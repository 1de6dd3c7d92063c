"""Corpus runs, baselines, drift and regression: joins and groupings over results by case.

Results: case_id, category, status (ok or error), final_score, confidence, metrics map<string,double>,
recommendations array<string>, absence array<string>, contamination_type, runtime_ms.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import text as T
from pagelens.functions.score import half_up
from pagelens.operators.baselines import Store, compatible
from pagelens.operators.fingerprint import ordered_fnv1a
from pagelens.operators.metrics import WEIGHTS
from pagelens.plans.scratch import materialize

# Tolerances of drift, and shares from which a category and a corpus have drifted.
SCORE_TOLERANCE, CONFIDENCE_TOLERANCE, METRIC_TOLERANCE = 0.5, 0.05, 0.5
CATEGORY_SHARE, CATEGORIES, CASE_SHARE = 0.05, 2, 0.10
#: Hashes that one step of a corpus hash joins.
RUN = 1024
CRITICAL_METRICS = ["semanticStructure", "extractability", "machineComprehension"]


def case_line(corpus: DataFrame) -> Column:
    size = F.coalesce(F.length("snapshot_html"), F.lit(0)) if "snapshot_html" in corpus.columns else F.lit(0)
    return F.concat_ws("|", "id", "category", F.coalesce("url", F.lit("")), size.cast("string"), F.coalesce("expected_type", F.lit("")) if "expected_type" in corpus.columns else F.lit(""), F.array_join(F.coalesce("tags", F.array()), ",") if "tags" in corpus.columns else F.lit(""))


def case_hashes(corpus: DataFrame) -> DataFrame:
    """A 32-bit FNV-1a of every case's line."""
    return corpus.select("id", "category", T.fnv1a(case_line(corpus)).alias("case_hash"))


def corpus_hash(corpus: DataFrame, run: int = RUN) -> DataFrame:
    """One hash for a corpus in (category, id) order, as (corpus_hash, cases).

    Cases' hashes are cut in that order into runs of `run`, each run's hashes joined by line feeds are hashed, the runs'
    hashes are cut and hashed in the same way, level by level, until one is left. So no group holds more than `run`
    rows. Nulls come first in the order and repeated cases are told apart by their hashes. An empty corpus has the hash
    of the empty text and null cases.
    """
    ordered = case_hashes(corpus).repartitionByRange("category", "id", "case_hash").sortWithinPartitions("category", "id", "case_hash")
    # the id that Spark gives a row has the partition above its 33 lowest bits, and the row's place in it there
    placed = materialize(ordered.select("case_hash", F.monotonically_increasing_id().alias("at")), "case-hashes")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    starts = list(accumulate((r.n for r in counts), initial=0))
    first = corpus.sparkSession.createDataFrame([(r.part, start) for r, start in zip(counts, starts)], "part long, start long")
    rows = starts[-1]
    level = placed.withColumn("part", part).join(F.broadcast(first), "part").select((F.col("start") + place).alias("pos"), F.col("case_hash").alias("h"), F.lit(1).cast("long").alias("n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda c: c["h"]), "\n")
    while rows > run:
        level = level.groupBy(F.floor(F.col("pos") / run).alias("above")).agg(T.fnv1a(joined).alias("h"), F.sum("n").alias("n")).withColumnRenamed("above", "pos")
        rows = -(-rows // run)
    return level.agg(T.fnv1a(joined).alias("corpus_hash"), F.sum("n").alias("cases"))


def duplicates(corpus: DataFrame, column: str) -> DataFrame:
    return corpus.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def validate_cases(corpus: DataFrame) -> DataFrame:
    """(id, problem) of each thing wrong with a case."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    problems = F.array_compact(F.array(F.when(blank("id"), "missing id"), F.when(blank("category"), "empty category"), F.when(blank("url"), "missing url"), F.when(~blank("url") & ~T.is_valid_url(F.col("url")), "invalid url")))
    return corpus.select("id", F.explode(problems).alias("problem"))


def run_summary(results: DataFrame) -> DataFrame:
    """Totals and per-category counts of passed and failed cases; category null is the grand total."""
    return results.rollup("category").agg(F.count("*").alias("total"), F.sum((F.col("status") == "ok").cast("int")).alias("passed"), F.sum((F.col("status") != "ok").cast("int")).alias("failed"), half_up(F.avg("final_score"), 2).alias("mean_score"), F.median("final_score").alias("median_score"))


def runtime_stats(results: DataFrame) -> DataFrame:
    """Mean and median runtime, slowest and fastest case (ties: the smaller id)."""
    order = lambda sign: F.struct(sign * F.col("runtime_ms"), "case_id")
    return results.where("runtime_ms is not null").agg(F.avg("runtime_ms").alias("mean_ms"), F.median("runtime_ms").alias("median_ms"), F.min_by("case_id", order(-1)).alias("slowest"), F.min_by("case_id", order(1)).alias("fastest"))


def create_baseline(results: DataFrame, corpus_hash_: str | Column) -> DataFrame:
    """Results as a baseline; of a repeated case the last by run_order stays (any, without one)."""
    order = F.col("run_order") if "run_order" in results.columns else F.lit(0)
    last = results.groupBy("case_id").agg(F.max_by(F.struct(*results.columns), order).alias("r"))
    return last.select("r.*", (F.lit(corpus_hash_) if isinstance(corpus_hash_, str) else corpus_hash_).alias("corpus_hash"))


def store_baseline(baseline: DataFrame, path: str, corpus_hash_: str) -> int:
    """Stores a corpus' baseline as its next version and returns that; other corpora in the folder stay as they are."""
    return Store(baseline.sparkSession, path).store(baseline, corpus_hash_)


def load_baseline(spark, path: str, corpus_hash_: str, version: int | None = None) -> DataFrame | None:
    """The stored baseline of that corpus, its last version by default; None if there is none."""
    return Store(spark, path).load(corpus_hash_, version)


def serialize_baseline(baseline: DataFrame) -> DataFrame:
    """One JSON line per case."""
    return baseline.select(F.to_json(F.struct(*baseline.columns)).alias("line"))


def deserialize_baseline(lines: DataFrame, schema) -> DataFrame:
    """Cases of JSON lines; lines that are broken or lack a case, status or corpus hash come back with problem set."""
    parsed = lines.select("line", F.from_json("line", schema, {"mode": "PERMISSIVE"}).alias("r"))
    problem = F.when(F.try_parse_json("line").isNull(), "invalid json").when(F.col("r.case_id").isNull() | F.col("r.status").isNull() | F.col("r.corpus_hash").isNull(), "missing fields")
    return parsed.select("r.*", problem.alias("problem"))


def compare_or_store(current: DataFrame, path: str, corpus_hash_: str) -> DataFrame | None:
    """Drift against the stored baseline of this corpus; stores current as its first version and returns None where there is none.

    If another run stores one meanwhile, that is the baseline. ValueError if the two cannot be compared.
    """
    store = Store(current.sparkSession, path)
    stored = store.load(corpus_hash_)
    if stored is None:
        if store.store(create_baseline(current, corpus_hash_), corpus_hash_, version=1):
            return None
        stored = store.load(corpus_hash_)
    if problems := compatible(stored, current):
        raise ValueError("; ".join(problems))
    return drift(current, stored)


def _record(kind: str, when: Column, base: Column, now: Column, delta: Column, metric: Column | None = None) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("type"), (F.lit(None) if metric is None else metric).cast("string").alias("metric"), base.cast("string").alias("baseline_value"), now.cast("string").alias("current_value"), delta.cast("double").alias("delta")))


def _number(kind: str, b: Column, n: Column, tolerance: float, metric: Column | None = None) -> Column:
    moved = F.when(b.isNotNull() & n.isNotNull(), F.abs(n - b) > tolerance).otherwise(b.isNotNull() | n.isNotNull())
    return _record(kind, moved, b, n, F.coalesce(n - b, F.lit(0.0)), metric)


def _set(kind: str, b: Column, n: Column) -> Column:
    b, n = F.coalesce(b, F.array()), F.coalesce(n, F.array())
    other = (F.size(b) != F.size(n)) | (F.size(F.array_except(n, b)) > 0)
    return _record(kind, other, F.size(b), F.size(n), F.size(n) - F.size(b))


def drift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Drift records of all cases: (case_id, category, type, metric, baseline_value, current_value, delta).

    A full outer join by case: a case on one side alone is a schema drift, and so is a change between ok and error;
    cases in error on both sides have none.
    """
    b, n = baseline.alias("b"), current.alias("n")
    joined = n.join(b, F.col("n.case_id") == F.col("b.case_id"), "full_outer")
    now, old = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"b.{c}"))
    both = now("case_id").isNotNull() & old("case_id").isNotNull()
    errors = both & (now("status") != old("status"))
    fine = both & (now("status") == "ok") & (old("status") == "ok")
    numbers = [_number("score", old("final_score"), now("final_score"), SCORE_TOLERANCE), _number("confidence", old("confidence"), now("confidence"), CONFIDENCE_TOLERANCE)]
    numbers += [_number("metric", old("metrics")[m], now("metrics")[m], METRIC_TOLERANCE, F.lit(m)) for m in WEIGHTS]
    kinds = [F.coalesce(s("contamination_type"), F.lit("none")) for s in (old, now)]
    checks = [
        *numbers,
        _set("recommendation", old("recommendations"), now("recommendations")),
        _set("absence_evidence", old("absence"), now("absence")),
        _record("contamination", kinds[0] != kinds[1], kinds[0], kinds[1], (kinds[1] != "none").cast("int") - (kinds[0] != "none").cast("int")),
    ]
    records = (
        F.when(old("case_id").isNull(), F.array(_record("schema", F.lit(True), F.lit("not in baseline"), F.lit("present"), F.lit(1))))
        .when(now("case_id").isNull(), F.array(_record("schema", F.lit(True), F.lit("present"), F.lit("missing"), F.lit(-1))))
        .when(errors, F.array(_record("schema", F.lit(True), old("status"), now("status"), F.when(now("status") == "error", 1).otherwise(-1))))
        .when(fine, F.array_compact(F.array(*checks)))
    )
    return joined.select(F.coalesce(now("case_id"), old("case_id")).alias("case_id"), F.coalesce(now("category"), old("category")).alias("category"), F.inline(records))


def critical_drift(drifts: DataFrame) -> DataFrame:
    return drifts.where((F.col("type") == "metric") & F.col("metric").isin(CRITICAL_METRICS))


def category_verdicts(current: DataFrame, baseline: DataFrame, drifts: DataFrame) -> DataFrame:
    """Share of each category's cases (those in the baseline) that drift, and whether it is too many."""
    known = current.join(baseline.select("case_id"), "case_id", "left_semi").select("case_id", "category")
    moved = drifts.select("case_id").distinct().withColumn("moved", F.lit(1))
    per = known.join(moved, "case_id", "left").groupBy("category").agg(F.count("*").alias("cases"), F.sum(F.coalesce("moved", F.lit(0))).alias("drifted"))
    return per.withColumn("drifts", F.col("drifted") / F.col("cases") >= CATEGORY_SHARE)


def corpus_verdict(current: DataFrame, baseline: DataFrame, drifts: DataFrame) -> DataFrame:
    """One row: whether the corpus has drifted and for what reason (schema, categories, cases, none)."""
    cases = drifts.agg(F.countDistinct("case_id").alias("moved"), F.countDistinct(F.when(F.col("type") == "schema", F.col("case_id"))).alias("schema_drifts"))
    categories = category_verdicts(current, baseline, drifts).agg(F.sum(F.col("drifts").cast("int")).alias("categories"))
    total = current.agg(F.count("*").alias("cases"))
    key = lambda df: df.withColumn("one", F.lit(1))
    one = key(cases).join(key(categories), "one").join(key(total), "one").drop("one")  # three single rows
    reason = F.when(F.col("schema_drifts") > 0, "schema").when(F.coalesce("categories", F.lit(0)) >= CATEGORIES, "categories").when(F.col("moved") >= CASE_SHARE * F.col("cases"), "cases").otherwise("none")
    return one.withColumn("reason", F.when(F.col("cases") > 0, reason).otherwise("none")).withColumn("drifted", F.col("reason") != "none")


def drift_by(drifts: DataFrame, column: str) -> DataFrame:
    return drifts.groupBy(column).agg(F.count("*").alias("records"), F.countDistinct("case_id").alias("cases"))


def corpus_fingerprint(corpus: DataFrame) -> DataFrame:
    """(corpus_hash, cases): the FNV-1a of all cases' lines in (category, id) order, joined by line feeds."""
    return ordered_fnv1a(corpus, case_line(corpus), "category", "id").toDF("corpus_hash", "cases")
