"""Page scores: weighted metrics, missing ones left out, contamination and absence taken into account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions.score import clamp_confidence, clamp_score, grade, half_up
from pagelens.operators.metrics import WEIGHTS

CRITICAL_ABSENCES = ["main_landmark", "primary_heading", "fetch_failure"]


def valid_weights(weights: dict[str, float]) -> bool:
    return set(weights) == set(WEIGHTS) and all(w >= 0 for w in weights.values()) and abs(sum(weights.values()) - 1) <= 0.001


def normalize_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """All twelve weights, from the usual ones where missing, scaled to a sum of one at five digits."""
    filled = {m: float((weights or {}).get(m, w)) for m, w in WEIGHTS.items()}
    filled = {m: max(0.0, w) for m, w in filled.items()}
    total = sum(filled.values())
    if total <= 0:
        return dict(WEIGHTS)
    out = {m: int(w / total * 100000 + 0.5) / 100000 for m, w in filled.items()}
    top = max(out, key=lambda m: (out[m], -list(out).index(m)))
    out[top] = int((out[top] + 1 - sum(out.values())) * 100000 + 0.5) / 100000
    return out


def weight_column(weights: dict[str, float], metric: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), metric)


def effective_weights(metric_rows: DataFrame, weights: dict[str, float], id_col: str = "page_id") -> DataFrame:
    """Weights of the metrics that have a score, scaled to a sum of one per page, rounding drift on the largest."""
    place = F.array_position(F.array(*map(F.lit, weights)), F.col("metric"))
    rows = metric_rows.withColumn("place", place).withColumn("base", F.when(F.col("score").isNotNull(), weight_column(weights, F.col("metric"))).otherwise(0.0))
    page = W.partitionBy(id_col)
    active = F.sum("base").over(page)
    rows = rows.withColumn("weight", F.when(F.col("base") > 0, half_up(F.col("base") / active, 5)).otherwise(0.0))
    rows = rows.withColumn("drift", half_up(1 - F.sum("weight").over(page), 5)).withColumn("rank", F.row_number().over(page.orderBy(F.desc("weight"), "place")))
    fixed = F.when((F.col("rank") == 1) & (F.abs("drift") > 0.00001) & (F.col("weight") > 0), half_up(F.col("weight") + F.col("drift"), 5)).otherwise(F.col("weight"))
    return rows.withColumn("weight", fixed).drop("base", "drift", "rank")


def final_scores(metric_rows: DataFrame, stats: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", dominance: bool = True) -> DataFrame:
    """One row per page: the weighted score before and after absence dominance, confidence, status and grade.

    stats has id_col and, for pages, contamination_type, blocked and absent. A blocked page, and one without any
    metric, has null scores. With dominance, a page without a main landmark or h1, or with eight absences and a score
    under 30, is scored 0 at confidence .2; weighted_score keeps what it had.
    """
    usual = normalize_weights(weights)
    rows = effective_weights(metric_rows, usual, id_col)
    terms = F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("place", (F.col("score") * F.col("weight")).alias("s"), (F.col("confidence") * F.col("weight")).alias("c")))))
    total = lambda name: F.aggregate("terms", F.lit(0.0), lambda a, t: a + t[name])
    per = rows.groupBy(id_col).agg(terms.alias("terms"), F.count("score").alias("metrics"))
    has = set(stats.columns)
    blocked = F.coalesce(F.col("blocked"), F.lit(False)) if "blocked" in has else F.lit(False)
    dirty = F.col("contamination_type").isNotNull() if "contamination_type" in has else F.lit(False)
    absent = F.col("absent") if "absent" in has else F.array().cast("array<string>")
    joined = stats.join(per, id_col, "left").withColumn("usable", ~blocked & (F.coalesce("metrics", F.lit(0)) > 0))
    joined = joined.withColumn("weighted_score", F.when(F.col("usable"), clamp_score(total("s")))).withColumn("confidence", F.when(F.col("usable"), clamp_confidence(F.when(dirty, total("c") * 0.7).otherwise(total("c")))))
    dominated = F.arrays_overlap(absent, F.array(*map(F.lit, CRITICAL_ABSENCES))) | ((F.size(absent) >= 8) & (F.col("weighted_score") < 30))
    joined = joined.withColumn("dominated", F.col("usable") & (F.coalesce(dominated, F.lit(False)) if dominance else F.lit(False)))
    score = F.when(F.col("dominated"), 0.0).otherwise(F.col("weighted_score"))
    status = F.when(blocked, "blocked").when(~F.col("usable"), "insufficient_evidence").when(F.col("dominated"), "scored_absence_evidence").otherwise("scored")
    return joined.select(id_col, "weighted_score", score.alias("final_score"), F.when(F.col("dominated"), 0.2).otherwise(F.col("confidence")).alias("confidence"), status.alias("status"), grade(score).alias("grade"), F.coalesce("metrics", F.lit(0)).alias("metrics"), *([F.col("contamination_type")] if "contamination_type" in has else []))


def score_summary(metric_rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Metrics of a page side by side."""
    return metric_rows.groupBy(id_col).pivot("metric", list(WEIGHTS)).agg(F.first("score"))
