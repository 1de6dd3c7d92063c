"""Score arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(col: Column, digits: int) -> Column:
    """Rounds .5 up, as floor(x + .5) does."""
    scale = float(10**digits)
    return F.floor(col * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clamp_score(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), half_up(col, 2)))


def clamp_confidence(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), half_up(col, 4)))


def ladder(col: Column, steps: list[tuple[float, float]], otherwise: float | Column) -> Column:
    """The first step (least value, result) that col reaches."""
    out = F.when(F.lit(False), F.lit(0.0))
    for least, result in steps:
        out = out.when(col >= least, F.lit(float(result)))
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(float(otherwise)))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def grade(score: Column) -> Column:
    return F.when(score.isNull(), "N/A").when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
