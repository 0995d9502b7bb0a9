"""Scores and time as column expressions."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIORITY_WEIGHT = {0: 4.0, 1: 3.0, 2: 2.0, 3: 1.0}
PRIORITY_PRIOR = {0: 1.0, 1: 0.75, 2: 0.5, 3: 0.25}
VITALITY_FLOOR = {0: 1.0, 1: 0.3, 2: 0.1, 3: 0.0}


def lookup(c: Column, table: Mapping, default: float) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(c == key, F.lit(value)) if out is None else out.when(c == key, F.lit(value))
    return out.otherwise(F.lit(default))


def clamp01(c: Column) -> Column:
    """Into [0, 1]; what isn't a finite number is 0."""
    c = c.cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def overlap(a: Column, b: Column) -> Column:
    """Shared part of two sets by the larger of them; 0 where one is empty."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / most).otherwise(F.lit(0.0))


def instant(when: datetime | str | Column) -> Column:
    return when if isinstance(when, Column) else F.lit(str(when)).cast("timestamp")


def days(earlier: Column, later: datetime | str | Column) -> Column:
    """Days, with fractions, from one instant to another."""
    return (F.unix_micros(instant(later)) - F.unix_micros(earlier)) / F.lit(86_400_000_000.0)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for vectors of different size or zero length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def vitality(stability: Column, age_days: Column, priority: Column) -> Column:
    """Forgetting curve exp(-days/stability) above the floor of the priority; the highest never fades."""
    curve = F.exp(-age_days / F.greatest(stability, F.lit(0.01)))
    return F.when(priority == 0, F.lit(1.0)).otherwise(F.greatest(lookup(priority, VITALITY_FLOOR, 0.0), curve))


def relative_date(when: Column, now: datetime | str) -> Column:
    """今天, 昨天, N天前 up to a week, else the date; by days elapsed, not by calendar days."""
    n = F.floor(days(when, now))
    return F.when(n <= 0, F.lit("今天")).when(n == 1, F.lit("昨天")).when(n <= 7, F.concat(n.cast("string"), F.lit("天前"))).otherwise(F.date_format(when, "yyyy-MM-dd"))


def rank_score(rank: Column, window: int) -> Column:
    return F.when(rank.isNull() | (rank == 0), F.lit(0.0)).otherwise(clamp01(1 - (rank - 1) / F.lit(max(window, 1))))
