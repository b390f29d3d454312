"""Scores and times over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, RRF_K = 1.5, 0.75, 60
DAY = 8.64e10


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_weight(idf: Column, tf: Column, length: Column, average: Column, k1: float = K1, b: float = B) -> Column:
    """Weight of a term in a document."""
    norm = 1 - b + b * F.greatest(F.lit(1), length) / F.greatest(average, F.lit(1.0))
    return idf * tf * (k1 + 1) / (tf + k1 * norm)


def query_weight(idf: Column, tf: Column) -> Column:
    return idf * (1 + F.log(tf))


def reciprocal_rank(rank: Column, k: int = RRF_K) -> Column:
    return F.coalesce(1.0 / (k + rank), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """The vector over its length; zero stays zero."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))


def parse_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def sunday_week(ts: Column) -> Column:
    """Year, month and week of the year, weeks starting on Sunday."""
    week = F.floor((F.dayofyear(ts) + 6 - (F.dayofweek(ts) - 1)) / 7).cast("int")
    return F.concat(F.date_format(ts, "yyyy-MM-"), F.lpad(week.cast("string"), 2, "0"))


def age_days(ts: Column, at: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(at) - F.unix_micros(ts)) / DAY)


def temporal_utility(ts: Column, mode: Column, at: Column, half_life: float) -> Column:
    """Freshness that halves each ``half_life`` days; its complement for introductions; zero for other modes."""
    fresh = F.exp(-math.log(2) * age_days(ts, at) / half_life)
    return F.when(ts.isNull(), 0.0).when(mode.isin("current", "latest", "as_of"), fresh).when(mode == "introduced", 1 - fresh).otherwise(0.0)


def interpolate(score: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear, constant beyond the ends."""
    out = F.when(score <= xs[0], F.lit(float(ys[0])))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys, strict=True), zip(xs[1:], ys[1:], strict=False), strict=False):
        out = out.when(score <= x1, F.lit(float(y0)) + (score - x0) * ((y1 - y0) / (x1 - x0)))
    return F.when(score.isNull(), None).otherwise(out.otherwise(F.lit(float(ys[-1]))))


def logistic(features: list[Column], mean: list[float], scale: list[float], weights: list[float], bias: float) -> Column:
    z = sum(((f - m) / (s or 1.0) * w for f, m, s, w in zip(features, mean, scale, weights, strict=True)), F.lit(float(bias)))
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-40.0)), F.lit(40.0))))
