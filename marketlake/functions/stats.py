"""Robust statistics as aggregates over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exprs import finite


def floor_percentiles(value: str, rank: str, count: str, p: float) -> Column:
    """The value at index floor(p (n - 1)) of the sorted group, from a row number and a count."""
    return F.max(F.when(F.col(rank) - 1 == F.floor(F.lit(p) * (F.col(count) - 1)), F.col(value)))


def median(x: str) -> Column:
    return F.percentile(finite(x), F.lit(0.5))


def percentile(x: str, p: float) -> Column:
    return F.percentile(finite(x), F.lit(p))


def medians_and_mads(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, c_med, c_mad for every column): two aggregations joined on the group, whose rows are few."""
    med = df.groupBy(*by).agg(*[median(c).alias(f"{c}_med") for c in columns])
    mad = df.join(med, by).groupBy(*by).agg(*[F.percentile(F.abs(finite(c) - F.col(f"{c}_med")),
        F.lit(0.5)).alias(f"{c}_mad") for c in columns])
    return med.join(mad, by)


def winsorized_mean(df: DataFrame, by: list[str], x: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(by, x_wins): the mean after clamping to the two percentiles."""
    q = df.groupBy(*by).agg(percentile(x, low).alias("__lo"), percentile(x, high).alias("__hi"))
    return df.join(q, by).groupBy(*by).agg(F.avg(F.least(F.greatest(finite(x), F.col("__lo")), F.col("__hi"))).alias(f"{x}_wins"))


def finite_range(x: str) -> list[Column]:
    return [F.min(finite(x)).alias(f"{x}_min"), F.max(finite(x)).alias(f"{x}_max")]
