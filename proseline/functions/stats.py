"""Aggregates with the definitions that reports need: rates, nearest-rank percentiles, summaries, correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POINTS = (0.10, 0.25, 0.50, 0.75, 0.90)


def pooled(hits: Column, words: Column) -> Column:
    """Hits for 1000 words of all rows together; 0 without words."""
    return F.when(F.sum(words) > 0, 1000 * F.sum(hits) / F.sum(words)).otherwise(0.0)


def counted(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The distinct values of each group of `by`, with how often they occur (_c), rows up to them (_end) and in all (_n).

    Rows are counted by value before they are shuffled, so what is sorted is distinct values and not rows.
    """
    own = Window.partitionBy(*by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    return counts.withColumns({"_end": F.sum("_c").over(own.orderBy(value)), "_n": F.sum("_c").over(own)})


def nearest(value: str, point: float) -> Column:
    """Of counted values in a group: the value at place floor(point * n) of the rows in order, the last at most."""
    at = F.least(F.floor(F.lit(point) * F.col("_n")), F.col("_n") - 1)
    return F.max(F.when((at < F.col("_end")) & (at >= F.col("_end") - F.col("_c")), F.col(value)))


def percentiles(df: DataFrame, value: str, by: list[str], points: tuple[float, ...] = POINTS) -> DataFrame:
    """by, n and p10 ... of value in each group; groups without a value have none."""
    return (
        counted(df, value, by)
        .groupBy(*by)
        .agg(F.sum("_c").alias("n"), *[nearest(value, p).alias(f"p{int(p * 100)}") for p in points])
    )


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """by, n, mean, median (the upper of two), q1 and q3 of value in each group."""
    return (
        counted(df, value, by)
        .groupBy(*by)
        .agg(
            F.sum("_c").alias("n"),
            (F.sum(F.col(value) * F.col("_c")) / F.sum("_c")).alias("mean"),
            nearest(value, 0.5).alias("median"),
            nearest(value, 0.25).alias("q1"),
            nearest(value, 0.75).alias("q3"),
        )
    )


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows that have both; null for fewer than three of them or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    found = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return F.when(F.sum(both.cast("int")) >= 3, found)
