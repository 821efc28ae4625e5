"""Histograms and series of samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(value: Column, bounds: Sequence[float]) -> Column:
    """Number of the first bound that is not below the value; one more for values beyond all."""
    out = F.lit(len(bounds))
    for k in range(len(bounds) - 1, -1, -1):
        out = F.when(value <= bounds[k], k).otherwise(out)
    return out


def histogram(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(bucket(F.col(value), bounds).alias("bucket")).agg(F.count("*").alias("n"), F.max(value).alias("top"))


def histogram_percentile(df: DataFrame, value: str, bounds: Sequence[float], shares: Sequence[int]) -> DataFrame:
    """For each share in per cent, the least bound that so many samples do not exceed; the largest
    sample beyond the bounds. The windows run over the buckets, not the rows."""
    edge = F.coalesce(*[F.when(F.col("bucket") == k, float(b)) for k, b in enumerate(bounds)], F.col("top"))
    w = Window.orderBy("bucket")
    cum = histogram(df, value, bounds).withColumn("edge", edge).withColumn("cum", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))
    asked = cum.withColumn("share", F.explode(F.array(*map(F.lit, shares))))
    return asked.filter("cum * 100 >= total * share").groupBy("share").agg(F.min("edge").alias("bound"))


def deltas(df: DataFrame, by: str, order: str, value: str, skip: int = 2) -> DataFrame:
    """Each sample less the one before it, without the first ``skip`` of each series."""
    w = Window.partitionBy(by).orderBy(order)
    out = df.withColumn("delta", F.col(value) - F.lag(value).over(w)).withColumn("rn", F.row_number().over(w))
    return out.filter(F.col("rn") > skip).drop("rn")


def last_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each series."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("rn") <= n).drop("rn")
