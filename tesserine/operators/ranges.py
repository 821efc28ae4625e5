"""Running sums and neighbours along an order, without one task for all rows of a group.

Rows are dealt out by ranges of (group, order) and written with the number of their part. Sums run
inside each part; one row a group and part then carries what the parts before it hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.sources.scratch import scratch

FIRST, PRIOR, NOW = Window.unboundedPreceding, -1, 0


def parted(df: DataFrame, group: list[str], by: list) -> DataFrame:
    """``df`` with ``_part``: parts are ranges of (group, by), in rising order of their numbers."""
    return scratch(df.repartitionByRange(*group, *by).withColumn("_part", F.spark_partition_id()), "ranges")


def running_sums(df: DataFrame, group: list[str], by: list, **sums: Column) -> DataFrame:
    """``df`` with, for each name, the sum over the rows of the group before this one; 0 at its start."""
    rows = parted(df.withColumns({f"_{k}": c for k, c in sums.items()}), group, by)
    names = [f"_{k}" for k in sums]
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(FIRST, PRIOR)
    held = rows.groupBy(*group, "_part").agg(*[F.sum(c).alias(c) for c in names])
    held = held.select(*group, "_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in names])
    inside = Window.partitionBy(*group, "_part").orderBy(*by).rowsBetween(FIRST, PRIOR)
    rows = rows.withColumns({f"{c}_inside": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in names})
    out = rows.join(held, [*group, "_part"])
    return out.select(*df.columns, *[(F.col(f"_{k}_inside") + F.col(f"_{k}_before")).alias(k) for k in sums])


def running_fold(df: DataFrame, group: list[str], by: list, value: Column, fold, name: str) -> DataFrame:
    """``df`` with F.max or F.min (``fold``) of a value over the rows of the group up to this one."""
    rows = parted(df.withColumn("_v", value), group, by)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(FIRST, PRIOR)
    inside = Window.partitionBy(*group, "_part").orderBy(*by).rowsBetween(FIRST, NOW)
    rows = rows.withColumn("_inside", fold("_v").over(inside))
    held = rows.groupBy(*group, "_part").agg(fold("_v").alias("_v")).withColumn("_before", fold("_v").over(before)).drop("_v")
    both = F.least if fold is F.min else F.greatest
    return rows.join(held, [*group, "_part"]).select(*df.columns, both("_inside", "_before").alias(name))
