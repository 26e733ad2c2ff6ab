"""Exact percentiles of large groups, without a buffer of a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.session import cut


def group_key(by: tuple[str, ...]) -> Column:
    """The group as one value that joins nulls to nulls."""
    return F.struct(*by) if by else F.lit(0)


def quantiles(rows: DataFrame, value: str, by: tuple[str, ...], discrete: dict[str, float], median: str | None = None) -> DataFrame:
    """``(_k, names...)``: nearest-rank percentiles, and the interpolated median, per group; nulls don't count.

    Values are counted, the distinct ones are sorted by range partitions over all groups, and running counts inside a partition plus
    the counts of the partitions before give every value's ranks; a percentile is the value that holds its rank.  A group of a
    third of all rows spreads over a third of the partitions.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group_key(by).alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = cut(counts.repartitionByRange("_k", "_v").withColumn("_p", F.spark_partition_id()))
    sums = placed.groupBy("_k", "_p").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_k", "_p", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_s"), F.sum("_t").over(Window.partitionBy("_k")).alias("_all"))
    inside = Window.partitionBy("_k", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    at = placed.withColumn("_c", F.sum("_n").over(inside)).join(starts, ["_k", "_p"]).withColumn("_stop", F.col("_s") + F.col("_c"))

    def of(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_stop")) & (rank >= F.col("_stop") - F.col("_n")), F.col("_v")))

    picked = [of(F.greatest(F.lit(1), F.ceil(F.round(F.lit(p) * F.col("_all"), 6))) - 1).alias(name) for name, p in discrete.items()]
    if median:
        low, high = of(F.floor((F.col("_all") - 1) / 2)), of(F.floor(F.col("_all") / 2))
        picked.append(((low + high) / 2).cast("double").alias(median))
    return at.groupBy("_k").agg(*picked)
