"""Budgets, quotas and deterministic samples.

Where a seeded shuffle would decide, rows are ordered by the SHA-256 of seed and key: the same quotas, reproducible
by any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import hash_id
from sievework.session import cut


def hash_order(seed: int, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *parts), 256)


def largest_remainder(shares: DataFrame, total: int) -> DataFrame:
    """``(key, share)`` to whole budgets that add up: floors, then one more by largest fraction, then key."""
    exact = F.col("share") * F.lit(total)
    base = shares.select("key", F.floor(exact).alias("base"), F.round(exact - F.floor(exact), 9).alias("fraction"))
    left = F.lit(total) - F.sum("base").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("fraction"), "key"))  # one row per share: a handful
    return base.select("key", (F.col("base") + F.when(rank <= left, 1).otherwise(0)).alias("budget"))


def balance_target(counts: DataFrame, target: str | int = "median") -> DataFrame:
    """The one-row target for balancing: min, max, median (half-even, at least 1) or a positive number."""
    if target in ("none", "off", "disabled"):
        return counts.agg(F.lit(None).cast("bigint").alias("target"))
    if target == "min":
        return counts.agg(F.min("n").alias("target"))
    if target == "max":
        return counts.agg(F.max("n").alias("target"))
    if target == "median":
        return counts.agg(F.greatest(F.lit(1), F.bround(F.median("n"))).cast("bigint").alias("target"))
    if int(target) < 1:
        raise ValueError("a balance target must be positive")
    return counts.agg(F.lit(int(target)).cast("bigint").alias("target"))


def ranked_in(rows: DataFrame, by: str, order: Column, name: str = "r") -> DataFrame:
    """0-based rank within ``by`` without one task per group: ranks in hashed blocks plus the blocks' offsets.

    Blocks are ranges of the hash order, so the rank is the one a window over the whole group would give.
    """
    block = F.substring(order, 1, 2)  # 256 ranges of a hexadecimal hash
    keyed = rows.withColumn("_o", order).withColumn("_b", block)
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(by, "_b").agg(F.count("*").alias("_n")).select(by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    own = F.row_number().over(Window.partitionBy(by, "_b").orderBy("_o")) - 1
    return keyed.withColumn("_r", own).join(offsets, [by, "_b"]).withColumn(name, F.col("_off") + F.col("_r")).drop("_o", "_b", "_n", "_off", "_r")


def balanced(rows: DataFrame, by: str, key: str, target: str | int = "median", seed: int = 42) -> DataFrame:
    """Exactly ``target`` rows per group: the hash order is cycled, and every use gets an instance id.

    Groups above the target are cut, groups below are repeated; ``occurrence`` counts the uses of a row.
    """
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    plan = counts.crossJoin(F.broadcast(balance_target(counts, target)))
    ranked = ranked_in(rows, by, hash_order(seed, F.col(by).cast("string"), F.col(key).cast("string")))
    uses = F.ceil((F.coalesce("target", "n") - F.col("r")) / F.col("n")).cast("int")
    return (
        ranked.join(plan, by)
        .where(F.col("r") < F.coalesce("target", "n"))
        .withColumn("occurrence", F.explode(F.sequence(F.lit(0), uses - 1)))
        .withColumn("instance_id", hash_id("", F.col(by).cast("string"), F.col(key).cast("string"), F.col("occurrence").cast("string"), digits=20))
        .drop("r", "n", "target")
    )


def replay_quota(counts: DataFrame, budget: int, seed: int) -> DataFrame:
    """``(key, n)`` to equal quotas; the remainder goes to the keys with the smallest hashes."""
    n = F.count("*").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit("dimension-remainder"), F.col("key")), 256)))
    base = F.floor(F.lit(budget) / n)
    return counts.select("key", (base + F.when(rank <= F.lit(budget) - base * n, 1).otherwise(0)).alias("quota"))


def waterfill_quota(capacity: DataFrame, count: int, seed: int, label: str) -> DataFrame:
    """Water-filling: ``(key, capacity, shared, baseline)`` to quotas that add up to ``count`` if the capacities allow.

    The k-th unit of a key costs (shared + k, baseline + shared + k, hash); costs rise with k, so taking the
    cheapest ``count`` units is what a greedy loop would do, and it is a sort with a limit.
    """
    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit("dimension-waterfill"), F.lit(label), F.col("key")), 256)
    units = capacity.where("capacity > 0").select(
        "key", "shared", "baseline", h.alias("h"), F.explode(F.sequence(F.lit(0), F.least(F.col("capacity"), F.lit(count)).cast("int") - 1)).alias("k")
    )
    taken = units.orderBy(F.col("shared") + F.col("k"), F.col("baseline") + F.col("shared") + F.col("k"), "h").limit(count)
    got = taken.groupBy("key").agg(F.count("*").alias("quota"))
    return cut(capacity.select("key").join(got, "key", "left").select("key", F.coalesce("quota", F.lit(0)).alias("quota")))


def take_quota(rows: DataFrame, quotas: DataFrame, by: str, key: str, cap: int, seed: int, label: str) -> DataFrame:
    """Rows by group quota: hash order, cycled at most ``cap`` times."""
    ranked = ranked_in(rows, by, hash_order(seed, F.lit(label), F.col(key).cast("string")))
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    uses = F.least(F.lit(cap), F.ceil((F.col("quota") - F.col("r")) / F.col("n"))).cast("int")
    return (
        ranked.join(counts.join(quotas.withColumnRenamed("key", by), by), by)
        .where("r < quota")
        .withColumn("occurrence", F.explode(F.sequence(F.lit(0), uses - 1)))
        .drop("r", "n", "quota")
    )


def quota_summary(quotas: DataFrame) -> DataFrame:
    return quotas.agg(
        F.count("*").alias("groups"), F.sum("quota").alias("rows"), F.min("quota").alias("min"), F.max("quota").alias("max"),
        (F.max("quota") - F.min("quota")).alias("spread"),
    )
