"""A dimension-aware train and dev split that keeps story clusters whole.

The choice is sequential and looks at clusters only, so rows are first aggregated to (cluster, dimension,
count).  Clusters of equal profile are interchangeable up to their tie-breaker, so Spark counts the clusters of every
profile and ranks them by tie-breaker; the greedy runs on the driver over the classes of all profiles, one numpy step
a pick, and the picked ranks are joined back.  The driver holds one row per distinct profile and, where classes tie, the
tie-breakers it has come to, never the clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import tie_breaker
from sievework.operators.sampling import ranked_in
from sievework.session import cut, written


#: How much rows beyond a dimension's need, and beyond the goal, count against a cluster.
OVERSUPPLY, OVERSHOOT = 0.20, 2.0


def cluster_profile(rows: DataFrame, cluster: Column, dimension: Column) -> DataFrame:
    """``(cluster, dims array<struct<dimension, n>>, class)``: equal profiles have the same class."""
    n = rows.groupBy(cluster.alias("cluster"), dimension.alias("dimension")).agg(F.count("*").alias("n"))
    per = n.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("dimension", "n"))).alias("dims"))
    return per.withColumn("class", F.xxhash64("dims"))


def choose_dev(
    classes: list[tuple[dict[str, int], int]], fraction: float, stay: dict[str, int], first: Callable[[list[int], np.ndarray], int]
) -> tuple[np.ndarray, set[str]]:
    """How many clusters of each class go to dev, and the dimensions that can't be in dev without leaving train.

    ``classes`` has the rows per dimension of a cluster and the number of such clusters, ``stay`` the rows per dimension that
    belong to no cluster and stay in train; ``first`` names, of classes and the picks so far, the class whose next cluster
    has the best tie-breaker.  First every dimension is covered by the cluster with the best coverage per square root of its
    rows, as long as each of its dimensions keeps a cluster in train; then clusters are added while that brings the rows
    nearer to the target, each time the one that fills most open need with least oversupply and overshoot.
    """
    picks = np.zeros(len(classes), np.int64)
    names = sorted({d for dims, _ in classes for d in dims} | set(stay))
    if not classes:
        return picks, set(names)
    at = {d: i for i, d in enumerate(names)}
    counts, fixed = np.zeros((len(classes), len(names))), np.array([float(stay.get(d, 0)) for d in names])
    for k, (dims, _) in enumerate(classes):
        for d, n in dims.items():
            counts[k, at[d]] = n
    size, has = counts.sum(1), counts > 0
    many = np.array([n for _, n in classes])
    whole = (counts * many[:, None]).sum(0) + fixed
    goal = max(1, round(whole.sum() * fraction))
    target = whole * fraction
    left = (has * many[:, None]).sum(0) + fixed
    base, held = np.maximum(target, 1e-9), np.zeros(len(names))
    rows = 0.0

    def best(*keys: np.ndarray) -> int:
        """The class with a cluster left that is largest by the keys, then by its next cluster's tie-breaker."""
        hit = np.flatnonzero(many > 0)
        for key in keys:
            hit = hit[key[hit] == key[hit].max()]
        return int(hit[0]) if len(hit) == 1 else first(hit.tolist(), picks)

    def move(k: int) -> None:
        nonlocal rows, held
        picks[k] += 1
        many[k] -= 1
        rows += size[k]
        held = held + counts[k]

    open_ = np.ones(len(names), bool)
    while open_.any():
        hits = (has & open_).sum(1).astype(float)
        fits = (hits > 0) & ~(has & (left <= 1)).any(1) & (many > 0)
        if not fits.any():
            break
        k = best(np.where(fits, hits / np.maximum(np.sqrt(size), 1), -np.inf), hits, -size)
        move(k)
        open_ &= ~has[k]
        left = left - has[k]
    lack = np.maximum(target - held, 0)
    gains = (np.minimum(counts, lack) - OVERSUPPLY * np.maximum(counts - lack, 0)) / base
    while (many > 0).any() and rows < goal:
        over = OVERSHOOT * np.maximum(rows + size - goal, 0) / max(goal, 1)
        k = best(gains.sum(1) - over, -np.abs(goal - rows - size))
        if rows and abs(goal - rows) <= abs(goal - rows - size[k]):
            break
        move(k)
        d = np.flatnonzero(has[k])  # only these dimensions' needs have changed
        lack[d] = np.maximum(target[d] - held[d], 0)
        gains[:, d] = (np.minimum(counts[:, d], lack[d]) - OVERSUPPLY * np.maximum(counts[:, d] - lack[d], 0)) / base[d]
    return picks, {names[i] for i in np.flatnonzero(open_)}


def _members(profile: DataFrame, seed: int) -> DataFrame:
    """``(cluster, class, tie, r)``: every cluster's tie-breaker in hexadecimal and its rank in its class."""

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ties = [f"{tie_breaker(seed, c):016x}" for c in b.column("cluster").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("cluster"), b.column("class"), pa.array(ties, pa.string())], names=["cluster", "class", "tie"])

    with_ties = profile.select("cluster", "class").mapInArrow(tied, "cluster string, class bigint, tie string")
    return written(ranked_in(with_ties, "class", F.concat("tie", "cluster")), "members")


def _first(members: DataFrame, ids: list[int]) -> Callable[[list[int], np.ndarray], int]:
    """Compares the next tie-breakers of classes; they are read from the members as the greedy uses them up."""
    held: list[list[str]] = [[] for _ in ids]
    at = {c: k for k, c in enumerate(ids)}

    def first(hit: list[int], picks: np.ndarray) -> int:
        if any(picks[k] >= len(held[k]) for k in hit):
            low = [(c, len(held[k]), max(16, 4 * int(picks[k]))) for k, c in enumerate(ids) if len(held[k]) <= 2 * picks[k]]
            asked = members.sparkSession.createDataFrame(low, "class bigint, lo bigint, hi bigint")
            got = members.join(asked, "class").where("r >= lo AND r < hi").select("class", "r", "tie").toArrow()
            for c, _, t in sorted(zip(*(got.column(i).to_pylist() for i in range(3)))):
                held[at[c]].append(t)
        return min(hit, key=lambda k: held[k][picks[k]])

    return first


def train_dev_split(rows: DataFrame, cluster: str = "story_cluster_id", dimension: str = "dimension", fraction: float = 0.10, seed: int = 42) -> DataFrame:
    """The rows with ``split``: ``dev`` for rows of dev clusters, else ``train``; rows without a cluster are ``train``.

    The fraction refers to all rows, with or without a cluster.
    """
    spark = rows.sparkSession
    named = F.coalesce(F.col(dimension), F.lit("missing"))
    profile = cut(cluster_profile(rows.where(F.col(cluster).isNotNull()), F.col(cluster), named))
    members = _members(profile, seed)
    found = profile.groupBy("class").agg(F.first("dims").alias("dims"), F.count("*").alias("n")).orderBy("class").collect()
    stay = {r[0]: r[1] for r in rows.where(F.col(cluster).isNull()).groupBy(named).count().collect()}
    ids = [r["class"] for r in found]
    picks, _ = choose_dev([({d: n for d, n in r["dims"]}, r["n"]) for r in found], fraction, stay, _first(members, ids))
    chosen = spark.createDataFrame([(c, int(n)) for c, n in zip(ids, picks) if n], "class bigint, picks bigint")
    dev = cut(members.join(chosen, "class").where("r < picks").select(F.col("cluster").alias(cluster), F.lit("dev").alias("split")))
    return rows.join(dev, cluster, "left").fillna("train", ["split"])


def leakage(split: DataFrame, cluster: str = "story_cluster_id") -> DataFrame:
    """Clusters that stand in more than one split: must be empty."""
    return split.where(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count_distinct("split").alias("splits")).where("splits > 1")
