"""Borůvka-style minimum-edge contraction: a spanning forest of a graph given as an edge table.

Each round every component picks its smallest edge (by weight, then by its ends), the picked edges are
kept as forest edges, components joined by them are contracted by pointer jumping, and edges inside
a component are dropped.  The number of components with edges at least halves per round, so there are at
most log2(vertices) rounds; each is cut by a reliable checkpoint.  Picks are partial aggregates,
so a hub with a third of all edges is combined before it is shuffled; the joins that relabel the edges have one row per component
on the other side, so adaptive execution splits a hub's partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import cut


def _jump(parent: DataFrame) -> DataFrame:
    """Pointer jumping ``(c, p)`` until every ``p`` is a root."""
    while True:
        up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        nxt = cut(parent.join(up, "p", "left").select("c", F.coalesce("pp", "p").alias("n"), "p"))
        if nxt.where("n <> p").isEmpty():
            return nxt.select("c", F.col("n").alias("p"))
        parent = nxt.select("c", F.col("n").alias("p"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(u, v, w)`` to components ``(vertex, root)`` and forest edges ``(u, v, w, round)``.

    Vertices are of any type with an order.  ``root`` is the smallest vertex of the component.  Null ends, loops and repeated edges are ignored; ties
    of ``w`` are broken by the ends, a null ``w`` counts as the largest.  Vertices without an edge are not listed.  An
    empty table gives two empty ones.
    """
    base = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(
        F.least("u", "v").alias("a"),
        F.greatest("u", "v").alias("b"),
        F.coalesce(F.col("w").cast("double"), F.lit(float("inf"))).alias("w"),
    )
    live = cut(base.groupBy("a", "b").agg(F.min("w").alias("w")).select("*", F.col("a").alias("ca"), F.col("b").alias("cb")))
    vertices = cut(live.select(F.col("a").alias("vertex")).union(live.select("b")).distinct())
    component = vertices.select("vertex", F.col("vertex").alias("root"))
    forest: list[DataFrame] = []
    while not live.isEmpty():
        ends = live.select(F.col("ca").alias("c"), F.col("cb").alias("to"), "w", "a", "b").union(
            live.select("cb", "ca", "w", "a", "b")
        )
        pick = cut(ends.groupBy("c").agg(F.min(F.struct("w", "a", "b", "to")).alias("m")).select("c", "m.*"))
        forest.append(pick.select("a", "b", "w").distinct().withColumn("round", F.lit(len(forest) + 1)))
        # the only cycles of picks are pairs that pick the same edge; the smaller becomes the root
        back = pick.select(F.col("c").alias("to"), F.col("to").alias("back"))
        parent = pick.join(back, "to").select(
            "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p")
        )
        parent = _jump(cut(parent))
        low = parent.groupBy("p").agg(F.min("c").alias("low"))  # names stay the smallest vertex
        names = cut(parent.join(low, "p").select("c", "low"))
        component = cut(
            component.join(names.withColumnRenamed("c", "root"), "root", "left").select(
                "vertex", F.coalesce("low", "root").alias("root")
            )
        )
        live = cut(
            live.join(names.select(F.col("c").alias("ca"), F.col("low").alias("na")), "ca", "left")
            .join(names.select(F.col("c").alias("cb"), F.col("low").alias("nb")), "cb", "left")
            .select("a", "b", "w", F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb"))
            .where("ca <> cb")
        )
    if not forest:
        empty = live.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").withColumn("round", F.lit(0))
        return component, empty
    kept = reduce(DataFrame.union, forest)
    return component, kept.select(F.col("a").alias("u"), F.col("b").alias("v"), "w", "round")
