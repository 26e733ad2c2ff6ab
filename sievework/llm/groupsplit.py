"""Problem 3: splits that keep related records together.

Rows that share a sample, story cluster, author or source reference are related.  Every value of
such a field is a star of edges from its rows to its first row (a pre-aggregated minimum, so the one author
with a third of all rows gives one edge per row and no group is gathered).  A Borůvka-style
contraction of these edges (``forest.spanning_forest``) gives the groups.

Groups are then dealt to the splits by one rule, from the largest size band (powers of two) to the single rows.  The groups of
a band and a main dimension are a stratum; in the order of a hash they take evenly spaced positions (systematic dealing from a
hashed start) in the proportions that the splits still lack in that dimension after all larger bands.  Splits that
lack fewer rows than a group of the band has, or fewer rows of the dimension than the stratum's groups have on average, are
passed over; where none is left for a dimension, the lacks over all dimensions decide, and where no split has room, the one that lacks most.  So a group of a third of all rows is dealt by the
same rule as a single row, and what large groups leave uneven is evened out by the smaller ones of the same dimension.

Defined results: case and surrounding blanks don't matter; nulls, blanks, fill-in words and all-zero
ids relate nothing.  A row without relations is a group of its own.  Repeated rows keep their own ids.  A null
``split_row_id`` is left out.  Targets need not add up to 1,000: they are shares of their sum; without
targets nothing is assigned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.values import category, reference
from sievework.operators.forest import spanning_forest
from sievework.session import cut, ranked, written

RELATIONS = ("sample_id", "story_cluster_id", "source_ref", "author_id")


def relation_edges(rows: DataFrame, relations: tuple[str, ...] = RELATIONS) -> DataFrame:
    """``(u, v, w)``: from each row to the first row with the same value; ``w`` ranks the fields."""
    named = F.array(
        *(F.struct(F.lit(i).alias("w"), reference(F.col(c)).alias("value")) for i, c in enumerate(relations))
    )
    values = rows.where("split_row_id IS NOT NULL").select(F.col("split_row_id").alias("u"), F.explode(named).alias("x"))
    values = values.select("u", "x.w", "x.value").where("value IS NOT NULL")
    firsts = values.groupBy("w", "value").agg(F.min("u").alias("v"), F.max("u").alias("z")).where("v < z").drop("z")
    return values.join(firsts, ["w", "value"]).where("u <> v").select("u", "v", "w")


def related_groups(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(split_row_id, group_row_id)`` of all rows that are related to another, and the forest."""
    component, forest = spanning_forest(relation_edges(rows))
    return component.select(F.col("vertex").alias("split_row_id"), F.col("root").alias("group_row_id")), forest


def found(rows: DataFrame) -> DataFrame:
    """p3_found."""
    return related_groups(rows)[0]


def forest_edges(rows: DataFrame) -> DataFrame:
    """The spanning forest: ``(u, v, relation, round)``."""
    forest = related_groups(rows)[1]
    names = F.array(*(F.lit(r) for r in RELATIONS))
    return forest.select("u", "v", F.get(names, F.col("w").cast("int")).alias("relation"), "round")


def split(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``(split_row_id, group_row_id, dimension, split_name)``: every row and its split."""
    groups = found(rows)
    keyed = rows.where("split_row_id IS NOT NULL").select("split_row_id", F.coalesce(category(F.col("dimension")), F.lit("missing")).alias("dimension"))
    keyed = cut(keyed.join(groups, "split_row_id", "left").withColumn("group_row_id", F.coalesce("group_row_id", "split_row_id")))
    wanted = [(r[0], r[1]) for r in targets.where("target_permille > 0").orderBy(F.desc("target_permille"), "split_name").collect()]
    if not wanted:
        return keyed.withColumn("split_name", F.lit(None).cast("string"))
    profile = keyed.groupBy("group_row_id", "dimension").agg(F.count("*").alias("n"))
    sized = profile.groupBy("group_row_id").agg(F.sum("n").alias("rows"), F.max(F.struct("n", "dimension")).alias("m"))
    sized = sized.select("group_row_id", "m.dimension", F.col("m.n").alias("main"), F.floor(F.log2("rows") + 1e-9).cast("int").alias("band"), F.xxhash64("group_row_id").alias("h"))
    order = [F.desc("band"), F.col("dimension"), F.col("h"), F.col("group_row_id")]
    roots = written(ranked(sized, order).drop("h"), "roots")  # sorted by band, so that a band reads its own row groups only
    strata = cut(roots.groupBy("band", "dimension").agg(F.min("rank").alias("first"), F.count("*").alias("size"), F.avg("main").alias("main")))
    profile = written(profile.join(roots.select("group_row_id", "band"), "group_row_id"), "profile")
    whole = sum(p for _, p in wanted)
    names, lacks = [s for s, _ in wanted], [f"lack_{i}" for i in range(len(wanted))]
    open_rows = cut(profile.groupBy("dimension").agg(*(F.sum("n").cast("double") * (p / whole) for _, p in wanted)).toDF("dimension", *lacks))
    dealt = []
    for band in sorted((r[0] for r in strata.select("band").distinct().collect()), reverse=True):  # at most one per power of two
        total = open_rows.agg(*(F.sum(c) for c in lacks)).first()
        room = [x >= 2**band for x in total]
        here = roots.where(F.col("band") == band).join(strata.where(F.col("band") == band).drop("band").alias("stratum"), "dimension").join(open_rows, "dimension")
        own = [F.when(F.col(c) >= F.col("stratum.main"), F.col(c)).otherwise(0.0) if ok else F.lit(0.0) for c, ok in zip(lacks, room)]
        all_ = [max(0.0, x) if ok else 0.0 for x, ok in zip(total, room)]
        if not sum(all_):
            all_ = [float(x == max(total)) for x in total]
        some = sum(own, F.lit(0.0)) > 0
        shares = [F.when(some, o / sum(own, F.lit(0.0))).otherwise(a / sum(all_)) for o, a in zip(own, all_)]
        edges = [sum(shares[: i + 1], F.lit(0.0)) for i in range(len(shares))]
        start = F.pmod(F.xxhash64("band", "dimension"), F.lit(1 << 20)) / float(1 << 20)
        at = ((F.col("rank") - F.col("first")) / F.col("size") + start) % 1
        last = cut(here.select("group_row_id", _dealt(at, edges, names).alias("split_name")))
        dealt.append(last)
        got = profile.where(F.col("band") == band).join(last, "group_row_id").groupBy("dimension").agg(
            *(F.sum(F.when(F.col("split_name") == s, F.col("n")).otherwise(0)).alias(f"got_{i}") for i, s in enumerate(names))
        )
        left = open_rows.join(got, "dimension", "left").fillna(0)
        open_rows = cut(left.select("dimension", *((F.col(c) - F.col(f"got_{i}")).alias(c) for i, c in enumerate(lacks))))
    if not dealt:
        return keyed.withColumn("split_name", F.lit(None).cast("string"))
    return keyed.join(reduce(DataFrame.union, dealt), "group_row_id").select("split_row_id", "group_row_id", "dimension", "split_name")


def _dealt(at, edges: list, names: list[str]):
    """The split in whose part of [0, 1) a position lies."""
    name = F.lit(names[-1])
    for edge, s in reversed(list(zip(edges[:-1], names[:-1]))):
        name = F.when(at < edge, s).otherwise(name)
    return name


def kept_together(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: rows, groups, rows without a split, and groups that stand in several splits (the last two must be 0)."""
    per = split(rows, targets).groupBy("group_row_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("split_name").isNull()).alias("unassigned"), F.count_distinct("split_name").alias("splits")
    )
    return per.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("*").alias("groups"),
        F.coalesce(F.sum("unassigned"), F.lit(0)).alias("unassigned"), F.count_if(F.col("splits") > 1).alias("divided_groups"),
    )


def split_report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per split: groups, rows, reached and wanted permille, and the largest gap of a dimension's permille.

    ``dimension_gap`` is taken over dimensions of at least 100 rows.
    """
    assigned = cut(split(rows, targets))
    total = assigned.count() or 1
    per_dim = assigned.groupBy("dimension", "split_name").agg(F.count("*").alias("n"))
    dims = assigned.groupBy("dimension").agg(F.count("*").alias("all"))
    shares = per_dim.join(dims.where("all >= 100"), "dimension").select("split_name", (F.col("n") * 1000 / F.col("all")).alias("permille"))
    counts = assigned.groupBy("split_name").agg(F.count_distinct("group_row_id").alias("groups"), F.count("*").alias("rows"))
    gap = shares.join(targets, "split_name").groupBy("split_name").agg(
        F.round(F.max(F.abs(F.col("permille") - F.col("target_permille"))), 3).alias("dimension_gap")
    )
    return (
        targets.join(counts, "split_name", "left")
        .join(gap, "split_name", "left")
        .select(
            "split_name",
            F.coalesce("groups", F.lit(0)).alias("groups"),
            F.coalesce("rows", F.lit(0)).alias("rows"),
            F.round(F.coalesce("rows", F.lit(0)) * 1000 / F.lit(total), 3).alias("permille"),
            "target_permille",
            "dimension_gap",
        )
    )
