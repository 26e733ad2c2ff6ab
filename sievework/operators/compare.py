"""Paired comparison of two runs over the same grid of seeds and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.evalgrid import UNKNOWN, primary_dimension

PAIR = ("seed", "sample_id")
META = ("qtype", "dimension", "gold_letters", "mapped_letters", "safe_gold", "gold_audit_reason")


def paired(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row per common key, both sides' predictions and endings, and whether the samples' facts agree."""
    cut = F.lower(F.trim(F.coalesce("finish_reason", F.lit("")))) == "length"
    side = lambda df, x: df.select(
        *PAIR,
        F.col("predicted_letters").alias(f"{x}_letters"),
        F.coalesce(F.col("predicted_letters") == F.col("gold_letters"), F.lit(False)).alias(f"{x}_correct"),
        F.col("predicted_letters").isNotNull().alias(f"{x}_parsed"),
        cut.alias(f"{x}_cut"),
        F.struct(*META).alias(f"{x}_meta"),
    )
    both = side(baseline, "b").join(side(candidate, "c"), list(PAIR))
    dim = F.coalesce(F.nullif(F.trim(F.col("b_meta.dimension")), F.lit("")), F.lit(UNKNOWN))
    return both.select(
        "*",
        (~F.col("b_letters").eqNullSafe(F.col("c_letters"))).alias("changed"),
        (~F.col("b_meta").eqNullSafe(F.col("c_meta"))).alias("meta_differs"),
        F.coalesce("b_meta.qtype", F.lit(UNKNOWN)).alias("qtype"),
        primary_dimension(dim).alias("main"),
    )


def _paired_metrics() -> list[Column]:
    b, c = F.col("b_correct"), F.col("c_correct")
    wins, losses = F.count_if(~b & c), F.count_if(b & ~c)
    rate = lambda x, y: F.round(F.try_divide(x.cast("double"), y.cast("double")), 9)
    n = F.count("*")
    return [
        n.alias("total"),
        wins.alias("wins"),
        losses.alias("losses"),
        F.count_if(b & c).alias("both_correct"),
        F.count_if(~b & ~c).alias("both_wrong"),
        (wins - losses).alias("net"),
        (wins + losses).alias("discordant"),
        rate(wins, wins + losses).alias("win_rate"),
        rate(F.count_if(b), n).alias("baseline_accuracy"),
        rate(F.count_if(c), n).alias("candidate_accuracy"),
        F.count_if(~F.col("b_parsed") & F.col("c_parsed")).alias("newly_parsed"),
        F.count_if(F.col("b_parsed") & ~F.col("c_parsed")).alias("newly_unparsed"),
        F.count_if(~F.col("b_cut") & F.col("c_cut")).alias("newly_cut"),
        F.count_if(F.col("b_cut") & ~F.col("c_cut")).alias("no_longer_cut"),
        F.count_if("changed").alias("changed"),
    ]


def comparison(pairs: DataFrame) -> DataFrame:
    """Metrics per seed and pooled (``seed`` null), overall and by question type and primary dimension.

    Pairs are expanded to the three groups and their seed is rolled up, so everything is one aggregate.
    """
    groups = F.array(
        F.struct(F.lit("overall").alias("k"), F.lit("all").alias("v")),
        F.struct(F.lit("qtype").alias("k"), F.col("qtype").alias("v")),
        F.struct(F.lit("primary").alias("k"), F.col("main").alias("v")),
    )
    flat = pairs.withColumn("g", F.explode(groups)).select("*", F.col("g.k").alias("group_kind"), F.col("g.v").alias("group_value"))
    return flat.groupingSets(
        [[F.col("group_kind"), F.col("group_value"), F.col("seed")], [F.col("group_kind"), F.col("group_value")]],
        "group_kind", "group_value", "seed",
    ).agg(*_paired_metrics())


def seed_summary(compared: DataFrame) -> DataFrame:
    """Mean and population deviation over seeds of the delta, and of win and loss shares."""
    per = compared.where("seed IS NOT NULL")
    delta = F.col("candidate_accuracy") - F.col("baseline_accuracy")
    return per.groupBy("group_kind", "group_value").agg(
        F.count("*").alias("seeds"),
        F.round(F.avg(delta), 8).alias("delta_mean"),
        F.round(F.stddev_pop(delta), 8).alias("delta_std"),
        F.round(F.avg(F.col("wins") / F.col("total")), 8).alias("win_share"),
        F.round(F.avg(F.col("losses") / F.col("total")), 8).alias("loss_share"),
    )


def weighted_comparison(compared: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Per seed: fixed-weight scores of both runs from the primary groups and their difference.

    Scores are null unless every weighted group is there; weights are never renormalised.
    """
    table = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    rows = compared.where("seed IS NOT NULL AND group_kind = 'primary' AND total > 0").withColumn("w", F.try_element_at(table, F.col("group_value")) / F.lit(sum(weights.values())))
    per = rows.where("w IS NOT NULL").groupBy("seed").agg(
        F.count("*").alias("groups"), F.sum(F.col("baseline_accuracy") * F.col("w")).alias("b"), F.sum(F.col("candidate_accuracy") * F.col("w")).alias("c")
    )
    full = F.col("groups") == len(weights)
    return per.select(
        "seed", "groups", full.alias("complete"), F.when(full, F.round("b", 8)).alias("baseline_score"), F.when(full, F.round("c", 8)).alias("candidate_score"),
        F.when(full, F.round(F.col("c") - F.col("b"), 8)).alias("delta"),
    )


def protocol_gaps(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Differences of two runs' protocols: seeds, samples and per-key facts, all reported together."""
    def facts(df: DataFrame) -> DataFrame:
        seeds = df.select(F.lit("seed").alias("fact"), F.col("seed").cast("string").alias("value"))
        return seeds.union(df.select(F.lit("sample_id"), "sample_id")).distinct()

    a, b = facts(baseline), facts(candidate)
    return a.exceptAll(b).withColumn("only_in", F.lit("baseline")).union(b.exceptAll(a).withColumn("only_in", F.lit("candidate")))
