"""Scoring a prediction log: canonical grid, metrics by policy and group, stability over seeds.

Correctness compares letter arrays in order; a null prediction is unparsed: counted, never correct.
Rates over no rows are null.  All groups come from one pass with grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("run_id", "seed", "sample_id")
#: Names of the primary dimensions by the first part of a dimension.
PRIMARY = {"1": "mentalization", "2": "strategic_social_interaction", "3": "sociocultural_norms"}
UNKNOWN = "unknown"


def primary_dimension(dimension: Column) -> Column:
    head = F.split_part(dimension, F.lit("."), F.lit(1))
    named = F.lit(UNKNOWN)
    for digit, name in PRIMARY.items():
        named = F.when(head == digit, name).otherwise(named)
    return named


def last_success(log: DataFrame, key: tuple[str, ...] = KEY, order: str = "prediction_id") -> DataFrame:
    """The last row without an error of each key; one partial aggregate, no sort."""
    rest = [c for c in log.columns if c not in key]
    best = log.where("error IS NULL").groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*key, "r.*")


def attempt_audit(log: DataFrame, key: tuple[str, ...] = KEY, by: str = "run_id") -> DataFrame:
    """Attempts, successes, failures, keys, keys with several successes and keys with none, per ``by``."""
    per_key = log.groupBy(*key).agg(F.count("*").alias("rows"), F.count_if(F.col("error").isNull()).alias("ok"))
    return per_key.groupBy(by).agg(
        F.sum("rows").alias("attempts"),
        F.sum("ok").alias("successes"),
        F.sum(F.col("rows") - F.col("ok")).alias("failures"),
        F.count("*").alias("keys"),
        F.count_if(F.col("ok") > 1).alias("duplicate_success_keys"),
        F.count_if(F.col("ok") == 0).alias("unfinished_keys"),
    )


def expected_grid(samples: DataFrame, seeds: DataFrame) -> DataFrame:
    """Every sample under every seed; the seeds are a handful of rows."""
    return samples.select("sample_id").distinct().crossJoin(F.broadcast(seeds.select("seed").distinct()))


def grid_gaps(grid: DataFrame, rows: DataFrame, key: tuple[str, ...] = ("seed", "sample_id")) -> DataFrame:
    """Keys on one side only: ``(key..., side)`` with ``missing`` or ``unexpected``."""
    a, b = grid.select(*key).distinct(), rows.select(*key).distinct()
    return a.join(b, list(key), "left_anti").withColumn("side", F.lit("missing")).union(
        b.join(a, list(key), "left_anti").withColumn("side", F.lit("unexpected"))
    )


def scored(rows: DataFrame) -> DataFrame:
    """Adds ``parsed``, correctness under the three label policies, and the plain dimension columns."""
    p = F.col("predicted_letters")
    return rows.select(
        "*",
        p.isNotNull().alias("parsed"),
        F.coalesce(p == F.col("gold_letters"), F.lit(False)).alias("correct"),
        F.coalesce(p == F.col("mapped_letters"), F.lit(False)).alias("correct_mapped"),
        F.coalesce("safe_gold", F.lit(False)).alias("safe"),
        F.col("mapped_letters").isNotNull().alias("mapped"),
        F.coalesce(F.nullif(F.trim(F.col("dimension")), F.lit("")), F.lit(UNKNOWN)).alias("fine"),
    ).withColumn("main", primary_dimension(F.col("fine")))


def _rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 9)


def metric_columns(total: Column, parsed: Column, correct: Column, prefix: str = "") -> list[Column]:
    return [
        total.alias(f"{prefix}total"),
        parsed.alias(f"{prefix}parsed"),
        correct.alias(f"{prefix}correct"),
        _rate(correct, total).alias(f"{prefix}accuracy"),
        _rate(parsed, total).alias(f"{prefix}parse_rate"),
    ]


def diagnostics() -> list[Column]:
    """Total, parsed, correct and rates under the reported, safe and mapped policies."""
    out: list[Column] = []
    for prefix, of, right in (("", None, "correct"), ("safe_", "safe", "correct"), ("mapped_", "mapped", "correct_mapped")):
        inside = F.lit(True) if of is None else F.col(of)
        out += metric_columns(
            F.count_if(inside), F.count_if(inside & F.col("parsed")), F.count_if(inside & F.col(right)), prefix
        )
    return out


def grouped_metrics(rows: DataFrame, by: tuple[str, ...] = ("run_id", "seed")) -> DataFrame:
    """Diagnostics overall, by question type, primary and fine dimension in one pass of grouping sets.

    ``group_kind`` and ``group_value`` tell the group; unknown dimensions count overall and by question type only.
    """
    # each row stands in at most four groups, so they are exploded beside each other rather than scanned again
    kinds = F.array(
        F.struct(F.lit("overall").alias("group_kind"), F.lit("all").alias("group_value")),
        F.struct(F.lit("qtype").alias("group_kind"), F.coalesce("qtype", F.lit(UNKNOWN)).alias("group_value")),
        F.struct(F.lit("primary").alias("group_kind"), F.col("main").alias("group_value")),
        F.struct(F.lit("dimension").alias("group_kind"), F.col("fine").alias("group_value")),
    )
    s = scored(rows)
    known = F.filter(kinds, lambda k: ~k["group_kind"].isin("primary", "dimension") | (F.col("fine") != UNKNOWN))
    flat = s.select(*by, "parsed", "correct", "correct_mapped", "safe", "mapped", F.explode(known).alias("g"))
    return flat.groupBy(*by, F.col("g.group_kind").alias("group_kind"), F.col("g.group_value").alias("group_value")).agg(*diagnostics())


def over_seeds(metrics: DataFrame, value: str = "accuracy", by: tuple[str, ...] = ("run_id", "group_kind", "group_value")) -> DataFrame:
    """Mean, population deviation, minimum and maximum of a rate over seeds; nulls don't count."""
    return metrics.groupBy(*by).agg(
        F.count("*").alias("seeds"),
        F.round(F.avg(value), 9).alias("mean"),
        F.round(F.stddev_pop(value), 9).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def policies_over_seeds(metrics: DataFrame, by: tuple[str, ...] = ("run_id", "group_kind", "group_value")) -> DataFrame:
    """``over_seeds`` of the accuracies and parse rates under the reported, safe and mapped policies."""
    rates = F.array(*(
        F.struct(F.lit(policy).alias("policy"), F.lit(rate).alias("rate"), F.col(prefix + rate).alias("value"))
        for policy, prefix in (("reported", ""), ("safe", "safe_"), ("mapped", "mapped_")) for rate in ("accuracy", "parse_rate")
    ))
    flat = metrics.select(*by, "seed", F.explode(rates).alias("x")).select(*by, "seed", "x.*")
    return over_seeds(flat, "value", (*by, "policy", "rate"))


def dimension_coverage(rows: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Rows with known and unknown dimensions, coverage, distinct fine dimensions and primaries."""
    s = scored(rows)
    known = F.col("fine") != UNKNOWN
    return s.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(known).alias("known"),
        F.count_if(~known).alias("unknown"),
        _rate(F.count_if(known), F.count("*")).alias("coverage"),
        F.count_distinct(F.when(known, F.col("fine"))).alias("fine_dimensions"),
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("fine")))), ",").alias("fine_names"),
        F.array_join(F.array_sort(F.collect_set(F.when(known, F.col("main")))), ",").alias("primaries"),
    )


def text_of(letters: Column) -> Column:
    """A prediction as text; null stays apart from the empty array."""
    return F.when(letters.isNull(), "<unparsed>").otherwise(F.concat(F.lit("["), F.array_join(letters, ","), F.lit("]")))


def sample_stability(rows: DataFrame, seeds: int, by: tuple[str, ...] = ("run_id", "sample_id")) -> DataFrame:
    """One row per sample: distinct predictions, consistency, majority vote and its correctness.

    A null prediction is a vote.  The majority needs all seeds and a single top count; it is null if the winning vote
    is null.  Votes are counted per sample by a partial aggregate; no window over rows.
    """
    votes = rows.groupBy(*by, text_of(F.col("predicted_letters")).alias("vote")).agg(
        F.count("*").alias("n"),
        F.first("predicted_letters").alias("letters"),
        F.min(F.struct("seed", "gold_letters", "mapped_letters", "safe_gold", "qtype", "dimension")).alias("meta"),
    )
    per = votes.groupBy(*by).agg(
        F.sum("n").alias("present"),
        F.count("*").alias("unique_predictions"),
        F.max("n").alias("top"),
        F.max_by("letters", F.struct("n", "vote")).alias("winner"),
        F.min("meta").alias("m"),
        F.array_sort(F.collect_list("n")).alias("counts"),  # at most one entry per seed
    )
    complete = F.col("present") == seeds
    tie = (F.size("counts") > 1) & (F.element_at("counts", -1) == F.try_element_at("counts", F.lit(-2)))
    decided = complete & ~F.coalesce(tie, F.lit(False))
    w = F.when(decided, F.col("winner"))
    return per.select(
        *by,
        F.col("m.qtype").alias("qtype"),
        F.coalesce(F.nullif(F.trim(F.col("m.dimension")), F.lit("")), F.lit(UNKNOWN)).alias("dimension"),
        F.col("present").alias("seeds_present"),
        complete.alias("complete"),
        "unique_predictions",
        (complete & (F.col("unique_predictions") == 1)).alias("consistent"),
        F.coalesce(tie, F.lit(False)).alias("tie"),
        w.alias("majority"),
        F.coalesce(w == F.col("m.gold_letters"), F.lit(False)).alias("majority_correct"),
        F.when(F.coalesce("m.safe_gold", F.lit(False)), F.coalesce(w == F.col("m.gold_letters"), F.lit(False))).alias("majority_correct_safe"),
        F.when(F.col("m.mapped_letters").isNotNull(), F.coalesce(w == F.col("m.mapped_letters"), F.lit(False))).alias("majority_correct_mapped"),
    )


def stability_audit(stability: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return stability.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.count_if("complete").alias("complete"),
        F.count_if("consistent").alias("consistent"),
        F.count_if("tie").alias("ties"),
        _rate(F.count_if("consistent"), F.count_if("complete")).alias("consistency_rate"),
        _rate(F.count_if(F.col("complete") & F.col("majority_correct")), F.count_if("complete")).alias("majority_accuracy"),
    )


def artifact_audit(rows: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Per finish reason (``<missing>`` and ``<empty>`` apart): rows, rows without letters, rows cut by length."""
    reason = F.when(F.col("finish_reason").isNull(), "<missing>").otherwise(
        F.coalesce(F.nullif(F.trim(F.col("finish_reason")), F.lit("")), F.lit("<empty>"))
    )
    return rows.groupBy(*by, reason.alias("reason")).agg(
        F.count("*").alias("rows"),
        F.count_if(F.coalesce(F.size("predicted_letters"), F.lit(0)) <= 0).alias("without_letters"),
        F.count_if(F.lower(reason) == "length").alias("cut_by_length"),
    )


def weighted_score(metrics: DataFrame, weights: dict[str, int], by: tuple[str, ...] = ("run_id", "seed")) -> DataFrame:
    """Fixed-weight sum of the primary accuracies; null unless every group is there, never renormalised."""
    total = sum(weights.values())
    weight = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    rows = metrics.where("group_kind = 'primary'").withColumn("w", F.try_element_at(weight, F.col("group_value")))
    rows = rows.where("w IS NOT NULL AND accuracy IS NOT NULL")
    return rows.groupBy(*by).agg(
        F.count("*").alias("groups"),
        F.round(F.sum("w") / F.lit(total), 9).alias("covered_weight"),
        F.when(F.count("*") == len(weights), F.round(F.sum(F.col("accuracy") * F.col("w")) / F.lit(total), 9)).alias("score"),
    )


def canonical_rows(log: DataFrame, grid: DataFrame) -> DataFrame:
    """Successful rows in grid order: seed, then sample."""
    return last_success(log).join(grid, ["seed", "sample_id"], "left_semi").orderBy("run_id", "seed", "sample_id")


def row_errors(rows: DataFrame, seeds: list[int]) -> DataFrame:
    """Rows that break the canonical form, with the reason."""
    w = Window.partitionBy("run_id", "seed", "sample_id")
    bad = F.exists("predicted_letters", lambda x: x.isNull() | (F.trim(x) == ""))
    reason = (
        F.when(F.col("seed").isNull() | ~F.col("seed").isin(*seeds), "unexpected_seed")
        .when(F.col("sample_id").isNull() | (F.trim("sample_id") == ""), "missing_sample_id")
        .when(F.coalesce(bad, F.lit(False)), "bad_prediction")
        .when(F.col("gold_letters").isNull() | (F.size("gold_letters") == 0), "missing_gold")
        .when(F.count("*").over(w) > 1, "duplicate_key")
    )
    return rows.select("prediction_id", "run_id", "seed", "sample_id", reason.alias("reason")).where("reason IS NOT NULL")


def filled_groups(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """Every seed of a run with every group ``(group_kind, group_value)``: absent cells have totals of 0 and null rates."""
    grid = metrics.select("run_id", "seed").distinct().crossJoin(F.broadcast(groups.select("group_kind", "group_value").distinct()))
    key = ["run_id", "seed", "group_kind", "group_value"]
    counts = [c for c in metrics.columns if c not in key and not c.endswith(("accuracy", "parse_rate"))]
    return grid.join(metrics, key, "left").fillna(0, counts)
