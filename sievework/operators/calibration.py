"""The calibration mix: a replay bucket over all dimensions, few-letter and uncertain items water-filled over dimensions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import hash_id
from sievework.operators import provenance, sampling
from sievework.operators.sampling import largest_remainder, replay_quota, take_quota, waterfill_quota
from sievework.session import cut, ranked, written

#: The buckets in their order.
REPLAY, FEW_LETTERS, UNCERTAIN = "balanced_replay", "q2_low_cardinality", "q3_uncertain"
BUCKETS = (REPLAY, FEW_LETTERS, UNCERTAIN)


@dataclass(frozen=True)
class CalibrationConfig:
    """Sizes, shares and caps; shares are those of ``BUCKETS``, caps those of single-letter, several-letter and uncertain items."""

    total_rows: int = 2982
    replay_fraction: float = 0.70
    q2_fraction: float = 0.15
    q3_fraction: float = 0.15
    q2_single_share: float = 0.70
    single_cap: int = 4
    several_cap: int = 2
    uncertain_cap: int = 2
    required_dimensions: int = 71
    seed: int = 42

    def __post_init__(self) -> None:
        shares = (self.replay_fraction, self.q2_fraction, self.q3_fraction)
        broken = [
            text
            for ok, text in (
                (self.total_rows > 0, "total_rows must be positive"),
                (min(shares) > 0, "every fraction must be positive"),
                (abs(sum(shares) - 1) <= 1e-9, "the fractions must add up to 1"),
                (0 < self.q2_single_share <= 1, "q2_single_share must lie in (0, 1]"),
                (self.required_dimensions > 0, "required_dimensions must be positive"),
            )
            if not ok
        ]
        if broken:
            raise ValueError("; ".join(broken))


def budgets(spark, config: CalibrationConfig) -> dict[str, int]:
    shares = zip(BUCKETS, (config.replay_fraction, config.q2_fraction, config.q3_fraction))
    table = largest_remainder(spark.createDataFrame(list(shares), "key string, share double"), config.total_rows)
    return {r["key"]: r["budget"] for r in table.collect()}


def quotas(train: DataFrame, config: CalibrationConfig = CalibrationConfig()) -> tuple[list[tuple], DataFrame]:
    """The parts ``(bucket, part, rows, quotas, cap, label)`` of the mix, and the quotas ``(part, key, quota)`` in one table.

    ``train`` has ``sample_id, dimension, question_type, gold_letters, meaning``.  Single-letter and several-letter items share one
    count per dimension, which with the replay's quotas is the uncertain items' baseline.  The several-letter part takes the
    smallest number of letters above one.
    """
    budget, seed = budgets(train.sparkSession, config), config.seed
    dims = train.select(F.col("dimension").alias("key")).distinct()
    n_dims = dims.count()
    if n_dims > budget[REPLAY]:
        raise ValueError(f"{budget[REPLAY]} replay rows can't cover {n_dims} dimensions")
    replay = cut(replay_quota(dims, budget[REPLAY], seed))
    q2 = train.where("question_type = 'Q2'")
    single = q2.where(F.size("gold_letters") == 1)
    least = q2.where(F.size("gold_letters") > 1).agg(F.min(F.size("gold_letters"))).first()[0] or 2
    several = q2.where(F.size("gold_letters") == least)
    unsure = train.where("question_type = 'Q3' AND meaning = 'uncertain'")
    n_single = int(round(budget[FEW_LETTERS] * config.q2_single_share))
    none = dims.withColumn("quota", F.lit(0))

    def fill(rows: DataFrame, cap: int, count: int, label: str, shared: DataFrame, baseline: DataFrame) -> DataFrame:
        c = rows.groupBy(F.col("dimension").alias("key")).agg((F.count("*") * cap).alias("capacity"))
        c = c.join(shared.withColumnRenamed("quota", "shared"), "key", "left").join(baseline.withColumnRenamed("quota", "baseline"), "key", "left")
        return waterfill_quota(c.fillna(0, ["shared", "baseline"]), count, seed, label)

    q_single = fill(single, config.single_cap, n_single, "q2-single", none, replay)
    q_several = fill(several, config.several_cap, budget[FEW_LETTERS] - n_single, "q2-several", q_single, replay)
    both = replay.union(q_single).union(q_several).groupBy("key").agg(F.sum("quota").alias("quota"))
    q_unsure = fill(unsure, config.uncertain_cap, budget[UNCERTAIN], "q3-uncertain", none, both)
    parts = [
        (REPLAY, "replay", train, replay, 1 << 20), (FEW_LETTERS, "q2_single", single, q_single, config.single_cap),
        (FEW_LETTERS, "q2_several", several, q_several, config.several_cap), (UNCERTAIN, "q3_uncertain", unsure, q_unsure, config.uncertain_cap),
    ]
    table = reduce(DataFrame.union, (q.select(F.lit(part).alias("part"), "key", F.col("quota").cast("bigint").alias("quota")) for _, part, _, q, _ in parts))
    return parts, table


def calibration_mix(train: DataFrame, config: CalibrationConfig = CalibrationConfig()) -> DataFrame:
    """The instances of the mix with their provenance.

    ``ordinal`` numbers all instances in the order of buckets, parts, dimensions, repetitions and hashes; ``occurrence`` counts the
    uses of a sample in its part, ``occurrence_in_bucket`` and ``occurrence_in_output`` those before it in the bucket and in
    the whole mix; ``instance_id`` is a hash of seed, bucket, sample, occurrence in the bucket and ordinal, ``shuffle_key`` orders the output.
    """
    train = written(train, "calibration")  # read by every part
    out = []
    for i, (bucket, part, rows, quota, cap) in enumerate(quotas(train, config)[0]):
        taken = take_quota(rows, quota, "dimension", "sample_id", cap, config.seed, part)
        out.append(
            taken.select(
                F.lit(i).alias("no"), F.lit(bucket).alias("bucket"), F.lit(part).alias("part"), "sample_id", "dimension", "question_type",
                F.size("gold_letters").alias("letters"), "meaning", "occurrence", sampling.hash_order(config.seed, F.lit(part), F.col("sample_id")).alias("o"),
            )
        )
    order = [F.col(c) for c in ("no", "dimension", "occurrence", "o", "sample_id")]
    rows = ranked(reduce(DataFrame.unionByName, out), order, "ordinal")

    def before(*by: str) -> Column:  # the uses of one sample
        return F.row_number().over(Window.partitionBy(*by).orderBy("ordinal")) - 1

    rows = rows.withColumns({"occurrence_in_bucket": before("bucket", "sample_id"), "occurrence_in_output": before("sample_id")})
    named = [F.lit("stage3"), F.lit(str(config.seed)), F.col("bucket"), F.col("sample_id"), F.col("occurrence_in_bucket").cast("string"), F.col("ordinal").cast("string")]
    return rows.drop("no", "o").withColumns(
        {"instance_id": hash_id("s3_", *named, digits=20), "shuffle_key": F.sha2(F.concat_ws(":", F.lit(str(config.seed + 3003)), "ordinal"), 256)}
    )


def bucket_audit(mix: DataFrame) -> DataFrame:
    """Per bucket: rows, samples, dimensions, most uses of a sample."""
    return provenance.selection_audit(mix)


def distribution(mix: DataFrame) -> DataFrame:
    """``(bucket, kind, value, rows)``: rows per question type, per dimension and per number of uses of a sample (of samples)."""
    uses = mix.groupBy("bucket", "sample_id").agg(F.count("*").alias("n"))
    kind = lambda c: mix.groupBy("bucket", F.lit(c).alias("kind"), F.coalesce(F.col(c), F.lit("unknown")).alias("value")).agg(F.count("*").alias("rows"))
    return kind("question_type").union(kind("dimension")).union(
        uses.groupBy("bucket", F.lit("uses").alias("kind"), F.col("n").cast("string").alias("value")).agg(F.count("*").alias("rows"))
    )


def checks(mix: DataFrame, train: DataFrame, meanings: DataFrame | None = None, config: CalibrationConfig = CalibrationConfig()) -> dict[str, bool]:
    """The invariants of the mix; all must be true."""
    budget = budgets(mix.sparkSession, config)
    per = {r["bucket"]: r for r in bucket_audit(mix).collect()}  # one row per bucket
    replay = mix.where(F.col("bucket") == REPLAY).groupBy("dimension").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    whole = mix.agg(F.count("*"), F.count_distinct("instance_id"), F.count_distinct("dimension"), F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first()
    uncertain = mix.where(F.col("bucket") == UNCERTAIN).where("NOT coalesce(meaning = 'uncertain', false)")
    unmapped = meanings.where("error IS NOT NULL").isEmpty() if meanings is not None else True
    most = lambda b: per[b]["most_uses"] if b in per else 0
    return {
        "total_rows_exact": whole[0] == config.total_rows,
        "source_budgets_exact": {b: r["rows"] for b, r in per.items()} == budget,
        "required_dimensions_covered": whole[2] == config.required_dimensions,
        "replay_covers_required_dimensions": replay[2] == config.required_dimensions,
        "replay_quota_spread_at_most_one": replay[0] is not None and replay[1] - replay[0] <= 1,
        "unique_instance_ids": whole[1] == whole[0],
        "ordinals_without_gaps": whole[3] == whole[0] and (not whole[0] or (whole[4], whole[5]) == (0, whole[0] - 1)),
        "yes_no_meanings_complete": unmapped,
        "q3_uncertain_only": uncertain.isEmpty(),
        "q2_repeat_cap_respected": most(FEW_LETTERS) <= max(config.single_cap, config.several_cap),
        "q3_repeat_cap_respected": most(UNCERTAIN) <= config.uncertain_cap,
        "sources_are_training_only": mix.join(train.select("sample_id"), "sample_id", "left_anti").isEmpty(),
    }
