"""The calibration job: the mix, its audit and its invariants."""

from __future__ import annotations

from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import calibration, provenance, sampling
from sievework.operators.calibration import CalibrationConfig
from sievework.session import cut, drop_written
from sievework.sources import jsonl


def calibrate(train: DataFrame, config: CalibrationConfig = CalibrationConfig(), meanings: DataFrame | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """The mix in its shuffled order and its audit; raises if an invariant does not hold."""
    mix = cut(calibration.calibration_mix(train, config))
    holds = calibration.checks(mix, train, meanings, config)
    provenance.invariants(holds)
    parts = calibration.quotas(train, config)[1]
    summary = {
        part: sampling.quota_summary(parts.where(F.col("part") == part)).first().asDict() for part in ("replay", "q2_single", "q2_several", "q3_uncertain")
    }
    audit = {
        "config": asdict(config),
        "budgets": calibration.budgets(train.sparkSession, config),
        "quotas": summary,
        "buckets": {r["bucket"]: r.asDict() for r in calibration.bucket_audit(mix).collect()},
        "most_repeated": [r.asDict() for r in provenance.most_repeated(mix, "sample_id").collect()],
        "invariants": holds,
    }
    return mix.orderBy("shuffle_key"), audit


def run(spark: SparkSession, train_path: str, out: str, config: CalibrationConfig = CalibrationConfig(), force: bool = False) -> dict[str, Any]:
    """Reads ``sample_id, dimension, question_type, gold_letters, meaning`` rows as Parquet, writes ``mix`` and ``audit.json``."""
    jsonl.guard_outputs([f"{out}/mix", f"{out}/audit.json"], force, spark)
    mix, audit = calibrate(spark.read.parquet(train_path), config)
    jsonl.write_jsonl(mix, f"{out}/mix", force)
    jsonl.write_report(f"{out}/audit.json", audit)
    drop_written(spark)
    return audit
