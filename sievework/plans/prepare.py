"""Composite jobs: prepare a corpus, and write it with its audit."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import clusters, labels, quality, sampling, split
from sievework.session import drop_written, written
from sievework.sources import jsonl

TRAIN_SCHEMA = (
    "sample_id string, sample_index string, prompt_type string, gold_letters array<string>, pred_letters array<string>, "
    "meta struct<dim: string, qtype: string>, messages array<struct<role: string, content: string>>, "
    "story_cluster_id string, split_name string, source string"
)
PUBLIC_SCHEMA = (
    "sample_id string, story string, question string, question_type string, task_format string, options map<string, string>, "
    "correct_letters array<string>, correct_answers array<string>, dimension string"
)
ARTIFACTS = ("clean", "rejected", "train", "dev", "train_balanced", "public_safe", "public_review")


@dataclass(frozen=True)
class PrepareConfig:
    seed: int = 42
    val_fraction: float = 0.10
    fuzzy_story_threshold: float = 0.92
    shingle_size: int = 5
    sketch_size: int = 12
    max_cot_chars: int = 1800
    cot_style: str = "compressed"
    balance_target: str = "median"
    safe_dev_policy: str = "agreement_only"
    safe_dev_require_complete_story: bool = False
    allow_pred_mismatch: bool = False

    def __post_init__(self) -> None:
        checks = {
            "val_fraction must lie between 0 and 1": 0 < self.val_fraction < 1,
            "fuzzy_story_threshold must lie in (0, 1]": 0 < self.fuzzy_story_threshold <= 1,
            "shingle_size and sketch_size must be 2 or more": min(self.shingle_size, self.sketch_size) >= 2,
            "max_cot_chars must not be negative": self.max_cot_chars >= 0,
            "cot_style is compressed or answer_only": self.cot_style in ("compressed", "answer_only"),
            "safe_dev_policy is agreement_only or mapped_answer_text": self.safe_dev_policy in ("agreement_only", "mapped_answer_text"),
            "balance_target is none, off, disabled, min, max, median or a positive number": self.balance_target
            in ("none", "off", "disabled", "min", "max", "median")
            or (str(self.balance_target).isdigit() and int(self.balance_target) > 0),
        }
        broken = [text for text, ok in checks.items() if not ok]
        if broken:
            raise ValueError("; ".join(broken))


def prepare(train: DataFrame, public: DataFrame, config: PrepareConfig = PrepareConfig()) -> dict[str, DataFrame]:
    """All outputs of the preparation as tables (see ``ARTIFACTS``)."""
    judged = written(quality.judged(train, config.allow_pred_mismatch), "judged")
    source = judged.drop("prompt", "answer", "gold", "pred", "dimension", "question_type", "story", "option_letters", "reasons")
    clean = quality.accepted(source, config.max_cot_chars, config.cot_style).drop("story_cluster_id")
    ids = clusters.story_clusters(clean, "_source_line", F.col("story"), config.fuzzy_story_threshold, config.shingle_size, config.sketch_size)
    clean = written(clean.join(ids, "_source_line"), "clean")
    assigned = written(split.train_dev_split(clean, fraction=config.val_fraction, seed=config.seed), "assigned")
    tr = assigned.where("split = 'train'").drop("split")
    balanced = tr if config.balance_target in ("none", "off", "disabled") else sampling.balanced(
        tr, "dimension", "_source_line", config.balance_target if not str(config.balance_target).isdigit() else int(config.balance_target), config.seed
    )
    audited = written(labels.audit(public), "audited")
    safe = labels.usable(audited, config.safe_dev_policy)
    if config.safe_dev_require_complete_story:
        whole = labels.complete_bundles(audited, policy=config.safe_dev_policy).select("public_line")
        safe = safe.join(whole, "public_line", "left_semi")
    return {
        "clean": clean,
        "rejected": judged.where(F.size("reasons") > 0).select("_source_line", "sample_id", "reasons"),
        "train": tr,
        "dev": assigned.where("split = 'dev'").drop("split"),
        "train_balanced": balanced,
        "public_safe": safe,
        "public_review": audited.join(safe.select("public_line"), "public_line", "left_anti").withColumn("requires_manual_review", F.lit(True)),
    }


def audit(outputs: dict[str, DataFrame], config: PrepareConfig) -> dict:
    """Counts, distributions and invariants; raises if a cluster stands in both splits."""
    counts = {k: v.count() for k, v in outputs.items()}
    both = outputs["train"].select("story_cluster_id").distinct().join(outputs["dev"].select("story_cluster_id").distinct(), "story_cluster_id").count()
    if both:
        raise AssertionError(f"{both} story clusters stand in train and dev")
    reasons = outputs["rejected"].select(F.explode("reasons").alias("r")).groupBy("r").count().collect()
    status = outputs["public_review"].unionByName(outputs["public_safe"], allowMissingColumns=True).groupBy("status").count().collect()
    absent = outputs["train"].select("dimension").distinct().join(outputs["dev"].select("dimension").distinct(), "dimension", "left_anti").collect()
    dims = outputs["train_balanced"].groupBy("dimension").count().agg(F.count("*"), F.min("count"), F.max("count")).first()
    return {
        "config": asdict(config),
        "rows": counts,
        "rejection_reasons": {r[0]: r[1] for r in sorted(reasons)},
        "label_status": {r[0]: r[1] for r in sorted(status)},
        "balanced": {"dimensions": dims[0], "min": dims[1], "max": dims[2]},
        "cluster_overlap": both,
        "dimensions_not_in_dev": sorted(r[0] for r in absent),
    }


def run(spark: SparkSession, train_path: str, public_path: str, out: str, config: PrepareConfig = PrepareConfig(), force: bool = False) -> dict:
    """Reads both JSON lines inputs, writes seven outputs and ``audit.json``; refuses to overwrite unless forced."""
    paths = {name: f"{out}/{name}" for name in ARTIFACTS}
    jsonl.guard_outputs([*paths.values(), f"{out}/audit.json"], force, spark)
    train = jsonl.read_jsonl(spark, train_path, TRAIN_SCHEMA)
    public = jsonl.read_jsonl(spark, public_path, PUBLIC_SCHEMA).withColumnRenamed("_source_line", "public_line")
    outputs = prepare(train, public, config)
    for name, path in paths.items():
        jsonl.write_jsonl(outputs[name], path, force)
    report = audit(outputs, config) | {
        "inputs": {r["path"].rpartition("/")[2]: r["sha256"] for p in (train_path, public_path) for r in jsonl.file_hashes(spark, p).collect()}
    }
    jsonl.write_report(Path(out) / "audit.json", report)
    drop_written(spark)  # the outputs are stored
    return report
