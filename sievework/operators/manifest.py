"""Reconciling file manifests with what is there."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listing(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``(path, size, sha256)`` of a ``binaryFile`` scan or any table with contents."""
    body = F.col(content)
    return df.select(F.col(path).alias("path"), F.octet_length(body).cast("bigint").alias("size"), F.sha2(body.cast("binary"), 256).alias("sha256"))


def reconciled(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """``(path, error)``: missing, size, sha256 (both can hold for one path) and unexpected files.

    A path with a part that begins with a dot is never unexpected.
    """
    both = expected.withColumn("_e", F.lit(1)).alias("e").join(observed.withColumn("_o", F.lit(1)).alias("o"), "path", "full_outer")
    hidden = F.col("path").rlike(r"(^|/)\.")
    errors = F.array_compact(
        F.array(
            F.when(F.col("_o").isNull(), "missing"),
            F.when(F.col("_e").isNotNull() & F.col("_o").isNotNull() & ~F.col("e.size").eqNullSafe(F.col("o.size")), "size"),
            F.when(F.col("_e").isNotNull() & F.col("_o").isNotNull() & ~F.col("e.sha256").eqNullSafe(F.col("o.sha256")), "sha256"),
            F.when(F.col("_e").isNull() & ~hidden, "unexpected"),
        )
    )
    return both.select("path", F.explode(errors).alias("error"))


def first_failures(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """The stop-at-first form: one error per expected file, extra files are no error."""
    rank = F.when(F.col("error") == "missing", 0).when(F.col("error") == "size", 1).otherwise(2)
    r = reconciled(expected, observed).where("error <> 'unexpected'")
    return r.groupBy("path").agg(F.min_by("error", rank).alias("error"))


def fingerprint(manifest: DataFrame) -> str:
    """SHA-256 of the manifest as compact JSON with sorted keys, files in path order (a list for the driver)."""
    files = [{"path": r["path"], "size": r["size"], "sha256": r["sha256"]} for r in manifest.orderBy("path").toLocalIterator()]
    return hashlib.sha256(json.dumps(files, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def repository_errors(files: DataFrame, index: DataFrame, required: list[str], forbidden: str, least_bytes: int, shard: str = r"\.safetensors$") -> DataFrame:
    """``(path, error)`` of a repository listing ``(path, size)`` against an index ``(path)`` of its shards.

    Required names that are absent, files that match ``forbidden``, index entries without a file, shards outside the
    index, and ``*`` / ``too_small`` if all shards together have fewer than ``least_bytes``.
    """
    spark = files.sparkSession
    must = spark.createDataFrame([(r,) for r in required], "path string")
    shards = files.where(F.col("path").rlike(shard))
    small = shards.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).where(F.col("n") < least_bytes)
    parts = [
        must.join(files, "path", "left_anti").select("path", F.lit("required_missing").alias("error")),
        files.where(F.col("path").rlike(forbidden)).select("path", F.lit("forbidden").alias("error")),
        index.select("path").distinct().join(files, "path", "left_anti").select("path", F.lit("shard_missing").alias("error")),
        shards.join(index.select("path").distinct(), "path", "left_anti").select("path", F.lit("not_in_index").alias("error")),
        small.select(F.lit("*").alias("path"), F.lit("too_small").alias("error")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


#: Names of the files that a release holds, beside weights, their index and tokenizer files.
RELEASE_FILES = r"(^|/)(?:[^/]*\.safetensors|[^/]*\.safetensors\.index\.json|tokenizer[^/]*)$"


def included(files: DataFrame, exact: list[str], patterns: str = RELEASE_FILES) -> DataFrame:
    """The files of an allow-list: by name, or by pattern."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(name.isin(exact) | F.col("path").rlike(patterns))


#: Names of adapters and of quantised weights, which a full model does not hold.
FOREIGN_WEIGHTS = r"(^|/)(?:adapter_config\.json|adapter_model[^/]*|[^/]*(?:4bit|gptq|awq)[^/]*)$"
BF16 = ("bfloat16", "bf16", "torch.bfloat16")


def model_config_errors(config: dict, tokenizer: dict, model_type: str | None = None) -> list[str]:
    """What a merged model's configuration objects (one file each) say against its release."""
    kind = config.get("torch_dtype", config.get("dtype"))
    rules = {
        "other_model_type": model_type is not None and config.get("model_type") != model_type,
        "dtype_not_bfloat16": str(kind).lower() not in BF16,
        "declares_quantization": config.get("quantization_config") is not None or bool(config.get("load_in_4bit")),
        "no_architectures": not isinstance(config.get("architectures"), list) or not config["architectures"],
        "no_chat_template": not tokenizer.get("chat_template"),
    }
    return [name for name, broken in rules.items() if broken]
