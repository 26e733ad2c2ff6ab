"""Checks of a model repository on a local or shared file system."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievework.operators import manifest

#: Files that a repository must hold.
REQUIRED = ["config.json", "tokenizer_config.json", "tokenizer.json"]
INDEX = "model.safetensors.index.json"


def _object(spark: SparkSession, path: str) -> dict:
    """One small JSON file as an object; {} if it is none."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    try:
        value = json.loads(rows[0][0]) if rows else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def inspect(spark: SparkSession, folder: str, least_bytes: int, model_type: str | None = None) -> list[str]:
    """``path: error`` lines: absent and foreign files, shards against their index, sizes, and what the configurations declare."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)  # empty files too, which a scan leaves out
    listed = spark.createDataFrame([(f.getPath().getName(), f.getLen()) for f in files if f.isFile()], "path string, size bigint")
    names = {r["path"] for r in listed.select("path").where(F.col("path").isin(*REQUIRED, INDEX)).collect()}
    index = _object(spark, f"{folder}/{INDEX}") if INDEX in names else {"weight_map": {"": "model.safetensors"}}
    shards = spark.createDataFrame([(s,) for s in sorted(set((index.get("weight_map") or {}).values()))], "path string")
    declared = (index.get("metadata") or {}).get("total_size", 0)
    found = manifest.repository_errors(listed, shards, REQUIRED, manifest.FOREIGN_WEIGHTS, max(least_bytes, int(declared)))
    out = [f"{r['path']}: {r['error']}" for r in found.orderBy("path", "error").collect()]
    out += [f"{r['path']}: empty" for r in listed.where("size = 0").join(shards, "path", "left_semi").orderBy("path").collect()]
    objects = [_object(spark, f"{folder}/{n}") if n in names else {} for n in ("config.json", "tokenizer_config.json")]
    return out + [f"config: {e}" for e in manifest.model_config_errors(*objects, model_type)]
