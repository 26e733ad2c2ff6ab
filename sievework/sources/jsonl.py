"""JSON lines in and out, with line numbers and strict errors."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MalformedLine(ValueError):
    """A line that is no JSON object; the message names path and line."""


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, _source_line, value)``: non-blank lines with their 1-based physical line number.

    Line numbers come from the partitions' line counts (one number per partition), so files are read in parallel.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    marked = raw.withColumn("id", F.monotonically_increasing_id())
    part = F.shiftright("id", 33)
    chunk = marked.groupBy("path", "block", part.alias("part")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    rows = sorted((r["path"], r["block"], r["part"], r["n"], r["first"]) for r in chunk.collect())  # one row per input split
    starts, seen = [], {}
    for p, b, q, n, first in rows:
        starts.append((p, b, q, seen.get(p, 0) - first + 1))
        seen[p] = seen.get(p, 0) + n
    offsets = spark.createDataFrame(starts, "path string, block bigint, part bigint, shift bigint")
    return (
        marked.withColumn("part", part)
        .join(F.broadcast(offsets), ["path", "block", "part"])
        .where(F.trim(F.col("value")) != "")
        .select("path", (F.col("id") + F.col("shift")).alias("_source_line"), "value")
    )


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, line_numbers: bool = True, strict: bool = True) -> DataFrame:
    """Objects of a JSON lines file; a line number already in the data is kept.

    ``strict`` raises ``MalformedLine`` for the first bad line, else bad lines are kept in ``_corrupt_record``.
    """
    fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    own = "_source_line" in fields.fieldNames()
    full = T.StructType([*fields.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = read_lines(spark, path).select("path", F.col("_source_line").alias("_line"), "value", F.from_json("value", full, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    is_bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.trim("value").startswith("{")
    if strict:
        bad = parsed.where(is_bad).orderBy("path", "_line").select("path", "_line").first()
        if bad:
            raise MalformedLine(f"{bad['path']}:{bad['_line']}: not a JSON object")
    out = parsed.select("_line", F.when(is_bad, F.col("value")).alias("_bad"), "r.*").drop("_corrupt_record")
    if line_numbers:
        out = out.withColumn("_source_line", F.coalesce("_source_line", "_line") if own else F.col("_line"))
    return out.drop("_line", *(["_bad"] if strict else [])).withColumnsRenamed({} if strict else {"_bad": "_corrupt_record"})


def guard_outputs(paths: list[str | Path], force: bool = False, spark: SparkSession | None = None) -> None:
    """Refuses to overwrite any of the outputs unless forced; with a session, paths of any of its file systems are seen."""

    def exists(path: str) -> bool:
        if spark is None:
            return os.path.exists(path)
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    there = [str(p) for p in paths if exists(str(p))]
    if there and not force:
        raise FileExistsError("outputs exist: " + ", ".join(there))


def write_jsonl(df: DataFrame, path: str, force: bool = False) -> None:
    """A folder of JSON lines files; nulls are kept, the commit protocol makes it whole or nothing."""
    df.write.mode("overwrite" if force else "errorifexists").option("ignoreNullFields", "false").json(path)


def write_text(path: str | Path, text: str) -> None:
    """A small file, whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix="." + path.name)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def write_report(path: str | Path, report: dict) -> None:
    """A report as indented JSON with sorted keys."""
    write_text(path, json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size, sha256)`` of files, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
