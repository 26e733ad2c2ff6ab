"""The append-only attempt log as a stream: the last success of every key, kept as log files arrive.

A file stream in append mode feeds one stateful aggregate (``max_by`` per key) in update mode: each trigger writes the keys it changed
to a folder of its own, named by the batch, and replaces only that folder if it runs again.  A reader takes every key's row
of the latest batch, so it never sees a half-written table.  The checkpoint makes reading each file exactly-once, so a
restarted job goes on where it stopped and never counts an attempt twice.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.evalgrid import KEY
from sievework.session import shared_folder


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """The log as a stream; ``path`` is a folder of Parquet files or one file."""
    local = path.removeprefix("file://")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if os.path.isfile(local):
        folder, name = os.path.split(path)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def latest_successes(stream: DataFrame, key: tuple[str, ...] = KEY, order: str = "prediction_id") -> DataFrame:
    rest = [c for c in stream.columns if c not in key]
    best = stream.where("error IS NULL").groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return best.select(*key, "r.*")


def attempt_counts(stream: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Attempts and failures per key: the running audit of the log."""
    return stream.groupBy(*key).agg(F.count("*").alias("attempts"), F.count("error").alias("failures"))


def run_to_table(stream: DataFrame, folder: str | None = None, key: tuple[str, ...] = KEY) -> DataFrame:
    """Runs a stateful stream over everything that is there and returns the table of its latest rows per key."""
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    out = f"{folder}/table"
    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return latest(spark.read.schema(f"{_ddl(stream)}, batch bigint").parquet(out), key)


def _ddl(stream: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)


def latest(changes: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """The rows of ``(key..., other columns, batch)`` of every key's latest batch."""
    rest = [c for c in changes.columns if c not in (*key, "batch")]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")


def append(rows: DataFrame, path: str) -> None:
    """Adds finished attempts to the log; a failed write leaves nothing behind (commit protocol)."""
    rows.write.mode("append").parquet(path)


def pending(grid: DataFrame, log: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Grid keys without a success in the log: what a resumed run still has to do."""
    return grid.join(log.where("error IS NULL").select(*key).distinct(), list(key), "left_anti")
