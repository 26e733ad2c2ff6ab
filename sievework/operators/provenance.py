"""Source keys, replay containment, selection audits and input pins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def source_key(sample_id: Column, source_line: Column, record: Column) -> Column:
    """``sample_id:…|source_line:…``, either alone, else the SHA-256 of the record as JSON.

    Blank sample ids count as absent.
    """
    sid = F.nullif(F.trim(sample_id.cast("string")), F.lit(""))
    parts = F.concat_ws("|", F.concat(F.lit("sample_id:"), sid), F.concat(F.lit("source_line:"), source_line.cast("string")))
    return F.when(parts != "", parts).otherwise(F.concat(F.lit("sha256:"), F.sha2(F.to_json(record), 256)))


def record_field(top: Column, nested: Column, default: str = "unknown", top_first: bool = True) -> Column:
    """A field that a record can hold itself or in its metadata: the first that is filled, else the default."""
    filled = [F.nullif(F.trim(c), F.lit("")) for c in ((top, nested) if top_first else (nested, top))]
    return F.coalesce(*filled, F.lit(default))


def record_metadata(records: DataFrame) -> DataFrame:
    """``(_source_line, sample_id, qtype, dimension)`` with the nested fields first and defaults for absent ones."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return records.select(
        "_source_line",
        F.coalesce(filled(F.col("sample_id")), F.format_string("row-%06d", F.col("_source_line"))).alias("sample_id"),
        F.upper(F.coalesce(filled(F.col("meta.qtype")), F.lit("unknown"))).alias("qtype"),
        F.coalesce(filled(F.col("meta.dim")), F.lit("unknown")).alias("dimension"),
    )


def outside(replay: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Replay rows whose key is not in train; must be empty before they are mixed."""
    return replay.join(train.select(key).distinct(), key, "left_anti")


def occurrences(rows: DataFrame, key: str) -> DataFrame:
    """``(times, keys)``: how many keys are used how often."""
    per = rows.groupBy(key).agg(F.count("*").alias("times"))
    return per.groupBy("times").agg(F.count("*").alias("keys"))


def most_repeated(rows: DataFrame, key: str, top: int = 20) -> DataFrame:
    """The ``top`` keys by uses, then by key: a top-k report."""
    return rows.groupBy(key).agg(F.count("*").alias("times")).orderBy(F.desc("times"), key).limit(top)


def selection_audit(selected: DataFrame, bucket: str = "bucket") -> DataFrame:
    """Rows, distinct samples, dimensions and the largest repetition per bucket."""
    per = selected.groupBy(bucket, "sample_id").agg(F.count("*").alias("n"), F.first("dimension").alias("dimension"))
    return per.groupBy(bucket).agg(
        F.sum("n").alias("rows"), F.count("*").alias("samples"), F.count_distinct("dimension").alias("dimensions"), F.max("n").alias("most_uses")
    )


def invariants(checks: dict[str, bool]) -> None:
    """All invariants must hold; those that don't are named together."""
    broken = sorted(k for k, ok in checks.items() if not ok)
    if broken:
        raise AssertionError("broken invariants: " + ", ".join(broken))


def pinned(observed: DataFrame, pins: dict[str, str]) -> None:
    """Raises unless every pinned file name is there with its SHA-256 (``observed`` is a listing)."""
    names = observed.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256").where(F.col("name").isin(*pins))
    got = {r["name"]: r["sha256"] for r in names.collect()}  # one row per pinned file
    wrong = [f"{n}: {'missing' if n not in got else 'other content'}" for n, h in sorted(pins.items()) if got.get(n) != h]
    if wrong:
        raise ValueError("inputs are not the pinned ones: " + "; ".join(wrong))
