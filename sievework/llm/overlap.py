"""Problem 1: records of evaluation splits that also stand in the training split.

Minwise hash shingles with banded buckets: every distinct story-and-question text gets a minwise
signature of its 5-character pieces; texts of one bucket that come from both sides are
candidates, and only those; their exact Jaccard similarity decides.  Confirmed pairs are
aggregated by split and source.

Defined results: rows whose ``messages`` is null, holds no user message, no story label, or no
letter or digit in the measured text overlap with nothing.  A null split is neither side.  Repeated
rows count as rows of their own.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.records import last_content, story_and_question
from sievework.llm.regions import joined, packed_texts, routed

THRESHOLD = 0.7
#: A pair at exactly 0.7 is missed with probability (1 - 0.7**3)**28 < 8e-6.
BANDS, ROWS = 28, 3


def cross_split_pairs(
    records: DataFrame,
    threshold: float = THRESHOLD,
    train: str = "train",
    held_out: tuple[str, ...] = ("dev", "test"),
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(train_line, eval_line, similarity)``: every overlapping pair of records.

    Copies are collapsed before the search and expanded after it, so a text repeated a million
    times is signed, bucketed and compared once.
    """
    side = F.when(F.col("split_name") == train, 1).when(F.col("split_name").isin(*held_out), 2)
    texts = records.select(
        F.col("_source_line").alias("id"), side.alias("side"), last_content("messages", "user").alias("text")
    ).where("side IS NOT NULL AND text IS NOT NULL")
    packed, dictionary = packed_texts(texts, story_and_question)
    members = routed(packed, dictionary, bands, rows, cross=True)
    near = joined(members, packed, dictionary, threshold, cross=True)
    lines = packed.select("id", "side", "k")
    equal = lines.groupBy("k").agg(F.bit_or("side").alias("side")).where("side = 3")
    pairs = near.select(F.col("ka").alias("kt"), F.col("kb").alias("ke"), "similarity")
    both = pairs.union(near.select(F.col("kb"), F.col("ka"), "similarity")).union(
        equal.select("k", "k", F.lit(1.0))
    )
    train_lines = lines.where("side = 1").select(F.col("k").alias("kt"), F.col("id").alias("train_line"))
    eval_lines = lines.where("side = 2").select(F.col("k").alias("ke"), F.col("id").alias("eval_line"))
    return both.join(eval_lines, "ke").join(train_lines, "kt").select("train_line", "eval_line", "similarity")


def found(records: DataFrame) -> DataFrame:
    """p1_found: ``(line_a, line_b)``, smaller line first."""
    pairs = cross_split_pairs(records)
    return pairs.select(
        F.least("train_line", "eval_line").alias("line_a"), F.greatest("train_line", "eval_line").alias("line_b")
    )


def report(records: DataFrame) -> DataFrame:
    """Per evaluation split and source: rows, rows that overlap, exact ones among them, pairs, share."""
    pairs = cross_split_pairs(records)
    hit = pairs.groupBy("eval_line").agg(F.count("*").alias("pairs"), F.max("similarity").alias("best"))
    rows = records.where(F.col("split_name").isin("dev", "test")).select(
        F.col("_source_line").alias("eval_line"), "split_name", "source"
    )
    return (
        rows.join(hit, "eval_line", "left")
        .groupBy("split_name", "source")
        .agg(
            F.count("*").alias("eval_rows"),
            F.count("pairs").alias("overlapping_rows"),
            F.count(F.when(F.col("best") == 1.0, 1)).alias("equal_rows"),
            F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        )
        .withColumn("overlapping_share", F.round(F.col("overlapping_rows") / F.col("eval_rows"), 6))
    )
