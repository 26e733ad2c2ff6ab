"""Validation and cleaning of chat records, with every rejection reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.letters import box_count, letters_az, option_letters
from sievework.functions.messages import chat_error, last_content, with_last_answer
from sievework.functions.text import story_of, with_clean_answer
from sievework.operators.quantiles import group_key, quantiles


def fields(records: DataFrame) -> DataFrame:
    """Adds what the rules look at: prompt, answer, story, options, dimension, question type, letters."""
    m = F.col("messages")
    return records.select(
        "*",
        last_content(m, "user").alias("prompt"),
        last_content(m, "assistant").alias("answer"),
        letters_az(F.col("gold_letters")).alias("gold"),
        letters_az(F.col("pred_letters")).alias("pred"),
        F.trim(F.coalesce("meta.dim", F.lit(""))).alias("dimension"),
        F.upper(F.trim(F.coalesce("meta.qtype", F.lit("")))).alias("question_type"),
    ).select("*", story_of(F.col("prompt")).alias("story"), option_letters(F.col("prompt")).alias("option_letters"))


def reasons(allow_mismatch: bool = False) -> Column:
    """All reasons to reject a record, sorted; empty if it is accepted."""
    n = F.size("option_letters")
    outside = F.size(F.array_except("gold", "option_letters")) > 0
    rules = [
        (F.size("messages") < 1) | F.col("messages").isNull() | (F.col("prompt") == "") | (F.col("answer") == ""),
        F.col("story") == "",
        F.col("dimension") == "",
        (F.col("question_type") == "Q2") & (F.array_contains("option_letters", "F") | (n > 5)),
        F.size("gold") == 0,
        (F.size("gold") > 0) & (n > 0) & outside,
    ]
    names = ["invalid_or_missing_chat", "story_extraction_failed", "missing_dimension", "legacy_q2_six_options", "missing_gold_letters", "gold_outside_options"]
    if not allow_mismatch:
        rules.append((F.size("pred") > 0) & (F.col("pred") != F.col("gold")))
        names.append("gold_pred_mismatch")
    return F.array_sort(F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), n) for r, n in zip(rules, names)))))


def judged(records: DataFrame, allow_mismatch: bool = False) -> DataFrame:
    return fields(records).withColumn("reasons", reasons(allow_mismatch))


def accepted(records: DataFrame, limit: int = 1800, style: str = "compressed") -> DataFrame:
    """Accepted records with the answer rewritten to one canonical box, and what was done to it."""
    ok = with_clean_answer(judged(records).where(F.size("reasons") == 0), "answer", "gold", limit, style)
    return ok.select(
        "_source_line", "sample_id", "prompt_type", F.col("gold").alias("gold_letters"), "story", "dimension", "question_type", "option_letters",
        with_last_answer(F.col("messages"), F.col("clean")).alias("messages"), "story_cluster_id", "source",
        F.struct(
            F.col("_source_line").alias("source_line"),
            F.lit(True).alias("answer_cleaned"),
            F.char_length("answer").alias("original_answer_chars"),
            F.char_length("clean").alias("clean_answer_chars"),
            box_count(F.col("answer")).alias("original_boxed_count"),
        ).alias("_pipeline"),
    )


def rejected(records: DataFrame) -> DataFrame:
    return judged(records).where(F.size("reasons") > 0).select("_source_line", "sample_id", "reasons")


def reason_counts(records: DataFrame) -> DataFrame:
    """Rows per rejection reason; a row counts once for each of its reasons."""
    return judged(records).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("rows"))


def cleaning_audit(records: DataFrame) -> DataFrame:
    """Counts before and after cleaning by question type, in one pass."""
    j = judged(records)
    ok = F.size("reasons") == 0
    return j.groupBy("question_type").agg(
        F.count("*").alias("rows"),
        F.count_if(ok).alias("accepted"),
        F.count_if((F.size("pred") > 0) & (F.col("pred") != F.col("gold"))).alias("letter_mismatches"),
        F.sum(box_count(F.col("answer"))).alias("boxes"),
        F.count_distinct(F.when(ok, F.col("dimension"))).alias("accepted_dimensions"),
        F.sum(F.size("option_letters")).alias("options"),
    )


def chat_errors(records: DataFrame) -> DataFrame:
    """Rows per reason for which a conversation can't be trained on (``ok`` for none)."""
    return records.groupBy(F.coalesce(chat_error(F.col("messages")), F.lit("ok")).alias("reason")).agg(F.count("*").alias("rows"))


def distribution(rows: DataFrame, *by: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("rows"))


def duplicate_audit(rows: DataFrame, value: str) -> DataFrame:
    """Distinct values, repeated values and the rows that hold them; nulls don't count."""
    per = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("distinct_values"),
        F.count_if(F.col("n") > 1).alias("repeated_values"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows_in_repeats"),
    )


def length_summary(rows: DataFrame, length: str, *by: str) -> DataFrame:
    """Count, minimum, interpolated median, nearest-rank 95th and 99th percentile, maximum of a column."""
    base = rows.groupBy(*by).agg(F.count(length).alias("count"), F.min(length).cast("double").alias("min"), F.max(length).cast("double").alias("max"))
    parts = quantiles(rows, length, by, {"p95": 0.95, "p99": 0.99}, "median")
    return base.withColumn("_k", group_key(by)).join(parts, "_k", "left").select(
        *by, "count", "min", "median", F.col("p95").cast("double").alias("p95"), F.col("p99").cast("double").alias("p99"), "max"
    )
