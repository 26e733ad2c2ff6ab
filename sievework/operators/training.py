"""Tabular pieces of training: token windows, label masks, padding, grouped losses, token audits."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.quantiles import group_key, quantiles

IGNORED = -100


def assistant_labels(ids: Column, spans: Column) -> Column:
    """Labels that keep the ids inside ``spans`` (array of start, end) and mask the others."""
    return F.transform(ids, lambda x, i: F.when(F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"])), x).otherwise(IGNORED))


def chat_tokens(messages, encode: Callable[[str, str], Sequence[int]]):
    """``(input_ids, labels, error)`` of conversations whose template is one message after the other.

    ``encode(role, content)`` gives a message's ids; other roles than the assistant are masked.  A case of ``template_tokens``.
    """
    return template_tokens(messages, lambda chat, _: [i for turn in chat for i in encode(turn["role"], turn["content"] or "")])


def template_tokens(messages, render: Callable[[list, bool], Sequence[int]]):
    """``(input_ids, labels, error)`` of conversations under an injected chat template.

    ``render(messages, generation_prompt)`` gives the ids of a conversation, with the opening of the next answer if asked.  An
    answer's labels run from the ids of what precedes it, with that opening, to the ids through it; both must be prefixes of the whole,
    else the template is not stable, ``error`` says where, and labels are null.  A conversation without a trainable id has that as its error.  An
    opening that ``render`` does not give belongs to the answer.
    """

    def one(chat) -> tuple[list[int], list[int] | None, str | None]:
        turns = list(chat) if chat is not None else []
        ids = list(render(turns, False))
        labels = [IGNORED] * len(ids)
        for i, turn in enumerate(turns):
            if turn["role"] != "assistant":
                continue
            start, stop = list(render(turns[:i], True)), list(render(turns[: i + 1], False))
            for name, part in (("before", start), ("after", stop)):
                if ids[: len(part)] != part:
                    return ids, None, f"unstable_{name}_answer"
            if len(stop) <= len(start):
                return ids, None, "empty_answer"
            labels[len(start) : len(stop)] = ids[len(start) : len(stop)]
        return ids, labels, None if any(x != IGNORED for x in labels) else "no_trainable_label"

    def batch(chats: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(chat) for chat in chats], columns=["input_ids", "labels", "error"])

    return F.pandas_udf(batch, "input_ids array<int>, labels array<int>, error string")(messages)


def dataset_stats(rows: DataFrame, limit: int, strategy: str, *by: str) -> DataFrame:
    """Rows, kept and dropped ones (by the cut, or without any trainable label) and the longest, per ``by``."""
    cut = truncated(rows, limit, strategy)
    cut = cut.withColumn("dropped", F.col("dropped") | ~F.coalesce(F.exists("labels", lambda x: x != IGNORED), F.lit(False)))
    return cut.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(~F.col("dropped")).alias("kept"), F.count_if("dropped").alias("dropped"),
        F.max(F.size("input_ids")).alias("longest"), F.sum(F.size(F.filter("labels", lambda x: x != IGNORED))).alias("trainable"),
    )


def truncated(rows: DataFrame, limit: int, strategy: str = "left", strict: bool = False) -> DataFrame:
    """Token rows cut to ``limit`` ids; rows that are not longer stay as they are.

    ``left`` (``keep_left``) keeps the last ids, ``right`` (``keep_right``) the first, ``drop`` marks longer rows as dropped, ``error``
    raises for them.  A cut that leaves no trainable label marks the row as dropped, or raises if ``strict``.  Ids and labels of
    different lengths raise.
    """
    kind = strategy.lower().replace("keep_", "")
    if limit <= 0 or kind not in ("left", "right", "drop", "error"):
        raise ValueError("a positive limit, and one of drop, error, left, right")
    n = F.size("input_ids")
    long = n > limit
    begin = F.when(long, F.greatest(n - limit + 1, F.lit(1))).otherwise(1) if kind == "left" else F.lit(1)
    part = (lambda c: F.when(long, F.slice(c, begin, F.lit(limit))).otherwise(F.col(c))) if kind in ("left", "right") else F.col
    out = rows.withColumns({"_ids": part("input_ids"), "_labels": part("labels")})
    lost = long & ~F.exists("_labels", lambda x: x != IGNORED)
    dropped = long if kind == "drop" else lost
    stop = F.lit(False)
    if kind == "error":
        stop = F.when(long, F.raise_error(F.concat(F.lit(f"more than {limit} ids: "), n.cast("string")))).otherwise(False)
    elif strict and kind != "drop":
        stop = F.when(lost, F.raise_error(F.lit(f"{strategy} leaves no trainable label"))).otherwise(False)
    uneven = F.when(F.coalesce(n, F.lit(0)) != F.coalesce(F.size("labels"), F.lit(0)), F.raise_error(F.lit("ids and labels differ in length"))).otherwise(False)
    return out.select(
        *[c for c in rows.columns if c not in ("input_ids", "labels")],
        F.col("_ids").alias("input_ids"), F.col("_labels").alias("labels"), (stop | uneven | F.coalesce(dropped, F.lit(False))).alias("dropped"),
    )


def padded(rows: DataFrame, batch: str, multiple: int = 8, pad_id: int = 0) -> DataFrame:
    """Token rows right-padded to their batch's longest row, rounded up to a multiple; with attention masks."""
    longest = rows.groupBy(batch).agg(F.max(F.size("input_ids")).alias("m"))
    width = (F.ceil(F.col("m") / multiple) * multiple).cast("int")
    gap = width - F.size("input_ids")
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), gap))
    return rows.join(longest, batch).select(
        *[c for c in rows.columns if c not in ("input_ids", "labels")],
        fill("input_ids", pad_id).alias("input_ids"),
        fill("labels", IGNORED).alias("labels"),
        fill(F.transform("input_ids", lambda _: F.lit(1)), 0).alias("attention_mask"),
    )


def grouped_loss(rows: DataFrame) -> DataFrame:
    """``(kind, name, loss, tokens)``: token-weighted loss overall, by question type and dimension, and the macro means.

    A macro is the unweighted mean of the averages of groups with tokens; unknown groups are ``unknown``.
    """
    name = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown"))
    kinds = F.array(
        F.struct(F.lit("overall").alias("kind"), F.lit("all").alias("name")),
        F.struct(F.lit("qtype").alias("kind"), name("qtype").alias("name")),
        F.struct(F.lit("dimension").alias("kind"), name("dimension").alias("name")),
    )
    flat = rows.select("loss_sum", "token_count", F.explode(kinds).alias("g"))
    per = flat.groupBy(F.col("g.kind").alias("kind"), F.col("g.name").alias("name")).agg(F.sum("loss_sum").alias("l"), F.sum("token_count").alias("tokens"))
    per = per.where("tokens > 0").select("kind", "name", (F.col("l") / F.col("tokens")).alias("loss"), "tokens")
    macro = per.where("kind <> 'overall'").groupBy(F.concat(F.lit("macro_"), F.col("kind")).alias("kind")).agg(F.avg("loss").alias("loss"), F.sum("tokens").alias("tokens"))
    return per.union(macro.select("kind", F.lit("all").alias("name"), "loss", "tokens"))


def token_audit(rows: DataFrame, limit: int, *by: str) -> DataFrame:
    """Nearest-rank percentiles of token counts, rows above the limit, rows without the final markers."""
    base = rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.max("tokens").cast("bigint").alias("max"),
        F.count_if(F.col("tokens") > limit).alias("overlength"),
        F.count_if(~F.coalesce(F.contains("answer", F.lit("</think>")), F.lit(False))).alias("without_think_end"),
        F.count_if(~F.coalesce(F.contains("answer", F.lit("\\boxed{")), F.lit(False))).alias("without_box"),
    )
    parts = quantiles(rows, "tokens", by, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    disc = [F.col(p).cast("bigint").alias(p) for p in ("p50", "p95", "p99")]
    return base.withColumn("_k", group_key(by)).join(parts, "_k", "left").select(*by, "rows", *disc, "max", "overlength", "without_think_end", "without_box")


def overlength(rows: DataFrame, limit: int) -> DataFrame:
    return rows.where(F.col("tokens") > limit).orderBy(F.desc("tokens"), "id")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Batch numbers inside hashed blocks of rows; no global window."""
    w = Window.partitionBy("_b").orderBy(order)
    keyed = rows.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(64)))
    return keyed.withColumn("batch", F.concat_ws("-", "_b", F.floor((F.row_number().over(w) - 1) / size).cast("string"))).drop("_b")
