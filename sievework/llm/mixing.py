"""Problem 8: mixing sources to target weights.

Poisson replication: every distinct text of a source is repeated by a draw from a Poisson distribution whose
mean is the source's repetition rate, inverted from a uniform number hashed from seed and text and truncated at
``max_repeats``; the parameter is chosen so that the truncated distribution has the rate as its expectation.  Texts are
exploded by their counts and put in one global order by hash.

The mix is as large as the texts of all target sources together, or as asked for.  A source's wanted tokens are its share of
that; one that is too small is used up to its cap and stays below, and the report tells how many tokens it lacks.  No source
changes the size of the mix or the draws of another.

Defined results: sources that differ in case, surrounding blanks or ``-`` for ``_`` are one; null and other
sources take no part.  A text that is repeated, within a source or over several, is one text, of the source of its
smallest ``doc_id``, so it never stands more than ``max_repeats`` times in the mix.  Null and empty texts are left out.  A
target without texts is reported with a share of 0.  A source named by several targets has the sum of their shares and the
largest of their caps.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.values import strip
from sievework.llm.tokens import VOCABULARY, counted
from sievework.session import cut, ranked, written

SEED = 29


def _name(column: str):
    return F.replace(F.lower(strip(F.col(column))), F.lit("-"), F.lit("_"))


def _cdf(mean: float, cap: int) -> list[float]:
    """P(Poisson(mean) <= n) for n below the cap: the truncated draw is the number of these at or below u."""
    out, term, total = [], math.exp(-mean), 0.0
    for n in range(cap):
        total += term
        out.append(total)
        term *= mean / (n + 1)
    return out


def thresholds(rate: float, cap: int) -> list[float]:
    """Distribution function of the truncated Poisson distribution with expectation ``rate``."""
    if rate >= cap - 1e-9:
        return [0.0] * cap
    low, high = 0.0, 700.0
    for _ in range(200):
        mid = (low + high) / 2
        if cap - sum(_cdf(mid, cap)) < rate:
            low = mid
        else:
            high = mid
    return _cdf(low, cap)


def _sources(targets: DataFrame) -> DataFrame:
    return (
        targets.select(_name("source").alias("source"), "target_permille", "max_repeats")
        .where("source IS NOT NULL AND target_permille > 0 AND max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_permille").alias("target_permille"), F.max("max_repeats").alias("max_repeats"))
    )


def _mix(documents: DataFrame, targets: DataFrame, total: int | None, vocabulary: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """The drawn texts with their ``times``, and per target source ``(source, target_permille, max_repeats, wanted)``."""
    spark = documents.sparkSession
    goals = {r[0]: (r[1], r[2]) for r in _sources(targets).collect()}  # one row per target
    rows = counted(documents, vocabulary).where("tokens > 0").withColumn("source", _name("source"))
    rows = rows.where(F.col("source").isin(*goals))
    texts = rows.groupBy("k").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("t")).select("k", "t.*")
    texts = written(texts, "texts")
    have = {r[0]: r[1] for r in texts.groupBy("source").agg(F.sum("tokens")).collect()}
    whole = sum(p for p, _ in goals.values()) or 1
    size = sum(have.values()) if total is None else total
    plan = []
    for s, (p, cap) in sorted(goals.items()):
        wanted = size * p / whole
        plan.append((s, p, cap, float(wanted), thresholds(min(wanted / have[s], cap), cap) if have.get(s) else []))
    plan = spark.createDataFrame(plan, "source string, target_permille bigint, max_repeats int, wanted double, cdf array<double>")  # one row per target
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "k"), 11) / float(1 << 53)
    drawn = texts.withColumn("u", u).join(F.broadcast(plan.select("source", "cdf")), "source")
    drawn = drawn.withColumn("times", F.size(F.filter("cdf", lambda c: c <= F.col("u")))).where("times > 0")
    return drawn.select("k", "doc_id", "source", "tokens", "times"), plan.drop("cdf")


def mixed(documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """``(position, source, doc_id, repeat_no, tokens)``: the mix in its global order."""
    drawn = _mix(documents, targets, total, vocabulary, seed)[0].withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("times"))))
    order = drawn.select("source", "doc_id", "repeat_no", "tokens", F.xxhash64(F.lit(seed + 1), "k", "repeat_no").alias("o"))
    placed = ranked(order, [F.col("o"), F.col("doc_id"), F.col("repeat_no")], "position")
    return placed.select("position", "source", "doc_id", "repeat_no", "tokens")


def report(documents: DataFrame, targets: DataFrame, total: int | None = None, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """Per target source: wanted and reached permille of all tokens, texts, uses, the most uses of one text, and lacking tokens.

    ``lacking_tokens`` is what the source has too few of even if every text is used ``max_repeats`` times or as drawn.
    """
    drawn, goals = _mix(documents, targets, total, vocabulary, seed)
    per = drawn.groupBy("source").agg(
        F.count("*").alias("texts"), F.sum("times").alias("uses"), F.max("times").alias("most_uses"), F.sum(F.col("tokens") * F.col("times")).alias("tokens")
    )
    per = cut(goals.join(per, "source", "left").fillna(0, ["texts", "uses", "most_uses", "tokens"]))
    total_tokens = per.agg(F.sum("tokens").alias("all_tokens"))
    return per.join(F.broadcast(total_tokens)).select(
        "source",
        "target_permille",
        F.when(F.col("all_tokens") > 0, F.round(F.col("tokens") * 1000 / F.col("all_tokens"), 3)).otherwise(F.lit(0.0)).alias("permille"),
        "texts",
        "uses",
        "most_uses",
        "max_repeats",
        "tokens",
        F.greatest(F.lit(0), F.round(F.col("wanted") - F.col("tokens"))).cast("bigint").alias("lacking_tokens"),
    )


def caps(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its share and cap, and whether the cap is kept."""
    r = report(documents, targets)
    return r.select("source", "target_permille", "max_repeats", (F.col("most_uses") <= F.col("max_repeats")).alias("kept"))
