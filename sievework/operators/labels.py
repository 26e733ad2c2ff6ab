"""Reconciling declared answer letters with answer texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.letters import OPTION_TEXT, letters_az
from sievework.functions.text import option_key, semantic_key, story_key

#: Option texts of yes/no questions and what they mean.
MEANINGS = {"是": "yes", "否": "no", "无法确定": "uncertain", "证据不足": "uncertain", "信息不足": "uncertain", "无法判断": "uncertain"}


def _keys_of(records: DataFrame, key) -> DataFrame:
    """``(text, key)`` of all distinct option and answer texts: each is normalised once."""
    texts = records.select(F.explode(F.map_values("options")).alias("text")).union(records.select(F.explode("correct_answers")))
    return texts.where("text IS NOT NULL").distinct().select("text", key("text").alias("key"))


def answer_candidates(records: DataFrame, key=story_key, id_: str = "public_line") -> DataFrame:
    """``(id, position, answer, candidates)``: the option letters whose normal text equals an answer's."""
    keys = _keys_of(records, key)
    options = (
        records.select(id_, F.explode("options").alias("letter", "text"))
        .join(keys, "text")
        .groupBy(id_, "key")
        .agg(F.array_sort(F.collect_set(F.upper("letter"))).alias("candidates"))
    )
    answers = records.select(id_, F.posexplode("correct_answers").alias("position", "text"))
    return (
        answers.join(keys, "text", "left")
        .join(options, [id_, "key"], "left")
        .select(id_, "position", F.col("text").alias("answer"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))
    )


def mapped(records: DataFrame, key=story_key, id_: str = "public_line") -> DataFrame:
    """Per record: letters the answer texts map to, answers without and with several candidates."""
    c = answer_candidates(records, key, id_)
    n = F.size("candidates")
    return c.groupBy(id_).agg(
        F.array_sort(F.collect_set(F.when(n == 1, F.col("candidates")[0]))).alias("mapped_letters"),
        F.array_sort(F.collect_list(F.when(n == 0, F.coalesce("answer", F.lit(""))))).alias("unmapped_answers"),
        F.array_sort(F.collect_list(F.when(n > 1, F.col("answer")))).alias("ambiguous_answers"),
        F.max(F.when(n == 1, 0).otherwise(1)).alias("_open"),
    )


def audit(records: DataFrame) -> DataFrame:
    """Status and issues of every labelled item.

    Status: missing, unmapped, ambiguous, conflict, agree; the first that holds.
    """
    m = mapped(records).drop("_open")
    empty = F.array().cast("array<string>")
    r = records.join(m, "public_line", "left").select(
        "*",
        letters_az(F.col("correct_letters")).alias("declared"),
        F.coalesce("mapped_letters", empty).alias("from_text"),
        F.coalesce("unmapped_answers", empty).alias("unmapped"),
        F.coalesce("ambiguous_answers", empty).alias("ambiguous"),
    )
    d, t = F.col("declared"), F.col("from_text")
    missing = (F.size(d) == 0) | (F.coalesce(F.size("correct_answers"), F.lit(0)) <= 0)
    single = (F.col("task_format") == "mcq_single") & (F.greatest(F.size(d), F.size(t)) > 1)
    issues = F.array(
        F.when(F.size(d) == 0, "missing_declared_letters"),
        F.when(F.coalesce(F.size("correct_answers"), F.lit(0)) <= 0, "missing_answer_texts"),
        F.when(F.size("unmapped") > 0, "unmapped_answer_text"),
        F.when(F.size("ambiguous") > 0, "ambiguous_answer_text"),
        F.when(d != t, "letters_answers_conflict"),
        F.when(single, "single_format_with_multiple_answers"),
    )
    status = (
        F.when(missing, "missing")
        .when(F.size("unmapped") > 0, "unmapped")
        .when(F.size("ambiguous") > 0, "ambiguous")
        .when(d != t, "conflict")
        .otherwise("agree")
    )
    return r.select(
        "public_line", "sample_id", "story", "question_type", "task_format", "declared", "from_text", "unmapped", "ambiguous",
        F.array_compact(issues).alias("issues"), status.alias("status"),
    )


def usable(audited: DataFrame, policy: str = "agreement_only") -> DataFrame:
    """Items that may be scored under a policy, with their evaluation letters."""
    clean = ~F.array_contains("issues", "single_format_with_multiple_answers")
    if policy == "agreement_only":
        return audited.where((F.col("status") == "agree") & clean).withColumn("evaluation_letters", F.col("declared"))
    if policy != "mapped_answer_text":
        raise ValueError("policy must be agreement_only or mapped_answer_text")
    return audited.where(F.col("status").isin("agree", "conflict") & clean).withColumn("evaluation_letters", F.col("from_text"))


def complete_bundles(audited: DataFrame, cluster: str = "story", policy: str = "agreement_only") -> DataFrame:
    """Usable items of clusters all of whose items are usable: two counts per cluster, joined back."""
    ok = usable(audited, policy).select("public_line", "evaluation_letters")
    marked = audited.join(ok, "public_line", "left")
    counts = marked.groupBy(cluster).agg(F.count("*").alias("n"), F.count("evaluation_letters").alias("u")).where("n = u").select(cluster)
    return marked.join(counts, cluster)


def status_counts(audited: DataFrame) -> DataFrame:
    """Rows per status and per issue."""
    a = audited.groupBy(F.lit("status").alias("kind"), F.col("status").alias("value")).agg(F.count("*").alias("rows"))
    i = audited.select(F.explode("issues").alias("v")).groupBy(F.lit("issue").alias("kind"), F.col("v").alias("value")).agg(F.count("*").alias("rows"))
    return a.union(i)


def gold_audit(records: DataFrame) -> DataFrame:
    """Whether an item's declared letters are safe to score against, by the strict option text form."""
    m = mapped(records, option_key)
    in_range = lambda c: F.filter(c, lambda x: x.rlike("^[A-F]$"))
    r = records.join(m, "public_line", "left")
    reported = in_range(letters_az(F.col("correct_letters")))
    strict = F.when(F.col("_open") == 0, in_range(F.col("mapped_letters")))
    single = (F.lower("task_format") == "mcq_single") & (F.size(reported) != 1)
    reason = (
        F.when(F.col("options").isNull() | F.col("correct_answers").isNull(), "answer_text_not_provided")
        .when(strict.isNull(), "answer_text_unmapped")
        .when(strict != reported, "letter_text_conflict")
        .when(single, "single_format_with_multiple_answers")
        .otherwise("letter_text_agree")
    )
    return r.select("public_line", "sample_id", reported.alias("reported"), strict.alias("mapped"), reason.alias("reason")).withColumn(
        "safe", F.col("reason") == "letter_text_agree"
    )


def yes_no_meaning(records: DataFrame, prompt: Column, gold: Column, id_: str) -> DataFrame:
    """Meaning of a three-option yes/no item's gold letter, or why it has none.

    Options must be exactly three, all on the list of known texts, covering yes, no and uncertain.
    """
    section = F.when(F.contains(prompt, F.lit("选项：")), F.substring_index(prompt, "选项：", -1)).when(
        F.contains(prompt, F.lit("选项:")), F.substring_index(prompt, "选项:", -1)
    ).otherwise(prompt)
    letters = F.regexp_extract_all(section, F.lit(OPTION_TEXT), 1)
    texts = F.regexp_extract_all(section, F.lit(OPTION_TEXT), 2)
    flat = records.select(id_, letters.alias("letters"), texts.alias("texts"), gold.alias("gold"))
    pairs = flat.select(id_, "gold", F.size("letters").alias("n"), F.size(F.array_distinct("letters")).alias("d"), F.explode(F.arrays_zip("letters", "texts")).alias("o"))
    known = F.create_map(*(F.lit(x) for kv in MEANINGS.items() for x in kv))
    words = pairs.select(F.col("o.texts").alias("text")).distinct().select("text", F.try_element_at(known, semantic_key("text")).alias("meaning"))
    joined = pairs.withColumn("text", F.col("o.texts")).join(words, "text", "left")
    per = joined.groupBy(id_).agg(
        F.first("gold").alias("gold"), F.first("n").alias("n"), F.first("d").alias("d"), F.count("meaning").alias("known"),
        F.count_distinct("meaning").alias("kinds"),
        F.collect_list(F.struct(F.col("o.letters").alias("letter"), "meaning")).alias("pairs"),
    )
    hit = F.filter("pairs", lambda p: p["letter"] == F.col("gold")[0])
    error = (
        F.when(F.col("n") != F.col("d"), "duplicate_option")
        .when(F.col("n") != 3, "not_three_options")
        .when(F.col("known") != F.col("n"), "unknown_option_text")
        .when(F.col("kinds") != 3, "not_one_to_one")
        .when((F.size("gold") != 1) | (F.size(hit) != 1), "no_single_gold")
    )
    every = flat.select(id_).join(per, id_, "left")
    error = F.when(F.col("n").isNull(), "not_three_options").otherwise(error)
    return every.select(id_, error.alias("error"), F.when(error.isNull(), F.try_element_at(hit, F.lit(1))["meaning"]).alias("meaning"))


def meaning_coverage(meanings: DataFrame) -> DataFrame:
    """Rows per meaning, or per error where there is none."""
    return meanings.groupBy(F.coalesce("error", F.lit("mapped")).alias("outcome"), F.coalesce("meaning", F.lit("")).alias("meaning")).agg(F.count("*").alias("rows"))


def require_meanings(meanings: DataFrame, id_: str, examples: int = 5) -> None:
    """Raises if any item has no meaning, with the number of such items and some of them."""
    bad = meanings.where("error IS NOT NULL")
    some = bad.orderBy(id_).limit(examples).collect()
    if some:
        raise ValueError(f"{bad.count()} items without a meaning: " + ", ".join(f"{r[id_]} ({r['error']})" for r in some))


def incomplete_bundles(audited: DataFrame, cluster: str = "story", policy: str = "agreement_only") -> DataFrame:
    """Usable items of clusters that are not usable as a whole, with the issue ``incomplete_safe_story_bundle`` added."""
    whole = complete_bundles(audited, cluster, policy).select("public_line")
    rest = usable(audited, policy).join(whole, "public_line", "left_anti")
    return rest.withColumn("issues", F.array_append("issues", F.lit("incomplete_safe_story_bundle")))
