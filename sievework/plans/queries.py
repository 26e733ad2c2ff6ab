"""Registered queries: every operator over the tables it is meant for, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.letters import boxed_answer, letters_az, option_letters
from sievework.functions.messages import evaluation_messages, last_content
from sievework.functions.text import metric_key, story_of
from sievework.functions.values import category, letter_set, reference
from sievework.operators import calibration, clusters, compare, evalgrid, labels, manifest, provenance, quality, sampling, split, training
from sievework.streaming import prediction_log

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Question counts behind the weighted score.
WEIGHTS = {"mentalization": 750, "strategic_social_interaction": 675, "sociocultural_norms": 350}
BASELINE, CANDIDATE = "run_stage_one", "run_stage_two"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _last(spark: SparkSession, sf: str) -> DataFrame:
    return evalgrid.last_success(table(spark, sf, "predictions"))


def _letters(name: str):
    return evalgrid.text_of(F.col(name)).alias(name)


# ---- prediction log and grid


@query
def log_last_success(spark, sf):
    return _last(spark, sf).select("run_id", "seed", "sample_id", "prediction_id", _letters("predicted_letters"))


@query
def streaming_last_success(spark, sf):
    stream = prediction_log.log_stream(spark, f"{sf}/predictions.parquet")
    rows = prediction_log.run_to_table(prediction_log.latest_successes(stream))
    return rows.select("run_id", "seed", "sample_id", "prediction_id", _letters("predicted_letters"))


@query
def streaming_attempt_counts(spark, sf):
    return prediction_log.run_to_table(prediction_log.attempt_counts(prediction_log.log_stream(spark, f"{sf}/predictions.parquet")))


@query
def log_attempt_audit(spark, sf):
    return evalgrid.attempt_audit(table(spark, sf, "predictions"))


@query
def grid_gaps(spark, sf):
    log = table(spark, sf, "predictions")
    grid = evalgrid.expected_grid(table(spark, sf, "public_records"), log).crossJoin(F.broadcast(log.select("run_id").distinct()))
    return evalgrid.grid_gaps(grid, _last(spark, sf), ("run_id", "seed", "sample_id"))


@query
def canonical_rows(spark, sf):
    log = table(spark, sf, "predictions")
    grid = evalgrid.expected_grid(table(spark, sf, "public_records"), log)
    return evalgrid.canonical_rows(log, grid).select("run_id", "seed", "sample_id", "prediction_id", "finish_reason")


@query
def canonical_row_errors(spark, sf):
    log = table(spark, sf, "predictions")
    return evalgrid.row_errors(log, [11, 23, 47])


@query
def metric_grouping_sets(spark, sf):
    return evalgrid.grouped_metrics(_last(spark, sf))


@query
def filled_primary_groups(spark, sf):
    m = evalgrid.grouped_metrics(_last(spark, sf))
    names = [("primary", n) for n in WEIGHTS] + [("qtype", q) for q in ("Q1", "Q2", "Q3", "Q4")]
    out = evalgrid.filled_groups(m, spark.createDataFrame(names, "group_kind string, group_value string"))
    return out.select("run_id", "seed", "group_kind", "group_value", "total", "correct", "accuracy")


@query
def pending_attempts(spark, sf):
    log = table(spark, sf, "predictions")
    grid = evalgrid.expected_grid(table(spark, sf, "public_records"), log).crossJoin(F.broadcast(log.select("run_id").distinct()))
    return prediction_log.pending(grid, log).select("run_id", "seed", "sample_id")


@query
def seed_summary(spark, sf):
    return evalgrid.over_seeds(evalgrid.grouped_metrics(_last(spark, sf)))


@query
def policy_seed_summary(spark, sf):
    return evalgrid.policies_over_seeds(evalgrid.grouped_metrics(_last(spark, sf)))


@query
def dimension_coverage(spark, sf):
    return evalgrid.dimension_coverage(_last(spark, sf))


def _stability(spark, sf):
    return evalgrid.sample_stability(_last(spark, sf), 3)


@query
def sample_stability(spark, sf):
    s = _stability(spark, sf)
    return s.withColumn("majority", evalgrid.text_of(F.col("majority")))


@query
def stability_audit(spark, sf):
    return evalgrid.stability_audit(_stability(spark, sf))


@query
def majority_by_qtype(spark, sf):
    s = _stability(spark, sf).where("complete")
    return s.groupBy("run_id", "qtype").agg(
        F.count("*").alias("samples"), F.count_if("majority_correct").alias("correct"),
        F.count("majority_correct_safe").alias("safe"), F.count_if(F.coalesce("majority_correct_safe", F.lit(False))).alias("safe_correct"),
        F.count("majority_correct_mapped").alias("mapped"), F.count_if(F.coalesce("majority_correct_mapped", F.lit(False))).alias("mapped_correct"),
    )


@query
def artifact_audit(spark, sf):
    return evalgrid.artifact_audit(_last(spark, sf))


@query
def weighted_score(spark, sf):
    return evalgrid.weighted_score(evalgrid.grouped_metrics(_last(spark, sf)), WEIGHTS)


def _pairs(spark, sf):
    last = _last(spark, sf)
    return compare.paired(last.where(F.col("run_id") == BASELINE), last.where(F.col("run_id") == CANDIDATE))


@query
def paired_comparison(spark, sf):
    return compare.comparison(_pairs(spark, sf))


@query
def paired_seed_summary(spark, sf):
    return compare.seed_summary(compare.comparison(_pairs(spark, sf)))


@query
def paired_metadata_differences(spark, sf):
    return _pairs(spark, sf).groupBy("qtype").agg(F.count("*").alias("pairs"), F.count_if("meta_differs").alias("different"))


@query
def protocol_gaps(spark, sf):
    last = _last(spark, sf)
    return compare.protocol_gaps(last.where(F.col("run_id") == BASELINE), last.where((F.col("run_id") == CANDIDATE) & F.col("safe_gold")))


@query
def weighted_comparison(spark, sf):
    return compare.weighted_comparison(compare.comparison(_pairs(spark, sf)), WEIGHTS)


@query
def boxed_answers(spark, sf):
    rows = _last(spark, sf).select("run_id", "prediction_id", "content", "predicted_letters")
    return rows.select("run_id", "prediction_id", evalgrid.text_of(boxed_answer(F.col("content"))).alias("boxed"))


@query
def latency_summary(spark, sf):
    return quality.length_summary(table(spark, sf, "predictions"), "latency_seconds", "run_id", "seed")


@query
def grouped_latency_per_token(spark, sf):
    rows = _last(spark, sf).select(
        "qtype", "dimension", F.col("latency_seconds").alias("loss_sum"), F.try_element_at("usage", F.lit("completion_tokens")).cast("double").alias("token_count")
    )
    out = training.grouped_loss(rows.where("loss_sum IS NOT NULL AND token_count IS NOT NULL"))
    return out.select("kind", "name", F.round("loss", 8).alias("loss"), F.col("tokens").cast("bigint").alias("tokens"))


# ---- chat records


@query
def rejection_reasons(spark, sf):
    return quality.reason_counts(table(spark, sf, "train_records"))


@query
def rejected_records(spark, sf):
    return quality.rejected(table(spark, sf, "train_records")).withColumn("reasons", F.array_join("reasons", ","))


@query
def accepted_records(spark, sf):
    a = quality.accepted(table(spark, sf, "train_records"))
    return a.select("_source_line", "sample_id", F.array_join("gold_letters", ",").alias("gold_letters"), "dimension", "question_type", F.sha2("story", 256).alias("story_sha"), F.col("_pipeline.original_answer_chars").alias("answer_chars"), F.col("_pipeline.original_boxed_count").alias("boxes"))


@query
def cleaned_answers(spark, sf):
    a = quality.accepted(table(spark, sf, "train_records"))
    return a.select("_source_line", F.sha2(last_content(F.col("messages"), "assistant"), 256).alias("answer_sha"), F.col("_pipeline.clean_answer_chars").alias("chars"))


@query
def cleaning_dimensions(spark, sf):
    return quality.judged(table(spark, sf, "train_records")).groupBy("dimension").agg(F.count("*").alias("rows"), F.count_if(F.size("reasons") == 0).alias("accepted"))


@query
def incomplete_story_bundles(spark, sf):
    return labels.incomplete_bundles(labels.audit(table(spark, sf, "public_records"))).select("public_line", F.array_join("issues", ",").alias("issues"))


@query
def release_files(spark, sf):
    docs = table(spark, sf, "documents")
    end = F.when(F.col("lang") == "zh", ".safetensors").when(F.col("lang") == "en", ".safetensors.index.json").otherwise(".txt")
    name = F.when(F.col("doc_kind") == "note", F.lit("tokenizer-")).otherwise("part-")
    return manifest.included(docs.select(F.concat(F.col("doc_kind"), F.lit("/"), name, "doc_id", end).alias("path")), ["config.json"])


@query
def cleaning_audit(spark, sf):
    return quality.cleaning_audit(table(spark, sf, "train_records"))


@query
def chat_validity(spark, sf):
    return quality.chat_errors(table(spark, sf, "train_records"))


@query
def message_fields(spark, sf):
    m = F.col("messages")
    return table(spark, sf, "train_records").select(
        "_source_line", F.size(m).alias("turns"), F.length(last_content(m, "user")).alias("prompt_chars"), F.length(last_content(m, "assistant")).alias("answer_chars"),
        F.length(last_content(m, "system")).alias("system_chars"), F.array_join(letters_az(F.col("gold_letters")), ",").alias("gold"),
    )


@query
def story_extraction(spark, sf):
    prompt = last_content(F.col("messages"), "user")
    return table(spark, sf, "train_records").select("_source_line", F.sha2(story_of(prompt), 256).alias("story_sha"), F.array_join(option_letters(prompt), "").alias("options"))


@query
def answer_length_summary(spark, sf):
    rows = table(spark, sf, "train_records").select("split_name", F.length(last_content(F.col("messages"), "assistant")).alias("chars"))
    return quality.length_summary(rows, "chars", "split_name")


@query
def duplicate_sample_ids(spark, sf):
    return quality.duplicate_audit(table(spark, sf, "train_records"), "sample_id")


@query
def qtype_distribution(spark, sf):
    rows = table(spark, sf, "train_records").withColumn("q", F.coalesce("meta.qtype", F.lit("missing"))).withColumn("source", F.coalesce("source", F.lit("missing")))
    return quality.distribution(rows, F.col("q").alias("question_type"), F.col("source"))


@query
def answer_char_audit(spark, sf):
    rows = table(spark, sf, "train_records").select("split_name", last_content(F.col("messages"), "assistant").alias("answer"))
    return training.token_audit(rows.withColumn("tokens", F.length("answer")), 250, "split_name")


@query
def source_metric_names(spark, sf):
    return table(spark, sf, "documents").groupBy(metric_key(F.col("source")).alias("name")).agg(F.count("*").alias("rows"))


@query
def document_length_summary(spark, sf):
    return quality.length_summary(table(spark, sf, "documents").withColumn("lang", F.coalesce("lang", F.lit("missing"))), "n_chars", "lang")


@query
def record_metadata(spark, sf):
    return provenance.record_metadata(table(spark, sf, "train_records"))


@query
def source_keys(spark, sf):
    r = table(spark, sf, "train_records")
    return r.select("_source_line", provenance.source_key(F.col("sample_id"), F.col("_source_line"), F.struct("meta")).alias("key"))


@query
def sample_id_occurrences(spark, sf):
    return provenance.occurrences(table(spark, sf, "train_records"), "sample_id")


@query
def most_repeated_clusters(spark, sf):
    return provenance.most_repeated(table(spark, sf, "train_records").where("story_cluster_id IS NOT NULL"), "story_cluster_id")


@query
def replay_outside_train(spark, sf):
    records = table(spark, sf, "train_records")
    replay = records.where("split_name <> 'train'").select("_source_line", "sample_id")
    return provenance.outside(replay, records.where("split_name = 'train'"), "sample_id")


def _utf8(role: str, content: str) -> list[int]:
    """The byte tokenizer of the tests: a role byte, the content's bytes, an end."""
    return [{"system": 1, "user": 2, "assistant": 3}.get(role, 4), *content.encode(), 0]


@query
def chat_token_stats(spark, sf):
    rows = table(spark, sf, "train_records").select("split_name", training.chat_tokens("messages", _utf8).alias("t")).select("split_name", "t.*")
    return training.dataset_stats(rows, 1024, "left", "split_name")


# ---- labelled items


@query
def label_status(spark, sf):
    a = labels.audit(table(spark, sf, "public_records"))
    j = lambda c: F.array_join(c, ",").alias(c)
    return a.select("public_line", j("declared"), j("from_text"), F.size("unmapped").alias("unmapped"), F.size("ambiguous").alias("ambiguous"), j("issues"), "status")


@query
def label_status_counts(spark, sf):
    return labels.status_counts(labels.audit(table(spark, sf, "public_records")))


@query
def usable_items(spark, sf):
    a = labels.audit(table(spark, sf, "public_records"))
    one = labels.usable(a).select("public_line", F.lit("agreement_only").alias("policy"), F.array_join("evaluation_letters", ",").alias("letters"))
    two = labels.usable(a, "mapped_answer_text").select("public_line", F.lit("mapped_answer_text").alias("policy"), F.array_join("evaluation_letters", ",").alias("letters"))
    return one.union(two)


@query
def complete_story_bundles(spark, sf):
    return labels.complete_bundles(labels.audit(table(spark, sf, "public_records"))).select("public_line", F.array_join("evaluation_letters", ",").alias("letters"))


@query
def gold_audit(spark, sf):
    g = labels.gold_audit(table(spark, sf, "public_records"))
    return g.select("public_line", evalgrid.text_of(F.col("reported")).alias("reported"), evalgrid.text_of(F.col("mapped")).alias("mapped"), "reason", "safe")


@query
def evaluation_prompts(spark, sf):
    m = evaluation_messages(F.col("task_format"), F.col("story"), F.col("question"), F.col("options"))
    return table(spark, sf, "public_records").select("public_line", F.sha2(m[0]["content"], 256).alias("system_sha"), F.sha2(m[1]["content"], 256).alias("user_sha"))


@query
def yes_no_meanings(spark, sf):
    rows = table(spark, sf, "train_records").where("upper(trim(meta.qtype)) = 'Q3'")
    return labels.yes_no_meaning(rows, last_content(F.col("messages"), "user"), letters_az(F.col("gold_letters")), "_source_line")


# ---- clusters, splits, samples


@query
def story_clusters(spark, sf):
    rows = table(spark, sf, "train_records").withColumn("story", story_of(last_content(F.col("messages"), "user")))
    return clusters.story_clusters(rows, "_source_line", F.col("story"))


@query
def story_cluster_audit(spark, sf):
    rows = table(spark, sf, "train_records").withColumn("story", story_of(last_content(F.col("messages"), "user")))
    return clusters.cluster_audit(rows, "_source_line", F.col("story"))


@query
def public_story_clusters(spark, sf):
    return clusters.story_clusters(table(spark, sf, "public_records"), "public_line", F.col("story"), prefix="public_story")


def _plain_split_rows(spark, sf):
    """The first row of every sample; a row without a sample id is a sample of its own."""
    rows = table(spark, sf, "split_rows")
    key = F.coalesce(reference(F.col("sample_id")), F.concat(F.lit("row-"), "split_row_id"))
    first = rows.groupBy(key.alias("key")).agg(F.min_by(F.struct(*rows.columns), "split_row_id").alias("r"))
    letters = letter_set(F.col("r.gold_letters"))
    return first.select(
        F.col("key").alias("sample_id"), "r.split_row_id", reference(F.col("r.story_cluster_id")).alias("story_cluster_id"),
        F.coalesce(category(F.col("r.dimension")), F.lit("missing")).alias("dimension"), category(F.col("r.question_type")).alias("question_type"),
        F.when(letters.isNull(), F.array().cast("array<string>")).otherwise(F.split(letters, ",")).alias("gold_letters"),
    )


@query
def train_dev_split(spark, sf):
    return split.train_dev_split(_plain_split_rows(spark, sf)).select("split_row_id", "story_cluster_id", "dimension", "split")


@query
def train_dev_leakage(spark, sf):
    return split.leakage(split.train_dev_split(_plain_split_rows(spark, sf)))


@query
def train_dev_facts(spark, sf):
    """One row that holds for every valid split."""
    rows = split.train_dev_split(_plain_split_rows(spark, sf))
    clustered = F.col("story_cluster_id").isNotNull()
    return rows.agg(
        F.count("*").alias("rows"), F.count_distinct("story_cluster_id").alias("clusters"), F.count_if(~clustered).alias("rows_without_cluster"),
        F.count_if(~clustered & (F.col("split") == "dev")).alias("of_them_in_dev"), (F.count_if(F.col("split") == "dev") > 0).alias("has_dev"),
    ).crossJoin(split.leakage(rows).agg(F.count("*").alias("divided_clusters")))


@query
def balanced_sample(spark, sf):
    return sampling.balanced(_plain_split_rows(spark, sf).select("sample_id", "dimension"), "dimension", "sample_id")


def _dim_counts(spark, sf):
    return _plain_split_rows(spark, sf).groupBy(F.col("dimension").alias("key")).agg(F.count("*").alias("n"))


@query
def replay_quota(spark, sf):
    return sampling.replay_quota(_dim_counts(spark, sf), 2087, 42)


@query
def waterfill_quota(spark, sf):
    counts = _dim_counts(spark, sf)
    replay = sampling.replay_quota(counts, 2087, 42).withColumnRenamed("quota", "baseline")
    return sampling.waterfill_quota(counts.join(replay, "key").select("key", (F.col("n") * 2).alias("capacity"), F.lit(0).alias("shared"), "baseline"), 447, 42, "q3")


@query
def bucket_budgets(spark, sf):
    shares = table(spark, sf, "mix_targets").select(F.col("source").alias("key"), (F.col("target_permille") / 1000).alias("share"))
    return sampling.largest_remainder(shares, 2983)


def _meanings(spark, sf):
    """``(sample_id, meaning)``: of a sample's first record whose gold letter has a meaning."""
    records = table(spark, sf, "train_records")
    m = labels.yes_no_meaning(records, last_content(F.col("messages"), "user"), letters_az(F.col("gold_letters")), "_source_line")
    m = records.select("_source_line", reference(F.col("sample_id")).alias("sample_id")).join(m.where("meaning IS NOT NULL"), "_source_line")
    return m.groupBy("sample_id").agg(F.min_by("meaning", "_source_line").alias("meaning"))


def _calibration_rows(spark, sf):
    return _plain_split_rows(spark, sf).join(_meanings(spark, sf), "sample_id", "left")


@query
def calibration_mix(spark, sf):
    return calibration.calibration_mix(_calibration_rows(spark, sf)).drop("letters", "meaning")


@query
def calibration_quotas(spark, sf):
    return calibration.quotas(_calibration_rows(spark, sf))[1]


@query
def calibration_audit(spark, sf):
    return calibration.bucket_audit(calibration.calibration_mix(_calibration_rows(spark, sf)))


@query
def calibration_distribution(spark, sf):
    return calibration.distribution(calibration.calibration_mix(_calibration_rows(spark, sf)))


@query
def yes_no_coverage(spark, sf):
    return labels.meaning_coverage(yes_no_meanings(spark, sf))


@query
def quota_summary(spark, sf):
    return sampling.quota_summary(sampling.replay_quota(_dim_counts(spark, sf), 2087, 42))


# ---- manifests


def _expected(spark, sf):
    docs = table(spark, sf, "documents")
    return manifest.listing(docs.select(F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("path"), "text"), content="text")


def _observed(spark, sf):
    docs = table(spark, sf, "documents").where("lang IS NOT NULL")
    path = F.when(F.col("doc_kind") == "note", F.concat(F.lit("docs/.notes/"), "doc_id")).when(F.col("lang") == "und", F.concat(F.lit("new/"), "doc_id")).otherwise(F.concat(F.lit("docs/"), "doc_id"))
    return manifest.listing(docs.select(F.concat(path, F.lit(".txt")).alias("path"), F.trim("text").alias("text")), content="text")


@query
def manifest_reconcile(spark, sf):
    return manifest.reconciled(_expected(spark, sf), _observed(spark, sf))


@query
def repository_errors(spark, sf):
    docs = table(spark, sf, "documents")
    files = docs.select(F.concat(F.col("doc_kind"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".safetensors")).alias("path"), F.col("n_chars").alias("size"))
    index = docs.where("lang = 'zh'").select(F.concat(F.lit("story/"), F.col("doc_id").cast("string"), F.lit(".safetensors")).alias("path"))
    return manifest.repository_errors(files, index, ["config.json"], "^note/", 1)


@query
def manifest_first_failures(spark, sf):
    return manifest.first_failures(_expected(spark, sf), _observed(spark, sf))
