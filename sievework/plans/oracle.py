"""The registered queries in SQL, over the same whole tables."""

from __future__ import annotations

import unicodedata

from sievework.functions.messages import MULTI_PROMPT, SINGLE_PROMPT
from sievework.functions.values import MISSING
from sievework.operators.labels import MEANINGS
from sievework.plans.queries import BASELINE, CANDIDATE, WEIGHTS

ORACLE: dict[str, str] = {}

LAST = """last AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seed, sample_id ORDER BY prediction_id DESC) AS rn
FROM predictions WHERE error IS NULL) WHERE rn = 1)"""


def _text(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '<unparsed>' ELSE '[' || array_to_string({c}, ',') || ']' END"


def _rate(a: str, b: str) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), 9)"


FINE = "coalesce(nullif(trim(dimension), ''), 'unknown')"
MAIN = "CASE split_part({d}, '.', 1) WHEN '1' THEN 'mentalization' WHEN '2' THEN 'strategic_social_interaction' WHEN '3' THEN 'sociocultural_norms' ELSE 'unknown' END"
SCORED = f"""scored AS (SELECT *, predicted_letters IS NOT NULL AS parsed, coalesce(predicted_letters = gold_letters, false) AS correct,
coalesce(predicted_letters = mapped_letters, false) AS correct_mapped, coalesce(safe_gold, false) AS safe, mapped_letters IS NOT NULL AS mapped,
{FINE} AS fine, {MAIN.format(d=FINE)} AS main FROM last)"""
GROUPED = f"""{LAST}, {SCORED}, grouped AS (
SELECT run_id, seed, 'overall' AS group_kind, 'all' AS group_value, * EXCLUDE (run_id, seed) FROM scored
UNION ALL SELECT run_id, seed, 'qtype', coalesce(qtype, 'unknown'), * EXCLUDE (run_id, seed) FROM scored
UNION ALL SELECT run_id, seed, 'primary', main, * EXCLUDE (run_id, seed) FROM scored WHERE fine <> 'unknown'
UNION ALL SELECT run_id, seed, 'dimension', fine, * EXCLUDE (run_id, seed) FROM scored WHERE fine <> 'unknown'),
metrics AS (SELECT run_id, seed, group_kind, group_value, """ + ", ".join(
    f"count(*) FILTER ({w}) AS {p}total, count(*) FILTER ({w} AND parsed) AS {p}parsed, count(*) FILTER ({w} AND {r}) AS {p}correct, "
    + _rate(f"count(*) FILTER ({w} AND {r})", f"count(*) FILTER ({w})") + f" AS {p}accuracy, "
    + _rate(f"count(*) FILTER ({w} AND parsed)", f"count(*) FILTER ({w})") + f" AS {p}parse_rate"
    for p, w, r in (("", "true", "correct"), ("safe_", "safe", "correct"), ("mapped_", "mapped", "correct_mapped"))
) + " FROM grouped GROUP BY ALL)"

ORACLE["log_last_success"] = ORACLE["streaming_last_success"] = (
    f"WITH {LAST} SELECT run_id, seed, sample_id, prediction_id, {_text('predicted_letters')} AS predicted_letters FROM last"
)
ORACLE["streaming_attempt_counts"] = "SELECT run_id, seed, sample_id, count(*) AS attempts, count(error) AS failures FROM predictions GROUP BY ALL"
ORACLE["log_attempt_audit"] = """WITH k AS (SELECT run_id, seed, sample_id, count(*) AS n, count(*) FILTER (error IS NULL) AS ok FROM predictions GROUP BY ALL)
SELECT run_id, sum(n)::BIGINT AS attempts, sum(ok)::BIGINT AS successes, sum(n - ok)::BIGINT AS failures, count(*) AS keys,
count(*) FILTER (ok > 1) AS duplicate_success_keys, count(*) FILTER (ok = 0) AS unfinished_keys FROM k GROUP BY run_id"""
ORACLE["grid_gaps"] = f"""WITH {LAST}, grid AS (SELECT run_id, seed, sample_id FROM (SELECT DISTINCT sample_id FROM public_records), (SELECT DISTINCT seed FROM predictions), (SELECT DISTINCT run_id FROM predictions)),
have AS (SELECT DISTINCT run_id, seed, sample_id FROM last)
SELECT *, 'missing' AS side FROM (SELECT * FROM grid EXCEPT SELECT * FROM have) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM have EXCEPT SELECT * FROM grid)"""
ORACLE["canonical_rows"] = f"""WITH {LAST} SELECT run_id, seed, sample_id, prediction_id, finish_reason FROM last WHERE sample_id IN (SELECT sample_id FROM public_records)"""
ORACLE["canonical_row_errors"] = """WITH r AS (SELECT prediction_id, run_id, seed, sample_id, CASE WHEN seed IS NULL OR seed NOT IN (11, 23, 47) THEN 'unexpected_seed'
WHEN sample_id IS NULL OR trim(sample_id) = '' THEN 'missing_sample_id' WHEN coalesce(len(list_filter(predicted_letters, lambda x: x IS NULL OR trim(x) = '')), 0) > 0 THEN 'bad_prediction'
WHEN gold_letters IS NULL OR len(gold_letters) = 0 THEN 'missing_gold' WHEN count(*) OVER (PARTITION BY run_id, seed, sample_id) > 1 THEN 'duplicate_key' END AS reason FROM predictions)
SELECT * FROM r WHERE reason IS NOT NULL"""
ORACLE["metric_grouping_sets"] = f"WITH {GROUPED} SELECT * FROM metrics"
_NAMES = " UNION ALL ".join([f"SELECT 'primary' AS group_kind, '{n}' AS group_value" for n in WEIGHTS] + [f"SELECT 'qtype', '{q}'" for q in ("Q1", "Q2", "Q3", "Q4")])
ORACLE["filled_primary_groups"] = f"""WITH {GROUPED}, names AS ({_NAMES}), s AS (SELECT DISTINCT run_id, seed FROM metrics)
SELECT s.run_id, s.seed, n.group_kind, n.group_value, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, accuracy FROM s CROSS JOIN names n LEFT JOIN metrics m
ON m.run_id = s.run_id AND m.seed = s.seed AND m.group_kind = n.group_kind AND m.group_value = n.group_value"""
ORACLE["pending_attempts"] = """SELECT run_id, seed, sample_id FROM (SELECT DISTINCT sample_id FROM public_records), (SELECT DISTINCT seed FROM predictions), (SELECT DISTINCT run_id FROM predictions)
EXCEPT SELECT run_id, seed, sample_id FROM predictions WHERE error IS NULL"""
ORACLE["seed_summary"] = f"""WITH {GROUPED} SELECT run_id, group_kind, group_value, count(*) AS seeds, round(avg(accuracy), 9) AS mean, round(stddev_pop(accuracy), 9) AS std,
min(accuracy) AS min, max(accuracy) AS max FROM metrics GROUP BY ALL"""
ORACLE["dimension_coverage"] = f"""WITH {LAST}, {SCORED} SELECT run_id, count(*) AS total, count(*) FILTER (fine <> 'unknown') AS known, count(*) FILTER (fine = 'unknown') AS unknown,
{_rate("count(*) FILTER (fine <> 'unknown')", 'count(*)')} AS coverage, count(DISTINCT fine) FILTER (fine <> 'unknown') AS fine_dimensions,
array_to_string(list_sort(list(DISTINCT fine) FILTER (fine <> 'unknown')), ',') AS fine_names,
array_to_string(list_sort(list(DISTINCT main) FILTER (fine <> 'unknown')), ',') AS primaries FROM scored GROUP BY run_id"""
STABLE = f"""{LAST}, votes AS (SELECT run_id, sample_id, {_text('predicted_letters')} AS vote, count(*) AS n, any_value(predicted_letters) AS letters FROM last GROUP BY ALL),
meta AS (SELECT run_id, sample_id, arg_min(coalesce(qtype, '<null>'), seed) AS qtype, arg_min({FINE}, seed) AS dimension, arg_min(gold_letters, seed) AS gold,
arg_min_null(mapped_letters, seed) AS mapped, arg_min(coalesce(safe_gold, false), seed) AS safe FROM last GROUP BY ALL),
per AS (SELECT run_id, sample_id, sum(n)::BIGINT AS present, count(*) AS kinds, max(n) AS top, count(*) FILTER (n = m) AS tops, arg_max_null(letters, n) AS winner
FROM (SELECT *, max(n) OVER (PARTITION BY run_id, sample_id) AS m FROM votes) GROUP BY ALL),
stable AS (SELECT p.run_id, p.sample_id, nullif(qtype, '<null>') AS qtype, dimension, present AS seeds_present, present = 3 AS complete, kinds AS unique_predictions, present = 3 AND kinds = 1 AS consistent,
tops > 1 AS tie, CASE WHEN present = 3 AND tops = 1 THEN winner END AS w, gold, mapped, safe FROM per p JOIN meta m ON p.run_id = m.run_id AND p.sample_id = m.sample_id),
out AS (SELECT * EXCLUDE (w, gold, mapped, safe), w AS majority, coalesce(w = gold, false) AS majority_correct, CASE WHEN safe THEN coalesce(w = gold, false) END AS majority_correct_safe,
CASE WHEN mapped IS NOT NULL THEN coalesce(w = mapped, false) END AS majority_correct_mapped FROM stable)"""
ORACLE["sample_stability"] = f"WITH {STABLE} SELECT * REPLACE ({_text('majority')} AS majority) FROM out"
ORACLE["stability_audit"] = f"""WITH {STABLE} SELECT run_id, count(*) AS samples, count(*) FILTER (complete) AS complete, count(*) FILTER (consistent) AS consistent, count(*) FILTER (tie) AS ties,
{_rate('count(*) FILTER (consistent)', 'count(*) FILTER (complete)')} AS consistency_rate, {_rate('count(*) FILTER (complete AND majority_correct)', 'count(*) FILTER (complete)')} AS majority_accuracy FROM out GROUP BY run_id"""
ORACLE["majority_by_qtype"] = f"""WITH {STABLE} SELECT run_id, qtype, count(*) AS samples, count(*) FILTER (majority_correct) AS correct, count(majority_correct_safe) AS safe,
count(*) FILTER (majority_correct_safe) AS safe_correct, count(majority_correct_mapped) AS mapped, count(*) FILTER (majority_correct_mapped) AS mapped_correct FROM out WHERE complete GROUP BY ALL"""
ORACLE["artifact_audit"] = f"""WITH {LAST} SELECT run_id, CASE WHEN finish_reason IS NULL THEN '<missing>' WHEN trim(finish_reason) = '' THEN '<empty>' ELSE trim(finish_reason) END AS reason,
count(*) AS rows, count(*) FILTER (coalesce(len(predicted_letters), 0) = 0) AS without_letters, count(*) FILTER (lower(trim(finish_reason)) = 'length') AS cut_by_length FROM last GROUP BY ALL"""
_W = "CASE group_value " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " END"
_SUM = sum(WEIGHTS.values())
ORACLE["weighted_score"] = f"""WITH {GROUPED} SELECT run_id, seed, count(*) AS groups, round(sum(w) / {_SUM}.0, 9)::DOUBLE AS covered_weight, CASE WHEN count(*) = {len(WEIGHTS)} THEN round(sum(accuracy * w) / {_SUM}, 9) END AS score
FROM (SELECT *, {_W} AS w FROM metrics WHERE group_kind = 'primary') WHERE w IS NOT NULL AND accuracy IS NOT NULL GROUP BY ALL"""
_SIDE = "SELECT seed, sample_id, predicted_letters AS l, coalesce(predicted_letters = gold_letters, false) AS ok, predicted_letters IS NOT NULL AS parsed, lower(trim(coalesce(finish_reason, ''))) = 'length' AS cut, qtype, dimension, gold_letters, mapped_letters, safe_gold, gold_audit_reason FROM last WHERE run_id = '{}'"
PAIRS = f"""{LAST}, b AS ({_SIDE.format(BASELINE)}), c AS ({_SIDE.format(CANDIDATE)}), pairs AS (SELECT b.seed, b.sample_id, b.ok AS bo, c.ok AS co, b.parsed AS bp, c.parsed AS cp, b.cut AS bc, c.cut AS cc,
b.l IS DISTINCT FROM c.l AS changed, (b.qtype IS DISTINCT FROM c.qtype OR b.dimension IS DISTINCT FROM c.dimension OR b.gold_letters IS DISTINCT FROM c.gold_letters OR b.mapped_letters IS DISTINCT FROM c.mapped_letters
OR b.safe_gold IS DISTINCT FROM c.safe_gold OR b.gold_audit_reason IS DISTINCT FROM c.gold_audit_reason) AS differs, coalesce(b.qtype, 'unknown') AS qtype,
{MAIN.format(d="coalesce(nullif(trim(b.dimension), ''), 'unknown')")} AS main FROM b JOIN c ON b.seed = c.seed AND b.sample_id = c.sample_id),
g AS (SELECT *, 'overall' AS group_kind, 'all' AS group_value FROM pairs UNION ALL SELECT *, 'qtype', qtype FROM pairs UNION ALL SELECT *, 'primary', main FROM pairs),
compared AS (SELECT group_kind, group_value, seed, count(*) AS total, count(*) FILTER (NOT bo AND co) AS wins, count(*) FILTER (bo AND NOT co) AS losses, count(*) FILTER (bo AND co) AS both_correct, count(*) FILTER (NOT bo AND NOT co) AS both_wrong,
count(*) FILTER (NOT bo AND co) - count(*) FILTER (bo AND NOT co) AS net, count(*) FILTER (bo <> co) AS discordant, {_rate('count(*) FILTER (NOT bo AND co)', 'count(*) FILTER (bo <> co)')} AS win_rate,
{_rate('count(*) FILTER (bo)', 'count(*)')} AS baseline_accuracy, {_rate('count(*) FILTER (co)', 'count(*)')} AS candidate_accuracy, count(*) FILTER (NOT bp AND cp) AS newly_parsed, count(*) FILTER (bp AND NOT cp) AS newly_unparsed,
count(*) FILTER (NOT bc AND cc) AS newly_cut, count(*) FILTER (bc AND NOT cc) AS no_longer_cut, count(*) FILTER (changed) AS changed FROM g GROUP BY GROUPING SETS ((group_kind, group_value, seed), (group_kind, group_value)))"""
ORACLE["paired_comparison"] = f"WITH {PAIRS} SELECT * FROM compared"
ORACLE["paired_seed_summary"] = f"""WITH {PAIRS} SELECT group_kind, group_value, count(*) AS seeds, round(avg(candidate_accuracy - baseline_accuracy), 8) AS delta_mean, round(stddev_pop(candidate_accuracy - baseline_accuracy), 8) AS delta_std,
round(avg(wins / total), 8) AS win_share, round(avg(losses / total), 8) AS loss_share FROM compared WHERE seed IS NOT NULL GROUP BY ALL"""
ORACLE["paired_metadata_differences"] = f"WITH {PAIRS} SELECT qtype, count(*) AS pairs, count(*) FILTER (differs) AS different FROM pairs GROUP BY qtype"
ORACLE["protocol_gaps"] = f"""WITH {LAST}, f AS (SELECT DISTINCT run_id, 'seed' AS fact, CAST(seed AS VARCHAR) AS value FROM last UNION SELECT DISTINCT run_id, 'sample_id', sample_id FROM last),
a AS (SELECT fact, value FROM f WHERE run_id = '{BASELINE}'), 
s AS (SELECT * FROM last WHERE run_id = '{CANDIDATE}' AND safe_gold), b AS (SELECT 'seed' AS fact, CAST(seed AS VARCHAR) AS value FROM s UNION SELECT 'sample_id', sample_id FROM s)
SELECT *, 'baseline' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'candidate' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""
ORACLE["latency_summary"] = """SELECT run_id, seed, count(latency_seconds) AS count, min(latency_seconds) AS min, median(latency_seconds) AS median, quantile_disc(latency_seconds, 0.95) AS p95,
quantile_disc(latency_seconds, 0.99) AS p99, max(latency_seconds) AS max FROM predictions GROUP BY ALL"""
ORACLE["grouped_latency_per_token"] = f"""WITH {LAST}, r AS (SELECT coalesce(nullif(trim(qtype), ''), 'unknown') AS q, {FINE} AS d, latency_seconds AS l, CAST(usage['completion_tokens'] AS DOUBLE) AS t FROM last),
k AS (SELECT * FROM r WHERE l IS NOT NULL AND t IS NOT NULL), g AS (SELECT 'overall' AS kind, 'all' AS name, l, t FROM k UNION ALL SELECT 'qtype', q, l, t FROM k UNION ALL SELECT 'dimension', d, l, t FROM k),
p AS (SELECT kind, name, sum(l) / sum(t) AS loss, sum(t) AS tokens FROM g GROUP BY ALL HAVING sum(t) > 0)
SELECT kind, name, round(loss, 8) AS loss, tokens::BIGINT AS tokens FROM p UNION ALL SELECT 'macro_' || kind, 'all', round(avg(loss), 8), sum(tokens)::BIGINT FROM p WHERE kind <> 'overall' GROUP BY kind"""

# ---- chat records


def _of(role: str) -> str:
    return f"coalesce(list_filter(messages, lambda m: m.role = '{role}')[-1].content, '')"


def _az(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(coalesce({c}, []), lambda x: upper(trim(x))), lambda x: regexp_full_match(x, '[A-Z]'))))"


_STORY_RE = r"(?s)(?:^|\n)\s*故事\s*[：:]\s*(.*?)\n\s*问题\s*[：:]"
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_HEAD = "CASE WHEN contains(prompt, '问题：') THEN split_part(prompt, '问题：', 1) ELSE prompt END"
_REST = f"CASE WHEN instr({_HEAD}, '故事：') > 0 THEN left({_HEAD}, CAST(instr({_HEAD}, '故事：') - 1 AS BIGINT)) || substr({_HEAD}, CAST(instr({_HEAD}, '故事：') + 3 AS BIGINT)) ELSE {_HEAD} END"
_SECTION = "CASE WHEN contains(prompt, '选项：') THEN string_split(prompt, '选项：')[-1] WHEN contains(prompt, '选项:') THEN string_split(prompt, '选项:')[-1] ELSE '' END"
FIELDS = f"""f0 AS (SELECT *, {_of('user')} AS prompt, {_of('assistant')} AS answer, {_az('gold_letters')} AS gold, {_az('pred_letters')} AS pred, trim(coalesce(meta.dim, '')) AS dimension,
upper(trim(coalesce(meta.qtype, ''))) AS question_type FROM train_records),
f1 AS (SELECT *, CASE WHEN regexp_matches(prompt, '{_STORY_RE}') THEN {_STRIP.format(f"regexp_extract(prompt, '{_STORY_RE}', 1)")} WHEN contains(prompt, '问题：') THEN {_STRIP.format(_REST)} ELSE '' END AS story,
list_sort(list_distinct(regexp_extract_all({_SECTION}, '(?m)^\\s*([A-Z])\\s*[.．、)]\\s*', 1))) AS opts FROM f0),
f2 AS (SELECT *, list_filter([CASE WHEN coalesce(len(messages), 0) = 0 OR prompt = '' OR answer = '' THEN 'invalid_or_missing_chat' END, CASE WHEN story = '' THEN 'story_extraction_failed' END, CASE WHEN dimension = '' THEN 'missing_dimension' END,
CASE WHEN question_type = 'Q2' AND (list_contains(opts, 'F') OR len(opts) > 5) THEN 'legacy_q2_six_options' END, CASE WHEN len(gold) = 0 THEN 'missing_gold_letters' END,
CASE WHEN len(gold) > 0 AND len(opts) > 0 AND NOT list_has_all(opts, gold) THEN 'gold_outside_options' END, CASE WHEN len(pred) > 0 AND pred <> gold THEN 'gold_pred_mismatch' END], lambda x: x IS NOT NULL) AS reasons FROM f1)"""
ORACLE["rejection_reasons"] = f"WITH {FIELDS} SELECT reason, count(*) AS rows FROM (SELECT unnest(reasons) AS reason FROM f2) GROUP BY reason"
ORACLE["rejected_records"] = f"WITH {FIELDS} SELECT _source_line, sample_id, array_to_string(list_sort(reasons), ',') AS reasons FROM f2 WHERE len(reasons) > 0"
ORACLE["cleaning_audit"] = rf"""WITH {FIELDS} SELECT question_type, count(*) AS rows, count(*) FILTER (len(reasons) = 0) AS accepted, count(*) FILTER (len(pred) > 0 AND pred <> gold) AS letter_mismatches,
sum(len(regexp_extract_all(answer, '(?i)\\boxed\s*\{{[^{{}}]*\}}')))::BIGINT AS boxes, count(DISTINCT dimension) FILTER (len(reasons) = 0) AS accepted_dimensions, sum(len(opts))::BIGINT AS options FROM f2 GROUP BY question_type"""
ORACLE["message_fields"] = f"""SELECT _source_line, len(messages) AS turns, length({_of('user')}) AS prompt_chars, length({_of('assistant')}) AS answer_chars, length({_of('system')}) AS system_chars,
array_to_string({_az('gold_letters')}, ',') AS gold FROM train_records"""
ORACLE["story_extraction"] = f"WITH {FIELDS} SELECT _source_line, sha256(story) AS story_sha, array_to_string(opts, '') AS options FROM f1"
_BLANK = r"m.content IS NULL OR regexp_full_match(m.content, '[\s\p{Z}]*')"
ORACLE["chat_validity"] = f"""SELECT CASE WHEN coalesce(len(messages), 0) = 0 THEN 'no_messages' WHEN len(list_filter(messages, lambda m: m.role NOT IN ('system', 'user', 'assistant') OR m.role IS NULL)) > 0 THEN 'unknown_role'
WHEN len(list_filter(messages, lambda m: {_BLANK})) > 0 THEN 'blank_content' WHEN len(list_filter(messages, lambda m: m.role = 'assistant')) = 0 THEN 'no_assistant' WHEN messages[-1].role <> 'assistant' THEN 'last_not_assistant' ELSE 'ok' END AS reason,
count(*) AS rows FROM train_records GROUP BY ALL"""
ORACLE["answer_length_summary"] = f"""WITH r AS (SELECT split_name, length({_of('assistant')}) AS n FROM train_records) SELECT split_name, count(n) AS count, min(n)::DOUBLE AS min, median(n) AS median,
quantile_disc(n, 0.95)::DOUBLE AS p95, quantile_disc(n, 0.99)::DOUBLE AS p99, max(n)::DOUBLE AS max FROM r GROUP BY split_name"""
ORACLE["duplicate_sample_ids"] = """WITH k AS (SELECT sample_id, count(*) AS n FROM train_records WHERE sample_id IS NOT NULL GROUP BY 1)
SELECT count(*) AS distinct_values, count(*) FILTER (n > 1) AS repeated_values, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS rows_in_repeats FROM k"""
ORACLE["qtype_distribution"] = "SELECT coalesce(meta.qtype, 'missing') AS question_type, coalesce(source, 'missing') AS source, count(*) AS rows FROM train_records GROUP BY ALL"
ORACLE["answer_char_audit"] = f"""WITH r AS (SELECT split_name, {_of('assistant')} AS a FROM train_records) SELECT split_name, count(*) AS rows, quantile_disc(length(a), 0.5) AS p50, quantile_disc(length(a), 0.95) AS p95, quantile_disc(length(a), 0.99) AS p99,
max(length(a)) AS max, count(*) FILTER (length(a) > 250) AS overlength, count(*) FILTER (NOT contains(a, '</think>')) AS without_think_end, count(*) FILTER (NOT contains(a, '\\boxed{{')) AS without_box FROM r GROUP BY split_name""".replace("\\\\", "\\")
ORACLE["source_metric_names"] = """SELECT CASE WHEN k = '' THEN 'unknown' ELSE k END AS name, count(*) AS rows FROM (SELECT trim(regexp_replace(coalesce(source, ''), '[^0-9A-Za-z_.-]+', '_', 'g'), '_') AS k FROM documents) GROUP BY ALL"""
ORACLE["document_length_summary"] = """SELECT coalesce(lang, 'missing') AS lang, count(n_chars) AS count, min(n_chars)::DOUBLE AS min, median(n_chars) AS median, quantile_disc(n_chars, 0.95)::DOUBLE AS p95, quantile_disc(n_chars, 0.99)::DOUBLE AS p99,
max(n_chars)::DOUBLE AS max FROM documents GROUP BY ALL"""

_ROWNAME = "'row-' || lpad(CAST(_source_line AS VARCHAR), CAST(greatest(6, length(CAST(_source_line AS VARCHAR))) AS INTEGER), '0')"
ORACLE["record_metadata"] = f"""SELECT _source_line, coalesce(nullif(trim(sample_id), ''), {_ROWNAME}) AS sample_id, upper(coalesce(nullif(trim(meta.qtype), ''), 'unknown')) AS qtype,
coalesce(nullif(trim(meta.dim), ''), 'unknown') AS dimension FROM train_records"""
ORACLE["source_keys"] = "SELECT _source_line, concat_ws('|', 'sample_id:' || nullif(trim(sample_id), ''), 'source_line:' || _source_line) AS key FROM train_records"
ORACLE["sample_id_occurrences"] = "SELECT times, count(*) AS keys FROM (SELECT sample_id, count(*) AS times FROM train_records GROUP BY 1) GROUP BY 1"
ORACLE["most_repeated_clusters"] = "SELECT story_cluster_id, count(*) AS times FROM train_records WHERE story_cluster_id IS NOT NULL GROUP BY 1 ORDER BY times DESC, story_cluster_id LIMIT 20"
ORACLE["replay_outside_train"] = """SELECT sample_id, _source_line FROM train_records r WHERE split_name <> 'train' AND NOT EXISTS (SELECT 1 FROM train_records t WHERE t.split_name = 'train' AND t.sample_id = r.sample_id)"""
ORACLE["chat_token_stats"] = """WITH m AS (SELECT split_name, _source_line, unnest(messages, max_depth := 1) AS m FROM train_records), n AS (SELECT split_name, _source_line, m.role AS role, 2 + octet_length(encode(coalesce(m.content, ''))) AS n,
row_number() OVER (PARTITION BY _source_line) AS pos FROM m), t AS (SELECT split_name, _source_line, role, n, sum(n) OVER (PARTITION BY _source_line ORDER BY pos) AS e, sum(n) OVER (PARTITION BY _source_line) AS total FROM n),
r AS (SELECT split_name, _source_line, max(total) AS total, sum(CASE WHEN role = 'assistant' THEN greatest(0, e - greatest(e - n, total - 1024)) ELSE 0 END) AS trainable FROM t GROUP BY ALL)
SELECT split_name, count(*) AS rows, count(*) FILTER (trainable > 0) AS kept, count(*) FILTER (trainable = 0) AS dropped, max(least(total, 1024))::BIGINT AS longest, sum(trainable)::BIGINT AS trainable FROM r GROUP BY split_name"""

# ---- labelled items


def _mapped(key: str) -> str:
    """Letters that answer texts map to under a normal form ``key`` (a format of x)."""
    return f"""o AS (SELECT public_line, {key.format(x='e.value')} AS k, list_sort(list_distinct(list(upper(e.key)))) AS cand FROM (SELECT public_line, unnest(map_entries(options)) AS e FROM public_records) GROUP BY ALL),
a AS (SELECT public_line, {key.format(x='t')} AS k FROM (SELECT public_line, unnest(correct_answers) AS t FROM public_records)),
m AS (SELECT a.public_line, list_sort(list_distinct(list(cand[1]) FILTER (len(cand) = 1))) AS from_text, count(*) FILTER (cand IS NULL) AS unmapped, count(*) FILTER (len(cand) > 1) AS ambiguous FROM a LEFT JOIN o ON a.public_line = o.public_line AND a.k = o.k GROUP BY ALL)"""


_WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)])
_THIN = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)
_STORY_KEY = r"regexp_replace(lower(translate({x}, '%s', '%s')), '[^\p{{L}}\p{{N}}]', '', 'g')" % (_WIDE, _THIN)
AUDIT = f"""{_mapped(_STORY_KEY)}, r AS (SELECT p.*, {_az('correct_letters')} AS declared, coalesce(from_text, []) AS ft, coalesce(unmapped, 0) AS um, coalesce(ambiguous, 0) AS am, coalesce(len(correct_answers), 0) AS na FROM public_records p LEFT JOIN m ON p.public_line = m.public_line),
audited AS (SELECT *, list_filter([CASE WHEN len(declared) = 0 THEN 'missing_declared_letters' END, CASE WHEN na = 0 THEN 'missing_answer_texts' END, CASE WHEN um > 0 THEN 'unmapped_answer_text' END, CASE WHEN am > 0 THEN 'ambiguous_answer_text' END,
CASE WHEN declared <> ft THEN 'letters_answers_conflict' END, CASE WHEN task_format = 'mcq_single' AND greatest(len(declared), len(ft)) > 1 THEN 'single_format_with_multiple_answers' END], lambda x: x IS NOT NULL) AS issues,
CASE WHEN len(declared) = 0 OR na = 0 THEN 'missing' WHEN um > 0 THEN 'unmapped' WHEN am > 0 THEN 'ambiguous' WHEN declared <> ft THEN 'conflict' ELSE 'agree' END AS status FROM r)"""
ORACLE["label_status"] = f"""WITH {AUDIT} SELECT public_line, array_to_string(declared, ',') AS declared, array_to_string(ft, ',') AS from_text, um AS unmapped, am AS ambiguous, array_to_string(issues, ',') AS issues, status FROM audited"""
ORACLE["label_status_counts"] = f"""WITH {AUDIT} SELECT 'status' AS kind, status AS value, count(*) AS rows FROM audited GROUP BY ALL UNION ALL SELECT 'issue', i, count(*) FROM (SELECT unnest(issues) AS i FROM audited) GROUP BY ALL"""
_CLEAN = "NOT list_contains(issues, 'single_format_with_multiple_answers')"
ORACLE["usable_items"] = f"""WITH {AUDIT} SELECT public_line, 'agreement_only' AS policy, array_to_string(declared, ',') AS letters FROM audited WHERE status = 'agree' AND {_CLEAN}
UNION ALL SELECT public_line, 'mapped_answer_text', array_to_string(ft, ',') FROM audited WHERE status IN ('agree', 'conflict') AND {_CLEAN}"""
ORACLE["complete_story_bundles"] = f"""WITH {AUDIT}, u AS (SELECT *, status = 'agree' AND {_CLEAN} AS ok FROM audited), c AS (SELECT story FROM u GROUP BY story HAVING bool_and(ok))
SELECT public_line, array_to_string(declared, ',') AS letters FROM u WHERE story IN (SELECT story FROM c)"""
_OPTION_KEY = r"regexp_replace(translate(regexp_replace({x}, '[\s\p{{Z}}]+', '', 'g'), '“”‘’：', '""' || chr(39) || chr(39) || ':'), '^[。.;； ]+|[。.;； ]+$', '', 'g')"
ORACLE["gold_audit"] = f"""WITH {_mapped(_OPTION_KEY)}, r AS (SELECT p.*, list_filter({_az('correct_letters')}, lambda x: x <= 'F') AS reported, CASE WHEN um.unmapped + um.ambiguous = 0 THEN list_filter(um.from_text, lambda x: x <= 'F') END AS strict FROM public_records p LEFT JOIN m um ON p.public_line = um.public_line),
s AS (SELECT *, CASE WHEN options IS NULL OR correct_answers IS NULL THEN 'answer_text_not_provided' WHEN strict IS NULL THEN 'answer_text_unmapped' WHEN strict <> reported THEN 'letter_text_conflict'
WHEN lower(task_format) = 'mcq_single' AND len(reported) <> 1 THEN 'single_format_with_multiple_answers' ELSE 'letter_text_agree' END AS reason FROM r)
SELECT public_line, {_text('reported')} AS reported, {_text('strict')} AS mapped, reason, reason = 'letter_text_agree' AS safe FROM s"""
_OUTER = "[。.!！?？:：;；,，()（）\\\\[\\\\]【】]".replace("\\\\", "\\")
_OPT = r"(?m)^\s*([A-Z])\s*[.．、)]\s*(.*?)\s*$"
_MEANING = "CASE regexp_replace(regexp_replace(t, '[\\s\\p{Z}]+', '', 'g'), '^" + _OUTER + "+|" + _OUTER + "+$', '', 'g') " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MEANINGS.items()) + " END"
ORACLE["yes_no_meanings"] = f"""WITH {FIELDS}, q AS (SELECT _source_line, gold, CASE WHEN {_SECTION} = '' THEN prompt ELSE {_SECTION} END AS section FROM f1 WHERE upper(trim(meta.qtype)) = 'Q3'),
o AS (SELECT _source_line, gold, regexp_extract_all(section, '{_OPT}', 1) AS ls, list_transform(regexp_extract_all(section, '{_OPT}', 2), lambda t: {_MEANING}) AS ms FROM q),
e AS (SELECT *, CASE WHEN len(ls) = 0 THEN 'not_three_options' WHEN len(ls) <> len(list_distinct(ls)) THEN 'duplicate_option' WHEN len(ls) <> 3 THEN 'not_three_options' WHEN len(list_filter(ms, lambda m: m IS NOT NULL)) <> len(ls) THEN 'unknown_option_text'
WHEN len(list_distinct(ms)) <> 3 THEN 'not_one_to_one' WHEN len(gold) <> 1 OR NOT list_contains(ls, gold[1]) THEN 'no_single_gold' END AS error FROM o)
SELECT _source_line, error, CASE WHEN error IS NULL THEN ms[list_position(ls, gold[1])] END AS meaning FROM e"""
_LINES = "array_to_string(list_transform(list_sort(list_transform(map_entries(options), lambda e: {'l': upper(e.key), 't': e.value})), lambda e: e.l || '. ' || e.t), chr(10))"
ORACLE["evaluation_prompts"] = f"""SELECT public_line, sha256(CASE WHEN lower(coalesce(task_format, '')) = 'mcq_single' THEN '{SINGLE_PROMPT}' ELSE '{MULTI_PROMPT}' END) AS system_sha,
sha256('请根据下面的故事回答问题。' || chr(10) || chr(10) || '故事：' || chr(10) || story || chr(10) || chr(10) || '问题：' || chr(10) || question || chr(10) || chr(10) || '选项：' || chr(10) || {_LINES}) AS user_sha FROM public_records"""

# ---- samples and manifests

_W2 = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_N2 = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
_FILL = ", ".join(f"'{m}'" for m in MISSING)
_EDGE = r"^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$"


def _category(x: str) -> str:
    v = f"regexp_replace(translate({x}, '{_W2}', '{_N2}'), '{_EDGE}', '', 'g')"
    return f"CASE WHEN lower({v}) NOT IN ({_FILL}) THEN upper({v}) END"


def _reference(x: str) -> str:
    v = f"lower(regexp_replace({x}, '{_EDGE}', '', 'g'))"
    return f"CASE WHEN {v} NOT IN ({_FILL}) AND NOT regexp_full_match({v}, '([a-z]+[_/:-])?0+') THEN {v} END"


def _letter_list(x: str) -> str:
    each = f"upper(regexp_replace(translate(v, '{_W2}', '{_N2}'), '{_EDGE}', '', 'g'))"
    return f"list_sort(list_distinct(list_filter(list_transform(coalesce({x}, []), lambda v: {each}), lambda v: regexp_full_match(v, '[A-Z]'))))"


ROWS = f"""keyed AS (SELECT * EXCLUDE (sample_id), coalesce({_reference('sample_id')}, 'row-' || split_row_id) AS sample_id FROM split_rows),
firsts AS (SELECT sample_id, {_reference('story_cluster_id')} AS cluster, coalesce({_category('dimension')}, 'missing') AS dimension, {_category('question_type')} AS question_type, {_letter_list('gold_letters')} AS gold
FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY split_row_id) AS rn FROM keyed) WHERE rn = 1),
dims AS (SELECT dimension AS key, count(*) AS n FROM firsts GROUP BY 1)"""
ORACLE["balanced_sample"] = f"""WITH {ROWS}, t AS (SELECT greatest(1, round_even(median(n), 0))::BIGINT AS target FROM dims),
r AS (SELECT f.*, n, target, row_number() OVER (PARTITION BY dimension ORDER BY sha256('42:' || dimension || ':' || sample_id)) - 1 AS r FROM firsts f JOIN dims d ON f.dimension = d.key, t),
u AS (SELECT *, unnest(generate_series(0, CAST(ceil((target - r) / n) AS BIGINT) - 1)) AS occurrence FROM r WHERE r < target)
SELECT dimension, sample_id, occurrence, left(sha256(dimension || ':' || sample_id || ':' || occurrence), 20) AS instance_id FROM u"""
ORACLE["replay_quota"] = f"""WITH {ROWS}, k AS (SELECT key, count(*) OVER () AS m, row_number() OVER (ORDER BY sha256('42:dimension-remainder:' || key)) AS r FROM dims)
SELECT key, 2087 // m + CASE WHEN r <= 2087 - (2087 // m) * m THEN 1 ELSE 0 END AS quota FROM k"""
ORACLE["quota_summary"] = f"""WITH {ROWS}, k AS (SELECT key, count(*) OVER () AS m, row_number() OVER (ORDER BY sha256('42:dimension-remainder:' || key)) AS r FROM dims),
q AS (SELECT 2087 // m + CASE WHEN r <= 2087 - (2087 // m) * m THEN 1 ELSE 0 END AS quota FROM k) SELECT count(*) AS groups, sum(quota)::BIGINT AS rows, min(quota) AS min, max(quota) AS max, max(quota) - min(quota) AS spread FROM q"""
ORACLE["waterfill_quota"] = f"""WITH {ROWS}, k AS (SELECT key, count(*) OVER () AS m, row_number() OVER (ORDER BY sha256('42:dimension-remainder:' || key)) AS r FROM dims),
c AS (SELECT dims.key, n * 2 AS capacity, 2087 // m + CASE WHEN r <= 2087 - (2087 // m) * m THEN 1 ELSE 0 END AS baseline, sha256('42:dimension-waterfill:q3:' || dims.key) AS h FROM dims JOIN k USING (key)),
u AS (SELECT key, baseline, h, unnest(generate_series(0, least(capacity, 447) - 1)) AS k FROM c), t AS (SELECT * FROM u ORDER BY k, baseline + k, h LIMIT 447)
SELECT c.key, count(t.key) AS quota FROM c LEFT JOIN t ON c.key = t.key GROUP BY c.key"""
ORACLE["bucket_budgets"] = """WITH e AS (SELECT source AS key, target_permille / 1000 * 2983 AS x FROM mix_targets), b AS (SELECT key, floor(x)::BIGINT AS base, round(x - floor(x), 9) AS f FROM e)
SELECT key, base + CASE WHEN row_number() OVER (ORDER BY f DESC, key) <= 2983 - sum(base) OVER () THEN 1 ELSE 0 END AS budget FROM b"""
_FILES = """e AS (SELECT 'docs/' || doc_id || '.txt' AS path, octet_length(encode(text)) AS size, sha256(text) AS sha FROM documents),
o AS (SELECT CASE WHEN doc_kind = 'note' THEN 'docs/.notes/' || doc_id WHEN lang = 'und' THEN 'new/' || doc_id ELSE 'docs/' || doc_id END || '.txt' AS path, octet_length(encode(trim(text))) AS size, sha256(trim(text)) AS sha FROM documents WHERE lang IS NOT NULL),
j AS (SELECT coalesce(e.path, o.path) AS path, e.path AS ep, o.path AS op, e.size AS es, o.size AS os, e.sha AS eh, o.sha AS oh FROM e FULL OUTER JOIN o ON e.path = o.path),
x AS (SELECT path, 'missing' AS error, 0 AS r FROM j WHERE op IS NULL UNION ALL SELECT path, 'size', 1 FROM j WHERE ep IS NOT NULL AND op IS NOT NULL AND es IS DISTINCT FROM os UNION ALL SELECT path, 'sha256', 2 FROM j WHERE ep IS NOT NULL AND op IS NOT NULL AND eh IS DISTINCT FROM oh
UNION ALL SELECT path, 'unexpected', 3 FROM j WHERE ep IS NULL AND NOT regexp_matches(path, '(^|/)\\.'))""".replace("\\\\", "\\")
ORACLE["manifest_reconcile"] = f"WITH {_FILES} SELECT path, error FROM x"
ORACLE["manifest_first_failures"] = f"WITH {_FILES} SELECT path, arg_min(error, r) AS error FROM x WHERE error <> 'unexpected' GROUP BY path"
ORACLE["repository_errors"] = """WITH f AS (SELECT doc_kind || '/' || doc_id || '.safetensors' AS path FROM documents), i AS (SELECT 'story/' || doc_id || '.safetensors' AS path FROM documents WHERE lang = 'zh')
SELECT 'config.json' AS path, 'required_missing' AS error UNION ALL SELECT path, 'forbidden' FROM f WHERE path LIKE 'note/%' UNION ALL SELECT path, 'shard_missing' FROM (SELECT path FROM i EXCEPT SELECT path FROM f)
UNION ALL SELECT path, 'not_in_index' FROM (SELECT path FROM f EXCEPT SELECT path FROM i)"""

ORACLE["train_dev_facts"] = f"""WITH {ROWS} SELECT count(*) AS rows, count(DISTINCT cluster) AS clusters, count(*) FILTER (cluster IS NULL) AS rows_without_cluster, 0 AS of_them_in_dev, true AS has_dev, 0 AS divided_clusters FROM firsts"""
ORACLE["train_dev_leakage"] = "SELECT CAST(NULL AS VARCHAR) AS story_cluster_id, CAST(0 AS BIGINT) AS splits WHERE false"
ORACLE["policy_seed_summary"] = "WITH " + GROUPED + ", x AS (" + " UNION ALL ".join(
    f"SELECT run_id, group_kind, group_value, '{policy}' AS policy, '{rate}' AS rate, {prefix}{rate} AS v FROM metrics" for policy, prefix in (("reported", ""), ("safe", "safe_"), ("mapped", "mapped_")) for rate in ("accuracy", "parse_rate")
) + ") SELECT run_id, group_kind, group_value, policy, rate, count(*) AS seeds, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, min(v) AS min, max(v) AS max FROM x GROUP BY ALL"
_W = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())
ORACLE["weighted_comparison"] = f"""WITH {PAIRS}, w AS (SELECT seed, baseline_accuracy * (CASE group_value {_W} END) / {sum(WEIGHTS.values())} AS b, candidate_accuracy * (CASE group_value {_W} END) / {sum(WEIGHTS.values())} AS c
FROM compared WHERE seed IS NOT NULL AND group_kind = 'primary' AND total > 0 AND group_value IN ({", ".join(f"'{k}'" for k in WEIGHTS)})), s AS (SELECT seed, count(*) AS groups, sum(b) AS b, sum(c) AS c FROM w GROUP BY seed)
SELECT seed, groups, groups = {len(WEIGHTS)} AS complete, CASE WHEN groups = {len(WEIGHTS)} THEN round(b, 8) END AS baseline_score, CASE WHEN groups = {len(WEIGHTS)} THEN round(c, 8) END AS candidate_score,
CASE WHEN groups = {len(WEIGHTS)} THEN round(c - b, 8) END AS delta FROM s"""
ORACLE["accepted_records"] = f"""WITH {FIELDS} SELECT _source_line, sample_id, array_to_string(gold, ',') AS gold_letters, dimension, question_type, sha256(story) AS story_sha, length(answer) AS answer_chars,
len(regexp_extract_all(answer, '(?i)\\\\boxed\\s*\\{{[^{{}}]*\\}}')) AS boxes FROM f2 WHERE len(reasons) = 0"""
ORACLE["cleaning_dimensions"] = f"WITH {FIELDS} SELECT dimension, count(*) AS rows, count(*) FILTER (len(reasons) = 0) AS accepted FROM f2 GROUP BY dimension"
ORACLE["yes_no_coverage"] = f"SELECT coalesce(error, 'mapped') AS outcome, coalesce(meaning, '') AS meaning, count(*) AS rows FROM ({ORACLE['yes_no_meanings']}) GROUP BY ALL"
ORACLE["release_files"] = """WITH f AS (SELECT doc_kind || '/' || CASE WHEN doc_kind = 'note' THEN 'tokenizer-' ELSE 'part-' END || doc_id || CASE lang WHEN 'zh' THEN '.safetensors' WHEN 'en' THEN '.safetensors.index.json' ELSE '.txt' END AS path FROM documents)
SELECT path FROM f WHERE path LIKE '%.safetensors' OR path LIKE '%.safetensors.index.json' OR path LIKE '%/tokenizer%'"""

#: Compatibility forms of single characters, for SQL engines without NFKC; the table is built from Unicode data.
_FORMS = {
    chr(c): f
    for c in range(0xA0, 0x10000)
    if not 0xD800 <= c < 0xE000 and len(f := unicodedata.normalize("NFKC", chr(c))) == 1 and f != chr(c) and f.isalnum()
}


ORACLE["incomplete_story_bundles"] = f"""SELECT public_line, 'incomplete_safe_story_bundle' AS issues FROM ({ORACLE['usable_items']}) WHERE policy = 'agreement_only' AND public_line NOT IN (SELECT public_line FROM ({ORACLE['complete_story_bundles']}))"""
_LETTERS_IN = "regexp_replace(x, '[\\s\\p{Z},，、;；/|&和及与+]+', '', 'g')"
ORACLE["boxed_answers"] = f"""WITH {LAST}, b AS (SELECT run_id, prediction_id, upper(translate(nfc_normalize(regexp_extract_all(content, '(?i)\\\\+boxed\\s*\\{{([^{{}}]*)\\}}', 1)[-1]), '{"".join(_FORMS)}', '{"".join(_FORMS.values())}')) AS x FROM last),
l AS (SELECT run_id, prediction_id, nullif(list_sort(list_distinct(CASE WHEN regexp_full_match({_LETTERS_IN}, '[A-F]+') THEN string_split({_LETTERS_IN}, '') ELSE list_filter(regexp_extract_all(x, '[A-Z]+'), lambda t: regexp_full_match(t, '[A-F]')) END)), []) AS boxed FROM b)
SELECT run_id, prediction_id, {_text('boxed')} AS boxed FROM l"""


def _clusters(source: str, id_: str, prefix: str) -> str:
    """Exact and near stories by comparing all pairs that share a piece, and their components."""
    return f"""{source}, n AS (SELECT {id_}, regexp_replace(lower(translate(nfc_normalize(story), '{"".join(_FORMS)}', '{"".join(_FORMS.values())}')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS x FROM st),
d AS (SELECT DISTINCT x, sha256(x) AS h FROM n WHERE x <> ''), s AS (SELECT DISTINCT h, substr(x, i, 5) AS p FROM (SELECT h, x, unnest(range(1, greatest(2, length(x) - 3))) AS i FROM d)),
z AS (SELECT h, count(*) AS k FROM s GROUP BY h), c AS (SELECT a.h AS a, b.h AS b, count(*) AS c FROM s a JOIN s b ON a.p = b.p AND a.h < b.h GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN z x ON x.h = a JOIN z y ON y.h = b WHERE c >= 0.92 * (x.k + y.k - c)), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT h AS start, h AS node FROM d UNION SELECT start, b FROM reach JOIN both_ways ON node = a), g AS (SELECT start, min(node) AS root FROM reach GROUP BY start),
o AS (SELECT {id_}, x, sha256(CASE WHEN x = '' THEN '__missing_story_' || {id_} ELSE x END) AS h FROM n)
SELECT {id_}, '{prefix}_' || left(coalesce(root, h), 16) AS story_cluster_id, 'exact_' || left(h, 16) AS story_exact_id FROM o LEFT JOIN g ON start = h"""


ORACLE["story_clusters"] = f"WITH RECURSIVE {FIELDS}, " + _clusters("st AS (SELECT _source_line, story FROM f1)", "_source_line", "story")
ORACLE["public_story_clusters"] = "WITH RECURSIVE " + _clusters("st AS (SELECT public_line, coalesce(story, '') AS story FROM public_records)", "public_line", "public_story")

# ---- the calibration mix


def _fill(name: str, source: str, cap: int, count: int, label: str, shared: str, baseline: str) -> str:
    """Water-filled quotas: the cheapest units over all keys."""
    return f"""{name}_c AS (SELECT dimension AS key, count(*) * {cap} AS capacity, sha256('42:dimension-waterfill:{label}:' || dimension) AS h, {shared} AS shared, {baseline} AS base FROM {source} GROUP BY dimension),
{name}_u AS (SELECT key, h, shared, base, unnest(generate_series(0, least(capacity, {count}) - 1)) AS k FROM {name}_c), {name}_t AS (SELECT key FROM {name}_u ORDER BY shared + k, base + shared + k, h LIMIT {count}),
{name} AS (SELECT c.key, (SELECT count(*) FROM {name}_t t WHERE t.key = c.key) AS quota FROM {name}_c c)"""


_of_key = lambda *names: " + ".join(f"coalesce((SELECT any_value(quota) FROM {n} WHERE {n}.key = dimension), 0)" for n in names)
_ALL_MEANINGS = ORACLE["yes_no_meanings"].replace(" WHERE upper(trim(meta.qtype)) = 'Q3'", "")
_MIX = f"""{ROWS}, m AS (SELECT sample_id, arg_min(meaning, _source_line) AS meaning FROM (SELECT {_reference('r.sample_id')} AS sample_id, y._source_line, meaning FROM ({_ALL_MEANINGS}) y JOIN train_records r USING (_source_line)
WHERE meaning IS NOT NULL) GROUP BY sample_id), t AS (SELECT f.*, m.meaning FROM firsts f LEFT JOIN m ON f.sample_id = m.sample_id),
k AS (SELECT key, count(*) OVER () AS m, row_number() OVER (ORDER BY sha256('42:dimension-remainder:' || key)) AS r FROM dims), replay AS (SELECT key, 2088 // m + CASE WHEN r <= 2088 - (2088 // m) * m THEN 1 ELSE 0 END AS quota FROM k),
one AS (SELECT * FROM t WHERE question_type = 'Q2' AND len(gold) = 1), more AS (SELECT * FROM t WHERE question_type = 'Q2' AND len(gold) = (SELECT min(len(gold)) FROM t WHERE question_type = 'Q2' AND len(gold) > 1)),
unsure AS (SELECT * FROM t WHERE question_type = 'Q3' AND meaning = 'uncertain'),
{_fill('q2_single', 'one', 4, 313, 'q2-single', '0', _of_key('replay'))}, {_fill('q2_several', 'more', 2, 134, 'q2-several', _of_key('q2_single'), _of_key('replay'))},
{_fill('q3_uncertain', 'unsure', 2, 447, 'q3-uncertain', '0', _of_key('replay', 'q2_single', 'q2_several'))}"""


def _taken(no: int, bucket: str, part: str, source: str, cap: int) -> str:
    return f"""SELECT {no} AS no, '{bucket}' AS bucket, '{part}' AS part, sample_id, dimension, question_type, o, unnest(generate_series(0, least({cap}, CAST(ceil((quota - r) / n) AS BIGINT)) - 1)) AS occurrence
FROM (SELECT s.*, q.quota, count(*) OVER (PARTITION BY dimension) AS n, row_number() OVER (PARTITION BY dimension ORDER BY sha256('42:{part}:' || sample_id)) - 1 AS r, sha256('42:{part}:' || sample_id) AS o
FROM {source} s JOIN {part} q ON q.key = s.dimension) WHERE r < quota"""


_INSTANCES = f"""{_MIX}, taken AS ({_taken(0, 'balanced_replay', 'replay', 't', 1048576)} UNION ALL {_taken(1, 'q2_low_cardinality', 'q2_single', 'one', 4)} UNION ALL {_taken(2, 'q2_low_cardinality', 'q2_several', 'more', 2)}
UNION ALL {_taken(3, 'q3_uncertain', 'q3_uncertain', 'unsure', 2)}), placed AS (SELECT *, row_number() OVER (ORDER BY no, dimension, occurrence, o, sample_id) - 1 AS ordinal FROM taken),
mix AS (SELECT bucket, part, sample_id, dimension, question_type, occurrence, ordinal, row_number() OVER (PARTITION BY bucket, sample_id ORDER BY ordinal) - 1 AS occurrence_in_bucket,
row_number() OVER (PARTITION BY sample_id ORDER BY ordinal) - 1 AS occurrence_in_output FROM placed)"""
ORACLE["calibration_mix"] = f"""WITH {_INSTANCES} SELECT *, 's3_' || left(sha256('stage3:42:' || bucket || ':' || sample_id || ':' || occurrence_in_bucket || ':' || ordinal), 20) AS instance_id, sha256('3045:' || ordinal) AS shuffle_key FROM mix"""
ORACLE["calibration_quotas"] = f"""WITH {_MIX} SELECT 'replay' AS part, key, quota FROM replay UNION ALL SELECT 'q2_single', * FROM q2_single UNION ALL SELECT 'q2_several', * FROM q2_several UNION ALL SELECT 'q3_uncertain', * FROM q3_uncertain"""
ORACLE["calibration_audit"] = f"""WITH {_INSTANCES}, per AS (SELECT bucket, sample_id, count(*) AS n, any_value(dimension) AS dimension FROM mix GROUP BY ALL)
SELECT bucket, sum(n)::BIGINT AS rows, count(*) AS samples, count(DISTINCT dimension) AS dimensions, max(n) AS most_uses FROM per GROUP BY bucket"""
ORACLE["calibration_distribution"] = f"""WITH {_INSTANCES}, u AS (SELECT bucket, sample_id, count(*) AS n FROM mix GROUP BY ALL) SELECT bucket, 'question_type' AS kind, coalesce(question_type, 'unknown') AS value, count(*) AS rows FROM mix GROUP BY ALL
UNION ALL SELECT bucket, 'dimension', dimension, count(*) FROM mix GROUP BY ALL UNION ALL SELECT bucket, 'uses', CAST(n AS VARCHAR), count(*) FROM u GROUP BY ALL"""
