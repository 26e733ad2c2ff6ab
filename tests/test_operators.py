import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators.forest import spanning_forest
from sievework.operators import clusters, compare, evalgrid, labels, manifest, quality, sampling, split, training

LOG = (
    "prediction_id bigint, run_id string, seed int, sample_id string, qtype string, dimension string, predicted_letters array<string>, "
    "gold_letters array<string>, mapped_letters array<string>, safe_gold boolean, gold_audit_reason string, finish_reason string, error string"
)


def log_row(i, seed, sample, pred, gold=("A",), run="r", error=None, safe=True, mapped=("A",), dim="1.1.1", q="Q1", end="stop"):
    arr = lambda x: None if x is None else list(x)
    return (i, run, seed, sample, q, dim, arr(pred), arr(gold), arr(mapped), safe, "", end, error)


def test_last_success_wins_and_attempts_are_counted(spark):
    rows = [log_row(1, 1, "a", ["A"]), log_row(2, 1, "a", ["B"]), log_row(3, 1, "b", None, error="timeout")]
    df = spark.createDataFrame(rows, LOG)
    assert [(r["sample_id"], r["predicted_letters"]) for r in evalgrid.last_success(df).collect()] == [("a", ["B"])]
    a = evalgrid.attempt_audit(df).first()
    assert (a["attempts"], a["failures"], a["duplicate_success_keys"], a["unfinished_keys"]) == (3, 1, 1, 1)
    assert evalgrid.last_success(df.where("false")).count() == 0


def test_metrics_stability_and_majority(spark):
    rows = []
    for seed, (x, y) in enumerate([(["A"], ["B"]), (["A"], ["A"]), (["A"], ["C"])]):
        rows += [log_row(10 + seed, seed, "x", x), log_row(20 + seed, seed, "y", y, safe=False, mapped=None, dim=None)]
    rows += [log_row(40 + s, s, "z", None) for s in range(3)] + [log_row(50, 0, "w", ["A"])]
    df = spark.createDataFrame(rows, LOG)
    m = {(r["seed"], r["group_kind"], r["group_value"]): r for r in evalgrid.grouped_metrics(df).collect()}
    assert m[1, "overall", "all"]["total"] == 3 and m[1, "overall", "all"]["correct"] == 2 and m[1, "overall", "all"]["safe_total"] == 2
    assert (1, "dimension", "unknown") not in m
    s = {r["sample_id"]: r for r in evalgrid.sample_stability(df, 3).collect()}
    assert s["x"]["consistent"] and s["x"]["majority"] == ["A"] and s["x"]["majority_correct"]
    assert s["y"]["tie"] and s["y"]["majority"] is None and s["y"]["majority_correct_safe"] is None and s["y"]["majority_correct_mapped"] is None
    assert s["z"]["consistent"] and s["z"]["majority"] is None and not s["z"]["majority_correct"]
    assert not s["w"]["complete"] and s["w"]["majority"] is None


def test_rates_over_nothing_are_null(spark):
    df = spark.createDataFrame([log_row(1, 0, "a", ["A"], safe=False)], LOG)
    r = evalgrid.grouped_metrics(df).where("group_kind = 'overall'").first()
    assert r["safe_total"] == 0 and r["safe_accuracy"] is None


def test_weighted_score_is_never_renormalised(spark):
    metrics = [("r", 0, "primary", k, a) for k, a in (("m", 1.0), ("s", 1.0), ("n", 0.0))] + [("r", 1, "primary", "m", 1.0)]
    df = spark.createDataFrame(metrics, "run_id string, seed int, group_kind string, group_value string, accuracy double")
    got = {r["seed"]: r for r in evalgrid.weighted_score(df, {"m": 750, "s": 675, "n": 350}).collect()}
    assert got[0]["score"] == pytest.approx(1425 / 1775, abs=1e-9) and got[1]["score"] is None
    assert got[1]["covered_weight"] == pytest.approx(750 / 1775, abs=1e-9)


def test_paired_outcomes(spark):
    b = [log_row(i, 0, s, p) for i, (s, p) in enumerate([("a", ["A"]), ("b", ["B"]), ("c", None), ("d", ["B"])])]
    c = [log_row(i, 0, s, p, end="length") for i, (s, p) in enumerate([("a", ["B"]), ("b", ["A"]), ("c", ["A"]), ("d", ["B"])])]
    pairs = compare.paired(spark.createDataFrame(b, LOG), spark.createDataFrame(c, LOG))
    r = compare.comparison(pairs).where("seed IS NULL AND group_kind = 'overall'").first()
    assert (r["wins"], r["losses"], r["net"], r["discordant"], r["both_wrong"], r["newly_parsed"], r["newly_cut"], r["changed"]) == (2, 1, 1, 3, 1, 1, 4, 3)
    assert r["win_rate"] == pytest.approx(2 / 3, abs=1e-8)


def test_row_errors(spark):
    rows = [log_row(1, 9, "a", ["A"]), log_row(2, 1, "", ["A"]), log_row(3, 1, "b", [""]), log_row(4, 1, "c", ["A"], gold=[]), log_row(5, 1, "d", ["A"]), log_row(6, 1, "d", ["A"]), log_row(7, 1, "e", None)]
    got = {r["prediction_id"]: r["reason"] for r in evalgrid.row_errors(spark.createDataFrame(rows, LOG), [1]).collect()}
    assert got == {1: "unexpected_seed", 2: "missing_sample_id", 3: "bad_prediction", 4: "missing_gold", 5: "duplicate_key", 6: "duplicate_key"}


PUBLIC = "public_line bigint, sample_id string, story string, question_type string, task_format string, options map<string, string>, correct_letters array<string>, correct_answers array<string>"


def public(i, letters, answers, fmt="mcq_single", story="s", options=None):
    return (i, str(i), story, "Q1", fmt, options or {"A": "甲。", "B": "乙", "C": "丙"}, letters, answers)


def test_label_status_and_policies(spark):
    rows = [public(1, ["A"], ["甲"]), public(2, ["A"], ["乙"]), public(3, ["A"], ["丁"]), public(4, ["A", "B"], ["甲", "乙"]), public(5, ["A"], None), public(6, None, ["甲"]), public(7, ["A"], ["x"], options={"A": "x", "B": "X"})]
    df = spark.createDataFrame(rows, PUBLIC)
    a = labels.audit(df)
    got = {r["public_line"]: r["status"] for r in a.collect()}
    assert got == {1: "agree", 2: "conflict", 3: "unmapped", 4: "agree", 5: "missing", 6: "missing", 7: "ambiguous"}
    assert {r[0] for r in labels.usable(a).select("public_line").collect()} == {1}
    assert {r[0] for r in labels.usable(a, "mapped_answer_text").select("public_line").collect()} == {1, 2}
    assert labels.complete_bundles(a).count() == 0
    gold = {r["public_line"]: r["reason"] for r in labels.gold_audit(df).collect()}
    assert gold == {1: "letter_text_agree", 2: "letter_text_conflict", 3: "answer_text_unmapped", 4: "single_format_with_multiple_answers", 5: "answer_text_not_provided", 6: "letter_text_conflict", 7: "letter_text_agree"}
    with pytest.raises(ValueError):
        labels.usable(a, "other")


def test_yes_no_meaning(spark):
    opts = lambda *o: "选项：\n" + "\n".join(f"{x}. {t}" for x, t in zip("ABCD", o))
    rows = [(1, opts("是", "否", "无法确定。"), ["C"]), (2, opts("是", "否"), ["A"]), (3, opts("是", "否", "也许"), ["A"]), (4, opts("是", "否", "证据不足"), []), (5, opts("是", "是", "否"), ["A"]), (6, None, ["A"])]
    df = spark.createDataFrame(rows, "id bigint, p string, g array<string>")
    got = {r["id"]: (r["error"], r["meaning"]) for r in labels.yes_no_meaning(df, F.col("p"), F.col("g"), "id").collect()}
    assert got == {1: (None, "uncertain"), 2: ("not_three_options", None), 3: ("unknown_option_text", None), 4: ("no_single_gold", None), 5: ("not_one_to_one", None), 6: ("not_three_options", None)}


TRAIN = "_source_line bigint, sample_id string, prompt_type string, gold_letters array<string>, pred_letters array<string>, meta struct<dim: string, qtype: string>, messages array<struct<role: string, content: string>>, story_cluster_id string, source string"


def train(i, q="Q1", dim="1.1.1", gold=("B",), pred=("B",), options="ABCD", story="甲告诉乙会议延期。"):
    prompt = f"故事：{story}\n问题：谁知道？\n选项：\n" + "\n".join(f"{x}. 选项{x}" for x in options)
    return (i, str(i), "mcq_single", list(gold), list(pred), (dim, q), [("user", prompt), ("assistant", "因为乙在场。\\boxed{B}")], None, "s")


def test_rejection_reasons_and_cleaning(spark):
    rows = [train(1), train(2, q="Q2", options="ABCDEF"), train(3, dim=""), train(4, gold=("F",), pred=("F",)), train(5, gold=(), pred=()), train(6, pred=("A",)), (7, "7", None, ["A"], None, None, None, None, None)]
    df = spark.createDataFrame(rows, TRAIN)
    got = {r["_source_line"]: r["reasons"] for r in quality.rejected(df).collect()}
    assert got == {2: ["legacy_q2_six_options"], 3: ["missing_dimension"], 4: ["gold_outside_options"], 5: ["missing_gold_letters"], 6: ["gold_pred_mismatch"], 7: ["invalid_or_missing_chat", "missing_dimension", "story_extraction_failed"]}
    ok = quality.accepted(df).collect()
    assert len(ok) == 1 and ok[0]["messages"][-1]["content"].endswith("\\boxed{B}") and ok[0]["_pipeline"]["original_boxed_count"] == 1
    assert quality.accepted(df.where("false")).count() == 0


def test_near_stories_share_a_cluster(spark):
    base = "甲把雨伞放在门卫室然后离开了学校乙没有看见甲的举动于是继续在仓库里寻找那把旧的雨伞直到天黑"
    rows = [(1, base + "才回家"), (2, base + "才回来"), (3, "完全不同的另一个故事讲的是集市上的摊贩和顾客之间的争执"), (4, ""), (5, ""), (6, None), (7, base + "才，回家！")]
    df = spark.createDataFrame(rows, "id bigint, story string")
    got = {r["id"]: r["story_cluster_id"] for r in clusters.story_clusters(df, "id", F.col("story"), 0.70, 3, 10).collect()}
    assert got[1] == got[2] == got[7] != got[3] and len({got[4], got[5], got[6]}) == 3
    strict = {r["id"]: r["story_cluster_id"] for r in clusters.story_clusters(df, "id", F.col("story"), 1.0).collect()}
    assert strict[1] == strict[7] != strict[2]


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", 1.0) for i in range(60)] + [("a", "b", 1.0)], "u string, v string, w double")
    got = {r["vertex"]: r["root"] for r in spanning_forest(chain)[0].collect()}
    assert {got[f"{i:03d}"] for i in range(61)} == {"000"} and got["b"] == "a"


def test_candidates_equal_all_pairs_by_definition(spark):
    """Pairs of hashes find what counting shared hashes over all pairs finds, also with a stock opening and short texts."""
    rng = random.Random(8)
    letters = "".join(chr(0x4E00 + i) for i in range(40))
    texts = {"".join(rng.choice(letters) for _ in range(n)) for n in (3, 4, 5, 6, 6, 7, 7, 8, 9)} | {letters[:k] for k in range(4, 9)}
    for _ in range(12):
        t = "开头都是这一句话" * 3 + "".join(rng.choice(letters) for _ in range(60))
        texts |= {t, t[:50] + "改" + t[51:], t + "尾"}
    df = spark.createDataFrame([(t, t) for t in texts], "h string, norm string")
    base = clusters._shingled(df, 3)
    sketches = {r["h"]: r["s"][:6] for r in base.collect()}
    want = set()
    for u in texts:
        for v in texts:
            if u < v and min(len(u), len(v)) >= 0.8 * max(len(u), len(v)):
                if len(set(sketches[u]) & set(sketches[v])) >= (1 if len(sketches[v]) < 4 else 2):
                    want.add((u, v))
    got = [tuple(r) for r in clusters.fuzzy_candidates(base, 0.8, 3, 6).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_cluster_audit(spark):
    base = "甲把雨伞放在门卫室然后离开了学校乙没有看见甲的举动于是继续在仓库里寻找那把旧的雨伞直到天黑"
    df = spark.createDataFrame([(1, base + "才回家"), (2, base + "才回来"), (3, "另一个故事讲的是集市上的摊贩"), (4, ""), (5, base + "才，回家！")], "id bigint, story string")
    r = clusters.cluster_audit(df, "id", F.col("story"), 0.70, 3, 10).first()
    assert (r["rows"], r["exact_stories"], r["clusters"], r["merged_stories"], r["candidate_pairs_compared"], r["rows_in_shared_clusters"]) == (5, 4, 3, 1, 1, 3)
    assert clusters.cluster_audit(df, "id", F.col("story"), 1.0).first()["candidate_pairs_compared"] == 0


def stock_stories(count):
    """Stories with one stock opening, and an edited copy of every tenth: near pairs are few, pairs that share hashes nearly all."""
    rng = random.Random(3)
    opening = "".join(chr(0x4E00 + i) for i in range(60))
    texts = [opening + "".join(chr(0x5000 + rng.randrange(900)) for _ in range(80)) for _ in range(count)]
    return texts + [t[:100] + "改" + t[101:] for t in texts[::10]]


def written_rows(monkeypatch):
    rows, plain = [], clusters.written
    monkeypatch.setattr(clusters, "written", lambda df, name: (t := plain(df, name), rows.append(t.count()))[0])
    return rows


def test_stories_with_a_stock_opening_are_not_listed_by_pairs(spark, monkeypatch):
    texts, rows = stock_stories(200), written_rows(monkeypatch)
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, story string")
    got = {r["id"]: r["story_cluster_id"] for r in clusters.story_clusters(df, "id", F.col("story")).collect()}
    assert all((got[i] == got[j]) == (j == 200 + i / 10) for i in range(200) for j in range(i + 1, 220))
    assert sum(rows) <= 4 * len(texts)


def test_public_stories_with_a_stock_opening_are_not_listed_by_pairs(spark, tmp_path, monkeypatch):
    import __spark_entry__

    texts, rows = stock_stories(150), written_rows(monkeypatch)
    spark.createDataFrame(list(enumerate(texts)), "public_line bigint, story string").write.parquet(f"{tmp_path}/public_records.parquet")
    got = {r["public_line"]: r["story_cluster_id"] for r in __spark_entry__.queries()["public_story_clusters"](spark, str(tmp_path)).collect()}
    assert len(got) == 165 and len(set(got.values())) == 150 and all(got[i] == got[150 + i // 10] for i in range(0, 150, 10))
    assert sum(rows) <= 4 * len(texts)


def test_cluster_audit_counts_pairs_without_listing_them(spark, monkeypatch):
    """Also where a hash that many stories share is compared in blocks, some pairs at a time."""
    monkeypatch.setattr(clusters, "BLOCK", 40)
    monkeypatch.setattr(clusters, "PAIRS", 500)
    texts, rows = stock_stories(120), written_rows(monkeypatch)
    sketches = [set(sorted(int(k) & 0xFFFFFFFF for k in text.piece_crcs([t]))[:12]) for t in texts]
    r = clusters.cluster_audit(spark.createDataFrame(list(enumerate(texts)), "id bigint, story string"), "id", F.col("story")).first()
    assert r["candidate_pairs_compared"] == sum(len(a & b) >= 2 for i, a in enumerate(sketches) for b in sketches[:i]) > 20 * len(texts)
    assert (r["exact_stories"], r["clusters"], r["rows_in_shared_clusters"]) == (132, 120, 24)
    assert sum(rows) <= 5 * len(texts)


def test_similar_texts_have_a_part_in_common():
    """For sizes from one shingle on and thresholds down to 0.9, every pair that reaches the threshold, and few others."""
    rng, texts = random.Random(5), []
    for n in [1, 2, 5, 6, 9, 14, 20, 33, 60, 61, 90, 140, 300] * 3:
        t = "".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(n))
        texts += [t, t + "尾", "头" + t[:-1], t[: n // 2] + "改" + t[n // 2 + 1 :], t + t[: n // 12], t[n // 14 :]]
    texts = sorted({t for t in texts if t})
    pieces = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    for threshold in (0.9, 0.92, 0.97):
        keys = [set() for _ in texts]
        for key, t in zip(*clusters.part_keys(texts, threshold, 5)):
            keys[t].add(int(key))
        pairs = [(i, j) for i in range(len(texts)) for j in range(i)]
        near = {(i, j) for i, j in pairs if len(pieces[i] & pieces[j]) >= threshold * len(pieces[i] | pieces[j])}
        meet = {(i, j) for i, j in pairs if keys[i] & keys[j]}
        assert near and near <= meet and len(meet) < len(near) + len(pairs) // 20


def test_split_keeps_clusters_and_covers_dimensions(spark):
    rng = random.Random(4)
    rows = [(i, f"c{i // 3}", rng.choice("xyz")) for i in range(120)] + [(900, None, "x")]
    df = spark.createDataFrame(rows, "id bigint, story_cluster_id string, dimension string")
    out = split.train_dev_split(df)
    assert split.leakage(out).count() == 0 and out.count() == 121
    dev = out.where("split = 'dev'").collect()
    assert {r["dimension"] for r in dev} == {"x", "y", "z"} and 9 <= len(dev) <= 15
    assert split.train_dev_split(df.where("false")).count() == 0


def test_split_looks_at_every_cluster(spark, monkeypatch):
    monkeypatch.setattr(split, "PROFILES", 20, raising=False)  # the former cap on candidates
    rows = [(f"big{i}", "x") for i in range(20) for _ in range(3)] + [(f"small{i}", "xyz"[i % 3]) for i in range(540)] + [(None, "x")] * 100
    out = split.train_dev_split(spark.createDataFrame(rows, "story_cluster_id string, dimension string"))
    dev = out.where("split = 'dev'").collect()
    assert len(dev) == 70 and {r["dimension"] for r in dev} == {"x", "y", "z"} and all(r["story_cluster_id"] for r in dev)
    assert out.count() == 700 and split.leakage(out).count() == 0


def test_split_picks_by_tie_breaker(spark):
    rows = [(f"c{i}", "xy"[i % 2]) for i in range(200)]
    out = split.train_dev_split(spark.createDataFrame(rows, "story_cluster_id string, dimension string"), fraction=0.5)
    dev = {r["story_cluster_id"] for r in out.where("split = 'dev'").collect()}
    best = [sorted((c for c, d in rows if d == x), key=lambda c: text.tie_breaker(42, c))[:50] for x in "xy"]
    assert dev == {*best[0], *best[1]}


def test_balance_and_quotas(spark):
    df = spark.createDataFrame([("s0", "a")] + [(f"t{i}", "b") for i in range(5)], "sample_id string, dimension string")
    out = sampling.balanced(df, "dimension", "sample_id", 3).collect()
    assert sorted(r["dimension"] for r in out) == ["a"] * 3 + ["b"] * 3 and len({r["instance_id"] for r in out}) == 6
    assert sampling.balanced(df, "dimension", "sample_id", "none").count() == 6
    counts = spark.createDataFrame([(f"d{i}", i) for i in range(7)], "key string, n bigint")
    q = [r["quota"] for r in sampling.replay_quota(counts, 24, 42).collect()]
    assert sum(q) == 24 and max(q) - min(q) <= 1
    shares = spark.createDataFrame([("a", 0.7), ("b", 0.15), ("c", 0.15)], "key string, share double")
    assert {r["key"]: r["budget"] for r in sampling.largest_remainder(shares, 2982).collect()} == {"a": 2088, "b": 447, "c": 447}
    with pytest.raises(ValueError):
        sampling.balance_target(counts, 0)


def test_calibration_takes_uncertain_by_meaning(spark, tmp_path):
    from sievework.plans.queries import QUERIES

    items = [("s1", ("是", "否", "无法确定"), "C"), ("s2", ("证据不足", "是", "否"), "C"), ("s3", ("无法判断", "否", "是"), "A"), ("s4", ("是", "否", "也许"), "C")]
    prompt = lambda o: "问题：是吗？\n选项：\n" + "\n".join(f"{x}. {t}" for x, t in zip("ABC", o))
    records = [(i, s, [g], [("user", prompt(o)), ("assistant", "好")]) for i, (s, o, g) in enumerate(items)]
    spark.createDataFrame(records, "_source_line bigint, sample_id string, gold_letters array<string>, messages array<struct<role: string, content: string>>").write.parquet(f"{tmp_path}/train_records.parquet")
    rows = [(i, s, f"c{i}", "1.1.1", "Q3", [g]) for i, (s, _, g) in enumerate(items)]
    spark.createDataFrame(rows, "split_row_id bigint, sample_id string, story_cluster_id string, dimension string, question_type string, gold_letters array<string>").write.parquet(f"{tmp_path}/split_rows.parquet")
    out = QUERIES["calibration_mix"](spark, str(tmp_path)).where("bucket = 'q3_uncertain'")
    assert {r["sample_id"] for r in out.collect()} == {"s1", "s3"}


def test_waterfill_equals_a_greedy(spark):
    import hashlib

    rng = random.Random(1)
    rows = [(f"d{i}", rng.randrange(0, 9), rng.randrange(0, 3), rng.randrange(0, 6)) for i in range(12)]
    df = spark.createDataFrame(rows, "key string, capacity bigint, shared bigint, baseline bigint")
    got = {r["key"]: r["quota"] for r in sampling.waterfill_quota(df, 25, 7, "x").collect()}
    want, shared = {k: 0 for k, *_ in rows}, {k: s for k, _, s, _ in rows}
    for _ in range(25):
        free = [(shared[k], b + shared[k], hashlib.sha256(f"7:dimension-waterfill:x:{k}".encode()).hexdigest(), k) for k, c, _, b in rows if want[k] < c]
        if not free:
            break
        k = min(free)[-1]
        want[k] += 1
        shared[k] += 1
    assert got == want


def test_manifest(spark):
    s = "path string, size bigint, sha256 string"
    e = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], s)
    o = spark.createDataFrame([("a", 1, "x"), ("b", 5, "q"), ("new", 1, "n"), ("d/.hid", 1, "n")], s)
    assert {tuple(r) for r in manifest.reconciled(e, o).collect()} == {("b", "size"), ("b", "sha256"), ("c", "missing"), ("new", "unexpected")}
    assert {tuple(r) for r in manifest.first_failures(e, o).collect()} == {("b", "size"), ("c", "missing")}
    assert manifest.fingerprint(e) == manifest.fingerprint(e.orderBy(F.desc("path")))


def test_token_rows(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4], [-100, -100, 3, 4]), (2, [5, 6, 7], [5, -100, -100])], "id int, input_ids array<int>, labels array<int>")
    left = {r["id"]: r for r in training.truncated(df, 2).collect()}
    assert left[1]["labels"] == [3, 4] and left[2]["dropped"]
    right = {r["id"]: r for r in training.truncated(df, 2, "keep_right").collect()}
    dead = spark.createDataFrame([(3, [1], [-100]), (4, None, None)], df.schema)
    assert {r["dropped"] for r in training.truncated(dead, 2).collect()} == {False}  # short rows stay as they are
    assert training.truncated(df, 4, "error").count() == 2
    for bad in (training.truncated(df, 3, "error"), training.truncated(df, 2, "right", strict=True)):
        with pytest.raises(Exception, match="more than 3 ids|no trainable label"):
            bad.collect()
    with pytest.raises(ValueError):
        training.truncated(df, 2, "middle")
    assert right[1]["dropped"] and right[2]["input_ids"] == [5, 6]
    assert {r["id"]: r["dropped"] for r in training.truncated(df, 3, "drop").collect()} == {1: True, 2: False}
    pad = {r["id"]: r for r in training.padded(df.withColumn("b", F.lit(0)), "b", 8).collect()}
    assert len(pad[1]["input_ids"]) == len(pad[2]["labels"]) == 8 and sum(pad[2]["attention_mask"]) == 3
    spans = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("end")))
    assert df.select(training.assistant_labels(F.col("input_ids"), spans)).first()[0] == [-100, 2, 3, -100]


def test_template_labels(spark):
    m = "messages array<struct<role: string, content: string>>"
    chats = [([("user", "ab"), ("assistant", "cd"), ("user", "e"), ("assistant", "f")],), ([("user", "x")],), (None,)]
    df = spark.createDataFrame(chats, m)
    mark = {"user": 1, "assistant": 2}

    def render(chat, opening):
        ids = [i for t in chat for i in (mark[t["role"]], *t["content"].encode(), 0)]
        return ids + [2] if opening else ids

    got = df.select(training.template_tokens("messages", render).alias("t")).select("t.*").collect()
    assert got[0]["labels"] == [-100] * 5 + [99, 100, 0] + [-100] * 4 + [102, 0] and got[0]["error"] is None
    assert got[1]["labels"] == [-100] * 3 and got[1]["error"] == got[2]["error"] == "no_trainable_label"
    shifting = df.select(training.template_tokens("messages", lambda chat, opening: [len(chat), *render(chat, opening)]).alias("t")).select("t.error").collect()
    assert shifting[0][0] == "unstable_before_answer"


def test_grouped_loss(spark):
    df = spark.createDataFrame([("Q1", "a", 10.0, 10.0), ("Q2", "b", 10.0, 1.0), (None, "a", 0.0, 0.0)], "qtype string, dimension string, loss_sum double, token_count double")
    got = {(r["kind"], r["name"]): r["loss"] for r in training.grouped_loss(df).collect()}
    assert got["overall", "all"] == pytest.approx(20 / 11) and got["macro_dimension", "all"] == pytest.approx(5.5) and got["macro_qtype", "all"] == pytest.approx(5.5)
    assert ("qtype", "unknown") not in got


def test_length_summary(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 101)], "n bigint")
    r = quality.length_summary(df, "n").first()
    assert (r["count"], r["min"], r["median"], r["p95"], r["p99"], r["max"]) == (100, 1, 50.5, 95, 99, 100)
    assert quality.length_summary(df.where("false"), "n").first()["count"] == 0
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.choice([None, round(rng.random(), 2)])) for _ in range(600)] + [("none", None)]
    got = {r["g"]: r for r in quality.length_summary(spark.createDataFrame(rows, "g string, x double"), "x", "g").collect()}
    assert got["none"]["count"] == 0 and got["none"]["p95"] is None
    for g in ("hot", "cold", None):
        xs = sorted(x for k, x in rows if k == g and x is not None)
        n = len(xs)
        rank = lambda q: xs[-(-n * q // 100) - 1]
        want = (n, xs[0], (xs[(n - 1) // 2] + xs[n // 2]) / 2, rank(95), rank(99), xs[-1])
        assert tuple(got[g])[1:] == pytest.approx(want), g


def test_provenance(spark):
    from sievework.operators import provenance

    df = spark.createDataFrame([("a", 1, "x"), (" ", 2, "x"), (None, None, "y")], "s string, n bigint, r string")
    keys = [r[0] for r in df.select(provenance.source_key(F.col("s"), F.col("n"), F.struct("r"))).collect()]
    assert keys[:2] == ["sample_id:a|source_line:1", "source_line:2"] and keys[2].startswith("sha256:")
    rows = spark.createDataFrame([("b1", "a", "d"), ("b1", "a", "d"), ("b1", "b", "e")], "bucket string, sample_id string, dimension string")
    r = provenance.selection_audit(rows).first()
    assert (r["rows"], r["samples"], r["dimensions"], r["most_uses"]) == (3, 2, 2, 2)
    assert [tuple(x) for x in provenance.most_repeated(rows, "sample_id").collect()] == [("a", 2), ("b", 1)]
    assert {tuple(x) for x in provenance.occurrences(rows, "sample_id").collect()} == {(1, 1), (2, 1)}
    assert provenance.outside(rows, rows.limit(0), "sample_id").count() == 3
    with pytest.raises(AssertionError, match="two"):
        provenance.invariants({"one": True, "two": False})
    listing = spark.createDataFrame([("x/a.jsonl", "h")], "path string, sha256 string")
    provenance.pinned(listing, {"a.jsonl": "h"})
    with pytest.raises(ValueError, match="b.jsonl: missing"):
        provenance.pinned(listing, {"a.jsonl": "h", "b.jsonl": "h"})


def test_chat_tokens_mask_other_roles(spark):
    m = "messages array<struct<role: string, content: string>>"
    df = spark.createDataFrame([([("user", "ab"), ("assistant", "c"), ("user", None), ("assistant", "d")],), (None,)], m)
    got = df.select(training.chat_tokens("messages", lambda role, content: list(content.encode())).alias("t")).select("t.*").collect()
    assert got[0]["input_ids"] == [97, 98, 99, 100] and got[0]["labels"] == [-100, -100, 99, 100] and got[1]["input_ids"] == []
    s = training.dataset_stats(df.select(training.chat_tokens("messages", lambda role, content: list(content.encode())).alias("t")).select("t.*"), 2, "left").first()
    assert (s["rows"], s["kept"], s["dropped"], s["longest"], s["trainable"]) == (2, 1, 1, 2, 2)


def test_repository_errors(spark):
    files = spark.createDataFrame([("config.json", 1), ("a.safetensors", 5), ("b.safetensors", 5), ("x.gguf", 1)], "path string, size bigint")
    index = spark.createDataFrame([("a.safetensors",), ("c.safetensors",)], "path string")
    got = {tuple(r) for r in manifest.repository_errors(files, index, ["config.json", "tok.json"], r"\.gguf$", 100).collect()}
    assert got == {("tok.json", "required_missing"), ("x.gguf", "forbidden"), ("c.safetensors", "shard_missing"), ("b.safetensors", "not_in_index"), ("*", "too_small")}
