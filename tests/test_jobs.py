import json

import pytest
from pyspark.sql import functions as F

from sievework.plans import prepare, report
from sievework.sources import config, jsonl
from sievework.streaming import prediction_log
from tests.test_operators import LOG, log_row


def test_config():
    base = {"a": {"b": 1, "c": [1]}, "max_tokens": 5}
    assert config.merged(base, {"a": {"c": [2]}}) == {"a": {"b": 1, "c": [2]}, "max_tokens": 5} and base["a"]["c"] == [1]
    assert config.merged(base, {"a": {}}) == base and config.merged(base, {"a": None})["a"] is None and config.merged({"a": 1}, {"a": {"b": 2}}) == {"a": {"b": 2}}
    assert [config.scalar(x) for x in ("True", " none", "NULL", "1.5", "[1]", "text", "")] == [True, None, None, 1.5, [1], "text", ""]
    assert config.overridden({"a": None}, ["a..b = 1"]) == {"a": {"b": 1}} and config.overridden({"a": {"x": 1}}, ["a={}"]) == {"a": {}}
    assert config.overridden(base, ["a.b=2", "x.y=text", "z=true"]) == {"a": {"b": 2, "c": [1]}, "max_tokens": 5, "x": {"y": "text"}, "z": True}
    assert config.redacted({"API_KEY": "s", "max_tokens": 1, "in": [{"password": 1}], "ok": 2}) == {"API_KEY": config.SECRET, "max_tokens": config.SECRET, "in": [{"password": config.SECRET}], "ok": 2}
    with pytest.raises(config.ConfigError, match="a.z, q"):
        config.require(base, ["a.b", "a.z", "q"])
    with pytest.raises(config.ConfigError):
        config.overridden(base, ["nonsense"])


def test_jsonl_lines_and_errors(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"a": 1}\n\n  \n{"a": 2, "_source_line": 77}\n', encoding="utf-8")
    rows = jsonl.read_jsonl(spark, str(good), "a bigint, _source_line bigint").orderBy("a").collect()
    assert [(r["a"], r["_source_line"]) for r in rows] == [(1, 1), (2, 77)]
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n[1]\n{"a": \n', encoding="utf-8")
    with pytest.raises(jsonl.MalformedLine, match="bad.jsonl:2"):
        jsonl.read_jsonl(spark, str(bad), "a bigint")
    assert jsonl.read_jsonl(spark, str(bad), "a bigint", strict=False).where("_corrupt_record IS NOT NULL").count() == 2
    jsonl.write_report(tmp_path / "r.json", {"b": 1, "a": "é"})
    assert (tmp_path / "r.json").read_text().index('"a"') < (tmp_path / "r.json").read_text().index('"b"')
    with pytest.raises(FileExistsError):
        jsonl.guard_outputs([good])
    hashes = jsonl.file_hashes(spark, str(good)).first()
    assert hashes["size"] == good.stat().st_size


def test_prepare_end_to_end(spark, tmp_path):
    stories = ["甲告诉乙会议延期之后没有人更正", "丙在花园里找到一把旧的雨伞并交给门卫", "丁答应戊周三以前把信送到车站", "己误以为庚已经离开学校所以锁上了门"]
    with open(tmp_path / "train.jsonl", "w", encoding="utf-8") as f:
        for i in range(40):
            prompt = f"故事：{stories[i % 4]}第{'一二三四五六七八九十'[i // 4]}次。\n问题：谁知道？\n选项：\nA. 甲\nB. 乙\nC. 丙"
            row = {"sample_id": f"s{i}", "prompt_type": "mcq_single", "gold_letters": ["B"], "pred_letters": ["B"], "meta": {"dim": f"1.1.{i % 2}" if i else "", "qtype": "Q1"},
                   "messages": [{"role": "user", "content": prompt}, {"role": "assistant", "content": "因为乙在场。\\boxed{B}"}]}
            f.write(json.dumps(row, ensure_ascii=False) + "\n")
    with open(tmp_path / "public.jsonl", "w", encoding="utf-8") as f:
        for i, answers in enumerate((["甲"], ["乙"])):
            f.write(json.dumps({"sample_id": f"p{i}", "story": "s", "question": "q", "question_type": "Q1", "task_format": "mcq_single", "options": {"A": "甲", "B": "乙"}, "correct_letters": ["A"], "correct_answers": answers}, ensure_ascii=False) + "\n")
    args = (spark, str(tmp_path / "train.jsonl"), str(tmp_path / "public.jsonl"), str(tmp_path / "out"))
    audit = prepare.run(*args)
    assert audit["rows"]["clean"] == 39 and audit["rejection_reasons"] == {"missing_dimension": 1} and audit["cluster_overlap"] == 0
    assert audit["rows"]["train"] + audit["rows"]["dev"] == 39 and audit["label_status"] == {"agree": 1, "conflict": 1}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted([*prepare.ARTIFACTS, "audit.json"])
    with pytest.raises(FileExistsError):
        prepare.run(*args)
    with pytest.raises(ValueError):
        prepare.PrepareConfig(val_fraction=2)


def grid(spark, answers, run="r"):
    rows = [log_row(i * 10 + s, s, f"s{i}", a, run=run) for i, a in enumerate(answers) for s in range(3)]
    return spark.createDataFrame(rows, LOG)


def test_reports(spark):
    a, b = grid(spark, [["A"], ["B"], None]), grid(spark, [["A"], ["A"], ["A"]])
    out = report.evaluation(report.checked(a), {"mentalization": 1})
    assert out["aggregate"]["overall/all"]["mean"] == pytest.approx(1 / 3, abs=1e-8) and out["stability"]["consistent"] == 3
    assert "# Evaluation of x" in report.evaluation_markdown(out, "x")
    c = report.comparison(a, b)
    assert "## Over seeds" in report.comparison_markdown(c, ("x", "y"))
    assert next(r for r in c["groups"] if r["seed"] is None and r["group_kind"] == "overall")["wins"] == 6
    with pytest.raises(report.ReportError, match="only in"):
        report.comparison(a, b.where("sample_id <> 's0'"))
    with pytest.raises(report.ReportError, match="seeds"):
        report.checked(a.where("seed < 2"))
    with pytest.raises(report.ReportError, match="repeated"):
        report.checked(a.union(a.limit(1)))
    with pytest.raises(report.ReportError, match="missing"):
        report.checked(a.where("NOT (seed = 1 AND sample_id = 's1')"))
    with pytest.raises(report.ReportError, match="x.y"):
        report.expectations({"x": {"y": 1}}, {"x": {"y": 2}})
    assert report.percent(None) == "—" and report.percent(0.1234) == "12.34%" and report.spread(0.01, 0.002, True) == "+1.00 ± 0.20 pp"
    assert sorted(["10", "b", "2", "a"], key=report.seed_key) == ["2", "10", "a", "b"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [log_row(i, i % 3, f"s{i % 5}", ["A"] if i % 4 else ["B"], error="x" if i % 6 == 5 else None) for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = prediction_log.log_stream(spark, str(tmp_path / "log"), 1)
    got = prediction_log.run_to_table(prediction_log.latest_successes(stream), str(tmp_path / "work"))
    from sievework.operators.evalgrid import last_success

    want = last_success(spark.read.parquet(str(tmp_path / "log")))
    key = ["run_id", "seed", "sample_id", "prediction_id"]
    assert {tuple(r) for r in got.select(key).collect()} == {tuple(r) for r in want.select(key).collect()}
    counts = prediction_log.run_to_table(prediction_log.attempt_counts(prediction_log.log_stream(spark, str(tmp_path / "log"))))
    assert counts.agg(F.sum("attempts"), F.sum("failures")).first()[0] == 60


def test_every_query_has_sql_of_the_same_name():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_intermediate_tables_and_ranks(spark):
    from sievework.session import cut, drop_written, ranked, written

    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    table = written(df, "t")
    assert table.count() == cut(df).count() == 1000 and drop_written(spark) >= 1 and drop_written(spark) == 0
    got = ranked(df, [F.desc("g"), F.col("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1000)) and [r["g"] for r in got] == sorted((r["g"] for r in got), reverse=True)
    assert ranked(df.where("false"), [F.col("id")]).count() == 0


def test_protocols_gaps_and_appends(spark, tmp_path):
    a = {"dataset_sha256": "x", "record_count": 3, "generation": {"n": 1}, "prompt": "p", "seeds": [1]}
    report.same_protocol(a, dict(a))
    with pytest.raises(report.ReportError, match="generation differs; seeds differs"):
        report.same_protocol(a, a | {"generation": {}, "seeds": [2]})
    with pytest.raises(report.ReportError, match="missing"):
        report.same_protocol({}, {})
    log = grid(spark, [["A"], ["B"]]).where("NOT (seed = 1 AND sample_id = 's1')")
    prediction_log.append(log.where("seed = 0"), str(tmp_path / "log"))
    prediction_log.append(log.where("seed > 0"), str(tmp_path / "log"))
    kept = spark.read.parquet(str(tmp_path / "log"))
    want = grid(spark, [["A"], ["B"]]).select("run_id", "seed", "sample_id")
    assert [tuple(r) for r in prediction_log.pending(want, kept).collect()] == [("r", 1, "s1")]
    from sievework.operators import evalgrid

    m = evalgrid.grouped_metrics(kept)
    names = spark.createDataFrame([("qtype", "Q1"), ("qtype", "Q9")], "group_kind string, group_value string")
    got = {(r["seed"], r["group_value"]): (r["total"], r["accuracy"]) for r in evalgrid.filled_groups(m, names).collect()}
    assert got[1, "Q1"] == (1, 1.0) and got[1, "Q9"] == (0, None) and len(got) == 6


def test_evaluation_resumes_and_writes_the_canonical_grid(spark, tmp_path):
    from sievework.plans import evaluate, report

    out = str(tmp_path)
    schema = "prediction_id bigint, seed int, sample_id string, qtype string, dimension string, predicted_letters array<string>, gold_letters array<string>, mapped_letters array<string>, safe_gold boolean, gold_audit_reason string, finish_reason string, error string"
    row = lambda i, seed, sample, pred, error=None: (i, seed, sample, "Q1", "1.1.1", pred, ["A"], ["A"], True, "", "stop", error)
    records = spark.createDataFrame([("s1",), ("s2",)], "sample_id string")
    generation = evaluate.PROTOCOL | {"seeds": [17, 29, 43]}
    assert evaluate.guarded(generation, records) == [17, 29, 43]
    with pytest.raises(report.ReportError, match="temperature.*extra_body sets n.*3 different seeds.*1 blank sample ids.*1 repeated"):
        evaluate.guarded(generation | {"temperature": 1, "extra_body": {"n": 2}, "seeds": [1, 1, 2]}, spark.createDataFrame([(None,), ("a",), ("a",)], "sample_id string"))
    first = [row(i, s, x, ["A"]) for i, (s, x) in enumerate((s, x) for s in (17, 29) for x in ("s1", "s2"))] + [row(9, 43, "s1", None, "timeout"), row(10, 17, "s1", ["B"])]
    log = spark.createDataFrame(first, schema)
    manifest = {"model": "m", "dataset_sha256": "x", "record_count": 2, "generation": generation, "prompt": "p", "seeds": [17, 29, 43]}
    evaluate.resumed(manifest, tmp_path / "manifest.json")
    evaluate.resumed(manifest, tmp_path / "manifest.json")
    with pytest.raises(report.ReportError, match="dataset_sha256 differs"):
        evaluate.resumed(manifest | {"dataset_sha256": "y"}, tmp_path / "manifest.json")
    with pytest.raises(evaluate.Incomplete, match="2 of 6"):
        evaluate.finished(log, records, [17, 29, 43], out)
    assert config.load(tmp_path / "metrics.json")["run"]["missing_keys"] == ["43:s1", "43:s2"]
    whole = log.union(spark.createDataFrame([row(11, 43, "s1", ["A"]), row(12, 43, "s2", None)], schema))
    metrics = evaluate.finished(whole, records, [17, 29, 43], out)
    assert metrics["run"]["completed_predictions"] == 6 and metrics["run"]["duplicate_success_keys"] == 1 and metrics["run"]["all_records_retained"]
    kept = spark.read.json(f"{out}/predictions_canonical")
    assert kept.count() == 6 and kept.where("seed = 17 AND sample_id = 's1'").first()["predicted_letters"] == ["B"]
    short = evaluate.compact(metrics, manifest, kept.withColumn("seed", F.col("seed").cast("int")), spark.read.json(f"{out}/sample_stability"), {"mentalization": 1})
    assert short["warnings"] == [] and len(short["weighted"]["per_seed"]) == 3
    assert evaluate.warnings({"run": {"missing_or_failed": 1}}, manifest | {"record_count": 9}, kept, spark.read.json(f"{out}/sample_stability"))
    with pytest.raises(report.ReportError, match="other keys: 5:s1"):
        evaluate.finished(whole.union(spark.createDataFrame([row(13, 5, "s1", ["A"])], schema)), records, [17, 29, 43], out)


def test_calibration_job(spark, tmp_path):
    from sievework.operators.calibration import CalibrationConfig
    from sievework.plans import calibrate

    rows = [(f"s{i}", f"d{i % 5}", ("Q1", "Q2", "Q3")[i % 3], [["A"], ["A", "B"], ["A", "B", "C"]][i % 7 % 3], "uncertain" if i % 2 else "yes") for i in range(300)]
    train = spark.createDataFrame(rows, "sample_id string, dimension string, question_type string, gold_letters array<string>, meaning string")
    config_ = CalibrationConfig(total_rows=200, required_dimensions=5)
    mix, audit = calibrate.calibrate(train, config_)
    assert mix.count() == 200 and all(audit["invariants"].values()) and sum(audit["budgets"].values()) == 200
    assert mix.select("instance_id").distinct().count() == 200 and sorted(r[0] for r in mix.select("ordinal").collect()) == list(range(200))
    with pytest.raises(AssertionError, match="required_dimensions_covered"):
        calibrate.calibrate(train, CalibrationConfig(total_rows=200, required_dimensions=6))
    with pytest.raises(ValueError, match="can't cover 5 dimensions"):
        calibrate.calibrate(train, CalibrationConfig(total_rows=4, required_dimensions=5))
    with pytest.raises(ValueError, match="add up to 1"):
        CalibrationConfig(replay_fraction=0.5)


def test_repository_inspection(spark, tmp_path):
    import json

    from sievework.plans import repository

    write = lambda name, value: (tmp_path / name).write_text(value if isinstance(value, str) else json.dumps(value))
    write("config.json", {"model_type": "m", "torch_dtype": "bfloat16", "architectures": ["X"]})
    write("tokenizer_config.json", {"chat_template": "t"}), write("tokenizer.json", {}), write("model.safetensors", "12345")
    assert repository.inspect(spark, str(tmp_path), 5, "m") == []
    write("config.json", {"dtype": "float16", "load_in_4bit": True}), write("adapter_model.bin", "x"), write("model.safetensors", "")
    got = repository.inspect(spark, str(tmp_path), 5, "m")
    assert {"adapter_model.bin: forbidden", "*: too_small", "model.safetensors: empty", "config: dtype_not_bfloat16", "config: declares_quantization", "config: other_model_type", "config: no_architectures"} == set(got)
