"""The end of an evaluation run: protocol guards, what is left to do, canonical predictions, stability and metrics."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import evalgrid
from sievework.plans import report
from sievework.sources import config as conf
from sievework.sources import jsonl
from sievework.streaming import prediction_log

#: The generation settings of the evaluation protocol, and settings that a request may not carry beside them.
PROTOCOL = {"protocol": "cot", "temperature": 0.6, "top_p": 0.95, "max_tokens": 8192, "n": 1}
RESERVED = (*PROTOCOL, "seed")
SEEDS = 3


class Incomplete(RuntimeError):
    """The log lacks grid keys; the outputs are written, and a resumed run does the rest."""


def guarded(generation: dict[str, Any], records: DataFrame) -> list[int]:
    """The run's seeds, if settings, seeds and sample ids keep to the protocol; all that is wrong in one error."""
    wrong = [f"{k} is {generation.get(k)!r}, not {v!r}" for k, v in PROTOCOL.items() if generation.get(k) != v]
    wrong += [f"extra_body sets {k}" for k in sorted(set(generation.get("extra_body") or {}) & set(RESERVED))]
    seeds = [int(s) for s in generation.get("seeds", [])]
    if len(seeds) != SEEDS or len(set(seeds)) != SEEDS:
        wrong.append(f"{SEEDS} different seeds are needed")
    ids = records.groupBy("sample_id").agg(F.count("*").alias("n"))
    bad = ids.agg(F.count_if(F.coalesce(F.trim("sample_id"), F.lit("")) == "").alias("blank"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    wrong += [f"{n} {name} sample ids" for name, n in bad.asDict().items() if n]
    if wrong:
        raise report.ReportError("; ".join(wrong))
    return seeds


def resumed(manifest: dict[str, Any], path: str | Path) -> None:
    """Writes a run's manifest, or raises if a different one is there: a log is only continued under the same manifest."""
    if Path(path).exists():
        report.same_protocol(conf.load(path), conf.redacted(manifest))
    else:
        jsonl.write_report(path, conf.redacted(manifest))


def finished(log: DataFrame, records: DataFrame, seeds: list[int], out: str, force: bool = True) -> dict[str, Any]:
    """Writes ``predictions_canonical``, ``sample_stability`` and ``metrics.json`` of one run's log; raises ``Incomplete`` at the end
    if grid keys have no success, and before anything if the log holds keys outside the grid."""
    spark = records.sparkSession
    grid = evalgrid.expected_grid(records, spark.createDataFrame([(s,) for s in seeds], "seed int"))
    ok = evalgrid.last_success(log, ("seed", "sample_id"))
    foreign = [r for r in evalgrid.grid_gaps(grid, ok).where("side = 'unexpected'").limit(10).collect()]
    if foreign:
        raise report.ReportError("the log holds other keys: " + ", ".join(f"{r['seed']}:{r['sample_id']}" for r in foreign))
    left = prediction_log.pending(grid, log, ("seed", "sample_id")).orderBy("seed", "sample_id")
    position = F.array_position(F.array(*map(F.lit, seeds)), F.col("seed"))
    rows = ok.withColumn("run_id", F.lit("run"))
    stable = evalgrid.sample_stability(rows, len(seeds))
    jsonl.write_jsonl(ok.orderBy(position, "sample_id"), f"{out}/predictions_canonical", force)
    jsonl.write_jsonl(stable.drop("run_id").orderBy("sample_id"), f"{out}/sample_stability", force)
    audit = evalgrid.attempt_audit(log.withColumn("run_id", F.lit("run")), ("run_id", "seed", "sample_id")).first()
    missing, samples = left.count(), records.select("sample_id").distinct().count()
    done = grid.count() - missing
    metrics = report.evaluation(rows, {}) | {
        "run": {
            "expected_predictions": done + missing, "completed_predictions": done, "missing_or_failed": missing,
            "missing_keys": [f"{r['seed']}:{r['sample_id']}" for r in left.limit(1000).collect()],  # a report's list, the table is in the log
            "attempts": audit["attempts"] if audit else 0, "failures": audit["failures"] if audit else 0,
            "duplicate_success_keys": audit["duplicate_success_keys"] if audit else 0, "all_records_retained": stable.count() == samples,
        }
    }
    jsonl.write_report(f"{out}/metrics.json", metrics)
    if missing:
        raise Incomplete(f"{missing} of {done + missing} predictions are missing; resume the run")
    return metrics


def warnings(metrics: dict[str, Any], manifest: dict[str, Any], predictions: DataFrame, stability: DataFrame) -> list[str]:
    """What the artifacts of one run say differently: counts, seeds and keys."""
    facts = predictions.agg(F.count("*").alias("rows"), F.count_distinct("sample_id").alias("samples"), F.count_distinct("seed").alias("seeds"), F.count_distinct("seed", "sample_id").alias("keys")).first()
    stable = stability.agg(F.count("*"), F.count_if(~F.col("complete"))).first()
    run, out = metrics.get("run", {}), []
    pairs = [
        ("completed predictions", run.get("completed_predictions"), facts["rows"]), ("canonical keys", facts["rows"], facts["keys"]),
        ("records of the manifest", manifest.get("record_count"), facts["samples"]), ("stability rows", stable[0], facts["samples"]),
        ("seeds of the manifest", len(manifest["seeds"]) if "seeds" in manifest else None, facts["seeds"]),
    ]
    out += [f"{name}: {a} against {b}" for name, a, b in pairs if a is not None and a != b]
    if stable[1]:
        out.append(f"{stable[1]} samples lack a seed")
    if run.get("missing_or_failed"):
        out.append(f"{run['missing_or_failed']} predictions are missing")
    return out


def compact(metrics: dict[str, Any], manifest: dict[str, Any], predictions: DataFrame, stability: DataFrame, weights: dict[str, int]) -> dict[str, Any]:
    """The short summary of a run: model, aggregates, stability, endings, weighted score over seeds, and warnings."""
    rows = predictions.withColumn("run_id", F.lit("run"))
    scores = [r["score"] for r in evalgrid.weighted_score(evalgrid.grouped_metrics(rows), weights).orderBy("seed").collect()]
    known = [s for s in scores if s is not None]
    mean = sum(known) / len(known) if known and len(known) == len(scores) else None
    return {
        "model": manifest.get("model"), "dataset": manifest.get("dataset"), "run": metrics.get("run"), "aggregate": metrics.get("aggregate"),
        "stability": metrics.get("stability"), "endings": metrics.get("endings"), "weighted": {"per_seed": scores, "mean": mean},
        "warnings": warnings(metrics, manifest, predictions, stability),
    }
