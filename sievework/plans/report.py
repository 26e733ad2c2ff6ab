"""Evaluation reports: small aggregates collected to nested dictionaries and Markdown."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators import compare, evalgrid

NONE = "—"


class ReportError(ValueError):
    """Predictions that no report can be made of."""


def percent(value: float | None, signed: bool = False) -> str:
    return NONE if value is None else f"{value * 100:{'+' if signed else ''}.2f}%"


def spread(mean: float | None, std: float | None, signed: bool = False) -> str:
    return NONE if mean is None else f"{mean * 100:{'+' if signed else ''}.2f} ± {(std or 0) * 100:.2f} pp"


def markdown_table(headers: list[str], rows: list[list[Any]]) -> str:
    line = lambda cells: "| " + " | ".join(NONE if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(headers), line(["---"] * len(headers)), *map(line, rows)])


def seed_key(seed: Any) -> tuple[int, int, str]:
    """Numbers first, in numeric order, then other names."""
    text = str(seed)
    return (0, int(text), "") if text.lstrip("-").isdigit() else (1, 0, text)


def checked(rows: DataFrame, seeds: int = 3) -> DataFrame:
    """The rows if they are a complete grid of that many seeds without repeated keys, else an error naming what is wrong."""
    key = rows.groupBy("seed", "sample_id").agg(F.count("*").alias("n"))
    s = key.agg(F.count_distinct("seed").alias("seeds"), F.count_distinct("sample_id").alias("samples"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated")).first()
    wrong = []
    if s["seeds"] != seeds:
        wrong.append(f"{s['seeds']} seeds, expected {seeds}")
    if s["repeated"]:
        wrong.append(f"{s['repeated']} repeated (seed, sample) keys")
    if s["keys"] != s["seeds"] * s["samples"]:
        wrong.append(f"{s['seeds'] * s['samples'] - s['keys']} grid rows missing")
    if wrong:
        raise ReportError("; ".join(wrong))
    return rows


def expectations(observed: dict[str, Any], expected: dict[str, Any]) -> None:
    """All unmet equalities in one error; nested dictionaries are compared key by key."""
    wrong: list[str] = []

    def walk(a: Any, b: Any, name: str) -> None:
        if isinstance(b, dict):
            for k, v in b.items():
                walk(a.get(k) if isinstance(a, dict) else None, v, f"{name}.{k}".lstrip("."))
        elif a != b:
            wrong.append(f"{name}: {a!r}, expected {b!r}")

    walk(observed, expected, "")
    if wrong:
        raise ReportError("; ".join(wrong))


def same_protocol(baseline: dict[str, Any], candidate: dict[str, Any]) -> None:
    """Two runs' manifests must name the same data, counts, generation settings, prompts and seeds; all differences in one error."""
    wrong = [] if baseline.get("dataset_sha256") else ["dataset_sha256 is missing"]
    for key in ("dataset_sha256", "record_count", "generation", "prompt", "seeds"):
        if baseline.get(key) != candidate.get(key):
            wrong.append(f"{key} differs")
    if wrong:
        raise ReportError("; ".join(wrong))


def dataset_audit(items: DataFrame, gold: DataFrame) -> dict[str, Any]:
    """Records, safe and mapped items, and their distributions, for ``expectations``."""
    joined = items.select("public_line", "question_type", "task_format", "dimension").join(gold, "public_line")
    total = joined.agg(F.count("*"), F.count_if("safe"), F.count("mapped"), F.count_if(F.col("dimension").isNotNull())).first()
    dist = lambda c: {str(r[0]): r[1] for r in joined.groupBy(c).count().collect()}
    return {
        "records": total[0], "safe": total[1], "mapped": total[2], "known_dimensions": total[3],
        "question_types": dist("question_type"), "formats": dist("task_format"), "reasons": dist("reason"),
    }


def evaluation(rows: DataFrame, weights: dict[str, int]) -> dict[str, Any]:
    """Per-seed and aggregate metrics, stability, endings and the weighted score of one run."""
    one = rows.withColumn("run_id", F.lit("run"))
    metrics = evalgrid.grouped_metrics(one).persist()
    stable = evalgrid.sample_stability(one, one.select("seed").distinct().count())
    per_seed: dict[str, dict] = {}
    for r in metrics.collect():  # one row per seed and group
        d = r.asDict()
        per_seed.setdefault(str(d.pop("seed")), {}).setdefault(d.pop("group_kind"), {})[d.pop("group_value")] = d
    total = {f"{r['group_kind']}/{r['group_value']}": r.asDict() for r in evalgrid.over_seeds(metrics).collect()}
    scores = [r.asDict() for r in evalgrid.weighted_score(metrics, weights).collect()]
    metrics.unpersist()
    return {
        "per_seed": {k: per_seed[k] for k in sorted(per_seed, key=seed_key)},
        "aggregate": total,
        "stability": evalgrid.stability_audit(stable).first().asDict(),
        "endings": [r.asDict() for r in evalgrid.artifact_audit(one).collect()],
        "weighted": scores,
    }


def evaluation_markdown(report: dict[str, Any], name: str) -> str:
    rows = [[k, v["seeds"], spread(v["mean"], v["std"]), percent(v["min"]), percent(v["max"])] for k, v in sorted(report["aggregate"].items())]
    s = report["stability"]
    return "\n\n".join(
        [
            f"# Evaluation of {name}",
            markdown_table(["group", "seeds", "accuracy", "min", "max"], rows),
            "## Stability",
            markdown_table(["samples", "complete", "consistent", "ties", "consistency"], [[s["samples"], s["complete"], s["consistent"], s["ties"], percent(s["consistency_rate"])]]),
            "## Weighted score",
            markdown_table(["seed", "covered", "score"], [[r["seed"], percent(r["covered_weight"]), percent(r["score"])] for r in sorted(report["weighted"], key=lambda r: seed_key(r["seed"]))]),
        ]
    ) + "\n"


def comparison(baseline: DataFrame, candidate: DataFrame) -> dict[str, Any]:
    """Paired report of two runs over one grid; raises if grids or facts differ."""
    gaps = compare.protocol_gaps(baseline, candidate).limit(5).collect()
    if gaps:
        raise ReportError("the runs' grids differ: " + ", ".join(f"{g['fact']} {g['value']} only in {g['only_in']}" for g in gaps))
    pairs = compare.paired(baseline, candidate)
    different = pairs.where("meta_differs").limit(5).collect()
    if different:
        raise ReportError("facts differ for: " + ", ".join(f"{d['seed']}/{d['sample_id']}" for d in different))
    compared = compare.comparison(pairs).persist()
    out = {"groups": [r.asDict() for r in compared.collect()], "seeds": [r.asDict() for r in compare.seed_summary(compared).collect()]}
    compared.unpersist()
    return out


def comparison_markdown(report: dict[str, Any], names: tuple[str, str]) -> str:
    pooled = [r for r in report["groups"] if r["seed"] is None]
    rows = [[r["group_kind"], r["group_value"], r["total"], r["wins"], r["losses"], r["net"], percent(r["win_rate"])] for r in sorted(pooled, key=lambda r: (r["group_kind"], r["group_value"]))]
    seeds = [[r["group_kind"], r["group_value"], spread(r["delta_mean"], r["delta_std"], True)] for r in sorted(report["seeds"], key=lambda r: (r["group_kind"], r["group_value"]))]
    return "\n\n".join(
        [f"# {names[1]} against {names[0]}", markdown_table(["kind", "group", "pairs", "wins", "losses", "net", "win rate"], rows), "## Over seeds", markdown_table(["kind", "group", "delta"], seeds)]
    ) + "\n"
