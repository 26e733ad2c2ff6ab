"""Command line: prepare, calibrate, evaluate, compare, finish, summarise, check-repository."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sievework.operators.evalgrid import last_success
from sievework.plans import calibrate, evaluate, prepare, report, repository
from sievework.plans.queries import WEIGHTS
from sievework.sources import config, jsonl


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sievework")
    jobs = p.add_subparsers(dest="job", required=True)
    a = jobs.add_parser("prepare", help="clean, cluster, split, balance and audit a corpus")
    a.add_argument("train"), a.add_argument("public"), a.add_argument("out")
    a.add_argument("--config"), a.add_argument("--set", action="append", default=[], metavar="a.b=v"), a.add_argument("--force", action="store_true")
    d = jobs.add_parser("calibrate", help="the calibration mix of a training table, audited")
    d.add_argument("train"), d.add_argument("out")
    d.add_argument("--config"), d.add_argument("--set", action="append", default=[], metavar="a.b=v"), d.add_argument("--force", action="store_true")
    e = jobs.add_parser("finish", help="canonical predictions, stability and metrics of one run's log")
    e.add_argument("log"), e.add_argument("records"), e.add_argument("manifest"), e.add_argument("out")
    f = jobs.add_parser("summarise", help="compact summary of a finished run, with warnings")
    f.add_argument("folder"), f.add_argument("manifest"), f.add_argument("out")
    g = jobs.add_parser("check-repository", help="structural errors of a model repository")
    g.add_argument("folder"), g.add_argument("--least-bytes", type=int, default=20_000_000_000), g.add_argument("--model-type")
    b = jobs.add_parser("evaluate", help="report of one run of a prediction log")
    b.add_argument("log"), b.add_argument("run"), b.add_argument("out")
    c = jobs.add_parser("compare", help="paired report of two runs")
    c.add_argument("log"), c.add_argument("baseline"), c.add_argument("candidate"), c.add_argument("out")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sievework").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.job == "prepare":
        settings = config.overridden(config.load(args.config) if args.config else {}, args.set)
        try:
            prepare.run(spark, args.train, args.public, args.out, prepare.PrepareConfig(**settings), args.force)
        except FileExistsError as e:
            print(e, file=sys.stderr)
            return 2
        return 0
    if args.job == "calibrate":
        settings = config.overridden(config.load(args.config) if args.config else {}, args.set)
        calibrate.run(spark, args.train, args.out, calibrate.CalibrationConfig(**settings), args.force)
        return 0
    if args.job == "finish":
        manifest, records = config.load(args.manifest), spark.read.parquet(args.records)
        seeds = evaluate.guarded(manifest["generation"], records)
        evaluate.resumed(manifest, f"{args.out}/evaluation_manifest.json")
        try:
            evaluate.finished(spark.read.parquet(args.log), records, seeds, args.out)
        except evaluate.Incomplete as e:
            print(e, file=sys.stderr)
            return 3
        return 0
    if args.job == "summarise":
        rows, stable = (spark.read.json(f"{args.folder}/{name}") for name in ("predictions_canonical", "sample_stability"))
        jsonl.write_report(args.out, evaluate.compact(config.load(f"{args.folder}/metrics.json"), config.load(args.manifest), rows, stable, WEIGHTS))
        return 0
    if args.job == "check-repository":
        errors = repository.inspect(spark, args.folder, args.least_bytes, args.model_type)
        print("\n".join(errors) or "no errors")
        return int(bool(errors))
    rows = last_success(spark.read.parquet(args.log))
    of = lambda name: rows.where(F.col("run_id") == name)
    if args.job == "evaluate":
        out = report.evaluation(of(args.run), WEIGHTS)
        text = report.evaluation_markdown(out, args.run)
    else:
        out = report.comparison(of(args.baseline), of(args.candidate))
        text = report.comparison_markdown(out, (args.baseline, args.candidate))
    jsonl.write_report(f"{args.out}.json", out)
    jsonl.write_text(f"{args.out}.md", text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
