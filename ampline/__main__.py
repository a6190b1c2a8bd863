"""python -m ampline fixture|suite|generate|parity|privacy|kafka|manifest ...: exit code 0 passed, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession


def _session() -> SparkSession:
    return SparkSession.builder.appName("ampline").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    from ampline import grading, manifest, suite
    from ampline.sources import fixtures, generate, kafka
    from ampline.sources.folders import scratch

    parser = argparse.ArgumentParser(prog="ampline", allow_abbrev=False)
    modes = parser.add_subparsers(dest="mode", required=True)
    one = modes.add_parser("fixture", help="replay one fixture and write its artifacts")
    one.add_argument("fixture", metavar="JOB=PATH")
    many = modes.add_parser("suite", help="run and grade folders of cases")
    many.add_argument("suites", nargs="+")
    many.add_argument("--job", choices=sorted(fixtures.SPECS))
    for p in (one, many):
        p.add_argument("--out", required=True)
        p.add_argument("--stream", action="store_true", help="on a stream instead of as a batch plan")
    live = modes.add_parser("kafka", help="run a job over Kafka, configured by the environment")
    live.add_argument("job", choices=sorted(fixtures.SPECS))
    live.add_argument("--checkpoint", required=True)
    live.add_argument("--counters-out", help="file of running totals, written after each micro-batch")
    live.add_argument("--shadow", action="store_true", help="write to the output topic's .shadow topic")
    made = modes.add_parser("generate", help="write a seeded fixture")
    made.add_argument("job", choices=sorted(fixtures.SPECS))
    made.add_argument("path")
    made.add_argument("--seed", type=int, default=1)
    made.add_argument("--vehicles", type=int, default=40)
    for mode, what in (("parity", "compare a finished run with a golden one"), ("privacy", "hold a finished run against the policy")):
        p = modes.add_parser(mode, help=what)
        p.add_argument("job", choices=sorted(fixtures.SPECS))
        p.add_argument("--run", required=True)
        p.add_argument("--report")
        if mode == "parity":
            p.add_argument("--golden", required=True)
            p.add_argument("--manifest", required=True)
        else:
            p.add_argument("--policy", required=True, help="folder of the policy's three files")
            p.add_argument("--fixture", required=True)
    sums = modes.add_parser("manifest", help="write or compare digests of files and folders")
    sums.add_argument("manifest")
    sums.add_argument("paths", nargs="*", help="to write; none: compare")
    args = parser.parse_args(argv)

    if args.mode == "manifest":
        path = Path(args.manifest)
        if args.paths:
            path.write_text(json.dumps(manifest.compute(args.paths), indent=2) + "\n")
            return 0
        found = manifest.differences(json.loads(path.read_text()))
        print("\n".join(found) or "no difference")
        return int(bool(found))
    if args.mode == "kafka":
        spec = fixtures.SPECS[args.job]
        try:
            config = kafka.KafkaConfig.read(os.environ, spec, args.shadow)
        except ValueError as bad:
            parser.error(str(bad))
        kafka.start(_session(), spec, config, args.checkpoint, args.counters_out).awaitTermination()
        return 0
    spark = _session()
    if args.mode == "generate":
        done = generate.generate(spark, args.job, args.path, args.seed, args.vehicles)
        print(json.dumps(done.summary | {"sha256": done.sha256}, indent=2))
        return 0
    if args.mode in ("parity", "privacy"):
        if args.mode == "parity":
            report = grading.parity(spark, args.job, args.run, args.golden, json.loads(Path(args.manifest).read_text()))
        else:
            report = grading.privacy(spark, args.job, args.run, grading.read_policy(args.policy), args.fixture)
        Path(args.report or f"{args.run}/{args.job}.{args.mode}.md").write_text(report.markdown())
        print(report.markdown())
        return 0 if report.status == "PASS" else 1
    folder = scratch(spark) if args.stream else None
    if args.mode == "suite":
        passed, report = suite.run_suite(spark, args.suites, args.out, args.job, folder)
        (Path(args.out) / "suite.md").write_text(report)
        print(report)
        return 0 if passed else 1
    job, _, path = args.fixture.partition("=")
    if job not in fixtures.SPECS or not path:
        parser.error("the fixture is JOB=PATH, with a known job")
    try:
        fixture = fixtures.load(spark, path, job)
    except ValueError as bad:
        print(bad, file=sys.stderr)
        return 1
    status = suite.write_fixture_run(suite.run(spark, fixture, folder), path, Path(args.out), "spark")
    print(status)
    return 0 if status == "PASS" else 1


if __name__ == "__main__":
    sys.exit(main())
