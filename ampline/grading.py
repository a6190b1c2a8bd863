"""Grades finished runs from their artifacts: parity with a golden run, and the privacy policy.

Records are read and joined as DataFrames; a check reports how much is wrong and the
first few cases. Checks run in order: one that refuses stops those after it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.functions import rules
from ampline.operators import batch, compare
from ampline.sources import fixtures
from ampline.sources.generate import exact_half
from ampline.suite import RECORD_DDL, TOLERANCES, flatten

SHOWN = 5


@dataclass
class Report:
    title: str
    wanted: tuple[str, ...]
    checks: list[tuple[str, str, str, list[str]]] = field(default_factory=list)

    def add(self, detail: str, problems: list[str], total: int | None = None, severity: str = "FAIL") -> bool:
        """Notes the next check; whether it passed."""
        name = self.wanted[len(self.checks)]
        n = len(problems) if total is None else total
        self.checks.append((severity if n else "PASS", name, f"{detail}; {n} problems" if n else detail, problems[:SHOWN]))
        return not n

    @property
    def status(self) -> str:
        found = {c[0] for c in self.checks}
        return "REFUSED" if "REFUSED" in found else "FAIL" if "FAIL" in found or len(self.checks) < len(self.wanted) else "PASS"

    def markdown(self) -> str:
        rows = [f"| {s} | {name} | {'; '.join([detail, *problems])} |" for s, name, detail, problems in self.checks]
        rows += [f"| NOT RUN | {name} | an earlier check stopped the run |" for name in self.wanted[len(self.checks) :]]
        return "\n".join([f"# {self.title}: {self.status}", "", "| result | check | |", "| --- | --- | --- |", *rows]) + "\n"


def _load(folder: str, job: str, kind: str) -> dict:
    return json.loads(Path(folder, f"{job}.{kind}.json").read_text())


def records(spark: SparkSession, folder: str, job: str) -> DataFrame:
    return spark.read.schema(RECORD_DDL[job]).option("mode", "FAILFAST").json(f"{folder}/{job}.records.jsonl")


def _counters(spark: SparkSession, nested: dict) -> DataFrame:
    return spark.createDataFrame(sorted(flatten(nested).items()), "counter string, n bigint")


def _first(df: DataFrame) -> list[str]:
    return [" ".join(str(v) for v in r) for r in df.orderBy(*df.columns[:1]).limit(SHOWN).collect()]


def parity(spark: SparkSession, job: str, run: str, golden: str, baseline: dict) -> Report:
    """baseline: fixtures.<job>.sha256, replay.watermark_delay_ms.<job>, and what else replay names that the run's replay has too."""
    report = Report(f"Parity of {job}", ("frozen baseline", "drain", "own result", "unique ids", "records", "counters"))
    meta = _load(run, job, "run")
    settings = {k: v for k, v in flatten(baseline.get("replay", {})).items() if not k.startswith("watermark_delay_ms.")}
    own = flatten(meta.get("replay") or {})
    wanted = [("job", job, meta.get("job")), ("fixture_sha256", baseline["fixtures"][job]["sha256"], meta.get("fixture_sha256")), ("watermark_delay_ms", baseline["replay"]["watermark_delay_ms"][job], meta.get("watermark_delay_ms"))]
    wanted += [(f"replay.{k}", v, own.get(k)) for k, v in sorted(settings.items())]
    if not report.add(f"{len(wanted)} settings", [f"{k}: {a} pinned, {b} in the run" for k, a, b in wanted if a != b], severity="REFUSED"):
        return report
    drain = _load(run, job, "drain")
    if not report.add("drained", drain["failures"] or ([] if drain["passed"] else ["not drained"]), severity="REFUSED"):
        return report
    result = _load(run, job, "result")
    report.add(f"the run says {result['status']}", [] if result["status"] == "PASS" else [result["status"], *result.get("failures", [])])
    mine, theirs = records(spark, run, job), records(spark, golden, job)
    twice = compare.repeated(mine).withColumn("of", F.lit("run")).unionByName(compare.repeated(theirs).withColumn("of", F.lit("golden")))
    if not report.add(f"{mine.count()} records, {theirs.count()} golden", _first(twice), twice.count()):
        return report
    diff = compare.record_diff(theirs, mine, tolerances=TOLERANCES.get(job))
    report.add("joined by output_id", _first(diff), diff.count())
    unequal = compare.counter_diff(_counters(spark, _load(golden, job, "counters")), _counters(spark, _load(run, job, "counters")))
    report.add("each counter", _first(unequal), unequal.count())
    return report


def read_policy(folder: str) -> dict[str, dict]:
    """The policy's files fields, field-map and output-allowlist, YAML or JSON."""
    out = {}
    for name in ("fields", "field-map", "output-allowlist"):
        path = next(p for s in ("json", "yaml") if (p := Path(folder, f"{name}.{s}")).exists())
        if path.suffix == ".json":
            out[name] = json.loads(path.read_text())
        else:
            import yaml

            out[name] = yaml.safe_load(path.read_text())
    return out


def policy_problems(spark: SparkSession, job: str, policy: dict[str, dict]) -> DataFrame:
    """(problem): allowed fields without a class, and location fields that nothing asserts."""
    allowed = [(t, f) for t, names in policy["output-allowlist"]["jobs"][job].items() for f in names]
    topics = {t for t, _ in allowed} | set(policy["output-allowlist"]["jobs"][job])
    classes = [(t, f, c) for t, fields in policy["fields"]["topics"].items() if t in topics for f, c in fields.items()]
    asserted = [(a["output"],) for a in policy["field-map"][job]["assertions"]]
    allow = spark.createDataFrame(allowed, "topic string, field string")
    known = spark.createDataFrame(classes, "topic string, field string, class string")
    sure = spark.createDataFrame(asserted, "field string")
    unknown = allow.join(known, ["topic", "field"], "left_anti").select(F.concat_ws(" ", "topic", "field", F.lit("has no class")).alias("problem"))
    bare = known.filter("class = 'location'").join(sure, "field", "left_anti").select(F.concat_ws(" ", "topic", "field", F.lit("is a location without an assertion")).alias("problem"))
    return unknown.unionByName(bare)


def privacy(spark: SparkSession, job: str, run: str, policy: dict[str, dict], fixture: str) -> Report:
    report = Report(f"Privacy of {job}", ("policy", "topics", "fields", "coordinates"))
    allowed = policy["output-allowlist"]["jobs"][job]
    wrong = policy_problems(spark, job, policy)
    report.add(f"review: {policy['fields'].get('review', {}).get('status')}", _first(wrong), wrong.count())
    declared = _load(run, job, "run")["output_topics"]
    named = [r["t"] for r in spark.createDataFrame([(t,) for t in declared], "t string").select(rules.topic_name(F.col("t")).alias("t")).collect()]
    bad = [f"{t} is not allowed" for t in named if t not in allowed] + ([f"{len(named)} topics instead of one"] if len(named) != 1 else [])
    if not report.add(", ".join(declared), bad):
        return report
    path = f"{run}/{job}.records.jsonl"
    keys = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("field")).groupBy("field").count()
    extra = keys.filter(~F.col("field").isin(list(allowed[named[0]])))
    report.add(f"{len(allowed[named[0]])} fields allowed", _first(extra), extra.count())
    assertions = policy["field-map"][job]["assertions"]
    if not assertions:
        report.add("none to assert", [])
        return report
    taken = batch.accepted(batch.classify(fixtures.load(spark, fixture, job).rows, fixtures.SPECS[job]))
    checked, problems = None, []
    for a in assertions:
        source = taken.filter(F.col("event") == a["source_event"]).select(rules.session_output_id(F.col("event_id")).alias("output_id"), F.col(a["source_field"]).alias("raw"))
        found = records(spark, run, job).select("output_id", F.col(a["output"]).alias("got")).join(source, "output_id", "left")
        ok = F.col("raw").isNotNull() & F.col("got").eqNullSafe(rules.round3(F.col("raw")))
        tally = found.agg(F.count("raw").alias("n"), F.count(F.when(F.col("raw") < 0, 1)).alias("negative"), F.count(F.when(exact_half(F.abs("raw")), 1)).alias("halves"), F.count(F.when(~ok, 1)).alias("bad")).first()
        checked = [x + y for x, y in zip(checked or [0] * 4, tally, strict=True)]
        problems += [f"{a['output']} of {x}" for x in _first(found.filter(~ok))]
    report.add("{} checked, {} negative, {} exact halves".format(*checked[:3]), problems, checked[3])
    return report
