"""Runs fixtures and suites of cases, writes their artifacts, grades them and reports in Markdown."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.operators import batch, compare
from ampline.operators.batch import BATTERY, JobSpec
from ampline.sources import fixtures
from ampline.streaming.replay import replay
from ampline.streaming.stateful import session_records, window_records

TOLERANCES = {BATTERY.name: {"avg_soc_pct": 1e-9}}
RECORD_DDL = {
    batch.CHARGING.name: "output_id string, vin string, start_ts bigint, end_ts bigint, duration_ms bigint, total_energy_wh bigint, start_lat double, start_lon double, charger_type string, close_reason string",
    BATTERY.name: "output_id string, vin string, window_start bigint, avg_soc_pct double, min_soh_pct double, max_cell_temp_c double, alert boolean, event_count bigint",
}


@dataclass
class Outcome:
    spec: JobSpec
    records: DataFrame
    counters: dict
    trace: list[dict]
    drain: dict
    failures: list[str] = field(default_factory=list)


def nest(flat: dict[str, int]) -> dict:
    """Dotted counters as nested objects."""
    out: dict = {}
    for name, n in flat.items():
        *parents, leaf = name.split(".")
        at = out
        for p in parents:
            at = at.setdefault(p, {})
        at[leaf] = n
    return out


def flatten(nested: dict, prefix: str = "") -> dict[str, int]:
    out = {}
    for k, v in nested.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {prefix + k: v}
    return out


def _ordered(counters: dict[str, int], spec: JobSpec) -> dict[str, int]:
    names = list(batch.COUNTERS)
    if spec.name != BATTERY.name:
        names += ["orphan", *(f"sessions_by_close_reason.{r.lower()}" for r in batch.CLOSE_REASONS)]
    return {n: counters.get(n, 0) for n in names}


def _emitted(records: DataFrame, spec: JobSpec, marks: DataFrame) -> DataFrame:
    if spec.name == BATTERY.name:
        return batch.emission_batch(records, F.col("window_start") + spec.window_ms, F.lit(False), marks)
    reason = F.col("close_reason")
    due = F.when(reason == "UNPLUG", F.col("end_ts")).when(reason == "REPLACED_BY_PLUG_IN", F.col("next_ts")).otherwise(F.col("end_ts") + spec.gap_ms)
    return batch.emission_batch(records, due, reason == "INACTIVITY_TIMEOUT", marks)


def run(spark: SparkSession, fixture: fixtures.Fixture, folder: str | None = None) -> Outcome:
    """Records, counters, trace and drain evidence; on a stream where folder is given, else as a batch plan."""
    spec = fixture.spec
    classed = batch.classify(fixture.rows, spec)
    own = batch.accepted(classed).filter(F.col("key") != batch.rules.RESERVED_VIN)
    full = batch.battery_windows(own, spec) if spec.name == BATTERY.name else batch.sessionize(own, spec)
    records = full.select(*batch.ALLOWED[spec.name])
    flat = {r["counter"]: r["n"] for r in batch.counters(classed, spec).collect()}
    marks = batch.watermarks(fixture.rows, spec)
    emitted = {r["emitted"]: r["n"] for r in _emitted(full, spec, marks).groupBy("emitted").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = classed.groupBy("batch").agg(F.min("arrival_seq").alias("lo"), F.max("arrival_seq").alias("hi"), F.count(F.when(F.col("class") == "late", 1)).alias("late")).join(marks, "batch").orderBy("batch")
    trace = [
        {"batch": r["batch"], "kind": "events", "arrival_seqs": list(range(r["lo"], r["hi"] + 1)), "watermark_in_effect": r["wm_in"], "watermark_after": r["wm_after"], "num_rows_dropped_by_watermark": r["late"], "records_emitted": emitted.get(r["batch"], 0)}
        for r in per.collect()
    ]
    before = trace[-1]["watermark_after"]
    trace.append({"batch": fixture.flush_batch, "kind": "flush", "arrival_seqs": [], "watermark_in_effect": before, "watermark_after": fixture.target, "num_rows_dropped_by_watermark": 0, "records_emitted": 0})
    trace.append({"batch": fixture.flush_batch + 1, "kind": "empty", "arrival_seqs": [], "watermark_in_effect": fixture.target, "watermark_after": fixture.target, "num_rows_dropped_by_watermark": 0, "records_emitted": emitted.get(None, 0)})
    drain = {"passed": True, "final_watermark": fixture.target, "target_watermark": fixture.target, "failures": []}
    if folder is None:
        return Outcome(spec, records, _ordered(flat, spec), trace, drain)

    done = replay(fixture.rows, spec, folder)
    records = window_records(done.facts, spec) if spec.name == BATTERY.name else session_records(done.facts)
    flat = done.counters()
    if spec.name != BATTERY.name:
        for r in records.groupBy("close_reason").agg(F.count(F.lit(1)).alias("n")).collect():
            flat[f"sessions_by_close_reason.{r['close_reason'].lower()}"] = r["n"]
    keys = classed.filter("class not in ('rejected', 'late')").agg(F.countDistinct("key")).first()[0] + 1
    failures, after = [], None
    dropped, late = done.dropped(), 0
    by_batch: dict[int, list[dict]] = {}
    for t in done.trace:
        by_batch.setdefault(t["batch"], []).append(t)
    lates = {t["batch"]: t["num_rows_dropped_by_watermark"] for t in trace}
    for t in trace:  # what the stream itself did
        own = by_batch.get(t["batch"], [])
        if t["kind"] != "empty":
            t |= {"watermark_in_effect": after, "num_rows_dropped_by_watermark": dropped.get(t["batch"], 0), "microbatches": own}
            after = t["watermark_after"] = own[-1]["watermark"] if own else after
        late += t["num_rows_dropped_by_watermark"]
    late += done.facts.filter("kind = 'counter' and counter = 'late'").count()  # the engine's filter can lag a batch
    if late != sum(lates.values()):
        failures.append(f"{late} late rows on the stream, {sum(lates.values())} by the rules")
    busy = {r["key"]: r["busy"] for r in done.busy().filter(F.col("busy") | (F.col("key") == batch.rules.RESERVED_VIN)).limit(1000).collect()}
    if not busy.pop(batch.rules.RESERVED_VIN, False):
        failures.append("the reserved key holds no control row")
    failures += [f"{k} is still busy" for k in sorted(busy)[:5]]
    if done.drain["watermark"] != fixture.target:
        failures.append(f"watermark {done.drain['watermark']} is not the target {fixture.target}")
    if done.drain["state_rows"] != keys:
        failures.append(f"{done.drain['state_rows']} state rows, {keys} keys with state")
    drain = {"passed": not failures, "final_watermark": done.drain["watermark"], "target_watermark": fixture.target, "state_rows_total_last_progress": done.drain["state_rows"], "vins_reached_state_plus_reserved": keys, "failures": failures}
    return Outcome(spec, records, _ordered(flat, spec), trace, drain, failures)


def _json(path: Path, value) -> None:
    path.write_text(json.dumps(value, indent=2) + "\n")


def write_fixture_run(outcome: Outcome, fixture_path: str, out: Path, engine: str) -> str:
    """The six artifacts of a fixture; returns the status."""
    out.mkdir(parents=True, exist_ok=True)
    name = outcome.spec.name
    with (out / f"{name}.records.jsonl").open("w") as f:
        for r in outcome.records.orderBy("output_id").toLocalIterator():
            f.write(json.dumps(r.asDict()) + "\n")
    status = "REFUSED" if not outcome.drain["passed"] else "PASS"
    _json(out / f"{name}.counters.json", nest(outcome.counters))
    (out / f"{name}.trace.jsonl").write_text("".join(json.dumps(t) + "\n" for t in outcome.trace))
    _json(out / f"{name}.drain.json", outcome.drain)
    _json(out / f"{name}.result.json", {"job": name, "status": status, "failures": outcome.failures})
    digest = hashlib.sha256(Path(fixture_path).read_bytes()).hexdigest()
    _json(out / f"{name}.run.json", {"job": name, "engine": engine, "fixture_sha256": digest, "output_topics": [outcome.spec.output_topic], "watermark_delay_ms": outcome.spec.delay_ms, "replay": {"pyspark": pyspark.__version__}})
    return status


def discover(folder: str) -> list[Path]:
    """Case folders NN-slug in order of name."""
    return sorted(p for p in Path(folder).iterdir() if p.is_dir() and re.fullmatch(r"\d\d-.+", p.name))


def grade(spark: SparkSession, outcome: Outcome, expected: dict) -> list[str]:
    """What differs from the expected result; empty when all is equal."""
    if not outcome.drain["passed"]:
        return ["REFUSED: not drained"]
    name = outcome.spec.name
    # createDataFrame verifies types, so an int where a double belongs is refused
    golden = spark.createDataFrame([tuple(r[c] for c in batch.ALLOWED[name]) for r in expected["records"]], RECORD_DDL[name])
    found = [f"{r['n']} records with output_id {r['output_id']}" for r in compare.repeated(outcome.records).limit(5).collect()]
    found += [f"{r['status']} {r['output_id']} {r['fields']}".strip() for r in compare.record_diff(golden, outcome.records, tolerances=TOLERANCES.get(name)).orderBy("output_id").limit(5).collect()]
    want = flatten(expected["counters"])
    found += [f"counter {k}: expected {want.get(k)}, got {outcome.counters.get(k)}" for k in sorted(want.keys() | outcome.counters.keys()) if want.get(k) != outcome.counters.get(k)]
    after = {str(t["batch"]): t["watermark_after"] for t in outcome.trace}
    found += [f"batch {b} should leave the watermark at {w}, not {after.get(b)}" for b, w in expected.get("watermarks", {}).items() if after.get(b) != w]
    return found


def run_suite(spark: SparkSession, suites: list[str], out: str, job: str | None = None, folder: str | None = None) -> tuple[bool, str]:
    """(passed, Markdown report) over every case of the suites; with job, over those that name it.

    Each case leaves outputs.json, trace.jsonl, drain.json and result.json under
    out/suite/case. A run over no case fails.
    """
    lines, checked, failed = ["# Suite", "", "| case | job | result |", "| --- | --- | --- |"], 0, 0
    for suite in suites:
        for case in discover(suite):
            expected = json.loads((case / "expected.json").read_text())
            if job not in (None, expected["job"]):
                continue
            checked += 1
            target = Path(out) / Path(suite).name / case.name
            target.mkdir(parents=True, exist_ok=True)
            try:
                outcome = run(spark, fixtures.load(spark, str(case / "input.jsonl"), expected["job"]), folder)
            except ValueError as bad:
                found, status = [str(bad)], "REFUSED"
            else:
                found = grade(spark, outcome, expected)
                status = "REFUSED" if not outcome.drain["passed"] else "FAIL" if found else "PASS"
                rows = [r.asDict() for r in outcome.records.orderBy("output_id").collect()]  # a case is a few lines
                _json(target / "outputs.json", {"job": expected["job"], "records": rows, "counters": nest(outcome.counters)})
                (target / "trace.jsonl").write_text("".join(json.dumps(t) + "\n" for t in outcome.trace))
                _json(target / "drain.json", outcome.drain)
            _json(target / "result.json", {"job": expected["job"], "status": status, "failures": found})
            failed += bool(found)
            lines.append(f"| {case.name} | {expected['job']} | {status}{': ' + '; '.join(found[:5]) if found else ''} |")
    lines += ["", f"{checked - failed} of {checked} cases pass."]
    return checked > 0 and failed == 0, "\n".join(lines) + "\n"
