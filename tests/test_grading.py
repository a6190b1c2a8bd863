"""Seeded fixtures, and grading of finished runs: altered ones fail, undrained ones are refused."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from ampline import grading, manifest, suite
from ampline.sources import codec, fixtures, generate, kafka

JOB = "charging-sessions"
POLICY = {
    "fields": {"review": {"status": "test"}, "topics": {"charging.sessions.v1": {f: "location" if f in ("start_lat", "start_lon") else "none" for f in suite.batch.ALLOWED[JOB]}}},
    "field-map": {JOB: {"assertions": [{"output": f"start_{x}", "source_event": "PLUG_IN", "source_field": x} for x in ("lat", "lon")]}},
    "output-allowlist": {"jobs": {JOB: {"charging.sessions.v1": list(suite.batch.ALLOWED[JOB])}}},
}


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    """A run over a generated fixture, and the baseline that pins it."""
    top = tmp_path_factory.mktemp("graded")
    done = generate.generate(spark, JOB, f"{top}/in.jsonl", seed=5, vehicles=12)
    f = fixtures.load(spark, done.path, JOB)
    assert suite.write_fixture_run(suite.run(spark, f), done.path, top / "golden", "spark") == "PASS"
    return top, done, {"fixtures": {JOB: {"sha256": done.sha256}}, "replay": {"watermark_delay_ms": {JOB: f.spec.delay_ms}}}


@pytest.mark.parametrize("job", sorted(fixtures.SPECS))
def test_generated_rows_are_of_the_class_meant(spark, tmp_path, job):
    done = generate.generate(spark, job, f"{tmp_path}/a.jsonl", seed=3, vehicles=12)
    again = generate.generate(spark, job, f"{tmp_path}/b.jsonl", seed=3, vehicles=12)
    other = generate.generate(spark, job, f"{tmp_path}/c.jsonl", seed=4, vehicles=12)
    assert done.sha256 == again.sha256 != other.sha256
    assert set(done.summary["intents"]) == {"accepted", "rejected", "late", "duplicate", "conflicting"}
    assert {"late", "duplicate", "conflict", "at_watermark", "after_watermark"} < set(done.summary["cases"]) and len(done.summary["cases"]) >= 15
    if job == JOB:
        assert set(done.summary["scenarios"]) == set(generate.SCENARIOS) and done.summary["exact_halves"] > 5


def test_wrong_intents_are_found(spark):
    rows = generate.rows_of(spark, fixtures.SPECS[JOB], 3, 8)
    assert generate.check(rows.withColumn("intent", F.when(F.col("case") == "late", "accepted").otherwise(F.col("intent"))), fixtures.SPECS[JOB])


def test_parity(spark, finished, tmp_path):
    top, _, baseline = finished
    run = tmp_path / "run"
    shutil.copytree(top / "golden", run)
    same = grading.parity(spark, JOB, str(run), str(top / "golden"), baseline)
    assert same.status == "PASS" and len(same.checks) == 6
    path = run / f"{JOB}.records.jsonl"
    lines = path.read_text().splitlines()
    first = json.loads(lines[0])
    path.write_text("\n".join([json.dumps(first | {"total_energy_wh": first["total_energy_wh"] + 1}), *lines[2:]]) + "\n")
    changed = grading.parity(spark, JOB, str(run), str(top / "golden"), baseline)
    assert changed.status == "FAIL" and [c[0] for c in changed.checks] == ["PASS"] * 4 + ["FAIL", "PASS"] and "2 problems" in changed.markdown()
    path.write_text("\n".join([*lines, lines[0]]) + "\n")
    assert [c[0] for c in grading.parity(spark, JOB, str(run), str(top / "golden"), baseline).checks][-1] == "FAIL"
    (run / f"{JOB}.drain.json").write_text(json.dumps({"passed": False, "failures": ["TSTV1 is still busy"]}))
    refused = grading.parity(spark, JOB, str(run), str(top / "golden"), baseline)
    assert refused.status == "REFUSED" and len(refused.checks) == 2 and "NOT RUN" in refused.markdown()
    other = baseline | {"fixtures": {JOB: {"sha256": "0"}}}
    assert grading.parity(spark, JOB, str(run), str(top / "golden"), other).status == "REFUSED"


def test_privacy(spark, finished, tmp_path):
    top, done, _ = finished
    (tmp_path / "policy").mkdir()
    for name, body in POLICY.items():
        (tmp_path / "policy" / f"{name}.json").write_text(json.dumps(body))
    policy = grading.read_policy(str(tmp_path / "policy"))
    good = grading.privacy(spark, JOB, str(top / "golden"), policy, done.path)
    assert good.status == "PASS" and len(good.checks) == 4, good.markdown()
    run = tmp_path / "run"
    shutil.copytree(top / "golden", run)
    path = run / f"{JOB}.records.jsonl"
    lines = [json.loads(x) for x in path.read_text().splitlines()]
    lines[0] |= {"start_lat": lines[0]["start_lat"] + 0.001, "lat": 1.5}
    path.write_text("\n".join(map(json.dumps, lines)) + "\n")
    bad = grading.privacy(spark, JOB, str(run), policy, done.path)
    assert [c[0] for c in bad.checks] == ["PASS", "PASS", "FAIL", "FAIL"]
    bare = policy | {"field-map": {JOB: {"assertions": []}}}
    assert grading.privacy(spark, JOB, str(top / "golden"), bare, done.path).checks[0][0] == "FAIL"


def test_two_runs_leave_the_same_bytes(spark, finished, tmp_path):
    top, done, _ = finished
    suite.write_fixture_run(suite.run(spark, fixtures.load(spark, done.path, JOB)), done.path, tmp_path / "again", "spark")
    assert manifest.digest(top / "golden") == manifest.digest(tmp_path / "again")


def test_one_message_there_and_back_through_a_memory_sink(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spec = fixtures.SPECS[JOB]
    sent = generate.charging_base(spark, 1, 1).limit(1)
    names = [f.split(" ")[0] for f in codec.MESSAGES[spec.input_topic][1]]
    bytes_ = sent.select(F.lit(1).cast("long").alias("offset"), codec.encode(spark, F.struct(*names), spec.input_topic).alias("value"))
    bytes_.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(bytes_.schema).parquet(str(tmp_path / "in"))
    query = kafka.messages(stream, spec).writeStream.format("memory").queryName("smoke").start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("smoke").withColumnRenamed("key", "vin").select(*names)
    assert got.exceptAll(sent.select(*names)).count() == 0 and got.count() == 1


def test_running_totals(spark, tmp_path):
    facts = spark.createDataFrame([("counter", "late", None), ("record", None, "UNPLUG"), ("state", None, None), ("counter", "late", None)], "kind string, counter string, close_reason string")
    totals = kafka.CounterFile(spark, f"{tmp_path}/totals.json")
    for batch_id in (0, 0, 1):
        totals.add(facts, batch_id)
    assert json.loads((tmp_path / "totals.json").read_text()) == {"late": 4, "sessions_by_close_reason.unplug": 2}


def test_energy_for_display(spark):
    assert spark.range(1).select(generate.kilowatt_hours(F.lit(2500))).first()[0] == 2.5
