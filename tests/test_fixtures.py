"""Fixture format, suites and their artifacts, the codec, configuration and digests."""

import json

import pytest
from pyspark.sql import functions as F

from ampline import manifest, suite
from ampline.sources import codec, fixtures, kafka
from tests.test_jobs import CASES, MIN, T0, VIN, rows, uid

JOB = "charging-sessions"


def line(seq, batch, **message):
    return json.dumps({"arrival_seq": seq, "batch": batch, "message": {"event_id": uid(seq), "vin": VIN, "ts": T0 + seq * MIN, "event": "START", "energy_wh": 0} | message})


def flush(batch, seq):
    return json.dumps({"advance_watermark_to": T0 + seq * MIN + fixtures.HOUR, "batch": batch})


GOOD = [line(1, 1, event="PLUG_IN", lat=37.4, lon=-122, charger_type="ac"), line(2, 1), line(3, 2, event="STOP", energy_wh=5), flush(3, 3)]

BAD = {
    "not a JSON object": [*GOOD[:2], "{", *GOOD[3:]],
    "event line: wrong keys": [GOOD[0].replace('"batch"', '"lot"'), *GOOD[1:]],
    "arrival_seq is not a positive integer": [GOOD[0].replace('"arrival_seq": 1', '"arrival_seq": 1.0'), *GOOD[1:]],
    "message has an unknown key": [*GOOD[:2], line(3, 2, extra=1), GOOD[3]],
    "charger_type is not a string": [*GOOD[:2], line(3, 2, charger_type=None), GOOD[3]],
    "ts is not a bigint": [*GOOD[:2], line(3, 2, ts=str(T0)), GOOD[3]],
    "unknown event name": [*GOOD[:2], line(3, 2, event="NAP"), GOOD[3]],
    "batches leave a gap": [*GOOD[:2], line(3, 3), flush(4, 3)],
    "arrival_seq does not rise by 1": [GOOD[1], GOOD[0], *GOOD[2:]],
    "not exactly one flush line": GOOD[:3],
    "the flush line is not last": [*GOOD[:2], GOOD[3], GOOD[2]],
    "flush batch is not the last batch + 1": [*GOOD[:3], flush(4, 3)],
    "flush target is not the largest valid ts + 1 hour": [*GOOD[:3], flush(3, 2)],
}


def save(path, lines):
    path.write_text("".join(text + "\n" for text in lines))
    return str(path)


def test_good_fixture(spark, tmp_path):
    f = fixtures.load(spark, save(tmp_path / "f.jsonl", GOOD), JOB)
    got = f.rows.orderBy("arrival_seq").collect()
    assert [r["valid"] for r in got] == [True, True, True] and got[0]["lon"] == -122.0 and got[1]["lat"] is None
    assert (f.target, f.flush_batch) == (T0 + 3 * MIN + fixtures.HOUR, 3)


@pytest.mark.parametrize("problem", BAD)
def test_bad_fixture(spark, tmp_path, problem):
    with pytest.raises(ValueError, match=problem.replace("+", r"\+")):
        fixtures.load(spark, save(tmp_path / "f.jsonl", BAD[problem]), JOB)


def test_written_fixture_reads_back(spark, tmp_path):
    df = rows(spark, *CASES["late is not remembered"][0])
    fixtures.write(df, JOB, str(tmp_path / "out"))
    back = fixtures.load(spark, str(tmp_path / "out"), JOB).rows.select(*df.columns)
    assert back.exceptAll(df).count() == 0 and back.count() == df.count()


@pytest.fixture
def cases(spark, tmp_path):
    """Two cases, the second with a wrong expectation."""
    for i, (wrong, name) in enumerate([(0, "conflict"), (1, "basic")], 1):
        folder = tmp_path / "suite" / f"{i:02d}-{name}"
        folder.mkdir(parents=True)
        df = rows(spark, *CASES[name][0])
        fixtures.write(df, JOB, str(folder / "lines"))
        part = next((folder / "lines").glob("part-*"))
        (folder / "input.jsonl").write_bytes(part.read_bytes())
        done = suite.run(spark, fixtures.load(spark, str(folder / "input.jsonl"), JOB))
        records = [r.asDict() for r in done.records.collect()]
        assert {k: v for k, v in done.counters.items() if v} == CASES[name][2]
        records[0]["total_energy_wh"] += wrong
        (folder / "expected.json").write_text(json.dumps({"job": JOB, "records": records, "counters": suite.nest(done.counters), "watermarks": {"1": T0 + 15 * MIN}}))
    return tmp_path / "suite"


def test_suite(spark, cases, tmp_path):
    passed, report = suite.run_suite(spark, [str(cases)], str(tmp_path / "out"))
    assert not passed and "1 of 2 cases pass" in report and "total_energy_wh" in report
    assert json.loads((tmp_path / "out/suite/01-conflict/result.json").read_text())["status"] == "PASS"
    assert not suite.run_suite(spark, [str(cases)], str(tmp_path / "out"), job="battery-health")[0]  # none checked


def test_fixture_run_on_a_stream(spark, cases, tmp_path):
    path = str(cases / "01-conflict" / "input.jsonl")
    f = fixtures.load(spark, path, JOB)
    plain, stream = suite.run(spark, f), suite.run(spark, f, str(tmp_path / "work"))
    assert stream.drain["passed"], stream.drain
    assert stream.counters == plain.counters and stream.records.exceptAll(plain.records).count() == 0
    assert suite.write_fixture_run(stream, path, tmp_path / "run", "spark") == "PASS"
    assert {p.name.removeprefix(JOB + ".") for p in (tmp_path / "run").iterdir()} == {"records.jsonl", "counters.json", "trace.jsonl", "drain.json", "result.json", "run.json"}


def test_codec_round_trip(spark):
    pytest.importorskip("google.protobuf")
    df = rows(spark, *CASES["basic"][0]).withColumnRenamed("key", "vin")
    topic = "vehicle.charging.v1"
    names = [f.split(" ")[0] for f in codec.MESSAGES[topic][1]]
    sent = df.select("arrival_seq", codec.encode(spark, F.struct(*names), topic).alias("value"))
    bad = spark.createDataFrame([(99, bytearray(b"\xff\xff")), (100, None)], "arrival_seq long, value binary")
    got = sent.unionByName(bad).select("arrival_seq", codec.decode(spark, F.col("value"), topic).alias("m"))
    assert got.filter("m is null").count() == 2
    assert got.filter("m is not null").select("m.*").exceptAll(df.select(*names)).count() == 0
    raw = sent.unionByName(bad).withColumnRenamed("arrival_seq", "offset")
    assert [r["valid"] for r in kafka.messages(raw, fixtures.SPECS[JOB]).orderBy("arrival_seq").collect()] == [True] * 4 + [False] * 2


def test_kafka_settings():
    own = {"INPUT_TOPIC": "in", "OUTPUT_TOPIC": "out", "GROUP_ID": "g"}
    assert kafka.KafkaConfig.read(own) == kafka.KafkaConfig("localhost:9092", "in", "out", "g", 0, 500, 1000)
    spec = fixtures.SPECS[JOB]
    assert kafka.KafkaConfig.read({}, spec, shadow=True) == kafka.KafkaConfig("localhost:9092", spec.input_topic, spec.output_topic + ".shadow", JOB, 0, 500, 1000)
    for wrong in ({"INPUT_TOPIC": ""}, {"BATCH_MAX_EVENTS": "0"}, {"BATCH_POLL_TIMEOUT_MS": "soon"}, {"INPUT_PARTITION": "-1"}):
        with pytest.raises(ValueError):
            kafka.KafkaConfig.read(own | wrong)


def test_manifest(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_text("1")
    kept = manifest.compute([str(tmp_path / "d"), str(tmp_path / "d" / "x")])
    assert manifest.differences(kept) == []
    (tmp_path / "d" / "x").write_text("2")
    assert len(manifest.differences(kept)) == 2
