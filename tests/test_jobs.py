"""Hand-checked cases of the two jobs, in batch form and on a stream."""

import pytest

from ampline.functions import rules
from ampline.operators import batch, compare
from ampline.streaming.replay import replay
from ampline.streaming.stateful import session_records

MIN = 60_000
T0 = 1_789_984_800_000
VIN = "TST00000000000001"
SCHEMA = "arrival_seq long, batch long, event_id string, vin string, ts long, event string, energy_wh long, lat double, lon double, charger_type string"


def uid(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def rows(spark, *events):
    """(batch, id, minutes, event, energy[, lat, lon])"""
    data = []
    for i, (b, n, minute, event, energy, *at) in enumerate(events, 1):
        lat, lon = at if at else (37.4, -122.1)
        plug = event == "PLUG_IN"
        data.append((i, b, uid(n), VIN, T0 + int(minute * MIN), event, energy, lat if plug else None, lon if plug else None, "dc_fast" if plug else None))
    df = spark.createDataFrame(data, SCHEMA)
    return df.withColumn("valid", rules.charging_valid()).withColumnRenamed("vin", "key")


def run(df):
    classed = batch.classify(df, batch.CHARGING)
    sessions = batch.sessionize(batch.accepted(classed), batch.CHARGING).orderBy("start_ts").collect()
    return [(r["total_energy_wh"], r["duration_ms"] // MIN, r["close_reason"]) for r in sessions], {r["counter"]: r["n"] for r in batch.counters(classed, batch.CHARGING).collect() if r["n"]}


CASES = {
    "basic": ([(1, 1, 0, "PLUG_IN", 0), (1, 2, 10, "PROGRESS", 2000), (1, 3, 20, "STOP", 500), (1, 4, 25, "UNPLUG", 0)], [(2500, 25, "UNPLUG")], {"sessions_by_close_reason.unplug": 1}),
    "conflict": ([(1, 1, 0, "PLUG_IN", 0), (1, 2, 10, "PROGRESS", 100), (1, 2, 10, "PROGRESS", 900), (1, 2, 10, "PROGRESS", 100), (1, 4, 25, "UNPLUG", 0)], [(100, 25, "UNPLUG")], {"conflicting_duplicates": 1, "duplicate_events": 1, "sessions_by_close_reason.unplug": 1}),
    "gap exactly": ([(1, 1, 0, "PLUG_IN", 0), (1, 2, 30, "PROGRESS", 100), (1, 3, 40, "UNPLUG", 0)], [(100, 40, "UNPLUG")], {"sessions_by_close_reason.unplug": 1}),
    "gap over": ([(1, 1, 0, "PLUG_IN", 0), (1, 2, 30 + 1 / 60_000, "PROGRESS", 100)], [(0, 0, "INACTIVITY_TIMEOUT")], {"orphan": 1, "sessions_by_close_reason.inactivity_timeout": 1}),
    "replaced": ([(1, 1, 0, "PLUG_IN", 0), (1, 2, 5, "PLUG_IN", 0), (1, 3, 10, "UNPLUG", 0)], [(0, 0, "REPLACED_BY_PLUG_IN"), (0, 5, "UNPLUG")], {"sessions_by_close_reason.unplug": 1, "sessions_by_close_reason.replaced_by_plug_in": 1}),
    "late is not remembered": ([(1, 1, 0, "PLUG_IN", 0), (1, 2, 20, "PROGRESS", 50), (2, 3, 10, "PROGRESS", 100), (2, 3, 21, "PROGRESS", 100), (2, 4, 25, "UNPLUG", 0)], [(150, 25, "UNPLUG")], {"late": 1, "sessions_by_close_reason.unplug": 1}),
    "invalid reserves nothing": ([(1, 1, 0, "PLUG_IN", 0), (1, 2, 5, "START", 7), (1, 2, 6, "PROGRESS", 200), (1, 4, 25, "UNPLUG", 0)], [(200, 25, "UNPLUG")], {"rejected": 1, "sessions_by_close_reason.unplug": 1}),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    events, sessions, counts = CASES[name]
    assert run(rows(spark, *events)) == (sessions, counts)


def test_stream_equals_batch(spark, tmp_path):
    df = rows(spark, *CASES["late is not remembered"][0], (3, 7, 30, "PLUG_IN", 0, -33.8675, 0.0005), (3, 8, 40, "PROGRESS", 10))
    done = replay(df, batch.CHARGING, str(tmp_path))
    classed = batch.classify(df, batch.CHARGING)
    golden = batch.sessionize(batch.accepted(classed), batch.CHARGING).select(*batch.SESSION)
    assert compare.record_diff(golden, session_records(done.facts)).count() == 0 and golden.count() == 2
    assert done.drain["drained"] and done.counters()["late"] == 1
    assert compare.coordinate_failures(session_records(done.facts), batch.accepted(classed)).count() == 0


def test_windows_and_alert(spark):
    data = [(i, 1, uid(i), VIN, T0 + m * MIN, soc, 95.0, temp, 400.0) for i, (m, soc, temp) in enumerate([(0, 80.0, 55.0), (5, 70.0, 55.1), (9, 60.0, 30.0)], 1)]
    df = spark.createDataFrame(data, "arrival_seq long, batch long, event_id string, vin string, ts long, soc_pct double, soh_pct double, cell_temp_max_c double, pack_voltage_v double")
    df = df.withColumn("valid", rules.battery_valid()).withColumnRenamed("vin", "key")
    found = batch.battery_windows(batch.accepted(batch.classify(df, batch.BATTERY)), batch.BATTERY).orderBy("window_start").collect()
    assert [(r["avg_soc_pct"], r["alert"], r["event_count"]) for r in found] == [(80.0, False, 1), (65.0, True, 2)]


def test_rounding_and_identity(spark):
    df = spark.createDataFrame([(-33.8675, "A" * 17), (0.0005, "A" * 17 + "\n"), (-0.0004, "a" * 17)], "x double, vin string")
    got = df.select(rules.round3(df.x).alias("r"), rules.is_vin(df.vin).alias("v")).collect()
    assert [r["r"] for r in got] == [-33.868, 0.001, 0.0] and [r["v"] for r in got] == [True, False, False]
    assert str(got[2]["r"]) == "0.0"


def test_parity_has_teeth(spark):
    df = rows(spark, *CASES["basic"][0])
    classed = batch.classify(df, batch.CHARGING)
    golden = batch.sessionize(batch.accepted(classed), batch.CHARGING).select(*batch.SESSION)
    counts = batch.counters(classed, batch.CHARGING)
    twice = golden.withColumn("total_energy_wh", golden.total_energy_wh * 2)
    assert compare.parity(golden, golden, counts, counts, True)["status"] == "PASS"
    assert compare.parity(golden, twice, counts, counts, True)["status"] == "FAIL"
    assert compare.parity(golden, golden, counts, counts, False)["status"] == "REFUSED"
