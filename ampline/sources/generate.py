"""Seeded replay fixtures as DataFrames: ordinary traffic, and rows made to be rejected, late, copies or conflicts.

Every number is a hash of the seed, a name and the row's identity, so a fixture does not
depend on how it is partitioned and the same seed gives the same bytes. Each row
carries the class it is meant to have; check() classifies the finished rows and
names those that came out otherwise.

An ordinary row arrives less than half the job's watermark delay after its time, a
copy less than half the delay after its original; so neither is late. A late row
arrives four hours after its time.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampline.functions import rules
from ampline.operators import batch, compare
from ampline.operators.batch import BATTERY, CHARGING, JobSpec
from ampline.sources import fixtures
from ampline.sources.folders import scratch

START = 1_767_225_600_000  # 2026-01-01 00:00 UTC
MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
SLOT = 30 * MINUTE
MOST_BYTES = 5_000_000
SCENARIOS = ("plain", "resume", "replace", "no_unplug", "gap_exact", "gap_over", "midnight")
PLACES = ("half", "half_negative", "six_decimals", "short", "edge")
#: One broken rule each: the columns to change and what to.
BROKEN = {
    CHARGING.name: {
        "id_short": {"event_id": "abc"}, "id_upper": {"event_id": "ABCDEFAB-0000-4000-8000-000000000000"}, "vin_short": {"vin": "TSTV1"}, "vin_lower": {"vin": "tstv0000000000001"},
        "ts_early": {"ts": rules.MIN_TS - 1}, "ts_end": {"ts": rules.MAX_TS}, "event_unset": {"event": "EVENT_UNSPECIFIED"}, "energy_negative": {"event": "PROGRESS", "energy_wh": -1}, "energy_on_start": {"event": "START", "energy_wh": 5},
        "no_lat": {"event": "PLUG_IN", "energy_wh": 0, "lon": 1.0, "charger_type": "ac"}, "no_lon": {"event": "PLUG_IN", "energy_wh": 0, "lat": 1.0, "charger_type": "ac"}, "lat_out": {"event": "PLUG_IN", "energy_wh": 0, "lat": 90.5, "lon": 1.0, "charger_type": "ac"},
        "lon_out": {"event": "PLUG_IN", "energy_wh": 0, "lat": 1.0, "lon": -180.5, "charger_type": "ac"}, "no_type": {"event": "PLUG_IN", "energy_wh": 0, "lat": 1.0, "lon": 1.0}, "type_empty": {"event": "PLUG_IN", "energy_wh": 0, "lat": 1.0, "lon": 1.0, "charger_type": ""},
    },
    BATTERY.name: {
        "id_short": {"event_id": "abc"}, "vin_short": {"vin": "TSTV1"}, "ts_early": {"ts": rules.MIN_TS - 1}, "ts_end": {"ts": rules.MAX_TS}, "no_soc": {"soc_pct": None}, "soc_out": {"soc_pct": 100.5}, "no_soh": {"soh_pct": None}, "soh_out": {"soh_pct": -0.5},
        "no_temp": {"cell_temp_max_c": None}, "temp_low": {"cell_temp_max_c": -60.5}, "temp_high": {"cell_temp_max_c": 120.5}, "no_volts": {"pack_voltage_v": None}, "volts_zero": {"pack_voltage_v": 0.0}, "volts_out": {"pack_voltage_v": 1000.5},
    },
}


def draw(seed: int, name: str, n: int, *identity) -> Column:
    """A number from 0 to n - 1."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *identity), F.lit(n))


def unique_id(seed: int, *identity) -> Column:
    """A canonical version 4 UUID; different identities give different ones."""
    h = F.sha2(F.concat_ws("/", F.lit(str(seed)), *[c.cast("string") for c in identity]), 256)
    part = lambda at, n: F.substring(h, at, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("4"), part(13, 3)), F.concat(F.lit("8"), part(16, 3)), part(19, 12))


def vin(number: Column) -> Column:
    return F.concat(F.lit("TSTV"), F.lpad(number.cast("string"), 13, "0"))


def exact_half(x: Column) -> Column:
    """Whether the number's shortest decimal form ends in a 5 at the fourth place."""
    return F.coalesce(F.split_part(x.cast("decimal(18,9)").cast("string"), F.lit("."), F.lit(2)).rlike(r"\A[0-9]{3}50{5}\z"), F.lit(False))


def kilowatt_hours(energy_wh: Column) -> Column:
    """Energy as it is displayed."""
    return energy_wh / 1000


def _place(seed: int, kind: Column, limit: int, name: str, *identity) -> Column:
    """A coordinate: whole numbers divided by a power of ten, so its decimal form is as short as meant."""
    k = draw(seed, name, limit * 1000, *identity)
    return (
        F.when(kind == "half", (k * 10 + 5) / 10_000).when(kind == "half_negative", -(k * 10 + 5) / 10_000).when(kind == "six_decimals", (k * 1000 + draw(seed, name + "6", 1000, *identity)) / 1_000_000)
        .when(kind == "short", k / 100 % limit).otherwise(F.when(k % 2 == 0, float(limit)).otherwise(-float(limit)))
    )


def _events(steps: Column) -> Column:
    """A session's events (minutes from its start, event, energy) and the milliseconds that come on top."""
    e = lambda at, name, wh=0, ms=0: F.struct((at * MINUTE + ms).cast("long").alias("off"), F.lit(name).alias("event"), F.lit(wh).cast("long").alias("energy_wh"))
    charge = F.transform(F.sequence(F.lit(1), steps), lambda i: F.struct((i * 5 * MINUTE).cast("long").alias("off"), F.lit("PROGRESS").alias("event"), (i * 7 + 100).cast("long").alias("energy_wh")))
    end, both = steps * 5, lambda *more: F.concat(F.array(e(F.lit(0), "PLUG_IN"), e(F.lit(1), "START")), charge, F.array(*more))
    stop, out = e(end + 1, "STOP", 9), e(end + 2, "UNPLUG")
    kind = F.col("scenario")
    return (
        F.when(kind == "resume", both(stop, e(end + 11, "START"), e(end + 15, "PROGRESS", 50), e(end + 16, "STOP"), e(end + 17, "UNPLUG")))
        .when(kind == "replace", both(stop, e(end + 20, "PLUG_IN"), e(end + 22, "UNPLUG"))).when(kind == "no_unplug", both(stop))
        .when(kind == "gap_exact", both(e(end + 30, "STOP", 9), e(end + 31, "UNPLUG"))).when(kind == "gap_over", both(e(end + 30, "STOP", 9, 1), e(end + 31, "UNPLUG"))).otherwise(both(stop, out))
    )


def charging_base(spark: SparkSession, seed: int, vehicles: int) -> DataFrame:
    """Two or three sessions a vehicle, one of SCENARIOS each."""
    v, s = F.col("v"), F.col("s")
    plan = spark.range(1, vehicles + 1).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), 1 + draw(seed, "sessions", 2, F.col("id")))).alias("s"))
    scenario = F.element_at(F.array(*map(F.lit, SCENARIOS)), (F.pmod(v + 3 * s, F.lit(len(SCENARIOS))) + 1).cast("int"))
    plan = plan.withColumn("scenario", scenario).withColumn("place", F.element_at(F.array(*map(F.lit, PLACES)), (F.pmod(v + s, F.lit(len(PLACES))) + 1).cast("int")))
    begin = F.when(F.col("scenario") == "midnight", F.lit(START + DAY - 8 * MINUTE)).otherwise(START + s * 7 * HOUR + draw(seed, "start", 3 * HOUR, v, s))
    rows = plan.withColumn("begin", begin).select("v", "s", "scenario", "place", "begin", F.posexplode(_events(3 + draw(seed, "steps", 6, v, s))).alias("k", "e"))
    plug = F.col("e.event") == "PLUG_IN"
    return rows.select(
        unique_id(seed, F.lit("c"), v, s, F.col("k")).alias("event_id"), vin(v).alias("vin"), (F.col("begin") + F.col("e.off")).alias("ts"), F.col("e.event").alias("event"), F.col("e.energy_wh").alias("energy_wh"),
        F.when(plug, _place(seed, F.col("place"), 90, "lat", v, s)).alias("lat"), F.when(plug, _place(seed, F.col("place"), 180, "lon", v, s)).alias("lon"), F.when(plug, F.lit("ac_l2")).alias("charger_type"), "scenario", "place",
    )


def battery_base(spark: SparkSession, seed: int, vehicles: int) -> DataFrame:
    """A reading a minute over a trip; some vehicles run hot, to just at and just above the alert's bound."""
    v, m = F.col("v"), F.col("m")
    trip = spark.range(1, vehicles + 1).select(F.col("id").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("m"))
    begin = F.lit(START) + F.pmod(v, F.lit(40)) * 20 * MINUTE
    hot = F.pmod(v, F.lit(5))
    temp = F.when((hot == 0) & (m % 10 == 3), 55.0).when((hot == 1) & (m % 10 == 3), 55.1).otherwise((250 + draw(seed, "temp", 200, v, m)) / 10)
    return trip.select(
        unique_id(seed, F.lit("b"), v, m).alias("event_id"), vin(v).alias("vin"), (begin + m * MINUTE).alias("ts"), ((900 - m * 3) / 10).alias("soc_pct"), F.when(m == 5, 100.0).otherwise((950 - v % 50) / 10).alias("soh_pct"),
        temp.alias("cell_temp_max_c"), F.when(m == 7, 1000.0).otherwise(380 + (m % 9) / 10).alias("pack_voltage_v"), F.when(hot == 0, "at_bound").when(hot == 1, "above_bound").otherwise("cool").alias("scenario"), F.lit(None).cast("string").alias("place"),
    )


BASES = {CHARGING.name: charging_base, BATTERY.name: battery_base}


def _broken(base: DataFrame, seed: int, job: str) -> DataFrame:
    """For each rule, some ordinary rows again under new ids with that rule broken."""
    names = list(BROKEN[job])
    picked = base.withColumn("_r", draw(seed, "broken", 8 * len(names), F.col("event_id"))).filter(F.col("_r") < len(names)).withColumn("_case", F.get(F.array(*map(F.lit, names)), F.col("_r").cast("int")))
    picked = picked.withColumn("event_id", unique_id(seed, F.lit("broken"), F.col("event_id")))
    clear = {c: F.when(F.col("_case").isin([n for n in names if "event" in BROKEN[job][n]]), None).otherwise(F.col(c)) for c in ("lat", "lon", "charger_type") if c in base.columns}
    picked = picked.withColumns({"_at": F.col("ts")} | clear)
    for c in fixtures.FIELDS[job]:
        change = [(n, BROKEN[job][n][c]) for n in names if c in BROKEN[job][n]]
        out = F.col(c)
        for n, value in change:
            out = F.when(F.col("_case") == n, F.lit(value).cast(base.schema[c].dataType)).otherwise(out)
        picked = picked.withColumn(c, out)
    return picked.withColumns({"intent": F.lit("rejected"), "case": F.concat(F.lit("invalid:"), "_case"), "arrival": F.col("_at") + 1000}).drop("_r", "_case", "_at")


def _kept(df: DataFrame) -> DataFrame:
    """Written once and read back: what follows reads it several times."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/generated-{uuid.uuid4().hex}"
    df.coalesce(4).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_of(spark: SparkSession, spec: JobSpec, seed: int, vehicles: int) -> DataFrame:
    """The fixture's rows with batch, arrival_seq, intent, case, scenario and place."""
    half, job = spec.delay_ms // 2, spec.name
    base = BASES[job](spark, seed, vehicles)
    small = F.when(draw(seed, "straggler", 20, F.col("event_id")) == 0, draw(seed, "delay", half - 1000, F.col("event_id"))).otherwise(draw(seed, "delay", 5000, F.col("event_id")))
    base = _kept(base.withColumns({"intent": F.lit("accepted"), "case": F.lit(None).cast("string"), "arrival": F.col("ts") + 100 + small}))
    some = lambda name, n: base.filter(draw(seed, name, n, F.col("event_id")) == 0)
    again = lambda df, intent, case: df.withColumns({"intent": F.lit(intent), "case": F.lit(case), "arrival": F.col("arrival") + 1 + draw(seed, "again", half - 1000, F.col("event_id"))})
    changed = {"energy_wh": F.col("energy_wh") + 1} if job == CHARGING.name else {"soc_pct": F.col("soc_pct") / 2}
    conflicting = some("conflict", 40).filter("event = 'PROGRESS'") if job == CHARGING.name else some("conflict", 40)
    fresh = lambda df, case: df.withColumn("event_id", unique_id(seed, F.lit(case), F.col("event_id")))
    late = fresh(some("late", 50).filter(F.col("ts") < START + 6 * HOUR), "late").withColumns({"intent": F.lit("late"), "case": F.lit("late"), "arrival": F.col("ts") + 4 * HOUR})
    parts = [base, again(some("copy", 40), "duplicate", "duplicate"), again(conflicting.withColumns(changed), "conflicting", "conflict"), late, _broken(base, seed, job)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    out = _kept(out.withColumn("slot", F.floor((F.col("arrival") - START) / SLOT)))
    # batches are the slots that have rows, numbered without gaps: one row per slot
    numbered = out.select("slot").distinct().withColumn("batch", F.row_number().over(Window.orderBy("slot")).cast("bigint"))
    out = _kept(out.join(F.broadcast(numbered), "slot").drop("slot"))
    # rows at the watermark in effect are late, a millisecond after it they aren't; neither moves it
    marks = batch.watermarks(out.withColumn("valid", fixtures.VALID[job]()), spec).filter("wm_in is not null")
    edge = out.filter("intent = 'accepted' and case is null").groupBy("batch").agg(F.min_by(F.struct(*[c for c in out.columns if c != "batch"]), F.struct("arrival", "event_id")).alias("r")).join(marks.select("batch", "wm_in"), "batch")
    edge = _kept(edge.select("batch", "wm_in", "r.*"))
    for plus, intent, case in ((0, "late", "at_watermark"), (1, "accepted", "after_watermark")):
        own = fresh(edge, case).withColumns({"ts": F.col("wm_in") + plus, "intent": F.lit(intent), "case": F.lit(case)}).drop("wm_in")
        out = out.unionByName(own)
    # a fixture is a file of megabytes with one order
    order = Window.orderBy("batch", "arrival", "event_id", F.col("case").asc_nulls_first())
    return _kept(out.withColumn("arrival_seq", F.row_number().over(order).cast("bigint")).drop("arrival"))


def check(rows: DataFrame, spec: JobSpec) -> list[str]:
    """What is wrong with a finished fixture; empty if it is as meant."""
    keyed = rows.withColumn("valid", fixtures.VALID[spec.name]()).withColumnRenamed("vin", "key")
    classed = batch.classify(keyed, spec)
    wrong = classed.filter(~F.col("class").eqNullSafe(F.col("intent")))
    out = [f"row {r['arrival_seq']} ({r['case']}) is {r['class']}, meant to be {r['intent']}" for r in wrong.orderBy("arrival_seq").limit(5).collect()]
    out += [f"{r['event_id']} has {r['n_keys']} vehicles" for r in compare.owners(keyed.filter("valid")).limit(5).collect()]
    top = rows.agg(F.max("batch").alias("top"), F.countDistinct("batch").alias("n")).first()
    return out + ([f"{top['n']} batches up to number {top['top']}"] if top["top"] != top["n"] else [])


@dataclass
class Generated:
    path: str
    sha256: str
    summary: dict


def summary(rows: DataFrame) -> dict:
    """Rows by class, by case, by scenario and by kind of place, and how many coordinates are exact halves."""
    count = lambda c: {r[c]: r["count"] for r in rows.filter(F.col(c).isNotNull()).groupBy(c).count().orderBy(c).collect()}
    halves = rows.filter(exact_half(F.col("lat")) | exact_half(F.col("lon"))).count() if "lat" in rows.columns else 0
    return {"rows": rows.count(), "intents": count("intent"), "cases": count("case"), "scenarios": count("scenario"), "places": count("place"), "exact_halves": halves}


def generate(spark: SparkSession, job: str, path: str, seed: int = 1, vehicles: int = 40) -> Generated:
    """Writes one fixture file to `path`; ValueError if it is not as meant or too large."""
    spec = fixtures.SPECS[job]
    rows = rows_of(spark, spec, seed, vehicles)
    folder = Path(f"{path}.parts")
    if bad := check(rows, spec):
        raise ValueError("; ".join(bad))
    fixtures.write(rows, job, str(folder))
    (part,) = folder.glob("part-*")
    body = part.read_bytes()
    for f in folder.iterdir():
        f.unlink()
    folder.rmdir()
    if len(body) > MOST_BYTES:
        raise ValueError(f"{len(body)} bytes, {MOST_BYTES} at most")
    Path(path).write_bytes(body)
    return Generated(path, hashlib.sha256(body).hexdigest(), summary(rows) | {"seed": seed, "vehicles": vehicles, "bytes": len(body)})
