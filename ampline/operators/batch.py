"""The two jobs as relational plans over stored events.

Input rows: key, event_id, ts (epoch ms), arrival_seq, batch, valid, and the
payload columns that a spec names. After the flush the final records do not
depend on how releases fell into batches, so sessions and windows are windowed
aggregates over the accepted rows in (ts, arrival_seq) order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampline.functions import rules


@dataclass(frozen=True)
class JobSpec:
    name: str
    delay_ms: int
    payload: tuple[str, ...]
    input_topic: str = ""
    output_topic: str = ""
    gap_ms: int = rules.GAP_MS
    window_ms: int = rules.WINDOW_MS
    alert_above: float = rules.ALERT_ABOVE


CHARGING = JobSpec("charging-sessions", 600_000, ("ts", "event", "energy_wh", "lat", "lon", "charger_type"), "vehicle.charging.v1", "charging.sessions.v1")
BATTERY = JobSpec("battery-health", 120_000, ("ts", "soc_pct", "soh_pct", "cell_temp_max_c", "pack_voltage_v"), "vehicle.battery.v1", "battery.health.v1")

CLOSE_REASONS = ("UNPLUG", "INACTIVITY_TIMEOUT", "REPLACED_BY_PLUG_IN")
COUNTERS = ("rejected", "late", "duplicate_events", "conflicting_duplicates")
CLASSES = {"rejected": "rejected", "late": "late", "duplicate": "duplicate_events", "conflicting": "conflicting_duplicates"}


def watermarks(rows: DataFrame, spec: JobSpec) -> DataFrame:
    """(batch, wm_in, wm_after), one row per batch: null until a valid time has been seen.

    Every valid row moves time, late ones and copies too. The window runs over
    one row per batch, after a partial aggregate.
    """
    per = rows.groupBy("batch").agg(F.max(F.when(F.col("valid"), F.col("ts"))).alias("top"))
    upto = Window.orderBy("batch")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    return per.select("batch", (F.max("top").over(before) - spec.delay_ms).alias("wm_in"), (F.max("top").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - spec.delay_ms).alias("wm_after"))


def classify(rows: DataFrame, spec: JobSpec) -> DataFrame:
    """rows with wm_in and class: rejected, late, accepted, duplicate or conflicting.

    Late rows go before copies are looked for, so they reserve no id. A copy
    conflicts when any payload field differs from the first arrival's.
    """
    timed = rows.join(watermarks(rows, spec).select("batch", "wm_in"), "batch")
    late = F.coalesce(F.col("ts") <= F.col("wm_in"), F.lit(False))
    staged = timed.withColumn("_stage", F.when(~F.col("valid"), "rejected").when(late, "late").otherwise("on_time"))
    payload = F.struct(*spec.payload)
    # Rows that are not on time stand in partitions of their own: no id is compared with theirs.
    same = Window.partitionBy("key", "event_id", "_stage").orderBy("arrival_seq")
    first = F.first(payload).over(same)
    order = F.row_number().over(same)
    kind = F.when(F.col("_stage") != "on_time", F.col("_stage")).when(order == 1, "accepted").when(payload.eqNullSafe(first), "duplicate").otherwise("conflicting")
    return staged.withColumn("class", kind).drop("_stage")


def histogram(classified: DataFrame) -> DataFrame:
    return classified.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.filter("class = 'accepted'")


def sessions_marked(taken: DataFrame, spec: JobSpec) -> DataFrame:
    """Accepted rows with grp (plug-ins so far) and orphan."""
    by_key = Window.partitionBy("key").orderBy("ts", "arrival_seq")
    plug = F.col("event") == "PLUG_IN"
    grouped = taken.select("*", F.sum(plug.cast("long")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)).alias("grp"), F.lag("ts").over(by_key).alias("_ts"), F.lag("event").over(by_key).alias("_event"))
    within = Window.partitionBy("key", "grp").orderBy("ts", "arrival_seq").rowsBetween(Window.unboundedPreceding, 0)
    broken = ~plug & ((F.col("ts") - F.col("_ts") > spec.gap_ms) | (F.col("_event") == "UNPLUG"))
    marked = grouped.withColumn("_broken", F.max(F.coalesce(broken, F.lit(False))).over(within))
    return marked.withColumn("orphan", (F.col("grp") == 0) | F.col("_broken")).drop("_ts", "_event", "_broken")


def sessionize(taken: DataFrame, spec: JobSpec) -> DataFrame:
    """One row per session that a plug-in opened, all closed (after the flush)."""
    inside = sessions_marked(taken, spec).filter(~F.col("orphan"))
    opening = lambda c: F.max(F.when(F.col("event") == "PLUG_IN", F.col(c)))
    found = inside.groupBy("key", "grp").agg(
        opening("event_id").alias("opened_by"), opening("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.sum("energy_wh").alias("total_energy_wh"),
        opening("lat").alias("lat"), opening("lon").alias("lon"), opening("charger_type").alias("charger_type"),
        F.max(F.col("event") == "UNPLUG").alias("unplugged"),
    )
    following = F.lead("start_ts").over(Window.partitionBy("key").orderBy("grp"))
    reason = F.when(F.col("unplugged"), "UNPLUG").when(F.col("next_ts") - F.col("end_ts") <= spec.gap_ms, "REPLACED_BY_PLUG_IN").otherwise("INACTIVITY_TIMEOUT")
    return found.withColumn("next_ts", following).select(
        rules.session_output_id(F.col("opened_by")).alias("output_id"), F.col("key").alias("vin"), "start_ts", "end_ts",
        (F.col("end_ts") - F.col("start_ts")).alias("duration_ms"), "total_energy_wh",
        rules.round3(F.col("lat")).alias("start_lat"), rules.round3(F.col("lon")).alias("start_lon"), "charger_type", reason.alias("close_reason"), "next_ts",
    )


SESSION = ("output_id", "vin", "start_ts", "end_ts", "duration_ms", "total_energy_wh", "start_lat", "start_lon", "charger_type", "close_reason")
WINDOW = ("output_id", "vin", "window_start", "avg_soc_pct", "min_soh_pct", "max_cell_temp_c", "alert", "event_count")
ALLOWED = {"charging-sessions": SESSION, "battery-health": WINDOW}


def battery_windows(taken: DataFrame, spec: JobSpec) -> DataFrame:
    """Tumbling windows, aligned to the epoch, end exclusive; empty ones do not exist."""
    found = taken.groupBy("key", rules.window_start(F.col("ts"), spec.window_ms).alias("window_start")).agg(
        (F.sum("soc_pct") / F.count(F.lit(1))).alias("avg_soc_pct"), F.min("soh_pct").alias("min_soh_pct"), F.max("cell_temp_max_c").alias("max_cell_temp_c"), F.count(F.lit(1)).alias("event_count")
    )
    return found.select(rules.window_output_id(F.col("key"), F.col("window_start"), spec.name).alias("output_id"), F.col("key").alias("vin"), "window_start", "avg_soc_pct", "min_soh_pct", "max_cell_temp_c", (F.col("max_cell_temp_c") > spec.alert_above).alias("alert"), "event_count")


def emission_batch(records: DataFrame, threshold: Column, strict: Column, marks: DataFrame, slot_ms: int = 3_600_000) -> DataFrame:
    """records with emitted: the first batch whose wm_after is at least threshold (above it where strict).

    The intervals between successive watermarks are cut at slots of time, so the
    as-of lookup is an equi-join on the slot. Records after the last watermark
    have no batch and keep null.
    """
    moved = marks.filter("wm_after is not null").groupBy("wm_after").agg(F.min("batch").alias("emitted"))
    span = moved.withColumn("lo", F.lag("wm_after").over(Window.orderBy("wm_after")))
    lo = F.coalesce("lo", F.lit(rules.MIN_TS))
    slots = span.select("emitted", lo.alias("lo"), F.col("wm_after").alias("hi"), F.explode(F.sequence(F.floor(lo / slot_ms), F.floor(F.col("wm_after") / slot_ms))).alias("slot"))
    due = threshold + strict.cast("long")
    asked = records.withColumn("_due", due).withColumn("_slot", F.floor(due / slot_ms))
    hit = (F.col("_slot") == F.col("slot")) & (F.col("_due") > F.col("lo")) & (F.col("_due") <= F.col("hi"))
    return asked.join(slots, hit, "left").drop("_due", "_slot", "lo", "hi", "slot")


def counters(classified: DataFrame, spec: JobSpec) -> DataFrame:
    """(counter, n) with every counter of the job present, without the reserved key."""
    names = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    own = classified.filter(~F.col("key").eqNullSafe(F.lit(rules.RESERVED_VIN)))
    found = own.filter("class <> 'accepted'").select(names[F.col("class")].alias("counter"))
    wanted = list(COUNTERS)
    if spec.name == CHARGING.name:
        taken = accepted(own)
        found = found.unionByName(sessions_marked(taken, spec).filter("orphan").select(F.lit("orphan").alias("counter")))
        closed = F.concat(F.lit("sessions_by_close_reason."), F.lower("close_reason"))
        found = found.unionByName(sessionize(taken, spec).select(closed.alias("counter")))
        wanted += ["orphan", *(f"sessions_by_close_reason.{r.lower()}" for r in CLOSE_REASONS)]
    names_df = classified.sparkSession.createDataFrame([(w,) for w in wanted], "counter string")
    counted = found.groupBy("counter").agg(F.count(F.lit(1)).alias("n"))
    return names_df.join(counted, "counter", "left").select("counter", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def flush_target(rows: DataFrame) -> DataFrame:
    """An hour after the largest valid time."""
    return rows.agg((F.max(F.when(F.col("valid"), F.col("ts"))) + 3_600_000).alias("flush_target"))
