"""The driver's events table as keyed telemetry, with disorder derived by arithmetic that SQL shares."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampline.functions import rules
from ampline.operators.batch import BATTERY, CHARGING

HOUR = 3_600_000
#: The table's gaps are hours, so gap and window are too.
SESSIONS = replace(CHARGING, gap_ms=12 * HOUR)
WINDOWS = replace(BATTERY, payload=("ts", "soc_pct", "soh_pct", "cell_temp_max_c"), window_ms=6 * HOUR)

KINDS = {"signup": "PLUG_IN", "click": "START", "view": "PROGRESS", "purchase": "STOP", "error": "UNPLUG"}

#: The same rows in SQL: the start of every oracle.
SQL = """
WITH base AS (
  SELECT event_id AS e, user_id AS key, epoch_us(ts) // 1000 AS ts, value,
    CASE event_type WHEN 'signup' THEN 'PLUG_IN' WHEN 'click' THEN 'START' WHEN 'view' THEN 'PROGRESS' WHEN 'purchase' THEN 'STOP' ELSE 'UNPLUG' END AS event
  FROM events),
copies AS (
  SELECT *, 0 AS copy, CASE WHEN e % 97 = 0 THEN (e + 1500) * 10 + 1 ELSE e * 10 END AS arrival_seq FROM base
  UNION ALL SELECT *, 1, (e + 3) * 10 + 2 FROM base WHERE e % 41 = 0
  UNION ALL SELECT *, 2, (e + 5) * 10 + 3 FROM base WHERE e % 83 = 0),
rows_ AS (
  SELECT key, CAST(e AS VARCHAR) AS event_id, ts, event, arrival_seq, arrival_seq // 5000 + 1 AS batch,
    CAST(CASE WHEN e % 101 = 0 THEN -1 WHEN event IN ('PROGRESS', 'STOP') THEN CAST(round(value * 100) AS BIGINT) + copy // 2 ELSE 0 END AS BIGINT) AS energy_wh,
    CASE WHEN event = 'PLUG_IN' THEN ((e * 7919) % 1800000 - 900000) / 10000.0 END::DOUBLE AS lat,
    CASE WHEN event = 'PLUG_IN' THEN ((e * 104729) % 3600000 - 1800000) / 10000.0 END::DOUBLE AS lon,
    CASE WHEN event = 'PLUG_IN' THEN CASE e % 3 WHEN 0 THEN 'ac' WHEN 1 THEN 'dc_fast' ELSE 'dc' END END AS charger_type,
    CAST(value AS DOUBLE) AS soc_pct, CAST(value + copy // 2 AS DOUBLE) AS soh_pct, CAST(value AS DOUBLE) AS cell_temp_max_c
  FROM copies),
checked AS (SELECT *, ts >= 1577836800000 AND ts < 4102444800000 AND energy_wh >= 0 AS valid FROM rows_)
"""


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, event_id, ts, event, payload columns, arrival_seq, batch, valid.

    Every 97th event arrives later, every 41st twice, every 83rd again with
    another value, every 101st is invalid.
    """
    c = F.col
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    base = events.select(c("event_id").alias("e"), c("user_id").alias("key"), F.unix_millis(c("ts").cast("timestamp")).alias("ts"), "value", F.coalesce(kind[c("event_type")], F.lit("UNPLUG")).alias("event"))
    own = F.struct(F.lit(0).alias("copy"), F.when(c("e") % 97 == 0, (c("e") + 1500) * 10 + 1).otherwise(c("e") * 10).alias("arrival_seq"))
    again = F.when(c("e") % 41 == 0, F.struct(F.lit(1).alias("copy"), ((c("e") + 3) * 10 + 2).alias("arrival_seq")))
    other = F.when(c("e") % 83 == 0, F.struct(F.lit(2).alias("copy"), ((c("e") + 5) * 10 + 3).alias("arrival_seq")))
    rows = base.withColumn("a", F.explode(F.array_compact(F.array(own, again, other)))).select("*", "a.copy", "a.arrival_seq")
    plug = c("event") == "PLUG_IN"
    changed = (c("copy") == 2).cast("int")
    energy = F.when(c("e") % 101 == 0, F.lit(-1)).when(c("event").isin("PROGRESS", "STOP"), F.round(c("value") * 100).cast("bigint") + changed).otherwise(F.lit(0))
    out = rows.select(
        "key", c("e").cast("string").alias("event_id"), "ts", "event", "arrival_seq", (F.floor(c("arrival_seq") / 5000) + 1).cast("bigint").alias("batch"), energy.cast("bigint").alias("energy_wh"),
        F.when(plug, ((c("e") * 7919) % 1800000 - 900000) / F.lit(10000.0)).alias("lat"), F.when(plug, ((c("e") * 104729) % 3600000 - 1800000) / F.lit(10000.0)).alias("lon"),
        F.when(plug, F.element_at(F.array(F.lit("ac"), F.lit("dc_fast"), F.lit("dc")), (c("e") % 3 + 1).cast("int"))).alias("charger_type"),
        c("value").cast("double").alias("soc_pct"), (c("value") + changed).cast("double").alias("soh_pct"), c("value").cast("double").alias("cell_temp_max_c"),
    )
    return out.withColumn("valid", rules.always(rules.in_time_range(c("ts")) & rules.charging_rules()))
