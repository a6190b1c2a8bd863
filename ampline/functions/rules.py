"""Column expressions of the message contract: identity, ranges, rounding, ids, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the contract.
MIN_TS = 1577836800000
MAX_TS = 4102444800000
EVENTS = ("PLUG_IN", "START", "PROGRESS", "STOP", "UNPLUG")
WITH_ENERGY = ("PROGRESS", "STOP")
RESERVED_VIN = "TSTZZZZZZZZZZZZZZ"
CONTROL_ID = "ffffffff-ffff-4fff-bfff-ffffffffffff"
GAP_MS = 1_800_000
WINDOW_MS = 300_000
ALERT_ABOVE = 55.0


def is_uuid(c: Column) -> Column:
    """Lower-case canonical form; \\A and \\z, as $ would let a line end pass."""
    return c.rlike(r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z")


def is_vin(c: Column) -> Column:
    return c.rlike(r"\A[A-Z0-9]{17}\z")


def in_time_range(ts: Column) -> Column:
    return ts.between(MIN_TS, MAX_TS - 1)


def within(c: Column, low: float, high: float) -> Column:
    """Present, finite and in [low, high]."""
    return c.isNotNull() & ~F.isnan(c) & c.between(low, high)


def always(c: Column) -> Column:
    """Null logic rejects."""
    return F.coalesce(c, F.lit(False))


def charging_valid() -> Column:
    c = F.col
    identity = is_uuid(c("event_id")) & is_vin(c("vin")) & in_time_range(c("ts")) & c("event").isin(*EVENTS)
    return always(identity & charging_rules())


def charging_rules() -> Column:
    """What the event's own fields must be, whatever the form of its identity."""
    c = F.col
    energy = (c("energy_wh") >= 0) & ((c("energy_wh") == 0) | c("event").isin(*WITH_ENERGY))
    plug = within(c("lat"), -90, 90) & within(c("lon"), -180, 180) & (F.length(F.coalesce(c("charger_type"), F.lit(""))) > 0)
    return always(energy & ((c("event") != "PLUG_IN") | plug))


def battery_valid() -> Column:
    c = F.col
    identity = is_uuid(c("event_id")) & is_vin(c("vin")) & in_time_range(c("ts"))
    volts = within(c("pack_voltage_v"), 0, 1000) & (c("pack_voltage_v") > 0)
    return always(identity & within(c("soc_pct"), 0, 100) & within(c("soh_pct"), 0, 100) & within(c("cell_temp_max_c"), -60, 120) & volts)


def round3(c: Column) -> Column:
    """Three decimals, halves away from zero on the shortest decimal form, no negative zero."""
    return F.round(c, 3) + F.lit(0.0)


def session_output_id(event_id: Column) -> Column:
    return F.sha2(event_id.cast("string"), 256)


def window_output_id(key: Column, start: Column, job: str = "battery-health") -> Column:
    return F.sha2(F.concat_ws("|", F.lit(job), key.cast("string"), start.cast("string")), 256)


def window_start(ts: Column, size_ms: int = WINDOW_MS) -> Column:
    return ts - F.pmod(ts, F.lit(size_ms))


def topic_name(topic: Column) -> Column:
    return F.regexp_replace(topic, r"\.shadow\z", "")


def default_fill(df):
    """Proto3 defaults of fields without presence; other columns stay."""
    zero = {"event_id": "", "vin": "", "ts": 0, "event": "EVENT_UNSPECIFIED", "energy_wh": 0}
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in zero.items() if k in df.columns})
