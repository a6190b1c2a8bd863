"""Registered queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampline.functions import rules
from ampline.operators import batch, compare
from ampline.sources.events import SESSIONS, SQL, WINDOWS, telemetry
from ampline.sources.folders import scratch
from ampline.streaming.replay import replay
from ampline.streaming.stateful import session_records, window_records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_GAP, _WIN, _DELAY = SESSIONS.gap_ms, WINDOWS.window_ms, SESSIONS.delay_ms

#: Classes of the session job's rows, its sessions, and the window job's windows.
CLASSIFIED = SQL + f""",
per AS (SELECT batch, max(ts) FILTER (WHERE valid) AS top FROM checked GROUP BY batch),
wm AS (SELECT batch, max(top) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {_DELAY} AS wm_in,
  max(top) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) - {_DELAY} AS wm_after FROM per),
timed AS (SELECT c.*, w.wm_in, CASE WHEN NOT valid THEN 'rejected' WHEN coalesce(ts <= wm_in, false) THEN 'late' ELSE 'on_time' END AS stage FROM checked c JOIN wm w USING (batch)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY key, event_id, stage ORDER BY arrival_seq) AS rn,
  first(ROW(ts, event, energy_wh, lat, lon, charger_type)) OVER (PARTITION BY key, event_id, stage ORDER BY arrival_seq) AS first_payload FROM timed),
classed AS (SELECT *, CASE WHEN stage <> 'on_time' THEN stage WHEN rn = 1 THEN 'accepted'
  WHEN ROW(ts, event, energy_wh, lat, lon, charger_type) IS NOT DISTINCT FROM first_payload THEN 'duplicate' ELSE 'conflicting' END AS class FROM ranked),
taken AS (SELECT * FROM classed WHERE class = 'accepted')
"""
SESSIONIZED = CLASSIFIED + f""",
g AS (SELECT *, sum(CASE WHEN event = 'PLUG_IN' THEN 1 ELSE 0 END) OVER w AS grp, lag(ts) OVER w AS pts, lag(event) OVER w AS pev FROM taken WINDOW w AS (PARTITION BY key ORDER BY ts, arrival_seq)),
b AS (SELECT *, grp = 0 OR max(CASE WHEN event <> 'PLUG_IN' AND (ts - pts > {_GAP} OR pev = 'UNPLUG') THEN 1 ELSE 0 END) OVER (PARTITION BY key, grp ORDER BY ts, arrival_seq ROWS UNBOUNDED PRECEDING) = 1 AS orphan FROM g),
f AS (SELECT key, grp, max(event_id) FILTER (WHERE event = 'PLUG_IN') AS opened_by, max(ts) FILTER (WHERE event = 'PLUG_IN') AS start_ts, max(ts) AS end_ts, CAST(sum(energy_wh) AS BIGINT) AS total_energy_wh,
  max(lat) AS lat, max(lon) AS lon, max(charger_type) AS charger_type, bool_or(event = 'UNPLUG') AS unplugged FROM b WHERE NOT orphan GROUP BY key, grp),
n AS (SELECT *, lead(start_ts) OVER (PARTITION BY key ORDER BY grp) AS next_ts FROM f),
sessions AS (SELECT sha256(opened_by) AS output_id, key AS vin, start_ts, end_ts, end_ts - start_ts AS duration_ms, total_energy_wh,
  CAST(round(CAST(CAST(lat AS VARCHAR) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS start_lat, CAST(round(CAST(CAST(lon AS VARCHAR) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS start_lon, charger_type,
  CASE WHEN unplugged THEN 'UNPLUG' WHEN next_ts - end_ts <= {_GAP} THEN 'REPLACED_BY_PLUG_IN' ELSE 'INACTIVITY_TIMEOUT' END AS close_reason, next_ts FROM n)
"""
_SESSION = ", ".join(batch.SESSION)
# The window job has its own delay and payload.
WINDOWED = CLASSIFIED.replace(f"- {_DELAY}", f"- {WINDOWS.delay_ms}").replace("ROW(ts, event, energy_wh, lat, lon, charger_type)", "ROW(ts, soc_pct, soh_pct, cell_temp_max_c)") + f""",
windows AS (SELECT key, ts - ts % {_WIN} AS window_start, sum(CAST(round(soc_pct * 100) AS BIGINT)) AS cents, min(soh_pct) AS min_soh_pct, max(cell_temp_max_c) AS max_cell_temp_c, count(*) AS event_count FROM taken GROUP BY 1, 2),
healths AS (SELECT sha256('battery-health|' || key || '|' || window_start) AS output_id, key AS vin, window_start, round(cents / 100.0 / event_count, 6) AS avg_soc_pct, min_soh_pct, max_cell_temp_c, max_cell_temp_c > 55.0 AS alert, event_count FROM windows)
"""


def query(sql: str | None = None):
    def register(f):
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def _classified(spark, sf_dir, spec=SESSIONS):
    return batch.classify(telemetry(spark, sf_dir), spec)


def _taken(spark, sf_dir, spec=SESSIONS):
    return batch.accepted(_classified(spark, sf_dir, spec))


def _sessions(spark, sf_dir):
    return batch.sessionize(_taken(spark, sf_dir), SESSIONS)


def _windows(spark, sf_dir):
    found = batch.battery_windows(_taken(spark, sf_dir, WINDOWS), WINDOWS)
    return found.withColumn("avg_soc_pct", F.round("avg_soc_pct", 6))


@query(SQL + "SELECT valid, count(*) AS n, CAST(sum(energy_wh) AS BIGINT) AS energy_wh FROM checked GROUP BY valid")
def validate_split(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("valid").agg(F.count(F.lit(1)).alias("n"), F.sum("energy_wh").alias("energy_wh"))


@query(CLASSIFIED + "SELECT batch, wm_in, wm_after FROM wm")
def watermark_per_batch(spark, sf_dir):
    return batch.watermarks(telemetry(spark, sf_dir), SESSIONS)


@query(CLASSIFIED + "SELECT key, event_id, arrival_seq, ts, wm_in FROM classed WHERE class = 'late'")
def late_rows(spark, sf_dir):
    return _classified(spark, sf_dir).filter("class = 'late'").select("key", "event_id", "arrival_seq", "ts", "wm_in")


@query(CLASSIFIED + "SELECT key, event_id, arrival_seq, ts, event, energy_wh FROM taken")
def first_arrival_dedup(spark, sf_dir):
    return _taken(spark, sf_dir).select("key", "event_id", "arrival_seq", "ts", "event", "energy_wh")


@query(CLASSIFIED + "SELECT key, event_id, arrival_seq, class FROM classed WHERE class IN ('duplicate', 'conflicting')")
def duplicate_vs_conflict(spark, sf_dir):
    return _classified(spark, sf_dir).filter("class in ('duplicate', 'conflicting')").select("key", "event_id", "arrival_seq", "class")


@query(CLASSIFIED + "SELECT class, count(*) AS n FROM classed GROUP BY class")
def row_class_histogram(spark, sf_dir):
    return batch.histogram(_classified(spark, sf_dir))


@query(SESSIONIZED + f"SELECT {_SESSION} FROM sessions")
def sessionize(spark, sf_dir):
    return _sessions(spark, sf_dir).select(*batch.SESSION)


@query(SESSIONIZED + "SELECT key, event_id, ts, event FROM b WHERE orphan")
def orphans(spark, sf_dir):
    return batch.sessions_marked(_taken(spark, sf_dir), SESSIONS).filter("orphan").select("key", "event_id", "ts", "event")


@query(SESSIONIZED + "SELECT close_reason, count(*) AS n FROM sessions GROUP BY close_reason")
def sessions_by_close_reason(spark, sf_dir):
    return _sessions(spark, sf_dir).groupBy("close_reason").agg(F.count(F.lit(1)).alias("n"))


@query(WINDOWED + f"SELECT {', '.join(batch.WINDOW)} FROM healths")
def battery_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


@query(WINDOWED + "SELECT output_id, vin, window_start, max_cell_temp_c FROM healths WHERE alert")
def alert_windows(spark, sf_dir):
    return _windows(spark, sf_dir).filter("alert").select("output_id", "vin", "window_start", "max_cell_temp_c")


@query("SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS session_id, sha256('battery-health|' || user_id || '|' || (epoch_us(ts) // 1000 - epoch_us(ts) // 1000 % 300000)) AS window_id FROM events")
def output_ids(spark, sf_dir):
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", rules.session_output_id(F.col("event_id")).alias("session_id"), rules.window_output_id(F.col("user_id"), rules.window_start(ts)).alias("window_id"))


@query(SQL + "SELECT event_id, arrival_seq, CAST(round(CAST(CAST(lat AS VARCHAR) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS lat3, CAST(round(CAST(CAST(lon AS VARCHAR) AS DECIMAL(18, 9)), 3) AS DOUBLE) AS lon3 FROM checked WHERE lat IS NOT NULL")
def round3(spark, sf_dir):
    return telemetry(spark, sf_dir).filter("lat is not null").select("event_id", "arrival_seq", rules.round3(F.col("lat")).alias("lat3"), rules.round3(F.col("lon")).alias("lon3"))


_DUE = f"CASE close_reason WHEN 'UNPLUG' THEN end_ts WHEN 'REPLACED_BY_PLUG_IN' THEN next_ts ELSE end_ts + {_GAP} + 1 END"


@query(SESSIONIZED + f"SELECT output_id, close_reason, (SELECT min(batch) FROM wm WHERE wm_after >= {_DUE}) AS emitted FROM sessions")
def emission_batch(spark, sf_dir):
    reason = F.col("close_reason")
    threshold = F.when(reason == "UNPLUG", F.col("end_ts")).when(reason == "REPLACED_BY_PLUG_IN", F.col("next_ts")).otherwise(F.col("end_ts") + _GAP)
    marks = batch.watermarks(telemetry(spark, sf_dir), SESSIONS)
    return batch.emission_batch(_sessions(spark, sf_dir), threshold, reason == "INACTIVITY_TIMEOUT", marks).select("output_id", "close_reason", "emitted")


# A second version of the sessions: some lost, some changed, one id repeated.
_OTHER = SESSIONIZED + """,
other AS (SELECT output_id, CASE WHEN start_ts % 7 = 0 THEN total_energy_wh + 1 ELSE total_energy_wh END AS total_energy_wh, end_ts, start_lat + CASE WHEN start_ts % 5 = 0 THEN 1e-10 ELSE 0 END AS start_lat FROM sessions WHERE start_ts % 11 <> 0
  UNION ALL SELECT 'x' || output_id, total_energy_wh, end_ts, start_lat FROM sessions WHERE start_ts % 13 = 0)
"""


def _versions(spark, sf_dir):
    golden = _sessions(spark, sf_dir).select("output_id", "total_energy_wh", "end_ts", "start_lat", "start_ts")
    changed = golden.filter("start_ts % 11 <> 0").withColumn("total_energy_wh", F.col("total_energy_wh") + F.when(F.col("start_ts") % 7 == 0, 1).otherwise(0)).withColumn("start_lat", F.col("start_lat") + F.when(F.col("start_ts") % 5 == 0, 1e-10).otherwise(0.0))
    extra = golden.filter("start_ts % 13 = 0").withColumn("output_id", F.concat(F.lit("x"), F.col("output_id")))
    return golden.drop("start_ts"), changed.unionByName(extra).drop("start_ts")


_PARITY = _OTHER + """SELECT coalesce(s.output_id, o.output_id) AS output_id, CASE WHEN o.output_id IS NULL THEN 'missing' WHEN s.output_id IS NULL THEN 'extra' ELSE 'changed' END AS status,
CASE WHEN s.output_id IS NOT NULL AND o.output_id IS NOT NULL THEN 'total_energy_wh' ELSE '' END AS fields
FROM sessions s FULL OUTER JOIN other o ON s.output_id = o.output_id WHERE s.output_id IS NULL OR o.output_id IS NULL OR s.total_energy_wh <> o.total_energy_wh"""


@query(_PARITY)
def record_parity_full_outer(spark, sf_dir):
    return compare.record_diff(*_versions(spark, sf_dir), tolerances={"start_lat": 1e-9})


@query(_PARITY + " ORDER BY 1 LIMIT 5")
def top5_diffs(spark, sf_dir):
    return record_parity_full_outer(spark, sf_dir).orderBy("output_id").limit(5)


@query(_OTHER + "SELECT s.output_id, abs(s.start_lat - o.start_lat) <= 1e-9 AS near FROM sessions s JOIN other o ON s.output_id = o.output_id")
def tolerance_compare(spark, sf_dir):
    golden, other = _versions(spark, sf_dir)
    j = golden.join(other.select("output_id", F.col("start_lat").alias("o")), "output_id")
    return j.select("output_id", (~compare.differs(F.col("start_lat"), F.col("o"), 1e-9)).alias("near"))


@query(_OTHER + "SELECT output_id FROM sessions WHERE output_id NOT IN (SELECT output_id FROM other)")
def missing_ids(spark, sf_dir):
    return compare.missing(*_versions(spark, sf_dir))


@query(_OTHER + "SELECT output_id FROM other WHERE output_id NOT IN (SELECT output_id FROM sessions)")
def extra_ids(spark, sf_dir):
    golden, other = _versions(spark, sf_dir)
    return compare.missing(other, golden)


@query(_OTHER + "SELECT output_id FROM sessions INTERSECT SELECT output_id FROM other")
def common_ids(spark, sf_dir):
    return compare.common(*_versions(spark, sf_dir))


@query(CLASSIFIED + "SELECT sha256(event_id) AS output_id, count(*) AS n FROM checked GROUP BY 1 HAVING count(*) > 1")
def dup_output_ids(spark, sf_dir):
    return compare.repeated(telemetry(spark, sf_dir).select(rules.session_output_id(F.col("event_id")).alias("output_id")))


@query("SELECT o_custkey AS event_id, count(DISTINCT o_orderstatus) AS n_keys FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def one_owner(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return compare.owners(orders.select(F.col("o_custkey").alias("event_id"), F.col("o_orderstatus").alias("key")))


@query(SESSIONIZED + "SELECT s.output_id, t.event_id AS source_event_id FROM sessions s LEFT JOIN taken t ON s.output_id = sha256(t.event_id) AND t.event = 'PLUG_IN'")
def source_lookup(spark, sf_dir):
    return compare.source_lookup(_sessions(spark, sf_dir), _taken(spark, sf_dir))


@query(SESSIONIZED + "SELECT output_id FROM sessions WHERE start_ts % 7 = 0")
def coordinate_assertions(spark, sf_dir):
    records = _sessions(spark, sf_dir).withColumn("start_lat", F.col("start_lat") + F.when(F.col("start_ts") % 7 == 0, 0.001).otherwise(0.0))
    return compare.coordinate_failures(records, _taken(spark, sf_dir))


@query(CLASSIFIED + "SELECT key, max(batch) AS batch, arg_max(event <> 'UNPLUG', arrival_seq) AS busy FROM taken GROUP BY key")
def last_marker(spark, sf_dir):
    return _taken(spark, sf_dir).groupBy("key").agg(F.max("batch").alias("batch"), F.max_by(F.col("event") != "UNPLUG", "arrival_seq").alias("busy"))


@query(CLASSIFIED + "SELECT count(DISTINCT key) AS n_keys FROM classed WHERE class NOT IN ('rejected', 'late')")
def distinct_keys(spark, sf_dir):
    return _classified(spark, sf_dir).filter("class not in ('rejected', 'late')").agg(F.countDistinct("key").alias("n_keys"))


@query(SESSIONIZED + "SELECT 'record' AS kind, vin, output_id AS detail FROM sessions UNION ALL SELECT 'counter', key, class FROM classed WHERE class <> 'accepted'")
def union_facts(spark, sf_dir):
    records = _sessions(spark, sf_dir).select(F.lit("record").alias("kind"), "vin", F.col("output_id").alias("detail"))
    counted = _classified(spark, sf_dir).filter("class <> 'accepted'").select(F.lit("counter").alias("kind"), F.col("key").alias("vin"), F.col("class").alias("detail"))
    return records.unionByName(counted)


@query(SESSIONIZED + f"SELECT {_SESSION} FROM sessions")
def allowlist_projection(spark, sf_dir):
    return compare.project_allowed(_sessions(spark, sf_dir), batch.ALLOWED["charging-sessions"])


@query("SELECT event_id, regexp_replace(event_type || CASE WHEN event_id % 2 = 0 THEN '.shadow' ELSE '' END, '\\.shadow$', '') AS topic FROM events")
def topic_normalise(spark, sf_dir):
    topic = F.concat("event_type", F.when(F.col("event_id") % 2 == 0, ".shadow").otherwise(""))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", rules.topic_name(topic).alias("topic"))


@query("SELECT event_id AS id, coalesce(CASE WHEN event_id % 3 > 0 THEN event_type END, 'EVENT_UNSPECIFIED') AS event, CAST(coalesce(CASE WHEN event_id % 2 > 0 THEN event_id END, 0) AS BIGINT) AS energy_wh FROM events")
def default_fill(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("event"), F.when(F.col("event_id") % 2 > 0, F.col("event_id")).alias("energy_wh"))
    return rules.default_fill(e)


@query(CLASSIFIED + "SELECT max(ts) FILTER (WHERE valid) + 3600000 AS flush_target FROM checked")
def flush_target(spark, sf_dir):
    return batch.flush_target(telemetry(spark, sf_dir))


@query(SESSIONIZED + """, found AS (
SELECT CASE class WHEN 'rejected' THEN 'rejected' WHEN 'late' THEN 'late' WHEN 'duplicate' THEN 'duplicate_events' ELSE 'conflicting_duplicates' END AS counter FROM classed WHERE class <> 'accepted'
UNION ALL SELECT 'orphan' FROM b WHERE orphan UNION ALL SELECT 'sessions_by_close_reason.' || lower(close_reason) FROM sessions),
names AS (SELECT unnest(['rejected', 'late', 'duplicate_events', 'conflicting_duplicates', 'orphan', 'sessions_by_close_reason.unplug', 'sessions_by_close_reason.inactivity_timeout', 'sessions_by_close_reason.replaced_by_plug_in']) AS counter)
SELECT counter, count(found.counter) AS n FROM names LEFT JOIN found USING (counter) GROUP BY counter""")
def counters_flat(spark, sf_dir):
    rows = telemetry(spark, sf_dir).withColumn("key", F.col("key").cast("string"))
    return batch.counters(batch.classify(rows, SESSIONS), SESSIONS)


@query(SESSIONIZED + f"SELECT {_SESSION.replace('vin', 'CAST(vin AS VARCHAR) AS vin')} FROM sessions")
def stream_sessions(spark, sf_dir):
    return session_records(replay(telemetry(spark, sf_dir), SESSIONS, scratch(spark), by_batch=False).facts)


@query(WINDOWED + f"SELECT {', '.join(batch.WINDOW).replace(' vin', ' CAST(vin AS VARCHAR) AS vin')} FROM healths")
def stream_windows(spark, sf_dir):
    found = window_records(replay(telemetry(spark, sf_dir), WINDOWS, scratch(spark), by_batch=False).facts, WINDOWS)
    return found.withColumn("avg_soc_pct", F.round("avg_soc_pct", 6))
