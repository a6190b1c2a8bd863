"""The jobs on a stream: watermark, late drop, first-arrival dedup, ordered release, keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ampline.functions import rules
from ampline.operators.batch import BATTERY, JobSpec
from ampline.streaming.processors import Sessions, Windows

FACT = (
    "kind string, key string, counter string, busy boolean, opened_by string, start_ts long, end_ts long, total_energy_wh long, lat double, lon double, charger_type string, close_reason string, "
    "window_start long, avg_soc_pct double, min_soh_pct double, max_cell_temp_c double, event_count long, calls long"
)
_COLUMNS = [c.strip().split(" ")[0] for c in FACT.split(",")]
_STATE = "seen string, buffered string, job string, calls long"


def _records(frame: pd.DataFrame) -> list[dict]:
    """Rows as dicts of plain Python values, nulls as None."""
    columns = [[None if v is None or v != v else v for v in frame[c].tolist()] for c in frame.columns]
    return [dict(zip(frame.columns, r, strict=True)) for r in zip(*columns, strict=True)]


def facts_stream(rows: DataFrame, spec: JobSpec) -> DataFrame:
    """rows(key, event_id, ts, arrival_seq, valid, payload...) streaming -> fact rows of kind record, counter or state.

    Rejected rows move no watermark, so they pass beside the stateful operator; so do
    rows that a column `late` marks, which are behind the watermark already.
    Rows are held until the watermark passes them and then run in (ts,
    arrival_seq) order. Ids are kept for the whole run.
    """
    processor = Windows(spec) if spec.name == BATTERY.name else Sessions(spec)
    payload = list(spec.payload)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, buffered, job = (json.loads(s) for s in state.get[:3]) if state.exists else ({}, [], {})
        calls = state.get[3] + 1 if state.exists else 1
        watermark = state.getCurrentWatermarkMs()
        quiet = key[0] == rules.RESERVED_VIN
        out, touched = [], state.exists
        count = lambda name: [] if quiet else [{"kind": "counter", "counter": name}]
        rows = [] if state.hasTimedOut else [r for f in frames for r in _records(f)]
        for r in sorted(rows, key=lambda r: r["arrival_seq"]):
            if watermark and r["ts"] <= watermark:  # the engine's own filter may lag one batch
                out += count("late")
                continue
            touched = True
            own = [r[p] for p in payload]
            if r["event_id"] in seen:
                out += count("duplicate_events" if seen[r["event_id"]] == own else "conflicting_duplicates")
                continue
            seen[r["event_id"]] = own
            buffered.append({k: r[k] for k in ("event_id", "arrival_seq", *payload)})
        due = sorted((r for r in buffered if r["ts"] <= watermark), key=lambda r: (r["ts"], r["arrival_seq"]))
        buffered = [r for r in buffered if r["ts"] > watermark]
        made = [] if quiet else [x for r in due for x in processor.on_event(r, job)] + processor.on_watermark(watermark, job)
        out += [{"kind": "counter" if "counter" in m else "record", **m} for m in made]
        if touched:
            state.update((json.dumps(seen), json.dumps(buffered), json.dumps(job), calls))
            at = min([processor.next_timeout(job), *(r["ts"] - 1 for r in buffered)])
            if at < rules.MAX_TS:
                state.setTimeoutTimestamp(max(at, watermark, 1))
            out.append({"kind": "state", "busy": bool(buffered) or processor.is_open(job), "calls": calls})
        if out:
            cells = np.empty((len(out), len(_COLUMNS)), object)  # None where a fact lacks a column
            for cell, o in zip(cells, out, strict=True):
                cell[:] = [{"key": key[0], **o}.get(c) for c in _COLUMNS]
            yield pd.DataFrame(cells, columns=_COLUMNS)

    known = F.col("late") if "late" in rows.columns else F.lit(False)
    valid = rows.filter(F.col("valid") & ~known).withColumn("event_time", F.timestamp_millis("ts")).withWatermark("event_time", f"{spec.delay_ms} milliseconds")
    kept = valid.select(F.col("key").cast("string").alias("key"), "event_id", "arrival_seq", *payload, "event_time")
    facts = kept.groupBy("key").applyInPandasWithState(update, FACT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    blank = lambda c: F.lit(None).cast(facts.schema[c].dataType).alias(c)
    refused = rows.filter((~F.col("valid") | known) & ~F.col("key").cast("string").eqNullSafe(F.lit(rules.RESERVED_VIN)))
    made = {"kind": F.lit("counter").alias("kind"), "key": F.col("key").cast("string").alias("key"), "counter": F.when(F.col("valid"), "late").otherwise("rejected").alias("counter")}
    return facts.unionByName(refused.select(*[made.get(c, blank(c)) for c in _COLUMNS]))


def session_records(facts: DataFrame) -> DataFrame:
    r = facts.filter("kind = 'record'")
    return r.select(
        rules.session_output_id(F.col("opened_by")).alias("output_id"), F.col("key").alias("vin"), "start_ts", "end_ts", (F.col("end_ts") - F.col("start_ts")).alias("duration_ms"), "total_energy_wh",
        rules.round3(F.col("lat")).alias("start_lat"), rules.round3(F.col("lon")).alias("start_lon"), "charger_type", "close_reason",
    )


def window_records(facts: DataFrame, spec: JobSpec) -> DataFrame:
    r = facts.filter("kind = 'record'")
    return r.select(rules.window_output_id(F.col("key"), F.col("window_start"), spec.name).alias("output_id"), F.col("key").alias("vin"), "window_start", "avg_soc_pct", "min_soh_pct", "max_cell_temp_c", (F.col("max_cell_temp_c") > spec.alert_above).alias("alert"), "event_count")
