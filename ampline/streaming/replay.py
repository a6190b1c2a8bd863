"""Deterministic replay: one file per batch, a flush, and evidence that everything drained."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampline.functions import rules
from ampline.operators.batch import JobSpec, watermarks
from ampline.streaming.stateful import FACT, facts_stream


#: Steps of a stepped replay at least (or as many as there are batches), and rows of a step, about.
STEPS, STEP_ROWS = 8, 1_000_000
#: Batches whose watermarks are broadcast, at most.
SMALL = 100_000


@dataclass
class Replay:
    facts: DataFrame
    drain: dict
    trace: list[dict]

    def busy(self) -> DataFrame:
        """(key, busy): each key's last state marker."""
        return self.facts.filter("kind = 'state'").groupBy("key").agg(F.max_by("busy", "calls").alias("busy"))

    def dropped(self) -> dict[int, int]:
        """Rows that the engine dropped as late, by the batch they came in."""
        out: dict[int, int] = {}
        for t in self.trace:
            out[t["batch"]] = out.get(t["batch"], 0) + t["dropped"]
        return out

    def counters(self) -> dict[str, int]:
        """Counters that facts carry, with the rows that the engine itself dropped as late."""
        found = {r["counter"]: r["n"] for r in self.facts.filter("kind = 'counter'").groupBy("counter").agg(F.count(F.lit(1)).alias("n")).collect()}
        late = found.get("late", 0) + sum(t["dropped"] for t in self.trace)
        return found | ({"late": late} if late else {})


def stepped(rows: DataFrame, spec: JobSpec, batches: list[int]) -> tuple[DataFrame, list[int]]:
    """rows with late and, as batch, the last batch of their step; the steps' batches.

    Rows are late by the watermark before their own batch. The engine's watermark before a step is at most that, so it
    drops nothing that is on time; final records don't depend on the watermarks at which rows are released.
    """
    marks = watermarks(rows, spec).select("batch", "wm_in")
    marked = rows.join(F.broadcast(marks) if len(batches) <= SMALL else marks, "batch")
    late = F.col("valid") & F.coalesce(F.col("ts") <= F.col("wm_in"), F.lit(False))
    count = min(len(batches), max(STEPS, -(-rows.count() // STEP_ROWS)))
    lasts = [batches[(k + 1) * len(batches) // count - 1] for k in range(count)]
    step = F.element_at(F.filter(F.lit(lasts), lambda x: x >= F.col("batch")), 1)
    return marked.select(*[step.cast(f.dataType).alias("batch") if f.name == "batch" else F.col(f.name) for f in rows.schema], late.alias("late")), lasts


def replay(rows: DataFrame, spec: JobSpec, folder: str, by_batch: bool = True) -> Replay:
    """rows(batch, ...) as one file per batch, in batch order, through the streaming job; or, not by batch, one per step of many batches.

    The flush is a control row on the reserved key an hour (or twice the gap or window) past the largest
    valid time, plus the delay; an empty batch follows and brings the watermark there.
    """
    spark = rows.sparkSession
    root = f"{folder}/replay-{uuid.uuid4().hex}"
    batches = [r["batch"] for r in rows.select("batch").distinct().orderBy("batch").collect()]
    margin = max(3_600_000, 2 * spec.gap_ms, 2 * spec.window_ms)  # all that is open closes
    target = rows.agg((F.max(F.when(F.col("valid"), F.col("ts"))) + margin).alias("t")).first()["t"]
    if target is None:
        return Replay(spark.createDataFrame([], FACT), {"drained": True, "target": None}, [])
    rows = rows.withColumn("key", F.col("key").cast("string"))
    last = rows.agg(F.max("arrival_seq").alias("a")).first()["a"]
    path = spark._jvm.org.apache.hadoop.fs.Path
    inbox = path(f"{root}/in")
    files = inbox.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.mkdirs(inbox)
    if not by_batch:
        rows, batches = stepped(rows, spec, batches)
        # read and dealt once; a step is one file, which comes to the inbox by rename
        rows.withColumn("step", F.col("batch")).repartition(len(batches), "step").write.partitionBy("step").parquet(f"{root}/steps")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    progress: dict[int, list] = {}

    if spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", "true") != "true":
        raise ValueError("micro-batches without data are off: what a watermark releases would wait for the next data")

    def note(batch: int):
        # the engine keeps only the latest entries (100 by default); a micro-batch can have several
        for p in query.recentProgress:
            own = progress.setdefault(p["batchId"], [])
            if p["timestamp"] not in [q["timestamp"] for _, q in own]:
                own.append((batch, p))

    query = facts_stream(source, spec).writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").start(f"{root}/out")
    try:
        for b in batches:
            if by_batch:
                rows.filter(F.col("batch") == b).coalesce(1).write.mode("append").parquet(f"{root}/in")
            else:
                for k, f in enumerate(files.globStatus(path(f"{root}/steps/step={b}/*.parquet"))):
                    if k or not files.rename(f.getPath(), path(f"{root}/in/step-{b}.parquet")):
                        raise ValueError(f"step {b} isn't one file")
            query.processAllAvailable()
            note(b)
        control = rows.limit(1).select(*[
            {"key": F.lit(rules.RESERVED_VIN), "event_id": F.lit(rules.CONTROL_ID), "ts": F.lit(target + spec.delay_ms), "arrival_seq": F.lit(last + 1), "batch": F.lit(batches[-1] + 1), "valid": F.lit(True), "late": F.lit(False)}.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in rows.schema
        ])
        control.coalesce(1).write.mode("append").parquet(f"{root}/in")
        query.processAllAvailable()
        note(batches[-1] + 1)
    finally:
        query.stop()
    facts = spark.read.schema(FACT).parquet(f"{root}/out")
    instant = lambda p: _millis(p["eventTime"].get("watermark"))
    trace = [
        {"batch": b, "micro_batch": p["batchId"], "watermark": instant(p), "rows": p["numInputRows"], "dropped": sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]), "state_rows": sum(s["numRowsTotal"] for s in p["stateOperators"])}
        for n in sorted(progress) for b, p in progress[n]
    ]
    reached = trace[-1]["watermark"] if trace else None
    return Replay(facts, {"target": target, "watermark": reached, "drained": reached == target, "state_rows": trace[-1]["state_rows"] if trace else 0}, trace)


def _millis(instant: str | None) -> int | None:
    """Milliseconds of an ISO instant; None before there is a watermark, which the engine shows as the epoch."""
    if not instant:
        return None
    at = datetime.fromisoformat(instant.replace("Z", "+00:00"))
    return round(at.timestamp() * 1000) or None
