"""A replay in steps of many batches against the batch plan."""

from pyspark.sql import functions as F

from ampline.operators import batch
from ampline.sources.events import SESSIONS, telemetry
from ampline.streaming.replay import replay
from ampline.streaming.stateful import session_records


def test_steps_give_the_records_and_counters_of_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ampline.streaming.replay.STEPS", 3)
    # ten batches, with rows behind the watermark
    rows = telemetry(spark, "/root/testdata/sf0.001").withColumn("batch", F.floor(F.col("arrival_seq") / 1000).cast("bigint"))
    rows = rows.withColumn("ts", F.when(F.col("arrival_seq") % 37 == 0, F.col("ts") - 40 * 3_600_000).otherwise(F.col("ts"))).localCheckpoint()
    done = replay(rows, SESSIONS, str(tmp_path), by_batch=False)
    assert done.drain["drained"] and len({t["batch"] for t in done.trace}) == 4  # and the flush
    classed = batch.classify(rows.withColumn("key", F.col("key").cast("string")), SESSIONS)
    want = {r["class"]: r["n"] for r in batch.histogram(classed).collect()}
    got = done.counters()
    assert want["late"] > 5 and {k: got.get(v, 0) for k, v in batch.CLASSES.items()} == {k: want.get(k, 0) for k in batch.CLASSES}
    wanted = batch.sessionize(batch.accepted(classed), SESSIONS).select(*batch.SESSION)
    assert sorted(map(tuple, session_records(done.facts).collect())) == sorted(map(tuple, wanted.collect()))
