"""The listener's late count against the replay's own trace."""

import json
import time

from ampline.operators import batch
from ampline.streaming.listener import LateRows
from ampline.streaming.replay import replay
from tests.test_jobs import CASES, rows


def test_late_rows(spark, tmp_path):
    heard = LateRows(str(tmp_path / "late.json"))
    spark.streams.addListener(heard)
    try:
        done = replay(rows(spark, *CASES["late is not remembered"][0]), batch.CHARGING, str(tmp_path))
        dropped = sum(t["dropped"] for t in done.trace)
        end = time.time() + 20
        while sum(heard.dropped.values()) < dropped and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(heard)
    assert len(heard.dropped) == 1 and sum(heard.dropped.values()) == dropped
    assert json.loads((tmp_path / "late.json").read_text()) == heard.dropped
