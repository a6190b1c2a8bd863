"""The replay's late count where the engine has forgotten the batches that dropped rows."""

from ampline.operators import batch
from ampline.streaming.replay import replay
from tests.test_jobs import CASES, rows


def test_late_rows_are_counted_past_the_kept_progress(spark, tmp_path):
    df = rows(spark, *CASES["late is not remembered"][0], *[(b, 10 + b, 26 + b, "PROGRESS", 1) for b in range(3, 7)])
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    try:
        done = replay(df, batch.CHARGING, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    seen = [t["micro_batch"] for t in done.trace]
    assert done.counters()["late"] == 1 and seen == sorted(set(seen)) and seen[0] == 0 and len(seen) > 6
