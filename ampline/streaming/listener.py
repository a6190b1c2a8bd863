"""Counts what streaming queries drop as late, from their progress events."""

from __future__ import annotations

import json
import os

from pyspark.sql.streaming.listener import StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Rows dropped by the watermark, by query run, over all triggers, those without data too.

    With a path, the counts are written there as JSON after every event, by
    rename. Events come after their trigger, on another thread.
    """

    def __init__(self, path: str | None = None):
        self.path = path
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.runId), 0)

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        run = str(progress.runId)
        self.dropped[run] = self.dropped.get(run, 0) + sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
        if self.path:
            with open(f"{self.path}.new", "w") as f:
                json.dump(self.dropped, f)
            os.replace(f"{self.path}.new", self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
