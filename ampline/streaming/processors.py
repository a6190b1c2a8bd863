"""State machines of the two jobs; no clock but event time. State is JSON-friendly."""

from __future__ import annotations

from typing import Any, Protocol

from ampline.functions.rules import MAX_TS
from ampline.operators.batch import JobSpec


class EventTimeProcessor(Protocol):
    def on_event(self, event: dict, state: dict) -> list[dict]: ...

    def on_watermark(self, watermark: int, state: dict) -> list[dict]: ...

    def next_timeout(self, state: dict) -> int: ...

    def is_open(self, state: dict) -> bool: ...


class Sessions:
    """A session opens with PLUG_IN and closes on UNPLUG, the next PLUG_IN or a gap."""

    def __init__(self, spec: JobSpec):
        self.gap = spec.gap_ms

    def _close(self, state: dict, end: int, reason: str) -> list[dict]:
        s: dict[str, Any] = state.pop("open")
        return [{"opened_by": s["id"], "start_ts": s["start"], "end_ts": end, "total_energy_wh": s["energy"], "lat": s["lat"], "lon": s["lon"], "charger_type": s["type"], "close_reason": reason}]

    def on_event(self, event: dict, state: dict) -> list[dict]:
        out = []
        if "open" in state and event["ts"] - state["open"]["last"] > self.gap:
            out += self._close(state, state["open"]["last"], "INACTIVITY_TIMEOUT")
        if event["event"] == "PLUG_IN":
            if "open" in state:
                out += self._close(state, state["open"]["last"], "REPLACED_BY_PLUG_IN")
            state["open"] = {"id": event["event_id"], "start": event["ts"], "last": event["ts"], "energy": 0, "lat": event["lat"], "lon": event["lon"], "type": event["charger_type"]}
        elif "open" not in state:
            return [*out, {"counter": "orphan"}]
        state["open"]["last"] = event["ts"]
        state["open"]["energy"] += event["energy_wh"]
        if event["event"] == "UNPLUG":
            out += self._close(state, event["ts"], "UNPLUG")
        return out

    def on_watermark(self, watermark: int, state: dict) -> list[dict]:
        if "open" in state and state["open"]["last"] + self.gap < watermark:
            return self._close(state, state["open"]["last"], "INACTIVITY_TIMEOUT")
        return []

    def next_timeout(self, state: dict) -> int:
        return state["open"]["last"] + self.gap if "open" in state else MAX_TS

    def is_open(self, state: dict) -> bool:
        return "open" in state


class Windows:
    """Tumbling windows, final once the watermark reaches their end."""

    def __init__(self, spec: JobSpec):
        self.size = spec.window_ms

    def on_event(self, event: dict, state: dict) -> list[dict]:
        start = event["ts"] - event["ts"] % self.size
        w = state.setdefault(str(start), {"sum": 0.0, "n": 0, "soh": event["soh_pct"], "temp": event["cell_temp_max_c"]})
        w["sum"] += event["soc_pct"]
        w["n"] += 1
        w["soh"], w["temp"] = min(w["soh"], event["soh_pct"]), max(w["temp"], event["cell_temp_max_c"])
        return []

    def on_watermark(self, watermark: int, state: dict) -> list[dict]:
        done = sorted(int(s) for s in state if int(s) + self.size <= watermark)
        closed = [(s, state.pop(str(s))) for s in done]
        return [{"window_start": s, "avg_soc_pct": w["sum"] / w["n"], "min_soh_pct": w["soh"], "max_cell_temp_c": w["temp"], "event_count": w["n"]} for s, w in closed]

    def next_timeout(self, state: dict) -> int:
        return min((int(s) + self.size - 1 for s in state), default=MAX_TS)

    def is_open(self, state: dict) -> bool:
        return bool(state)
