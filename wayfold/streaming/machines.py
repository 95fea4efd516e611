"""Small per-document machines, shared by the batch and the streaming runs.

A machine keeps a JSON-able ``state``; ``feed`` takes one event in order of
time and yields finished rows; ``due`` says when an open row closes by itself
and ``close`` yields it. Times are epoch milliseconds.
"""

from __future__ import annotations

# ---- fixed values: timings in milliseconds -----------------------------------
DEBOUNCE, CEILING, STATE_GAP = 900, 3000, 2000
BREAKER_RECORDS, BREAKER_WINDOW, BREAKER_COOLDOWN = 500, 1000, 10000
HINT_TTL = 15000
ACTION_WINDOW = 5000


class Bursts:
    """Bursts of triggers: close after a quiet gap, or a ceiling after start or change of route.

    The first trigger that is not ``dom-change`` names the burst and lends it
    its time. With ``state_gap`` a burst that would close too soon after the
    last one waits, and what arrives meanwhile joins it; ``manual`` never waits.
    All triggers are named, or the first ``named`` if asked.
    """

    inputs = ("ts_ms", "trigger", "route")
    schema = "started_ms bigint, fired_ms bigint, trigger string, trigger_ms bigint, n_events bigint, triggers string"

    def __init__(self, gap=DEBOUNCE, ceiling=CEILING, state_gap=0, named=None):
        self.gap, self.ceiling, self.state_gap, self.named = gap, ceiling, state_gap, named
        self.state = {"open": None, "stored": None}

    def due(self):
        o = self.state["open"]
        if o is None:
            return None
        at = min(o["last"] + self.gap, o["ceiling_from"] + self.ceiling)
        if self.state_gap and o["trigger"] != "manual" and self.state["stored"] is not None:
            at = max(at, self.state["stored"] + self.state_gap)
        return max(at, o["last"])

    def close(self):
        o = self.state["open"]
        if o is None:
            return
        at = self.due()
        said = ",".join(f"{t} (x{n})" if n > 1 else t for t, n in o["said"])
        self.state = {"open": None, "stored": at}
        yield o["start"], at, o["trigger"], o["trigger_ms"], o["n"], said

    def feed(self, e):
        ts, trigger, route = int(e["ts_ms"]), e["trigger"], e["route"]
        if self.state["open"] is not None and ts >= self.due():
            yield from self.close()
        o = self.state["open"]
        if o is None:
            o = self.state["open"] = {"start": ts, "ceiling_from": ts, "route": route, "last": ts, "trigger": trigger, "trigger_ms": ts, "n": 0, "said": []}
        elif o["trigger"] == "dom-change" and trigger != "dom-change":
            o["trigger"], o["trigger_ms"] = trigger, ts
        if route != o["route"]:
            o["route"], o["ceiling_from"] = route, ts
        o["last"], o["n"] = ts, o["n"] + 1
        if o["said"] and o["said"][-1][0] == trigger:
            o["said"][-1][1] += 1
        elif self.named is None or len(o["said"]) < self.named:
            o["said"].append([trigger, 1])


class VolumeBreaker:
    """Cuts ``dom-change`` for a while after too many records in one window.

    A window starts at the first record after the last one ended.
    """

    inputs = ("ts_ms", "trigger", "records")
    schema = "ts_ms bigint, trigger string, kept boolean, degraded boolean"

    def __init__(self, limit=BREAKER_RECORDS, window=BREAKER_WINDOW, cooldown=BREAKER_COOLDOWN):
        self.limit, self.window, self.cooldown = limit, window, cooldown
        self.state = {"start": None, "n": 0, "until": None}

    def due(self):
        return None

    def close(self):
        return ()

    def feed(self, e):
        s, ts = self.state, int(e["ts_ms"])
        if s["start"] is None or ts - s["start"] > self.window:
            s["start"], s["n"] = ts, 0
        s["n"] += int(e["records"])
        if s["n"] > self.limit and (s["until"] is None or ts >= s["until"]):
            s["until"] = ts + self.cooldown
        cut = s["until"] is not None and ts < s["until"]
        yield ts, e["trigger"], not (cut and e["trigger"] == "dom-change"), cut


class Neighbours:
    """States that differ from the one before, with the one before: dedupe and edges in one pass."""

    inputs = ("ts_ms", "id", "signature", "trigger", "route")
    schema = "ts_ms bigint, id string, trigger string, duplicate_of string, from_id string, route_changed boolean"

    def __init__(self):
        self.state = {"id": None, "signature": None, "route": None}

    def due(self):
        return None

    def close(self):
        return ()

    def feed(self, e):
        s = self.state
        same = s["id"] is not None and s["signature"] == e["signature"]
        if same and e["trigger"] != "manual":
            return
        before = dict(s)
        s.update(id=e["id"], signature=e["signature"], route=e["route"])
        yield int(e["ts_ms"]), e["id"], e["trigger"], before["id"] if same else None, before["id"], None if before["id"] is None else before["route"] != e["route"]


class PauseGate:
    """Records while recording runs; ``paused`` and ``resumed`` arrive on the same line."""

    inputs = ("ts_ms", "id", "kind")
    schema = "ts_ms bigint, id string"

    def __init__(self):
        self.state = {"paused": False}

    def due(self):
        return None

    def close(self):
        return ()

    def feed(self, e):
        if e["kind"] in ("paused", "resumed"):
            self.state["paused"] = e["kind"] == "paused"
        elif not self.state["paused"]:
            yield int(e["ts_ms"]), e["id"]


class LastSeen:
    """Rows met with the latest ``mark`` before them inside a window; optionally used up by the first.

    Serves calls after actions (not used up) and downloads after hints (used up).
    """

    inputs = ("ts_ms", "id", "kind")
    schema = "ts_ms bigint, id string, mark_id string"

    def __init__(self, window=ACTION_WINDOW, consume=False):
        self.window, self.consume = window, consume
        self.state = {"id": None, "at": None}

    def due(self):
        return None

    def close(self):
        return ()

    def feed(self, e):
        s, ts = self.state, int(e["ts_ms"])
        if e["kind"] == "mark":
            s["id"], s["at"] = e["id"], ts
            return
        hit = s["id"] if s["at"] is not None and ts - s["at"] <= self.window else None
        if hit is not None and self.consume:
            s["id"], s["at"] = None, None
        yield ts, e["id"], hit


class MenuMemory:
    """Menu items of a state, and those seen earlier in its document as no longer visible.

    One event per item sighting, states in order; the memory keeps all items, or the
    most recently seen if asked, and shows all or so many per state.
    """

    inputs = ("ts_ms", "state_id", "item")
    schema = "state_id string, item string, visible boolean"

    def __init__(self, memory=None, shown=None):
        self.memory, self.shown = memory, shown
        self.state = {"seen": [], "now": None, "items": []}

    def due(self):
        return None

    def close(self):
        s = self.state
        if s["now"] is None:
            return
        here = list(dict.fromkeys(s["items"]))
        now = set(here)
        before = [i for i in s["seen"] if i not in now]
        gone = before[::-1] if self.shown is None else before[::-1][: max(0, self.shown - len(here))]
        yield from ((s["now"], i, True) for i in here)
        yield from ((s["now"], i, False) for i in gone)
        s["seen"] = before + here
        if self.memory is not None:
            s["seen"] = s["seen"][max(0, len(s["seen"]) - self.memory) :]
        s["now"], s["items"] = None, []

    def feed(self, e):
        if e["state_id"] != self.state["now"]:
            yield from self.close()
            self.state["now"] = e["state_id"]
        self.state["items"].append(e["item"])
