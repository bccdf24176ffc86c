"""State processors against a store in memory that counts its calls."""

from __future__ import annotations

import pandas as pd


class Store:
    """What a processor asks of its handle."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def _state(self):
        store = self

        class State:
            def __init__(self):
                self.value, self.table = None, {}

            def exists(self):
                store.calls += 1
                return self.value is not None or bool(self.table)

            def get(self):
                store.calls += 1
                return self.value

            def update(self, value):
                store.calls += 1
                self.value = value

            def clear(self):
                store.calls += 1
                self.value, self.table = None, {}

            def getValue(self, key):
                store.calls += 1
                return self.table.get(key)

            def updateValue(self, key, value):
                store.calls += 1
                self.table[key] = value

            def removeKey(self, key):
                store.calls += 1
                self.table.pop(key, None)

        return State()

    def getValueState(self, name, schema):
        return self._state()

    def getMapState(self, name, key, value):
        return self._state()

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


class Expiry:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def fire(processor, store, key, watermark):
    """All timers that the watermark has passed, as Spark fires them."""
    out = []
    while due := [t for t in store.timers if t <= watermark]:
        at = min(due)
        out += processor.handleExpiredTimer(key, Times(watermark), Expiry(at)) or []
        store.timers.discard(at)
    return out


def tuples(frames):
    return [tuple(None if pd.isna(v) else getattr(v, "item", lambda v=v: v)() for v in r) for f in frames for r in f.itertuples(index=False)]
