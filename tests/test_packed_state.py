"""Waiting calls, and drains with their readings, in few calls to the state store."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from state_store import Store, Times, fire, tuples

from servelens.streaming import keyed


@pytest.mark.parametrize(("block", "read"), [(1 << 14, 32), (16, 2)])
def test_waiting_calls_are_blocks(monkeypatch, block, read):
    for name, value in {"BLOCK": block, "READ": read, "SORTED": 8 * block, "RELEASED": 2 * block}.items():
        monkeypatch.setattr(keyed, name, value)
    rng, store, window = random.Random(6), Store(), 100
    calls = [(rng.randrange(1, 3_000), i, 4, rng.choice([None, "x", "é"])) for i in range(3_000)]
    rows = pd.DataFrame(calls, columns=["ts_ms", "request_id", "rpm", "payload"])
    rows = rows.iloc[(rows["ts_ms"] + [rng.randrange(200) for _ in calls]).argsort(kind="stable")]
    processor = keyed.LimitProcessor(window, 0, None)
    processor.init(store)
    got = []
    for at in range(0, 3_000, 1_000):
        part = rows[at : at + 1_000]
        got += processor.handleInputRows(("b",), iter([part[:300], part[300:]]), Times(0))
        got += fire(processor, store, ("b",), int(rows["ts_ms"][: at + 1_000].max()) - 200)
    got += fire(processor, store, ("b",), 10_000)
    out = pd.concat(got)
    first, places, want = min(t for t, *_ in calls), {}, {}
    for t, i, n, p in sorted(calls, key=lambda c: c[:2]):
        start = first + (t - first) // window * window
        places[start] = places.get(start, 0) + 1
        want[i] = (t, start, places[start], p)
    found = {r.request_id: (r.ts_ms, r.window_start_ms, r.place, r.payload) for r in out.itertuples()}
    assert found == want and len(out) == 3_000 and not out["late"].any() and not store.timers
    assert not processor.waiting.table
    assert store.calls < (200 if read == 32 else 4_000)


def test_drains_share_a_timer():
    rng, store, timeout = random.Random(7), Store(), 60
    rows = [(True, rng.randrange(1, 2_000), i, 0) for i in range(800)]
    rows += [(False, rng.randrange(1, 2_000), i, rng.choice([0, 3, 5, 1, 2, 4, 7, 9])) for i in range(800, 1_200)]
    rows = sorted(rows, key=lambda r: r[1])
    frame = pd.DataFrame(rows, columns=["drain", "ts_ms", "event_id", "depth"])
    processor = keyed.DrainProcessor(timeout)
    processor.init(store)
    got = []
    for at in range(0, 1_200, 400):
        part = frame[at : at + 400]
        # Backwards inside a trigger.
        got += processor.handleInputRows(("c",), iter([part[::-1][:150], part[::-1][150:]]), Times(int(part["ts_ms"].min()) - 1))
        got += fire(processor, store, ("c",), int(part["ts_ms"].max()) - 1)
    got += fire(processor, store, ("c",), 10_000)
    read = sorted((t, i, d) for drain, t, i, d in rows if not drain)
    want = set()
    for _, at, number, _ in (r for r in rows if r[0]):
        before = [d for t, _, d in read if t <= at]
        inside = [d for t, _, d in read if at <= t < at + timeout]
        last = [d for t, _, d in read if t < at + timeout]
        left = 0 if not before or before[-1] <= 0 or 0 in inside else last[-1]
        want.add(("c", number, at, "drain_timeout" if left > 0 else "drained", left))
    assert set(tuples(got)) == want and {w[3] for w in want} == {"drained", "drain_timeout"}
    # One timer at a time; before, one for each drain.
    assert store.calls < 200 and not store.timers
