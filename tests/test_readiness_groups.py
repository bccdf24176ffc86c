"""Readiness of many containers in one key."""

from __future__ import annotations

import random

import pandas as pd
from state_store import Store, Times, fire, tuples

from servelens.streaming.stateful import ReadinessProcessor


def test_containers_of_a_group_share_their_state():
    rng, store, timeout = random.Random(3), Store(), 100
    names = [f"c{i}" for i in range(500)]
    events = [(n, "start", rng.randrange(1, 400)) for n in names]
    events += [(n, "probe_ready", t + rng.randrange(0, 200)) for n, _, t in events if rng.random() < 0.7]
    rows = pd.DataFrame(events, columns=["container_id", "event", "ts_ms"]).sort_values("ts_ms", kind="stable")
    processor = ReadinessProcessor(timeout)
    processor.init(store)
    got = []
    for low in range(0, 700, 350):
        part = rows[(rows["ts_ms"] >= low) & (rows["ts_ms"] < low + 350)]
        got += processor.handleInputRows((0,), iter([part[:100], part[100:]]), Times(low))
        got += fire(processor, store, (0,), min(low + 350, int(part["ts_ms"].max())))
    got += fire(processor, store, (0,), 10_000)
    started = {n: t for n, e, t in events if e == "start"}
    ready = {n: t - started[n] for n, e, t in events if e == "probe_ready"}
    want = {
        (n, t, "warmup_ok", ready[n]) if ready.get(n, timeout) < timeout else (n, t, "warmup_timeout", None)
        for n, t in started.items()
    }
    assert sorted(map(str, tuples(got))) == sorted(map(str, want)) and not store.timers
    # No call per container.
    assert store.calls < 100
