"""Order-dependent state: health-check breakers and scale recommendations.

The state machines jump from transition to transition over sorted arrays instead of stepping
through rows. A long history of one host is cut into time chunks that are walked in parallel:
each chunk is summarised for every state it may be entered with, the short list of summaries is
chained per host, and each chunk is then walked once more from its known entry state.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servelens.operators.skew import time_slice

# Health-check breaker and scaling defaults.
FAILURE_THRESHOLD = 5
RESET_MS = 30_000
UP_THRESHOLD, DOWN_THRESHOLD = 0.7, 0.2
MIN_CONTAINERS, MAX_CONTAINERS = 1, 10
COOLDOWN_MS = 60_000

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"
NEVER = -1


class BreakerState(NamedTuple):
    """``resume_ms`` is when an open breaker lets a probe through, NEVER while closed."""

    resume_ms: int = NEVER
    failures: int = 0


class ProbeRun:
    """Probes of one host in time order."""

    def __init__(self, ts: np.ndarray, ready: np.ndarray, threshold: int, reset_ms: int):
        self.ts, self.ready = ts, ready
        self.threshold, self.reset_ms = threshold, reset_ms
        self.n = len(ts)
        index = np.arange(self.n)
        self.ok = np.flatnonzero(ready)
        streak = index - np.maximum.accumulate(np.where(ready, index, -1)) if self.n else index
        self.streak = streak
        self.tripping = np.flatnonzero(streak >= threshold)
        self._exits: dict[int, BreakerState] = {}

    def trips_at(self, i: int, failures: int) -> int:
        """Probe that opens a breaker closed ahead of probe ``i``; ``n`` if none does."""
        if failures:
            p = np.searchsorted(self.ok, i)
            next_ok = int(self.ok[p]) if p < len(self.ok) else self.n
            if next_ok - i >= self.threshold - failures:
                return i + self.threshold - failures - 1
            i = next_ok + 1
        p = np.searchsorted(self.tripping, i + self.threshold - 1)
        return int(self.tripping[p]) if p < len(self.tripping) else self.n

    def closed_exit(self, i: int, failures: int) -> BreakerState:
        """State at the end of a run that stays closed from probe ``i`` on."""
        if i >= self.n:
            return BreakerState(NEVER, failures)
        tail = int(self.streak[-1])
        return BreakerState(NEVER, failures + self.n - i if tail >= self.n - i else tail)

    def probe_at(self, resume_ms: int, i: int) -> int:
        return max(i, int(np.searchsorted(self.ts, resume_ms)))

    def walk(self, state: BreakerState) -> Iterator[tuple[int, str, str] | BreakerState]:
        """Yield (probe index, from, to) for each transition, then the final state."""
        i, (resume, failures) = 0, state
        while True:
            if resume == NEVER:
                j = self.trips_at(i, failures)
                if j >= self.n:
                    yield self.closed_exit(i, failures)
                    return
                yield j, CLOSED, OPEN
                resume, failures = int(self.ts[j]) + self.reset_ms, 0
            else:
                j = self.probe_at(resume, i)
                if j >= self.n:
                    yield BreakerState(resume, 0)
                    return
                yield j, OPEN, HALF_OPEN
                if self.ready[j]:
                    yield j, HALF_OPEN, CLOSED
                    resume, failures = NEVER, 0
                else:
                    yield j, HALF_OPEN, OPEN
                    resume = int(self.ts[j]) + self.reset_ms
            i = j + 1

    def exit_state(self, state: BreakerState) -> BreakerState:
        last = None
        for last in self.walk(state):
            pass
        return last

    def exit_from_half_open(self, j: int) -> BreakerState:
        """Final state when probe ``j`` is the one let through; shared tails are walked once."""
        path: list[int] = []
        while True:
            if j in self._exits:
                final = self._exits[j]
                break
            path.append(j)
            if self.ready[j]:
                trip = self.trips_at(j + 1, 0)
                if trip >= self.n:
                    final = self.closed_exit(j + 1, 0)
                    break
                resume, after = int(self.ts[trip]) + self.reset_ms, trip + 1
            else:
                resume, after = int(self.ts[j]) + self.reset_ms, j + 1
            nxt = self.probe_at(resume, after)
            if nxt >= self.n:
                final = BreakerState(resume, 0)
                break
            j = nxt
        self._exits.update(dict.fromkeys(path, final))
        return final


def _sorted_run(pdf: pd.DataFrame, threshold: int, reset_ms: int):
    order = np.lexsort((pdf["event_id"].to_numpy(), pdf["ts_ms"].to_numpy()))
    ids = pdf["event_id"].to_numpy()[order]
    run = ProbeRun(
        pdf["ts_ms"].to_numpy()[order],
        pdf["ready"].to_numpy(dtype=bool)[order],
        threshold,
        reset_ms,
    )
    return run, ids


SUMMARY_SCHEMA = """
  host string, chunk bigint, entry_failures array<int>, entry_until array<bigint>,
  exit_resume array<bigint>, exit_failures array<int>
"""


def _summarise(key: tuple, pdf: pd.DataFrame, threshold: int, reset_ms: int, chunk_ms: int):
    """Exit state for each entry state of one chunk.

    Closed entries come first, one per failure count. Open entries are intervals of the resume
    time, cut only where the outcome changes; a resume time past the last probe leaves the chunk
    as it came in and needs no row.
    """
    run, _ = _sorted_run(pdf, threshold, reset_ms)
    entry_failures = list(range(threshold))
    exits = [run.exit_state(BreakerState(NEVER, c)) for c in entry_failures]
    until: list[int] = []
    # An open breaker was opened before the chunk began, so it resumes within one reset time.
    last = min(run.n - 1, int(np.searchsorted(run.ts, (int(key[1]) * chunk_ms) + reset_ms)))
    for j in range(last + 1):
        final = run.exit_from_half_open(j)
        if until and exits[-1] == final:
            until[-1] = int(run.ts[j])
        else:
            until.append(int(run.ts[j]))
            exits.append(final)
    return pd.DataFrame(
        {
            "host": [key[0]],
            "chunk": [key[1]],
            "entry_failures": [entry_failures],
            "entry_until": [until],
            "exit_resume": [[s.resume_ms for s in exits]],
            "exit_failures": [[s.failures for s in exits]],
        }
    )


ENTRY_SCHEMA = "host string, chunk bigint, entry_resume bigint, entry_count int"


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry state of every chunk of one host from the summaries, in chunk order."""
    pdf = pdf.sort_values("chunk")
    state = BreakerState()
    entries = []
    for row in pdf.itertuples(index=False):
        entries.append((row.host, row.chunk, state.resume_ms, state.failures))
        if state.resume_ms == NEVER:
            at = state.failures
        else:
            p = int(np.searchsorted(np.asarray(row.entry_until, dtype=np.int64), state.resume_ms))
            if p == len(row.entry_until):
                continue
            at = len(row.entry_failures) + p
        state = BreakerState(int(row.exit_resume[at]), int(row.exit_failures[at]))
    return pd.DataFrame(entries, columns=["host", "chunk", "entry_resume", "entry_count"])


TRANSITION_SCHEMA = (
    "host string, ts_ms bigint, event_id bigint, step int, from_state string, to_state string"
)


def transition_rows(host: str, run: ProbeRun, ids: np.ndarray, state: BreakerState):
    """Transition rows of a walk and the state it ends in."""
    rows = []
    for item in run.walk(state):
        if isinstance(item, BreakerState):
            state = item
        else:
            j, before, after = item
            step = 1 if before == HALF_OPEN else 0
            rows.append((host, int(run.ts[j]), int(ids[j]), step, before, after))
    columns = ["host", "ts_ms", "event_id", "step", "from_state", "to_state"]
    return pd.DataFrame(rows, columns=columns), state


def breaker_transitions(
    probes: DataFrame,
    threshold: int = FAILURE_THRESHOLD,
    reset_ms: int = RESET_MS,
    chunk_ms: int = 3_600_000,
) -> DataFrame:
    """State changes per host of (host, ts_ms, event_id, ready), ordered by (ts_ms, event_id).

    ``threshold`` failures in a row open the breaker; while open, probes are skipped; the first
    probe at least ``reset_ms`` later decides between closing and opening again. One task holds
    the probes of one (host, chunk); choose ``chunk_ms`` so that this fits.
    """
    keyed = probes.select(
        "host", "ts_ms", "event_id", "ready", time_slice("ts_ms", chunk_ms).alias("chunk")
    )

    def summarise(key, pdf):
        return _summarise(key, pdf, threshold, reset_ms, chunk_ms)

    def replay(key, pdf):
        run, ids = _sorted_run(pdf, threshold, reset_ms)
        entry = BreakerState(int(pdf["entry_resume"].iloc[0]), int(pdf["entry_count"].iloc[0]))
        return transition_rows(key[0], run, ids, entry)[0]

    summaries = keyed.groupBy("host", "chunk").applyInPandas(summarise, SUMMARY_SCHEMA)
    entries = summaries.groupBy("host").applyInPandas(_chain, ENTRY_SCHEMA)
    return (
        keyed.join(entries, ["host", "chunk"])
        .groupBy("host", "chunk")
        .applyInPandas(replay, TRANSITION_SCHEMA)
    )


class ScaleState(NamedTuple):
    target: int
    changed_ms: int = NEVER


class ScalingLimits(NamedTuple):
    up: float = UP_THRESHOLD
    down: float = DOWN_THRESHOLD
    minimum: int = MIN_CONTAINERS
    maximum: int = MAX_CONTAINERS
    cooldown_ms: int = COOLDOWN_MS


def scale_steps(ts: np.ndarray, load: np.ndarray, state: ScaleState, limits: ScalingLimits):
    """Yield (index, from, to) for each change over loads in time order, then the final state."""
    high, low = np.flatnonzero(load > limits.up), np.flatnonzero(load < limits.down)
    n, i = len(ts), 0
    target, changed = state

    def first(candidates: np.ndarray, start: int) -> int:
        p = np.searchsorted(candidates, start)
        return int(candidates[p]) if p < len(candidates) else n

    while True:
        if changed != NEVER:
            i = max(i, int(np.searchsorted(ts, changed + limits.cooldown_ms)))
        up = first(high, i) if target < limits.maximum else n
        down = first(low, i) if target > limits.minimum else n
        j = min(up, down)
        if j >= n:
            yield ScaleState(target, changed)
            return
        new = target + 1 if j == up else target - 1
        yield j, target, new
        target, changed, i = new, int(ts[j]), j + 1


RECOMMENDATION_SCHEMA = (
    "deployment string, tick bigint, ts_ms bigint, action string, from_target int, to_target int"
)


def recommendation_rows(pdf: pd.DataFrame, state: ScaleState, limits: ScalingLimits):
    pdf = pdf.sort_values("tick")
    rows = []
    for item in scale_steps(pdf["ts_ms"].to_numpy(), pdf["load"].to_numpy(), state, limits):
        if isinstance(item, ScaleState):
            state = item
        else:
            j, before, after = item
            row = pdf.iloc[j]
            action = "scale_up" if after > before else "scale_down"
            rows.append((row["deployment"], int(row["tick"]), int(row["ts_ms"]), action, before, after))
    columns = ["deployment", "tick", "ts_ms", "action", "from_target", "to_target"]
    return pd.DataFrame(rows, columns=columns), state


def scale_recommendations(
    signal: DataFrame, initial_target: int = MIN_CONTAINERS, limits: ScalingLimits | None = None
) -> DataFrame:
    """Target changes per deployment from (deployment, tick, ts_ms, load).

    The input has one row per deployment and tick, so a group is bounded by elapsed time, however
    many scrapes went into it. The first change is free of the cooldown.
    """
    bounds = limits or ScalingLimits()

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        return recommendation_rows(pdf, ScaleState(initial_target), bounds)[0]

    return (
        signal.select("deployment", "tick", "ts_ms", "load")
        .groupBy("deployment")
        .applyInPandas(walk, RECOMMENDATION_SCHEMA)
    )
