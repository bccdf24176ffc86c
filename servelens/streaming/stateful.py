"""Keyed state machines on streams. Batch and stream share the walks of ``operators.state``.

Rows of one key are ordered within a trigger, for which only their numbers are held, no frames; bound
a trigger with the source's ``maxFilesPerTrigger``. A row older than the key's last one cannot change
what was given out: it comes out flagged as late, for the batch operator to settle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from servelens.operators.skew import salted
from servelens.operators.state import (
    FAILURE_THRESHOLD,
    MIN_CONTAINERS,
    NEVER,
    RECOMMENDATION_SCHEMA,
    RESET_MS,
    TRANSITION_SCHEMA,
    BreakerState,
    ProbeRun,
    ScaleState,
    ScalingLimits,
    recommendation_rows,
    transition_rows,
)
from servelens.session import use_state_store

WARMUP_SCHEMA = "container_id string, start_ms bigint, verdict string, took_ms bigint"


LATE = "LATE"


def _columns(rows: Iterator[pd.DataFrame], kinds: dict[str, type]) -> list[np.ndarray]:
    """The named columns of all frames; each frame is let go once they are copied."""
    parts = [[pdf[c].to_numpy(dtype=kind) for c, kind in kinds.items()] for pdf in rows]
    return [np.concatenate(x) for x in zip(*parts)]


class BreakerProcessor(StatefulProcessor):
    def __init__(self, threshold: int, reset_ms: int):
        self.threshold, self.reset_ms = threshold, reset_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("breaker", "resume bigint, failures int, last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        held = self.state.get() if self.state.exists() else (NEVER, 0, NEVER)
        ts, ids, ready = _columns(rows, {"ts_ms": np.int64, "event_id": np.int64, "ready": bool})
        late = ts < held[2]
        if late.any():
            yield pd.DataFrame(
                {
                    "host": key[0], "ts_ms": ts[late], "event_id": ids[late],
                    "step": np.zeros(late.sum(), np.int32), "from_state": LATE, "to_state": LATE,
                }
            )
        ts, ids, ready = ts[~late], ids[~late], ready[~late]
        if not len(ts):
            return
        order = np.lexsort((ids, ts))
        ts, ids, ready = ts[order], ids[order], ready[order]
        run = ProbeRun(ts, ready, self.threshold, self.reset_ms)
        out, state = transition_rows(key[0], run, ids, BreakerState(int(held[0]), int(held[1])))
        self.state.update((state.resume_ms, state.failures, int(ts[-1])))
        yield out

    def close(self) -> None:
        pass


def stream_breaker(
    probes: DataFrame, threshold: int = FAILURE_THRESHOLD, reset_ms: int = RESET_MS
) -> DataFrame:
    """Breaker transitions per host of a probe stream."""
    use_state_store(probes.sparkSession)
    return (
        probes.select("host", "ts_ms", "event_id", "ready")
        .groupBy("host")
        .transformWithStateInPandas(
            BreakerProcessor(threshold, reset_ms), TRANSITION_SCHEMA, "Append", "None"
        )
    )


class ScaleProcessor(StatefulProcessor):
    def __init__(self, initial_target: int, limits: ScalingLimits):
        self.initial_target, self.limits = initial_target, limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scale", "target int, changed_ms bigint, last_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        held = self.state.get() if self.state.exists() else (self.initial_target, NEVER, NEVER)
        tick, ts, load = _columns(rows, {"tick": np.int64, "ts_ms": np.int64, "load": float})
        late = ts <= held[2]
        if late.any():
            yield pd.DataFrame(
                {
                    "deployment": key[0], "tick": tick[late], "ts_ms": ts[late], "action": LATE,
                    "from_target": np.int32(held[0]), "to_target": np.int32(held[0]),
                }
            )
        pdf = pd.DataFrame({"deployment": key[0], "tick": tick[~late], "ts_ms": ts[~late], "load": load[~late]})
        if pdf.empty:
            return
        out, state = recommendation_rows(pdf, ScaleState(int(held[0]), int(held[1])), self.limits)
        self.state.update((state.target, state.changed_ms, int(pdf["ts_ms"].max())))
        yield out

    def close(self) -> None:
        pass


def stream_scaling(
    signal: DataFrame, initial_target: int = MIN_CONTAINERS, limits: ScalingLimits | None = None
) -> DataFrame:
    """Scale recommendations per deployment of a load-signal stream (one row per tick)."""
    use_state_store(signal.sparkSession)
    return (
        signal.select("deployment", "tick", "ts_ms", "load")
        .groupBy("deployment")
        .transformWithStateInPandas(
            ScaleProcessor(initial_target, limits or ScalingLimits()),
            RECOMMENDATION_SCHEMA,
            "Append",
            "None",
        )
    )


class ReadinessProcessor(StatefulProcessor):
    """A start arms a deadline; readiness before it gives ``warmup_ok``, else it ends in ``warmup_timeout``.

    A key is a group of containers. Their open starts are one packed value with one event-time timer, at
    the earliest deadline, so a container costs no call to the state store of its own.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts binary")
        self.alarm = handle.getValueState("alarm", "at_ms bigint")

    def _starts(self) -> dict[str, int]:
        if not self.open.exists():
            return {}
        with pa.ipc.open_stream(self.open.get()[0]) as stream:
            held = stream.read_all()
        return dict(zip(held["container_id"].to_pylist(), held["start_ms"].to_pylist()))

    def _hold(self, starts: dict[str, int]) -> None:
        """Keep the open starts, and one timer at the earliest of their deadlines."""
        at = max(min(starts.values()) + self.timeout_ms, 1) if starts else None
        held = self.alarm.get()[0] if self.alarm.exists() else None
        if held != at and held is not None:
            self.handle.deleteTimer(held)
        if not starts:
            self.open.clear()
            self.alarm.clear()
            return
        names = pa.array(list(starts.keys()), pa.string())
        block = pa.record_batch([names, pa.array(list(starts.values()), pa.int64())], ["container_id", "start_ms"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, block.schema) as stream:
            stream.write_batch(block)
        self.open.update((sink.getvalue().to_pybytes(),))
        if held != at:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        names, begins, ends, ts = _columns(
            (pdf.assign(begins=pdf["event"] == "start", ends=pdf["event"] == "probe_ready") for pdf in rows),
            {"container_id": object, "begins": bool, "ends": bool, "ts_ms": np.int64},
        )
        # Of rows of equal time starts come first.
        order = np.lexsort((ends, ts))
        starts, out = self._starts(), []
        for name, begin, end, at in zip(*(c[order].tolist() for c in (names, begins, ends, ts))):
            if begin:
                starts.setdefault(name, at)
            elif end and name in starts and at - starts[name] < self.timeout_ms:
                started = starts.pop(name)
                out.append((name, started, "warmup_ok", at - started))
        self._hold(starts)
        yield _warmups(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        starts = self._starts()
        over = [(name, at) for name, at in starts.items() if at + self.timeout_ms <= now]
        # Spark removes the timer that has fired by itself.
        self.alarm.clear()
        self._hold({name: at for name, at in starts.items() if at + self.timeout_ms > now})
        yield _warmups([(name, at, "warmup_timeout", None) for name, at in over])

    def close(self) -> None:
        pass


def _warmups(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["container_id", "start_ms", "verdict", "took_ms"])
    return pdf.astype({"start_ms": "int64", "took_ms": "Int64"})


#: Keys that the containers of a stream are dealt to.
READINESS_GROUPS = 512


def stream_readiness(events: DataFrame, timeout_ms: int) -> DataFrame:
    """Warm-up verdicts per container start; ``events`` carries a watermark on ``event_time``."""
    use_state_store(events.sparkSession)
    return (
        events.select(
            salted(["container_id"], READINESS_GROUPS).alias("containers"),
            "container_id", "event", "ts_ms", "event_time",
        )
        .groupBy("containers")
        .transformWithStateInPandas(
            ReadinessProcessor(timeout_ms), WARMUP_SCHEMA, "Append", "EventTime"
        )
    )
