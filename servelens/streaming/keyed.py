"""Keyed state with event-time timers: rate limits, drains and rosters on streams whose rows come out of
order.

Each processor keeps what a later row may still need, and no more: a timer lets it go once the
watermark has passed. Rows that come after that are flagged or can't change anything. One key's rows
of a trigger are in one task; bound a trigger with the source's ``maxFilesPerTrigger``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from servelens.operators.fleet import DRAIN_TIMEOUT_MS
from servelens.operators.quota import WINDOW_MS
from servelens.operators.skew import SALTS, salted
from servelens.session import use_state_store
from servelens.streaming.aggregates import event_time

#: Bucket names of calls that no bucket counts; a bucket of a rule never begins so.
UNCOUNTED = "none|"

PLACED = (
    "bucket string, request_id bigint, ts_ms bigint, event_time timestamp, rpm int, "
    "window_start_ms bigint, place bigint, capacity int, late boolean, payload string"
)


def _placed(bucket, ts, ids, rpm, payload, start=None, place=None, capacity=None, late=False):
    counted = start is not None
    return pd.DataFrame(
        {
            "bucket": bucket,
            "request_id": ids,
            "ts_ms": ts,
            "event_time": pd.to_datetime(ts, unit="ms"),
            "rpm": pd.array(rpm, "Int32"),
            "window_start_ms": pd.array(start if counted else [None] * len(ts), "Int64"),
            "place": pd.array(place if counted else [None] * len(ts), "Int64"),
            "capacity": pd.array([capacity] * len(ts), "Int32"),
            "late": late,
            "payload": payload,
        }
    )


WAITING = pa.schema(
    [("ts_ms", pa.int64()), ("request_id", pa.int64()), ("rpm", pa.int64()), ("payload", pa.large_string())]
)
#: Calls of a block, calls that are sorted before they are cut into blocks, blocks read at a time, and
#: calls given out at a time.
BLOCK, SORTED, READ, RELEASED = 1 << 14, 1 << 18, 32, 1 << 16


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="lz4")
    with pa.ipc.new_stream(sink, rows.schema, options=options) as stream:
        stream.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


def _unpacked(block: bytes) -> pa.Table:
    with pa.ipc.open_stream(block) as stream:
        return stream.read_all()


class LimitProcessor(StatefulProcessor):
    """Places of a bucket's calls in its windows, in the order of (ts_ms, request_id).

    Calls wait in compressed blocks until the watermark, moved on by the grace time, has passed them; a
    timer at the earliest of them releases what is due, a few blocks at a time. A call before the last one
    released is late.
    """

    def __init__(self, window_ms: int, grace_ms: int, idle_ms: int | None):
        self.window_ms, self.grace_ms, self.idle_ms = window_ms, grace_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState(
            "bucket",
            "first_ms bigint, capacity int, window_start_ms bigint, used bigint, last_ms bigint, last_id bigint",
        )
        # Pairs (first time, number) of the blocks of waiting calls.
        self.index = handle.getValueState("index", "blocks binary")
        self.waiting = handle.getMapState("waiting", "number bigint", "block binary")
        self.alarm = handle.getValueState("alarm", "at_ms bigint")

    def _blocks(self) -> np.ndarray:
        held = self.index.get()[0] if self.index.exists() else b""
        return np.frombuffer(held, np.int64).reshape(-1, 2)

    def _keep(self, calls: pa.RecordBatch | pa.Table, blocks: list[tuple[int, int]], number: int) -> int:
        """Add ``calls`` as blocks that follow each other in time, to the store and to ``blocks``; the next number."""
        calls = calls.sort_by([("ts_ms", "ascending"), ("request_id", "ascending")])
        for at in range(0, calls.num_rows, BLOCK):
            part = calls.slice(at, BLOCK)
            self.waiting.updateValue((number,), (_packed(part),))
            blocks.append((part["ts_ms"][0].as_py(), number))
            number += 1
        return number

    def _hold(self, blocks: list[tuple[int, int]]) -> None:
        self.index.update((np.array(sorted(blocks), np.int64).tobytes(),))

    def _wake(self, at_ms: int) -> None:
        """One timer for each bucket, at the earliest time asked for."""
        at_ms = max(at_ms, 1)
        if self.alarm.exists():
            (held,) = self.alarm.get()
            if held <= at_ms:
                return
            self.handle.deleteTimer(held)
        self.handle.registerTimer(at_ms)
        self.alarm.update((at_ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        if key[0].startswith(UNCOUNTED):
            for pdf in rows:
                yield _placed(None, pdf["ts_ms"], pdf["request_id"], pdf["rpm"], pdf["payload"])
            return
        *_, last_ms, last_id = self.bucket.get() if self.bucket.exists() else (None, None)
        blocks = [tuple(b) for b in self._blocks().tolist()]
        number = max((n for _, n in blocks), default=-1) + 1
        old, fresh, size = len(blocks), [], 0
        for pdf in rows:
            if last_ms is not None:
                late = (pdf["ts_ms"] < last_ms) | ((pdf["ts_ms"] == last_ms) & (pdf["request_id"] < last_id))
                gone, pdf = pdf[late], pdf[~late]
                if len(gone):
                    yield _placed(key[0], gone["ts_ms"], gone["request_id"], gone["rpm"], gone["payload"], late=True)
            if len(pdf):
                fresh.append(pa.RecordBatch.from_pandas(pdf, schema=WAITING, preserve_index=False))
                size += len(pdf)
            if size >= SORTED:
                number = self._keep(pa.Table.from_batches(fresh), blocks, number)
                fresh, size = [], 0
        if fresh:
            self._keep(pa.Table.from_batches(fresh), blocks, number)
        if len(blocks) > old:
            self._hold(blocks)
            self._wake(min(b[0] for b in blocks[old:]) - self.grace_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self.alarm.clear()
        blocks = [tuple(b) for b in self._blocks().tolist()]
        due = [b for b in blocks if b[0] - self.grace_ms <= now]
        rest = blocks[len(due) :]
        number = max((n for _, n in blocks), default=-1) + 1
        held = None
        # Blocks are read in the order of their first times. What precedes all blocks unread is released.
        for at in range(0, len(due), READ):
            read = due[at : at + READ]
            parts = [_unpacked(self.waiting.getValue((n,))[0]) for _, n in read]
            calls = pa.concat_tables(parts if held is None else [held, *parts])
            calls = calls.sort_by([("ts_ms", "ascending"), ("request_id", "ascending")])
            upto = now + self.grace_ms + 1
            if at + READ < len(due):
                upto = min(upto, due[at + READ][0])
            cut = int(np.searchsorted(calls["ts_ms"].to_numpy(), upto))
            for k in range(0, cut, RELEASED):
                yield self._release(key[0], calls.slice(k, min(RELEASED, cut - k)))
            held = calls.slice(cut)
        for _, n in due:
            self.waiting.removeKey((n,))
        if held is not None and held.num_rows:
            self._keep(held, rest, number)
        if rest:
            self._hold(rest)
            self._wake(min(rest)[0] - self.grace_ms)
            return
        self.index.clear()
        if self.idle_ms is not None and self.bucket.exists():
            over = self.bucket.get()[4] + self.idle_ms
            if over <= now:
                self.bucket.clear()
            else:
                self._wake(over)

    def _release(self, bucket: str, due: pa.Table) -> pd.DataFrame:
        times, ids, rpm = (due[c].to_numpy() for c in ("ts_ms", "request_id", "rpm"))
        held = self.bucket.get() if self.bucket.exists() else (int(times[0]), int(rpm[0]), None, 0, None, None)
        first_ms, capacity, window_start, used = held[:4]
        number = (times - first_ms) // self.window_ms
        start = first_ms + number * self.window_ms
        # Calls are in order, so a window's calls follow each other.
        begins = np.flatnonzero(np.diff(number, prepend=number[0] - 1))
        place = np.arange(1, len(times) + 1) - np.repeat(begins, np.diff(np.append(begins, len(times))))
        place = place + np.where(start == window_start, used, 0) if window_start is not None else place
        self.bucket.update((first_ms, capacity, int(start[-1]), int(place[-1]), int(times[-1]), int(ids[-1])))
        return _placed(bucket, times, ids, rpm, due["payload"].to_pandas(), start, place, capacity)

    def close(self) -> None:
        pass


def place_requests(
    matched: DataFrame,
    window_ms: int = WINDOW_MS,
    lateness_ms: int = 0,
    grace_ms: int = 0,
    payload: str | None = None,
    idle_ms: int | None = None,
    watermark: bool = True,
) -> DataFrame:
    """The stream counterpart of ``quota.rank_requests``: bucket, request_id, ts_ms, event_time, rpm,
    window_start_ms, place, capacity, late and payload of each call of ``matched(bucket, request_id,
    ts_ms, rpm, [payload])``; ``quota.decide`` turns them into decisions.

    Calls may come ``lateness_ms`` after newer ones, in any order. Those that come up to ``grace_ms``
    after that are given out as late unless they still fit behind what their bucket has released;
    later ones are dropped by the watermark (Spark counts them in the stream's progress). Places are
    given once both times have passed no longer than ``lateness_ms``. With ``idle_ms`` a bucket that has
    had no call for so long is let go, and its next call begins a window of its own.

    ``event_time`` carries the watermark on, so another stateful operator may follow. Without
    ``watermark`` the input has one on its ``event_time`` already.
    """
    use_state_store(matched.sparkSession)
    timed = event_time(matched, f"{lateness_ms + grace_ms} milliseconds") if watermark else matched
    # Calls without a bucket pass through in many tasks; they leave no state.
    free = F.concat(F.lit(UNCOUNTED), salted(["request_id"], SALTS).cast("string"))
    return (
        timed.select(
            F.coalesce("bucket", free).alias("bucket"),
            "request_id",
            "ts_ms",
            "event_time",
            "rpm",
            (F.col(payload) if payload else F.lit(None)).cast("string").alias("payload"),
        )
        .groupBy("bucket")
        .transformWithStateInPandas(
            LimitProcessor(window_ms, grace_ms, idle_ms), PLACED, "Append", "EventTime",
            eventTimeColumnName="event_time",
        )
    )


VERDICTS = "container_id string, drain_id bigint, drain_ms bigint, verdict string, remaining int"


FOREVER = (1 << 63) - 1
#: A drain, and a reading, as they are packed.
DRAIN = np.dtype([("drain_id", np.int64), ("drain_ms", np.int64)])
READING = np.dtype([("ts_ms", np.int64), ("event_id", np.int64), ("depth", np.int32)])


class DrainProcessor(StatefulProcessor):
    """A container's open drains, with one timer at the earliest deadline, and the readings they need.

    Both are packed values, so that no drain or reading costs a call to the state store of its own.
    """

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "drains binary")
        self.readings = handle.getValueState("readings", "readings binary")
        self.alarm = handle.getValueState("alarm", "at_ms bigint")

    def _held(self, state, kind: np.dtype) -> np.ndarray:
        return np.frombuffer(state.get()[0] if state.exists() else b"", kind)

    def _hold(self, drains: np.ndarray) -> None:
        """Keep the open drains, and one timer at the earliest of their deadlines."""
        at = max(int(drains["drain_ms"].min()) + self.timeout_ms, 1) if len(drains) else None
        held = self.alarm.get()[0] if self.alarm.exists() else None
        if held != at and held is not None:
            self.handle.deleteTimer(held)
        if not len(drains):
            self.open.clear()
            self.alarm.clear()
            return
        self.open.update((drains.tobytes(),))
        if held != at:
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        begun, read = [self._held(self.open, DRAIN)], []
        for pdf in rows:
            begins = pdf["drain"].to_numpy(dtype=bool)
            drains, fresh = np.zeros(int(begins.sum()), DRAIN), np.zeros(int((~begins).sum()), READING)
            drains["drain_id"], drains["drain_ms"] = pdf["event_id"][begins], pdf["ts_ms"][begins]
            for name in READING.names:
                fresh[name] = pdf[name][~begins]
            begun.append(drains)
            read.append(fresh)
        drains = np.concatenate(begun)
        if len(drains) > len(begun[0]):
            # Of a drain that is sent again the last row counts.
            _, last = np.unique(drains["drain_id"][::-1], return_index=True)
            drains = drains[len(drains) - 1 - last]
            self._hold(drains)
        if any(map(len, read)):
            self._keep(np.concatenate([self._held(self.readings, READING), *read]), drains, timerValues)
        return iter(())

    def _keep(self, readings: np.ndarray, drains: np.ndarray, timerValues) -> None:
        """Hold the readings from the first open drain on, or from the watermark on if that is earlier,
        and the last one before them: no drain to come begins before the watermark."""
        since = min(timerValues.getCurrentWatermarkInMs(), int(drains["drain_ms"].min(initial=FOREVER)))
        readings = readings[np.lexsort((readings["depth"], readings["event_id"], readings["ts_ms"]))]
        before = int(np.searchsorted(readings["ts_ms"], since, "right"))
        # Of equal times all are kept: the one with the largest id counts.
        self.readings.update((readings[max(before - 1, 0) :].tobytes(),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        drains = self._held(self.open, DRAIN)
        over = drains["drain_ms"] + self.timeout_ms <= now
        ended, drains = np.sort(drains[over]), drains[~over]
        # Spark removes the timer that has fired by itself.
        self.alarm.clear()
        self._hold(drains)
        readings = self._held(self.readings, READING)
        times, depth, at = readings["ts_ms"], readings["depth"], ended["drain_ms"]
        empty = times[depth <= 0]
        entry = np.searchsorted(times, at, "right")
        last = np.searchsorted(times, at + self.timeout_ms, "left")
        # With a reading before, and another place for none at all.
        depths = np.append(depth, np.int32(0))
        next_empty = np.append(empty, np.int64(FOREVER))[np.searchsorted(empty, at, "left")]
        emptied = (entry == 0) | (depths[entry - 1] <= 0) | (next_empty < at + self.timeout_ms)
        remaining = np.where(emptied, 0, depths[last - 1]).astype(np.int32)
        if len(readings):
            self._keep(readings, drains, timerValues)
        yield pd.DataFrame(
            {
                "container_id": key[0], "drain_id": ended["drain_id"], "drain_ms": at,
                "verdict": np.where(remaining > 0, "drain_timeout", "drained"), "remaining": remaining,
            }
        )

    def close(self) -> None:
        pass


def stream_drains(
    drains: DataFrame, depth: DataFrame, lateness_ms: int = 0, timeout_ms: int = DRAIN_TIMEOUT_MS
) -> DataFrame:
    """The stream counterpart of ``fleet.drain_verdicts``, for streams of drains (container_id,
    drain_id, drain_ms) and of readings (container_id, ts_ms, event_id, depth).

    A verdict comes out once the watermark has passed the drain's deadline. Readings may come
    ``lateness_ms`` late, those without a depth or later ones are dropped. Drain ids are unique in
    their container.
    """
    use_state_store(drains.sparkSession)
    starts = drains.select(
        "container_id", F.col("drain_ms").alias("ts_ms"), F.col("drain_id").alias("event_id"),
        F.lit(0).alias("depth"), F.lit(True).alias("drain"),
    )
    readings = depth.where("depth is not null").select(
        "container_id", "ts_ms", "event_id", F.col("depth").cast("int").alias("depth"), F.lit(False).alias("drain")
    )
    both = starts.unionByName(readings)
    return (
        event_time(both, f"{lateness_ms} milliseconds")
        .groupBy("container_id")
        .transformWithStateInPandas(DrainProcessor(timeout_ms), VERDICTS, "Append", "EventTime")
    )


CHANGES = "container_id string, host string, event string, since_ms bigint, order_ms bigint, order_id bigint"


class RosterProcessor(StatefulProcessor):
    """The last lifecycle event of a container; gives a row out when that changes. A container that has
    left is forgotten ``ttl_ms`` after its last event, by a timer."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event string, since_ms bigint, order_id bigint, wake_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        held = self.last.get() if self.last.exists() else None
        best = None if held is None else (held[1], held[2], held[0])
        for pdf in rows:
            top = pdf.sort_values(["ts_ms", "event_id"]).iloc[-1]
            found = (int(top["ts_ms"]), int(top["event_id"]), top["event"])
            best = found if best is None or found[:2] > best[:2] else best
        if held is not None and best[:2] == (held[1], held[2]):
            return
        since, number, event = best
        if held is not None and held[3]:
            self.handle.deleteTimer(held[3])
        wake = 0
        if self.ttl_ms is not None and event != "registered":
            wake = since + self.ttl_ms
            self.handle.registerTimer(wake)
        self.last.update((event, since, number, wake))
        yield pd.DataFrame(
            {
                "container_id": [key[0]], "host": [key[1]], "event": [event], "since_ms": [since],
                "order_ms": [since], "order_id": [number],
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def roster_changes(
    events: DataFrame, lifecycle: tuple[str, ...], lateness_ms: int = 0, ttl_ms: int | None = None
) -> DataFrame:
    """Changes of the roster, a row per container and trigger in which its last event changed.

    ``events`` (container_id, host, event, ts_ms, event_id) may come ``lateness_ms`` late; a ``ttl_ms``
    below that would let an old registration bring a container back.
    """
    use_state_store(events.sparkSession)
    if ttl_ms is not None and ttl_ms < lateness_ms:
        raise ValueError("ttl_ms must cover lateness_ms")
    seen = events.filter(F.col("event").isin(*lifecycle))
    return (
        event_time(seen, f"{lateness_ms} milliseconds")
        .select("container_id", "host", "event", "ts_ms", "event_id", "event_time")
        .groupBy("container_id", "host")
        .transformWithStateInPandas(RosterProcessor(ttl_ms), CHANGES, "Update", "EventTime")
    )
