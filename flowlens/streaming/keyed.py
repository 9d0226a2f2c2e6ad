"""Stream operators on keyed state: sequence buffers, run status, rule windows and counters.

Each is a state machine per key with list, map or value state in a RocksDB store, trimmed by
event-time timers. A timer here does more than free state: the run status emits its release
and its idle reset when the watermark passes them.

Rows of a key are taken in ``(ts_us, row_id)`` order within a micro-batch, and micro-batches
in order of arrival. A task holds the rows of one key in one micro-batch, of narrow columns
only; the file limit of the source bounds them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator, Sequence
from decimal import Decimal
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from flowlens.functions import scalars as S
from flowlens.operators import rules
from flowlens.operators.alerts import RELEASED
from flowlens.operators.polls import FLOW_KEY
from flowlens.policy import Policy
from flowlens.sources.exports import stream_once
from flowlens.streaming.streams import BUCKETS

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))


def _ms_after(us: int) -> int:
    """First whole millisecond after a time in microseconds."""
    return us // 1000 + 1


def use_rocksdb(spark: SparkSession) -> None:
    """Map and list state and timers need this store; queries started later in the session use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


#: Rows of a frame that a processor hands over.
FRAME_ROWS = 50_000


def _columns_in_order(rows: Iterator[pd.DataFrame], *names: str) -> Iterator[tuple]:
    """``(ts_us, row_id, *names)`` of a key's rows in order; equal texts are held once, other columns not at all."""
    known: dict[str, str] = {}
    kept: list[list] = [[] for _ in range(2 + len(names))]
    for f in rows:
        for values, c in zip(kept, ("ts_us", "row_id", *names)):
            column = f[c]
            if column.dtype.kind in "iufb":
                values.append(column.to_numpy())
            else:
                others = np.empty(len(column), dtype=object)
                others[:] = [known.setdefault(x, x) if isinstance(x, str) else None if isinstance(x, float) else x for x in column]
                values.append(others)
    kept = [np.concatenate(v) for v in kept]
    order = np.lexsort((kept[1], kept[0]))
    for i in range(0, len(order), FRAME_ROWS):
        part = order[i : i + FRAME_ROWS]
        yield from zip(*(v[part].tolist() for v in kept))


def _watermarked(df: DataFrame, late: str) -> DataFrame:
    use_rocksdb(df.sparkSession)
    return df.withColumn("_at", F.timestamp_micros("ts_us")).withWatermark("_at", late)


def _set_timer(handle: StatefulProcessorHandle, at_ms: int | None) -> None:
    """The only timer of the key."""
    for (old,) in [(t,) if not isinstance(t, tuple) else t for t in handle.listTimers()]:
        handle.deleteTimer(old)
    if at_ms is not None:
        handle.registerTimer(at_ms)


# --- sequence buffer -----------------------------------------------------------------


class SequenceBuffer(StatefulProcessor):
    """The last ``n - 1`` vectors of each live flow of a bucket; a timer frees them after the idle time."""

    def __init__(self, n: int, idle_us: int):
        self.n, self.idle = n, idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "flow string, ts_us bigint, gone boolean, vector array<double>")

    def _buffers(self) -> dict[str, list[tuple]]:
        buffers: dict[str, list[tuple]] = {}
        for flow, *entry in self.recent.get():
            buffers.setdefault(flow, []).append(tuple(entry))
        return buffers

    def _keep(self, buffers: dict[str, list[tuple]], now_ms: int) -> None:
        """Hold what can still count behind the watermark; the timer is that of the next flow to be freed."""
        live = {k: b[-(self.n - 1) :] for k, b in buffers.items() if self.n > 1 and _ms_after(b[-1][0] + self.idle) > now_ms}
        if live:
            self.recent.put([(k, ts, gone, [float(x) for x in vector]) for k, b in live.items() for ts, gone, vector in b])
            _set_timer(self.handle, min(_ms_after(b[-1][0] + self.idle) for b in live.values()))
        else:
            self.recent.clear()
            _set_timer(self.handle, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buffers = self._buffers()
        out = []
        names = ["flow", "row_id", "ts_us", "buffered", "phase", "window"]
        for ts, row_id, flow, gone, vector in _columns_in_order(rows, "flow", "gone", "vector"):
            buffer = buffers.get(flow, [])
            if buffer and (buffer[-1][1] or ts - buffer[-1][0] > self.idle):
                buffer = []
            buffer = buffers[flow] = [*buffer, (int(ts), bool(gone), vector)][-self.n :]
            full = len(buffer) == self.n
            phase = "scored" if full else f"warmup_{len(buffer)}/{self.n}"
            out.append((flow, row_id, ts, len(buffer), phase, [b[2] for b in buffer] if full else None))
            if len(out) == FRAME_ROWS:
                yield pd.DataFrame(out, columns=names)
                out = []
        self._keep(buffers, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._keep(self._buffers(), timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def rolling_sequences_stream(
    df: DataFrame, n: int = 4, vector: str = "feature_vector", keys: Sequence[str] = FLOW_KEY, idle_timeout_s: float = 120.0,
    removed: str | None = None, late: str = "1 hour", buckets: int = BUCKETS,
) -> DataFrame:
    """``rolling_sequences`` of a stream: one row per row, ``window`` once the buffer is full.

    A silence above the time-out or a removal empties the buffer. Flows are dealt out to
    ``buckets``, each with the buffers of its flows: one list state and one timer.
    """
    gone = F.coalesce(F.col(removed), F.lit(False)) if removed else F.lit(False)
    flow = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    rows = _watermarked(df, late).select(flow.alias("flow"), "row_id", "ts_us", "_at", gone.alias("gone"), F.col(vector).alias("vector"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("flow"), F.lit(buckets)).cast("int"))
    schema = "flow string, row_id bigint, ts_us bigint, buffered int, phase string, window array<array<double>>"
    found = rows.groupBy("_bucket").transformWithStateInPandas(SequenceBuffer(n, _us(idle_timeout_s)), schema, "Append", "EventTime")
    types = T.StructType([df.schema[k] for k in keys])
    return found.select(F.from_json("flow", types).alias("_k"), "*").select("_k.*", "row_id", "ts_us", "buffered", "phase", "window")


# --- run status ------------------------------------------------------------------------

_RANK = {"ATTACK": 2, "SUSPECT": 1}
_NAMES = ("NORMAL", "SUSPECT", "ATTACK")


class _Down(str):
    """A text that sorts backwards."""

    def __lt__(self, other: str) -> bool:
        return str.__gt__(self, other)


class _Evidence:
    """Evidence inside the hold window; its worst entry, peak score and signals without looking through it.

    Entries expire by time, also where a late row came in between. The heaps drop an expired
    entry when it gets to their top, or when most of their entries have expired.
    """

    def __init__(self, entries: Iterable[tuple]):
        self.entries: dict[int, tuple] = {}
        self.seen = self.signals = 0
        self.by_time: list[tuple] = []
        self.by_worst: list[tuple] = []
        self.by_score: list[tuple] = []
        for e in entries:
            self.add(e)

    def add(self, e: tuple) -> None:
        ts, rank, score, category = e
        n, self.seen = self.seen, self.seen + 1
        self.entries[n] = e
        self.signals += rank > 0
        heappush(self.by_time, (ts, n))
        heappush(self.by_worst, (-rank, score is None, -(score or 0.0), category is None, _Down(category or ""), n))
        if score is not None:
            heappush(self.by_score, (-score, n))

    def expire(self, before: int) -> None:
        while self.by_time and self.by_time[0][0] < before:
            self.signals -= self.entries.pop(heappop(self.by_time)[1])[1] > 0

    def _top(self, heap: list[tuple]) -> tuple | None:
        if len(heap) > 2 * len(self.entries) + 64:
            heap[:] = [x for x in heap if x[-1] in self.entries]
            heapify(heap)
        while heap and heap[0][-1] not in self.entries:
            heappop(heap)
        return self.entries[heap[0][-1]] if heap else None

    def worst(self) -> tuple:
        return self._top(self.by_worst)

    def peak(self) -> float | None:
        top = self._top(self.by_score)
        return None if top is None else top[2]


class RunStatus(StatefulProcessor):
    """Display status of a run. State: the evidence inside the hold window, and the last row with what it still owes.

    A row owes a release (if its status is raised) and an idle reset. The next row settles
    what is due before it; else the timer of the run does when the watermark gets there.
    """

    def __init__(self, policy: Policy, keys: Sequence[str]):
        self.keys = list(keys)
        self.hold, self.idle = _us(policy.alert_hold_seconds), _us(policy.runtime_idle_reset_s)
        self.threshold, self.lower = policy.threshold, policy.lower_is_attack

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.evidence = handle.getListState("evidence", "ts_us bigint, rank int, score double, category string")
        self.last = handle.getValueState("last", "ts_us bigint, row_id bigint, score double, release boolean, idle boolean")

    def _due(self, key, last: tuple, now: int) -> tuple[list[tuple], tuple]:
        """Rows that are due before ``now``, and what is owed afterwards."""
        ts, row_id, score, release, idle = last
        out = []
        if release and now > ts + self.hold:
            out.append((*key, row_id, ts + self.hold + 1, "NORMAL", RELEASED, "active", 0, score))
            release = False
        if idle and now > ts + self.idle:
            out.append((*key, row_id, ts + self.idle + 1, "NORMAL", "", "idle", 0, 0.0))
            release = idle = False
        return out, (ts, row_id, score, release, idle)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*self.keys, "row_id", "at_us", "run_status", "run_reason", "run_phase", "active_signals", "display_score"])

    def _next_timer(self, last: tuple) -> int | None:
        times = [last[0] + self.hold] * last[3] + [last[0] + self.idle] * last[4]
        return _ms_after(min(times) + 1) if times else None

    def _live(self, key, row: tuple, evidence: _Evidence) -> tuple:
        ts, row_id, status, reason = row
        peak, worst = evidence.peak(), evidence.worst()
        own = _RANK.get(status, 0)
        hit = peak is not None and peak != 0 and (peak <= self.threshold if self.lower else peak >= self.threshold)
        status = _NAMES[own]
        if worst[1] > own:
            status = _NAMES[worst[1]]
            if worst[3]:
                reason = f"holding recent {worst[3]} evidence"
            elif hit:
                reason = "holding recent model evidence above threshold"
        elif own == 0 and hit:
            status, reason = "SUSPECT", "recent model score above threshold; confirming"
        return (*key, row_id, ts, status, reason, "active", evidence.signals, peak)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        evidence = _Evidence(tuple(e) for e in self.evidence.get())
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for ts, row_id, status, reason, score, category in _columns_in_order(rows, "status", "reason", "score", "category"):
            if last is not None:
                due, last = self._due(key, last, ts)
                out += due
            score = None if score is None or score != score else float(score)
            evidence.expire(ts - self.hold)
            evidence.add((int(ts), _RANK.get(status, 0), score, category))
            live = self._live(key, (ts, row_id, status, reason), evidence)
            out.append(live)
            raised = live[len(self.keys) + 2] != "NORMAL" and self.hold < self.idle
            last = (int(ts), int(row_id), score or 0.0, raised, True)
            if len(out) >= FRAME_ROWS:
                yield self._frame(out)
                out = []
        self.evidence.put(list(evidence.entries.values()))
        self.last.update(last)
        at = self._next_timer(last)
        _set_timer(self.handle, max(at, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        if last is None:
            return
        # the watermark may be far past the timer
        out, last = self._due(key, last, max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000)
        if last[4]:
            self.last.update(last)
            self.handle.registerTimer(max(self._next_timer(last), timerValues.getCurrentWatermarkInMs() + 1))
        elif self.hold <= self.idle:  # nothing owed, and no later row sees the evidence
            self.last.clear()
            self.evidence.clear()
        else:  # evidence may outlive the idle reset
            self.last.update(last)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def run_status_stream(decisions: DataFrame, policy: Policy, keys: Sequence[str] = ("run_id",), late: str = "1 hour") -> DataFrame:
    """``run_status`` of a stream: a row per decision, and release and idle rows when they are due."""
    category = F.col("category") if "category" in decisions.columns else F.lit("")
    rows = _watermarked(decisions, late).select(
        *keys, "row_id", "ts_us", "_at", S.norm_status("status").alias("status"), "reason", F.col("score").cast("double").alias("score"), category.alias("category")
    )
    types = ", ".join(f"{k} {decisions.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, row_id bigint, at_us bigint, run_status string, run_reason string, run_phase string, active_signals bigint, display_score double"
    return rows.groupBy(*keys).transformWithStateInPandas(RunStatus(policy, keys), schema, "Append", "EventTime")


# --- rules: bounded windows --------------------------------------------------------------

#: A window is kept in this many cells of time; only cells on its borders are looked into.
CELLS = 16


class _Sums:
    """A cell of a sliding sum: entries in order of (ts, row_id) with running totals."""

    def __init__(self, state: tuple | None = None):
        at, rid, p, b = state or ((), (), (), ())
        self.at = list(zip(map(int, at), map(int, rid)))
        self.p, self.b = [int(x) for x in p], [int(x) for x in b]
        self._total()

    def _total(self) -> None:
        self.run_p, self.run_b = [0], [0]
        for p, b in zip(self.p, self.b):
            self.run_p.append(self.run_p[-1] + p)
            self.run_b.append(self.run_b[-1] + b)

    def add(self, at: tuple[int, int], p: int, b: int) -> None:
        i = bisect_left(self.at, at)
        self.at.insert(i, at)
        self.p.insert(i, p)
        self.b.insert(i, b)
        if i == len(self.at) - 1:
            self.run_p.append(self.run_p[-1] + p)
            self.run_b.append(self.run_b[-1] + b)
        else:  # a late row
            self._total()

    def totals(self) -> tuple[int, int, int]:
        return len(self.at), self.run_p[-1], self.run_b[-1]

    def between(self, lo: tuple[int, int], hi: tuple[int, int]) -> tuple[int, int, int]:
        i, j = bisect_left(self.at, lo), bisect_left(self.at, hi)
        return j - i, self.run_p[j] - self.run_p[i], self.run_b[j] - self.run_b[i]

    def state(self) -> tuple:
        return [a for a, _ in self.at], [r for _, r in self.at], [str(x) for x in self.p], [str(x) for x in self.b]


class _Ports:
    """A cell of a sliding distinct count: every port with its times, ends of a run of times only where nothing lies late."""

    def __init__(self, state: tuple | None = None):
        self.times: dict[int, list[int]] = {}
        for port, at in zip(*(state or ((), ()))):
            insort(self.times.setdefault(int(port), []), int(at))

    def add(self, port: int, at: int) -> None:
        times = self.times.setdefault(port, [])
        if len(times) > 1 and at >= times[-1]:
            times[-1] = at  # between the first and the last one nothing is ever asked for alone
        else:
            insort(times, at)

    def between(self, lo: int, hi: int) -> set[int]:
        return {p for p, t in self.times.items() if bisect_right(t, hi) > bisect_left(t, lo)}

    def state(self) -> tuple:
        flat = [(p, a) for p, t in self.times.items() for a in t]
        return [p for p, _ in flat], [a for _, a in flat]


class ScopeWindows(StatefulProcessor):
    """Sliding windows of a scope as map state from cell to entries; a timer drops cells behind every window."""

    def __init__(self, window_us: dict[str, int]):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getMapState("sums", "cell bigint", "ts array<bigint>, rid array<bigint>, p array<string>, b array<string>")
        self.ports = handle.getMapState("ports", "cell bigint", "port array<bigint>, ts array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kind = key[0]
        window = self.window_us[kind]
        wide = max(1, window // CELLS)
        store, make = (self.ports, _Ports) if kind == "scan" else (self.sums, _Sums)
        cells: dict[int, _Sums | _Ports | None] = {}
        changed: set[int] = set()

        def cell(c: int, create: bool = False) -> _Sums | _Ports | None:
            if c not in cells:
                known = store.containsKey((c,))
                cells[c] = make(tuple(store.getValue((c,)))) if known else None
            if cells[c] is None and create:
                cells[c] = make()
            return cells[c]

        inside: tuple = (None, None)

        def inner(first: int, own: int) -> tuple | set:
            """What the cells between those on the border hold: rows come in order, so it stands until a border moves."""
            nonlocal inside
            if inside[0] != (first, own):
                found = [x for c in range(first + 1, own) if (x := cell(c)) is not None]
                if kind == "scan":
                    inside = (first, own), set().union(*(x.times for x in found))
                else:
                    parts = [x.totals() for x in found]
                    inside = (first, own), tuple(sum(x[i] for x in parts) for i in range(3))
            return inside[1]

        def frame(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(out, columns=["row_id", "ports", "tries", "n", "p", "b"]).astype({"ports": "Int64", "tries": "Int64", "n": "Int64"})

        out = []
        for ts, rid, port, seen, p, b in _columns_in_order(rows, "port", "seen", "p", "b"):
            if len(out) >= FRAME_ROWS:
                yield frame(out)
                out = []
            ts, rid = int(ts), int(rid)
            first, own = (ts - window) // wide, ts // wide
            if kind != "service":  # the row itself counts
                cell(own, True).add(*((int(port), ts) if kind == "scan" else ((ts, rid), 0, 0)))
                changed.add(own)
            border = [x for c in ((first, own) if first < own else (own,)) if (x := cell(c)) is not None]
            if kind == "scan":
                found = inner(first, own).union(*(x.between(ts - window, ts) for x in border))
                out.append((rid, len(found), None, None, None, None))
                continue
            upto = (ts, rid) if kind == "service" else (ts, rid + 1)
            parts = [inner(first, own), *(x.between((ts - window, -(1 << 62)), upto) for x in border)]
            n, sum_p, sum_b = (sum(x[i] for x in parts) for i in range(3))
            if kind == "bfa":
                out.append((rid, None, n, None, None, None))
                continue
            out.append((rid, None, None, n, str(Decimal(sum_p).scaleb(-9)), str(Decimal(sum_b).scaleb(-9))))
            if seen:
                cell(own, True).add((ts, rid), int(p), int(b))
                changed.add(own)
        for c in changed:
            store.updateValue((c,), cells[c].state())
            self.handle.registerTimer(max(_ms_after((c + 1) * wide + window), timerValues.getCurrentWatermarkInMs() + 1))
        yield frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        window = self.window_us[key[0]]
        wide = max(1, window // CELLS)
        # all that is behind the watermark at once: later timers then list few cells
        done = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        store = self.ports if key[0] == "scan" else self.sums
        for (c,) in list(store.keys()):
            if (c + 1) * wide + window < done:
                store.removeKey((c,))
        yield from ()

    def close(self) -> None:
        pass


def _key(names: Sequence[str]) -> Column:
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def _beside_rows(df: DataFrame, found: DataFrame) -> DataFrame:
    """What a stateful operator found in a micro-batch, and the rows themselves, as one stream."""
    return found.unionByName(df.select("row_id", F.struct(*df.columns).alias("row")), allowMissingColumns=True)


def _met(batch: DataFrame) -> DataFrame:
    """Rows of a micro-batch with what was found for them: one shuffle by row id."""
    names = [c for c in batch.columns if c not in ("row_id", "row")]
    one = batch.groupBy("row_id").agg(F.first("row", ignorenulls=True).alias("row"), *[F.max(c).alias(c) for c in names])
    return one.select("row.*", *names)


def rule_windows_stream(obs: DataFrame, policy: Policy, out: str, checkpoint: str, late: str = "1 hour", **trigger) -> StreamingQuery:
    """Observations with their scan and brute-force supports and service baseline, as a table.

    One processor per scope; a scope's state is its rows inside the window. Rows without a
    time are in no window.
    """
    scan_ok, try_ok = rules.countable_scan(policy), rules.countable_attempt(policy)
    seen = F.coalesce(F.col("has_history"), F.lit(False))
    units = lambda c: (F.when(seen, F.col(c)).otherwise(F.lit(0.0)).cast("decimal(28,9)") * 1_000_000_000).cast("decimal(38,0)").cast("string")
    no_text, no_port = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    scope = lambda kind, key, port, seen, p, b: F.struct(
        F.lit(kind).alias("kind"), key.alias("key"), port.alias("port"), seen.alias("seen"), p.alias("p"), b.alias("b")
    )
    scopes = F.array(
        F.when(scan_ok, scope("scan", _key(rules.SCAN), F.col("dst_port").cast("bigint"), F.lit(True), no_text, no_text)),
        F.when(try_ok, scope("bfa", _key(rules.BFA), no_port, F.lit(True), no_text, no_text)),
        scope("service", _key(rules.SERVICE), no_port, seen, units("packet_rate"), units("byte_rate")),
    )
    rows = _watermarked(obs.filter("ts_us IS NOT NULL"), late)
    rows = rows.select("row_id", "ts_us", "_at", F.explode(F.filter(scopes, lambda s: s.isNotNull())).alias("s")).select("row_id", "ts_us", "_at", "s.*")
    windows = {"scan": _us(policy.scan_window_s), "bfa": _us(policy.bfa_window_s), "service": _us(policy.baseline_window_s)}
    schema = "row_id bigint, ports bigint, tries bigint, n bigint, p string, b string"
    found = rows.groupBy("kind", "key").transformWithStateInPandas(ScopeWindows(windows), schema, "Append", "EventTime")

    def finish(batch: DataFrame) -> DataFrame:
        return rules.from_windows(_met(batch), policy)

    return stream_once(_beside_rows(obs, found), out, checkpoint, finish, **trigger)


# --- rules: counters ----------------------------------------------------------------------


class ScopeCounters(StatefulProcessor):
    """Counters of a scope since their last reset; those of a flow are freed once its silence resets them."""

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "a bigint, b bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        a, b = self.count.get() if self.count.exists() else (0, 0)
        out, last = [], 0
        flow = key[0] == "flow"
        for ts, row_id, add_a, reset_a, add_b, reset_b in _columns_in_order(rows, "add_a", "reset_a", "add_b", "reset_b"):
            a = (0 if reset_a else a) + int(add_a)
            b = (0 if reset_b else b) + int(add_b)
            out.append((row_id, None, None, a) if flow else (row_id, a, b, None))
            last = int(ts)
        self.count.update((int(a), int(b)))
        if flow:
            _set_timer(self.handle, max(_ms_after(last + self.idle), timerValues.getCurrentWatermarkInMs() + 1))
        names = ["violation_hits", "volumetric_hits", "hit_streak"]
        yield pd.DataFrame(out, columns=["row_id", *names]).astype({n: "Int64" for n in names})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        yield from ()

    def close(self) -> None:
        pass


def rule_decisions_stream(windows: DataFrame, policy: Policy, out: str, checkpoint: str, late: str = "1 hour", **trigger) -> StreamingQuery:
    """Decisions of a stream of the rows of ``rule_windows_stream``, as a table.

    Read that table without a file limit: a micro-batch of it appears as a whole and has to
    be taken as a whole, since its files overlap in time.

    Violation and volumetric counters belong to an entity scope and silence doesn't reset
    them, so their two numbers stay; the streak of a flow is freed after its idle time.
    """
    flags = rules.counter_flags(policy)
    whole = lambda c: F.coalesce(c.cast("bigint"), F.lit(0))
    sure = lambda c: F.coalesce(c, F.lit(False))
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    scope = lambda kind, key, a, ra, b, rb: F.struct(
        F.lit(kind).alias("kind"), _key(key).alias("key"), a.alias("add_a"), ra.alias("reset_a"), b.alias("add_b"), rb.alias("reset_b")
    )
    bad, volume, streak = (flags[n] for n in ("violation_hits", "volumetric_hits", "hit_streak"))
    scopes = F.array(
        scope("entity", rules.ENTITY, whole(bad[0]), sure(bad[1]), whole(volume[0]), sure(volume[1])),
        scope("flow", rules.FLOW, whole(streak[0]), sure(streak[1]), zero, no),
    )
    rows = _watermarked(windows.filter("ts_us IS NOT NULL"), late)
    rows = rows.select("row_id", "ts_us", "_at", F.explode(scopes).alias("s")).select("row_id", "ts_us", "_at", "s.*")
    schema = "row_id bigint, violation_hits bigint, volumetric_hits bigint, hit_streak bigint"
    counters = ScopeCounters(_us(policy.entity_idle_timeout_s))
    found = rows.groupBy("kind", "key").transformWithStateInPandas(counters, schema, "Append", "EventTime")

    def finish(batch: DataFrame) -> DataFrame:
        decided = rules.from_counters(_met(batch).fillna(0, ["violation_hits", "volumetric_hits", "hit_streak"]), policy)
        return decided.drop("supports", *rules.SUPPORTS)

    return stream_once(_beside_rows(windows, found), out, checkpoint, finish, **trigger)
