"""Keyed state: anchored windows for traces and floods, and sets with a cap."""

from __future__ import annotations

import datetime
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from telespark.operators.anchored import starts

#: Rows have ``ord``, a number or a struct of numbers, and ``arrival_us``.
def _place(ord_) -> tuple[int, ...]:
    """A row's place in the total order, as numbers that compare."""
    if isinstance(ord_, dict):  # how structs come
        return tuple(ord_.values())
    return tuple(ord_) if isinstance(ord_, tuple) else (ord_,)


def _in_order(rows) -> list:
    return sorted(rows, key=lambda r: (r.arrival_us, _place(r.ord)))


def _times_and_services(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, list]:
    """arrival_us of rows in order, the number of each one's service, and the services; of a row a few numbers are held, as
    a key may have all rows of a micro-batch.  ``ord`` is of whole numbers."""
    times, places, numbers, services = [], [], [], {}
    for f in frames:
        codes, names = pd.factorize(f["service"], use_na_sentinel=False)
        known = np.array([services.setdefault(x if isinstance(x, str) else None, len(services)) for x in names])
        numbers.append(known[codes])
        times.append(f["arrival_us"].to_numpy(np.int64))
        places.append(np.array([_place(x) for x in f["ord"].tolist()], dtype=np.int64))
    times, numbers, places = np.concatenate(times), np.concatenate(numbers), np.concatenate(places)
    order = np.lexsort([*places.T[::-1], times])
    return times[order], numbers[order], list(services)


def _utc(us: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(us / 1e6, datetime.timezone.utc).replace(tzinfo=None)


def _moved(handle: StatefulProcessorHandle, before: int | None, after: int | None) -> None:
    """Puts a key's timer at ``after`` in place of ``before``."""
    if before != after:
        if before is not None:
            handle.deleteTimer(before)
        if after is not None:
            handle.registerTimer(after)


#: Keys of short life share a state: so many buckets there are.
BUCKETS = 512


def _buckets(rows: DataFrame, key: str):
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS))).groupBy("_bucket")


TRACE_COLUMNS = "trace_id string, window_start timestamp, spans long, bytes long, max_duration_ns long, error boolean, service string, first_ts timestamp"
FLOOD_COLUMNS = "hash string, window_start timestamp, service string, at timestamp"


class TraceFold(StatefulProcessor):
    """Folds each trace's spans until ``length_ms`` after the first of them and then gives one row.

    A key is a bucket of traces: its state is one small row for each open trace and a timer for the earliest of them, so what
    is read and written is a list for each bucket and not a few messages for each trace.  A span that comes later opens a new
    group.  With ``processing`` the time of a span is the wall clock when its micro-batch is handled, and no watermark is
    needed.
    """

    def __init__(self, length_ms: int = 10_000, processing: bool = False):
        self.length_ms, self.processing = length_ms, processing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "trace_id string, start_us long, spans long, bytes long, longest long, error boolean, service string, known string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() * 1000 if self.processing else None
        folds = self._held()
        before = self._next(folds)
        for r in _in_order(rows):
            at = r.arrival_us if now is None else now
            held = folds.get(r.trace_id)
            if held is not None and at - held[0] >= self.length_ms * 1000:
                yield self._closed(r.trace_id, held)
                held = None
            if held is None:
                held = folds[r.trace_id] = [at, 0, 0, 0, False, "unknown", ()]
            held[1] += 1
            held[2] += r.bytes_est
            held[3] = max(held[3], r.duration_ns)
            held[4] = held[4] or r.error
            place = _place(r.ord)
            if r.service != "unknown" and place >= held[6]:
                held[5], held[6] = r.service, place
        self._keep(folds, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.processing else timerValues.getCurrentWatermarkInMs()
        now = max(now, expiredTimerInfo.getExpiryTimeInMs())
        folds = self._held()
        for trace_id, held in list(folds.items()):
            if self._due(held[0]) <= now:
                yield self._closed(trace_id, folds.pop(trace_id))
        self._keep(folds, None)

    def _held(self) -> dict:
        return {r[0]: [*r[1:7], tuple(map(int, r[7].split(",")) if r[7] else ())] for r in self.open.get()}

    def _keep(self, folds: dict, before: int | None) -> None:
        """Leaves the open traces, and a timer for the earliest in place of the one at ``before``."""
        rows = [(trace_id, *held[:6], ",".join(map(str, held[6]))) for trace_id, held in folds.items()]
        self.open.put(rows) if rows else self.open.clear()
        _moved(self.handle, before, self._next(folds))

    def _next(self, folds: dict) -> int | None:
        return self._due(min(held[0] for held in folds.values())) if folds else None

    def _due(self, start_us: int) -> int:
        return start_us // 1000 + self.length_ms

    def _closed(self, trace_id, held) -> Row:
        start = _utc(held[0])
        return Row(trace_id=trace_id, window_start=start, spans=held[1], bytes=held[2], max_duration_ns=held[3], error=held[4], service=held[5], first_ts=start)

    def close(self) -> None:
        pass


class FloodCount(StatefulProcessor):
    """Gives a row when a template has its ``threshold``-th record in an anchored window of ``length_ms``.

    State is one pair of numbers for each open window; it goes when the watermark has passed the window's end, after which
    any record opens another.  A key's records come as frames of bounded size, of which only numbers are held.
    """

    def __init__(self, length_ms: int = 60_000, threshold: int = 1000):
        self.length_ms, self.threshold = length_ms, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "start_us long, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.count.get()
        times, numbers, services = _times_and_services(rows)
        windows = starts(times, self.length_ms * 1000, None if before is None else before[0])
        edges = np.concatenate([[0], np.flatnonzero(np.diff(windows)) + 1, [len(windows)]])
        past = np.zeros(len(edges) - 1, dtype=np.int64)
        if before is not None and windows[0] == before[0]:
            past[0] = before[1]
        filled = edges[:-1] + self.threshold - past - 1
        filled = filled[(past < self.threshold) & (filled < edges[1:])]
        start, at = (pd.to_datetime(x[filled], unit="us", utc=True) for x in (windows, times))
        service = np.array([*services, None], dtype=object)[numbers[filled]]
        yield pd.DataFrame({"hash": np.full(len(filled), key[0], dtype=object), "window_start": start, "service": service, "at": at}).astype({"hash": object, "service": object})
        held = int(windows[-1]), int(edges[-1] - edges[-2] + past[-1])
        self.count.update(held)
        _moved(self.handle, None if before is None else self._due(before[0]), self._due(held[0]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.count.exists() and self._due(self.count.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.count.clear()
        return iter(())

    def _due(self, start_us: int) -> int:
        return -(-start_us // 1000) + self.length_ms

    def close(self) -> None:
        pass


class CappedSet(StatefulProcessor):
    """Counts a key's distinct values up to ``cap``; gives the key's count whenever it grows."""

    def __init__(self, cap: int = 10_000):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "value string", "one boolean")
        self.size = handle.getValueState("size", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = before = self.size.get()[0] if self.size.exists() else 0
        for r in rows:
            if n < self.cap and r.attr_value is not None and not self.seen.containsKey((r.attr_value,)):
                self.seen.updateValue((r.attr_value,), (True,))
                n += 1
        if n != before:
            self.size.update((n,))
            yield Row(metric_name=key[0], attr_key=key[1], distinct_values=n)

    def close(self) -> None:
        pass


class NonceTaken(StatefulProcessor):
    """Tells whether a nonce is taken: by the first request, for ``ttl_s`` from then on, whatever comes in between.

    A key is a bucket of nonces, whose state is a row for each that is taken and a timer for the earliest.
    """

    def __init__(self, ttl_s: int = 600):
        self.ttl_us = ttl_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getListState("taken", "nonce string, at_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        taken = dict(self.taken.get())
        before = self._next(taken)
        for r in _in_order(rows):
            at = taken.get(r.nonce)
            fresh = at is None or r.arrival_us - at >= self.ttl_us
            if fresh:
                taken[r.nonce] = r.arrival_us
            yield Row(ord=r.ord, arrival_us=r.arrival_us, key_id=r.key_id, early=None, replay=not fresh)
        self._keep(taken, before)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        self._keep({nonce: at for nonce, at in self.taken.get() if self._due(at) > now}, None)
        return iter(())

    def _keep(self, taken: dict, before: int | None) -> None:
        self.taken.put(list(taken.items())) if taken else self.taken.clear()
        _moved(self.handle, before, self._next(taken))

    def _next(self, taken: dict) -> int | None:
        return self._due(min(taken.values())) if taken else None

    def _due(self, at_us: int) -> int:
        return -(-(at_us + self.ttl_us) // 1000)

    def close(self) -> None:
        pass


class Running(StatefulProcessor):
    """A row for each batch: the records so far, and a sample time later than the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "total long, sample_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, ms = self.held.get() if self.held.exists() else (0, None)
        for r in sorted(rows, key=lambda x: _place(x.ord)):
            total, ms = total + r.n_records, r.now_ms if ms is None else max(r.now_ms, ms + 1)
            yield Row(signal=key[0], subtask=key[1], ord=r.ord, total=total, sample_ms=ms)
        self.held.update((total, ms))

    def close(self) -> None:
        pass


class Throughput(StatefulProcessor):
    """The rise per second of a scraped counter over ``window_us``, for each scrape.

    State is a ring: the points of the last ``window_us`` and the latest one before them.  A failed scrape empties it.
    """

    def __init__(self, window_us: int = 5_000_000):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "t_us long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ring = deque(tuple(p) for p in self.ring.get())
        for r in sorted(rows, key=lambda x: x.t_us):
            if r.failed:
                ring.clear()
                yield Row(type=key[0], t_us=r.t_us, per_second=None)
                continue
            ring.append((r.t_us, r.value))
            while len(ring) > 1 and ring[1][0] < r.t_us - self.window_us:
                ring.popleft()
            t, v = ring[0]
            yield Row(type=key[0], t_us=r.t_us, per_second=max(r.value - v, 0.0) / ((r.t_us - t) / 1e6) if r.t_us > t else 0.0)
        self.ring.put(list(ring)) if ring else self.ring.clear()

    def close(self) -> None:
        pass


class LastRows(StatefulProcessor):
    """The last ``n`` rows of a key, in a ring; gives the whole ring after each micro-batch, back being 1 for the last."""

    def __init__(self, n: int = 200):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "ord long, line string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ring = deque((tuple(p) for p in self.ring.get()), maxlen=self.n)
        ring.extend(sorted((r.ord, r.line) for r in rows))
        self.ring.put(list(ring))
        for k, (ord_, line) in enumerate(reversed(ring)):
            yield Row(source=key[0], ord=ord_, line=line, back=k + 1)

    def close(self) -> None:
        pass


class AlertRun(StatefulProcessor):
    """A rule's state for one series: pending while its condition holds, firing from the ``least``-th step on, resolved when
    it doesn't hold or a step is missing.

    Gives a row whenever the state changes or a firing run grows.  State is one row for each series.
    """

    def __init__(self, least: int, step: int = 1):
        self.least, self.step = least, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", "start long, until long, points long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        run = tuple(self.run.get()) if self.run.exists() else None
        for r in sorted(rows, key=lambda x: x.step_no):
            if run is not None and not (r.holds and r.step_no == run[1] + self.step):
                if run[2] >= self.least:
                    yield self._row(key, run, "resolved")
                run = None
            if r.holds:
                run = (r.step_no, r.step_no, 1) if run is None else (run[0], r.step_no, run[2] + 1)
                if run[2] >= self.least or run[2] == 1:
                    yield self._row(key, run, "firing" if run[2] >= self.least else "pending")
        self.run.update(run) if run is not None else self.run.clear()

    @staticmethod
    def _row(key, run, state: str) -> Row:
        return Row(type=key[0], start=run[0], until=run[1], points=run[2], state=state)

    def close(self) -> None:
        pass


def traces(facts: DataFrame, length_ms: int = 10_000, *, processing: bool = False) -> DataFrame:
    """Trace facts of a stream of (trace_id, service, duration_ns, error, bytes_est, ord, arrival_ts): with a watermark on
    arrival_ts, or by the clock (``processing``)."""
    timed = facts.select("trace_id", "service", "duration_ns", "error", "bytes_est", "ord", "arrival_ts", F.unix_micros("arrival_ts").alias("arrival_us"))
    return _buckets(timed, "trace_id").transformWithState(TraceFold(length_ms, processing), TRACE_COLUMNS, "append", "processingTime" if processing else "eventTime")


def floods(logs: DataFrame, length_ms: int = 60_000, threshold: int = 1000) -> DataFrame:
    """Flood events of a stream of (hash, service, arrival_us, ord, arrival_ts) with a watermark on arrival_ts."""
    return logs.groupBy("hash").transformWithStateInPandas(FloodCount(length_ms, threshold), FLOOD_COLUMNS, "append", "eventTime")


def distinct_values(attrs: DataFrame, cap: int = 10_000) -> DataFrame:
    """Growing distinct counts of a stream of (metric_name, attr_key, attr_value)."""
    return attrs.groupBy("metric_name", "attr_key").transformWithState(CappedSet(cap), "metric_name string, attr_key string, distinct_values long", "update", "none")


def taken(requests: DataFrame, ttl_s: int = 600) -> DataFrame:
    """ord, arrival_us, key_id, early (null) and replay of a stream of (nonce, ts, key_id, ord) with a watermark on ts."""
    kind = dict(requests.dtypes)["ord"]
    timed = requests.select("nonce", "key_id", "ord", "ts", F.unix_micros("ts").alias("arrival_us"))
    return _buckets(timed, "nonce").transformWithState(NonceTaken(ttl_s), f"ord {kind}, arrival_us long, key_id string, early string, replay boolean", "append", "eventTime")


def running(batches: DataFrame) -> DataFrame:
    """signal, subtask, ord, total and sample_ms of each row of a stream of (signal, subtask, ord, n_records, now_ms)."""
    kind = dict(batches.dtypes)
    return batches.groupBy("signal", "subtask").transformWithState(Running(), f"signal {kind['signal']}, subtask {kind['subtask']}, ord {kind['ord']}, total long, sample_ms long", "append", "none")


def throughput(scrapes: DataFrame, window_us: int = 5_000_000) -> DataFrame:
    """type, t_us and per_second of each row of a stream of (type, t_us, value, failed)."""
    return scrapes.groupBy("type").transformWithState(Throughput(window_us), "type string, t_us long, per_second double", "append", "none")


def last_rows(lines: DataFrame, n: int = 200) -> DataFrame:
    """The last rows of each source of a stream of (source, ord, line), whole after each micro-batch that brings some."""
    return lines.groupBy("source").transformWithState(LastRows(n), "source string, ord long, line string, back int", "update", "none")


def alerts(points: DataFrame, least: int, step: int = 1) -> DataFrame:
    """Changes of an alert's state, from a stream of (type, step_no, holds)."""
    return points.groupBy("type").transformWithState(AlertRun(least, step), "type string, start long, until long, points long, state string", "append", "none")
