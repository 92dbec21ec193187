"""The status machine of export items, on streams with timers and as a batch by the same rules.

An item is pending, in progress, success, failed or deferred. Events start it, finish it, fail it, defer it, interrupt it or
reset it; those that its status doesn't know change nothing. A deferral waits longer each time and fails the item after the
last delay, an interruption can be taken up at once and fails it the third time; success and reset clear both counters.
A deferred item becomes pending when its time has come, before an event of that time.

Events count in the order of (time, id), however they arrive, each id and time once. On a stream they wait until the watermark
has passed them; what comes later than that is left out. Rows without item, time or kind change nothing. An item's state is one row and its waiting
events are those of the watermark's delay, as they came; the batch form passes each item's rows through a task one by one and keeps one state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.jobs import DEFERRAL_SECONDS, MAX_INTERRUPTIONS

#: status, deferrals, interruptions, time of the next try in microseconds, number of changes
FRESH = ("pending", 0, 0, None, 0)
#: Waiting events in a row of the state store; each row is a message of its own to and from the store. Fixed value.
TOGETHER = 64
CHANGE = "item {kind}, n long, at timestamp, event string, status string, defer_count int, hard_interrupts int, next_retry timestamp"


def _after(state: tuple, kind: str, at: int, unit: int) -> tuple:
    """Status, counters and next try after an event."""
    status, defers, interrupts = state[:3]
    if kind == "reset":
        return "pending", 0, 0, None
    if kind == "start" and status == "pending":
        return "in_progress", defers, interrupts, None
    if status != "in_progress":
        return state[:4]
    if kind == "done":
        return "success", 0, 0, None
    if kind == "failed":
        return "failed", defers, interrupts, None
    if kind == "deferred":
        if defers >= len(DEFERRAL_SECONDS):
            return "failed", defers + 1, interrupts, None
        return "deferred", defers + 1, interrupts, at + DEFERRAL_SECONDS[defers] * unit * 1_000_000
    if kind == "interrupted":
        return ("failed", defers, interrupts + 1, None) if interrupts + 1 >= MAX_INTERRUPTIONS else ("deferred", defers, interrupts + 1, at)
    return state[:4]


def advance(state: tuple, events: Iterable[tuple[int, int, str]], until: int | None, unit: int) -> Iterator[tuple[tuple, int, str]]:
    """(state, time, event) of each change by events (time, id, kind) in order, then by a try that is due at ``until``."""
    for at, _, kind in events:
        for due in _released(state, at):
            state = due[0]
            yield due
        new = _after(state, kind, at, unit)
        if new != state[:4]:
            state = (*new, state[4] + 1)
            yield state, at, kind
    if until is not None:
        yield from _released(state, until)


def _released(state: tuple, now: int) -> Iterator[tuple[tuple, int, str]]:
    if state[0] == "deferred" and state[3] <= now:
        yield ("pending", *state[1:3], None, state[4] + 1), state[3], "due"


def _together(events: Iterable[tuple[int, int, str]]) -> list[tuple[list, ...]]:
    """Waiting events as rows of the state store."""
    return [tuple(map(list, zip(*some))) for some in batched(events, TOGETHER)]


def _timer(at: int) -> int:
    """The timer, in milliseconds, of a time in microseconds."""
    return at // 1000 + 1


class _Machine(StatefulProcessor):
    def __init__(self, unit: int):
        self.unit = unit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, defers int, interrupts int, retry long, n long")
        self.waiting = handle.getListState("waiting", "at array<long>, id array<long>, kind array<string>")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        """Events only join those that wait; what is kept of the item is read once its time has come."""
        watermark = timerValues.getCurrentWatermarkInMs()
        came = {(r.at, r.id, r.kind) for r in rows if r.at > watermark * 1000}  # what the watermark has passed before it came is late
        if came:
            self.waiting.appendList(_together(came))
        timers = list(self.handle.listTimers())
        if any(watermark <= t <= watermark + 1 for t in timers):  # something may be due, but its timer goes off later
            return self._due(key, watermark)
        first = min((_timer(e[0]) for e in came), default=None)
        if came and all(first < t for t in timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        return self._due(key, timerValues.getCurrentWatermarkInMs())

    def _due(self, key, watermark: int) -> Iterator[Row]:
        until = watermark * 1000
        state = self.state.get() or FRESH
        waiting = {e for some in self.waiting.get() for e in zip(*some)}
        ready, rest = (sorted(e for e in waiting if (e[0] <= until) == due) for due in (True, False))
        changes = list(advance(state, ready, until, self.unit))
        if changes:
            state = changes[-1][0]
            self.state.update(state)
        if ready:
            self.waiting.put(_together(rest)) if rest else self.waiting.clear()
        ahead = [t for t in (rest[0][0] if rest else None, state[3]) if t is not None]
        if ahead:
            self.handle.registerTimer(_timer(min(ahead)))
        for s, at, event in changes:
            yield Row(item=key[0], n=s[4], at=at, event=event, status=s[0], defer_count=s[1], hard_interrupts=s[2], next_retry=s[3])


def _events(events: DataFrame) -> DataFrame:
    return events.where("item is not null and ts is not null and kind is not null").select("item", "ts", F.unix_micros("ts").alias("at"), F.col("id").cast("long").alias("id"), "kind")


def _changes(found: DataFrame) -> DataFrame:
    """Times as timestamps."""
    return found.withColumns({c: F.timestamp_micros(c) for c in ("at", "next_retry")})


def _schema(events: DataFrame) -> str:
    return CHANGE.format(kind=events.schema["item"].dataType.simpleString()).replace("timestamp", "long")


def stream_changes(events: DataFrame, delay: str, unit: int = 1) -> DataFrame:
    """Changes of items by a stream of events (item, ts, id, kind), in append mode. The session's state store must be RocksDB."""
    rows = _events(events.withWatermark("ts", delay)).groupBy("item")
    return _changes(rows.transformWithState(_Machine(unit), _schema(events), "append", "eventTime"))


def changes(events: DataFrame, until: int | None = None, unit: int = 1) -> DataFrame:
    """The same changes of a table of events up to ``until`` (microseconds), tries that are due by then included."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item, state, last, out, kind = None, FRESH, None, [], None

        def took(found: Iterator) -> None:
            nonlocal state
            for state, at, event in found:  # noqa: B007
                out.append((item, state[4], at, event, state[0], state[1], state[2], state[3]))

        def batch() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["item", "n", "at", "event", "status", "defer_count", "hard_interrupts", "next_retry"])

        for rows in batches:
            kind = rows.schema.field("item").type
            for key, at, number, event in zip(*(rows.column(c).to_pylist() for c in ("item", "at", "id", "kind"))):
                if key != item:
                    took(advance(state, (), until, unit))
                    item, state, last = key, FRESH, None
                if (at, number, event) != last and (until is None or at <= until):
                    last = (at, number, event)
                    took(advance(state, [last], None, unit))
            if len(out) > 4096:
                yield batch()
                out.clear()
        took(advance(state, (), until, unit))
        if out:
            yield batch()

    rows = _events(events).drop("ts").repartition("item").sortWithinPartitions("item", "at", "id", "kind")
    return _changes(rows.mapInArrow(folded, _schema(events)))


def latest(found: DataFrame) -> DataFrame:
    """Each item's status after its last change."""
    rest = [c for c in found.columns if c not in ("item", "n")]
    return found.groupBy("item").agg(F.max("n").alias("n"), F.max_by(F.struct(*rest), "n").alias("_s")).select("item", "n", "_s.*")
