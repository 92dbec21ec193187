"""The status machine's use of its state: what waits is only read when something is due, and changes come out in the same batch as ever."""

import random
from types import SimpleNamespace

from docloom.streaming import machine


class Kept:
    """A value, a list and the timers of one item, and how often they are read and written."""

    def __init__(self):
        self.value, self.rows, self.timers, self.read, self.written = None, [], set(), 0, 0

    def getValueState(self, *_):  # noqa: N802
        return SimpleNamespace(exists=lambda: self.value is not None, get=lambda: self.value, update=lambda v: setattr(self, "value", v))

    def getListState(self, *_):  # noqa: N802
        def get():
            self.read += len(self.rows)
            yield from [*self.rows]

        def add(rows):
            self.written += len(rows)
            self.rows += rows

        def put(rows):
            self.rows = []
            add(rows)

        return SimpleNamespace(exists=lambda: bool(self.rows), get=get, put=put, appendList=add, clear=lambda: put([]))

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)


def ran(batches, kept=None):
    """The changes of one item in each batch (watermark in milliseconds, events), as Spark calls a processor: input first, then timers before the watermark."""
    kept, out = kept or Kept(), []
    m = machine._Machine(1)
    m.init(kept)
    for watermark, events in batches:
        times, found = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w), []
        if events:
            found += m.handleInputRows(("i",), iter([SimpleNamespace(at=a, id=i, kind=k) for a, i, k in events]), times)
        for t in sorted(t for t in kept.timers if t < watermark):
            found += m.handleExpiredTimer(("i",), times, SimpleNamespace(getExpiryTimeInMs=lambda t=t: t))
            kept.timers.discard(t)
        out.append([(r.n, r.at, r.event, r.status, r.defer_count, r.hard_interrupts, r.next_retry) for r in found])
    return out


def expected(batches):
    """The same by the rules alone: in a batch with rows of the item, or with a timer (the millisecond after what comes first), all that is due comes out."""
    state, waiting, timers, out = machine.FRESH, set(), set(), []
    for watermark, events in batches:
        until, found = watermark * 1000, []
        if events or any(t < watermark for t in timers):
            waiting |= {e for e in events if e[0] > until}
            found = list(machine.advance(state, sorted(e for e in waiting if e[0] <= until), until, 1))
            state, waiting = found[-1][0] if found else state, {e for e in waiting if e[0] > until}
            timers |= {t // 1000 + 1 for t in sorted({*[e[0] for e in waiting], *([] if state[3] is None else [state[3]])})[:1]}
        timers = {t for t in timers if t >= watermark}
        out.append([(s[4], at, event, *s[:4]) for s, at, event in found])
    return out


def test_waiting_events_are_read_when_due_only():
    kept = Kept()
    batches = [(0, [(1_000_000 * (100 * b + k + 1), 100 * b + k, "start") for k in range(100)]) for b in range(5)]
    assert ran(batches, kept) == [[]] * 5
    assert kept.read == 0 and kept.written <= 10  # five hundred events, in rows of many
    assert kept.timers == {1001}
    assert ran([(2000, [])], kept) == [[(1, 1_000_000, "start", "in_progress", 0, 0, None)]]


def test_same_changes_in_the_same_batches():
    """Late, repeated and out-of-order events, events at the watermark and within two milliseconds of it, batches without rows of the item."""
    kinds = ["start", "start", "start", "done", "failed", "deferred", "interrupted", "reset", "odd"]
    for seed in range(300):
        r = random.Random(seed)
        watermark, batches, seen = 0, [], []
        for b in range(r.randint(1, 12)):
            events = [(watermark * 1000 + r.choice([-2_000_000, -1, 0, 1, 999, 1000, 1001, 2000, r.randrange(60_000_000)]), 100 * b + k, r.choice(kinds)) for k in range(r.choice([0, 0, 1, 3, 20]))]
            events += r.choices(seen, k=r.randint(0, 3)) if seen else []
            seen += events
            batches.append((watermark, events))
            watermark += r.choice([0, 1, 2, 3, 1000, r.randrange(60_000), 400_000])
        batches.append((watermark + 1_000_000, []))
        assert ran(batches) == expected(batches), seed


def test_events_without_number():
    events = [(1_000, None, "start"), (2_000, 4, "done"), (1_000, None, "start")]
    assert [c[2] for c in ran([(0, events), (10, [])])[1]] == ["start", "done"]
