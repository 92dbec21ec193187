"""The status machine: its rules, out-of-order and repeated events, and the stream against the batch form."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docloom.streaming import machine

START = dt.datetime(2024, 1, 1)
SCHEMA = "item string, ts timestamp, id long, kind string"


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def events() -> list[tuple]:
    """Every rule once: three interruptions, five deferrals, a reset of a failed item, events that its status doesn't know."""
    rows = [("three", at(10 * k + (k % 2)), k, kind) for k, kind in enumerate(["start", "interrupted"] * 3 + ["start", "done"])]
    for k in range(5):
        rows += [("late", at(1000 * k), 100 + 2 * k, "start"), ("late", at(1000 * k + 1), 101 + 2 * k, "deferred")]
    rows += [("late", at(9000), 120, "start"), ("late", at(9001), 121, "reset"), ("late", at(9002), 122, "start"), ("late", at(9003), 123, "done"), ("late", at(9004), 124, "done")]
    rows += [("soon", at(0), 200, "start"), ("soon", at(1), 201, "deferred"), ("soon", at(45), 202, "start"), ("soon", at(46), 203, "start"), ("soon", at(47), 204, "failed"), ("soon", at(48), 205, "odd")]
    rows += [("waits", at(0), 300, "start"), ("waits", at(1), 301, "deferred"), ("never", at(5), 302, "done"), (None, at(1), 303, "start"), ("waits", None, 304, "done"), ("waits", at(2), 305, None)]
    return rows


def test_rules(spark):
    found = machine.changes(spark.createDataFrame(events(), SCHEMA))
    rows = {}
    for r in sorted(found.collect(), key=lambda r: r.n):
        rows.setdefault(r.item, []).append((r.event, r.status, r.defer_count, r.hard_interrupts))
    assert [s for _, s, *_ in rows["three"]] == ["in_progress", "deferred", "pending", "in_progress", "deferred", "pending", "in_progress", "failed"]
    assert rows["three"][-1] == ("interrupted", "failed", 0, 3)  # the later start and end change nothing
    assert [r for r in rows["late"] if r[1] == "failed"] == [("deferred", "failed", 5, 0)]
    assert rows["late"][-3:] == [("reset", "pending", 0, 0), ("start", "in_progress", 0, 0), ("done", "success", 0, 0)]
    # the start before the next try's time changes nothing, the one at it does
    assert [r[:2] for r in rows["soon"]] == [("start", "in_progress"), ("deferred", "deferred"), ("due", "pending"), ("start", "in_progress"), ("failed", "failed")]
    assert rows["waits"][-1][1] == "deferred" and "never" not in rows and None not in rows


def test_a_try_is_due_at_its_time(spark):
    rows = [("a", at(0), 1, "start"), ("a", at(1), 2, "deferred")]
    until = lambda s: int((at(s) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    df = spark.createDataFrame(rows, SCHEMA)
    last = lambda s: machine.latest(machine.changes(df, until(s))).first().status
    assert (last(45.9), last(46)) == ("deferred", "pending")
    assert machine.latest(machine.changes(df, until(0.5))).first().status == "in_progress"


def test_order_and_repeats_do_not_matter(spark):
    rows = events()
    once = sorted(map(tuple, machine.changes(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    mixed = rows[::-1] + rows[::3] + rows[1::4]
    assert sorted(map(tuple, machine.changes(spark.createDataFrame(mixed, SCHEMA).repartition(5)).collect()), key=repr) == once
    assert machine.changes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_stream_equals_batch(spark, tmp_path):
    """Three files out of order and with repeats, then one that moves the watermark on; what comes after it for an old time is left out."""
    rows = events()
    files = [rows[1::2], rows[::2] + rows[1::6], [("beat", at(100_000), 900, "start")], [("three", at(1), 901, "reset"), ("beat", at(200_000), 902, "done")]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
        run = machine.stream_changes(source, "20000 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(store)
    found = spark.read.parquet(str(tmp_path / "out")).where("item <> 'beat'")
    until = int((at(180_000) - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    expected = machine.changes(spark.createDataFrame(rows, SCHEMA), until)
    assert sorted(map(tuple, found.select(expected.columns).collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)


@pytest.mark.parametrize("kind", ["start", "done", "failed", "deferred", "interrupted", "reset", "odd"])
def test_changes_are_numbered_without_gaps(spark, kind):
    state, seen = machine.FRESH, []
    for k in range(12):
        for state, _, _ in machine.advance(state, [(k * 10**9, k, "start"), (k * 10**9 + 5, k, kind)], None, 1):  # noqa: B007
            seen.append(state[4])
    assert seen == list(range(1, len(seen) + 1))
