"""Streaming queries: a file stream over the events, run to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.checkpoints import fresh_folder
from docloom.streaming import jobs, machine

QUERIES: dict = {}
SQL: dict[str, str] = {"stream_statuses": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"}


def stream_statuses(spark, d):
    """Complete mode, so that the last window is there too; each batch replaces the table before it."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    folder = fresh_folder(spark, "statuses")
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    counts = jobs.statuses(source, watermark="40 days")

    def replace(batch, _) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts")

    run = counts.writeStream.foreachBatch(replace).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/counts").select("day", "event_type", F.col("n"))


QUERIES["stream_statuses"] = stream_statuses


#: What an event does to its user's item.
KINDS = {"signup": "reset", "view": "start", "purchase": "done", "click": "deferred", "error": "interrupted"}
#: A second of a delay counts as so many here, as a user's events are hours apart; tries count up to so many days after the last event.
UNIT, AFTER = 900, 2


def _items(spark, d):
    kind = F.when((F.col("event_type") == "error") & (F.col("value") > 60), "failed").otherwise(F.coalesce(*[F.when(F.col("event_type") == e, k) for e, k in KINDS.items()]))
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("item"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"), kind.alias("kind"))


_MACHINE_SQL = f"""WITH RECURSIVE k AS (
  SELECT user_id AS item, epoch_us(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
    CASE WHEN event_type = 'error' AND value > 60 THEN 'failed' ELSE CASE event_type {" ".join(f"WHEN '{e}' THEN '{k}'" for e, k in KINDS.items())} END END AS kind FROM events),
m AS (
  SELECT DISTINCT item, CAST(0 AS BIGINT) AS i, 'pending' AS status, 0 AS defers, 0 AS interrupts, CAST(NULL AS BIGINT) AS retry, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS at_us FROM k
  UNION ALL
  SELECT item, i, s, CASE WHEN s = 'success' OR reset THEN 0 ELSE defers + CAST(defer AS INTEGER) END, CASE WHEN s = 'success' OR reset THEN 0 ELSE interrupts + CAST(broken AS INTEGER) END,
    CASE WHEN s <> 'deferred' THEN NULL WHEN defer THEN ts + CAST([45, 90, 180, 300][defers + 1] AS BIGINT) * {UNIT} * 1000000 WHEN broken THEN ts ELSE retry END,
    n + CAST(due AS INTEGER) + CAST(moved AS INTEGER), CASE WHEN moved THEN ts WHEN due THEN retry ELSE at_us END
  FROM (
    SELECT *, CASE WHEN reset THEN 'pending' WHEN was = 'pending' AND kind = 'start' THEN 'in_progress' WHEN was <> 'in_progress' THEN was WHEN kind = 'done' THEN 'success' WHEN kind = 'failed' THEN 'failed'
        WHEN defer AND defers >= 4 THEN 'failed' WHEN broken AND interrupts >= 2 THEN 'failed' WHEN defer OR broken THEN 'deferred' ELSE was END AS s,
      (reset AND (was <> 'pending' OR defers > 0 OR interrupts > 0)) OR (was = 'pending' AND kind = 'start') OR (was = 'in_progress' AND kind IN ('done', 'failed', 'deferred', 'interrupted')) AS moved
    FROM (
      SELECT k.*, m.defers, m.interrupts, m.retry, m.n, m.at_us, m.status = 'deferred' AND m.retry <= k.ts AS due, CASE WHEN due THEN 'pending' ELSE m.status END AS was,
        k.kind = 'reset' AS reset, was = 'in_progress' AND k.kind = 'deferred' AS defer, was = 'in_progress' AND k.kind = 'interrupted' AS broken
      FROM m JOIN k ON k.item = m.item AND k.i = m.i + 1) a) b),
e AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY item ORDER BY i DESC) = 1),
f AS (SELECT *, status = 'deferred' AND retry <= (SELECT max(epoch_us(ts)) FROM events) + {AFTER} * 86400000000 AS due FROM e)
SELECT item, n + CAST(due AS INTEGER) AS n, CASE WHEN due THEN 'pending' ELSE status END AS status, defers AS defer_count, interrupts AS hard_interrupts, CASE WHEN due THEN retry ELSE at_us END AS at_us FROM f WHERE n > 0"""
SQL["stream_machine"] = SQL["batch_machine"] = _MACHINE_SQL


def _ended(found):
    return machine.latest(found).select("item", "n", "status", "defer_count", "hard_interrupts", F.unix_micros("at").alias("at_us"))


def batch_machine(spark, d):
    events = _items(spark, d)
    last = events.agg(F.max(F.unix_micros("ts"))).first()[0] or 0
    return _ended(machine.changes(events, last + AFTER * 86_400_000_000, UNIT))


def stream_machine(spark, d):
    """Events come in four files, a tenth of them a file late and a seventh of them again; an event of no user ends the stream."""
    folder, events = fresh_folder(spark, "machine"), _items(spark, d)
    low, last = events.agg(F.min("ts"), F.max("ts")).first()
    if last is None:
        return batch_machine(spark, d)
    span = F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(low)) + 1
    part = F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(low))) * 4 / span)
    late = F.least(part + (F.col("id") % 10 == 0).cast("int"), F.lit(3))
    again = events.where("id % 7 = 0").withColumn("file", F.least(part + 1, F.lit(3)))
    files = events.withColumn("file", late).unionAll(again)
    for k in range(4):
        # as many files as a batch takes, so that batches are four and the last, however many partitions the input has
        files.where(F.col("file") == k).drop("file").repartition(4).write.mode("append").parquet(f"{folder}/events")
    delay = max(1, (last - low).days // 2 + 1)  # spans two files, so that late rows are in time
    end = F.lit(last) + F.expr(f"interval {AFTER + delay} days")
    beat = spark.range(1).select(F.lit(-1).cast("long").alias("item"), end.alias("ts"), F.lit(-1).cast("long").alias("id"), F.lit("beat").alias("kind"))
    beat.write.mode("append").parquet(f"{folder}/events")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/events")
        found = machine.stream_changes(source, f"{delay} days", UNIT).where("item >= 0")
        run = found.writeStream.format("parquet").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(store) if before is None else spark.conf.set(store, before)
    return _ended(spark.read.schema(found.schema).parquet(f"{folder}/changes"))


QUERIES["batch_machine"], QUERIES["stream_machine"] = batch_machine, stream_machine
