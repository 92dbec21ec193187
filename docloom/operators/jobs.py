"""Job control: summaries, retries, deferrals, throttling and progress of export items."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Delays in seconds after the first to fourth deferral; a further one fails the item. Fixed values.
DEFERRAL_SECONDS = (45, 90, 180, 300)
MAX_INTERRUPTIONS = 3


def summary(rows: DataFrame, status: str, duration: Column, keys: list[str] | None = None) -> DataFrame:
    """Counts by state, duration of successes in total and on average (0 without any) and percentage done."""
    ok, bad = F.col(status) == "success", F.col(status) == "failed"
    done = F.count_if(ok)
    total = F.coalesce(F.sum(F.when(ok, duration)), F.lit(0)).cast("long")
    return rows.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"), done.alias("success"), F.count_if(bad).alias("failed"), F.count_if(~ok & ~bad).alias("pending"),
        total.alias("sum_duration"), F.coalesce(F.floor(total / F.nullif(done, F.lit(0)) + 0.5), F.lit(0)).cast("long").alias("avg_duration"),
        F.coalesce(F.floor(done * 100 / F.count("*") + 0.5), F.lit(0)).cast("long").alias("percent"),
    )


def slowest(rows: DataFrame, status: str, duration: str, tie: str, n: int = 10) -> DataFrame:
    return rows.where((F.col(status) == "success") & (F.col(duration) > 0)).orderBy(F.desc(duration), tie).limit(n)


def deferrals(events: DataFrame, item: str, order: list[str]) -> DataFrame:
    """Each deferral's number, and the delay it brings or ``failed``."""
    n = F.row_number().over(Window.partitionBy(item).orderBy(*order))
    delays = F.array(*map(F.lit, DEFERRAL_SECONDS))
    return events.withColumn("nth", n).withColumn("outcome", F.when(n <= len(DEFERRAL_SECONDS), F.concat(F.lit("retry+"), F.try_element_at(delays, n).cast("string"))).otherwise("failed"))


def interruptions(events: DataFrame, item: str, kind: Column, order: list[str]) -> DataFrame:
    """State after each event: ``failed`` from the third interruption since the last success on."""
    w = Window.partitionBy(item).orderBy(*order)
    run = F.sum(F.when(kind == "success", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("run", run)
    since = F.sum(F.when(kind == "interrupted", 1).otherwise(0)).over(Window.partitionBy(item, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("hard_interrupts", since).withColumn("state", F.when(kind == "success", "success").when(since >= MAX_INTERRUPTIONS, "failed").otherwise("pending"))


def next_runnable(rows: DataFrame, idx: str, pending: Column, cursor: Column, keys: list[str]) -> DataFrame:
    """The first pending item from the cursor on, going round at the end."""
    return rows.where(pending).groupBy(*keys).agg(F.min(F.struct((F.col(idx) < cursor).alias("wrapped"), F.col(idx).alias("idx"))).alias("m")).select(*keys, F.col("m.idx").alias("next_idx"))


def throttled(rows: DataFrame, key: str, time: Column, value: str, order: list[str], gap: int = 500) -> DataFrame:
    """Progress reports without those that repeat the value sent last less than ``gap`` after it was sent.

    Rows come to a task sorted by key and pass through it one by one; all it keeps is the last report."""
    names = rows.columns

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for k, v, at in zip(batch.column(names.index(key)).to_pylist(), batch.column(names.index(value)).to_pylist(), batch.column(len(names)).to_pylist()):
                keep.append(last is None or last[:2] != (k, v) or at - last[2] >= gap)
                if keep[-1]:
                    last = (k, v, at)
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    dealt = rows.withColumn("_time", time.cast("long")).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInArrow(sent, rows.schema)


def release_due(rows: DataFrame, now: Column) -> DataFrame:
    """Deferred rows whose ``next_retry`` has come or is unset become pending."""
    due = (F.col("status") == "deferred") & (F.coalesce("next_retry", F.lit(0)) <= now)
    return rows.withColumns({"status": F.when(due, "pending").otherwise(F.col("status")), "next_retry": F.when(due, 0).otherwise(F.col("next_retry"))})


def reset(rows: DataFrame, which: Column) -> DataFrame:
    """The rows of ``which`` become pending, without error, retry time and counters."""
    which = F.coalesce(which, F.lit(False))
    cleared = {"status": F.lit("pending"), "error": F.lit(None).cast("string"), "next_retry": F.lit(None).cast("long"), "defer_count": F.lit(0), "hard_interrupts": F.lit(0)}
    return rows.withColumns({name: F.when(which, value).otherwise(F.col(name)) for name, value in cleared.items()})


def log_ring(rows: DataFrame, key: str, order: list[Column], n: int = 300) -> DataFrame:
    """The last ``n`` log rows of a key."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


#: Levels by their patterns, the first match counts, and lines that are not shown. Fixed values.
LEVELS = {"success": "成功|完成|获取到", "error": "失败|错误|Error", "warn": "暂停|取消|跳过|加密"}
NOISE = r"^\s*(文档类型:|类型:|使用本地|数据表记录:|内嵌白板渲染:|官方导出失败，自动切换)"


def log_level(message: Column) -> Column:
    """Level of a log line, empty for a plain one."""
    return F.coalesce(*(F.when(message.rlike(pattern), level) for level, pattern in LEVELS.items()), F.lit(""))


def shown_log(message: Column) -> Column:
    """Whether a log line is shown: neither blank nor one of the details."""
    content = F.regexp_replace(message, r"^([^\[]*)\[.*?\]\s*", "$1")
    return ~content.rlike(NOISE) & ~message.rlike(r"^\s*$")


def merged_logs(logs: DataFrame, line: str, order: Column) -> DataFrame:
    """Each line once, where it occurs first."""
    return logs.groupBy(line).agg(F.min(order).alias("first_at"))
