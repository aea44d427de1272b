"""Structured Streaming forms of the batch operators; on the same rows they give the same results."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues


def sessions(events: DataFrame, key: str, ts: str, gap: str = "8 hours", late: str = "1 hour") -> DataFrame:
    """Gap segmentation: (key, start, last, n) of sessions of two rows at least, once the watermark has passed."""
    found = events.withWatermark(ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return found.where("n > 1").select(key, F.col("w.start").alias("start"), "last", "n")


def rolling_counts(events: DataFrame, key: str, ts: str, length: str = "36 hours", step: str = "8 hours", late: str = "1 hour", least: int = 4) -> DataFrame:
    """Rows per key in sliding windows."""
    found = events.withWatermark(ts, late).groupBy(key, F.window(ts, length, step).alias("w")).agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= least).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_key(rows: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


class _Ledger(StatefulProcessor):
    """How often a key was marked; forgotten ``idle`` milliseconds of event time after its last mark."""

    def __init__(self, key: str, idle: int | None):
        self.key, self.idle = key, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.uses = handle.getValueState("uses", "uses bigint, last bigint")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues: TimerValues) -> None:
        self.uses.update((initialState["uses"], None))

    def _row(self, key: tuple, uses: int, fresh: bool, expired: bool) -> Row:
        return Row(**{self.key: key[0], "uses": uses, "fresh": fresh, "expired": expired})

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        before, last = self.uses.get() if self.uses.exists() else (0, None)
        fresh, uses = before == 0, before
        if self.idle is None:
            uses += sum(1 for _ in rows)
        else:
            for at in sorted(int(row["ts"].timestamp() * 1000) for row in rows):
                if last is not None and at > last + self.idle:  # forgotten before the watermark said so
                    if uses > before:
                        yield self._row(key, uses, fresh, False)
                    yield self._row(key, uses, False, True)
                    before, uses, fresh = 0, 0, True
                uses, last = uses + 1, at if last is None else max(at, last)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last + self.idle)
        self.uses.update((uses, last))
        yield self._row(key, uses, fresh, False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.uses.exists():
            yield self._row(key, self.uses.get()[0], False, True)
            self.uses.clear()

    def close(self) -> None:
        pass


def usage_ledger(marks: DataFrame, key: str, ledger: DataFrame | None = None, ts: str | None = None, idle: timedelta | None = None, late: str = "1 hour") -> DataFrame:
    """(key, uses, fresh, expired) of every key of a micro-batch: how often it was marked so far, and whether none had marked it before.

    A typed state per key holds the count, so what earlier batches used stays
    used; ``ledger`` (key, uses) is what was used before the stream's first
    batch.  With ``idle`` a key is forgotten once the watermark of ``ts`` has
    passed its last mark by so much, and a row says so (expired).
    """
    spark = marks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = marks.schema[key].dataType.simpleString()
    if (idle is None) != (ts is None):
        raise ValueError("idle needs the column ts, and ts needs idle")
    timed = idle is not None
    rows = marks.select(key, F.col(ts).alias("ts")).withWatermark("ts", late) if timed else marks.select(key)
    initial = None if ledger is None else ledger.groupBy(key).agg(F.sum("uses").alias("uses")).groupBy(key)
    processor = _Ledger(key, int(idle.total_seconds() * 1000) if timed else None)
    return rows.groupBy(key).transformWithState(processor, f"`{key}` {kind}, uses bigint, fresh boolean, expired boolean", "append", "EventTime" if timed else "None", initial)


def file_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
