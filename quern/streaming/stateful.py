"""Keyed state in streams: a work queue that tries failed work again, and a log of status changes with their durations.

Both keep a key's state in RocksDB on the executors' disks, with the checkpoint; a batch that is replayed starts from the state before it,
and sinks write under the batch's number, so results do not change. Work itself is done at least once.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The default wait in seconds, and how often work is tried again.
RETRY_SECONDS, RETRIES = 60, 3

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_rocksdb(spark: SparkSession) -> None:
    """State stores of streams that start from now on."""
    for key, value in _STORE.items():
        spark.conf.set(key, value)


# ---------------------------------------------------------------- work


class _Attempts(StatefulProcessor):
    """A key's payload, attempts and status; a timer for the next attempt."""

    def __init__(self, work: Callable[[str, str, int], str | None], retries: int, wait_ms: int, longest_ms: int):
        self.work, self.retries, self.wait_ms, self.longest_ms = work, retries, wait_ms, longest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("work", "payload string, attempts int, status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        payloads = [r["payload"] for r in rows]
        if self.state.exists():
            # what is in the queue, was delivered or is dead is not taken in again
            attempts = self.state.get()[1]
            for _ in payloads:
                yield self._event(key, attempts, "duplicate", None, None, timerValues)
            return
        yield from self._attempt(key, payloads[0], 1, timerValues)
        for _ in payloads[1:]:
            yield self._event(key, 1, "duplicate", None, None, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        payload, attempts, status = self.state.get()
        if status == "retry":
            yield from self._attempt(key, payload, attempts + 1, timerValues)

    def _attempt(self, key, payload, attempt: int, timers) -> Iterator[Row]:
        try:
            code = self.work(key[0], payload, attempt)
        except Exception as error:  # noqa: BLE001  what fails without a code may be transient
            code = f"transient_{type(error).__name__}"
        wait = None
        if code is None:
            status = "delivered"
        elif code.startswith("transient_") and attempt <= self.retries:
            status, wait = "retry", min(self.wait_ms << (attempt - 1), self.longest_ms)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + wait)
        else:
            status = "dead"
        # the payload is needed only for another attempt
        self.state.update((payload if status == "retry" else None, attempt, status))
        yield self._event(key, attempt, status, code, wait, timers)

    @staticmethod
    def _event(key, attempt, status, code, wait, timers) -> Row:
        return Row(key=key[0], attempt=attempt, status=status, error_code=code, wait_ms=wait, at_ms=timers.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


EVENT = "key string, attempt int, status string, error_code string, wait_ms long, at_ms long"


class WorkQueue:
    """JSON lines (key, payload) that land in a folder are worked on until they are delivered or dead.

    ``work`` takes key, payload and the attempt's number and returns an error code, or None if it is done. A code of the
    transient category (and an exception) is tried again, ``retries`` times, after a wait that doubles from attempt to attempt up to ``longest_seconds``;
    any other, and the last failed attempt, makes a dead letter. A key that was taken in is never taken in again. Every
    attempt is an event.
    """

    def __init__(self, spark: SparkSession, landing: str, root: str, work: Callable[[str, str, int], str | None], retries: int = RETRIES, wait_seconds: float = RETRY_SECONDS, longest_seconds: float = 3600.0, max_files: int = 1000):
        self.spark, self.landing, self.root, self.max_files = spark, landing, root.rstrip("/"), max_files
        self.processor = _Attempts(work, retries, int(wait_seconds * 1000), int(longest_seconds * 1000))

    def start(self, every_seconds: float = 1.0):
        """The running query; timers are looked at in every batch."""
        use_rocksdb(self.spark)
        landed = self.spark.readStream.schema("key string, payload string").option("maxFilesPerTrigger", self.max_files).json(self.landing)
        events = landed.where("key is not null").groupBy("key").transformWithState(self.processor, EVENT, "append", "processingTime")
        sink = lambda batch, number: batch.write.mode("overwrite").parquet(f"{self.root}/events/batch={number}")
        writer = events.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", f"{self.root}/checkpoint")
        return writer.trigger(processingTime=f"{int(every_seconds * 1000)} milliseconds").start()

    def drain(self, keys: int, seconds: float = 300.0, every_seconds: float = 1.0) -> None:
        """Run until so many keys are delivered or dead."""
        query, until = self.start(every_seconds), time.time() + seconds
        try:
            while self.finished().count() < keys:
                if query.exception() is not None:
                    raise query.exception()
                if time.time() > until:
                    raise TimeoutError(f"{self.finished().count()} of {keys} keys are done")
                time.sleep(every_seconds)
        finally:
            query.stop()

    def events(self) -> DataFrame:
        """Every attempt: key, attempt, status (delivered, retry, dead, duplicate), error_code, wait_ms, at_ms."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/events")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], f"{EVENT}, batch int")
        return self.spark.read.schema(f"{EVENT}, batch int").parquet(f"{self.root}/events")

    def finished(self) -> DataFrame:
        return self.events().where("status in ('delivered', 'dead')")

    def dead_letters(self) -> DataFrame:
        """(key, attempts, error_code) of what was given up."""
        return self.events().where("status = 'dead'").select("key", F.col("attempt").alias("attempts"), "error_code")


# ---------------------------------------------------------------- statuses


class _Changes(StatefulProcessor):
    """A run's events that wait for the watermark, and its last status."""

    def __init__(self, terminal: Sequence[str]):
        self.terminal = set(terminal)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_us long, tie long, status string")
        self.last = handle.getValueState("last", "at_us long, status string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [(r["at_us"], r["tie"], r["status"]) for r in rows]
        before = min((x[0] for x in self.waiting.get()), default=None) if self.waiting.exists() else None
        self.waiting.appendList(fresh)
        first = min(x[0] for x in fresh)
        if before is None or first < before:
            self.handle.registerTimer(first // 1000)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [x for x in waiting if x[0] // 1000 <= passed], [x for x in waiting if x[0] // 1000 > passed]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000)
        else:
            self.waiting.clear()
        at, status = self.last.get() if self.last.exists() else (None, None)
        done = False
        for now, tie, new in ready:
            if new != status or at is None:
                yield Row(key=key[0], tie=tie, at_us=now, status=new, previous_status=status, duration_since_previous_ms=None if at is None else (now - at) // 1000)
            at, status = now, new
            done = new in self.terminal
        if done and not later:
            self.last.clear()
        elif ready:
            self.last.update((at, status))

    def close(self) -> None:
        pass


CHANGE = "key string, tie long, at_us long, status string, previous_status string, duration_since_previous_ms long"


def status_changes(events: DataFrame, key: str, at: str, status: str, delay: str, tie: str | None = None, terminal: Sequence[str] = ()) -> DataFrame:
    """A stream of the status changes of each run: key, tie, at_us, status, previous_status and the milliseconds since the run's event before.

    Events may come out of order by ``delay``; a run's events are put in order (``tie`` breaks ties of time) when the watermark has passed them, so
    changes equal those that ``ingest.transitions`` finds in the whole table. Later ones are dropped and counted by
    ``late_events``. Runs that reach a ``terminal`` status are forgotten.
    """
    use_rocksdb(events.sparkSession)
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("at_us"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("tie"), F.col(status).alias("status"))
    rows = rows.where("key is not null and at is not null").withWatermark("at", delay)
    return rows.groupBy("key").transformWithState(_Changes(terminal), CHANGE, "append", "eventTime")


def late_events(query) -> int:
    """How many rows a query has dropped because the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


__all__ = ["WorkQueue", "status_changes", "late_events", "use_rocksdb"]
