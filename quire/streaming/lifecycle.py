"""Jobs as stateful operators with timers: states that end by themselves, and queues that refuse what is beyond their room.

A job's state is a value of its own. When the job ends, a timer is set to the end of its time to live; when the watermark passes it, the job is
announced as expired and its state is gone, without any batch that looks through all jobs. What a queue has open is a map, so a queue holds
its open jobs and no more. Both are kept in RocksDB and taken up again from the checkpoint after a restart.

Events of a batch are taken in order of time, then of their numbers. Rows without an event are none. Events later than the watermark
are dropped, as the stream's ``late`` says; a job that is submitted anew before its time is over lives on, and its timer goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.jobs import ENDED, FOLLOWS, STATE
from ..sources.scratch import folder

#: The store that keeps such states, and the setting that names it.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
JOB_ROW = "job_id long, kind string, status string, changes int, n_events int, finished_at timestamp"
_JOB_STATE = "status string, changes int, n_events int, finished_us long"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _time(us: int | None) -> datetime | None:
    return None if us is None else _EPOCH + timedelta(microseconds=us)


def _in_order(rows: Iterator[Row]) -> list[Row]:
    return sorted((r for r in rows if r.event is not None), key=lambda r: (r.us, r.event_id))


class Jobs(StatefulProcessor):
    """Of each batch the state of every job that it has events of (kind state), and each job whose time is over (kind expired)."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", _JOB_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, changes, n, finished = self.state.get() if self.state.exists() else ("new", 0, 0, None)
        for r in (events := _in_order(rows)):
            n += 1
            if status in FOLLOWS[r.event] or r.event == "submitted" and status in ENDED:
                status, changes = STATE[r.event], changes + 1
                finished = r.us if status in ENDED else None
        if not events:
            return
        self.state.update((status, changes, n, finished))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if finished is not None:
            # The first whole millisecond after the time to live.
            self.handle.registerTimer((finished + self.ttl * 1_000_000) // 1000 + 1)
        yield Row(job_id=key[0], kind="state", status=status, changes=changes, n_events=n, finished_at=_time(finished))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            status, changes, n, finished = self.state.get()
            self.state.clear()
            yield Row(job_id=key[0], kind="expired", status=status, changes=changes, n_events=n, finished_at=_time(finished))

    def close(self) -> None:
        pass


class Queue(StatefulProcessor):
    """For each event, how many jobs its queue had open before, and for submissions whether they are admitted."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "job_id long", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {k[0] for k in self.open.keys()}
        before = set(held)
        for r in _in_order(rows):
            active, ok = len(held), None
            if r.event == "submitted":
                ok = r.job_id not in held and active < self.most
            if ok:
                held.add(r.job_id)
            elif r.event in ENDED:
                held.discard(r.job_id)
            yield Row(queue=key[0], event_id=r.event_id, active=active, admitted=ok)
        for job in before - held:
            self.open.removeKey((job,))
        for job in held - before:
            self.open.updateValue((job,), (0,))

    def close(self) -> None:
        pass


def _timed(events: DataFrame, late: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)


def job_lives(events: DataFrame, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """job_id, kind, status, changes, n_events, finished_at for a stream of events (job_id, ts, event_id, event)."""
    return _timed(events, late).groupBy("job_id").transformWithState(Jobs(ttl_seconds), JOB_ROW, "Update", "EventTime")


def admissions(events: DataFrame, most: int, late: str = "0 seconds") -> DataFrame:
    """queue, event_id, active, admitted for a stream of events (queue, job_id, ts, event_id, event): see operators.jobs.admitted."""
    return _timed(events, late).groupBy("queue").transformWithState(Queue(most), "queue long, event_id long, active int, admitted boolean", "Update", "None")


def run(updates: DataFrame, spark: SparkSession, out: str | None = None, checkpoint: str | None = None, watch: Callable[[int], None] = lambda n: None) -> DataFrame:
    """Runs a stream over what is there and gives its rows with their batch; with the same folders, it goes on where it stopped."""
    out, checkpoint = out or folder(spark, "lives"), checkpoint or folder(spark, "lives-stream")

    def keep(batch: DataFrame, number: int) -> None:
        watch(number)
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/at={number:08d}")

    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        query = updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE[0]) if before is None else spark.conf.set(STORE[0], before)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema.fields)
    return spark.read.schema(f"{kinds}, batch int").parquet(f"{out}/at=*")
