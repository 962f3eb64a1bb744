"""Job states over a stream of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.jobs import ENDED, FOLLOWS, STATE
from ..sources.scratch import folder

#: How late an event may come, and how long a silent job's state is kept.
LATE, KEPT_SECONDS = "1 day", 60 * 86400
ROW = "job_id long, status string, changes int, n_events int, finished_at timestamp"
STATE_ROW = "status string, changes int, n_events int, finished_at timestamp"


def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One job's state after a batch of its events, which are taken in order of time. A silent job's state goes when its time is over."""
    if state.hasTimedOut:
        state.remove()
        return
    status, changes, n, finished = state.get if state.exists else ("new", 0, 0, None)
    events = pd.concat(list(parts)).sort_values(["ts", "event_id"])
    for ts, event in zip(events["ts"], events["event"]):
        n += 1
        if status in FOLLOWS[event] or event == "submitted" and status in ENDED:
            status, changes = STATE[event], changes + 1
            finished = ts.to_pydatetime() if status in ENDED else None
    state.update((status, int(changes), int(n), finished))
    last = int(events["ts"].iloc[-1].timestamp() * 1000)
    state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + KEPT_SECONDS * 1000)
    yield pd.DataFrame({"job_id": [key[0]], "status": [status], "changes": [changes], "n_events": [n], "finished_at": [pd.Timestamp(finished) if finished is not None else pd.NaT]})


def job_states(events: DataFrame) -> DataFrame:
    """Updates of job states for a stream of events (job_id, ts, event_id, event)."""
    timed = events.filter("event IS NOT NULL").select("job_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "event").withWatermark("ts", LATE)
    return timed.groupBy("job_id").applyInPandasWithState(advance, ROW, STATE_ROW, "update", GroupStateTimeout.EventTimeTimeout)


def event_stream(spark: SparkSession, folder_path: str, glob: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1).parquet(folder_path)


def run_to_end(updates: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs the stream over what is there, and gives the last state of each job. Batches are kept by number, so a rerun of one replaces it."""
    out = folder(spark, "job-states")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    query = updates.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", folder(spark, "job-stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(updates.schema).parquet(out)
    last = rows.groupBy("job_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "job_id"]), "n_events").alias("s"))
    return last.select("job_id", "s.status", "s.changes", "s.n_events", "s.finished_at")
