"""The life of a job service: what was open when it stopped has failed, states follow a stream, old jobs go, the rest is cancelled at the end."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs as J
from ..sources.scratch import folder
from .jobs import job_states


class Service:
    """Job states from a stream of events (job_id, ts, event_id, event), as a table that is replaced job by job."""

    def __init__(self, spark: SparkSession, events: DataFrame, ttl_seconds: int = 3600, engine: Callable[[], object] | None = None):
        self.spark, self.events, self.ttl = spark, events, ttl_seconds
        self.make, self._engine, self._lock = engine, None, threading.Lock()
        self.out, self.query, self.restored = folder(spark, "service"), None, None

    def engine(self) -> object:
        """The engine, made when it is first asked for and then kept."""
        with self._lock:
            if self._engine is None and self.make:
                self._engine = self.make()
            return self._engine

    def start(self, before: DataFrame | None = None) -> Service:
        """Take up the jobs of an earlier service, warm the engine, and follow the events."""
        self.restored = J.restored(before) if before is not None else None
        self.engine()
        keep = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{self.out}/batch={n:08d}")
        self.query = job_states(self.events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", folder(self.spark, "service-stream")).trigger(availableNow=True).start()
        return self

    def jobs(self) -> DataFrame:
        """job_id, status, finished_at: the last state of every job."""
        rows = self.spark.read.schema("job_id long, status string, changes int, n_events int, finished_at timestamp").parquet(self.out)
        now = rows.groupBy("job_id").agg(F.max_by(F.struct("status", "finished_at"), "n_events").alias("s")).select("job_id", "s.*")
        if self.restored is None:
            return now
        old = self.restored.select("job_id", "status", "finished_at")
        return now.unionByName(old.join(now.select("job_id"), "job_id", "left_anti"))

    def expired(self, now) -> DataFrame:
        return J.expired(self.jobs(), now, self.ttl)

    def stop(self) -> DataFrame:
        """Let what was taken up end; the states of all jobs, of which those still waiting are cancelled."""
        if self.query is not None:
            self.query.awaitTermination()
            self.query = None
        return self.jobs().withColumn("status", F.when(F.col("status") == "queued", "cancelled").otherwise(F.col("status")))
