"""Recognition jobs as tables of events: admission, states, progress, expiry, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Which states an event may follow; fixed values. A job is new before its first event.
FOLLOWS = {"submitted": ("new",), "running": ("queued",), "completed": ("running",), "failed": ("queued", "running"), "cancelled": ("queued",)}
STATE = {"submitted": "queued", "running": "running", "completed": "completed", "failed": "failed", "cancelled": "cancelled"}
ENDED = ("completed", "failed", "cancelled")


def step(state: Column, event: Column) -> Column:
    """The state after an event; events that may not follow change nothing. An ended job may be submitted anew."""
    out = state
    for e, before in FOLLOWS.items():
        allowed = state.isin(*before, *(ENDED if e == "submitted" else ()))
        out = F.when((event == e) & allowed, F.lit(STATE[e])).otherwise(out)
    return out


def states(events: DataFrame) -> DataFrame:
    """job_id, status, changes, finished_at, n_events: a fold over each job's events in order.

    events: job_id, ts, event_id, event.
    """
    items = events.filter("event IS NOT NULL").groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event"))).alias("items"))
    start = F.struct(F.lit("new").alias("status"), F.lit(0).alias("changes"), F.lit(None).cast("timestamp").alias("finished_at"))

    def fold(a: Column, x: Column) -> Column:
        new = step(a["status"], x["event"])
        changed = new != a["status"]
        finished = F.when(changed, F.when(new.isin(*ENDED), x["ts"].cast("timestamp"))).otherwise(a["finished_at"])
        return F.struct(new.alias("status"), (a["changes"] + changed.cast("int")).alias("changes"), finished.alias("finished_at"))

    return items.select("job_id", F.aggregate("items", start, fold).alias("s"), F.size("items").alias("n_events")).select("job_id", "s.*", "n_events")


def restored(jobs: DataFrame) -> DataFrame:
    """Jobs as they are after a restart: what was queued or running has failed."""
    lost = F.col("status").isin("queued", "running")
    error = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    # The error is derived first, from the state before the restart.
    return jobs.withColumn("error", F.when(lost, "interrupted by a restart").otherwise(error)).withColumn("status", F.when(lost, "failed").otherwise(F.col("status")))


def expired(jobs: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Jobs that ended more than the time to live ago; running ones never expire."""
    return jobs.filter(F.col("finished_at").isNotNull() & (F.col("status") != "running") & (now.cast("double") - F.col("finished_at").cast("double") > ttl_seconds))


def janitor_seconds(ttl: Column) -> Column:
    """How often expiry is looked for."""
    return F.least(F.lit(60), F.greatest(F.lit(5), F.floor(ttl / 4)))


def progress(done: Column, total: Column, status: Column) -> Column:
    """Percent: at most 90 until the job has completed."""
    return F.when(status == "completed", 100).when(total > 0, F.least(F.lit(90), F.floor(done * 90 / F.when(total > 0, total)))).otherwise(0).cast("int")


def admitted(events: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """event_id, active (jobs open before this event) and admitted: submissions beyond ``most`` open jobs are refused.

    Refused jobs are counted as open nowhere; whether they are refused depends on those before, so the events of a group of
    ``by`` pass in order through one task, which holds no more than the open jobs and the batch it is at.
    """
    by = by or ["queue"]
    read = events.select(*by, "ts", "event_id", "job_id", "event")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_ = None, set()
        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(len(by))]))
            active, ok = [], []
            for key, job, event in zip(keys, batch.column(len(by) + 2).to_pylist(), batch.column(len(by) + 3).to_pylist()):
                if key != group:
                    group, open_ = key, set()
                active.append(len(open_))
                ok.append(job not in open_ and len(open_) < most if event == "submitted" else None)
                if ok[-1]:
                    open_.add(job)
                elif event in ENDED:
                    open_.discard(job)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], batch.column(len(by) + 1).cast(pa.int64()), pa.array(active, pa.int32()), pa.array(ok, pa.bool_())], [*by, "event_id", "active", "admitted"])

    kinds = ", ".join(f"`{c}` {read.schema[c].dataType.simpleString()}" for c in by)
    return read.repartition(*by).sortWithinPartitions(*by, "ts", "event_id", "job_id", "event").mapInArrow(run, f"{kinds}, event_id long, active int, admitted boolean")


def gate(jobs: DataFrame) -> DataFrame:
    """Adds status and error: a job fails if it found no text and kept no region as image, or if its checks fail.

    jobs: chars, fallback, result.
    """
    empty = (F.coalesce("chars", F.lit(0)) == 0) & ~F.coalesce("fallback", F.lit(False))
    status = F.when(empty | (F.col("result") == "FAIL"), "failed").otherwise("completed")
    return jobs.withColumn("status", status).withColumn("error", F.when(empty, "no text recognized").when(F.col("result") == "FAIL", "checks failed"))


def counters(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    return events.filter("event IS NOT NULL").groupBy(*(by or []), "event").agg(F.count("*").alias("n"))


def exposition(counts: DataFrame, prefix: str = "jobs") -> DataFrame:
    """One text: a metric line for each counter, in order of names."""
    line = F.concat(F.lit(f"{prefix}_"), "event", F.lit("_total "), F.col("n").cast("string"))
    return counts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def batch_status(files: DataFrame) -> DataFrame:
    """batch_id, files, completed, status: all, some or none of a batch's files completed."""
    n, done = F.count("*"), F.count_if(F.col("status") == "completed")
    return files.groupBy("batch_id").agg(n.alias("files"), done.alias("completed"), F.when(done == n, "completed").when(done > 0, "partial").otherwise("failed").alias("status"))


def manifest(files: DataFrame, most: int = 16, deadline: float = 600.0) -> DataFrame:
    """Adds state to the files of each batch (batch_id, n, seconds, status, code), which run one after another.

    Files beyond the limit, after the deadline, or after one with code 429, 503 or 504 are not started.
    """
    before = Window.partitionBy("batch_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("seconds").over(before), F.lit(0.0))
    aborted = F.coalesce(F.max(F.col("code").isin(429, 503, 504).cast("int")).over(before), F.lit(0)) == 1
    started = (F.row_number().over(Window.partitionBy("batch_id").orderBy("n")) <= most) & (spent < deadline) & ~aborted
    return files.withColumn("state", F.when(~started, "not_started").otherwise(F.col("status")))


def unsupported(wanted: Column, allowed: list[str]) -> Column:
    """Requested outputs that don't exist, each once, in order of request."""
    return F.array_except(wanted, F.array(*map(F.lit, allowed)))


def accepted_upload(name: Column) -> Column:
    """Whether the suffix is that of a readable file; fixed values."""
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin("pdf", "png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")


def visual_review(findings: DataFrame, checked: DataFrame, sure: float = 0.8, most: int = 20) -> DataFrame:
    """doc_id, issues, suggestions, status of a review of page images.

    findings: doc_id, page, category, confidence, bbox (shares of the page); checked: doc_id, pages, pages_checked. Boxes
    must lie in the page and not be empty; what is less sure is a suggestion.
    """
    b = F.col("bbox")
    ok = (F.size(b) == 4) & F.forall(b, lambda x: x.between(0, 1)) & (F.get(b, F.lit(0)) < F.get(b, F.lit(2))) & (F.get(b, F.lit(1)) < F.get(b, F.lit(3)))
    ranked = findings.filter(F.coalesce(ok, F.lit(False))).withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("confidence"), "category"))).filter(F.col("_n") <= most)
    counts = ranked.groupBy("doc_id").agg(F.count_if(F.col("confidence") >= sure).alias("issues"), F.count_if(F.col("confidence") < sure).alias("suggestions"))
    out = checked.join(counts, "doc_id", "left").withColumn("issues", F.coalesce("issues", F.lit(0))).withColumn("suggestions", F.coalesce("suggestions", F.lit(0)))
    status = F.when(F.col("pages_checked") < F.col("pages"), "partial").when(F.col("issues") > 0, "completed_with_findings").otherwise("completed")
    return out.select("doc_id", "issues", "suggestions", status.alias("status"))


def issues(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds verified: a finding of a language model counts if it quotes the page, and isn't about loss, which is measured.

    findings: doc_id, page, kind, detail, quote; evidence: doc_id, page, text.
    """
    joined = findings.join(evidence, ["doc_id", "page"], "left")
    quoted = (X.strip(X.or_empty(F.col("quote"))) != "") & F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False))
    return joined.withColumn("verified", quoted & ~F.col("kind").contains("missing")).drop("text")


def first_per_budget(units: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """Adds checked: whether a unit is among the first ``most`` of its group."""
    return units.withColumn("checked", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) <= most)
