"""Jobs and queues over streams of several batches equal the batch operators, after a stop in the middle too."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quire.operators import jobs as J
from quire.streaming import jobs as S
from quire.streaming import lifecycle

EVENTS = "job_id long, queue long, ts timestamp, event_id long, event string"


@pytest.fixture(scope="module")
def events():
    rng = random.Random(11)
    begin = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(rng.randrange(120), 0, begin + timedelta(seconds=rng.randrange(40_000), microseconds=rng.choice([0, 500, 999_999])), i, rng.choice([*J.STATE, None])) for i in range(900)]
    return sorted([(j, j % 5, *rest) for j, _, *rest in rows], key=lambda r: (r[2], r[3]))


def write(spark, events, folder, parts):
    folder.mkdir(exist_ok=True)
    size = -(-len(events) // parts)
    for n in range(parts):
        # Files are taken one a batch, in order of their times.
        spark.createDataFrame(events[n * size : (n + 1) * size], EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        yield n


def stream(spark, folder):
    schema = spark.createDataFrame([], EVENTS).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_states_and_expiries_equal_the_batch(spark, tmp_path, events):
    table = spark.createDataFrame(events, EVENTS)
    ttl = 3000
    list(write(spark, events, tmp_path / "in", 4))
    got = lifecycle.run(lifecycle.job_lives(stream(spark, tmp_path / "in"), ttl), spark).collect()
    assert len({r.batch for r in got}) >= 4
    # A job that came again after it had expired began anew: the fold over its events forgets as the state does.
    want, expired = {}, []
    last = events[-1][2]
    for job in {e[0] for e in events}:
        status, changes, n, finished = "new", 0, 0, None
        for _, _, ts, _, event in [e for e in events if e[0] == job]:
            if event is None:
                continue
            if finished is not None and (ts - finished).total_seconds() > ttl:
                over = None
                # It expires when a batch's watermark has passed its time; later events of the same batch come before that.
                over = (job, status, finished)
                expired.append(over)
                status, changes, n, finished = "new", 0, 0, None
            n += 1
            if status in J.FOLLOWS[event] or event == "submitted" and status in J.ENDED:
                status, changes = J.STATE[event], changes + 1
                finished = ts if status in J.ENDED else None
        want[job] = (status, finished)
        if finished is not None and (last - finished).total_seconds() > ttl:
            expired.append((job, status, finished))
    streamed = [(r.job_id, r.status, r.finished_at.astimezone(timezone.utc)) for r in got if r.kind == "expired"]
    assert len(streamed) == len(set(streamed)) and set(streamed) <= set(expired)
    # With a time to live beyond the stream nothing is forgotten: states are those of the batch, and the expiries those at its end.
    states = {r.job_id: r for r in J.states(table).collect()}
    lives = lifecycle.run(lifecycle.job_lives(stream(spark, tmp_path / "in"), 10**6), spark).collect()
    latest = {}
    for r in sorted(lives, key=lambda r: r.batch):
        assert r.kind == "state"
        latest[r.job_id] = (r.status, r.changes, r.n_events, r.finished_at)
    assert latest == {j: (r.status, r.changes, r.n_events, r.finished_at) for j, r in states.items()}


def test_expiries_are_those_of_the_batch_at_the_end(spark, tmp_path, events):
    # Jobs that end once and don't come again.
    once = {}
    for e in events:
        if e[4] is not None and e[0] not in once:
            once[e[0]] = e
    begin = events[0][2]
    rows = sorted([x for j, e in once.items() for x in ((j, 0, begin + timedelta(seconds=j), 2 * j, "submitted"), (j, 0, e[2] + timedelta(seconds=200), 2 * j + 1, "cancelled"))], key=lambda r: (r[2], r[3]))
    list(write(spark, rows, tmp_path / "in", 5))
    table = spark.createDataFrame(rows, EVENTS)
    now = table.agg(F.max("ts")).first()[0]
    want = {(r.job_id, r.status) for r in J.expired(J.states(table), F.lit(now), 20_000).collect()}
    got = [(r.job_id, r.status) for r in lifecycle.run(lifecycle.job_lives(stream(spark, tmp_path / "in"), 20_000), spark).filter("kind = 'expired'").collect()]
    assert sorted(got) == sorted(want) and 0 < len(want) < len(once)


def test_admissions_and_lives_go_on_after_a_restart(spark, tmp_path, events):
    table = spark.createDataFrame(events, EVENTS)
    given, out, kept = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/kept"
    for n in write(spark, events, given, 4):
        if n == 1:
            # Stopped while its second batch is being written, and begun again from the checkpoint.
            def fail(number):
                raise RuntimeError("stopped")

            with pytest.raises(Exception, match="stopped"):
                lifecycle.run(lifecycle.admissions(stream(spark, given), 3), spark, out, kept, fail)
        rows = lifecycle.run(lifecycle.admissions(stream(spark, given), 3), spark, out, kept)
    got = {(r.queue, r.event_id, r.active, r.admitted) for r in rows.collect()}
    want = {(r.queue, r.event_id, r.active, r.admitted) for r in J.admitted(table.filter("event IS NOT NULL"), 3).collect()}
    assert got == want and {a for *_, a in got} == {True, False, None} and rows.count() == len(got)


def test_job_states_of_both_operators_agree(spark, tmp_path, events):
    list(write(spark, events, tmp_path / "in", 3))
    old = {(r.job_id, r.status, r.n_events) for r in S.run_to_end(S.job_states(stream(spark, tmp_path / "in").drop("queue")), spark).collect()}
    lives = lifecycle.run(lifecycle.job_lives(stream(spark, tmp_path / "in"), 10**6), spark)
    new = {(r.job_id, r.s.status, r.s.n_events) for r in lives.groupBy("job_id").agg(F.max_by(F.struct("status", "n_events"), "batch").alias("s")).collect()}
    assert new == old
