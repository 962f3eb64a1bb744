"""Queries on recognition jobs, made from events, and on batches and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import bridge as B
from ..model.bridge import sql
from ..operators import jobs as J
from ..operators import layout as L
from ..sinks import render
from ..sources.scratch import kept
from . import layout as PL


def events(spark, d):
    return B.job_events(B.table(spark, d, "events"))


def states(spark, d):
    return J.states(events(spark, d))


def streamed(spark, d):
    """The same states, from a stream of the events."""
    from ..streaming import jobs as S

    raw = spark.read.parquet(f"{d}/events.parquet")
    stream = S.event_stream(spark, d, "events.parquet", raw.schema)
    return S.run_to_end(S.job_states(B.job_events(stream)), spark)


def lives(spark, d):
    """States from a stream whose operator has a timer for each job that ended: kind state, and kind expired at the end of its time."""
    from ..streaming import jobs as S
    from ..streaming import lifecycle

    raw = spark.read.parquet(f"{d}/events.parquet")
    stream = S.event_stream(spark, d, "events.parquet", raw.schema)
    rows = lifecycle.run(lifecycle.job_lives(B.job_events(stream), 3600), spark)
    return rows.select("job_id", "kind", "status", "changes", "n_events", "finished_at")


def admitted_stream(spark, d):
    """Admission as a stateful operator, over a stream of the events."""
    from ..streaming import jobs as S
    from ..streaming import lifecycle

    raw = spark.read.parquet(f"{d}/events.parquet")
    stream = B.job_events(S.event_stream(spark, d, "events.parquet", raw.schema)).withColumn("queue", F.col("job_id") % 20)
    return lifecycle.run(lifecycle.admissions(stream, 3), spark).drop("batch")


def expired(spark, d):
    s = J.states(events(spark, d))
    now = B.table(spark, d, "events").agg(F.max("ts").cast("timestamp"))
    return J.expired(s, now.scalar(), 3600).select("job_id", "status")


def restored(spark, d):
    return J.restored(J.states(events(spark, d))).groupBy("status", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


def counters(spark, d):
    return J.counters(events(spark, d))


def exposition(spark, d):
    return J.exposition(J.counters(events(spark, d)))


def admitted(spark, d):
    """Queues by a twentieth of the jobs, with room for three."""
    e = events(spark, d).filter("event IS NOT NULL").withColumn("queue", F.col("job_id") % 20)
    return J.admitted(e, 3)


def progress(spark, d):
    l = B.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("done"))
    return l.select("l_orderkey", "l_linenumber", J.progress(F.least("done", F.lit(40)), F.lit(40), F.when(F.col("done") > 45, "completed").otherwise("running")).alias("progress"), J.janitor_seconds(F.col("done") * 10).cast("int").alias("janitor"))


def gate(spark, d):
    from . import quality as Q

    jobs = Q.C.text_chars(PL.blocks(spark, d)).withColumn("chars", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(F.col("chars"))).withColumn("fallback", F.col("doc_id") % 20 == 0)
    return J.gate(jobs.withColumn("result", F.when(F.col("doc_id") % 7 == 0, "FAIL").otherwise("WARN"))).select("doc_id", "status", F.coalesce("error", F.lit("")).alias("error"))


def batch_files(spark, d):
    l = B.table(spark, d, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("n")).agg((F.max("l_quantity") * 8).alias("seconds"), F.when(F.max("l_returnflag") == "R", "failed").otherwise("completed").alias("status"), F.when((F.max("l_returnflag") == "R") & (F.max("l_partkey") % 2 == 0), 503).otherwise(200).alias("code"))


def batches(spark, d):
    return J.batch_status(batch_files(spark, d))


def manifest(spark, d):
    return J.manifest(batch_files(spark, d)).select("batch_id", "n", "state")


def outputs(spark, d):
    p = B.table(spark, d, "part").select("p_partkey", F.array_distinct(F.array(F.lit("json"), F.lower(F.element_at(F.split("p_type", " "), 1)), F.lit("pdf_flow"))).alias("wanted"))
    return p.select("p_partkey", F.array_join(J.unsupported(F.col("wanted"), ["json", "md", "html", "pdf_flow", "pdf_positional", "pdf_searchable", "docx"]), ",").alias("unsupported"))


def visual(spark, d):
    e = B.boxes(B.table(spark, d, "embeddings"))
    f = e.select((F.col("vec_id") % 40).alias("doc_id"), (F.col("vec_id") % 3).alias("page"), F.lit("layout").alias("category"), (F.col("vec_id") % 11 / 10.0).alias("confidence"), F.array(F.col("a_x0") / 600, F.col("a_y0") / 800, F.col("a_x1") / 600, F.col("a_y1") / 800).alias("bbox"))
    c = f.select("doc_id").distinct().select("doc_id", F.lit(3).alias("pages"), F.when(F.col("doc_id") % 6 == 0, 2).otherwise(3).alias("pages_checked"))
    return J.visual_review(f, c)


def verified_issues(spark, d):
    """A finding on each page, quoted from or foreign to the text of all its lines in reading order."""
    lines = PL.blocks(spark, d).filter("text IS NOT NULL AND i >= 0").groupBy("doc_id", (F.col("page_index") + 1).alias("page")).agg(F.sort_array(F.collect_list(F.struct("i", "text"))).alias("lines"))
    t = lines.select("doc_id", "page", F.array_join(F.transform("lines", lambda x: x["text"]), " ").alias("text"))
    evidence = t.select("doc_id", "page", "text")
    f = t.select("doc_id", "page", F.when(F.col("doc_id") % 4 == 0, "text_missing").otherwise("spelling").alias("kind"), F.lit("x").alias("detail"), F.when(F.col("doc_id") % 3 == 0, F.lit("zzz")).when(F.col("doc_id") % 3 == 1, F.substring("text", 5, 12)).otherwise(F.lit(" ")).alias("quote"))
    return J.issues(f, evidence).select("doc_id", "page", "kind", "verified")


def markdown(spark, d):
    o = PL.ordered(spark, d)
    return render.markdown(o, L.attach_captions(o)).select("doc_id", F.length("markdown").alias("chars"), F.md5("markdown").alias("md5"))


def html(spark, d):
    return render.html(PL.ordered(spark, d), B.PAGE_WIDTH, B.PAGE_HEIGHT).select("doc_id", F.length("html").alias("chars"), F.md5("html").alias("md5"))


def models(spark, d):
    return render.models(PL.ordered(spark, d), B.PAGE_WIDTH, B.PAGE_HEIGHT).select("doc_id", F.length("json").alias("chars"))


def bundles(spark, d):
    o = PL.ordered(spark, d)
    rows = render.bundle(document__md=render.markdown(o, L.attach_captions(o)), document__html=render.html(o, B.PAGE_WIDTH, B.PAGE_HEIGHT), document__json=render.models(o, B.PAGE_WIDTH, B.PAGE_HEIGHT))
    return render.write_zip(rows).select("doc_id", F.length("zip").alias("bytes"))


def replaced_regions(spark, d):
    from ..operators import refine as R

    b = PL.blocks(spark, d)
    out = R.replace_regions(b, R.unreadable_blocks(b, B.PAGE_WIDTH, B.PAGE_HEIGHT))
    return out.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.count("file").alias("files"), F.count_if(F.col("source_label") == "ocr_image_fallback").alias("fallbacks"))


def escaped_pages(spark, d):
    from ..operators.tables import escape_html

    return B.table(spark, d, "pages").select("page_id", F.md5(escape_html(F.col("html"))).alias("md5"))


def saved_bundles(spark, d):
    """Bundles written as archives into a folder, and read again."""
    from ..sinks import archives
    from ..sources.scratch import folder

    o = kept(PL.ordered(spark, d).drop("noisy"), "ordered")
    rows = render.bundle(document__md=render.markdown(o, L.attach_captions(o)), document__html=render.html(o, B.PAGE_WIDTH, B.PAGE_HEIGHT))
    path = folder(spark, "bundles")
    archives.save(rows, path)
    return archives.load(spark, path).select("doc_id", "name", F.md5("content").alias("md5"))


QUERIES = {
    "f01_admission": admitted,
    "f01_admission_stream": admitted_stream,
    "f03_job_lives": lives,
    "k10_saved_bundles": saved_bundles,
    "f02_job_states": states,
    "f02_job_stream": streamed,
    "f02_quality_gate": gate,
    "f03_expired_jobs": expired,
    "f04_progress": progress,
    "f07_manifest": manifest,
    "f11_verified_issues": verified_issues,
    "f12_visual_review": visual,
    "s10_restored_jobs": restored,
    "a13_batch_status": batches,
    "a15_job_counters": counters,
    "a15_exposition": exposition,
    "p08_replaced_regions": replaced_regions,
    "p11_unsupported_outputs": outputs,
    "k02_markdown": markdown,
    "k03_html": html,
    "k03_escaping": escaped_pages,
    "k09_models": models,
    "k10_bundles": bundles,
}

_STEP = "CASE WHEN e = 'submitted' AND s IN ('new', 'completed', 'failed', 'cancelled') THEN 'queued' WHEN e = 'running' AND s = 'queued' THEN 'running' WHEN e = 'completed' AND s = 'running' THEN 'completed' WHEN e = 'failed' AND s IN ('queued', 'running') THEN 'failed' WHEN e = 'cancelled' AND s = 'queued' THEN 'cancelled' ELSE s END"
B.SQL["steps"] = "steps AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS k FROM jobs WHERE event IS NOT NULL)"
B.SQL["fold"] = f"""fold AS (
  SELECT job_id, 0::BIGINT AS k, 'new' AS s, 0 AS changes, NULL::TIMESTAMP AS finished_at FROM (SELECT DISTINCT job_id FROM steps)
  UNION ALL
  SELECT job_id, k, n AS s, changes + CASE WHEN n <> s THEN 1 ELSE 0 END, CASE WHEN n <> s THEN CASE WHEN n IN ('completed', 'failed', 'cancelled') THEN ts END ELSE finished_at END
  FROM (SELECT f.job_id, x.k, f.s, f.changes, f.finished_at, x.ts, {_STEP.replace(' e ', ' x.event ').replace(' s ', ' f.s ').replace('ELSE s END', 'ELSE f.s END')} AS n FROM fold f JOIN steps x ON x.job_id = f.job_id AND x.k = f.k + 1)
)"""
_FOLD = "WITH RECURSIVE " + ",\n".join(B.SQL[n] for n in ("jobs", "steps", "fold")) + "\n"
_LAST = "SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY k DESC) = 1"
_FILES = "files AS (SELECT l_orderkey AS batch_id, l_linenumber AS n, max(l_quantity) * 8 AS seconds, CASE WHEN max(l_returnflag) = 'R' THEN 'failed' ELSE 'completed' END AS status, CASE WHEN max(l_returnflag) = 'R' AND max(l_partkey) % 2 = 0 THEN 503 ELSE 200 END AS code FROM lineitem GROUP BY ALL)"
_ALL = ("blocks", "all_blocks", "ordered", "links")
_ALT = "coalesce(c.text, '')"
ORACLES = {
    "f02_job_states": _FOLD + f"SELECT job_id, s AS status, changes, finished_at, k::INT AS n_events FROM ({_LAST})",
    "f02_job_stream": _FOLD + f"SELECT job_id, s AS status, changes, finished_at, k::INT AS n_events FROM ({_LAST})",
    "f03_job_lives": _FOLD + f"""SELECT job_id, unnest(CASE WHEN finished_at IS NOT NULL AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(finished_at) > 3600000000 THEN ['state', 'expired'] ELSE ['state'] END) AS kind,
  s AS status, changes, k::INT AS n_events, finished_at FROM ({_LAST})""",
    "f03_expired_jobs": _FOLD + f"SELECT job_id, s AS status FROM ({_LAST}) WHERE finished_at IS NOT NULL AND s <> 'running' AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(finished_at) > 3600000000",
    "s10_restored_jobs": _FOLD + f"SELECT CASE WHEN s IN ('queued', 'running') THEN 'failed' ELSE s END AS status, CASE WHEN s IN ('queued', 'running') THEN 'interrupted by a restart' ELSE '' END AS error, count(*) AS n FROM ({_LAST}) GROUP BY ALL",
    "f04_progress": "SELECT l_orderkey, l_linenumber, CASE WHEN q > 45 THEN 100 ELSE least(90, floor(least(q, 40) * 90 / 40)) END::INT AS progress, least(60, greatest(5, floor(q * 10 / 4)))::INT AS janitor FROM (SELECT *, floor(l_quantity)::INT AS q FROM lineitem)",
    "f07_manifest": f"""WITH {_FILES} SELECT batch_id, n, CASE WHEN row_number() OVER w <= 16 AND coalesce(sum(seconds) OVER before, 0) < 600 AND NOT coalesce(bool_or(code IN (429, 503, 504)) OVER before, false) THEN status ELSE 'not_started' END AS state
FROM files WINDOW w AS (PARTITION BY batch_id ORDER BY n), before AS (PARTITION BY batch_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "a13_batch_status": f"WITH {_FILES} SELECT batch_id, count(*) AS files, count(*) FILTER (status = 'completed') AS completed, CASE WHEN bool_and(status = 'completed') THEN 'completed' WHEN bool_or(status = 'completed') THEN 'partial' ELSE 'failed' END AS status FROM files GROUP BY batch_id",
    "a15_job_counters": sql("SELECT event, count(*) AS n FROM jobs WHERE event IS NOT NULL GROUP BY event", "jobs"),
    "a15_exposition": sql("SELECT string_agg('jobs_' || event || '_total ' || n, chr(10) ORDER BY event) AS text FROM (SELECT event, count(*) AS n FROM jobs WHERE event IS NOT NULL GROUP BY event)", "jobs"),
    "f02_quality_gate": sql(
        r"""SELECT doc_id, CASE WHEN c = 0 AND doc_id % 20 <> 0 OR doc_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN c = 0 AND doc_id % 20 <> 0 THEN 'no text recognized' WHEN doc_id % 7 = 0 THEN 'checks failed' ELSE '' END AS error
FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE sum(length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'))) END AS c FROM all_blocks GROUP BY doc_id)""",
        "blocks",
        "all_blocks",
    ),
    "p11_unsupported_outputs": "SELECT p_partkey, CASE WHEN lower(string_split(p_type, ' ')[1]) IN ('json', 'md', 'html', 'pdf_flow', 'pdf_positional', 'pdf_searchable', 'docx') THEN '' ELSE lower(string_split(p_type, ' ')[1]) END AS unsupported FROM part",
    "k02_markdown": sql(
        rf"""SELECT doc_id, length(md)::INT AS chars, md5(md) AS md5 FROM (
  SELECT doc_id, regexp_replace(string_agg(page, '' ORDER BY page_index), '\s+$', '') || chr(10) AS md FROM (
    SELECT o.doc_id, o.page_index, '<!-- page ' || (o.page_index + 1) || ' -->' || chr(10) || string_agg(
      CASE WHEN o.type = 'figure' THEN '![' || CASE WHEN {_ALT} <> '' THEN c.text ELSE o.block_id END || '](' || o.file || ')' || chr(10) || CASE WHEN {_ALT} <> '' THEN '*' || c.text || '*' || chr(10) ELSE '' END || chr(10)
           WHEN o.type = 'caption' AND u.caption_id IS NOT NULL THEN ''
           WHEN o.type = 'heading' THEN '# ' || coalesce(o.text, '') || chr(10) || chr(10)
           WHEN o.type = 'list_item' THEN '- ' || coalesce(o.text, '') || chr(10)
           WHEN coalesce(o.text, '') <> '' THEN o.text || chr(10) || chr(10) ELSE '' END, '' ORDER BY o.ord) AS page
    FROM ordered o LEFT JOIN links f ON f.doc_id = o.doc_id AND f.page_index = o.page_index AND f.figure_id = o.block_id
    LEFT JOIN ordered c ON c.doc_id = f.doc_id AND c.page_index = f.page_index AND c.block_id = f.caption_id
    LEFT JOIN links u ON u.doc_id = o.doc_id AND u.page_index = o.page_index AND u.caption_id = o.block_id
    GROUP BY o.doc_id, o.page_index) GROUP BY doc_id)""",
        *_ALL,
    ),
    "k03_escaping": """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS md5 FROM pages""",
}
