"""The command line, errors, environment, review clients, the service."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quire import doctor, errors, sinks
from quire.__main__ import main
from quire.operators import service as V
from quire.sinks import pdf
from quire.sources import config, engines, review
from quire.streaming.service import Service
from tests.test_files import MODEL


def test_doctor():
    report = doctor.examine(config.load(environment={}))
    assert report["ok"] and {c["check"] for c in report["checks"]} >= {"python", "java", "folder", "limits", "package pyspark"}
    assert not doctor.examine({"limits": {"max_pages": 0}})["ok"] and not doctor.examine({}, "/proc/none/x")["ok"]


def test_parse_and_verify(spark, tmp_path, capsys):
    (tmp_path / "in.pdf").write_bytes(pdf.flow(MODEL))
    assert main(["parse", str(tmp_path / "in.pdf"), "--out", str(tmp_path / "docs" / "one")]) == 0
    capsys.readouterr()
    assert main(["verify", str(tmp_path / "docs")]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["result"] == "PASS" and {c["check"] for c in report["checks"]} >= {"ir_valid", "bbox", "artifacts", "tables"}
    (tmp_path / "docs" / "one" / "document.md").unlink()
    assert main(["verify", str(tmp_path / "docs")]) == 1
    (tmp_path / "docs" / "one" / "document.json").write_text("{}")
    assert main(["verify", str(tmp_path / "docs")]) == 1
    (tmp_path / "bad.pdf").write_bytes(b"nothing")
    assert main(["parse", str(tmp_path / "bad.pdf"), "--out", str(tmp_path / "x")]) == 2


def test_lists_and_unknown_queries(capsys):
    assert main(["models"]) == 0 and main(["queries"]) == 0 and "w01_reading_order" in capsys.readouterr().out
    assert main(["run", "nothing", "a", "b"]) == 2


def test_only_texts_for_the_reader_are_shown(spark):
    assert errors.shown(errors.QualityError("too little text")) == "too little text" and errors.shown(ValueError("/secret/path")) == errors.MASKED
    rows = spark.createDataFrame([("QualityError", "a"), ("InputError", "b"), (None, "c")], "k string, t string")
    assert [r.x for r in rows.select(errors.shown_error(F.col("k"), F.col("t")).alias("x")).collect()] == ["a", errors.MASKED, None]


def test_sinks_by_name():
    assert sinks.sink("pdf_searchable")[1] is sinks.sink("pdf_positional")[1]
    with pytest.raises(errors.InputError):
        sinks.sink("tape")


def test_review_limits():
    client = review.Bounded(review.Prepared({"u": {"issues": [1]}}), calls=2)
    assert client.request("x", {"unit_id": "u"}) == {"issues": [1]} and client.request("x", {"unit_id": "v"}) == {"issues": []}
    with pytest.raises(TimeoutError):
        client.request("x", {})
    now = [0.0]
    late = review.Bounded(review.Prepared({}), seconds=5, clock=lambda: now[0])
    now[0] = 6.0
    with pytest.raises(TimeoutError):
        late.request("x", {})
    with pytest.raises(errors.InputError):
        review.Bounded(review.Prepared({})).request("x", {}, ["data:image/png;base64,"] * 3)
    with pytest.raises(errors.InputError):
        review.Bounded(review.Prepared({})).request("x", {}, ["https://example.org/a.png"])

    class Broken:
        def request(self, *_):
            raise ValueError("the document says so")

    with pytest.raises(errors.ModelError) as e:
        review.Bounded(Broken()).request("x", {})
    assert "document" not in str(e.value)
    with pytest.raises(errors.ModelError):
        review.Bounded(review.Prepared({"u": {"issues": "x" * 3_000_000}})).request("x", {"unit_id": "u"})


@pytest.mark.parametrize(
    "raw, code, outputs",
    [(None, 200, ["md", "html", "json"]), ("", 200, ["md", "html", "json"]), ('{"outputs": ["docx"]}', 200, ["pdf_positional"]), ('{"outputs": ["docx", "md"]}', 200, ["md"]), ('{"outputs": []}', 400, None), ('{"outputs": "md"}', 400, None), ('{"outputs": ["tape"]}', 400, None), ('{"engine": "other"}', 400, None), ("[1]", 400, None), ("{", 400, None)],
)
def test_options(spark, raw, code, outputs):
    r = spark.createDataFrame([(raw,)], "o string").select(V.options(F.col("o")).alias("x")).first().x
    assert (r.code, r.outputs) == (code, outputs)


def test_retries(spark):
    rows = [([], 1, 1.0, False), (["memory"], 2, 1.0, False), (["memory", "memory"], 3, 0.7, False), (["memory"] * 3, 3, 0.7, True), (["input"], 1, 1.0, True), (["memory", "input"], 2, 1.0, True)]
    got = spark.createDataFrame([(r[0],) for r in rows], "f array<string>").select(V.retries(F.col("f")).alias("x")).collect()
    assert [(r.x.attempts, r.x.scale, r.x.failed) for r in got] == [r[1:] for r in rows]


class Blank:
    def analyze(self, page):
        return [("x", 1.0, (0.0, 0.0, 1.0, 1.0))]

    def reset(self):
        pass


def test_progress_is_reported(spark):
    pages = spark.createDataFrame([(i, 0, b"", 1.0, 1.0, 72) for i in range(10)], "doc_id long, page_index int, image binary, width_pt double, height_pt double, dpi int")
    seen = []
    with engines.progress(spark, 10, lambda done, total: seen.append((done, total)), 0.01) as counter:
        assert engines.recognize(pages, Blank, counter=counter).count() == 10
    assert seen[-1] == (10, 10) and seen == sorted(seen)


def test_service(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(1, "submitted"), (2, "submitted"), (1, "running"), (1, "completed"), (3, "submitted"), (3, "running")]
    spark.createDataFrame([(j, start + timedelta(minutes=i), i, e) for i, (j, e) in enumerate(rows)], "job_id long, ts timestamp, event_id long, event string").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("job_id long, ts timestamp, event_id long, event string").parquet(str(tmp_path / "e"))
    before = spark.createDataFrame([(9, "running", None), (1, "queued", None)], "job_id long, status string, finished_at timestamp")
    made = []
    service = Service(spark, stream, engine=lambda: made.append(1) or object()).start(before)
    ended = {r.job_id: r.status for r in service.stop().collect()}
    assert ended == {1: "completed", 2: "cancelled", 3: "running", 9: "failed"}
    assert [r.job_id for r in service.expired(F.lit(start + timedelta(hours=3))).collect()] == [1]
    assert service.engine() is service.engine() and made == [1]
