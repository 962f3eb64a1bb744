"""Labels, stored models, places of text and checks of exports on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.model import stored
from quire.operators import align, labels, typography
from quire.operators import layout as L
from quire.quality import exports as E


def test_kinds_of_labels(spark):
    rows = [("Title", None), ("picture", "x"), (None, None), ("checkbox", "text"), ("checkbox", "  "), ("document_index", "")]
    got = spark.createDataFrame(rows, "label string, text string").select(labels.kind_of(F.col("label"), F.col("text")).alias("k")).collect()
    assert [r.k for r in got] == ["heading", "figure", "text", "text", None, "text"]


def test_index_text_takes_the_first_cell_of_a_slot(spark):
    rows = [(1, 0, 1, "12", 1, 1, 1), (1, 0, 0, "Part", 1, 1, 0), (1, 1, 0, "Next", 1, 1, 2), (1, 0, 0, "Part", 1, 1, 5), (1, 0, 0, "other", 1, 1, 6)]
    cells = spark.createDataFrame(rows, "t long, row int, col int, text string, rowspan int, colspan int, cell_seq int")
    assert labels.distinct_cells(cells, ["t"]).count() == 4
    assert labels.index_text(cells, ["t"]).first().text == "Part 12\nNext"


def test_words_go_where_their_partners_stand():
    split = align.split_by_readings
    assert split("the quick brown fox jumps", ["The quikc brown", "fox jumps"]) == ["the quick brown", "fox jumps"]
    assert split("one two three", ["one", "two", "three"]) == ["one", "two", "three"]
    assert split("a b c d e f", ["a b c", "x e f"]) == ["a b c", "d e f"]
    assert split("quite other words here", ["nothing alike", "at all"]) is None and split("x", ["", ""]) is None
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice("abcdefgh") * 3 for _ in range(rng.randint(1, 12))]
        cut = rng.randint(0, len(words))
        assert split(" ".join(words), [" ".join(words[:cut]), " ".join(words[cut:])]) == [" ".join(words[:cut]), " ".join(words[cut:])]


def test_clear_tops_equal_repeated_search(spark):
    rng, rows = random.Random(5), []
    for page in range(60):
        rows += [(1, page, f"b{i}", i, float(rng.randint(0, 60)), float(rng.randint(0, 60)), float(rng.randint(1, 40)), float(rng.randint(1, 30))) for i in range(12)]
    got = {(r.page_index, r.block_id): r.top for r in L.clear_tops(spark.createDataFrame(rows, "doc_id long, page_index int, block_id string, ord int, x0 double, y0 double, wide double, tall double")).collect()}
    for page in range(60):
        placed = []
        for _, _, name, _, x0, y0, wide, tall in sorted((r for r in rows if r[1] == page), key=lambda r: (r[5], r[4], r[3])):
            top = y0
            while hit := [b for left, right, t, b in placed if min(x0 + wide, right) - max(x0, left) > 0.5 and min(top + tall, b) - max(top, t) > 0]:
                top = max(hit) + 1.5
            assert got[page, name] == pytest.approx(top)
            placed.append((x0, x0 + wide, top, top + tall))


def box(x0=0.0, y0=0.0, x1=10.0, y1=10.0):
    return {"x0": x0, "y0": y0, "x1": x1, "y1": y1}


def document(**block):
    first = {"id": "a", "type": "text", "bbox": box(), "order": 0, "text": "x"} | block
    page = {"index": 0, "width_pt": 100.0, "height_pt": 100.0, "rotation": 0, "raster_dpi": 72, "size_px": [100, 100], "status": "ok", "text_layer": "valid", "blocks": [first], "warnings": []}
    return {"schema_version": "1.0", "source": {"file": "f.pdf", "sha256": "0", "type": "pdf"}, "engine": {"name": "e", "version": "1", "models": []}, "pages": [page], "warnings": [], "timings": {}}


CELL = {"row": 0, "col": 0, "text": "", "bbox": box()}
FIGURE = {"file": "a.png", "format": "png", "width_px": 1, "height_px": 1}


@pytest.mark.parametrize(
    "text, problems",
    [
        (json.dumps(document()), []),
        (json.dumps(document(type="figure", text=None, figure=FIGURE)), []),
        (json.dumps(document(type="table", text=None, table={"cells": [CELL], "n_rows": 1, "n_cols": 1})), []),
        (json.dumps(document(bbox=box(x1=200.0))), ["box beyond the page"]),
        (json.dumps(document(bbox=box(x0=20.0))), ["box"]),
        (json.dumps(document(type="figure", text=None)), ["figure"]),
        (json.dumps(document(type="figure", figure=FIGURE)), ["figure"]),
        (json.dumps(document(type="figure", text=None, figure=FIGURE | {"width_px": 0})), ["figure"]),
        (json.dumps(document(type="table")), ["table"]),
        (json.dumps(document(type="table", table={"cells": [CELL | {"colspan": 0}]})), ["table"]),
        (json.dumps(document(type="poem")), ["block"]),
        (json.dumps(document(level=0)), ["block"]),
        (json.dumps(document(confidence=-0.1)), ["block"]),
        (json.dumps(document(lines=[{"text": "x", "bbox": box(), "color": "red"}])), ["line"]),
        (json.dumps(document(rank=1)), ["unknown fields"]),
        (json.dumps(document() | {"extra": 1}), ["unknown fields"]),
        (json.dumps(document() | {"source": {"file": "f", "sha256": "0", "type": "tape"}}), ["source"]),
        ("{", ["no model"]),
        ("[]", ["no model"]),
    ],
)
def test_rules_of_the_model(spark, text, problems):
    rows = spark.createDataFrame([(1, text)], "doc_id long, json string")
    assert sorted(r.problem for r in stored.problems(rows).collect()) == problems
    assert stored.validity(rows).first().status == ("FAIL" if problems else "PASS")


def test_steady_sizes_fit_low_and_narrow_boxes(spark):
    rows = [("text", "x" * 10, 0.0, 0.0, 500.0, 20.0, 0), ("text", "x" * 10, 0.0, 0.0, 500.0, 5.0, 0), ("text", "x" * 10, 0.0, 0.0, 40.0, 20.0, 0), ("text", "x" * 10, 0.0, 0.0, 20.0, 500.0, 90), ("header", "x", 0.0, 0.0, 500.0, 20.0, 0)]
    got = typography.steady(spark.createDataFrame(rows, "role string, text string, x0 double, y0 double, x1 double, y1 double, rotation int")).collect()
    assert [round(r.size_pt, 3) for r in got] == [11.0, 6.75, round(40 / 5.4, 3), 11.0, 9.5] and got[4].bold


def test_leaders_fill_the_room(spark):
    line = spark.createDataFrame([("1. Title 7",), ("no entry",)], "t string").select(typography.leaders(F.col("t"), F.lit(200.0), F.lit(10.0)).alias("t")).collect()
    assert line[0].t.startswith("1. Title ..") and line[0].t.endswith(".7") and line[1].t == "no entry"


def test_a_damaged_pdf_has_one_check(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    files = spark.createDataFrame([(1, "bad xref")], "doc_id long, error string")
    pages = spark.createDataFrame([], "doc_id long, page_index int, text string, hidden boolean")
    words = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    got = E.pdf_checks(docs, files, pages, docs.withColumn("page_index", F.lit(0)), words, docs.limit(0)).collect()
    assert sorted((r.doc_id, r.check, r.status, r.detail) for r in got) == [(1, "searchable_pdf", "FAIL", "not readable: bad xref"), (2, "searchable_pdf", "FAIL", "no file")]
