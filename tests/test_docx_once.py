from pyspark.sql import functions as F

from quire import plans
from quire.plans import exports
from quire.sinks import docx
from quire.sources import docx as docx_source

SMALL = "/root/testdata/sf0.001"


def test_a_docx_file_is_read_once(spark, monkeypatch):
    cell = {"row": 0, "col": 0, "text": "t", "bbox": {"x0": 0, "y0": 0, "x1": 9, "y1": 9}}
    blocks = [{"id": "a", "type": "text", "text": "one", "bbox": {"x0": 5, "y0": 5, "x1": 90, "y1": 20}}, {"id": "b", "type": "table", "table": {"cells": [cell]}, "bbox": {"x0": 5, "y0": 50, "x1": 90, "y1": 80}}]
    good = docx.document({"pages": [{"width_pt": 595.0, "height_pt": 842.0, "blocks": blocks}]})
    files = spark.createDataFrame([(1, good), (2, b"no file"), (3, None)], "doc_id long, content binary")
    found = docx_source.structure(files)
    for what, schema, got in ((docx_source.canvases, docx_source.CANVASES, found.select("doc_id", "n", "sections", "body_tables", "error")), (docx_source.objects, docx_source.OBJECTS, found.select("doc_id", F.inline("objects"))), (docx_source.tables, docx_source.TABLES, found.select("doc_id", F.inline("tables")))):
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r)[: len(got.columns)] for r in docx_source.read(files, what, schema).collect())
    names = []
    monkeypatch.setattr(exports, "kept", lambda rows, name: names.append(rows.columns) or rows)
    plans.QUERIES["k07_docx_files"](spark, SMALL)
    assert len(names) == 1 and "content" not in names[0]
