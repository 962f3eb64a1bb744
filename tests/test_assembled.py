from pyspark.sql import functions as F

from quire.operators import layout as L
from quire.operators import page

BLOCK = "doc_id long, page_index int, block_id string, type string, text string, ord int, x0 double, y0 double, x1 double, y1 double"


def _blocks(spark):
    rows = [(1, p, f"{p}{i}", "text", t, i, 10.0, y0, 200.0, y1) for p in range(2) for i, (t, y0, y1) in enumerate([("one two", 100.0, 112.0), ("three", 114.0, 126.0), ("one two three", 99.0, 127.0), ("else", 90.0, 140.0), ("", 90.0, 140.0), (None, 200.0, 212.0)])]
    return spark.createDataFrame(rows + [(1, 0, "f", "figure", "one", 9, 0.0, 0.0, 300.0, 300.0)], BLOCK)


def test_wholes_go_with_the_blocks(spark):
    blocks = _blocks(spark)
    found = L.with_wholes(blocks)
    assert sorted(map(str, found.drop("whole").collect())) == sorted(map(str, blocks.collect()))
    gone = L.repeated(found.filter("whole IS NOT NULL").select(*L.PAGE, "whole")).select(*L.PAGE, F.explode("gone").alias("block_id"))
    assert sorted(gone.collect()) == sorted(L.contained_duplicates(blocks).collect()) == [(1, 0, "02"), (1, 1, "12")]


def test_texts_are_written_once_when_pages_are_assembled(spark):
    blocks, written = _blocks(spark), []
    lines = blocks.filter("type <> 'figure'").select(*L.PAGE, F.col("ord").alias("line_no"), "text", F.lit(0.99).alias("confidence"), "x0", F.col("y0") + 1, "x1", "y1").withColumnRenamed("(y0 + 1)", "y0")
    page.assembled(blocks, lines, 842.0, 595.0, step=lambda rows, name: written.append((name, "text" in rows.columns)) or rows)
    # What is left open among the lines, and blocks read anew.
    assert [name for name, text in written if text] == ["open", "read"]
