"""What a row or a page costs: work that a measured limit depends on, held by what it may not use."""

from __future__ import annotations

import re

import pytest

from pyspark.sql import functions

from quire import plans
from quire.functions import text as X
from quire.model import bridge
from quire.operators import align, refine, tables
from quire.sinks import docx, pdf


def test_few_words_are_divided_without_arrays(monkeypatch):
    monkeypatch.setattr(align, "np", None)
    words = [f"w{i}" for i in range(30)]
    assert align.divide(words, [12.0] * 30, [120.0] * 3) == [" ".join(words[i : i + 10]) for i in (0, 10, 20)]
    assert align.divide(["a", "b"], [6.0, 6.0], [10.0] * 3) == ["a", "b", ""]


def test_many_words_are_divided_as_few_are(monkeypatch):
    widths = [6.0 * (1 + i * 7 % 11) for i in range(300)]
    words, targets = [str(i) for i in range(300)], [sum(widths) / 4] * 4
    found = align.divide(words, widths, targets)
    monkeypatch.setattr(align, "FEW", 1 << 20)
    assert align.divide(words, widths, targets) == found


def test_texts_of_hundreds_of_words_are_aligned_at_once(monkeypatch):
    monkeypatch.setattr(align, "_crossing", lambda *a: pytest.fail("parted"))
    a, b = [f"a{i}" for i in range(300)], [f"a{i}" if i % 3 else f"b{i}" for i in range(310)]
    kinds = [kind for kind, _, _ in align.steps(a, b)]
    assert (kinds.count("keep"), kinds.count("change"), kinds.count("add"), kinds.count("drop")) == (200, 100, 10, 0)


SMALL = "/root/testdata/sf0.001"


def _dealt(df) -> list[str]:
    """What the shuffles of a plan deal rows by."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)


@pytest.mark.parametrize("name", ["a01_text_match", "p09_lost_in_export"])
def test_texts_are_shuffled_once_and_words_never(spark, name):
    found = _dealt(plans.QUERIES[name](spark, SMALL))
    assert len(found) == 1 and found[0].startswith("doc_id")


def test_headers_in_place_are_those_of_the_union(spark):
    b = bridge.blocks(bridge.table(spark, SMALL, "documents").limit(40))
    columns = b.columns
    one, other = bridge.with_headers(b), bridge.with_headers_in_place(b)
    assert one.columns == other.columns
    assert sorted(map(str, one.select(columns).collect())) == sorted(map(str, other.select(columns).collect()))


def test_words_lost_are_the_same_from_one_table(spark):
    rows = spark.createDataFrame([(1, 0, "a", "to be or be", "to", "to or x be"), (1, 0, "b", "be it", "it", None), (1, 1, "a", "x", "x", ""), (None, 0, "a", "y", "", ""), (2, 0, None, "z z", "z z", "z")], "doc_id int, page_index int, region string, text string, region_text string, page_text string")
    page = rows.filter("page_text IS NOT NULL").selectExpr("doc_id", "page_index", "page_text AS text")
    general = refine.lost_words(rows, page, rows.selectExpr("doc_id", "page_index", "region", "region_text AS text"))
    expected = [(1, 0, "a", ["be"]), (1, 0, "b", ["be"]), (1, 1, "a", None), (2, 0, None, ["z"])]
    for out in (general, refine.lost_words_of_rows(rows)):
        assert sorted(map(tuple, out.collect()), key=str) == sorted((x for x in expected if x[3]), key=str)


def test_lines_of_cells_are_dealt_by_order_to_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(bridge, "ITEMS", 512)
    sizes = plans.QUERIES["a12_cell_sizes"](spark, SMALL)
    items = bridge.table(spark, SMALL, "lineitem").count()
    plan = sizes._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning\([^)]*, (\d+)\)", plan) == [str(max(4, -(-items // 512)))]
    assert "Union" not in plan


@pytest.mark.parametrize("name", ["m07_measured_cells", "m07_reading_boxes", "m07_verified_grids"])
def test_grids_are_measured_where_the_items_of_an_order_are(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        grid = plans.QUERIES[name](spark, SMALL)
        plan = grid._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # Only items are dealt, and nothing that was written is read.
    assert {x.split("#")[0] for x in _dealt(grid)} == {"l_orderkey"}
    assert "Union" not in plan and "checkpoint" not in plan and set(re.findall(r"(\w+)\.parquet", plan)) == {"lineitem"}


def test_edges_are_medians_of_repeated_sides_and_gaps_are_even(spark):
    # Sides at 1: 10, 10, 12 and 20; none at 2.
    rows = [(1, 0, 1, 0.0, 10.0), (1, 0, 1, 0.0, 10.0), (1, 0, 1, 0.0, 12.0), (1, 1, 2, 20.0, 40.0), (1, 3, 1, 30.0, 40.0), (2, 1, 1, 5.0, 5.0)]
    cells = spark.createDataFrame(rows, "table_id long, col int, colspan int, x0 double, x1 double")
    found = tables.edges(cells, ["table_id"]).orderBy("table_id", "at").collect()
    assert [(r.table_id, r.at, r.edge) for r in found] == [(1, 0, 0.0), (1, 1, 11.0), (1, 2, 20.0), (1, 3, 35.0), (1, 4, 40.0)]


def test_a_row_beyond_the_model_moves_texts_to_the_slots_they_lie_in(spark):
    cells = spark.createDataFrame([(1, r, c, 1, 1, 0, t, 50.0 * c, 20.0 * r + 20, 50.0 * c + 50, 20.0 * r + 40) for r, c, t in ((0, 0, "a"), (0, 1, " "), (1, 1, "d"))], "table_id long, row int, col int, rowspan int, colspan int, cell_seq int, text string, x0 double, y0 double, x1 double, y1 double")
    edges = lambda n, step: spark.createDataFrame([(1, i, step * i) for i in range(n)], "table_id long, at int, edge double")
    shape = tables.shape(cells, ["table_id"]).withColumnsRenamed({"rows": "n_rows", "cols": "n_cols"})
    grid = lambda c: sorted((r.row, r.col, r.text, r.x0, r.y1) for r in tables.verified_grid(c, shape, edges(3, 50.0), edges(4, 20.0), ["table_id"]).collect())
    assert grid(cells) == [(0, 0, "", 0.0, 20.0), (0, 1, "", 50.0, 20.0), (1, 0, "a", 0.0, 40.0), (1, 1, "", 50.0, 40.0), (2, 0, "", 0.0, 60.0), (2, 1, "d", 50.0, 60.0)]
    assert [x[2] for x in grid(cells.withColumn("text", cells.text.substr(1, 0)))] == [""] * 6
    # A second text in a slot leaves the table out.
    assert grid(cells.union(cells.filter("row = 1").selectExpr("table_id", "row", "col", "rowspan", "colspan", "1", "'e'", "x0", "y0", "x1", "y1"))) == []


def test_words_are_measured_once_for_all_sizes(monkeypatch):
    monkeypatch.setattr(pdf, "width", lambda *a: pytest.fail("measured again"))
    assert pdf.fitted("aaa aaa aaa", 40.0, 30.0, 11.0) == (["aaa aaa", "aaa"], 11.0)
    assert pdf.fitted("a" * 30, 10.0, 10.0, 11.0) == (["a" * 30], pdf.LEAST)


def test_files_are_written_a_few_at_a_time(spark, monkeypatch):
    import pyarrow as pa

    models = spark.createDataFrame([], "doc_id long, json string")
    monkeypatch.setattr(type(models), "mapInArrow", lambda self, run, schema: run)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(150)), "json": ['{"pages": []}', None, ""] * 50})
    for write in (pdf.positional_pdf, pdf.flow_pdf, docx.docx):
        made = list(write(models)([batch]))
        assert [b.num_rows for b in made] == [64, 64, 22]
        assert [x.as_py() is None for b in made for x in b.column(1)] == [False, True, True] * 50


def test_a_dictionary_is_held_by_no_task_and_not_by_the_driver(spark, monkeypatch):
    import random

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda *a: pytest.fail("sent to all tasks"))
    rng = random.Random(5)
    draw = lambda n: "".join(rng.choice("ab-./ \\é_") for _ in range(rng.randint(1, n)))
    edits = {draw(4): draw(3) for _ in range(120)}
    texts = [(i, draw(40)) for i in range(400)] + [(400, None), (401, "")]
    found = align.replace_everywhere(spark.createDataFrame(texts, "i int, text string"), spark.createDataFrame(list(edits.items()), "before string, after string"))
    assert dict(map(tuple, found.collect())) == {i: t and align.replace_all(t, edits) for i, t in texts}


def test_the_first_word_is_found_once_and_without_the_others(spark):
    rows = spark.createDataFrame([("Ёж und Igel",), ("  -- x_1, y",), ("...",), (None,), ("",)], "t string")
    assert [tuple(r) for r in rows.select(X.first_word(rows.t), functions.coalesce(functions.get(X.words(rows.t), functions.lit(0)), functions.lit(""))).collect()] == [("еж",) * 2, ("x_1",) * 2, ("",) * 2, ("",) * 2, ("",) * 2]
    plan = plans.QUERIES["x19_valid_corrections"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("regexp_extract(") == 1


@pytest.mark.parametrize("name", ["j04_refined_blocks", "j06_contained_duplicates", "j07_echoes"])
def test_boxes_of_a_page_meet_where_their_document_is(spark, name):
    found = _dealt(plans.QUERIES[name](spark, SMALL))
    assert len(found) == 1 and found[0].startswith("doc_id")


def test_similar_is_what_the_similarity_says(spark):
    words = ["", "a", "abcdefghij", "abcdefghix", "abcdefghxx", "abcdefgxxx", "xbcdefghijk", "äbcdefghij", "abcdefghij" * 5, "abcdefghij" * 4 + "abcdefgxxx"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    a, b = functions.col("a"), functions.col("b")
    for least in (0.5, 0.7, 0.8, 0.9, 0.94):
        assert pairs.filter(X.similar(a, b, least) != (X.similarity(a, b) >= least)).count() == 0


def test_tables_are_drawn_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(bridge, "ITEMS", 512)
    grids = plans.QUERIES["m07_ink_grids"](spark, SMALL)
    # Adaptive plans join small partitions unless their number is asked for.
    assert grids.rdd.getNumPartitions() == max(4, -(-bridge.table(spark, SMALL, "lineitem").count() // 512))


def test_whole_separators_are_not_searched_for_breaks(monkeypatch):
    import numpy as np

    from quire.sources import pixels

    image = np.full((100, 200), 255, np.uint8)
    image[10:12, 10:192] = image[80:82, 10:192] = image[10:82, 10:12] = image[10:82, 190:192] = 0
    columns, rows = pixels.grid(image)
    assert (columns, rows) == ([10.5, 190.5], [10.5, 80.5])
    monkeypatch.setattr(pixels.np, "diff", lambda *a, **k: pytest.fail("searched"))
    assert pixels.unbroken(image, columns, rows)


def test_cells_are_reconciled_where_their_table_is(spark):
    found = _dealt(plans.QUERIES["j03_reconciled_cells"](spark, SMALL))
    assert found and all(x.startswith("l_orderkey") for x in found)


def test_texts_that_go_on_are_reread_as_before(spark):
    rows = [(1, 0, c, 1, 1, t, 10.0 + 100 * c, 0.0, 90.0 + 100 * c, 20.0) for c, t in enumerate(("12 kg", "12", "", "ab cd", "12 kg"))]
    cells = spark.createDataFrame(rows, "table_id int, row int, col int, rowspan int, colspan int, text string, x0 double, y0 double, x1 double, y1 double")
    read = [(1, c, t, 0.9, 12.0 + 100 * c, 2.0, 80.0 + 100 * c, 18.0) for c, t in enumerate(("12 kg a", "12", "new", "ab ce", "12kg x"))]
    lines = spark.createDataFrame(read, "table_id int, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double")
    got = {r.col: (r.text, r.reread) for r in tables.reconcile(cells, lines, ["table_id"]).collect()}
    # The first goes on, the fourth changes a word, the last is too unlike.
    assert [got[c] for c in range(4)] == [("12 kg a", True), ("12", True), ("new", True), ("ab ce", True)]
    assert got[4] == ("12 kg", False)


def test_pages_are_assembled_from_blocks_written_once(spark, monkeypatch):
    from quire.plans import service

    seen = []
    monkeypatch.setattr(service, "kept", lambda rows, name: seen.append((name, rows.columns)) or rows)
    monkeypatch.setattr(service.page, "assembled", lambda blocks, lines, *a, **k: blocks)
    plans.QUERIES["m02_assembled_pages"](spark, SMALL)
    assert [name for name, _ in seen] == ["blocks"] and "noisy" not in seen[0][1]
