"""Joins of boxes by tiles and sweeps over pages, against every pair and every fold; and on pages of very many boxes."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import layout as L
from quire.operators import refine, sweep, tiles

BOX = "doc_id long, page_index int, id int, x0 double, y0 double, x1 double, y1 double"


def boxes(rng, page, n, spread, size):
    x, y = rng.uniform(0, spread, n), rng.uniform(0, spread, n)
    w, h = rng.exponential(size, n), rng.exponential(size, n)
    return [(1, page, i, *map(float, b)) for i, b in enumerate(np.round(np.stack([x, y, x + w, y + h], 1), 1))]


def pages(seed):
    rng = np.random.default_rng(seed)
    odd = [(1, 4, 0, 10.0, 10.0, 10.0, 10.0), (1, 4, 1, 30.0, 5.0, 2.0, 20.0), (1, 4, 2, None, 1.0, 2.0, 3.0), (1, 4, 3, 10.0, 10.0, 50.0, 50.0), (1, 4, 4, -1e12, 0.0, 1e12, 1e12)]
    stack = [(1, 5, i, 0.0, 10.0 * i, 400.0, 10.0 * i + 9) for i in range(300)]
    nested = [(1, 6, i, 1.0 * i, 1.0 * i, 400.0 - i, 400.0 - i) for i in range(60)]
    same = [(1, 7, i, 5.0, 5.0, 6.0, 6.0) for i in range(40)]
    return [*boxes(rng, 1, 400, 800, 15), *boxes(rng, 2, 40, 100, 80), *boxes(rng, 3, 1, 10, 1), *odd, *stack, *nested, *same]


@pytest.mark.parametrize("shared", [True, False])
def test_each_pair_that_meets_is_found_once(spark, shared):
    left, right = pages(1), pages(1 if shared else 2)
    a, b = spark.createDataFrame(left, BOX), spark.createDataFrame(right, BOX)
    grid = tiles.grids(b, L.PAGE)
    first = tiles.with_grid(a, L.PAGE) if shared else a.join(grid, L.PAGE)
    second = tiles.with_grid(b, L.PAGE) if shared else b.join(grid, L.PAGE)
    first, second = (t.select(*L.PAGE, tiles.GRID, F.col("id").alias(f"{n}_id"), G.of().alias(n)) for t, n in ((first, "a"), (second, "b")))
    met = tiles.meet(first, second, L.PAGE, F.col("a"), F.col("b"))
    assert met.columns == [*L.PAGE, "a_id", "a", "b_id", "b"]
    got = sorted((r.page_index, r.a_id, r.b_id) for r in met.collect())
    in_order = lambda r: (r[1], r[2], min(r[3], r[5]), min(r[4], r[6]), max(r[3], r[5]), max(r[4], r[6]))
    whole = lambda rows: [in_order(r) for r in rows if None not in r]
    want = sorted((p, i, j) for p, i, ax, ay, bx, by in whole(left) for q, j, cx, cy, dx, dy in whole(right) if p == q and ax <= dx and cx <= bx and ay <= dy and cy <= by)
    assert got == want and len(got) > 1000


BLOCK = "doc_id long, page_index int, block_id string, type string, text string, ord int, x0 double, y0 double, x1 double, y1 double, confidence double"


def test_large_pages_are_not_squared(spark):
    # 20,000 lines in two columns, figures among them, and blocks over pairs of lines.
    rows = []
    for i in range(20000):
        x, y = 72.0 + 250 * (i % 2), 18.0 * (i // 2)
        kind = "figure" if i % 40 == 6 else "caption" if i % 40 == 8 else "text"
        rows.append((1, 0, f"b{i:06d}", kind, None if kind == "figure" else f"line {i}", i, x, y, x + 100 + i % 120, y + 12, 0.9))
    rows += [(1, 0, f"e{i:06d}", "text", f"line {i} line {i + 2}", 20000 + i, 72.0, 9.0 * i, 400.0, 9.0 * i + 31, 0.9) for i in range(10, 18000, 40)]
    blocks = spark.createDataFrame(rows, BLOCK).cache()
    lines = spark.createDataFrame([(1, 0, i + 1, f"line {i}", 0.9, 72.0 + 250 * (i % 2) + 30 * (i % 3 == 0), 18.0 * (i // 2) + 6 * (i % 5 == 0), 200.0 + 250 * (i % 2), 18.0 * (i // 2) + 6 * (i % 5 == 0) + 12) for i in range(20000)], "doc_id long, page_index int, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double").cache()
    began = time.perf_counter()
    assert L.attach_captions(blocks).count() == 500
    assert L.figure_leaks(blocks).count() == 0
    assert L.contained_duplicates(blocks).count() == 450 and L.echoes(blocks).count() == 300  # others reach too far over the second column
    assert refine.refine_blocks(blocks, lines).count() == len(rows)
    assert L.recover_lines(blocks, lines, 842.0).count() > len(rows)
    wide = blocks.withColumns({"needed": F.lit(20.0), "wide": F.col("x1") - F.col("x0"), "tall": F.lit(15.0)})
    assert L.push_down(wide).count() == L.clear_tops(wide).count() == len(rows)
    assert time.perf_counter() - began < 120
    for made in (L.attach_captions(blocks), L.echoes(blocks), L.figure_leaks(blocks), L.contained_duplicates(blocks)):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        joins = re.findall(r"Join \[([^\]]*)\]", plan)
        assert joins and all(re.sub(r"#\d+L?", "", keys) == "doc_id, page_index, _column, _row" for keys in joins)
    blocks.unpersist()
    lines.unpersist()


def fold_push(rows):
    placed, out = [], {}
    for x in sorted(rows, key=lambda r: (r["y0"], r["x0"], r["ord"], r["block_id"])):
        top = x["y0"]
        if x["solid"]:
            for left, right, a, b in placed:
                if min(x["x1"], right) - max(x["x0"], left) > 2 and top < b + 1 and top + x["needed"] > a:
                    top = b + 1
            placed.append((x["x0"], x["x1"], top, top + x["needed"]))
        out[x["block_id"]] = top
    return out


def fold_clear(rows, gap):
    placed, out = [], {}
    for x in sorted(rows, key=lambda r: (r["y0"], r["x0"], r["ord"], r["block_id"])):
        top, right = x["y0"], x["x0"] + x["wide"]
        beside = [p for p in placed if min(right, p[1]) - max(x["x0"], p[0]) > 0.5 and p[3] > x["y0"]]
        while hit := [p[3] for p in beside if p[2] < top + x["tall"] and p[3] > top]:
            top = max(hit) + gap
        placed.append((x["x0"], right, top, top + x["tall"]))
        out[x["block_id"]] = top
    return out


@pytest.mark.parametrize("seed,tall", [(1, 60.0), (2, 600.0), (3, 6000.0)])
def test_sweeps_equal_folds_over_all_blocks(seed, tall):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(500):
        x, y = np.round(rng.uniform(0, 300), 1), np.round(rng.uniform(0, tall), 1)
        rows.append({"block_id": f"b{i}", "ord": i, "x0": float(x), "y0": float(y), "x1": float(x + rng.choice([1, 40, 300])), "needed": float(rng.choice([0, 3, 12, 40])), "wide": float(rng.choice([0.2, 40, 300])), "tall": float(rng.choice([0, 0.5, 12, 40])), "solid": bool(rng.random() < 0.9)})
    rows.sort(key=lambda r: (r["y0"], r["x0"], r["ord"], r["block_id"]))
    push, clear = sweep.pushing(), sweep.clearing(1.5)()
    assert dict(push(r) for r in rows) == fold_push(rows)
    assert dict(clear(r) for r in rows) == fold_clear(rows, 1.5)


def brute_recovered(blocks, lines, cover=0.6):
    """Lines one by one against all blocks and all lines put in before."""
    put = []
    for no, text, x0, y0, x1, y1 in sorted(lines):
        share = lambda b: max(0.0, min(x1, b[2]) - max(x0, b[0])) * max(0.0, min(y1, b[3]) - max(y0, b[1])) / max(0.01, (x1 - x0) * (y1 - y0))  # noqa: E731, B023
        over = [(share(b[:4]), b[4]) for b in [*blocks, *put] if share(b[:4]) > 0]
        words = [w for _, t in over for w in t.split()]
        covered = len(over) > 1 and sum(s for s, _ in over) >= cover and all(text.split().count(w) <= words.count(w) for w in text.split())
        if any(s >= cover for s, _ in over) or covered:
            continue
        up = [(b[1], b[5]) for b in [*blocks, *put] if b[1] <= y0 and min(b[2], x1) > max(b[0], x0)]
        lowest = max((y for y, _ in up), default=None)
        place = min((p for y, p in up if y == lowest), default=[0])
        put.append((x0, y0, x1, y1, text, [*place, -no]))
    return [x[4] for x in sorted([*blocks, *put], key=lambda b: b[5])]


def test_recovered_lines_equal_one_by_one(spark):
    rng = np.random.default_rng(8)
    all_blocks, all_lines, want = [], [], {}
    for page in range(12):
        n, m = (0, 8) if page == 0 else (int(rng.integers(1, 25)), int(rng.integers(1, 40)))
        box = lambda: (x := float(rng.integers(0, 20) * 10), y := float(rng.integers(0, 30) * 8 + 200), x + float(rng.integers(4, 20) * 10), y + float(rng.integers(8, 20)))  # noqa: E731, B023
        blocks = [(*box(), " ".join(rng.choice(list("abcd"), 3))) for _ in range(n)]
        lines = [(i + 1, " ".join(rng.choice(list("abcd"), 2)), *box()) for i in range(m)]
        all_blocks += [(1, page, f"b{i:03d}", "text", t, i, *b, 0.9) for i, (*b, t) in enumerate(blocks)]
        all_lines += [(1, page, no, t, 0.9, *b) for no, t, *b in lines]
        want[page] = brute_recovered([(*b, t, [i + 1]) for i, (*b, t) in enumerate(blocks)], lines)
    found = L.recover_lines(spark.createDataFrame(all_blocks, BLOCK), spark.createDataFrame(all_lines, "doc_id long, page_index int, line_no int, text string, confidence double, x0 double, y0 double, x1 double, y1 double"), 10000.0)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.page_index, r.ord)):
        got.setdefault(r.page_index, []).append(r.text)
    assert got == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edits_and_first_alike():
    rng = np.random.default_rng(5)
    texts = ["", "a", "ж" * 70] + ["".join(rng.choice(list("abж"), int(rng.integers(1, 80)))) for _ in range(60)]
    for a in texts:
        for b in texts[::3]:
            assert sweep.edits(a, b) == distance(a, b)
    near = [t[:k] + "b" * int(rng.integers(0, 4)) + t[k + int(rng.integers(0, 4)) :] for t in texts for k in (0, len(t) // 2)]
    heads, step = [], sweep.heading(0.85)()
    for t in texts + near:
        want = next((h for h in heads if 1 - distance(t, h) / max(len(t), len(h), 1) >= 0.85), None)
        if want is None:
            heads.append(want := t)
        assert step({"key": t}) == (t, want)
    assert 20 < len(heads) < len(texts + near) - 60


def test_very_many_margins_of_a_document(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    heads = [" ".join(rng.choice(words, 8)) for _ in range(1500)]
    rows = []
    for i in range(100_000):
        t = heads[i % 1500]
        k = int(rng.integers(0, len(t)))
        # Three letters are written in, so nearly all are different.
        rows.append((1, i, f"h{i}", "text", t[:k] + "".join(chr(97 + int(c)) for c in rng.integers(10, 26, 3)) + t[k:], 0, 72.0, 40.0, 300.0, 52.0, 0.9))
    blocks = spark.createDataFrame(rows, BLOCK)
    assert len({r[4] for r in rows}) > 99_000
    began = time.perf_counter()
    found = L.repeated_margins(blocks, 842.0, 595.0, share=0.0005)
    assert found.count() == len(rows) and time.perf_counter() - began < 150
