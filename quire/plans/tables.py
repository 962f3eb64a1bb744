"""Queries on tables: orders, with a row for each item."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..model import bridge as B
from ..model.bridge import sql
from ..operators import tables as T

KEY = ["table_id"]


def cells(spark, d):
    return B.cells(B.table(spark, d, "lineitem"))


def dealt_cells(spark, d):
    """``cells``, dealt by table: what is grouped or joined by table stays where it is."""
    return B.cells(B.dealt_items(spark, d))


def widths(spark, d):
    return T.sizes(cells(spark, d), KEY).withColumn("size", F.round("size", 6)).withColumn("at", F.col("at").cast("int"))


def heights(spark, d):
    return T.sizes(cells(spark, d), KEY, across=False).withColumn("size", F.round("size", 6)).withColumn("at", F.col("at").cast("int"))


def edges(spark, d):
    return T.edges(cells(spark, d), KEY).withColumn("edge", F.round("edge", 6)).withColumn("at", F.col("at").cast("int"))


def doubled(spark, d):
    """Some slots are claimed twice."""
    c = cells(spark, d).withColumn("cell_seq", F.lit(0))
    twice = c.filter("table_id % 7 = 0 AND col = 0").withColumn("cell_seq", F.lit(1)).withColumn("text", F.concat("text", F.lit("x")))
    return c.unionByName(twice)


def placements(spark, d):
    return T.placements(doubled(spark, d), KEY)


def dense_grid(spark, d):
    return T.dense_grid(doubled(spark, d), KEY).withColumn("row", F.col("row").cast("int")).withColumn("col", F.col("col").cast("int"))


def missing(spark, d):
    return T.missing_slots(cells(spark, d).filter("(table_id + row + col) % 5 <> 0"), KEY).withColumn("row", F.col("row").cast("int")).withColumn("col", F.col("col").cast("int"))


def html(spark, d):
    return T.to_html(cells(spark, d), KEY).select("table_id", F.length("html").alias("chars"), F.md5("html").alias("md5"))


def lines(spark, d):
    """Recognised lines in cells: the texts, partly longer, partly between two cells."""
    return lines_of(cells(spark, d))


def lines_of(cells):
    c = cells.withColumn("line_no", F.col("row") * 10 + F.col("col"))
    dx = F.when(F.col("line_no") % 6 == 5, 80.0).otherwise(2.0)
    return c.select("table_id", "line_no", F.when(F.col("row") % 2 == 0, F.concat("text", F.lit(" kg"))).otherwise(F.col("text")).alias("text"), (0.8 + F.col("col") * 0.06).alias("confidence"), (F.col("x0") + dx).alias("x0"), (F.col("y0") + 2).alias("y0"), (F.col("x0") + dx + 60).alias("x1"), (F.col("y1") - 2).alias("y1"))


def assigned(spark, d):
    return T.assign_lines(cells(spark, d), lines(spark, d), KEY)


def reconciled(spark, d):
    dealt = dealt_cells(spark, d)
    c = dealt.withColumn("text", F.when(F.col("table_id") % 3 == 0, "").otherwise(F.col("text")))
    return T.reconcile(c, lines_of(dealt), KEY).select("table_id", "row", "col", "text", "reread")


def snapped(spark, d):
    c = cells(spark, d)
    rows = T.edges(c, KEY, across=False)
    return T.snap_to_grid(c.withColumn("cell_id", F.col("row") * 10 + F.col("col")), T.edges(c, KEY), rows, KEY).select("table_id", "cell_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


def separators(spark, d):
    """Rules at fixed places; between some columns there are two."""
    t = cells(spark, d).select("table_id").distinct()
    rules = t.select("table_id", F.explode(F.array(F.lit(161.0), F.lit(250.5), F.when(F.col("table_id") % 2 == 0, 251.5), F.lit(400.0))).alias("x")).filter("x IS NOT NULL")
    narrow = cells(spark, d).withColumn("x0", 72.0 + 90 * F.col("col")).withColumn("x1", 72.0 + 90 * F.col("col") + 88 * F.col("colspan"))
    return T.separators(narrow, rules, KEY).withColumn("after_col", F.col("after_col").cast("int"))


def grown(spark, d):
    c = cells(spark, d)
    need = c.select("table_id", "row", "col", "rowspan", (F.length("text") * 4.0).alias("needed"))
    return T.grow_rows(need, T.sizes(c, KEY, across=False), KEY).withColumn("size", F.round("size", 6))


def grids(spark, d):
    """Cells, tables, and measured separators, of which each seventh table lacks one; and the rows of which each fifth has one more.

    All are made where the items of an order are, so items are shuffled once and nothing is written.
    """
    c = dealt_cells(spark, d)
    shapes = T.shape(c, KEY).withColumnsRenamed({"rows": "n_rows", "cols": "n_cols"})
    columns = T.edges(c, KEY).filter("NOT (table_id % 7 = 3 AND at = 1)")
    rows = T.edges(c, KEY, across=False)
    item = lambda at, edge: F.struct(at.alias("at"), edge.alias("edge"))
    own = item(F.col("at"), F.col("edge"))
    last = (F.col("table_id") % 5 == 1) & (F.col("at") == F.max("at").over(Window.partitionBy(*KEY)))
    more = rows.select(*KEY, F.when(last, F.array(own, item(F.col("at") + 1, F.col("edge") + 20))).otherwise(F.array(own)).alias("e")).select(*KEY, F.inline("e"))
    return c, shapes, columns, rows, more


def _rounded(boxes):
    return boxes.select(*[F.round(c, 6).alias(c) if c in ("x0", "y0", "x1", "y1") else F.col(c).cast("int").alias(c) if c in ("row", "col") else F.col(c) for c in boxes.columns])


def measured(spark, d):
    c, shapes, columns, _, more = grids(spark, d)
    return _rounded(T.measured_boxes(c, shapes, columns, more, KEY))


def reading(spark, d):
    """Rules stand right of the middles of the columns; each third table has two between a pair."""
    c, shapes, _, rows, _ = grids(spark, d)
    sides = c.groupBy(*KEY).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    x = F.explode(F.array(F.lit(160.0), F.lit(250.0), F.when(F.col("table_id") % 3 == 0, 251.0), F.lit(340.0)))
    return _rounded(T.reading_boxes(c, shapes.join(sides, KEY), sides.select(*KEY, x.alias("x")).filter("x IS NOT NULL"), rows, KEY))


def verified(spark, d):
    c, shapes, columns, _, more = grids(spark, d)
    return _rounded(T.verified_grid(c.withColumn("cell_seq", F.lit(0)), shapes, columns, more, KEY))


QUERIES = {
    "m07_measured_cells": measured,
    "m07_reading_boxes": reading,
    "m07_verified_grids": verified,
    "a06_column_widths": widths,
    "a06_row_heights": heights,
    "a07_column_edges": edges,
    "a08_placements": placements,
    "a09_grown_rows": grown,
    "j03_assigned_lines": assigned,
    "j03_reconciled_cells": reconciled,
    "j08_snapped_cells": snapped,
    "j09_separators": separators,
    "j14_missing_slots": missing,
    "k04_dense_grid": dense_grid,
    "x31_table_html": html,
}


def _sizes(at: str, span: str, lo: str, hi: str) -> str:
    return sql(
        f"""SELECT table_id, "at", round(CASE WHEN measured <= 0 THEN total / n ELSE middle * total / measured END, 6) AS size FROM (
  SELECT *, sum(middle) OVER (PARTITION BY table_id) AS measured FROM (
    SELECT s.table_id, s."at", s.total, s.n, coalesce(m.middle, 0) AS middle
    FROM (SELECT table_id, total, n, unnest(range(n))::INT AS "at" FROM (SELECT table_id, greatest(0.5::DOUBLE, max({hi}) - min({lo})) AS total, max({at} + {span}) AS n FROM cells GROUP BY table_id)) s
    LEFT JOIN (SELECT table_id, "at", median(share) AS middle FROM (SELECT table_id, greatest(0, {hi} - {lo}) / {span} AS share, unnest(range({at}, {at} + {span}))::INT AS "at" FROM cells) GROUP BY ALL) m ON s.table_id = m.table_id AND s."at" = m."at"))""",
        "cells",
    )


_LINES = """lines AS (
  SELECT table_id, row * 10 + col AS line_no, CASE WHEN row % 2 = 0 THEN text || ' kg' ELSE text END AS text, 0.8::DOUBLE + col * 0.06::DOUBLE AS confidence,
         x0 + CASE WHEN (row * 10 + col) % 6 = 5 THEN 80 ELSE 2 END AS x0, y0 + 2 AS y0, x0 + CASE WHEN (row * 10 + col) % 6 = 5 THEN 80 ELSE 2 END + 60 AS x1, y1 - 2 AS y1 FROM cells)"""
B.SQL["lines"] = _LINES
B.SQL["doubled"] = "doubled AS (SELECT *, 0 AS cell_seq FROM cells UNION ALL SELECT * REPLACE (text || 'x' AS text), 1 FROM cells WHERE table_id % 7 = 0 AND col = 0)"
_GRID = "SELECT table_id, row, unnest(range(cols))::INT AS col FROM (SELECT table_id, cols, unnest(range(rows))::INT AS row FROM (SELECT table_id, max(row + rowspan) AS rows, max(col + colspan) AS cols FROM {} GROUP BY table_id))"
_ESCAPE = """replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')"""
ORACLES = {
    "a06_column_widths": _sizes("col", "colspan", "x0", "x1"),
    "a06_row_heights": _sizes("row", "rowspan", "y0", "y1"),
    "a08_placements": sql(
        """SELECT table_id, row, col, rowspan, colspan, string_agg(text, chr(10) ORDER BY cell_seq) AS text FROM doubled GROUP BY table_id, row, col, rowspan, colspan""",
        "cells",
        "doubled",
    ),
    "j03_assigned_lines": sql(
        """SELECT table_id, row, col, string_agg(text, ' ' ORDER BY y0, x0, line_no) AS candidate FROM (
  SELECT l.*, c.row, c.col, count(*) OVER (PARTITION BY l.table_id, l.line_no) AS n FROM lines l JOIN cells c ON l.table_id = c.table_id AND l.confidence >= 0.85 AND (l.x0 + l.x1) / 2 BETWEEN c.x0 AND c.x1 AND (l.y0 + l.y1) / 2 BETWEEN c.y0 AND c.y1
    AND greatest(0, least(l.x1, c.x1) - greatest(l.x0, c.x0)) * greatest(0, least(l.y1, c.y1) - greatest(l.y0, c.y0)) / greatest(0.01, (l.x1 - l.x0) * (l.y1 - l.y0)) >= 0.9)
WHERE n = 1 GROUP BY table_id, row, col""",
        "cells",
        "lines",
    ),
    "j09_separators": sql(
        """SELECT table_id, col AS after_col, min(x) AS x FROM (
  SELECT s.table_id, col, r.x FROM (SELECT table_id, col, max(x1) AS right_, lead(min(x0)) OVER (PARTITION BY table_id ORDER BY col) AS next_left
      FROM (SELECT table_id, col, 72.0::DOUBLE + 90 * col + 88 * colspan AS x1, 72.0::DOUBLE + 90 * col AS x0 FROM cells WHERE colspan = 1) GROUP BY table_id, col) s
  JOIN (SELECT DISTINCT table_id, unnest(CASE WHEN table_id % 2 = 0 THEN [161.0, 250.5, 251.5, 400.0] ELSE [161.0, 250.5, 400.0] END)::DOUBLE AS x FROM cells) r ON r.table_id = s.table_id AND r.x > right_ AND r.x < next_left)
GROUP BY table_id, col HAVING count(*) = 1""",
        "cells",
    ),
    "k04_dense_grid": sql(
        f"SELECT g.*, coalesce(t.text, '') AS text FROM ({_GRID.format('doubled')}) g LEFT JOIN (SELECT table_id, row, col, arg_max(text, cell_seq) AS text FROM doubled GROUP BY ALL) t ON t.table_id = g.table_id AND t.row = g.row AND t.col = g.col", "cells", "doubled"
    ),
    "x31_table_html": sql(
        f"""SELECT table_id, length(html)::INT AS chars, md5(html) AS md5 FROM (
  SELECT table_id, '<table>' || string_agg('<tr>' || tds || '</tr>', '' ORDER BY row) || '</table>' AS html FROM (
    SELECT table_id, row, string_agg('<td rowspan="' || rowspan || '" colspan="' || colspan || '">' || {_ESCAPE} || '</td>', '' ORDER BY col) AS tds FROM cells GROUP BY table_id, row) GROUP BY table_id)""",
        "cells",
    ),
}
B.SQL["kept"] = "kept AS (SELECT * FROM cells WHERE (table_id + row + col) % 5 <> 0)"
ORACLES["j14_missing_slots"] = sql(
    f"""SELECT g.* FROM ({_GRID.format('kept')}) g WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.table_id = g.table_id AND g.row >= k.row AND g.row < k.row + k.rowspan AND g.col >= k.col AND g.col < k.col + k.colspan)""",
    "cells",
    "kept",
)
