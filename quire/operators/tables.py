"""Tables: assignment of lines to cells, grids, sizes of columns and rows, missing slots, HTML.

Columns: keys of the table (``KEY``), row, col, rowspan, colspan, text, x0, y0, x1, y1; several cells may claim a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from .align import keeps_words


def shape(cells: DataFrame, key: list[str]) -> DataFrame:
    """rows and cols of each table, from its cells and their spans."""
    return cells.groupBy(*key).agg(F.greatest(F.lit(1), F.max(F.col("row") + F.col("rowspan"))).alias("rows"), F.greatest(F.lit(1), F.max(F.col("col") + F.col("colspan"))).alias("cols"))


def sizes(cells: DataFrame, key: list[str], across: bool = True) -> DataFrame:
    """key, at, size: widths of columns (or heights of rows): the median share of the cells there, scaled to the table.

    A column without a measured cell has width 0, unless none has: then all are equal.
    """
    at, span, lo, hi = ("col", "colspan", "x0", "x1") if across else ("row", "rowspan", "y0", "y1")
    boxes = cells.groupBy(*key).agg(F.greatest(F.lit(0.5), F.max(hi) - F.min(lo)).alias("total"), F.max(F.col(at) + F.col(span)).alias("n"))
    share = F.greatest(F.lit(0.0), F.col(hi) - F.col(lo)) / F.col(span)
    parts = cells.select(*key, share.alias("share"), F.explode(F.sequence(at, F.col(at) + F.col(span) - 1)).alias("at"))
    medians = parts.groupBy(*key, "at").agg(F.median("share").alias("middle"))
    slots = boxes.select(*key, "total", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("at"))
    joined = slots.join(medians, [*key, "at"], "left").withColumn("middle", F.coalesce("middle", F.lit(0.0)))
    measured = F.sum("middle").over(Window.partitionBy(*key))
    return joined.select(*key, "at", F.when(measured <= 0, F.col("total") / F.col("n")).otherwise(F.col("middle") * F.col("total") / F.when(measured > 0, measured)).alias("size"))


def edges(cells: DataFrame, key: list[str], across: bool = True) -> DataFrame:
    """key, at, edge: where complete cells put the separators: the median of all cell sides there, ends at the table's own.

    Tables whose separators don't increase are left out.
    """
    at, span, lo, hi = ("col", "colspan", "x0", "x1") if across else ("row", "rowspan", "y0", "y1")
    end = F.col(at) + F.col(span)
    side = lambda at, side: F.struct(at.alias("at"), F.col(side).alias("side"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), end.alias("end"))
    sides = cells.select(*key, F.inline(F.array(side(F.col(at), lo), side(end, hi)))).filter("at IS NOT NULL")
    # Equal sides are counted, so that few are sorted. Where cells are dealt by table nothing is shuffled.
    counted = sides.groupBy(*key, "at", "side").agg(F.count("side").alias("same"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("end").alias("end"))
    slot = Window.partitionBy(*key, "at")
    ranked = counted.withColumn("upto", F.sum("same").over(slot.orderBy(F.asc_nulls_last("side")).rowsBetween(Window.unboundedPreceding, 0))).withColumn("known", F.sum("same").over(slot))
    # The median is the mean of the two middle sides, which are the same if their number is odd.
    holds = lambda k: F.max(F.when((F.col("upto") >= k) & (F.col("upto") - F.col("same") < k), F.col("side"))) * 0.5
    middle = ranked.groupBy(*key, "at").agg((holds(F.floor((F.col("known") + 1) / 2)) + holds(F.floor(F.col("known") / 2) + 1)).alias("middle"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("end").alias("end"))
    table, order = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("at")
    whole = middle.withColumns({"next": F.lead("at").over(order), "before": F.lag("at").over(order)}).withColumns({"first": F.min("lo").over(table), "last": F.max("hi").over(table), "n": F.max("end").over(table)})
    # Each separator brings those up to the next, which no cell has.
    own, begin = F.col("at"), F.when(F.col("before").isNull(), F.least(F.col("at"), F.lit(0))).otherwise(F.col("at"))
    slots = whole.select(*key, "middle", "first", "last", "n", own.alias("own"), F.explode(F.sequence(begin, F.coalesce(F.col("next") - 1, F.col("at")))).alias("at")).filter("at BETWEEN 0 AND n")
    even = F.col("first") + (F.col("last") - F.col("first")) * F.col("at") / F.col("n")
    edge = F.when(F.col("at") == 0, F.col("first")).when(F.col("at") == F.col("n"), F.col("last")).otherwise(F.coalesce(F.when(F.col("own") == F.col("at"), F.col("middle")), even))
    placed = slots.select(*key, "at", edge.alias("edge"))
    checked = placed.withColumn("bad", F.coalesce(F.lead("edge").over(order) <= F.col("edge"), F.lit(False)))
    return checked.withColumn("any_bad", F.max("bad").over(table)).filter(~F.col("any_bad")).select(*key, "at", "edge")


def placements(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, row, col, rowspan, colspan, text: cells that own their slot; texts of others in a slot join the owner's, once.

    In order of row, column and sequence a cell owns its slots unless its first is taken: a fold over a table's cells.
    """
    seq = F.col("cell_seq") if "cell_seq" in cells.columns else F.lit(0)
    item = F.struct("row", "col", seq.alias("seq"), "rowspan", "colspan", "text")
    lists = cells.groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.array().cast("array<struct<row:int,col:int,rowspan:int,colspan:int,text:string>>")

    def step(done: Column, x: Column) -> Column:
        holds = lambda p: (p["row"] <= x["row"]) & (x["row"] < p["row"] + p["rowspan"]) & (p["col"] <= x["col"]) & (x["col"] < p["col"] + p["colspan"])
        text = X.strip(X.or_empty(x["text"]))
        # The last owner that covers the slot has it.
        owner = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(done), F.lit(1))), F.lit(0), lambda a, i: F.when(F.coalesce(holds(F.get(done, i - 1)), F.lit(False)), i).otherwise(a))
        new = F.struct(x["row"].cast("int").alias("row"), x["col"].cast("int").alias("col"), x["rowspan"].cast("int").alias("rowspan"), x["colspan"].cast("int").alias("colspan"), X.or_empty(x["text"]).alias("text"))
        joined = lambda p: F.when((text == "") | F.array_contains(F.split(p["text"], "\n"), text), p["text"]).when(p["text"] == "", text).otherwise(F.concat(p["text"], F.lit("\n"), text))
        add = lambda p: F.struct(p["row"].alias("row"), p["col"].alias("col"), p["rowspan"].alias("rowspan"), p["colspan"].alias("colspan"), joined(p).alias("text"))
        return F.when(owner == 0, F.array_append(done, new)).otherwise(F.transform(done, lambda p, i: F.when(i + 1 == owner, add(p)).otherwise(p)))

    return lists.select(*key, F.explode(F.aggregate("items", start, step)).alias("p")).select(*key, "p.*")


def missing_slots(cells: DataFrame, key: list[str], most: int = 4096) -> DataFrame:
    """key, row, col of slots that no cell covers, in tables of up to ``most`` slots."""
    slots = shape(cells, key).filter(F.col("rows") * F.col("cols") <= most).select(*key, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols")
    slots = slots.select(*key, "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    return slots.join(covered(cells, key), [*key, "row", "col"], "left_anti")


def covered(cells: DataFrame, key: list[str]) -> DataFrame:
    rows = cells.select(*key, F.explode(F.sequence("row", F.col("row") + F.col("rowspan") - 1)).alias("row"), "col", "colspan")
    return rows.select(*key, "row", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)).alias("col"))


def dense_grid(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, row, col, text of every slot: that of the last cell that starts there, or empty."""
    slots = shape(cells, key).select(*key, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), "cols").select(*key, "row", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"))
    seq = F.col("cell_seq") if "cell_seq" in cells.columns else F.lit(0)
    last = cells.groupBy(*key, "row", "col").agg(F.max_by("text", F.struct(seq, "text")).alias("text"))
    return slots.join(last, [*key, "row", "col"], "left").withColumn("text", X.or_empty(F.col("text")))


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def to_html(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, html: a table element with spans; slots without a cell, and not under a span, are empty cells."""
    own = cells.groupBy(*key, "row", "col").agg(F.max(F.struct("rowspan", "colspan", "text")).alias("c")).select(*key, "row", "col", "c.*")
    holes = missing_slots(cells, key, 1 << 30).select(*key, "row", "col", F.lit("<td></td>").alias("td"))
    td = F.concat(F.lit('<td rowspan="'), F.col("rowspan").cast("string"), F.lit('" colspan="'), F.col("colspan").cast("string"), F.lit('">'), escape_html(X.or_empty(F.col("text"))), F.lit("</td>"))
    all_cells = own.select(*key, "row", "col", td.alias("td")).unionByName(holes)
    rows = all_cells.groupBy(*key, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "td"))), lambda x: x["td"]), "").alias("tds"))
    lines = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("row", "tds"))).alias("lines"))
    return lines.select(*key, F.concat(F.lit("<table>"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<tr>"), x["tds"], F.lit("</tr>"))), ""), F.lit("</table>")).alias("html"))


def assign_lines(cells: DataFrame, lines: DataFrame, key: list[str], sure: float = 0.85, inside: float = 0.9) -> DataFrame:
    """key, row, col, candidate: texts of the lines whose middle lies in just one cell, by place, joined by spaces.

    A line belongs to a cell if that holds its middle and most of its area; a line of several cells belongs to none.
    """
    good = lines.filter((F.col("confidence") >= sure) & (X.strip(X.or_empty(F.col("text"))) != "")).select(*key, "line_no", F.col("text").alias("line"), G.of().alias("l"))
    c, line = F.col("c"), F.col("l")
    x, y = (line["x0"] + line["x1"]) / 2, (line["y0"] + line["y1"]) / 2
    held = good.join(cells.select(*key, "row", "col", G.of().alias("c")), key).filter(x.between(c["x0"], c["x1"]) & y.between(c["y0"], c["y1"]) & (G.intersection(line, c) / G.area(line) >= inside))
    sole = held.withColumn("n", F.count("*").over(Window.partitionBy(*key, "line_no"))).filter("n = 1")
    item = F.struct(line["y0"].alias("y0"), line["x0"].alias("x0"), "line_no", X.strip(F.col("line")).alias("text"))
    return sole.groupBy(*key, "row", "col").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda i: i["text"]), " ").alias("candidate"))


def reconcile(cells: DataFrame, lines: DataFrame, key: list[str]) -> DataFrame:
    """The cells, with the text of their lines where that fills a blank, or extends the cell without losing words."""
    found = assign_lines(cells, lines, key).groupBy(*key).agg(F.collect_list(F.struct("row", "col", "candidate")).alias("_found"))
    # Joined by table, as lines and cells are before: where they are dealt by table nothing is shuffled.
    own = F.get(F.filter("_found", lambda x: (x["row"] == F.col("row")) & (x["col"] == F.col("col"))), F.lit(0))["candidate"]
    joined = cells.join(found, key, "left").withColumn("candidate", own).drop("_found")
    text, candidate = F.col("text"), F.col("candidate")
    old, new = X.squeeze(X.fold(X.or_empty(text))), X.squeeze(X.fold(X.or_empty(candidate)))
    likely = (F.length(new) >= F.length(old)) & X.similar(old, new, 0.7)
    # A text that is the same, or only goes on, keeps its words; the others are aligned.
    on = F.coalesce((candidate == text) | F.startswith(candidate, F.concat(text, F.lit(" "))), F.lit(False))
    marked = joined.withColumns({"_blank": old == "", "_likely": F.coalesce(likely, F.lit(False)) & (X.or_empty(candidate) != ""), "_on": on})
    asks = F.col("_likely") & ~F.col("_blank") & ~F.col("_on")
    safe = F.when(F.col("_likely") & ~F.col("_blank"), F.col("_on") | keeps_words(F.when(asks, text), F.when(asks, candidate))).otherwise(F.col("_blank"))
    taken = (X.or_empty(candidate) != "") & safe
    return marked.withColumn("text", F.when(taken, candidate).otherwise(text)).withColumn("reread", F.coalesce(taken, F.lit(False))).drop("candidate", "_blank", "_likely", "_on")


def snap_to_grid(cells: DataFrame, columns: DataFrame, rows: DataFrame, key: list[str], inside: float = 0.8) -> DataFrame:
    """key, cell_id, row, col: the slot of a measured grid in which the middle of a cell lies, if it holds most of it alone.

    columns and rows: key, at, edge. A slot that several cells claim goes to none.
    """
    spans = lambda e, n: e.withColumn("next", F.lead("edge").over(Window.partitionBy(*key).orderBy("at"))).filter("next IS NOT NULL").select(*key, F.col("at").alias(n), F.col("edge").alias(f"{n}_lo"), F.col("next").alias(f"{n}_hi"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    found = cells.join(spans(columns, "grid_col"), key).filter((x >= F.col("grid_col_lo")) & (x < F.col("grid_col_hi"))).join(spans(rows, "grid_row"), key).filter((y >= F.col("grid_row_lo")) & (y < F.col("grid_row_hi")))
    slot = G.box(F.col("grid_col_lo"), F.col("grid_row_lo"), F.col("grid_col_hi"), F.col("grid_row_hi"))
    good = found.filter(G.intersection(slot, G.of()) / G.area(G.of()) >= inside)
    alone = good.withColumn("n", F.count("*").over(Window.partitionBy(*key, "grid_row", "grid_col"))).filter("n = 1")
    return alone.select(*key, "cell_id", F.col("grid_row").alias("row"), F.col("grid_col").alias("col"))


def separators(cells: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """key, after_col, x: between two neighbouring columns, the one rule (key, x) that lies in the gap; none if several do."""
    sides = cells.filter("colspan = 1").groupBy(*key, "col").agg(F.max("x1").alias("right"), F.min("x0").alias("left"))
    gaps = sides.withColumn("next_left", F.lead("left").over(Window.partitionBy(*key).orderBy("col"))).filter("next_left IS NOT NULL")
    return gaps.join(rules, key).filter((F.col("x") > F.col("right")) & (F.col("x") < F.col("next_left"))).groupBy(*key, F.col("col").alias("after_col")).agg(F.count("*").alias("n"), F.min("x").alias("x")).filter("n = 1").drop("n")


def grow_rows(required: DataFrame, heights: DataFrame, key: list[str]) -> DataFrame:
    """key, at, size: row heights (key, at, size) raised, cell by cell in order, so that each cell's text fits its rows.

    required: key, row, col, rowspan, needed. What a cell lacks is spread evenly over its rows: a fold over a table.
    """
    a = required.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("row", "col", "rowspan", F.col("needed").cast("double").alias("needed")))).alias("cells"))
    b = heights.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "size"))), lambda x: x["size"]).alias("start"))

    def step(h: Column, c: Column) -> Column:
        own = F.aggregate(F.slice(h, c["row"] + 1, c["rowspan"]), F.lit(0.0), lambda s, x: s + x)
        more = F.greatest(F.lit(0.0), c["needed"] - own) / c["rowspan"]
        return F.transform(h, lambda x, i: F.when((i >= c["row"]) & (i < c["row"] + c["rowspan"]), x + more).otherwise(x))

    return a.join(b, key).select(*key, F.posexplode(F.aggregate("cells", F.col("start"), step)).alias("at", "size"))


def _lists(tables: DataFrame, key: list[str], **separators: DataFrame) -> DataFrame:
    """tables with the measured separators (key, at, edge) of each as a sorted list of (at, edge): all joins are by table.

    What is asked of both is written as a difference: an equation of the two would be a key of the join, by which rows are dealt anew.
    """
    for name, rows in separators.items():
        tables = tables.join(rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", F.col("edge").cast("double").alias("edge")))).alias(name)), key)
    return tables


def _index(separators: Column, at: Column) -> Column:
    """Where a separator stands in its list: most lists have all of them, so its number says it; else the list is searched. Null if it isn't there."""
    likely = (at - F.get(separators, F.lit(0))["at"]).cast("int")
    there = F.coalesce(F.get(separators, likely)["at"] == at, F.lit(False))
    return F.when(there, likely).otherwise(F.nullif(F.array_position(F.transform(separators, lambda x: x["at"]), at).cast("int"), F.lit(0)) - 1)


def measured_boxes(cells: DataFrame, tables: DataFrame, columns: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """key, row, col, x0, y0, x1, y1: the boxes that a complete measured grid gives the cells of a table.

    columns and rows: key, at, edge. A table whose grid has another shape, or with a cell beyond it, has none. Where all tables are dealt by
    key, nothing is shuffled.
    """
    return _boxes(cells, _lists(tables, key, xs=columns, ys=rows), key).select(*key, "row", "col", "x0", "y0", "x1", "y1")


def _boxes(cells: DataFrame, tables: DataFrame, key: list[str]) -> DataFrame:
    """``measured_boxes`` of tables with lists of separators (xs, ys), with the middle of each cell's own height."""
    whole = tables.filter("size(xs) - n_cols = 1 AND size(ys) - n_rows = 1").select(*key, "xs", "ys")
    side = lambda e, at: F.get(F.col(e), _index(F.col(e), at))["edge"]
    held = cells.join(whole, key).select(*key, "row", "col", ((F.col("y0") + F.col("y1")) / 2).alias("middle"), side("xs", F.col("col")).alias("x0"), side("ys", F.col("row")).alias("y0"), side("xs", F.col("col") + F.col("colspan")).alias("x1"), side("ys", F.col("row") + F.col("rowspan")).alias("y1"))
    lost = F.max((F.col("x0").isNull() | F.col("y0").isNull() | F.col("x1").isNull() | F.col("y1").isNull()).cast("int")).over(Window.partitionBy(*key))
    return held.withColumn("_lost", lost).filter("_lost = 0").drop("_lost")


def reading_boxes(cells: DataFrame, tables: DataFrame, rules: DataFrame, rows: DataFrame, key: list[str], slack: float = 4.0) -> DataFrame:
    """key, row, col, x0, y0, x1, y1: wider boxes to read cells in, between proven rules.

    tables: key, n_rows, n_cols, x0, x1; rules: key, x of upright rules; rows: key, at, edge of all row separators. Between the middles
    of neighbouring columns there must be just one rule, and each cell's middle must lie in its rows; else a table has none.
    """
    whole = _lists(tables, key, ys=rows).filter("size(ys) - n_rows = 1 AND n_cols >= 2")
    middle = (F.col("x0") + F.col("x1")) / 2
    places = cells.filter("colspan = 1").groupBy(*key, "col").agg(F.min(middle).alias("first"), F.max(middle).alias("last"))
    gaps = places.withColumn("next", F.lead("first").over(Window.partitionBy(*key).orderBy("col"))).withColumn("follows", F.lead("col").over(Window.partitionBy(*key).orderBy("col")) == F.col("col") + 1)
    between = gaps.filter("follows").join(rules, key).filter((F.col("x") > F.col("last")) & (F.col("x") < F.col("next"))).groupBy(*key, "col").agg(F.count("*").alias("n"), F.min("x").alias("x")).filter("n = 1")
    item = lambda at, edge: F.struct(at.cast("int").alias("at"), edge.cast("double").alias("edge"))
    proven = between.groupBy(*key).agg(F.collect_list(item(F.col("col") + 1, F.col("x"))).alias("inner"))
    inner = F.filter("inner", lambda x: x["at"] < F.col("n_cols"))
    ends = F.array(item(F.lit(0), F.col("x0")), item(F.col("n_cols"), F.col("x1")))
    lists = whole.join(proven, key, "left").withColumn("xs", F.sort_array(F.concat(ends, F.coalesce(inner, F.array().cast("array<struct<at:int,edge:double>>")))))
    own = _boxes(cells, lists, key)
    out = F.max((~F.col("middle").between(F.col("y0") - slack, F.col("y1") + slack)).cast("int")).over(Window.partitionBy(*key))
    return own.withColumn("_out", out).filter("_out = 0").select(*key, "row", "col", "x0", "y0", "x1", "y1")


def verified_grid(cells: DataFrame, tables: DataFrame, columns: DataFrame, rows: DataFrame, key: list[str], narrowest: float = 12.0, lowest: float = 8.0, inside: float = 0.8) -> DataFrame:
    """key, row, col, text, x0, y0, x1, y1: all slots of a measured grid, with the texts of a table's cells.

    Only for tables without spans, whose columns the grid confirms, which has no fewer rows than the model, none too small, and in
    which every cell with text lies for the most part in a slot of its own column that no other one claims. Where all tables are dealt by
    key, nothing is shuffled.
    """
    text, table = X.strip(X.or_empty(F.col("text"))), Window.partitionBy(*key)
    least = lambda e: F.array_min(F.zip_with(F.slice(e, 2, F.size(e)), e, lambda b, a: b["edge"] - a["edge"]))
    spans = cells.groupBy(*key).agg(F.max(F.greatest("rowspan", "colspan")).alias("span"))
    fit = _lists(tables.join(spans, key), key, xs=columns, ys=rows).withColumns({"n_x": F.size("xs"), "n_y": F.size("ys"), "w": least("xs"), "h": least("ys")})
    fit = fit.filter(f"n_cols >= 2 AND n_x - n_cols = 1 AND n_y >= 3 AND n_y - 1 >= n_rows AND span = 1 AND w >= {narrowest} AND h >= {lowest} AND (n_y - 1) * n_cols <= 4096").select(*key, "xs", "ys", "n_x", "n_y")
    xs, ys, x, y = F.col("xs"), F.col("ys"), (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    edge = lambda e, i: F.get(e, i)["edge"]
    between = lambda v, e, i: F.coalesce((v >= edge(e, i)) & (v < edge(e, i + 1)), F.lit(False))
    # A row of the grid is most often that of the same number; at most 4096 are searched.
    likely = _index(ys, F.col("row"))
    found = F.filter(F.sequence(F.lit(0), F.col("n_y") - 2), lambda i: between(y, ys, i))
    at = cells.join(fit, key).withColumns({"filled": text != "", "_x": _index(xs, F.col("col")), "_y": F.when(between(y, ys, likely), likely).otherwise(F.get(found, F.lit(0)))})
    slot = G.box(edge(xs, F.col("_x")), edge(ys, F.col("_y")), edge(xs, F.col("_x") + 1), edge(ys, F.col("_y") + 1))
    good = F.col("filled") & between(x, xs, F.col("_x")) & F.col("_y").isNotNull() & (G.intersection(slot, G.of()) / G.area(G.of()) >= inside)
    placed = at.select(*key, "text", "filled", "xs", "ys", (F.col("n_x") - 1).alias("across"), ((F.col("n_x") - 1) * (F.col("n_y") - 1)).alias("n"), F.when(good, F.col("_y") * (F.col("n_x") - 1) + F.col("_x")).alias("slot"))
    order = Window.partitionBy(*key).orderBy(F.asc_nulls_last("slot"))
    marked = placed.withColumns({"next": F.lead("slot").over(order), "k": F.row_number().over(order)})
    wrong = F.col("filled") & (F.col("slot").isNull() | F.coalesce(F.col("slot") == F.col("next"), F.lit(False)))
    sure = marked.withColumn("_wrong", F.max(wrong.cast("int")).over(table)).filter("_wrong = 0 AND (slot IS NOT NULL OR k = 1)")
    # Each placed cell brings the slots up to the next one, the first also those before it.
    begin = F.when(F.col("k") == 1, 0).otherwise(F.col("slot"))
    slots = sure.select(*key, "xs", "ys", "across", "slot", "text", F.explode(F.sequence(begin, F.coalesce("next", "n") - 1)).alias("s"))
    out = slots.select(*key, "xs", "ys", F.when(F.col("s") == F.col("slot"), F.col("text")).otherwise("").alias("text"), F.floor(F.col("s") / F.col("across")).cast("int").alias("_y"), (F.col("s") % F.col("across")).cast("int").alias("_x"))
    return out.select(*key, F.get(ys, F.col("_y"))["at"].alias("row"), F.get(xs, F.col("_x"))["at"].alias("col"), "text", edge(xs, F.col("_x")).alias("x0"), edge(ys, F.col("_y")).alias("y0"), edge(xs, F.col("_x") + 1).alias("x1"), edge(ys, F.col("_y") + 1).alias("y1"))
