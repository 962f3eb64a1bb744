"""Layout of pages: reading order, captions, repeated and overlapping text, unassigned lines.

All work within a page or document, so the joins have its key and the page is what is dealt to tasks. Where one decision changes
the next, that part alone is a fold over the rows that are still open; the rest are joins and windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..sources.scratch import kept
from . import sweep
from .tiles import GRID, grids, meet, met, met_in_place, with_grid

PAGE = ["doc_id", "page_index"]


def reading_order(blocks: DataFrame, gap: float = 18.0) -> DataFrame:
    """Adds page_column and ord: columns from left to right, each from top to bottom.

    In order of the left edge, a block that starts more than ``gap`` right of all before it opens a new column.
    """
    by_left = Window.partitionBy(*PAGE).orderBy("x0", "y0", "block_id")
    opens = F.coalesce(F.col("x0") > F.max("x1").over(by_left.rowsBetween(Window.unboundedPreceding, -1)) + gap, F.lit(False))
    marked = blocks.withColumn("_opens", opens.cast("int"))
    columns = marked.withColumn("page_column", F.sum("_opens").over(by_left.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_opens")
    down = Window.partitionBy(*PAGE).orderBy("page_column", "y0", "x0", "block_id")
    return columns.withColumn("ord", F.row_number().over(down) - 1)


def renumber(blocks: DataFrame, order: str = "ord") -> DataFrame:
    """Closes gaps in the order of each page."""
    return blocks.withColumn(order, F.row_number().over(Window.partitionBy(*PAGE).orderBy(order, "block_id")) - 1)


def attach_captions(blocks: DataFrame, most: float = 48.0) -> DataFrame:
    """doc_id, page_index, figure_id, caption_id: each caption goes to the nearest figure in its column, above or below.

    Of several captions of a figure the last on the page stays.
    """
    both = with_grid(blocks.filter("type IN ('figure', 'caption')"), PAGE)
    figures = both.filter("type = 'figure'").select(*PAGE, GRID, F.col("block_id").alias("figure_id"), F.col("ord").alias("figure_ord"), G.of().alias("f"))
    captions = both.filter("type = 'caption'").select(*PAGE, GRID, F.col("block_id").alias("caption_id"), F.col("ord").alias("caption_ord"), G.of().alias("c"))
    # Left edges at most a width apart: both boxes reach as far to the left as to the right.
    near = lambda b, up: G.box(b["x0"] - F.abs(G.width(b)), F.least(b["y0"], b["y1"]) - up, F.greatest(b["x0"], b["x1"]), F.greatest(b["y0"], b["y1"]) + up)
    pairs = meet(captions, figures, PAGE, near(F.col("c"), most), near(F.col("f"), 0.0)).filter(F.abs(F.col("c.x0") - F.col("f.x0")) <= F.greatest(G.width(F.col("c")), G.width(F.col("f"))))
    gap = F.when(F.col("c.y1") <= F.col("f.y0"), F.col("f.y0") - F.col("c.y1")).otherwise(F.col("c.y0") - F.col("f.y1"))
    near = pairs.withColumn("gap", gap).filter(F.col("gap").between(0, most))
    best = near.groupBy(*PAGE, "caption_id", "caption_ord").agg(F.min(F.struct("gap", "figure_ord", "figure_id")).alias("best"))
    return best.groupBy(*PAGE, F.col("best.figure_id").alias("figure_id")).agg(F.max_by("caption_id", F.struct("caption_ord", "caption_id")).alias("caption_id"))


def figure_leaks(blocks: DataFrame, slack: float = 2.0, pictograms: bool = False) -> DataFrame:
    """doc_id, page_index, block_id, figure_id: text within a figure, with the first figure that holds it.

    A single cross-shaped glyph in a small figure may belong to the figure: such pairs are the pictograms.
    """
    both = with_grid(blocks, PAGE)
    text, figures = both.filter("type NOT IN ('figure', 'caption', 'table')").filter(X.strip(X.or_empty(F.col("text"))) != ""), both.filter("type = 'figure'")
    label = F.coalesce(F.col("source_label"), F.lit("")) if "source_label" in blocks.columns else F.lit("")
    left = text.select(*PAGE, GRID, "block_id", "text", G.of().alias("a"))
    right = figures.select(*PAGE, GRID, F.col("block_id").alias("figure_id"), F.col("ord").alias("figure_ord"), label.alias("label"), G.of().alias("b"))
    a, b = F.col("a"), F.col("b")
    small = lambda x, most: (x > 0) & (x <= most)
    ambiguous = X.strip(F.col("text")).isin("X", "x", "Х", "х", "×", "+") & small(G.width(a), 12) & small(G.height(a), 12) & small(G.width(b), 24) & small(G.height(b), 36) & ~F.col("label").isin("ocr_image_fallback", "graphic_field")
    inside = meet(left, right, PAGE, a, G.grow(b, slack)).filter(G.contains(b, a, slack)).filter(ambiguous == F.lit(pictograms))
    return inside.groupBy(*PAGE, "block_id").agg(F.min_by("figure_id", F.struct("figure_ord", "figure_id")).alias("figure_id"))


def dangling_captions(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links to captions that their page doesn't have."""
    return links.join(blocks.select(*PAGE, F.col("block_id").alias("caption_id")), [*PAGE, "caption_id"], "left_anti")


def echoes(blocks: DataFrame, overlap: float = 0.55, least: float = 0.94, dealt: bool = False) -> DataFrame:
    """doc_id, page_index, block_id of blocks that repeat, as a whole, two or more blocks that they overlap.

    ``dealt``: blocks are dealt by document, and stay so.
    """
    keyed = blocks.filter("type <> 'figure'").select(*PAGE, "block_id", "ord", X.word_key(F.col("text")).alias("key"), G.of().alias("box")).filter("key <> ''")
    box = F.col("box")
    item = F.struct(box["y0"].alias("y0"), box["x0"].alias("x0"), "ord", "key", box.alias("part"), F.col("block_id").alias("part_id"))
    asked = lambda p: (F.col("block_id") != p["part_id"]) & (F.length(p["key"]) <= F.length("key")) & (G.intersection(box, p["part"]) / F.least(G.area(box), G.area(p["part"])) >= overlap)
    grouped = (met_in_place if dealt else met)(keyed, PAGE, ["block_id"], box, box, item, asked, "parts").filter("size(parts) >= 2").withColumn("parts", F.sort_array("parts"))
    side = lambda of: F.transform("parts", of)
    grouped = grouped.withColumn("drop", F.array_max(side(lambda p: p["y0"])) - F.array_min(side(lambda p: p["y0"]))).withColumn("tallest", F.array_max(side(lambda p: G.height(p["part"]))))
    across = F.sort_array(F.transform("parts", lambda p: F.struct(p["x0"].alias("x0"), p["y0"].alias("y0"), p["ord"].alias("ord"), p["key"].alias("key"))))
    keys = lambda x: F.array_join(F.transform(x, lambda p: p["key"]), "")
    joined = F.when(F.col("drop") <= 1.5 * F.col("tallest"), keys(across)).otherwise(keys(F.col("parts")))
    found = grouped.withColumn("joined", joined).filter((F.length("joined") / F.length("key")).between(0.9, 1.1))
    return found.filter(X.similar(F.col("key"), F.col("joined"), least)).select(*PAGE, "block_id")


def contained_duplicates(blocks: DataFrame, slack: float = 3.0, dealt: bool = False) -> DataFrame:
    """doc_id, page_index, block_id of blocks whose text is that of the two or more blocks they contain.

    A join finds what each block contains. What is gone no longer counts as a part of a shorter block, so the few blocks
    that contain others are folded from the longest on. ``dealt``: blocks are dealt by document, and stay so.
    """
    keyed = blocks.filter("type <> 'figure' AND coalesce(text, '') <> ''").select(*PAGE, "block_id", "ord", X.ink_key(F.col("text")).alias("key"), G.of().alias("box"))
    box = F.col("box")
    part = F.struct(box["y0"].alias("y0"), box["x0"].alias("x0"), "ord", F.col("block_id").alias("id"), "key", box.alias("box"))
    asked = lambda p: (F.col("block_id") != p["id"]) & G.contains(box, p["box"], slack)
    whole = (met_in_place if dealt else met)(keyed, PAGE, ["block_id"], G.grow(box, slack), box, part, asked, "parts").filter("size(parts) > 1").withColumn("parts", F.sort_array("parts"))
    return repeated(whole.select(*PAGE, _whole().alias("whole"))).select(*PAGE, F.explode("gone").alias("block_id"))


def _whole() -> Column:
    return F.struct((-F.length("key")).alias("size"), "ord", "block_id", "key", "parts")


def with_wholes(blocks: DataFrame, slack: float = 3.0) -> DataFrame:
    """The blocks, with what ``repeated`` needs of those that contain two or more others (whole, null for the rest). They are dealt by page once, or stay where they are if they are dealt so."""
    asked = (F.col("type") != "figure") & (X.or_empty(F.col("text")) != "")
    others = [c for c in blocks.columns if c not in (*PAGE, "block_id")]
    keyed = blocks.select(*PAGE, "block_id", "ord", F.when(asked, X.ink_key(F.col("text"))).alias("key"), F.when(asked, G.of()).alias("box"), F.struct(*others).alias("_block"))
    box = F.col("box")
    part = F.struct(box["y0"].alias("y0"), box["x0"].alias("x0"), "ord", F.col("block_id").alias("id"), "key", box.alias("box"))
    held = lambda p: (F.col("block_id") != p["id"]) & G.contains(box, p["box"], slack)
    found = met_in_place(keyed, PAGE, ["block_id"], F.when(box.isNotNull(), G.grow(box, slack)), box, part, held, "parts").withColumn("parts", F.sort_array("parts"))
    named = {c: F.col(f"_block.{c}").alias(c) for c in others} | {"block_id": F.col("block_id")}
    return found.select(*PAGE, *[named[c] for c in blocks.columns if c not in PAGE], F.when(F.size("parts") > 1, _whole()).alias("whole"))


def repeated(wholes: DataFrame) -> DataFrame:
    """doc_id, page_index, gone: of blocks that contain others (whole), those whose text is that of their parts."""
    pages = wholes.groupBy(*PAGE).agg(F.sort_array(F.collect_list("whole")).alias("items"))

    def step(gone: Column, x: Column) -> Column:
        left = F.filter(x["parts"], lambda y: ~F.array_contains(gone, y["id"]))
        same = (F.size(left) > 1) & (F.array_join(F.transform(left, lambda y: y["key"]), "") == x["key"])
        return F.when(same, F.array_append(gone, x["block_id"])).otherwise(gone)

    return pages.select(*PAGE, F.aggregate("items", F.array().cast("array<string>"), step).alias("gone"))


def repeated_margins(blocks: DataFrame, page_height: float, page_width: float, least: float = 0.85, share: float = 0.1) -> DataFrame:
    """doc_id, page_index, block_id, new_type: text at the margins that recurs, nearly alike, on enough pages of its document.

    A text joins the first group in its region that it resembles. Groups are formed in page order, in a sweep over the different
    texts of a document and region that holds the first text of each group; equal texts, the usual case, are one from the start.
    """
    width, height = F.lit(page_width), F.lit(page_height)
    marked = blocks.withColumn("region", G.margin_region(G.of(), width, height)).filter(F.col("type").isin("text", "other") & F.length("text").between(5, 300) & F.col("region").isNotNull())
    keyed = marked.select("doc_id", "page_index", "block_id", "ord", "region", X.margin_key(F.col("text")).alias("key")).filter(F.length("key") >= 5)
    region = ["doc_id", "region"]
    different = keyed.groupBy(*region, "key").agg(F.min(F.struct("page_index", "ord", "block_id")).alias("first"))
    ordered = different.select(*region, "key", "first.page_index", "first.ord", "first.block_id")
    grouped = sweep.over_groups(ordered, region, ["page_index", "ord", "block_id", "key"], sweep.heading(least), "key string, head string")
    assigned = keyed.join(grouped, [*region, "key"])
    support = assigned.groupBy(*region, "head").agg(F.countDistinct("page_index").alias("support"))
    pages = blocks.groupBy("doc_id").agg(F.countDistinct("page_index").alias("pages"))
    chosen = assigned.join(support, [*region, "head"]).join(pages, "doc_id").filter(F.col("support") >= F.greatest(F.lit(3), F.ceil(F.col("pages") * share)))
    return chosen.select("doc_id", "page_index", "block_id", F.when(F.col("region") == "header", "header").otherwise("footer").alias("new_type"))


def postprocess(blocks: DataFrame, page_furniture: str = "drop") -> DataFrame:
    """Cleans texts; drops headers, footers and page numbers unless they are kept."""
    cleaned = blocks.withColumn("text", F.when(F.col("type") != "figure", X.clean(F.col("text"))).otherwise(F.col("text")))
    return cleaned.filter(~F.col("type").isin("header", "footer", "page_number")) if page_furniture == "drop" else cleaned


def run_groups(rows: DataFrame, by: list[str], value: str, gap: float, into: str = "run") -> DataFrame:
    """Numbers runs of values of which each is at most ``gap`` above the one before."""
    order = Window.partitionBy(*by).orderBy(value)
    opens = F.coalesce(F.col(value) - F.lag(value).over(order) > gap, F.lit(True)).cast("int")
    return rows.withColumn("_opens", opens).withColumn(into, (F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).drop("_opens")


def recover_lines(blocks: DataFrame, lines: DataFrame, page_height: float, sure: float = 0.75, cover: float = 0.6, step: Callable[[DataFrame, str], DataFrame] = kept, boxes: bool = False) -> DataFrame:
    """doc_id, page_index, block_id, type, text, ord, and with ``boxes`` x0, y0, x1, y1: the blocks, and the recognised lines that no block covers.

    Joins and sums tell how much of a line its page's blocks cover, which of its words they lack, and which earlier lines it overlaps; a
    sweep, which block it follows. A line put in counts as a block for those after it: only that is decided line by line, for the lines that
    blocks leave open. A line put in follows what stands lowest above it in its column, before what was put there earlier,
    so its place is the place of that one, followed by its own number counted downwards. Both tables are read several times, and so are
    the lines left open: ``step`` writes these, see sources.scratch.
    """
    line = [*PAGE, "line_no"]
    seen = lines.filter((F.col("confidence") >= sure) & (X.strip(X.or_empty(F.col("text"))) != "")).select(*PAGE, F.col("line_no").cast("int").alias("line_no"), "text", G.of().alias("l"))
    order = Window.partitionBy(*PAGE).orderBy("ord", "block_id")
    placed = blocks.select(*PAGE, "block_id", "type", "text", F.row_number().over(order).alias("place"), G.of().alias("b"))
    l, b = F.col("l"), F.col("b")
    size = F.greatest(F.lit(0.01), (l["x1"] - l["x0"]) * (l["y1"] - l["y0"]))
    grid = grids(seen.select(*PAGE, "l.*").unionByName(placed.select(*PAGE, "b.*")), PAGE)
    # Texts are fetched for the lines that stay open; pairs are of boxes.
    near = seen.select(*line, "l").join(grid, PAGE)
    met = meet(near, placed.select(*PAGE, "place", "b").join(grid, PAGE), PAGE, l, b).withColumn("share", G.intersection(l, b) / size).filter("share > 0").select(*line, "place", "share")
    facts = met.groupBy(*line).agg(F.max("share").alias("most"), F.sum("share").alias("total"), F.count("*").alias("n"))
    left = step(near.join(facts, line, "left").filter(F.coalesce("most", F.lit(0.0)) < cover).drop("most", "l"), "left")
    open_ = step(seen.join(left, line), "open")
    counted = lambda t, words, n: t.select(*line, F.explode(X.folded_words(F.col(words))).alias("word")).groupBy(*line, "word").agg(F.count("*").alias(n))
    lacking = counted(open_, "text", "wanted").join(counted(met.join(open_.select(*line), line, "left_semi").join(placed.select(*PAGE, "place", F.col("text").alias("block_text")), [*PAGE, "place"]), "block_text", "there"), [*line, "word"], "left").withColumn("n", F.col("wanted") - F.coalesce("there", F.lit(0))).filter("n > 0")
    lacking = lacking.groupBy(*line).agg(F.collect_list(F.struct("word", "n")).alias("lacking"))
    earlier = open_.select(*PAGE, GRID, F.col("line_no").alias("no"), F.col("text").alias("earlier_text"), F.col("l").alias("b"))
    over = meet(open_, earlier, PAGE, l, b).filter(F.col("no") < F.col("line_no")).withColumn("share", G.intersection(l, b) / size).filter(F.col("share") > 0)
    over = over.groupBy(*line).agg(F.sort_array(F.collect_list(F.struct("no", "share", X.folded_words(F.col("earlier_text")).alias("words")))).alias("over"))
    # Blocks before lines of the same top, and of blocks with one top the first of the page last, as it is the one that counts.
    events = placed.select(*PAGE, "b.x0", "b.x1", "b.y0", F.lit(None).cast("int").alias("line_no"), "place").unionByName(open_.select(*PAGE, "l.x0", "l.x1", "l.y0", "line_no", F.lit(None).cast("int").alias("place")))
    followed = sweep.over_groups(events, PAGE, ["y0", F.asc_nulls_first("line_no"), F.desc("place")], sweep.above, "line_no int, above_y0 double, above_place int")
    items = open_.join(lacking, line, "left").join(over, line, "left").join(followed, line, "left").select(*line, "l.*", "total", "n", "lacking", "over", "above_y0", "above_place")
    put = sweep.over_groups(items, PAGE, ["line_no"], sweep.putting(cover), "line_no int, place array<int>")
    kind = F.when(l["y1"] < page_height * 0.07, "header").when(l["y0"] > page_height * 0.94, "footer").otherwise("text")
    new = put.join(seen, line).select(*PAGE, F.concat(F.lit("line-"), F.col("line_no").cast("string")).alias("block_id"), kind.alias("type"), "text", "place", l.alias("b"))
    both = placed.select(*PAGE, "block_id", "type", "text", F.array("place").alias("place"), "b").unionByName(new)
    sides = [b[n].alias(n) for n in ("x0", "y0", "x1", "y1")] if boxes else []
    return both.select(*PAGE, "block_id", "type", "text", *sides, (F.row_number().over(Window.partitionBy(*PAGE).orderBy("place")) - 1).alias("ord"))


def push_down(blocks: DataFrame) -> DataFrame:
    """doc_id, page_index, block_id, top: blocks moved below those before them that they would overlap, from the top down.

    Each block's place depends on all placed before it: a sweep over the blocks of a page. Column ``needed`` is the height
    the text takes. Figures up to 3 points high are rules of forms and stay, without pushing others.
    """
    solid = ~((F.col("type") == "figure") & (F.col("y1") - F.col("y0") <= 3))
    items = blocks.select(*PAGE, "block_id", "x0", "y0", "x1", "ord", F.col("needed").cast("double").alias("needed"), solid.alias("solid"))
    return sweep.over_groups(items, PAGE, ["y0", "x0", "ord", "block_id"], sweep.pushing, "block_id string, top double")


def clear_tops(blocks: DataFrame, gap: float = 1.5) -> DataFrame:
    """doc_id, page_index, block_id, top: a place, from its own downwards, at which each block's text is clear of those before it.

    Columns wide and tall are what the text takes. Text goes below all that reaches into it, as often as that meets
    something else; each time at least one block is passed for good. A sweep over the blocks of a page.
    """
    items = blocks.select(*PAGE, "block_id", "x0", "y0", "ord", F.col("wide").cast("double").alias("wide"), F.col("tall").cast("double").alias("tall"))
    return sweep.over_groups(items, PAGE, ["y0", "x0", "ord", "block_id"], sweep.clearing(gap), "block_id string, top double")


def merge_overlapping(boxes: DataFrame, by: list[str], threshold: float) -> DataFrame:
    """Boxes in order of ``n``, each merged into the first kept box that it overlaps enough: one fold a group."""
    box = lambda x: {n: x[n] for n in ("x0", "y0", "x1", "y1")}
    lists = boxes.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("n", "x0", "y0", "x1", "y1"))).alias("items"))
    start = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")

    def step(kept: Column, x: Column) -> Column:
        hit = lambda y: G.iou(y, x) >= threshold
        at = F.aggregate(F.sequence(F.size(kept), F.lit(1), F.lit(-1)), F.lit(0), lambda best, i: F.when(hit(F.get(kept, i - 1)), i).otherwise(best))
        union = lambda y: G.box(F.least(y["x0"], x["x0"]), F.least(y["y0"], x["y0"]), F.greatest(y["x1"], x["x1"]), F.greatest(y["y1"], x["y1"]))
        first = F.when(F.size(kept) == 0, 0).otherwise(at)
        return F.when(first == 0, F.array_append(kept, G.box(*box(x).values()))).otherwise(F.transform(kept, lambda y, i: F.when(i + 1 == first, union(y)).otherwise(y)))

    return lists.select(*by, F.posexplode(F.aggregate("items", start, step)).alias("n", "b")).select(*by, "n", "b.*")
