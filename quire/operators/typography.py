"""Typography: styles by role, the prevailing style of a reference, sizes that fit, review of uncertain lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Role -> (size in points, bold, italic); fixed values. Other roles are body text.
STYLES = {"heading": (12.0, True, False), "caption": (10.0, False, True), "footnote": (11.0, False, False), "page_number": (11.0, False, False)}
BODY = (11.0, False, False)
#: Advance of characters in thousandths of the size, by class: an even stand-in for metrics of installed fonts.
ADVANCE = {"narrow": ("[iljtfrI.,;:'|!()\\[\\]]", 290), "wide": ("[mwMWШЩЖЮшщжю@%]", 850), "space": (" ", 278)}
OTHER_ADVANCE = 540
#: The characters of each class.
LETTERS = {k: re.sub(r"\\(.)", r"\1", p[1:-1] if p[0] == "[" else p) for k, (p, _) in ADVANCE.items()}


def style(role: Column) -> Column:
    """size, bold and italic of a role."""
    pick = lambda i, kind: F.coalesce(*[F.when(role == k, F.lit(v[i])) for k, v in STYLES.items()], F.lit(BODY[i])).cast(kind)
    return F.struct(pick(0, "double").alias("size"), pick(1, "boolean").alias("bold"), pick(2, "boolean").alias("italic"))


def _units(text: Column) -> Column:
    """Width of a text in thousandths of its size: the sum of those of its characters."""
    # Every character of a class becomes the first of it, which is then counted by what is left without it: far cheaper than to list matches of patterns.
    classes = F.translate(text, "".join(LETTERS.values()), "".join(x[0] * len(x) for x in LETTERS.values()))
    count = lambda t, x: F.length(t) - F.length(F.replace(t, F.lit(x[0]), F.lit("")))
    return X.bound(classes, lambda t: sum((count(t, x) * (ADVANCE[k][1] - OTHER_ADVANCE) for k, x in LETTERS.items()), F.length(t) * OTHER_ADVANCE))


def advance(text: Column, size: Column) -> Column:
    """Width of a text in points."""
    return _units(text) * size / 1000


def wrapped(text: Column, width: Column, size: Column) -> Column:
    """Lines of the text, words packed greedily; a word wider than the line has one of its own."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("units"))

    def step(a: Column, x: Column) -> Column:
        # Each word is measured once; an open line's width is the sum of what it holds.
        w, units = x["w"], x["units"]
        fresh = a["open"] == ""
        longer, longer_units = F.when(fresh, w).otherwise(F.concat(a["open"], F.lit(" "), w)), F.when(fresh, units).otherwise(a["units"] + ADVANCE["space"][1] + units)
        full = ~fresh & (longer_units * size / 1000 > width)
        return F.struct(F.when(full, F.array_append(a["done"], a["open"])).otherwise(a["done"]).alias("done"), F.when(full, w).otherwise(longer).alias("open"), F.when(full, units).otherwise(longer_units).alias("units"))

    words = lambda t: F.transform(F.split(t, " "), lambda w: F.struct(w.alias("w"), _units(w).alias("units")))
    line = lambda t: F.aggregate(words(t), start, step, lambda a: F.array_append(a["done"], a["open"]))
    return F.flatten(F.transform(F.split(text, "\n"), line))


def text_height(text: Column, width: Column, size: Column, spacing: float = 1.2) -> Column:
    return F.size(wrapped(text, width, size)) * size * spacing


def standard(runs: DataFrame, share: float = 0.05) -> DataFrame:
    """role, family, size, bold, italic, sizes: the style with most characters in each role.

    runs: role, family, size, bold, italic, text. sizes: those of the same style with at least ``share`` of the role.
    """
    weight = runs.filter(X.strip(X.or_empty(F.col("text"))) != "").groupBy("role", "family", "size", "bold", "italic").agg(F.sum(F.length("text")).alias("weight"))
    role = Window.partitionBy("role")
    ranked = weight.withColumn("total", F.sum("weight").over(role)).withColumn("rank", F.row_number().over(role.orderBy(F.desc("weight"), "family", "size", "bold", "italic")))
    best = ranked.filter("rank = 1").select("role", "family", "size", "bold", "italic")
    likes = ranked.filter(F.col("weight") >= F.col("total") * share).select("role", "family", "bold", "italic", F.col("size").alias("other"))
    found = best.join(likes, ["role", "family", "bold", "italic"], "left").groupBy("role", "family", "size", "bold", "italic").agg(F.collect_set("other").alias("others"))
    return found.select("role", "family", "size", "bold", "italic", F.sort_array(F.array_union("others", F.array("size"))).alias("sizes"))


def fit(lines: DataFrame, profile: DataFrame, slack: float = 2.0) -> DataFrame:
    """Adds size_pt and overflow: the largest size of the role's standard at which the line fits its box.

    lines: role, text, x0, x1. Roles without a standard take that of text; a line that fits at none takes the smallest and is marked.
    """
    # A row a role: it goes to the lines. Lines that go to the roles would all be the work of as many tasks as there are roles.
    standard = profile.agg(F.sort_array(F.collect_list(F.struct("role", "sizes"))).alias("_standard"))
    of = lambda role: F.get(F.filter("_standard", lambda p: p["role"] == role), F.lit(0))["sizes"]
    joined = lines.crossJoin(F.broadcast(standard)).withColumn("_sizes", F.coalesce(of(F.col("role")), of(F.lit("text"))))
    width = F.col("x1") - F.col("x0") + slack
    fitting = X.bound(_units(F.col("text")), lambda units: F.filter("_sizes", lambda s: units * s / 1000 <= width))
    out = joined.withColumn("_fitting", fitting).withColumn("size_pt", F.coalesce(F.array_max("_fitting"), F.array_min("_sizes"))).withColumn("overflow", F.size("_fitting") == 0)
    return out.drop("_standard", "_sizes", "_fitting")


def uniform_size(lines: DataFrame, key: list[str], most: float = 11.0) -> DataFrame:
    """key, size: one size for all lines of a cell, by their median, their pitch and the room below, in half points.

    lines: key, x0, y0, font_size_pt, cell_y1.
    """
    order = Window.partitionBy(*key).orderBy("y0", "x0")
    pitch = F.lead("y0").over(order) - F.col("y0")
    marked = lines.withColumn("pitch", F.when(pitch > 1, pitch / 1.12))
    cells = marked.groupBy(*key).agg(F.median(F.coalesce("font_size_pt", F.lit(most))).alias("middle"), F.min("pitch").alias("pitch"), F.max("y0").alias("last"), F.max("cell_y1").alias("bottom"))
    limit = F.least(F.lit(most), F.col("middle"), F.coalesce("pitch", F.lit(1e9)), F.greatest(F.lit(1.0), F.col("bottom") - F.col("last") - 1.5) / 1.12)
    size = F.floor(F.greatest(F.lit(1.0), limit) * 2) / 2
    return cells.select(*key, F.when(size == 0, 0.5).otherwise(size).alias("size"))


def review_items(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, line_id, text, reason: lines that need a review, or hold runs that do; each reason once, in order.

    lines: key, line_id, parent_line_id (null for lines), text, review_required, review_reason.
    """
    own = F.coalesce("parent_line_id", "line_id")
    flagged = lines.filter("review_required").select(*key, own.alias("line_id"), F.struct(F.col("parent_line_id").isNotNull().alias("run"), F.col("line_id").alias("at"), F.coalesce("review_reason", F.lit("check the formatting")).alias("reason")).alias("r"))
    reasons = flagged.groupBy(*key, "line_id").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["reason"])), "; ").alias("reason"))
    return lines.filter("parent_line_id IS NULL").select(*key, "line_id", "text").join(reasons, [*key, "line_id"])


#: Role -> (size in points, bold, italic) of editable exports, where they differ from STYLES; fixed values.
STEADY = {"table": (11.0, False, False), "table_header": (11.0, True, False), "header": (9.5, True, False), "footer": (8.0, False, False), "page_number": (8.0, False, False)}
TALL = {"table": 1.05, "table_header": 1.05}


def steady(lines: DataFrame) -> DataFrame:
    """Adds size_pt, bold and italic of editable exports: the role's size, or less where the line's box is too low or too narrow.

    lines: role, text, x0, y0, x1, y1, rotation.
    """
    role, known = F.col("role"), style(F.col("role"))
    pick = lambda i, name: F.coalesce(*[F.when(role == k, F.lit(v[i])) for k, v in STEADY.items()], known[name])
    turned = F.coalesce(F.col("rotation").isin(90, 270), F.lit(False))
    across, down = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    width, height = F.when(turned, down).otherwise(across), F.when(turned, across).otherwise(down)
    factor = F.coalesce(*[F.when(role == k, F.lit(v)) for k, v in TALL.items()], F.lit(1.35))
    per_point = advance(F.col("text"), F.lit(1.0))
    fits = F.when(per_point > 0, width / per_point).otherwise(pick(0, "size"))
    size = F.greatest(F.lit(4.0), F.least(pick(0, "size"), F.greatest(F.lit(5.0), height * factor), fits))
    return lines.withColumn("size_pt", size).withColumn("bold", pick(1, "bold")).withColumn("italic", pick(2, "italic"))


def leaders(text: Column, width: Column, size: Column) -> Column:
    """A line of contents with points from its title to the page at the right end; other lines as they are."""
    entry = X.contents_entry(text)
    room = width - advance(F.concat(entry["title"], F.lit(" "), entry["page"]), size)
    points = F.floor(room / advance(F.lit("."), size)).cast("int")
    return F.when(entry.isNotNull() & (points > 0), F.concat(entry["title"], F.lit(" "), F.repeat(F.lit("."), points), entry["page"])).otherwise(text)


def family_vote(probes: DataFrame, key: list[str], error: float = 0.1, share: float = 0.66) -> DataFrame:
    """key, family: the font that two or more probed lines, and most of them, fit well.

    probes: key, line_no, family, error.
    """
    good = probes.filter(F.col("family").isNotNull() & (F.col("error") < error))
    counts = good.groupBy(*key, "family").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    total = F.sum("n").over(Window.partitionBy(*key))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "first"))
    ranked = counts.withColumn("total", total).withColumn("rank", rank)
    return ranked.filter((F.col("rank") == 1) & (F.col("n") >= 2) & (F.col("n") / F.col("total") >= share)).select(*key, "family")


def font_margins(candidates: DataFrame, key: list[str]) -> DataFrame:
    """key, family, variant, error, margin, reason: the best fitting font, by how much it beats the next other one, and any doubt.

    candidates: key, family, variant, error. A margin is null if there is no other font.
    """
    fonts = candidates.groupBy(*key, "family", "variant").agg(F.min("error").alias("error"))
    order = Window.partitionBy(*key).orderBy("error", "family", "variant")
    ranked = fonts.withColumn("rank", F.row_number().over(order)).withColumn("margin", F.lead("error").over(order) - F.col("error")).filter("rank = 1")
    doubt = F.when(F.col("margin") < 0.004, "several fonts look alike").when(F.col("error") > 0.08, "no font fits well")
    return ranked.select(*key, "family", "variant", "error", "margin", doubt.alias("reason"))
