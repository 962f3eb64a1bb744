"""Quality: metrics of documents, and checks that each pass, warn or fail.

A check is a table (doc_id, check, status, detail); a report is their union, and its result the worst status.
Details list at most ten findings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import layout

CONTENTS = "содержание"


def text_chars(blocks: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """doc_id, chars: stripped characters of blocks and cells."""
    parts = blocks.select("doc_id", F.length(X.strip(X.or_empty(F.col("text")))).alias("n"))
    if cells is not None:
        parts = parts.unionByName(cells.select("doc_id", F.length(X.strip(X.or_empty(F.col("text")))).alias("n")))
    return parts.groupBy("doc_id").agg(F.sum("n").alias("chars"))


def metrics(pages: DataFrame, blocks: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """One row a document: pages by status, characters, blocks by type, and whether it needs a review.

    pages: doc_id, page_index, status. Error rates need a reference text and stay null.
    """
    by_page = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), *[F.count_if(F.col("status") == s).alias(f"pages_{s}") for s in ("ok", "degraded", "failed")])
    label = F.col("source_label") if "source_label" in blocks.columns else F.lit(None)
    counts = blocks.groupBy("doc_id", "type").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(label == "ocr_image_fallback", F.lit(False))).alias("fallback"))
    types = counts.groupBy("doc_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("blocks_by_type"),
        F.coalesce(F.sum(F.when(F.col("type") == "table", F.col("n"))), F.lit(0)).alias("tables"),
        F.coalesce(F.sum(F.when(F.col("type") == "figure", F.col("n"))), F.lit(0)).alias("figures"),
        F.bool_or("fallback").alias("review_required"),
    )
    out = by_page.join(types, "doc_id", "left").join(text_chars(blocks, cells), "doc_id", "left")
    return out.withColumn("text_characters", F.coalesce("chars", F.lit(0)).cast("long")).drop("chars").withColumn("cer", F.lit(None).cast("double")).withColumn("wer", F.lit(None).cast("double"))


def listed(found: DataFrame, message: Column, order: list[str]) -> DataFrame:
    """doc_id, n, detail: findings by document, the first ten joined."""
    items = F.sort_array(F.collect_list(F.struct(*order, message.alias("_message"))))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.slice(items, 1, 10), lambda x: x["_message"]), "; ").alias("detail"))


def judged(docs: DataFrame, found: DataFrame, name: str, status: str, fine: Column) -> DataFrame:
    """A check that every document passes unless it has findings (doc_id, detail)."""
    joined = docs.select("doc_id").join(found.select("doc_id", "detail"), "doc_id", "left")
    return joined.select("doc_id", F.lit(name).alias("check"), F.when(F.col("detail").isNotNull(), status).otherwise("PASS").alias("status"), F.coalesce("detail", fine).alias("detail"))


def _page(x: str = "page_index") -> Column:
    return F.concat(F.lit("page "), (F.col(x) + 1).cast("string"))


def ocr_text(docs: DataFrame, blocks: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    label = F.col("source_label") if "source_label" in blocks.columns else F.lit(None)
    fallback = blocks.groupBy("doc_id").agg(F.bool_or(F.coalesce(label == "ocr_image_fallback", F.lit(False))).alias("fallback"))
    joined = docs.join(text_chars(blocks, cells), "doc_id", "left").join(fallback, "doc_id", "left")
    engine = F.col("engine") if "engine" in docs.columns else F.lit("")
    status = F.when(F.col("chars") > 0, "PASS").when(F.col("fallback"), "WARN").when(engine == "fake", "WARN").otherwise("FAIL")
    detail = F.when(F.col("chars") > 0, F.concat(F.lit("characters: "), F.col("chars").cast("string"))).when(F.col("fallback"), "only images of unreadable regions").when(engine == "fake", "made by the test engine").otherwise("no characters")
    return joined.select("doc_id", F.lit("ocr_text").alias("check"), status.alias("status"), detail.alias("detail"))


def page_count(docs: DataFrame, pages: DataFrame) -> DataFrame:
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "degraded").alias("degraded"))
    joined = docs.select("doc_id").join(counts, "doc_id", "left")
    status = F.when(F.col("n").isNull() | (F.col("failed") > 0), "FAIL").when(F.col("degraded") > 0, "WARN").otherwise("PASS")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    detail = F.concat(number("n"), F.lit(" pages, failed "), number("failed"), F.lit(", degraded "), number("degraded"))
    return joined.select("doc_id", F.lit("page_count").alias("check"), status.alias("status"), detail.alias("detail"))


def boxes(docs: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """pages: doc_id, page_index, width_pt, height_pt."""
    joined = blocks.join(pages.select("doc_id", "page_index", "width_pt", "height_pt"), layout.PAGE)
    outside = joined.filter(~G.within_page(G.of(), F.col("width_pt"), F.col("height_pt")))
    message = F.concat(_page(), F.lit(", block "), F.col("block_id"))
    return judged(docs, listed(outside, message, ["page_index", "ord", "block_id"]), "bbox", "FAIL", F.lit("boxes lie on their pages"))


def tables(docs: DataFrame, table_blocks: DataFrame, cells: DataFrame, pages: DataFrame) -> DataFrame:
    """table_blocks: doc_id, page_index, block_id, n_rows, n_cols."""
    key = [*layout.PAGE, "block_id"]
    joined = cells.join(table_blocks.select(*key, "n_rows", "n_cols"), key).join(pages.select(*layout.PAGE, "width_pt", "height_pt"), layout.PAGE)
    name = F.concat(F.col("block_id"), F.lit(": cell ("), F.col("row").cast("string"), F.lit(","), F.col("col").cast("string"), F.lit(") "))
    span = (F.col("row") + F.col("rowspan") > F.col("n_rows")) | (F.col("col") + F.col("colspan") > F.col("n_cols"))
    out = ~G.within_page(G.of(), F.col("width_pt"), F.col("height_pt"))
    problems = F.array_compact(F.array(F.when(span, F.concat(name, F.lit("reaches beyond the grid"))), F.when(out, F.concat(name, F.lit("lies off the page")))))
    found = joined.select("doc_id", "page_index", "block_id", "row", "col", F.explode(problems).alias("message"))
    return judged(docs, listed(found, F.col("message"), ["page_index", "block_id", "row", "col"]), "tables", "FAIL", F.lit("cells lie in grid and page"))


def safe_path(path: Column) -> Column:
    """Relative, not empty, and without a step upwards."""
    parts = F.split(F.coalesce(path, F.lit("")), r"[/\\]")
    return (F.coalesce(path, F.lit("")) != "") & ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~F.array_contains(parts, "..")


def figure_files(docs: DataFrame, figures: DataFrame, files: DataFrame) -> DataFrame:
    """figures: doc_id, block_id, file; files: doc_id, file that exist."""
    joined = figures.join(files.select("doc_id", "file", F.lit(True).alias("there")), ["doc_id", "file"], "left")
    safe = F.coalesce(safe_path(F.col("file")), F.lit(False))
    message = F.when(~safe, F.concat(F.col("block_id"), F.lit(": no safe path"))).otherwise(F.concat(F.col("block_id"), F.lit(": no file "), F.col("file")))
    return judged(docs, listed(joined.filter(~safe | F.col("there").isNull()), message, ["block_id"]), "figure_files", "FAIL", F.lit("every figure has its file"))


def caption_links(docs: DataFrame, links: DataFrame, blocks: DataFrame) -> DataFrame:
    dangling = layout.dangling_captions(links, blocks)
    message = F.concat(F.col("figure_id"), F.lit(": "), F.col("caption_id"))
    return judged(docs, listed(dangling, message, ["page_index", "figure_id"]), "caption_links", "FAIL", F.lit("captions found"))


def figure_leakage(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    count = lambda found: found.groupBy("doc_id").agg(F.concat(F.lit("texts inside: "), F.count("*").cast("string")).alias("detail"))
    a = judged(docs, count(layout.figure_leaks(blocks)), "figure_leakage", "FAIL", F.lit("texts inside: 0"))
    return a.unionByName(judged(docs, count(layout.figure_leaks(blocks, pictograms=True)), "figure_pictogram_overlap", "WARN", F.lit("no glyph in doubt")))


def figure_flow(docs: DataFrame, figures: DataFrame, outputs: DataFrame) -> DataFrame:
    """outputs: doc_id, name, content of the flowing formats; every figure's file must be named in each."""
    pairs = figures.select("doc_id", "file").join(outputs, "doc_id").filter(~F.col("content").contains(F.col("file")))
    message = F.concat(F.col("name"), F.lit(": "), F.col("file"), F.lit(" not named"))
    return judged(docs, listed(pairs, message, ["name", "file"]), "figure_flow", "FAIL", F.lit("all files named"))


def figure_counts(figures: DataFrame, outputs: DataFrame) -> DataFrame:
    """doc_id, ok: whether each figure's file is named just once in the output."""
    n = F.size(F.split("content", F.concat(F.lit("\\Q"), "file", F.lit("\\E")))) - 1
    return figures.select("doc_id", "file").join(outputs, "doc_id").groupBy("doc_id").agg(F.bool_and(n == 1).alias("ok"))


def contents(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Pages with a heading of contents on which fewer than three entries, or sixty characters, follow."""
    has = F.lower(X.or_empty(F.col("text"))).contains(CONTENTS)
    heads = blocks.filter(has).select(*layout.PAGE, F.col("block_id").alias("head_id"), F.col("ord").alias("head_ord"), F.col("y0").alias("head_y"), X.strip(F.element_at(F.split(F.col("text"), f"(?iu){CONTENTS}", 2), 2)).alias("own"))
    lines = F.filter(F.transform(F.split(X.or_empty(F.col("text")), r"\r?\n"), X.strip), lambda x: x != "")
    others = blocks.select(*layout.PAGE, "block_id", "ord", "y0", lines.alias("lines"))
    after = heads.join(others, layout.PAGE, "left").withColumn("use", (F.col("block_id") != F.col("head_id")) & (F.col("y0") >= F.col("head_y")))
    rest = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("use"), F.struct("ord", "block_id", "lines")))), lambda x: x["lines"]))
    entries = after.groupBy(*layout.PAGE, "head_id", "head_ord", "own").agg(rest.alias("rest")).withColumn("entries", F.concat(F.when(F.col("own") != "", F.array("own")).otherwise(F.array().cast("array<string>")), "rest"))
    poor = entries.filter((F.length(F.array_join("entries", " ")) < 60) | (F.size("entries") < 3))
    message = F.concat(_page(), F.lit(": contents with "), F.size("entries").cast("string"), F.lit(" entries"))
    return judged(docs, listed(poor, message, ["page_index", "head_ord"]), "table_of_contents", "WARN", F.lit("contents have entries"))


def searchable_text(recalls: DataFrame) -> DataFrame:
    """recalls: doc_id, recall of the model's words in an export."""
    status = F.when(F.col("recall") >= 0.5, "PASS").when(F.col("recall") >= 0.2, "WARN").otherwise("FAIL")
    return recalls.select("doc_id", F.lit("searchable_text").alias("check"), status.alias("status"), F.concat(F.lit("share of words found: "), F.format_number("recall", 3)).alias("detail"))


def cyrillic(model: DataFrame, exported: DataFrame) -> DataFrame:
    """Both: doc_id, text. Cyrillic letters of the model must be found in the export."""
    has = lambda t, n: t.groupBy("doc_id").agg(F.bool_or(X.or_empty(F.col("text")).rlike("[\\u0400-\\u04FF]")).alias(n))
    joined = has(model, "a").join(has(exported, "b"), "doc_id", "left")
    lost = F.col("a") & ~F.coalesce("b", F.lit(False))
    return joined.select("doc_id", F.lit("fonts_cyrillic").alias("check"), F.when(lost, "FAIL").otherwise("PASS").alias("status"), F.when(lost, "Cyrillic letters lost").when(F.col("a"), "Cyrillic letters found").otherwise("no Cyrillic letters").alias("detail"))


def image_fallback(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    n = blocks.filter("source_label = 'ocr_image_fallback'").groupBy("doc_id").agg(F.concat(F.count("*").cast("string"), F.lit(" regions kept as images")).alias("detail"))
    return judged(docs, n, "image_fallback", "WARN", F.lit("no region kept as an image"))


def typography(docs: DataFrame, items: DataFrame) -> DataFrame:
    n = items.groupBy("doc_id").agg(F.concat(F.count("*").cast("string"), F.lit(" fragments to look at")).alias("detail"))
    return judged(docs, n, "typography_review", "WARN", F.lit("nothing to look at"))


#: Kinds of review findings that mean text was lost in export; fixed values.
LOSSES = ("docx_text_missing", "pdf_text_missing", "pdf_page_count", "pdf_page_missing", "docx_read_error", "pdf_read_error")


def reviews(docs: DataFrame, reports: DataFrame) -> DataFrame:
    """reports: doc_id, name, status, review_required, kinds (of its issues)."""
    asked = listed(reports.filter("review_required"), F.concat(F.col("name"), F.lit(": "), F.coalesce("status", F.lit("unknown"))), ["name"])
    lost = reports.select("doc_id", "name", F.posexplode("kinds").alias("at", "kind")).filter(F.col("kind").isin(*LOSSES))
    found = listed(lost, F.concat(F.col("name"), F.lit(": "), F.col("kind")), ["name", "at"])
    return judged(docs, asked, "document_review", "WARN", F.lit("nothing left to review")).unionByName(judged(docs, found, "export_text_integrity", "FAIL", F.lit("no loss found")))


def artifacts(docs: DataFrame, files: DataFrame, required=("document.md", "document.html", "document-flow.pdf")) -> DataFrame:
    """files: doc_id, file. The formats that are always written must be there."""
    wanted = docs.select("doc_id", F.explode(F.array(*map(F.lit, required))).alias("file"))
    missing = wanted.join(files.select("doc_id", "file"), ["doc_id", "file"], "left_anti")
    return judged(docs, listed(missing, F.concat(F.lit("no "), F.col("file")), ["file"]), "artifacts", "FAIL", F.lit("all files there"))


def page_invariants(blocks: DataFrame) -> DataFrame:
    """doc_id, page_index, rule, n: rows that break the model's rules on order, boxes, figures and tables."""
    rules = F.array_compact(
        F.array(
            F.when((F.col("x1") < F.col("x0")) | (F.col("y1") < F.col("y0")), F.lit("box")),
            F.when((F.col("type") == "figure") & (F.col("file").isNull() | F.col("text").isNotNull()), F.lit("figure")),
            F.when(~F.col("confidence").between(0, 1), F.lit("confidence")),
        )
    )
    broken = blocks.select(*layout.PAGE, F.explode(rules).alias("rule")).groupBy(*layout.PAGE, "rule").agg(F.count("*").alias("n"))
    twice = blocks.groupBy(*layout.PAGE, "ord").agg(F.count("*").alias("n")).filter("n > 1").groupBy(*layout.PAGE).agg(F.sum("n").alias("n"))
    return broken.unionByName(twice.select(*layout.PAGE, F.lit("order").alias("rule"), "n"))


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def result(all_checks: DataFrame) -> DataFrame:
    """doc_id, result, ok: FAIL before WARN before PASS; skipped checks don't count."""
    has = lambda s: F.bool_or(F.col("status") == s)
    out = all_checks.groupBy("doc_id").agg(F.when(has("FAIL"), "FAIL").when(has("WARN"), "WARN").otherwise("PASS").alias("result"))
    return out.withColumn("ok", F.col("result") != "FAIL")
