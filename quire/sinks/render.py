"""Exports as texts: Markdown, positioned HTML, JSON; and the files of a bundle.

A document is put together in one row, as its export is one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.layout import PAGE
from ..operators.tables import escape_html


def _ordered(rows: DataFrame, by: list[str], order: list[str], value: str, between: str) -> DataFrame:
    item = F.struct(*order, F.col(value).alias("_v"))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_v"]), between).alias(value))


def markdown(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id, markdown: pages with a mark each, blocks in reading order.

    A figure takes its caption, which then doesn't stand by itself. Tables appear only if they carry HTML (column html).
    """
    html = F.col("html") if "html" in blocks.columns else F.lit(None)
    level = F.col("level") if "level" in blocks.columns else F.lit(1)
    captions = links.join(blocks.select(*PAGE, F.col("block_id").alias("caption_id"), F.col("text").alias("alt")), [*PAGE, "caption_id"], "left")
    figures = captions.select(*PAGE, F.col("figure_id").alias("block_id"), "alt")
    used = captions.filter("alt IS NOT NULL").select(*PAGE, F.col("caption_id").alias("block_id"), F.lit(True).alias("used"))
    rows = blocks.join(figures, [*PAGE, "block_id"], "left").join(used, [*PAGE, "block_id"], "left")
    alt, text, nl = X.or_empty(F.col("alt")), X.or_empty(F.col("text")), F.lit("\n")
    picture = F.concat(F.lit("!["), F.when(alt != "", alt).otherwise(F.col("block_id")), F.lit("]("), F.col("file"), F.lit(")\n"), F.when(alt != "", F.concat(F.lit("*"), alt, F.lit("*\n"))).otherwise(""), nl)
    kind = F.col("type")
    piece = (
        F.when((kind == "figure") & F.col("file").isNotNull(), picture)
        .when((kind == "caption") & F.col("used"), F.lit(""))
        .when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.coalesce(level, F.lit(1)), F.lit(6)).cast("int")), F.lit(" "), text, F.lit("\n\n")))
        .when(kind == "list_item", F.concat(F.lit("- "), text, nl))
        .when((kind == "table") & (X.or_empty(html) != ""), F.concat(html, F.lit("\n\n")))
        .when(text != "", F.concat(text, F.lit("\n\n")))
        .otherwise("")
    )
    pages = _ordered(rows.withColumn("markdown", piece), PAGE, ["ord", "block_id"], "markdown", "")
    pages = pages.withColumn("markdown", F.concat(F.lit("<!-- page "), (F.col("page_index") + 1).cast("string"), F.lit(" -->\n"), "markdown"))
    whole = _ordered(pages, ["doc_id"], ["page_index"], "markdown", "")
    return whole.withColumn("markdown", F.concat(F.regexp_replace("markdown", r"\s+$", ""), nl))


def _css(name: str, column: Column) -> Column:
    return F.concat(F.lit(f"{name}:"), F.format_string("%.3f", column), F.lit("pt"))


def html(blocks: DataFrame, page_width: float, page_height: float, images: DataFrame | None = None) -> DataFrame:
    """doc_id, html: every block at its place, text escaped, figures by their files.

    Tables appear if they carry their markup (column markup, from tables.to_html). images: doc_id, file, content; figures that
    are there are put into the page, so the file needs no other.
    """
    markup = F.col("markup") if "markup" in blocks.columns else F.lit(None).cast("string")
    source = escape_html(F.col("file"))
    if images is not None:
        blocks = blocks.join(images.select("doc_id", "file", F.col("content").alias("_image")), ["doc_id", "file"], "left")
        source = F.when(F.col("_image").isNotNull(), F.concat(F.lit("data:image/"), F.when(F.lower("file").endswith(".png"), "png").otherwise("jpeg"), F.lit(";base64,"), F.base64("_image"))).otherwise(source)
    style = F.concat_ws(";", F.lit("position:absolute"), _css("left", F.col("x0")), _css("top", F.col("y0")), _css("width", F.col("x1") - F.col("x0")), _css("height", F.col("y1") - F.col("y0")))
    inner = F.when(F.col("type") == "figure", F.concat(F.lit('<img src="'), source, F.lit('" alt="">'))).when((F.col("type") == "table") & markup.isNotNull(), markup).otherwise(F.replace(escape_html(X.or_empty(F.col("text"))), F.lit("\n"), F.lit("<br>")))
    div = F.concat(F.lit('<div id="'), escape_html(F.col("block_id")), F.lit('" class="'), F.col("type"), F.lit('" style="'), style, F.lit('">'), inner, F.lit("</div>"))
    pages = _ordered(blocks.withColumn("html", div), PAGE, ["ord", "block_id"], "html", "\n")
    size = f"position:relative;width:{page_width:.3f}pt;height:{page_height:.3f}pt"
    pages = pages.withColumn("html", F.concat(F.lit('<section data-page="'), (F.col("page_index") + 1).cast("string"), F.lit(f'" style="{size}">\n'), "html", F.lit("\n</section>")))
    whole = _ordered(pages, ["doc_id"], ["page_index"], "html", "\n")
    return whole.withColumn("html", F.concat(F.lit('<!doctype html>\n<html><head><meta charset="utf-8"></head><body>\n'), "html", F.lit("\n</body></html>\n")))


def models(blocks: DataFrame, page_width: float, page_height: float) -> DataFrame:
    """doc_id, json: each document's model as JSON text, pages and blocks in order."""
    b = F.struct(F.col("ord").alias("order"), F.col("block_id").alias("id"), "type", F.struct("x0", "y0", "x1", "y1").alias("bbox"), "confidence", "text", F.when(F.col("file").isNotNull(), F.struct("file")).alias("figure"))
    pages = blocks.groupBy(*PAGE).agg(F.sort_array(F.collect_list(b)).alias("blocks"))
    p = F.struct(F.col("page_index").alias("index"), F.lit(page_width).alias("width_pt"), F.lit(page_height).alias("height_pt"), F.lit("ok").alias("status"), "blocks")
    docs = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(p)).alias("pages"))
    return docs.select("doc_id", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "pages")).alias("json"))


def stored(blocks: DataFrame, pages: DataFrame, sources: DataFrame, engine: str, version: str = "1.0") -> DataFrame:
    """doc_id, json: each document's whole model as JSON text, with all fields that model.stored names; null ones are left out.

    blocks: doc_id, page_index, block_id, type, ord, x0, y0, x1, y1, confidence, text, file; pages: doc_id, page_index, width_pt, height_pt,
    status, dpi; sources: doc_id, file, sha256, kind.
    """
    wide, tall = (F.greatest(F.lit(1), F.round((F.col(b) - F.col(a)) * F.col("dpi") / 72)).cast("int") for a, b in (("x0", "x1"), ("y0", "y1")))
    figure = F.when(F.col("file").isNotNull(), F.struct("file", F.lit("png").alias("format"), wide.alias("width_px"), tall.alias("height_px")))
    b = F.struct(F.col("ord").alias("order"), F.col("block_id").alias("id"), "type", F.struct("x0", "y0", "x1", "y1").alias("bbox"), "confidence", "text", figure.alias("figure"))
    grouped = blocks.join(pages.select(*PAGE, "dpi"), PAGE).groupBy(*PAGE).agg(F.sort_array(F.collect_list(b)).alias("blocks"))
    size = F.array(*[F.ceil(F.col(c) * F.col("dpi") / 72).cast("int") for c in ("width_pt", "height_pt")])
    p = F.struct(F.col("page_index").alias("index"), "width_pt", "height_pt", F.lit(0).alias("rotation"), F.col("dpi").alias("raster_dpi"), size.alias("size_px"), "status", F.lit("absent").alias("text_layer"), F.coalesce("blocks", F.array().cast(grouped.schema["blocks"].dataType)).alias("blocks"), F.array().cast("array<string>").alias("warnings"))
    whole = pages.join(grouped, PAGE, "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(p)).alias("pages"))
    named = sources.select("doc_id", F.struct("file", "sha256", F.col("kind").alias("type")).alias("source"))
    nothing = F.array().cast("array<string>")
    fields = F.struct(F.lit("1.0").alias("schema_version"), "source", F.struct(F.lit(engine).alias("name"), F.lit(version).alias("version"), nothing.alias("models")).alias("engine"), "pages", nothing.alias("warnings"), F.create_map().cast("map<string,double>").alias("timings"))
    return whole.join(named, "doc_id").select("doc_id", F.to_json(fields).alias("json"))


def bundle(**exports: DataFrame) -> DataFrame:
    """doc_id, name, content: rows of a bundle from exports with columns doc_id and one text; file__ext names file.ext."""
    out = None
    for name, df in exports.items():
        text = next(c for c in df.columns if c != "doc_id")
        rows = df.select("doc_id", F.lit(name.replace("__", ".")).alias("name"), F.col(text).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_bundle(rows: DataFrame, path: str) -> None:
    """Writes bundle rows, one folder a file name; a whole write appears at once or not at all."""
    rows.write.mode("overwrite").partitionBy("name").parquet(path)


def write_zip(rows: DataFrame) -> DataFrame:
    """doc_id, zip: the bundle of each document as one archive; bundles are small, a document is one row."""
    import pandas as pd

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        import io
        import zipfile

        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for r in pdf.sort_values("name").itertuples(index=False):
                z.writestr(zipfile.ZipInfo(r.name, (2000, 1, 1, 0, 0, 0)), r.content)
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "zip": [out.getvalue()]})

    return rows.groupBy("doc_id").applyInPandas(pack, "doc_id long, zip binary")
