"""The stored model of a document: its fields, and a strict reading of its JSON text.

A document has source, engine, pages, warnings and timings; pages have blocks; blocks have boxes and, by kind, text, lines, a table or
a figure. Nothing else may be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

VERSION = "1.0"
BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
_LINE = f"text:string,bbox:{BOX},font_size_pt:double,font_family:string,bold:boolean,italic:boolean,font_match_error:double,font_match_margin:double,baseline_from_top_pt:double,glyph_offset_x_pt:double,review_required:boolean,review_reason:string,color:string,horizontal_scale_pct:double,rotation:int"
LINE = f"struct<{_LINE},runs:array<struct<{_LINE}>>>"
CELL = f"struct<row:int,col:int,rowspan:int,colspan:int,text:string,bbox:{BOX},lines:array<{LINE}>,background_color:string>"
TABLE = f"struct<html:string,cells:array<{CELL}>,n_rows:int,n_cols:int,border_color:string,border_width_pt:double>"
FIGURE = "struct<file:string,format:string,width_px:int,height_px:int,caption_id:string>"
BLOCK = f"struct<id:string,type:string,bbox:{BOX},order:int,confidence:double,text:string,lines:array<{LINE}>,level:int,table:{TABLE},figure:{FIGURE},source_label:string>"
PAGE = f"struct<index:int,width_pt:double,height_pt:double,rotation:int,raster_dpi:int,size_px:array<int>,status:string,text_layer:string,blocks:array<{BLOCK}>,warnings:array<string>>"
SCHEMA = f"struct<schema_version:string,source:struct<file:string,sha256:string,type:string>,engine:struct<name:string,version:string,models:array<struct<role:string,name:string,weights_sha256:string>>>,pages:array<{PAGE}>,warnings:array<string>,timings:map<string,double>>"
# Fixed values.
BLOCK_TYPES = ("text", "heading", "list_item", "table", "figure", "caption", "formula", "header", "footer", "page_number", "footnote", "other")
PAGE_STATES = ("ok", "degraded", "failed")
TEXT_LAYERS = ("valid", "absent", "garbage")
SOURCES = ("pdf", "image")
COLOR = "^#[0-9a-fA-F]{6}$"

#: Where an object of the model stands in its JSON, and the names it may have; lists are entered.
_NAMES = {
    "$": ("schema_version", "source", "engine", "pages", "warnings", "timings"),
    "$.source": ("file", "sha256", "type"),
    "$.engine": ("name", "version", "models"),
    "pages": ("index", "width_pt", "height_pt", "rotation", "raster_dpi", "size_px", "status", "text_layer", "blocks", "warnings"),
    "blocks": ("id", "type", "bbox", "order", "confidence", "text", "lines", "level", "table", "figure", "source_label"),
}


def _strange(json: Column, names: tuple[str, ...]) -> Column:
    return F.size(F.array_except(F.coalesce(F.json_object_keys(json), F.array().cast("array<string>")), F.array(*map(F.lit, names)))) > 0


def _items(json: Column, path: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(json, path), "array<string>"), F.array().cast("array<string>"))


def load(documents: DataFrame) -> DataFrame:
    """doc_id, model of documents (doc_id, json); model is null where the text is no object with the fields of a model."""
    return documents.select("doc_id", F.from_json("json", SCHEMA, {"mode": "PERMISSIVE"}).alias("model"))


def problems(documents: DataFrame) -> DataFrame:
    """doc_id, problem: every rule of the model that a document (doc_id, json) breaks, once."""
    j = F.col("json")
    rows = documents.withColumn("m", F.from_json("json", SCHEMA))
    m = F.col("m")
    page_texts, all_pages = _items(j, "$.pages"), F.coalesce(m["pages"], F.array().cast(f"array<{PAGE}>"))
    block_texts = F.flatten(F.transform(page_texts, lambda p: _items(p, "$.blocks")))
    blocks = F.flatten(F.transform(all_pages, lambda p: F.coalesce(p["blocks"], F.array().cast(f"array<{BLOCK}>"))))
    cells = F.flatten(F.transform(blocks, lambda b: F.coalesce(b["table"]["cells"], F.array().cast(f"array<{CELL}>"))))
    lines = F.flatten(F.transform(blocks, lambda b: F.coalesce(b["lines"], F.array().cast(f"array<{LINE}>"))))
    no = lambda c: F.coalesce(~c, F.lit(True))  # noqa: E731  a missing value breaks the rule
    if_any = lambda c: F.coalesce(~c, F.lit(False))  # noqa: E731  a missing value doesn't
    turned = lambda b: no((b["x1"] >= b["x0"]) & (b["y1"] >= b["y0"]))
    orders = lambda p: F.transform(F.coalesce(p["blocks"], F.array().cast(f"array<{BLOCK}>")), lambda b: b["order"])
    beyond = lambda p: F.exists(F.coalesce(p["blocks"], F.array().cast(f"array<{BLOCK}>")), lambda b: no((b["bbox"]["x0"] >= 0) & (b["bbox"]["x1"] <= p["width_pt"]) & (b["bbox"]["y0"] >= 0) & (b["bbox"]["y1"] <= p["height_pt"])))
    rules = {
        "no model": F.get_json_object(j, "$").isNull() | m["source"].isNull() | m["engine"].isNull(),
        "unknown fields": _strange(j, _NAMES["$"]) | _strange(F.get_json_object(j, "$.source"), _NAMES["$.source"]) | _strange(F.get_json_object(j, "$.engine"), _NAMES["$.engine"]) | F.exists(page_texts, lambda p: _strange(p, _NAMES["pages"])) | F.exists(block_texts, lambda b: _strange(b, _NAMES["blocks"])),
        "source": no(m["source"]["type"].isin(*SOURCES) & m["source"]["file"].isNotNull() & m["source"]["sha256"].isNotNull()),
        "engine": no(m["engine"]["name"].isNotNull() & m["engine"]["version"].isNotNull()),
        "page": F.exists(all_pages, lambda p: no((p["index"] >= 0) & (p["width_pt"] > 0) & (p["height_pt"] > 0) & (p["raster_dpi"] > 0) & (F.size(p["size_px"]) == 2) & p["status"].isin(*PAGE_STATES) & p["text_layer"].isin(*TEXT_LAYERS))),
        "block": F.exists(blocks, lambda b: no(b["id"].isNotNull() & b["type"].isin(*BLOCK_TYPES) & (b["order"] >= 0)) | if_any(b["confidence"].between(0, 1)) | if_any(b["level"] >= 1)),
        "box": F.exists(blocks, lambda b: turned(b["bbox"])) | F.exists(cells, lambda c: turned(c["bbox"])) | F.exists(lines, lambda x: turned(x["bbox"])),
        "box beyond the page": F.exists(all_pages, beyond),
        "order twice": F.exists(all_pages, lambda p: F.size(F.array_distinct(orders(p))) < F.size(orders(p))),
        "figure": F.exists(blocks, lambda b: (b["type"] == "figure") & (b["figure"].isNull() | b["text"].isNotNull())) | F.exists(blocks, lambda b: b["figure"].isNotNull() & no(b["figure"]["file"].isNotNull() & b["figure"]["format"].isNotNull() & (b["figure"]["width_px"] > 0) & (b["figure"]["height_px"] > 0))),
        "table": F.exists(blocks, lambda b: (b["type"] == "table") & b["table"].isNull()) | F.exists(cells, lambda c: no((c["row"] >= 0) & (c["col"] >= 0) & c["text"].isNotNull()) | if_any((c["rowspan"] >= 1) & (c["colspan"] >= 1)) | if_any(c["background_color"].rlike(COLOR))),
        "line": F.exists(lines, lambda x: x["text"].isNull() | if_any(x["font_size_pt"] > 0) | if_any(x["color"].rlike(COLOR)) | if_any(x["rotation"].between(0, 270))),
    }
    # Where there is no model at all, that alone is said.
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items() if k != "no model"]))
    listed = F.when(F.coalesce(rules["no model"], F.lit(True)), F.array(F.lit("no model"))).otherwise(found)
    return rows.select("doc_id", F.explode(listed).alias("problem"))


def validity(documents: DataFrame) -> DataFrame:
    """ir_valid of each document: doc_id, check, status, detail."""
    found = problems(documents).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("problem")), "; ").alias("detail"))
    joined = documents.select("doc_id", "json").join(found, "doc_id", "left")
    engine = X.or_empty(F.get_json_object("json", "$.engine.name"))
    fine = F.concat(F.lit("version "), F.coalesce(F.get_json_object("json", "$.schema_version"), F.lit(VERSION)), F.lit(", engine "), engine)
    return joined.select("doc_id", F.lit("ir_valid").alias("check"), F.when(F.col("detail").isNull(), "PASS").otherwise("FAIL").alias("status"), F.coalesce("detail", fine).alias("detail"))
