"""Queries on engine labels, stored models, checks of exports read back, and styles of editable exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..model import bridge as B
from ..model import stored
from ..model.bridge import sql
from ..operators import labels, typography
from ..operators import layout as L
from ..operators.align import split_lines
from ..quality import checks as C
from ..quality import exports as E
from ..sinks import docx, pdf, render
from ..sources import docx as docx_source
from ..sources import pdf as pdf_source
from ..sources.scratch import kept
from . import layout as PL
from . import quality as Q
from . import tables as PT

KEY = [*L.PAGE, "block_id"]
NAMES = ("text", "Title", "section_header", "list_item", "caption", "page_footer", "chart", "table", "checkbox", "document_index", "picture")


def kinds(spark, d):
    b = PL.blocks(spark, d)
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("i") % 11 + F.when(F.col("i") % 11 < 0, 11).otherwise(0) + 1).cast("int"))
    return b.select(*KEY, labels.kind_of(name, F.col("text")).alias("kind"), labels.first_text(F.when(F.col("i") % 3 == 0, F.lit(" ")).otherwise(F.col("text")), F.col("noisy")).alias("first_text"))


def index_texts(spark, d):
    out = labels.index_text(labels.distinct_cells(PT.doubled(spark, d).unionByName(PT.doubled(spark, d).withColumn("cell_seq", F.col("cell_seq") + 2)), PT.KEY), PT.KEY)
    return out.select("table_id", F.length("text").alias("chars"), F.md5("text").alias("md5"))


def split_readings(spark, d):
    """Each line read again as two lines, with the defects of recognition."""
    t = PL.blocks(spark, d).filter("text IS NOT NULL AND i >= 0").withColumn("words", F.split("noisy", " "))
    half = F.ceil(F.size("words") / 2).cast("int")
    read = F.array(F.array_join(F.slice("words", 1, half), " "), F.array_join(F.slice("words", half + 1, F.size("words")), " "))
    return t.select(*KEY, split_lines(F.col("text"), read).alias("parts")).select(*KEY, F.get("parts", F.lit(0)).alias("first"), F.get("parts", F.lit(1)).alias("second"))


def clear_tops(spark, d):
    wide = F.least(F.col("x1") - F.col("x0"), F.greatest(F.lit(1.0), typography.advance(X.or_empty(F.col("text")), F.lit(11.0))))
    t = PL.ordered(spark, d).filter("type <> 'figure' AND coalesce(text, '') <> ''").withColumn("wide", wide).withColumn("tall", F.lit(20.0))
    return L.clear_tops(t).withColumn("top", F.round("top", 4))


def styled(spark, d):
    t = PL.blocks(spark, d).filter("text IS NOT NULL")
    role = F.when(F.col("i") % 5 == 0, "table").when(F.col("i") % 5 == 1, "header").when(F.col("i") % 5 == 2, "footer").otherwise(F.col("type"))
    return typography.steady(t.select(*KEY, role.alias("role"), "text", "x0", "y0", "x1", "y1", (F.col("i") % 4 * 90).cast("int").alias("rotation"))).select(*KEY, F.round("size_pt", 6).alias("size_pt"), "bold", "italic")


def leaders(spark, d):
    t = PL.blocks(spark, d).filter("text IS NOT NULL").withColumn("text", F.when(F.col("i") % 2 == 0, F.concat(F.lit("1. "), F.substring("text", 1, 40), F.lit(" "), (F.col("doc_id") % 500).cast("string"))).otherwise(F.col("text")))
    return t.select(*KEY, typography.leaders(F.col("text"), F.lit(450.0), F.lit(11.0)).alias("text"))


def votes(spark, d):
    e = B.table(spark, d, "events").select(F.floor(F.col("event_id") / 6).alias("lines"), F.col("event_id").alias("line_no"), F.col("event_type").alias("family"), (F.col("event_id") * 7 % 23 / 100.0).cast("double").alias("error"))
    return typography.family_vote(e, ["lines"])


def margins(spark, d):
    l = B.table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("variant"), (F.floor("l_quantity").cast("double") / 600).alias("error"))
    m = typography.font_margins(l, ["l_orderkey"])
    return m.select("l_orderkey", "family", "variant", F.round("error", 9).alias("error"), F.round("margin", 9).alias("margin"), F.coalesce("reason", F.lit("")).alias("reason"))


def bands(spark, d):
    l = B.table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("band")).agg(F.max("l_quantity").cast("double").alias("ink")).withColumn("n_words", (F.col("l_orderkey") % 5).cast("int"))
    return E.word_bands(l, ["l_orderkey"]).select("l_orderkey", "band", "ink")


def cell_sizes(spark, d):
    """Two lines a cell, both made where the cell is."""
    c = B.cells(B.dealt_items(spark, d))
    y0, size = F.col("y0") + F.col("col"), 8.0 + F.col("row") % 5
    line = lambda top, points: F.struct(top.alias("y0"), points.alias("font_size_pt"))
    both = F.inline(F.array(line(y0, size), line(y0 + 7, F.when(F.col("row") % 3 > 0, size + 1))))
    lines = c.select("table_id", "row", "col", "x0", F.col("y1").alias("cell_y1"), "y0").select("table_id", "row", "col", "x0", "cell_y1", both)
    return typography.uniform_size(lines, ["table_id", "row", "col"])


def pdf_checks(spark, d):
    """PDFs of which some are missing, can't be read, hide text, lack a page or all text."""
    b, docs = PL.blocks(spark, d), Q.docs(spark, d)
    k = F.col("doc_id") % 10
    files = docs.filter(k != 0).select("doc_id", F.when(k == 1, "damaged").alias("error"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "noisy"))), lambda x: x["noisy"]), "\n")
    pages = b.filter("text IS NOT NULL").groupBy(*L.PAGE).agg(text.alias("text")).filter((k > 1) & ((k != 4) | (F.col("page_index") > 0)))
    pages = pages.select("doc_id", "page_index", F.when(k.isin(5, 6), " ").otherwise(F.col("text")).alias("text"), (k == 3).alias("hidden"))
    words = b.groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return E.pdf_checks(docs, files, pages, Q.pages(spark, d).select("doc_id", "page_index"), words, docs.filter("doc_id % 20 = 5"))


def docx_checks(spark, d):
    """Orders as documents of one page with a table each; objects are its items."""
    l = B.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_quantity")
    docs = l.select("doc_id").distinct()
    k = F.col("doc_id") % 11
    pages = docs.select("doc_id", F.lit(0).alias("page_index"), F.lit(595.0).alias("width_pt"), F.lit(842.0).alias("height_pt"))
    canvases = docs.filter(k != 0).select("doc_id", F.when(k == 1, 2).otherwise(1).alias("n"), F.when(k == 2, 3).otherwise(1).alias("sections"), F.when(k == 3, 1).otherwise(0).alias("body_tables"))
    objects = l.groupBy("doc_id", "l_linenumber").agg(F.max("l_quantity").cast("double").alias("q")).filter(k != 0).select("doc_id", F.lit(0).alias("page_index"), F.when(k == 4, 1).otherwise(F.col("l_linenumber")).alias("object_id"), F.concat(F.lit("box "), F.col("l_linenumber").cast("string")).alias("name"), ((k != 5) | (F.col("l_linenumber") > 2)).alias("from_page"), (F.col("q") * 10).alias("x"), F.lit(10.0).alias("y"), F.when(k == 6, 200.0).otherwise(20.0).alias("width"), F.lit(12.0).alias("height"))
    tables = docs.filter((k != 0) & (k != 7)).select("doc_id", F.lit(0).alias("page_index"), F.lit(0).alias("table_no"), (k != 8).alias("exact"), F.lit(4).alias("rows"), F.lit(80.0).alias("row_sum"), F.lit(0.5).alias("border"), F.when(k == 9, 82.0).otherwise(90.0).alias("frame_height"))
    return E.docx_checks(docs, pages, canvases, objects, tables, docs.select("doc_id", F.lit(1).alias("n"))).select("doc_id", "status", "detail")


def models(spark, d):
    """Stored models, some with a fault in their first block or in their text."""
    k = F.col("doc_id") % 9
    o = PL.ordered(spark, d)
    first = (F.col("page_index") == 0) & (F.col("ord") == 0)
    o = o.withColumn("x1", F.when(first & (k == 0), F.col("x0") - 5).otherwise(F.col("x1"))).withColumn("type", F.when(first & (k == 3), "figure").otherwise(F.col("type"))).withColumn("confidence", F.when(first & (k == 5), 1.5).otherwise(F.col("confidence"))).withColumn("ord", F.when(first & (k == 2), 1).otherwise(F.col("ord")))
    pages = Q.pages(spark, d).withColumn("dpi", F.lit(150))
    sources = o.select("doc_id").distinct().select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("file"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), F.lit("pdf").alias("kind"))
    out = render.stored(o, pages, sources, "lines")
    json = F.when(k == 1, F.replace("json", F.lit('"rotation":0'), F.lit('"rotation":0,"extra":1'))).when(k == 4, F.substring("json", 1, 200)).otherwise(F.col("json"))
    return out.withColumn("json", json)


def validity(spark, d):
    return stored.validity(models(spark, d)).select("doc_id", "status", "detail")


def fallback_checks(spark, d):
    b = PL.blocks(spark, d).withColumn("source_label", F.when((F.col("doc_id") % 3 == 0) & (F.col("type") == "figure"), "ocr_image_fallback"))
    items = b.filter("doc_id % 4 = 1 AND i % 6 = 2").select("doc_id")
    return C.report(C.image_fallback(Q.docs(spark, d), b), C.typography(Q.docs(spark, d), items))


def valid_models(spark, d):
    """Stored models of all documents, as they come from a recognition."""
    o, p = PL.ordered(spark, d), Q.pages(spark, d).withColumn("dpi", F.lit(150))
    sources = o.select("doc_id").distinct().select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("file"), F.sha2(F.col("doc_id").cast("string"), 256).alias("sha256"), F.lit("pdf").alias("kind"))
    return render.stored(o, p, sources, "lines")


def written_pdfs(spark, d, write=pdf.positional_pdf):
    """Checks of the documents' PDFs, as they are read back."""
    read = kept(pdf_source.pdf_pages(write(valid_models(spark, d)).select("doc_id", F.col("pdf").alias("content"))), "pdf-pages")
    files = read.groupBy("doc_id").agg(F.max("error").alias("error"))
    words = PL.blocks(spark, d).groupBy("doc_id").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    found = read.filter("page_index >= 0").select("doc_id", "page_index", "text", "hidden")
    return E.pdf_checks(files.select("doc_id"), files, found, Q.pages(spark, d).select("doc_id", "page_index"), words, files.limit(0).select("doc_id"))


def flowing_pdfs(spark, d):
    """Texts of the flowing PDFs, read back: a line for each written one."""
    read = pdf_source.pdf_pages(pdf.flow_pdf(valid_models(spark, d)).select("doc_id", F.col("pdf").alias("content")))
    lines = read.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_index", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return lines.select("doc_id", F.md5(F.regexp_replace("text", r"\s+", "")).alias("md5"))


def text_layers(spark, d):
    """States of the text layers of pages written to PDFs and read back."""
    read = pdf_source.pdf_pages(pdf.positional_pdf(valid_models(spark, d)).select("doc_id", F.col("pdf").alias("content")))
    return read.select("doc_id", "page_index", X.text_layer(F.col("text")).alias("status"))


def written_docx(spark, d):
    """The structure of the documents' DOCX files, as it is read back."""
    # Files are read where they are written; only what was found in them is kept.
    found = kept(docx_source.structure(docx.docx(valid_models(spark, d)).select("doc_id", F.col("docx").alias("content"))), "docx-structure")
    pages = Q.pages(spark, d).select("doc_id", "page_index", "width_pt", "height_pt")
    docs = pages.select("doc_id").distinct()
    wanted = docs.select("doc_id", F.lit(0).alias("n"))
    return E.docx_checks(docs, pages, found.select("doc_id", "n", "sections", "body_tables"), found.select("doc_id", F.inline("objects")), found.select("doc_id", F.inline("tables")), wanted).select("doc_id", "status", "detail")


def reference_styles(spark, d):
    """Prevailing styles of the runs of DOCX files."""
    files = docx.docx(valid_models(spark, d)).select("doc_id", F.col("docx").alias("content"))
    found = docx_source.read(files, docx_source.runs, docx_source.RUNS)
    return typography.standard(found).select("role", "family", "bold", "italic")


QUERIES = {
    "k04_flowing_pdfs": flowing_pdfs,
    "k05_positional_pdfs": written_pdfs,
    "k07_docx_files": written_docx,
    "s05_text_layers": text_layers,
    "s11_reference_styles": reference_styles,
    "p02_block_kinds": kinds,
    "p02_index_texts": index_texts,
    "x27_split_readings": split_readings,
    "w05_clear_tops": clear_tops,
    "p04_steady_lines": styled,
    "x28_leaders": leaders,
    "a11_family_votes": votes,
    "w10_font_margins": margins,
    "w07_word_bands": bands,
    "a12_cell_sizes": cell_sizes,
    "v00_model_valid": validity,
    "v08_pdf_checks": pdf_checks,
    "v11_docx_structure": docx_checks,
    "v12_fallback_checks": fallback_checks,
}

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_NAME = f"{list(NAMES)}[i % 11 + CASE WHEN i % 11 < 0 THEN 11 ELSE 0 END + 1]"
_ADVANCE = {r"[iljtfrI.,;:''|!()\[\]]": 290, "[mwMWШЩЖЮшщжю@%]": 850, " ": 278}


def _units(text: str) -> str:
    """A text's width in thousandths of its size."""
    return "(" + " + ".join(f"len(regexp_extract_all({text}, '{p}')) * {n}" for p, n in _ADVANCE.items()) + f" + (length({text}) - " + " - ".join(f"len(regexp_extract_all({text}, '{p}'))" for p in _ADVANCE) + ") * 540)"


_ROLE = "CASE WHEN i % 5 = 0 THEN 'table' WHEN i % 5 = 1 THEN 'header' WHEN i % 5 = 2 THEN 'footer' ELSE type END"
_TURNED = "i % 4 IN (1, 3)"
_ENTRY = r"^(\d+(?:\.\d+)*\.\s+.+?)\s+(\d{1,4})$"
_WORD = r"regexp_extract_all(replace(lower({}), 'ё', 'е'), '[\p{{L}}\p{{N}}_]+')"
ORACLES = {
    "k04_flowing_pdfs": sql(
        r"""SELECT doc_id, md5(regexp_replace(string_agg(CASE WHEN type = 'figure' THEN file ELSE coalesce(text, '') END, '' ORDER BY page_index, ord), '\s+', '', 'g')) AS md5 FROM ordered GROUP BY doc_id""", *PL._ALL
    ),
    "k05_positional_pdfs": sql(
        """SELECT doc_id, c AS "check", 'PASS' AS status, CASE c WHEN 'searchable_pdf' THEN 'pages read: ' || n WHEN 'visible_pdf_text' THEN 'all text is painted' WHEN 'searchable_pages' THEN n || ' of ' || n ELSE 'words found of a thousand: 1000' END AS detail
FROM (SELECT doc_id, count(DISTINCT page_index) AS n, unnest(['searchable_pdf', 'visible_pdf_text', 'searchable_pages', 'searchable_text']) AS c FROM all_blocks GROUP BY doc_id)""",
        "blocks",
        "all_blocks",
    ),
    "k07_docx_files": sql("SELECT doc_id, 'PASS' AS status, 'pages, objects and tables are in place' AS detail FROM (SELECT DISTINCT doc_id FROM all_blocks)", "blocks", "all_blocks"),
    "p02_block_kinds": sql(
        f"""SELECT doc_id, page_index, block_id, CASE name WHEN 'text' THEN 'text' WHEN 'Title' THEN 'heading' WHEN 'section_header' THEN 'heading' WHEN 'list_item' THEN 'list_item' WHEN 'caption' THEN 'caption' WHEN 'page_footer' THEN 'footer'
  WHEN 'chart' THEN 'figure' WHEN 'picture' THEN 'figure' WHEN 'table' THEN 'table' WHEN 'document_index' THEN 'text' ELSE CASE WHEN {_STRIP.format("coalesce(text, '')")} <> '' THEN 'text' END END AS kind,
  CASE WHEN i % 3 <> 0 AND {_STRIP.format("coalesce(text, '')")} <> '' THEN {_STRIP.format('text')} ELSE {_STRIP.format('noisy')} END AS first_text
FROM (SELECT *, {_NAME} AS name FROM all_blocks)""",
        "blocks",
        "all_blocks",
    ),
    "p02_index_texts": sql(
        """SELECT table_id, length(t)::INT AS chars, md5(t) AS md5 FROM (SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS t FROM (
  SELECT table_id, row, string_agg(text, ' ' ORDER BY col) AS line FROM (SELECT table_id, row, col, arg_min(text, cell_seq) AS text FROM doubled GROUP BY ALL) GROUP BY ALL) GROUP BY table_id)""",
        "cells",
        "doubled",
    ),
    "p04_steady_lines": sql(
        f"""SELECT doc_id, page_index, block_id, round(greatest(4, least(size, greatest(5, high * CASE WHEN role = 'table' THEN 1.05::DOUBLE ELSE 1.35::DOUBLE END), CASE WHEN units > 0 THEN wide / (units / 1000) ELSE size END)), 6) AS size_pt,
  role IN ('heading', 'header') AS bold, role = 'caption' AS italic
FROM (SELECT *, {_ROLE} AS role, CASE WHEN {_TURNED} THEN y1 - y0 ELSE x1 - x0 END AS wide, CASE WHEN {_TURNED} THEN x1 - x0 ELSE y1 - y0 END AS high, {_units('text')} AS units,
  CASE {_ROLE} WHEN 'header' THEN 9.5 WHEN 'footer' THEN 8.0 WHEN 'heading' THEN 12.0 WHEN 'caption' THEN 10.0 ELSE 11.0 END::DOUBLE AS size FROM all_blocks WHERE text IS NOT NULL)""",
        "blocks",
        "all_blocks",
    ),
    "x28_leaders": sql(
        f"""SELECT doc_id, page_index, block_id, CASE WHEN regexp_matches(t, '{_ENTRY}') AND points > 0 THEN title || ' ' || repeat('.', points) || number ELSE t END AS text FROM (
  SELECT *, floor((450 - {_units("(title || ' ' || number)")} * 11 / 1000) / (290 * 11 / 1000))::INT AS points FROM (
    SELECT *, regexp_extract(t, '{_ENTRY}', 1) AS title, regexp_extract(t, '{_ENTRY}', 2) AS number FROM (
      SELECT *, CASE WHEN i % 2 = 0 THEN '1. ' || left(text, 40) || ' ' || (doc_id % 500) ELSE text END AS t FROM all_blocks WHERE text IS NOT NULL)))""",
        "blocks",
        "all_blocks",
    ),
    "a11_family_votes": """WITH c AS (SELECT event_id // 6 AS lines, event_type AS family, count(*) AS n, min(event_id) AS first_ FROM events WHERE event_type IS NOT NULL AND event_id * 7 % 23 / 100.0::DOUBLE < 0.1 GROUP BY ALL)
SELECT lines, family FROM (SELECT *, sum(n) OVER (PARTITION BY lines) AS total FROM c QUALIFY row_number() OVER (PARTITION BY lines ORDER BY n DESC, first_) = 1) WHERE n >= 2 AND n / total >= 0.66""",
    "w10_font_margins": """WITH f AS (SELECT l_orderkey, l_returnflag AS family, l_linestatus AS variant, min(floor(l_quantity)::DOUBLE / 600) AS error FROM lineitem GROUP BY ALL),
r AS (SELECT *, lead(error) OVER w - error AS margin, row_number() OVER w AS rank FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY error, family, variant))
SELECT l_orderkey, family, variant, round(error, 9) AS error, round(margin, 9) AS margin, CASE WHEN margin < 0.004 THEN 'several fonts look alike' WHEN error > 0.08 THEN 'no font fits well' ELSE '' END AS reason FROM r WHERE rank = 1""",
    "w07_word_bands": """SELECT l_orderkey, band, ink FROM (SELECT l_orderkey, l_linenumber AS band, max(l_quantity)::DOUBLE AS ink FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY ink DESC, band) <= CASE WHEN l_orderkey % 5 > 0 THEN l_orderkey % 5 ELSE count(*) OVER (PARTITION BY l_orderkey) END""",
    "a12_cell_sizes": sql(
        """SELECT table_id, row, col, CASE WHEN s = 0 THEN 0.5 ELSE s END AS size FROM (
  SELECT table_id, row, col, floor(greatest(1, least(11, median(coalesce(font, 11)), coalesce(min(CASE WHEN pitch > 1 THEN pitch / 1.12::DOUBLE END), 1e9), greatest(1, max(bottom) - max(y) - 1.5) / 1.12::DOUBLE)) * 2) / 2 AS s FROM (
    SELECT *, lead(y) OVER (PARTITION BY table_id, row, col ORDER BY y, x0) - y AS pitch FROM (
      SELECT table_id, row, col, y0 + col AS y, x0, 8.0::DOUBLE + row % 5 AS font, y1 AS bottom FROM cells
      UNION ALL SELECT table_id, row, col, y0 + col + 7, x0, CASE WHEN row % 3 > 0 THEN 9.0::DOUBLE + row % 5 END, y1 FROM cells)) GROUP BY ALL)""",
        "cells",
    ),
    "v00_model_valid": sql(
        """SELECT doc_id, CASE WHEN doc_id % 9 < 6 THEN 'FAIL' ELSE 'PASS' END AS status,
  CASE doc_id % 9 WHEN 0 THEN 'box' WHEN 1 THEN 'unknown fields' WHEN 2 THEN 'order twice' WHEN 3 THEN 'figure' WHEN 4 THEN 'no model' WHEN 5 THEN 'block' ELSE 'version 1.0, engine lines' END AS detail FROM (SELECT DISTINCT doc_id FROM all_blocks)""",
        "blocks",
        "all_blocks",
    ),
    "v08_pdf_checks": sql(
        f"""SELECT * FROM (
SELECT doc_id, 'searchable_pdf' AS "check", CASE WHEN k > 1 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN k > 1 THEN 'pages read: ' || n WHEN k = 1 THEN 'not readable: damaged' ELSE 'no file' END AS detail FROM facts
UNION ALL SELECT doc_id, 'visible_pdf_text', CASE WHEN k = 3 AND n > 0 THEN 'FAIL' ELSE 'PASS' END, CASE WHEN k = 3 AND n > 0 THEN 'hidden text on pages ' || hidden ELSE 'all text is painted' END FROM facts WHERE k > 1
UNION ALL SELECT doc_id, 'searchable_pages', CASE WHEN n = wanted THEN 'PASS' ELSE 'FAIL' END, n || ' of ' || wanted FROM facts WHERE k > 1
UNION ALL SELECT doc_id, 'searchable_text', CASE WHEN blank THEN CASE WHEN doc_id % 20 = 5 THEN 'WARN' ELSE 'FAIL' END WHEN recall >= 0.5 THEN 'PASS' WHEN recall >= 0.2 THEN 'WARN' ELSE 'FAIL' END,
  CASE WHEN blank AND doc_id % 20 = 5 THEN 'text is kept as images' WHEN blank THEN 'no text' ELSE 'words found of a thousand: ' || floor(recall * 1000)::INT END FROM facts WHERE k > 1)""",
        "blocks",
        "all_blocks",
        "pages",
    ),
    "v11_docx_structure": """WITH d AS (SELECT DISTINCT l_orderkey AS doc_id, l_orderkey % 11 AS k FROM lineitem),
o AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_quantity)::DOUBLE * 10 AS x FROM lineitem GROUP BY ALL),
m AS (
  SELECT doc_id, 0 AS part, i AS place, '' AS at_, [CASE k WHEN 0 THEN 'no file' END, CASE k WHEN 2 THEN 'sections differ from pages' END, CASE k WHEN 1 THEN 'canvases differ from pages' END, CASE k WHEN 3 THEN 'a table stands outside the canvases' END, CASE k WHEN 7 THEN 'tables differ from the model''s' END][i] AS message
  FROM (SELECT *, unnest(range(1, 6)) AS i FROM d)
  UNION ALL SELECT doc_id, 1, 0, 'box ' || n, 'page 1: box ' || n || ' isn''t placed from the page' FROM o JOIN d USING (doc_id) WHERE k = 5 AND n <= 2
  UNION ALL SELECT doc_id, 1, 0, 'box ' || n, 'page 1: box ' || n || ' lies off the page' FROM o JOIN d USING (doc_id) WHERE k <> 0 AND x + CASE WHEN k = 6 THEN 200 ELSE 20 END > 595.05
  UNION ALL SELECT doc_id, 1, 0, '0', CASE WHEN k = 8 THEN 'page 1: a row may grow' ELSE 'page 1: a table is taller than its frame' END FROM d WHERE k IN (8, 9)
  UNION ALL SELECT doc_id, 2, 0, '', 'objects share an id' FROM (SELECT doc_id FROM o JOIN d USING (doc_id) WHERE k = 4 GROUP BY doc_id HAVING count(*) > 1))
SELECT d.doc_id, CASE WHEN t.detail IS NULL THEN 'PASS' ELSE 'FAIL' END AS status, coalesce(t.detail, 'pages, objects and tables are in place') AS detail
FROM d LEFT JOIN (SELECT doc_id, array_to_string(list_slice(list(message ORDER BY part, place, at_, message), 1, 10), '; ') AS detail FROM m WHERE message IS NOT NULL GROUP BY doc_id) t USING (doc_id)""",
    "v12_fallback_checks": sql(
        """SELECT d.doc_id, 'image_fallback' AS "check", CASE WHEN n IS NULL THEN 'PASS' ELSE 'WARN' END AS status, coalesce(n || ' regions kept as images', 'no region kept as an image') AS detail
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM all_blocks WHERE doc_id % 3 = 0 AND type = 'figure' GROUP BY doc_id) USING (doc_id)
UNION ALL SELECT d.doc_id, 'typography_review', CASE WHEN n IS NULL THEN 'PASS' ELSE 'WARN' END, coalesce(n || ' fragments to look at', 'nothing to look at')
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM all_blocks WHERE doc_id % 4 = 1 AND i % 6 = 2 GROUP BY doc_id) USING (doc_id)""",
        "blocks",
        "all_blocks",
    ),
}
_FACTS = f""", texts AS (SELECT doc_id, page_index, string_agg(noisy, chr(10) ORDER BY i) AS text FROM all_blocks WHERE text IS NOT NULL AND (doc_id % 10 <> 4 OR page_index > 0) GROUP BY ALL),
a AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORD.format("coalesce(text, '')")}) AS word FROM all_blocks) GROUP BY ALL),
b AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_WORD.format('text')}) AS word FROM texts) GROUP BY ALL),
facts AS (
  SELECT d.doc_id, d.doc_id % 10 AS k, coalesce(p.n, 0) AS n, p.hidden, coalesce(w.wanted, 0) AS wanted, d.doc_id % 10 IN (5, 6) OR coalesce(p.blank, true) AS blank, coalesce(r.recall, 1) AS recall
  FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, bool_and(NOT regexp_matches(text, '\\S')) AS blank, array_to_string(list_slice(list(page_index + 1 ORDER BY page_index), 1, 10), ', ') AS hidden FROM texts GROUP BY doc_id) p USING (doc_id)
  LEFT JOIN (SELECT doc_id, count(*) AS wanted FROM pages GROUP BY doc_id) w USING (doc_id)
  LEFT JOIN (SELECT a.doc_id, sum(least(a.n, coalesce(b.n, 0))) / sum(a.n) AS recall FROM a LEFT JOIN b USING (doc_id, word) GROUP BY a.doc_id) r USING (doc_id))
"""
ORACLES["v08_pdf_checks"] = ORACLES["v08_pdf_checks"].replace("\nSELECT * FROM (", _FACTS + "SELECT * FROM (", 1)
