"""What a recognition engine calls its items, as kinds of blocks with their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: Label of an engine -> kind of block; fixed values.
KINDS = {
    "text": "text",
    "paragraph": "text",
    "title": "heading",
    "section_header": "heading",
    "list_item": "list_item",
    "caption": "caption",
    "formula": "formula",
    "page_header": "header",
    "page_footer": "footer",
    "page_number": "page_number",
    "footnote": "footnote",
    "document_index": "text",
    "picture": "figure",
    "chart": "figure",
    "table": "table",
}


def kind_of(label: Column, text: Column) -> Column:
    """The kind of block; an item with an unknown label is text if it has any, else null. No label counts as text."""
    known = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return F.coalesce(known[F.lower(F.coalesce(label, F.lit("text")))], F.when(X.strip(X.or_empty(text)) != "", F.lit("text")))


def first_text(*candidates: Column) -> Column:
    """The first of an item's texts that isn't blank, without blanks around it; empty if all are."""
    filled = [F.when(X.strip(c) != "", X.strip(c)) for c in candidates]
    return F.coalesce(*filled, F.lit(""))


def distinct_cells(cells: DataFrame, key: list[str]) -> DataFrame:
    """Cells without repeats of one by its aliases: same slot, text and spans. The first by ``cell_seq`` stays.

    Cells with other texts in the slot are cells of their own.
    """
    same = [*key, "row", "col", "text", "rowspan", "colspan"]
    others = [c for c in cells.columns if c not in same]
    first = cells.groupBy(*same).agg(F.min(F.struct("cell_seq", *[c for c in others if c != "cell_seq"])).alias("_first"))
    return first.select(*same, "_first.*").select(*cells.columns)


def index_text(cells: DataFrame, key: list[str]) -> DataFrame:
    """key, text: a table of contents as lines, of which each is a row's cells in order; the first cell of a slot counts."""
    slots = cells.groupBy(*key, "row", "col").agg(F.min_by("text", "cell_seq").alias("text"))
    rows = slots.groupBy(*key, "row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), " ").alias("line"))
    return rows.groupBy(*key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))
