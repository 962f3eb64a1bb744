"""Document models made from the driver's tables, by rules that SQL can repeat.

Each line of a document becomes a block: ten to a page, in two columns for odd doc_id. Orders become tables, one row
a line item; embeddings become boxes; events become those of recognition jobs. ``SQL`` holds the same rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT, LINES = 595.0, 842.0, 10
#: Latin letters and the Cyrillic ones that look like them, for texts that mix scripts.
MIXED = ("aeopcx", "аеорсх")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver; how it is split is a matter of ``spark.sql.files.maxPartitionBytes``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Items of a task, about, where they are dealt by order: a cell and its lines take many times the room of what is shuffled.
ITEMS = 1 << 18


def dealt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, dealt by order to so many tasks that what is made of a task's items can be sorted in memory."""
    items = table(spark, sf_dir, "lineitem")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // ITEMS))
    return items.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus").repartition(tasks, "l_orderkey")


def noisy(line: Column, kind: Column) -> Column:
    """The line with one of the defects of recognition, by kind."""
    return (
        F.when(kind == 1, F.translate(line, *MIXED))
        .when(kind == 2, F.concat(F.lit("­"), F.replace(line, F.lit(" "), F.lit(" \t "))))
        .when(kind == 3, F.replace(line, F.lit("e"), F.lit("�")))
        .when(kind == 4, F.replace(line, F.lit(" "), F.lit("-\n ")))
        .when(kind == 5, F.substring(line, 1, 15))
        .otherwise(line)
    )


def blocks(documents: DataFrame) -> DataFrame:
    """One block for each line that isn't blank, without page furniture."""
    lines = documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "line")).filter(F.col("line").rlike(r"\S"))
    r, two, i, d = F.col("i") % LINES, F.col("doc_id") % 2 == 1, F.col("i"), F.col("doc_id")
    kind = F.when(i == 0, "heading").when(r == 9, "footnote").when((d * 7 + i) % 13 == 5, "figure").when((d * 7 + i) % 13 == 6, "caption").when((d + i) % 7 == 3, "list_item").otherwise("text")
    x0 = F.when(two, 72 + 250 * (i % 2)).otherwise(72).cast("double")
    y0 = (90 + 18 * F.when(two, F.floor(r / 2)).otherwise(r)).cast("double")
    out = lines.select("doc_id", "source", (F.floor(i / LINES)).cast("int").alias("page_index"), F.concat(F.lit("b"), F.lpad(i.cast("string"), 6, "0")).alias("block_id"), kind.alias("type"), "line", i.cast("int").alias("i"), x0.alias("x0"), y0.alias("y0"), (x0 + F.least(F.when(two, 220).otherwise(450), 6 * F.length("line"))).cast("double").alias("x1"), (y0 + 12).alias("y1"))
    confidence = ((d * 31 + F.col("i")) % 101) / 100.0
    is_figure = F.col("type") == "figure"
    return out.select("doc_id", "source", "page_index", "block_id", "type", F.when(~is_figure, F.col("line")).alias("text"), noisy(F.col("line"), (d + F.col("i")) % 6).alias("noisy"), "i", "x0", "y0", "x1", "y1", confidence.cast("double").alias("confidence"), F.when(is_figure, F.concat(F.lit("images/"), F.col("block_id"), F.lit(".png"))).alias("file"))


def with_headers(all_blocks: DataFrame) -> DataFrame:
    """The blocks and a running header on each page."""
    pages = all_blocks.select("doc_id", "source", "page_index").distinct()
    return all_blocks.unionByName(_header(pages).select(*all_blocks.columns))


def with_headers_in_place(all_blocks: DataFrame) -> DataFrame:
    """``with_headers`` of blocks that are dealt by document: the first block of a page brings the header, so nothing is shuffled.

    No union: in Spark 4.1.2 a union of unions of equally dealt tables was found to be taken for dealt where its rows weren't.
    """
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("doc_id", "source", "page_index").orderBy("i"))
    kinds = {f.name: f.dataType for f in all_blocks.schema.fields}
    row = lambda of: F.struct(*[of[c].cast(kinds[c]).alias(c) for c in all_blocks.columns])
    header = {c: F.col(c) for c in ("doc_id", "source", "page_index")} | _fields()
    both = all_blocks.withColumn("_at", at).select(F.explode(F.array_compact(F.array(row({c: F.col(c) for c in all_blocks.columns}), F.when(F.col("_at") == 1, row(header))))).alias("b"), "doc_id")
    return both.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"b.{c}").alias(c) for c in all_blocks.columns])


def _fields() -> dict[str, Column]:
    text = F.concat(F.lit("Report source "), F.col("source"), F.lit(" page "), F.col("page_index").cast("string"))
    fixed = {"block_id": "a_margin", "type": "text", "i": -1, "x0": 72.0, "y0": 40.0, "x1": 300.0, "y1": 52.0, "confidence": 0.99}
    return {"text": text, "noisy": text, "file": F.lit(None).cast("string")} | {k: F.lit(v) for k, v in fixed.items()}


def _header(pages: DataFrame) -> DataFrame:
    header = pages.select("doc_id", "source", "page_index", F.lit("a_margin").alias("block_id"), F.lit("text").alias("type"), F.concat(F.lit("Report source "), F.col("source"), F.lit(" page "), F.col("page_index").cast("string")).alias("text"))
    header = header.select("*", F.col("text").alias("noisy"), F.lit(-1).alias("i"), *[F.lit(v).alias(n) for n, v in (("x0", 72.0), ("y0", 40.0), ("x1", 300.0), ("y1", 52.0))], F.lit(0.99).alias("confidence"), F.lit(None).cast("string").alias("file"))
    return header


def cells(lineitem: DataFrame) -> DataFrame:
    """Cells of one table an order: quantity, price, flag and status of each item; a few span two columns."""
    from pyspark.sql import Window

    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    rows = lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", (F.row_number().over(place) - 1).alias("row"))
    texts = F.array(F.col("l_quantity").cast("int").cast("string"), F.floor("l_extendedprice").cast("string"), F.col("l_returnflag"), F.col("l_linestatus"))
    out = rows.select(F.col("l_orderkey").alias("table_id"), "row", F.posexplode(texts).alias("col", "text"))
    spans = F.when((F.col("col") == 2) & (F.col("table_id") % 5 == 0), 2).otherwise(1)
    out = out.filter(~((F.col("col") == 3) & (F.col("table_id") % 5 == 0))).withColumn("colspan", spans).withColumn("rowspan", F.lit(1))
    x0 = F.lit(72.0) + 90 * F.col("col") + (F.col("row") % 3)
    return out.select("table_id", "row", "col", "rowspan", "colspan", "text", x0.alias("x0"), (100.0 + 20 * F.col("row")).cast("double").alias("y0"), (x0 + 88 * F.col("colspan")).alias("x1"), (118.0 + 20 * F.col("row")).cast("double").alias("y1"))


def boxes(embeddings: DataFrame) -> DataFrame:
    """Two boxes an embedding, from its first eight components, on a page of 600 by 800."""
    e = lambda k: F.round(F.element_at("embedding", k).cast("double") * 400 + 300, 2)
    box = lambda p, k: [F.least(e(k), e(k + 2)).alias(f"{p}x0"), F.least(e(k + 1), e(k + 3)).alias(f"{p}y0"), F.greatest(e(k), e(k + 2)).alias(f"{p}x1"), F.greatest(e(k + 1), e(k + 3)).alias(f"{p}y1")]
    return embeddings.select("vec_id", *box("a_", 1), *box("b_", 5))


#: Event of a user -> event of a recognition job.
JOB_EVENTS = {"signup": "submitted", "view": "running", "purchase": "completed", "error": "failed", "click": "cancelled"}


def job_events(events: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in JOB_EVENTS.items() for x in kv])
    return events.select(F.col("user_id").alias("job_id"), "ts", "event_id", names[F.col("event_type")].alias("event"))


SQL = {
    "blocks": """blocks AS (
  SELECT doc_id, source, (i // 10)::INT AS page_index, 'b' || lpad(i::VARCHAR, 6, '0') AS block_id, type, CASE WHEN type <> 'figure' THEN line END AS text,
         CASE (doc_id + i) % 6 WHEN 1 THEN translate(line, 'aeopcx', 'аеорсх') WHEN 2 THEN chr(173) || replace(line, ' ', ' ' || chr(9) || ' ')
           WHEN 3 THEN replace(line, 'e', chr(65533)) WHEN 4 THEN replace(line, ' ', '-' || chr(10) || ' ') WHEN 5 THEN left(line, 15) ELSE line END AS noisy,
         i::INT AS i, x0, y0, x0 + least(CASE WHEN doc_id % 2 = 1 THEN 220 ELSE 450 END, 6 * length(line)) AS x1, y0 + 12 AS y1,
         ((doc_id * 31 + i) % 101) / 100.0::DOUBLE AS confidence, CASE WHEN type = 'figure' THEN 'images/b' || lpad(i::VARCHAR, 6, '0') || '.png' END AS file
  FROM (
    SELECT *, CASE WHEN i = 0 THEN 'heading' WHEN i % 10 = 9 THEN 'footnote' WHEN (doc_id * 7 + i) % 13 = 5 THEN 'figure' WHEN (doc_id * 7 + i) % 13 = 6 THEN 'caption'
                WHEN (doc_id + i) % 7 = 3 THEN 'list_item' ELSE 'text' END AS type,
           (CASE WHEN doc_id % 2 = 1 THEN 72 + 250 * (i % 2) ELSE 72 END)::DOUBLE AS x0,
           (90 + 18 * CASE WHEN doc_id % 2 = 1 THEN (i % 10) // 2 ELSE i % 10 END)::DOUBLE AS y0
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
    WHERE regexp_matches(line, '\\S'))
)""",
    "all_blocks": """all_blocks AS (
  SELECT * FROM blocks UNION ALL
  SELECT doc_id, source, page_index, 'a_margin', 'text', 'Report source ' || source || ' page ' || page_index, 'Report source ' || source || ' page ' || page_index, -1, 72, 40, 300, 52, 0.99, NULL
  FROM (SELECT DISTINCT doc_id, source, page_index FROM blocks)
)""",
    "cells": """cells AS (
  SELECT table_id, row, col, 1 AS rowspan, CASE WHEN col = 2 AND table_id % 5 = 0 THEN 2 ELSE 1 END AS colspan, text,
         72.0::DOUBLE + 90 * col + row % 3 AS x0, (100.0 + 20 * row)::DOUBLE AS y0,
         72.0::DOUBLE + 90 * col + row % 3 + 88 * CASE WHEN col = 2 AND table_id % 5 = 0 THEN 2 ELSE 1 END AS x1, (118.0 + 20 * row)::DOUBLE AS y1
  FROM (
    SELECT table_id, row, unnest(range(4))::INT AS col, unnest([floor(l_quantity)::INT::VARCHAR, floor(l_extendedprice)::BIGINT::VARCHAR, l_returnflag, l_linestatus]) AS text
    FROM (SELECT l_orderkey AS table_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS row, * FROM lineitem))
  WHERE NOT (col = 3 AND table_id % 5 = 0)
)""",
    "boxes": "boxes AS (SELECT vec_id, "
    + ", ".join(
        f"least(e{k}, e{k + 2}) AS {p}x0, least(e{k + 1}, e{k + 3}) AS {p}y0, greatest(e{k}, e{k + 2}) AS {p}x1, greatest(e{k + 1}, e{k + 3}) AS {p}y1" for p, k in (("a_", 1), ("b_", 5))
    )
    + " FROM (SELECT vec_id, "
    + ", ".join(f"round(embedding[{k}]::DOUBLE * 400 + 300, 2) AS e{k}" for k in range(1, 9))
    + " FROM embeddings))",
    "jobs": "jobs AS (SELECT user_id AS job_id, ts, event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in JOB_EVENTS.items()) + " END AS event FROM events)",
}


def sql(body: str, *names: str) -> str:
    """SQL over the named tables of the bridge."""
    return "WITH " + ",\n".join(SQL[n] for n in names) + "\n" + body
