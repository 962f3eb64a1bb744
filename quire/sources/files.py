"""Sources: files as binary rows, stored document models, job records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import jobs

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
LINE = f"struct<text:string,bbox:{BOX},font_size_pt:double,font_family:string,bold:boolean,italic:boolean,review_required:boolean,review_reason:string>"
CELL = f"struct<row:int,col:int,rowspan:int,colspan:int,text:string,bbox:{BOX},background_color:string>"
BLOCK = f"struct<id:string,type:string,bbox:{BOX},order:int,confidence:double,text:string,lines:array<{LINE}>,level:int,table:struct<html:string,n_rows:int,n_cols:int,cells:array<{CELL}>>,figure:struct<file:string,format:string,width_px:int,height_px:int,caption_id:string>,source_label:string>"
PAGE = f"struct<index:int,width_pt:double,height_pt:double,rotation:int,raster_dpi:int,status:string,text_layer:string,blocks:array<{BLOCK}>,warnings:array<string>>"
#: A stored document model.
DOCUMENT = f"schema_version string, source struct<file:string,sha256:string,type:string>, engine struct<name:string,version:string>, pages array<{PAGE}>, warnings array<string>, timings map<string,double>"
JOB = "id string, engine string, outputs array<string>, status string, progress int, pages_total int, error string, created_at double, started_at double, finished_at double, cancel_requested boolean, review_required boolean"


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def uploads(spark: SparkSession, path: str, most_bytes: int = 200 * 1024 * 1024) -> DataFrame:
    """path, name, length, sha256, accepted, content of the files in a folder. Files too large are listed without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ok = jobs.accepted_upload(name_of(F.col("path"))) & (F.col("length") <= most_bytes)
    return files.select("path", name_of(F.col("path")).alias("name"), "length", F.sha2("content", 256).alias("sha256"), ok.alias("accepted"), F.when(ok, F.col("content")).alias("content"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Stored models, one JSON file each, with doc_id from the folder that holds it. Files that don't fit the schema stop the read."""
    read = spark.read.schema(DOCUMENT).option("multiLine", "true").option("mode", "FAILFAST").option("recursiveFileLookup", "true").option("pathGlobFilter", "document.json").json(path)
    return read.withColumn("doc_id", F.element_at(F.split(F.input_file_name(), "/"), -2))


def blocks(models: DataFrame) -> DataFrame:
    """Blocks of stored models, one row each."""
    pages = models.select("doc_id", F.explode("pages").alias("p"))
    rows = pages.select("doc_id", F.col("p.index").alias("page_index"), F.col("p.width_pt").alias("width_pt"), F.col("p.height_pt").alias("height_pt"), F.col("p.status").alias("page_status"), F.explode("p.blocks").alias("b"))
    return rows.select("doc_id", "page_index", "width_pt", "height_pt", "page_status", F.col("b.id").alias("block_id"), "b.type", "b.text", F.col("b.order").alias("ord"), "b.confidence", "b.level", "b.bbox.*", "b.source_label", F.col("b.figure.file").alias("file"), F.col("b.figure.caption_id").alias("caption_id"), "b.table", "b.lines")


def cells(block_rows: DataFrame) -> DataFrame:
    rows = block_rows.filter("table IS NOT NULL").select("doc_id", "page_index", "block_id", F.posexplode("table.cells").alias("cell_seq", "c"))
    return rows.select("doc_id", "page_index", "block_id", "cell_seq", "c.row", "c.col", "c.rowspan", "c.colspan", "c.text", "c.bbox.*")


def job_records(spark: SparkSession, path: str) -> DataFrame:
    """Jobs stored as job.json, as they are after a restart."""
    read = spark.read.schema(JOB).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "job.json").json(path)
    return jobs.restored(read)
