"""The files of a document's bundle: those that are always written, those on request, and reports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import SINKS, sink

#: Files that every bundle has, in order; fixed values.
ALWAYS = ("output-policy.json", "document.json", "document.md", "document.html", "document-flow.pdf", "document-positional.pdf")


def file_names(wanted: Column, docx: Column) -> Column:
    """Files of a bundle: the searchable PDF if it is wanted, the DOCX file if it is wanted and switched on."""
    more = F.array(F.when(F.array_contains(wanted, "pdf_searchable"), SINKS["pdf_searchable"][0]), F.when(F.array_contains(wanted, "docx") & docx, SINKS["docx"][0]))
    return F.concat(F.array(*map(F.lit, ALWAYS)), F.array_compact(more))


def bundle(models: DataFrame, markdown: DataFrame, html: DataFrame, wanted: tuple[str, ...] = (), docx: bool = False) -> DataFrame:
    """doc_id, name, content of all files of the bundles of stored models (doc_id, json).

    markdown: doc_id, markdown; html: doc_id, html. The policy says which outputs were asked for.
    """
    policy = F.to_json(F.struct(F.array(*map(F.lit, wanted)).cast("array<string>").alias("outputs"), F.lit(docx).alias("docx")))
    text = lambda df, column, name: df.select("doc_id", F.lit(name).alias("name"), F.encode(column, "UTF-8").alias("content"))
    out = text(models.withColumn("policy", policy), "policy", ALWAYS[0]).unionByName(text(models, "json", ALWAYS[1])).unionByName(text(markdown, "markdown", ALWAYS[2])).unionByName(text(html, "html", ALWAYS[3]))
    for name in ("pdf_flow", "pdf_positional", *(w for w in ("pdf_searchable", "docx") if w in wanted and (w != "docx" or docx))):
        file, make, column = sink(name)
        out = out.unionByName(make(models).select("doc_id", F.lit(file).alias("name"), F.col(column).alias("content")))
    return out


def verification_reports(checks: DataFrame) -> DataFrame:
    """doc_id, name, content: verification.json of each document, of its checks in order of their names."""
    rows = F.sort_array(F.collect_list(F.struct("check", "status", "detail")))
    has = lambda s: F.bool_or(F.col("status") == s)
    grouped = checks.groupBy("doc_id").agg((~has("FAIL")).alias("ok"), F.when(has("FAIL"), "FAIL").when(has("WARN"), "WARN").otherwise("PASS").alias("result"), rows.alias("checks"))
    return grouped.select("doc_id", F.lit("verification.json").alias("name"), F.to_json(F.struct("ok", "result", "checks")).alias("content"))


def metrics_reports(metrics: DataFrame, results: DataFrame) -> DataFrame:
    """doc_id, name, content: metrics.json of each document; results: doc_id, result of its checks."""
    joined = metrics.join(results.select("doc_id", F.col("result").alias("verification")), "doc_id", "left")
    return joined.select("doc_id", F.lit("metrics.json").alias("name"), F.to_json(F.struct(*[c for c in joined.columns if c != "doc_id"])).alias("content"))
