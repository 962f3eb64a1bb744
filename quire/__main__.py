"""The command line: doctor, verify, parse, models, queries, run."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .errors import QuireError
from .sources import config


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("quire").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _print(report: object) -> None:
    print(json.dumps(report, ensure_ascii=False, indent=2, default=str))


def verified(spark, folder: str) -> list[dict]:
    """Checks of a folder of documents: each folder with a document.json is one, with its files beside it."""
    from pyspark.sql import functions as F

    from .model import stored
    from .operators import layout as L
    from .quality import checks as C
    from .sources import files

    named = F.element_at(F.split("path", "/"), -2).alias("doc_id")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    every = reader.load(folder).select("path")
    texts = reader.option("pathGlobFilter", "document.json").load(folder).select(named, "path", F.try_validate_utf8(F.col("content").cast("string")).alias("json"))
    valid = stored.validity(texts)
    good = texts.join(valid.filter("status = 'PASS'").select("doc_id"), "doc_id")
    docs = good.select("doc_id")
    models = stored.load(good).select("doc_id", "model.*")
    blocks, cells = files.blocks(models).drop("width_pt", "height_pt"), files.cells(files.blocks(models))
    pages = models.select("doc_id", F.explode("pages").alias("p")).select("doc_id", F.col("p.index").alias("page_index"), F.col("p.status").alias("status"), "p.width_pt", "p.height_pt")
    tables = blocks.filter("table IS NOT NULL").select(*L.PAGE, "block_id", F.col("table.n_rows").alias("n_rows"), F.col("table.n_cols").alias("n_cols"))
    figures = blocks.filter("type = 'figure'").select("doc_id", "block_id", "file")
    folders = good.select("doc_id", F.regexp_replace("path", "document\\.json$", "").alias("root"))
    beside = every.join(folders, F.col("path").startswith(F.col("root"))).select("doc_id", F.expr("substring(path, length(root) + 1)").alias("file"))
    links = blocks.filter("caption_id IS NOT NULL").select(*L.PAGE, F.col("block_id").alias("figure_id"), "caption_id")
    report = C.report(valid, C.contents(docs, blocks), C.ocr_text(docs, blocks, cells), C.page_count(docs, pages), C.boxes(docs, blocks, pages), C.tables(docs, tables, cells, pages), C.figure_files(docs, figures, beside), C.caption_links(docs, links, blocks), C.figure_leakage(docs, blocks), C.image_fallback(docs, blocks), C.artifacts(docs, beside))
    return [r.asDict() for r in report.orderBy("doc_id", "check").collect()]


def parse(spark, source: str, out: str) -> int:
    """The text layer of a PDF as a stored model, Markdown, HTML and PDFs; the number of pages."""
    from pyspark.sql import functions as F

    from .operators import layout as L
    from .sinks import render, sink
    from .sources import pdf

    data = Path(source).read_bytes()
    read = pdf.pdf_pages(spark.createDataFrame([(1, data)], "doc_id long, content binary")).collect()
    if read[0].error:
        raise QuireError(read[0].error)
    rows = [(1, r.page_index, f"p{r.page_index}l{i}", "text", line, i, 56.0, 56.0 + 14 * i, r.width_pt - 56.0, 68.0 + 14 * i, 1.0, None) for r in read for i, line in enumerate(r.text.split("\n")) if line]
    schema = "doc_id long, page_index int, block_id string, type string, text string, ord int, x0 double, y0 double, x1 double, y1 double, confidence double, file string"
    blocks = spark.createDataFrame(rows, schema)
    pages = spark.createDataFrame([(1, r.page_index, r.width_pt, max(r.height_pt, 80.0 + 14 * r.text.count("\n")), "ok", 72) for r in read], "doc_id long, page_index int, width_pt double, height_pt double, status string, dpi int")
    name = spark.createDataFrame([(1, Path(source).name, "pdf")], "doc_id long, file string, kind string").withColumn("sha256", F.sha2(F.lit(data), 256))
    models = render.stored(blocks, pages, name, "text layer")
    folder = Path(out)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "document.json").write_text(models.first().json, encoding="utf-8")
    (folder / "document.md").write_text(render.markdown(blocks, L.attach_captions(blocks)).first().markdown, encoding="utf-8")
    (folder / "document.html").write_text(render.html(blocks, read[0].width_pt, read[0].height_pt).first().html, encoding="utf-8")
    for output in ("pdf_flow", "pdf_positional"):
        file, make, column = sink(output)
        (folder / file).write_bytes(bytes(make(models).first()[column]))
    return len(read)


def main(arguments: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument("--settings", help="a YAML file")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor", help="whether what is needed is there")
    v = commands.add_parser("verify", help="checks of stored documents")
    v.add_argument("folder")
    v.add_argument("--strict", action="store_true", help="warnings fail too")
    a = commands.add_parser("parse", help="the text layer of a PDF as documents")
    a.add_argument("file")
    a.add_argument("--out", required=True)
    commands.add_parser("models", help="engines and models")
    commands.add_parser("queries", help="names of all queries")
    r = commands.add_parser("run", help="one query over a folder of tables, to Parquet")
    r.add_argument("name")
    r.add_argument("tables")
    r.add_argument("out")
    a = p.parse_args(arguments)
    settings = config.load(a.settings)
    try:
        if a.command == "doctor":
            from .doctor import examine

            report = examine(settings)
            _print(report)
            return 0 if report["ok"] else 1
        if a.command == "verify":
            found = verified(_session(), a.folder)
            worst = {r["status"] for r in found}
            _print({"result": "FAIL" if "FAIL" in worst or not found else "WARN" if "WARN" in worst else "PASS", "checks": found})
            return 1 if not found or "FAIL" in worst or a.strict and "WARN" in worst else 0
        if a.command == "parse":
            print(f"pages: {parse(_session(), a.file, a.out)}")
            return 0
        if a.command == "models":
            _print({"engines": ["ink"], "offline": settings["offline"]})
            return 0
        from .plans import QUERIES

        if a.command == "queries":
            print("\n".join(sorted(QUERIES)))
            return 0
        if a.name not in QUERIES:
            raise QuireError(f"unknown query {a.name}")
        QUERIES[a.name](_session(), a.tables).write.mode("overwrite").parquet(a.out)
        return 0
    except (QuireError, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    raise SystemExit(main())
