"""Archives of bundles as a data source: whole writes, reruns, failing tasks, and equality with archives made in groups."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from quire import plans
from quire.sinks import archives, render


def files(path):
    return sorted(os.path.relpath(os.path.join(d, n), path) for d, _, names in os.walk(path) for n in names)


def rows(spark, ids, text="text"):
    return spark.createDataFrame([(i, n, f"{text} {i} {n}") for i in ids for n in ("b.html", "a.md")], "doc_id long, name string, content string")


def found(spark, path):
    return {(r.doc_id, r.name): bytes(r.content).decode() for r in archives.load(spark, path).collect()}


def expected(ids, text="text"):
    return {(i, n): f"{text} {i} {n}" for i in ids for n in ("a.md", "b.html")}


def test_archives_are_those_of_groups(spark, tmp_path):
    path = str(tmp_path / "out")
    table = rows(spark, range(30))
    archives.save(table, path)
    assert found(spark, path) == expected(range(30))
    want = {r.doc_id: bytes(r.zip) for r in render.write_zip(table).collect()}
    got = {}
    for name in files(path):
        if name.endswith(".zip"):
            with open(os.path.join(path, name), "rb") as f:
                got[int(os.path.basename(name)[:-4])] = f.read()
    assert got == want and zipfile.ZipFile(io.BytesIO(got[3])).namelist() == ["a.md", "b.html"]


def test_reruns_replace_and_appends_add(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    archives.save(rows(spark, range(10)), path)
    archives.save(rows(spark, range(5, 8), "new"), path)
    assert found(spark, path) == expected(range(5, 8), "new")
    assert len([f for f in files(f"{tmp_path}/out") if f.endswith(".zip")]) == 3
    archives.save(rows(spark, [20]), path, "append")
    assert found(spark, path) == expected(range(5, 8), "new") | expected([20])
    archives.save(rows(spark, []), path)
    assert found(spark, path) == {} and archives.load(spark, f"{tmp_path}/never").count() == 0


def test_failing_tasks_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    archives.save(rows(spark, range(10)), path)
    before = files(path)
    bad = rows(spark, range(40), "new").withColumn("content", F.when(F.col("doc_id") == 33, F.raise_error(F.lit("broken"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        archives.save(bad, path)
    assert files(path) == before and found(spark, path) == expected(range(10))
    archives.save(rows(spark, range(40), "new"), path)
    assert found(spark, path) == expected(range(40), "new") and "_attempts" not in {f.split("/")[0] for f in files(path)}


def test_files_of_a_document_must_come_together(spark, tmp_path):
    archives.register(spark)
    torn = rows(spark, [1, 2]).orderBy("name").coalesce(1).withColumn("content", F.col("content").cast("binary"))
    with pytest.raises(Exception, match="come together"):
        torn.write.format("bundles").mode("overwrite").save(str(tmp_path / "torn"))
    assert files(tmp_path / "torn") == []


def test_saved_bundles_of_every_document(spark, tmp_path):
    docs = spark.createDataFrame([(i, "\n".join(f"line {n} of {i}" for n in range(i % 7 + 1)), "en", "s", 1) for i in range(25)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.name): r.md5 for r in plans.QUERIES["k10_saved_bundles"](spark, str(tmp_path)).collect()}
    want = {(r.doc_id, name): r.md5 for name, query in (("document.md", "k02_markdown"), ("document.html", "k03_html")) for r in plans.QUERIES[query](spark, str(tmp_path)).collect()}
    assert got == want and len(got) == 50
