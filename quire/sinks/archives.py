"""Bundles as archives in a folder: a data source that is written as a whole or not at all, and read again.

    rows.write.format("bundles").mode("overwrite").save(path)      # doc_id, name, content
    spark.read.format("bundles").load(path)

Each task writes the archives of its documents into a folder of its own attempt. Only when all have, the driver moves the folders of
those attempts that Spark took for good into place, and then writes the list of what holds. Readers follow that list, so a task that fails, is
lost or runs twice leaves nothing that anyone sees, and a rerun takes the place of what was there. Archives are those of ``render.write_zip``.
The path is one that pyarrow can open on the driver and all executors.

The files of a document must come together and by name, see ``save``; one file is in memory at a time.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

if TYPE_CHECKING:
    from pyarrow import fs

SCHEMA = "doc_id long, name string, content binary"
#: What is in the folder: parts that hold, attempts that are being written, and the list of parts.
PARTS, ATTEMPTS, LIST = "parts", "_attempts", "_list.json"
#: Fixed value: the time written in archives, so that equal files give equal archives.
WHEN = (2000, 1, 1, 0, 0, 0)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _there(store: fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type.value > 0


def _listed(store: fs.FileSystem, root: str) -> list[str]:
    if not _there(store, f"{root}/{LIST}"):
        return []
    with store.open_input_stream(f"{root}/{LIST}") as f:
        return json.loads(f.read())


def _remove(store: fs.FileSystem, path: str) -> None:
    if _there(store, path):
        store.delete_dir(path)


@dataclass
class Attempt(WriterCommitMessage):
    """The folder of an attempt that ended well, or nothing for a task without documents."""

    folder: str | None


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.number = path, overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Attempt:
        store, root = _opened(self.path)
        folder = f"{ATTEMPTS}/{self.number}/{uuid.uuid4().hex}"
        doc, archive, buffer, some = None, None, None, False

        def close() -> None:
            archive.close()
            with store.open_output_stream(f"{root}/{folder}/{doc}.zip") as f:
                f.write(buffer.getvalue())

        for row in rows:
            if not some:
                store.create_dir(f"{root}/{folder}", recursive=True)
            if not some or row.doc_id != doc:
                if some:
                    close()
                doc, buffer, some = row.doc_id, io.BytesIO(), True
                if _there(store, f"{root}/{folder}/{doc}.zip"):
                    raise ValueError(f"the files of document {doc} don't come together")
                archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
            archive.writestr(zipfile.ZipInfo(row.name, WHEN), bytes(row.content or b""))
        if some:
            close()
        return Attempt(folder if some else None)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, root = _opened(self.path)
        old = _listed(store, root)
        store.create_dir(f"{root}/{PARTS}", recursive=True)
        new = []
        for n, message in enumerate(m for m in messages if m and m.folder):
            new.append(f"{PARTS}/{self.number}-{n:05d}")
            store.move(f"{root}/{message.folder}", f"{root}/{new[-1]}")
        with store.open_output_stream(f"{root}/{LIST}.{self.number}") as f:
            f.write(json.dumps(new if self.overwrite else old + new).encode())
        # From this moment on the new parts hold.
        store.move(f"{root}/{LIST}.{self.number}", f"{root}/{LIST}")
        _remove(store, f"{root}/{ATTEMPTS}/{self.number}")
        for part in old if self.overwrite else ():
            _remove(store, f"{root}/{part}")

    def abort(self, messages: list[Attempt | None]) -> None:
        store, root = _opened(self.path)
        _remove(store, f"{root}/{ATTEMPTS}/{self.number}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(part) for part in _listed(*_opened(self.path))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        from pyarrow import fs

        store, root = _opened(self.path)
        for info in sorted(store.get_file_info(fs.FileSelector(f"{root}/{partition.value}")), key=lambda x: x.path):
            with store.open_input_file(info.path) as f, zipfile.ZipFile(f) as archive:
                for name in archive.namelist():
                    yield int(info.base_name.removesuffix(".zip")), name, archive.read(name)


class Bundles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Bundles)


def save(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows of bundles (doc_id, name, content) as archives in the folder; those of a null doc_id or name are none."""
    register(rows.sparkSession)
    given = rows.filter("doc_id IS NOT NULL AND name IS NOT NULL").select(rows["doc_id"].cast("long").alias("doc_id"), "name", rows["content"].cast("binary").alias("content"))
    given.repartition("doc_id").sortWithinPartitions("doc_id", "name").write.format("bundles").mode(mode).save(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("bundles").load(path)
