"""What the operators of this subpackage share: tables cut from their lineage, and word rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: the space and U+0009 to U+000D. A word is a maximal run of anything else.
SPACE = " \t\n\x0b\x0c\r"
#: The same as a regular expression that Java, RE2 and Python read alike.
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is absent and Spark runs in one process, as in tests, is a temporary folder made.
    """
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quire-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


#: With this setting Spark deletes the shuffle files of an action at its end, not at some later collection of garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables of each open scope, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are stashed inside are deleted at the end, unless they are kept. Nothing that reads them may be used later."""
    token = _scopes.set((*_scopes.get(), []))
    try:
        yield
    finally:
        for path in _scopes.get()[-1]:
            delete(spark, path)
        _scopes.reset(token)


def keep(table: DataFrame) -> DataFrame:
    """Hand a stashed table of the innermost scope on to the scope around it."""
    *outer, inner = _scopes.get()
    inner.remove(table._stashed_at)
    _own(table.sparkSession, table._stashed_at, outer)
    return table


def _own(spark: SparkSession, path: str, scopes) -> None:
    if scopes:
        scopes[-1].append(path)
    else:
        fs, at = _file_system(spark, path)
        fs.deleteOnExit(at)


def stash(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage without depending on any executor staying alive, computes df once, and gives
    Spark the true size of small tables, so that it alone decides whether to broadcast them. The table goes with the
    innermost open scope, or else when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _own(spark, path, _scopes.get())
    table = spark.read.schema(df.schema).parquet(path)
    table._stashed_at = path
    return table


def words_of(text):
    """Column: the words of a text in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
