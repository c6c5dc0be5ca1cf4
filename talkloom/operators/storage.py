"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a new local folder, if driver and executors are one machine.

    On a cluster a folder of one machine would lose tables: there it must be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.talkloom.local.dir", None)
    if not where:
        if not re.match(r"local(?:$|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="talkloom-")
        spark.conf.set("spark.talkloom.local.dir", where)
    return where.rstrip("/")


def forgotten(df: DataFrame) -> None:
    """Removes the files of a table that :func:`stored` gave and that nothing reads any more; what can't be removed stays."""
    from pyarrow.fs import FileSystem

    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        try:
            system, path = FileSystem.from_uri(re.sub("^file:/+", "/", folder))
            system.delete_dir(path)
        except (OSError, ValueError, NotImplementedError):  # a file system that Arrow doesn't know, or files in use
            pass


#: Spark's setting that a write's shuffle files go with its end, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is written here leaves no shuffle files behind."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if before is None else spark.conf.set(CLEANED, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage: what was computed once is not computed again, and no lost
    executor can take it away. The shuffle files behind it are dropped.
    """
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_turns(parts: Iterable[DataFrame], what: str) -> DataFrame:
    """:func:`stored` of all parts (one at least), written one after the other: only one's shuffle files are there at a time."""
    path = None
    for df in parts:
        path = path or f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
        with shuffles_dropped(df.sparkSession):
            df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
