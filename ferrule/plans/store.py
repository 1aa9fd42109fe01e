"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, one of this machine's is set if driver and
    executors are one process, as in tests; on a cluster that is an error, since no folder is sure to be seen by all."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "ferrule-checkpoints")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Paths that the scopes of this thread of work have made.
_scope: ContextVar[list[str] | None] = ContextVar("stored tables", default=None)


def place(spark: SparkSession, name: str) -> str:
    """A path of its own in that folder."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


@contextmanager
def scoped(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What is stored inside is deleted at the end, but for the tables that are handed to ``keep``.

    A scope only knows what was stored in its own thread of work, so queries that run side by side do not meet."""
    own: list[str] = []
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._stored_at)
        return table

    token = _scope.set(own)
    try:
        yield keep
    finally:
        _scope.reset(token)
        outer = _scope.get()
        for path in own:
            if path not in kept:
                remove(spark, path)
            elif outer is not None:
                outer.append(path)


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def written_whole(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that is there whole or not at all: written beside its place and renamed onto it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(there.toUri(), conf)
    out = there.getFileSystem(conf).create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    # one atomic step, which replaces the file that is there
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, there, renames)


def text_file(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables, as ``stored`` gave them, once what is made from them is stored itself."""
    for table in tables:
        remove(table.sparkSession, table._stored_at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written Parquet: later steps reread it, and a lost executor costs no more than that."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out
