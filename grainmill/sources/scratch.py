"""A folder that driver and executors share, for tables written between jobs and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder, below the shared one, that the current block writes to; see ``cleared``.
_BELOW: ContextVar[str | None] = ContextVar("below", default=None)


def new_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a local master without that setting gets one of this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="grainmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{_BELOW.get() or root.rstrip('/')}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store, whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Tables written inside the block are deleted at its end; results must have been written elsewhere by then."""
    path = new_folder(spark)
    before = _BELOW.set(path)
    try:
        yield
    finally:
        _BELOW.reset(before)
        remove(spark, path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in a new shared folder: computed once however often it is read."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
