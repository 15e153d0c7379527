"""Shared scratch space for lineage cuts and intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Paths written inside each open :func:`tables`, innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def scratch_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a private one on a local master, removed when the process ends; elsewhere an error,
    as driver and executors share no local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder path (not yet created) below the shared root."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def tables(spark: SparkSession) -> Iterator[None]:
    """A lifetime: what :func:`cut` writes inside is removed at its end, but for what it keeps."""
    written: list[str] = []
    token = _OPEN.set((*_OPEN.get(), written))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in written:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut(df: DataFrame, name: str = "cut", keep: bool = False) -> DataFrame:
    """Write the rows once to the shared folder and go on from the written table.

    Unlike a checkpoint this computes the plan a single time; like one it survives lost executors. Inside
    :func:`tables` the table goes at the end of the innermost one, with ``keep`` of the next one around it;
    outside of any it stays, as lazy results read it, until the shared folder is cleared.
    """
    path = scratch_dir(df.sparkSession, name)
    around = _OPEN.get()[:-1] if keep else _OPEN.get()
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
