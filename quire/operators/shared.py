"""The folder that all machines of a cluster share, and frames that are cut off from what they were made of."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder that the context was given.

    Where neither is set, a temporary folder serves a local session, as in tests; on a cluster that is an error, as each
    machine would write to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.gettempdir()}/quire-checkpoints")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


_written: list[tuple[SparkSession, str]] = []
_open: list[list[tuple[SparkSession, str]]] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new folder's name in the shared folder; it is deleted when the driver ends, or with the `scratch` around the call."""
    path = f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}"
    (_open[-1] if _open else _written).append((spark, path))
    return path


@contextmanager
def scratch() -> Iterator[None]:
    """Folders that are named within go when it ends: what was read from them must have been written by then."""
    _open.append([])
    try:
        yield
    finally:
        for spark, path in _open.pop():
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(frame: DataFrame) -> DataFrame:
    """The frame's rows, written to the shared folder and read from there; the files go when the driver ends."""
    spark = frame.sparkSession
    path = scratch_folder(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@atexit.register
def _delete() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session has ended before
            return
