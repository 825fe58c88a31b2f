"""Tables that cut lineage, in the folder that all machines of the cluster share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from quire.operators.shared import shared_folder


class Workspace:
    """Writes tables as Parquet to the shared folder, and deletes those that are no longer read; all of them when the driver ends."""

    #: Workspaces whose tables may still be there, and the lists of those that `scratch` will clear.
    _all: list[Workspace] = []
    _open: list[list[Workspace]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{shared_folder(spark)}/quire-{uuid.uuid4().hex}", 0
        self.paths: dict[int, str] = {}
        self.held: list[DataFrame] = []
        self._all.append(self)
        for group in self._open[-1:]:
            group.append(self)

    def table(self, frame: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(out)] = path
        self.held.append(out)  # while it lives, no other frame has its id
        return out

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes the files of tables; none may be read afterwards."""
        for frame in frames:
            if path := self.paths.pop(id(frame), None):
                self._delete(path)

    def keep(self, *frames: DataFrame) -> None:
        """`drop` and `clear` will leave these; `end` won't."""
        for frame in frames:
            self.paths.pop(id(frame), None)

    def clear(self, *but: DataFrame) -> None:
        """Deletes all tables that are not dropped yet, but for the given ones."""
        self.drop(*(f for f in self.held if id(f) in self.paths and not any(f is b for b in but)))

    def end(self) -> None:
        """Deletes the folder with all tables."""
        self.paths.clear()
        self._delete(self.folder)
        if self in self._all:
            self._all.remove(self)


@contextmanager
def scratch() -> Iterator[None]:
    """Workspaces that are made within end with it: what was read from them must have been written by then."""
    Workspace._open.append([])
    try:
        yield
    finally:
        for work in Workspace._open.pop():
            work.end()


@atexit.register
def _end_all() -> None:
    for work in list(Workspace._all):
        try:
            work.end()
        except Exception:  # the session has ended before
            return
