"""Incremental builds as a stateful stream: what was built of each path is state, which is forgotten after a time.

The state of a path is the key of the content that was built last. A version of
a source with that key is skipped, another one is built; of several versions
in one batch the latest counts. State lives in the checkpoint, so a restarted
query goes on where it stopped, and what has not been built for `ttl_seconds` is
forgotten and built again when it comes next. Only paths that a batch has are
touched, whatever the number of paths that are known.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "path string, content_hash string, action string, seen long"
#: The store that state with times to live needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Builds(StatefulProcessor):
    """For each path of a batch one row: its latest content, `build` or `skip`, and how many versions the batch had."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content_hash string", self.ttl or None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        latest, seen = None, 0
        for row in rows:
            seen += 1
            version = row["mtime"], row["content_hash"]
            if latest is None or version > latest:
                latest = version
        held = self.last.get()
        same = held is not None and held[0] == latest[1]
        if not same:
            self.last.update((latest[1],))
        yield Row(path=key[0], content_hash=latest[1], action="skip" if same else "build", seen=seen)

    def close(self) -> None:
        pass


def decisions(stream: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """(path, content_hash, action, seen) of a stream of path, content_hash and mtime; 0 seconds: nothing is forgotten."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.select("path", F.coalesce("content_hash", F.lit("")).alias("content_hash"), F.coalesce(F.unix_micros("mtime"), F.lit(0)).alias("mtime"))
    return rows.groupBy("path").transformWithState(Builds(ttl_seconds), OUTPUT, "Append", "ProcessingTime")


def decide(stream: DataFrame, folder: str, checkpoint: str, ttl_seconds: int = 3600):
    """A query that appends decisions to a table in `folder`; it takes what is there in one batch and ends.

    (Times to live ask for batches without rows, so a trigger that runs until nothing is left would not end.)
    """
    return decisions(stream, ttl_seconds).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(once=True).start()


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of path, content_hash and mtime from a growing table of Parquet files."""
    return spark.readStream.schema("path string, content_hash string, mtime timestamp").parquet(folder)
