"""Watching sources: files that change are read, and the documents that read them, at any depth, are built again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quire.functions import columns as C
from quire.functions import parser
from quire.operators import nodes
from quire.operators.shared import cut, scratch
from quire.sources import files

#: Seconds between looks.
INTERVAL = 1
#: What a build passes through, and how far it is then, in per cent.
STAGES = (("reading", 0), ("parsing", 30), ("building", 60), ("done", 100))
Report = Callable[[str, int], None]


def sources(spark: SparkSession, path: str, pattern: str = "*.tex") -> DataFrame:
    """A stream of (path, tex, mtime, content_hash) of new files under a folder, one row for each file.

    The text of a file that is no UTF-8 is null. A path is taken once: where files are written anew, `rebuilder` looks by itself.
    """
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return _texts(raw)


def _texts(raw: DataFrame) -> DataFrame:
    tex = F.try_validate_utf8(F.col("content").cast("string"))
    return raw.select("path", tex.alias("tex"), F.col("modificationTime").alias("mtime"), C.content_hash(tex).alias("content_hash"))


def ticks(spark: SparkSession) -> DataFrame:
    """A stream with a row in each batch: the clock of a watch that looks for itself."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()


def changed(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each content of a path once, within a watermark that bounds the state."""
    return stream.withWatermark("mtime", delay).dropDuplicatesWithinWatermark(["path", "content_hash"])


def watch(stream: DataFrame, build: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Calls `build` for each batch of changed sources; `once` takes what is there and ends."""
    writer = stream.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{INTERVAL} seconds")).start()


def wait(query: StreamingQuery, seconds: int = 600) -> None:
    """Until a query that takes what is there has ended; one that doesn't end in time is stopped, and that is an error."""
    if not query.awaitTermination(seconds):
        query.stop()
        raise TimeoutError(f"the stream did not end within {seconds} seconds")


def element_counts(docs: DataFrame) -> DataFrame:
    """(path, elements) of documents: what a rebuild reports."""
    return nodes.mapped(docs, lambda s: len(parser.parse(s)), "elements", T.IntegerType(), keys=("path",))


def readers(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """The paths of `seeds`, and all that read them, at any depth; `edges` has (path, file)."""
    seen = new = cut(seeds.select("path").distinct())
    while not new.isEmpty():
        above = edges.join(new.select(F.col("path").alias("file")), "file").select("path").distinct()
        new = cut(above.join(seen, "path", "left_anti"))
        seen = seen.unionByName(new)
    return seen


#: What is known of each file, by batch: `held` is the batch that its text was written in, null where the file is gone.
_MANIFEST = "path string, mtime timestamp, length long, content_hash string, held int, batch int"
_SOURCES = "path string, tex string, batch int"
_PLACES = "path string, base_dir string, call string, name string, rank int, file string, batch int"


def _latest(log: DataFrame, number: int) -> DataFrame:
    """Of each path what the last batch before this one says; paths that are gone are left out."""
    return log.where(F.col("batch") < number).groupBy("path").agg(F.max_by(F.struct("mtime", "length", "content_hash", "held"), "batch").alias("m")).select("path", "m.*").where("held is not null")


def rebuilder(spark: SparkSession, raw: str, folder: str, make: Callable[[DataFrame], DataFrame] = element_counts, report: Report | None = None, pattern: str = "*.tex") -> Callable[[DataFrame, int], None]:
    """A `build` for a watch by `ticks`: looks for sources under `raw` that have come, changed or gone, and writes what `make` makes
    of the documents that this reaches, with all they read in place, to `folder`/out; documents that are gone, to `folder`/gone.

    A listing is held against a manifest of what is known: a file of another time or length, be it older or newer, is opened, and
    one of another content counts as changed. Where names are looked for is kept for each source, so only the changed ones are
    scanned for names, and readers are found by joins with what has changed; texts are written once, when they change. A document
    is a source that no other one reads; names are looked for in the reader's folder and in `raw`.

    Manifest, sources, places and outputs are logs parted by batch, overwritten if a batch is taken again, so a restart repeats
    nothing. What a batch needs in between is deleted with it. `report` is told of each stage.
    """
    tell = report or (lambda stage, percent: None)
    top = spark._jvm.org.apache.hadoop.fs.Path(raw)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()

    def log(name: str, schema: str, number: int) -> DataFrame:
        none = spark.createDataFrame([], schema)
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return spark.read.schema(schema).parquet(f"{folder}/{name}").where(F.col("batch") <= number) if there else none

    def write(frame: DataFrame, name: str, number: int) -> None:
        frame.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    def build(_: DataFrame, number: int) -> None:
        tell(*STAGES[0])
        with scratch():
            batch(number)
        tell(*STAGES[3])

    def batch(number: int) -> None:
        known = cut(_latest(log("manifest", _MANIFEST, number), number))
        listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(raw)
        listing = cut(listed.select("path", F.col("modificationTime").alias("mtime"), "length"))
        gone = known.join(listing, "path", "left_anti")
        touched = cut(listing.join(known, ["path", "mtime", "length"], "left_anti"))
        if gone.isEmpty() and touched.isEmpty():
            return
        opened = _texts(listed.join(touched.select("path"), "path", "left_semi")).withColumn("length", F.octet_length("tex").cast("long"))
        opened = cut(opened.drop("mtime", "length").join(touched, "path").join(known.select("path", F.col("content_hash").alias("before"), "held"), "path", "left"))
        new = opened.where("before is null or not (content_hash <=> before)")
        rows = opened.select("path", "mtime", "length", "content_hash", F.when(F.col("content_hash").eqNullSafe(F.col("before")) & F.col("held").isNotNull(), F.col("held")).otherwise(number).alias("held"))
        lost = gone.select("path", F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("long").alias("length"), F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("int").alias("held"))
        write(rows.unionByName(lost), "manifest", number)
        seeds = cut(new.select("path").unionByName(gone.select("path")))
        if seeds.isEmpty():
            return
        write(new.select("path", "tex"), "sources", number)
        tell(*STAGES[1])
        write(files.input_places(new.select("path", "tex", F.regexp_replace("path", "/[^/]*$", "").alias("base_dir")), (top,)), "places", number)
        now = cut(_latest(log("manifest", _MANIFEST, number), number + 1).select("path", F.col("held").alias("batch")))
        # What holds of a source is what its last text says, so its older places fall to the join with the manifest.
        places = log("places", _PLACES, number).join(now, ["path", "batch"], "left_semi").drop("batch")
        texts = log("sources", _SOURCES, number).join(now, ["path", "batch"], "left_semi").withColumn("base_dir", F.regexp_replace("path", "/[^/]*$", ""))
        # What a changed source used to read may be read by none now, and so be a document.
        dropped = log("places", _PLACES, number).join(known.select("path", F.col("held").alias("batch")).join(seeds, "path"), ["path", "batch"], "left_semi").select(F.col("file").alias("path"))
        reached = readers(seeds, places.select("path", "file")).unionByName(dropped).distinct()
        held = files.resolved(places.join(reached.select(F.col("path").alias("file")), "file", "left_semi").select("path", "base_dir", "call", "name").distinct().join(places, ["path", "base_dir", "call", "name"]), now)
        read = held.where("file is not null").select(F.col("file").alias("path"))
        roots = texts.join(reached, "path", "left_semi").join(read, "path", "left_anti").select("path", "tex", "base_dir")
        tell(*STAGES[2])
        make(files.resolve_inputs(roots, texts.select("path", "tex"), (top,))).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
        write(gone.select("path"), "gone", number)

    return build
