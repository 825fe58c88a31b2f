"""Writers: outputs by format, and what lies between a source and its output."""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import macros, parser, render
from quire.operators import nodes

META = T.StructType([T.StructField("element_count", T.LongType()), T.StructField("title", T.StringType()), T.StructField("author", T.StringType())])


def meta(docs: DataFrame) -> DataFrame:
    """Count of top elements, title and author of each document."""

    def make(source: str) -> list:
        made = parser.parse(source)
        m = render.metadata(made)
        return [(len(made), m["title"], m["author"])]

    return nodes.rows_of(docs, make, META)


def outputs(docs: DataFrame, formats: tuple[str, ...], today: str = "") -> DataFrame:
    """(doc_id, format, content): every document in every format, parsed once for all of them."""
    makers = {"html": lambda n: render.page(n, today).encode(), "docx": render.docx, "epub": lambda n: render.epub(n, today), "txt": lambda n: render.plain(n).encode()}
    if unknown := [f for f in formats if f not in makers]:
        raise ValueError(f"no output format {unknown[0]}")

    def make(source: str) -> list:
        made = parser.parse(source)
        return [(f, makers[f](made)) for f in formats]

    return nodes.rows_of(docs, make, T.StructType([T.StructField("format", T.StringType()), T.StructField("content", T.BinaryType())]))


def write_outputs(docs: DataFrame, path: str, formats: tuple[str, ...], today: str = "") -> None:
    """Parquet parted by format; the bytes of each document are in `content`."""
    outputs(docs, formats, today).write.partitionBy("format").parquet(path)


def write_intermediates(docs: DataFrame, path: str) -> None:
    """Expanded sources, trees and summaries, as three tables of JSON lines."""
    nodes.mapped(docs, macros.expand, "expanded", T.StringType()).write.json(f"{path}/expanded")
    nodes.ast_json(docs).write.json(f"{path}/ast")
    meta(docs).withColumn("format", F.lit("html")).write.json(f"{path}/meta")


def write_sources(docs: DataFrame, folder: str) -> None:
    """One file for each row of (file, tex), a name within the folder and its text; files of the same name are replaced.

    Texts are written by tasks; the driver renames the files, one after another.
    """
    spark = docs.sparkSession
    made = f"{folder.rstrip('/')}/.made-{uuid.uuid4().hex}"
    docs.select("file", "tex").repartition("file").write.partitionBy("file").text(made)
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in system.listStatus(path(made)):
        name = entry.getPath().getName()
        if name.startswith("file="):
            parts = [p.getPath() for p in system.listStatus(entry.getPath()) if not p.getPath().getName().startswith((".", "_"))]
            target = path(f"{folder.rstrip('/')}/{unquote(name[5:])}")
            system.mkdirs(target.getParent())
            system.delete(target, False)
            system.rename(parts[0], target)
    system.delete(path(made), True)
