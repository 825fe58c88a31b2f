"""Documents from files, the files they read, and the packages they need."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.operators.shared import cut

def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, tex, base_dir, mtime and content_hash of each file; a file is one row."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("tex"), F.col("_metadata.file_modification_time").alias("mtime"))
    return rows.withColumn("base_dir", F.regexp_replace("path", r"[^/]*$", "")).withColumn("content_hash", C.content_hash(F.col("tex")))


def read_bytes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): files that are no UTF-8 go to the errors and stop nothing."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("mtime"), "content", F.try_validate_utf8(F.col("content").cast("string")).alias("tex"))
    docs = rows.where("tex is not null").select("path", "tex", "mtime", C.content_hash(F.col("tex")).alias("content_hash"))
    return docs, rows.where("tex is null").select("path", F.lit("parse_error").alias("kind"), F.lit("invalid UTF-8").alias("message"))


def _with_ending(name: Column) -> Column:
    """`.tex` where a name has no ending; a leading `./` says nothing."""
    name = F.regexp_replace(name, r"^(?:\./)+", "")
    return F.when(name.rlike(r"\.[A-Za-z0-9]+$"), name).otherwise(F.concat(name, F.lit(".tex")))


def _joined(folder: Column, name: Column) -> Column:
    folder = F.regexp_replace(F.coalesce(folder, F.lit("")), r"/+$", "")
    return F.when((folder == "") | name.startswith("/"), name).otherwise(F.concat(folder, F.lit("/"), name))


def input_places(docs: DataFrame, search_paths: tuple[str, ...] = ()) -> DataFrame:
    """(path, base_dir, call, name, rank, file): each place where a name that a source reads is looked for, whether it has a file or not."""
    base = F.col("base_dir") if "base_dir" in docs.columns else F.lit("")
    edges = docs.select("path", F.coalesce(base, F.lit("")).alias("base_dir"), F.explode(C.input_calls(F.col("tex"))).alias("c")).select("path", "base_dir", "c.call", "c.name")
    plain = _with_ending(F.col("name"))
    places = F.array(_joined(F.col("base_dir"), plain), *(_joined(F.lit(p), plain) for p in search_paths), plain)
    return edges.select("*", F.posexplode(places).alias("rank", "file"))


def resolved(places: DataFrame, files: DataFrame) -> DataFrame:
    """(path, base_dir, call, name, file): of each name the first place that `files` (path) has, or null."""
    found = places.join(files.select(F.col("path").alias("file"), F.lit(True).alias("held")).distinct(), "file", "left")
    file = F.min_by("file", F.when(F.col("held"), F.col("rank"))).alias("file")
    return found.groupBy("path", "base_dir", "call", "name").agg(file, F.max("held").alias("held")).withColumn("file", F.when(F.col("held"), F.col("file"))).drop("held")


def input_edges(docs: DataFrame, files: DataFrame | None = None, search_paths: tuple[str, ...] = ()) -> DataFrame:
    """(path, base_dir, call, name, file): what each source reads.

    A name is looked for in `base_dir` (a column of `docs`; none is the top), in the search paths, and as it is; the first file
    that `files` (path) has counts. `file` is null where there is none. Without `files`, it is the name with its ending.
    """
    places = input_places(docs, search_paths)
    if files is None:
        return places.where(F.col("rank") == 1 + len(search_paths)).drop("rank")
    return resolved(places, files)


def _reached(docs: DataFrame, files: DataFrame, search_paths: tuple[str, ...]) -> DataFrame:
    """(base_dir, path, call, name, file, loops) of the calls within files that documents reach, at any depth; `loops` where the file reaches back."""
    edges = cut(input_edges(docs, files, search_paths))
    seen = cut(edges.where("file is not null").select("base_dir", F.col("file").alias("path")).distinct())
    new, inner = seen, None
    while not new.isEmpty():
        own = cut(input_edges(new.join(files, "path").select("path", "base_dir", "tex"), files, search_paths))
        inner = own if inner is None else inner.unionByName(own)
        more = own.where("file is not null").select("base_dir", F.col("file").alias("path")).distinct()
        new = cut(more.join(seen, ["base_dir", "path"], "left_anti"))
        seen = seen.unionByName(new)
    if inner is None:
        return edges.withColumn("loops", F.lit(False)).limit(0)
    links = cut(inner.where("file is not null").select("base_dir", F.col("path").alias("a"), F.col("file").alias("b")).distinct())
    paths, n = links, links.count()
    while n:  # steps double until no pair is new
        longer = paths.alias("x").join(paths.alias("y"), (F.col("x.base_dir") == F.col("y.base_dir")) & (F.col("x.b") == F.col("y.a")))
        paths = cut(paths.union(longer.select("x.base_dir", "x.a", "y.b")).distinct())
        if paths.count() == n:
            break
        n = paths.count()
    back = paths.select("base_dir", F.col("a").alias("file"), F.col("b").alias("path"), F.lit(True).alias("back"))
    loops = F.coalesce("back", F.lit(False)) | F.coalesce(F.col("file") == F.col("path"), F.lit(False))
    return inner.join(back, ["base_dir", "file", "path"], "left").withColumn("loops", loops).drop("back")


def unresolved_inputs(docs: DataFrame, files: DataFrame, search_paths: tuple[str, ...] = ()) -> DataFrame:
    """(path, name, reason): calls of documents, and of the files that they reach, that read as nothing: `missing`, or `loop` where a file reaches itself."""
    own = input_edges(docs, files, search_paths).where("file is null").select("path", "name", F.lit("missing").alias("reason"))
    inner = _reached(docs, files, search_paths).where("loops or file is null").select("path", "name", F.when(F.col("loops"), "loop").otherwise("missing").alias("reason"))
    return own.unionByName(inner).distinct()


def _spliced(docs: DataFrame, texts: DataFrame, mark: str) -> DataFrame:
    """Documents with their calls replaced by (path, base_dir, call, file, text), between marks that name the file.

    A call without a text, or within the marks of its own file, reads as nothing.
    """
    columns = docs.columns
    held = texts.groupBy("path", "base_dir").agg(F.map_from_entries(F.collect_list(F.struct("call", F.struct("file", "text")))).alias("held"))
    pattern = f"\x02{mark}:[^\x03]*\x03|\x04{mark}|{C.CALL}"
    tokens = F.regexp_extract_all("tex", F.lit(pattern), F.lit(0))

    def step(state: Column, token: Column) -> Column:
        opens, closes = token.startswith("\x02"), token.startswith("\x04")
        found = F.try_element_at("held", token)
        inside = F.array_contains(state["within"], found["file"])
        text = F.when(found.isNull() | inside, "").otherwise(F.concat(F.lit(f"\x02{mark}:"), found["file"], F.lit("\x03"), found["text"], F.lit(f"\x04{mark}")))
        text = F.when(token.startswith("\\include"), F.concat(F.lit("\\clearpage "), text, F.lit("\\clearpage "))).otherwise(text)
        within = F.when(opens, F.array_append(state["within"], F.regexp_extract(token, ":([^\x03]*)\x03$", 1)))
        within = within.when(closes, F.slice(state["within"], 1, F.greatest(F.size(state["within"]) - 1, F.lit(0)))).otherwise(state["within"])
        return F.struct(within.alias("within"), F.array_append(state["out"], F.when(opens | closes, token).otherwise(text)).alias("out"))

    empty = F.expr("cast(array() as array<string>)")
    out = F.aggregate(tokens, F.struct(empty.alias("within"), empty.alias("out")), step)["out"]
    whole = F.array_join(F.zip_with(F.split("tex", pattern, -1), out, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")
    return docs.join(held, ["path", "base_dir"], "left").withColumn("tex", whole).select(*columns)


def resolve_inputs(docs: DataFrame, files: DataFrame, search_paths: tuple[str, ...] = ()) -> DataFrame:
    """Documents (path, tex, base_dir if there is one, ...) with the texts of `files` (path, tex) put where calls name them, at any depth.

    Calls within files are resolved by the documents' folders. A file within itself and a name without a file read as nothing;
    `unresolved_inputs` tells of both. Each round is a join on the file's path for those documents alone that still name one,
    written to the shared folder, so work doesn't grow with the square of the depth. A document and all it reads must fit into a row.
    """
    given, mark = docs.columns, uuid.uuid4().hex[:12]
    base = F.coalesce("base_dir", F.lit("")) if "base_dir" in given else F.lit("")
    docs, names = docs.withColumn("base_dir", base), files.select("path")
    calls = F.size(C.input_calls(F.col("tex"))) > 0
    done, open_ = docs.where(~calls | F.col("tex").isNull()), docs.where(calls)
    while not open_.isEmpty():
        found = input_edges(open_, names, search_paths).join(files.select(F.col("path").alias("file"), F.col("tex").alias("text")), "file")
        made = cut(_spliced(open_, found, mark))
        done, open_ = done.unionByName(made.where(~calls)), made.where(calls)
    return done.withColumn("tex", F.regexp_replace("tex", f"\x02{mark}:[^\x03]*\x03|\x04{mark}", "")).select(*given)


def package_requests(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, name, file_name) of the packages that preambles ask for."""
    rows = docs.select("doc_id", F.posexplode(C.packages(F.col("tex"))).alias("ordinal", "file_name"))
    return rows.select("doc_id", "ordinal", C.stem(F.col("file_name")).alias("name"), "file_name")


def missing_packages(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests that a listing of files (file_name) doesn't hold; nothing is fetched from a network."""
    return requests.join(cache.select("file_name").distinct(), "file_name", "left_anti")
