"""Documents to the table of their nodes, and the relations read from it.

All Python work on a document happens in one map over Arrow batches; equal
sources of a batch are parsed once. A document that can't be read ends the job
with its key and the cause, as without its nodes it would look like an empty
one. `findings` goes on and has a row that says why, so that such documents can
be set aside.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import analysis, macros, mathfmt, mathml, parser, render
from quire.operators import serialise

ROW = T.StructType([T.StructField("cells", T.ArrayType(T.StringType())), T.StructField("is_separator", T.BooleanType())])
ENTRY = T.StructType([T.StructField("key", T.StringType()), T.StructField("text", T.StringType())])
_TYPES = {
    **dict.fromkeys(("node_id", "parent_id", "subtree_end", "depth", "slot_idx", "ordinal", "level"), T.IntegerType()),
    "ordered": T.BooleanType(), **dict.fromkeys(("args", "keys", "lines", "columns"), T.ArrayType(T.StringType())), "rows": T.ArrayType(ROW), "bib": T.ArrayType(ENTRY), "starts": T.ArrayType(T.IntegerType()),
}
NODE = T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in parser.COLUMNS])
FINDING = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())] + [T.StructField(c, T.StringType()) for c in ("severity", "message", "code")])
SYMBOL = T.StructType([T.StructField(c, T.IntegerType()) for c in ("symbol_id", "parent_id", "depth")] + [T.StructField(c, T.StringType()) for c in ("name", "kind")] + [T.StructField(c, T.IntegerType()) for c in ("start", "end")])
ELEMENT = T.StructType([T.StructField("element_id", T.IntegerType()), T.StructField("element", T.StringType()), T.StructField("text", T.StringType()), T.StructField("term", T.StringType())] + [T.StructField(c, T.IntegerType()) for c in ("level", "depth", "number", "columns")] + [T.StructField("segments", T.ArrayType(T.StringType()))])


class Unreadable(ValueError):
    """A text that can't be read: the keys of its row, and the cause."""


def rows_of(docs: DataFrame, make: Callable[[str], list], added: T.StructType, text: str = "tex", keys: tuple[str, ...] = ("doc_id",), failed: Callable[[Exception], list] | None = None) -> DataFrame:
    """Each row's keys with each of the rows that `make` gives for its text; null reads as empty.

    A text on which `make` raises ends the job as `Unreadable`, so that no failure looks like a text without rows. Only where
    `failed` is given does the job go on, with the rows that it gives for such a text; they have to say that it failed.
    """
    schema = T.StructType([docs.schema[k] for k in keys] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        kinds = [target.field(k).type for k in range(len(keys), len(target))]
        for batch in batches:
            known: dict[str, list] = {}
            column = batch.column(len(keys)).to_pylist()
            step = 256
            for first in range(0, len(column), step):
                places, made = [], []
                for k, source in enumerate(column[first : first + step], first):
                    if source not in known:
                        try:
                            known[source] = make(source or "")
                        except Exception as e:
                            if failed is None:
                                row = ", ".join(f"{name}={batch.column(i)[k].as_py()}" for i, name in enumerate(keys))
                                raise Unreadable(f"{row}: {type(e).__name__}: {e}") from e
                            known[source] = failed(e)
                    places += [k] * len(known[source])
                    made += known[source]
                columns = list(zip(*made)) if made else [[] for _ in kinds]
                held = [batch.column(i).take(pa.array(places, pa.int64())).cast(target.field(i).type) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*held, *(pa.array(list(c), kind) for c, kind in zip(columns, kinds))], schema=target)

    return docs.select(*keys, F.col(text)).mapInArrow(run, schema)


def mapped(docs: DataFrame, make: Callable[[str], object], name: str, kind: T.DataType, text: str = "tex", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Each row's keys with one value made of its text; one of which none can be made ends the job, see `rows_of`."""
    return rows_of(docs, lambda s: [(make(s),)], T.StructType([T.StructField(name, kind)]), text, keys)


_PLACE = {c: k for k, c in enumerate(parser.COLUMNS)}
#: What turns the tuples of a column into structs.
_STRUCTS = {
    "rows": lambda rows: rows and [{"cells": cells, "is_separator": rule} for cells, rule in rows],
    "bib": lambda entries: entries and [{"key": key, "text": text} for key, text in entries],
}


def nodes(docs: DataFrame, plugins: tuple = (), text: str = "tex", keys: tuple[str, ...] = ("doc_id",), kinds: tuple[str, ...] = (), columns: tuple[str, ...] = (), forms: bool = False) -> DataFrame:
    """The node table: one row for each node of each document, in pre-order.

    No filter or projection passes the map by itself: `kinds` and `columns` tell it which rows and columns are asked for.
    With `forms`, each of a formula's lines (or its text) stands beside it as `unicode` and as `mathml`.
    """
    wanted, picked = frozenset(kinds) or None, columns or parser.COLUMNS
    places = [(_PLACE[c], _STRUCTS.get(c)) for c in picked]
    for plugin in plugins:
        plugin.on_load()

    def make(source: str) -> list[tuple]:
        rows = parser.flatten(transformed(parser.parse(source, plugins), plugins), wanted)
        return [tuple(r[k] if f is None else f(r[k]) for k, f in places) + (_forms(r) if forms else ()) for r in rows]

    added = [T.StructField(c, T.ArrayType(T.StringType())) for c in ("unicode", "mathml") if forms]
    return rows_of(docs, make, T.StructType([NODE[c] for c in picked] + added), text, keys)


def _forms(row: tuple) -> tuple[list[str] | None, list[str] | None]:
    kind = row[_PLACE["kind"]]
    if kind not in ("MathInline", "MathDisplay", "MathLines"):
        return None, None
    lines, shown = (row[_PLACE["lines"]] if kind == "MathLines" else [row[_PLACE["text"]]]), mathml.inline if kind == "MathInline" else mathml.display
    return [mathfmt.to_unicode(x) for x in lines], [shown(x) for x in lines]


def transformed(made: list, plugins: tuple) -> list:
    """The tree as the plugins' `transform` leave it, in order."""
    for plugin in plugins:
        made = plugin.transform(made)
    return made


def candidates(docs: DataFrame, *commands: str, text: str = "tex") -> DataFrame:
    """Documents that can hold one of the commands: they spell it, or define macros that might."""
    found = F.col(text).rlike(r"\\(?:newcommand|renewcommand|providecommand|def|let)(?![A-Za-z])")
    for command in commands:
        found = found | F.contains(F.col(text), F.lit("\\" + command))
    return docs.where(found)


# relations

def sections(table: DataFrame) -> DataFrame:
    return table.where("kind = 'Section'").select("doc_id", "node_id", "level", F.col("text").alias("title"))


def citations(table: DataFrame) -> DataFrame:
    return table.where("kind = 'Citation'").select("doc_id", "node_id", F.col("name").alias("cite_kind"), F.posexplode("keys").alias("key_idx", "key"))


def labels(table: DataFrame) -> DataFrame:
    return table.where("kind = 'Label'").select("doc_id", "node_id", F.col("text").alias("key"))


def references(table: DataFrame) -> DataFrame:
    return table.where("kind in ('Ref', 'PageRef')").select("doc_id", "node_id", F.col("name").alias("command"), F.col("text").alias("key"))


def table_cells(table: DataFrame) -> DataFrame:
    rows = table.where("kind = 'Table'").select("doc_id", "node_id", F.posexplode("rows").alias("row_idx", "row")).where("not row.is_separator")
    return rows.select("doc_id", "node_id", "row_idx", F.posexplode("row.cells").alias("col_idx", "value"))


def bibliography(table: DataFrame) -> DataFrame:
    """Entries with their numbers."""
    return table.where("kind = 'Bibliography'").select("doc_id", "node_id", F.posexplode("bib").alias("k", "entry")).select("doc_id", "node_id", (F.col("k") + 1).alias("number"), "entry.key", "entry.text")


def children_of(table: DataFrame, kind: str) -> DataFrame:
    """Direct children of nodes of a kind, beside their parents."""
    parents = table.where(F.col("kind") == kind).select("doc_id", F.col("node_id").alias("parent_id"), F.col("name").alias("parent_name"), F.col("label").alias("parent_label"), F.col("args").alias("parent_args"), F.col("depth").alias("parent_depth"), F.col("ordered").alias("parent_ordered"))
    return table.join(parents, ["doc_id", "parent_id"])


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, node_id, term, body): text of the items of descriptions, with their terms. Documents are parsed once."""
    rows = nodes(docs, kinds=("DescriptionList", "Text"), columns=("node_id", "parent_id", "kind", "slot", "slot_idx", "args", "text"))
    own = F.when(F.col("kind") == "DescriptionList", F.col("node_id")).otherwise(F.col("parent_id"))
    terms = F.max(F.when(F.col("kind") == "DescriptionList", F.col("args"))).over(Window.partitionBy("doc_id", "list"))
    rows = rows.withColumn("list", own).withColumn("terms", terms).where("kind = 'Text' and slot = 'desc'")
    return rows.select("doc_id", "node_id", F.get("terms", F.col("slot_idx")).alias("term"), F.col("text").alias("body"))


def texts_within(table: DataFrame, kind: str) -> DataFrame:
    """Concatenated text of each node of a kind, without pairs of nodes: see `serialise.contents`."""
    return serialise.contents(table, kind)


def texts_of(docs: DataFrame, *kinds: str, text: str = "tex") -> DataFrame:
    """As `texts_within`, of several kinds and straight from the documents: each is parsed once, and nothing is joined."""
    fields = [NODE[c] for c in ("node_id", "kind", "name", "label")] + [T.StructField("text", T.StringType())]

    def make(source: str) -> list[tuple]:
        rows = parser.flatten(parser.parse(source), frozenset((*kinds, "Text")))
        texts = [r for r in rows if r[_PLACE["kind"]] == "Text"]
        ids = [r[_PLACE["node_id"]] for r in texts]
        inner = lambda r: texts[bisect_left(ids, r[_PLACE["node_id"]]) : bisect_left(ids, r[_PLACE["subtree_end"]])]
        return [(*(r[_PLACE[c]] for c in ("node_id", "kind", "name", "label")), "".join(x[_PLACE["text"]] for x in inner(r))) for r in rows if r[_PLACE["kind"]] in kinds]

    return rows_of(docs, make, T.StructType(fields), text)


def resolved_references(docs: DataFrame) -> DataFrame:
    """(doc_id, node_id, command, key, found): references, and whether a label of their document has their key. Documents are parsed once."""
    rows = nodes(docs, kinds=("Label", "Ref", "PageRef"), columns=("node_id", "kind", "name", "text"))
    held = F.max(F.col("kind") == "Label").over(Window.partitionBy("doc_id", "text"))
    return rows.withColumn("found", held).where("kind <> 'Label'").select("doc_id", "node_id", F.col("name").alias("command"), F.col("text").alias("key"), "found")


def resolved_citations(docs: DataFrame) -> DataFrame:
    """(doc_id, node_id, key, number): cited keys, and the number of the entry that their document has for them, or null. Documents are parsed once."""
    rows = nodes(docs, kinds=("Citation", "Bibliography"), columns=("node_id", "keys", "bib"))
    one = lambda key, number: F.struct(key.alias("key"), number.cast("int").alias("entry"))
    pairs = F.coalesce(F.transform("keys", lambda k: one(k, F.lit(None))), F.transform("bib", lambda e, i: one(e["key"], i + 1)))
    rows = rows.select("doc_id", "node_id", F.explode(pairs).alias("p")).select("doc_id", "node_id", "p.*")
    number = F.min("entry").over(Window.partitionBy("doc_id", "key")).alias("number")
    return rows.select("doc_id", "node_id", "key", "entry", number).where("entry is null").drop("entry")


def math_spans(table: DataFrame) -> DataFrame:
    """Formulas: inline nodes, and spans that stay inside running text."""
    inside = table.where("kind = 'Text'").select("doc_id", "node_id", F.explode(F.regexp_extract_all("text", F.lit(r"\$([^$]*)\$"), F.lit(1))).alias("formula"))
    return inside.unionByName(table.where("kind = 'MathInline'").select("doc_id", "node_id", F.col("text").alias("formula")))


def metadata(table: DataFrame) -> DataFrame:
    """Title, author and date: the last command of each counts."""
    rows = table.where("kind = 'Command' and depth = 0 and name in ('title', 'author', 'date')").select("doc_id", "node_id", "name", F.col("args")[0].alias("value"))
    pick = lambda n: F.max_by("value", F.when(F.col("name") == n, F.col("node_id"))).alias(n)
    return rows.groupBy("doc_id").agg(pick("title"), pick("author"), pick("date"))


# whole documents

def findings(docs: DataFrame, compat: bool = False) -> DataFrame:
    """What is wrong with each document; one that can't be read at all has a finding `unreadable`."""

    def make(source: str) -> list[tuple]:
        parser.parse(source)
        return [tuple(f.values()) for f in analysis.findings(source, compat)]

    return rows_of(docs, make, FINDING, failed=lambda e: [(0, 0, "error", f"{type(e).__name__}: {e}", "unreadable")])


def outline(docs: DataFrame) -> DataFrame:
    """Symbols of each document, with the name of the one above as `parent`."""

    def make(source: str) -> list[tuple]:
        found = analysis.outline(source)
        names = {x["symbol_id"]: x["name"] for x in found}
        return [(*x.values(), names.get(x["parent_id"])) for x in found]

    return rows_of(docs, make, T.StructType([*SYMBOL, T.StructField("parent", T.StringType())]))


def expanded(docs: DataFrame) -> DataFrame:
    return mapped(docs, macros.expand, "expanded", T.StringType())


def html(docs: DataFrame, today: str = "", whole: bool = False) -> DataFrame:
    make = render.page if whole else render.html
    return mapped(docs, lambda s: make(parser.parse(s), today), "html", T.StringType())


def plain_text(docs: DataFrame) -> DataFrame:
    return mapped(docs, lambda s: render.plain(parser.parse(s)), "plain", T.StringType())


def layout(docs: DataFrame, today: str = "", most: int = 5000) -> DataFrame:
    """Elements of a page. A document with more than `most` of them is an error of its own kind, in one row; one that can't be laid out ends the job."""
    names = [f.name for f in ELEMENT.fields[1:]]

    def make(source: str) -> list:
        made = render.layout(parser.parse(source), today)
        if len(made) > most:
            return [(0, "error", f"element count {len(made)} exceeds limit {most}", *[None] * 6)]
        return [(k, *(x.get(n) for n in names)) for k, x in enumerate(made)]

    return rows_of(docs, make, ELEMENT)


def ast_json(docs: DataFrame) -> DataFrame:
    return mapped(docs, lambda s: render.ast_json(parser.parse(s)), "ast", T.StringType())


def packaged(docs: DataFrame, form: str, today: str = "") -> DataFrame:
    """Whole documents of a format, as bytes."""
    makers = {"html": lambda n: render.page(n, today).encode(), "docx": render.docx, "epub": lambda n: render.epub(n, today)}
    make = makers[form]
    return mapped(docs, lambda s: make(parser.parse(s)), "content", T.BinaryType())


def math_unicode(rows: DataFrame, text: str = "tex") -> DataFrame:
    return mapped(rows, mathfmt.to_unicode, "unicode", T.StringType(), text)


def math_mathml(rows: DataFrame, text: str = "tex", display: bool = False) -> DataFrame:
    return mapped(rows, mathml.display if display else mathml.inline, "mathml", T.StringType(), text)


def unknown(docs: DataFrame) -> DataFrame:
    """Names of commands and environments that nothing reads."""

    def make(source: str) -> list:
        p = parser.Parser(macros.expand(source))
        p.document()
        return [(n,) for n in p.unknown]

    return rows_of(docs, make, T.StructType([T.StructField("name", T.StringType())]))


