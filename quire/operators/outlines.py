"""Nesting by windows: outlines, and brackets and environments without partners, from rows alone.

What a stack does row by row is found here by sorted windows of each document:
a heading's parent is the nearest one before it of a higher rank, so the last
one of each rank is carried along and the nearest of those above is taken; a
bracket's partner is the next one of its level, where levels are running sums
that start anew at each closing bracket that nothing opens. Work is a sort of
each document's marks, whatever their depth. Sources are dealt over as many
parts as their marks ask for: the bytes of a shuffle say little about them, as
sources are alike and pack well, while each mark becomes a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import nodes

#: Ranks of headings, from the part down; a chapter ranks above a section.
RANKS = 7
#: Marks of a task that sorts them, but for a document of more.
MARKS = 200_000


def outline(table: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, symbol_id, parent_id (-1: none), depth, name, kind and parent of headings and labels at the top of the node table (node_id, depth, kind, level, text)."""
    rows = table.where("depth = 0 and kind in ('Section', 'Label')")
    heading = F.col("kind") == "Section"
    order = Window.partitionBy(*keys).orderBy("node_id")
    rank = F.when(heading, F.when(F.col("level") == 0, 0).when(F.col("level") == 6, 1).otherwise(F.col("level") + 1))
    kind = F.when(~heading, "label").when((F.col("level") <= 1) | (F.col("level") == 6), "section").otherwise("subsection")
    name = F.when(heading, F.col("text")).otherwise(F.concat(F.lit("#"), "text"))
    rows = rows.select(*keys, "node_id", (F.row_number().over(order) - 1).alias("symbol_id"), name.alias("name"), kind.alias("kind"), rank.alias("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("rank") == r, F.struct("symbol_id", "name")), ignorenulls=True).over(before) for r in range(RANKS - 1)]
    rows = rows.select("*", *(x.alias(f"_{r}") for r, x in enumerate(last)))
    above = [F.when(F.col("rank") > r, F.col(f"_{r}")) for r in range(RANKS - 1)]
    parent = F.greatest(*above)
    # An ancestor of rank r is the last one of that rank, if nothing of a higher rank came after it.
    held = lambda r: above[r].isNotNull() & (above[r]["symbol_id"] > F.greatest(F.lit(-1), *(F.coalesce(above[q]["symbol_id"], F.lit(-1)) for q in range(r))))
    depth = sum((held(r).cast("int") for r in range(1, RANKS - 1)), above[0].isNotNull().cast("int"))
    return rows.select(*keys, "symbol_id", F.coalesce(parent["symbol_id"], F.lit(-1)).alias("parent_id"), depth.alias("depth"), "name", "kind", parent["name"].alias("parent"))


def headings(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`outline` of documents, which are parsed once."""
    return outline(nodes.nodes(docs, keys=keys, kinds=("Section", "Label"), columns=("node_id", "depth", "kind", "level", "text")), keys)


def dealt(docs: DataFrame, text: str, signs: str, keys: tuple[str, ...]) -> DataFrame:
    """Keys and text, whole documents dealt by key over parts of about `MARKS` of the characters `signs` (ASCII), which are counted first."""
    rows = docs.select(*keys, text)
    count = F.octet_length(text) - F.octet_length(F.translate(text, signs, ""))
    found = rows.agg(F.sum(count.cast("long"))).first()[0] or 0
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-found // MARKS)), *keys)


def marks(docs: DataFrame, shown: Column, pattern: str, keys: tuple[str, ...]) -> DataFrame:
    """Keys, pos, mark, start and end (bytes) of what matches, in order. The text isn't copied to the rows: gaps and marks are cut apart once, and offsets are running sums."""
    pairs = F.zip_with(F.split(shown, pattern, -1), F.regexp_extract_all(shown, F.lit(pattern), F.lit(0)), lambda gap, mark: F.struct(F.octet_length(gap).alias("gap"), mark.alias("mark")))
    rows = docs.select(*keys, F.posexplode(pairs).alias("pos", "m")).where("m.mark is not null").select(*keys, "pos", "m.gap", "m.mark")
    until = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.octet_length("mark")).over(until)
    return rows.select(*keys, "pos", "mark", (end - F.octet_length("mark")).cast("int").alias("start"), end.cast("int").alias("end"))


def matched(rows: DataFrame, opens: Column, keys: tuple[str, ...]) -> DataFrame:
    """Marks (keys, pos) with `opens`, `free` (a closing one that nothing opens) and `partner` (pos of the closing mark of an opening one, or null)."""
    order = Window.partitionBy(*keys).orderBy("pos")
    until = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("opens", opens).withColumn("_sum", F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(until))
    rows = rows.withColumn("_low", F.coalesce(F.min("_sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_low", F.least("_low", F.lit(0))).withColumn("free", ~F.col("opens") & (F.col("_sum") < F.col("_low")))
    # The sum before a free mark is as low as ever, so levels of later marks count from there.
    level = F.when(F.col("opens"), F.col("_sum")).otherwise(F.col("_sum") + 1)
    rows = rows.withColumn("_level", level)
    pair = Window.partitionBy(*keys, "_level", "free").orderBy("pos")
    follows = F.when(F.col("opens") & ~F.lead("opens").over(pair), F.lead("pos").over(pair))
    return rows.withColumn("partner", follows).drop("_sum", "_low", "_level")


def _findings(rows: DataFrame, keys: tuple[str, ...], *found: tuple[Column, str, Column]) -> DataFrame:
    """A finding for each mark of which one of (condition, code, message) holds: marks are read once for all of them."""
    made = F.lit(None)
    for holds, code, message in found[::-1]:
        made = F.when(holds, F.struct(message.alias("message"), F.lit(code).alias("code"))).otherwise(made)
    rows = rows.select(*keys, "start", "end", made.alias("_f")).where("_f is not null")
    return rows.select(*keys, "start", "end", F.lit("error").alias("severity"), "_f.message", "_f.code")


def environment_findings(docs: DataFrame, text: str = "tex", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings on environments that don't begin and end in pairs. All windows follow one shuffle by document."""
    pattern = r"\\(?:begin|end)\{[^}]*\}"
    rows = marks(dealt(docs, text, "{", keys), F.col(text), pattern, keys)
    rows = rows.withColumn("name", F.regexp_extract("mark", r"(?s)^\\(?:begin|end)\{([^}]*)\}$", 1))
    rows = matched(rows, F.startswith("mark", F.lit("\\begin")), keys)
    # What a closing mark closes: the mark before it on its level.
    rows = rows.withColumn("opened", F.lag(F.when(F.col("opens"), F.col("name"))).over(Window.partitionBy(*keys, F.coalesce("partner", F.when(~F.col("opens"), F.col("pos")))).orderBy("pos")))
    return _findings(
        rows, keys,
        (F.col("free"), "env-unmatched-end", F.concat(F.lit("\\end{"), "name", F.lit("} without matching \\begin{"), "name", F.lit("}"))),
        (F.expr("not opens and not free and opened <> name"), "env-mismatch", F.concat(F.lit("Environment mismatch: expected \\end{"), "opened", F.lit("}, found \\end{"), "name", F.lit("}"))),
        (F.expr("opens and partner is null"), "env-unclosed", F.concat(F.lit("Unclosed environment '"), "name", F.lit("'"))),
    )


def brace_findings(docs: DataFrame, text: str = "tex", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Findings on braces without a partner, outside of comments."""
    rows = marks(dealt(docs, text, "{}%", keys), F.col(text), r"%[^\n]*|[{}]", keys).where("mark in ('{', '}')")
    rows = matched(rows, F.col("mark") == "{", keys)
    return _findings(
        rows, keys,
        (F.col("free"), "unmatched-brace", F.lit("Unmatched closing brace '}'")),
        (F.expr("opens and partner is null"), "unclosed-brace", F.lit("Unclosed '{' — missing closing brace")),
    )


def lines_and_columns(docs: DataFrame, step: int, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, at, line, col and bytes of every `step`-th character offset and the end, in work that grows with the text.

    The text is cut into pieces once; line, column and byte offset are running sums over them, and no row holds more than a piece.
    """
    pieces = F.concat(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), F.array(F.lit("")))
    feeds = lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit("")))
    part = lambda p: F.struct(F.length(p).alias("chars"), F.octet_length(p).alias("bytes"), feeds(p).alias("lines"), F.length(F.substring_index(p, "\n", -1)).alias("tail"))
    rows = docs.where(F.col(text).isNotNull()).select(*keys, F.posexplode(F.transform(pieces, part)).alias("pos", "p")).select(*keys, "pos", "p.*")
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("chars", "bytes", "lines")}
    rows = rows.select(*keys, "pos", *(v.alias(c) for c, v in sums.items()), F.struct(F.col("chars").alias("n"), "tail").alias("own"), (F.col("lines") > 0).alias("cut"))
    # Characters since the last feed: the start of the line is where the last piece with a feed leaves off.
    start = F.last(F.when(F.col("cut"), F.col("chars") + F.col("own.n") - F.col("own.tail")), ignorenulls=True).over(before)
    rows = rows.withColumn("_start", F.coalesce(start, F.lit(0)))
    made = rows.select(*keys, F.col("chars").cast("int").alias("at"), F.col("lines").cast("int").alias("line"), (F.col("chars") - F.col("_start")).cast("int").alias("col"), F.col("bytes").cast("int").alias("bytes"))
    return made
