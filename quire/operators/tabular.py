"""Tables of TeX read by column expressions alone.

Only documents whose source proves that nothing in it needs the parser are read
so: no macros, comments, verbatim text, plugins or unknown environments, and no
table inside an argument or a formula. `tables` reads these by expressions and
all others by the parser, so the two together give what the parser gives.

A body is split into lines and at row ends, then into cells; marks within
braces (to three levels) are put aside before and back after. What spans
columns is padded with empty cells. Specifications are cleared of widths and
decorations, then `*{n}{...}` is spelt out from the inside (to three levels).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import nodes

#: Environments among which tables are found, and those that are tables.
AROUND = ("document", "table", "table*", "center", "quote", "quotation", "abstract", "flushleft", "flushright")
TABLES = ("tabular", "tabular*", "tabularx", "longtable", "longtable*")
ALIGN = {"l": "left", "c": "center", "r": "right", "X": "left", "p": "left", "m": "left", "b": "left"}
#: Stand for a cell's end, a row's end and a decoration while they are put aside; a source that holds one goes to the parser.
_CELL, _ROW = "\ue000", "\ue001"
_FLAT = r"(?:\\.|[^{}\\])*"
_TWO = rf"(?:\\.|[^{{}}\\]|\{{{_FLAT}\}})*"
_THREE = rf"(?:\\.|[^{{}}\\]|\{{{_TWO}\}})*"
_RULE = r"^\\(?:toprule|midrule|bottomrule|hline|cline|cmidrule)(?![A-Za-z])"
_SPAN = rf"(?s)^\\multicolumn(?![A-Za-z])\s*\{{\s*(\d+)\s*\}}\s*\{{{_THREE}\}}\s*\{{({_THREE})\}}.*$"
_LINES = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"
#: White space (fixed values).
_BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _trim(text: Column) -> Column:
    return F.trim(text, F.lit(_BLANKS))


def readable(tex: Column) -> Column:
    """Whether the tables of a source can be read by expressions."""
    odd = [
        r"\\(?:newcommand|renewcommand|providecommand|def|let|newacronym|newglossaryentry|verb|lstinline|item|bibitem)(?![A-Za-z])|[%$\ue000\ue001]|\\[(\[]",
        rf"\{{{_TWO}\\begin",  # in an argument or a group
        r"\\(?:begin|end)\s+\{|\\(?:begin|end)\{[^}]*[^A-Za-z*}][^}]*\}|\\(?:begin|end)(?!\{|[A-Za-z])",
        rf"\{{{_FLAT}\{{{_FLAT}\{{{_FLAT}\{{{_FLAT}\{{",  # groups of more than four levels
    ]
    names = F.regexp_extract_all(tex, F.lit(r"\\begin\{([^}]*)\}"), F.lit(1))
    ends = F.regexp_extract_all(tex, F.lit(r"\\end\{([^}]*)\}"), F.lit(1))
    known = F.size(F.array_except(names, F.array(*map(F.lit, AROUND + TABLES)))) == 0
    plain = F.regexp_replace(tex, r"\\.", "")
    even = F.length(F.replace(plain, F.lit("{"), F.lit(""))) == F.length(F.replace(plain, F.lit("}"), F.lit("")))
    # Beginnings and ends in one order each: tables within tables, or ends that are missing, go to the parser.
    paired = (F.size(names) == F.size(ends)) & (F.size(F.regexp_extract_all(tex, F.lit(rf"(?s)\\begin\{{(?:{_TABLE})\}}(?:(?!\\(?:begin|end)\{{).)*\\end\{{(?:{_TABLE})\}}"), F.lit(0))) == F.size(F.filter(names, lambda n: n.isin(*TABLES))))
    once = F.size(F.filter(names, lambda n: n == "document")) <= 1
    inside = (F.size(F.filter(names, lambda n: n == "document")) == 0) | ~tex.rlike(rf"(?s)\\begin\{{(?:{_TABLE})\}}.*\\begin\{{document\}}|\\end\{{document\}}.*\\begin\{{")
    out = known & even & paired & once & inside
    for pattern in odd:
        out = out & ~tex.rlike("(?s)" + pattern)
    return F.coalesce(out, F.lit(True))


_TABLE = "|".join(t.replace("*", r"\*") for t in TABLES)


def _hidden(text: Column, back: bool = False) -> Column:
    """Marks within braces put aside, or back."""
    if back:
        return F.replace(F.replace(text, F.lit(_CELL), F.lit("&")), F.lit(_ROW), F.lit("\\\\"))
    # Group by group: what stands between braces is rewritten as one piece, all else stays.
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)\{{{_THREE}\}}|\\.|[^{{\\]+|."), F.lit(0))
    hide = lambda p: F.when(p.startswith("{"), F.replace(F.regexp_replace(p, r"\\\\", _ROW), F.lit("&"), F.lit(_CELL))).otherwise(p)
    return F.when(text.contains("{"), F.array_join(F.transform(pieces, hide), "")).otherwise(text)


def cells_of(text: Column) -> Column:
    """A trimmed cell, or as many as it spans: the first holds the contents."""
    n = F.regexp_extract(text, _SPAN, 1)
    content = _trim(_hidden(F.regexp_extract(text, _SPAN, 2), back=True))
    padded = F.concat(F.array(content), F.array_repeat(F.lit(""), F.greatest(n.try_cast("int"), F.lit(1)) - 1))
    plain = F.when(text.contains("\\"), F.replace(F.replace(text, F.lit("\\$"), F.lit("$")), F.lit("\\&"), F.lit("&"))).otherwise(text)
    whole = F.array(F.when(plain.contains("{"), _hidden(plain, back=True)).otherwise(plain))
    return F.when(text.startswith("\\multicolumn"), F.when(n != "", padded).otherwise(whole)).otherwise(whole)


def rows_of(body: Column) -> Column:
    """Array of (cells, is_separator) of a table's body."""
    parts = F.flatten(F.transform(F.split(body, _LINES), lambda line: F.split(_hidden(line), r"\\\\")))
    parts = F.filter(F.transform(parts, _trim), lambda p: p != "")

    def row(held: Column) -> Column:
        part, cells = held["part"], held["cells"]
        command = part.startswith("\\")
        rule = command & part.rlike(_RULE)
        made = F.when(rule, F.array().cast("array<string>")).when(F.size(cells) > 1, F.flatten(F.transform(F.transform(cells, _trim), cells_of)))
        made = made.when(command & part.rlike(r"^\\multicolumn(?![A-Za-z])"), cells_of(part))
        return F.struct(made.alias("cells"), rule.alias("is_separator"))

    # A lambda's argument is computed once, an expression as often as it stands there.
    parts = F.transform(parts, lambda p: F.struct(p.alias("part"), F.when(F.contains(p, F.lit("&")), F.split(p, r"(?<!\\)&")).alias("cells")))
    return F.filter(F.transform(parts, row), lambda r: r["cells"].isNotNull())


def columns_of(spec: Column) -> Column:
    """Alignments of a specification's columns."""
    plain = F.regexp_replace(spec, rf"[@!><]\s*\{{{_THREE}\}}", "")
    plain = F.regexp_replace(plain, rf"([pmb])\{{{_THREE}\}}", "$1")
    star = r"\*\s*\{\s*\d+\s*\}\s*\{[^{}*]*\}"
    for _ in range(3):
        pieces = F.regexp_extract_all(plain, F.lit(rf"{star}|[^*]+|\*"), F.lit(0))
        times = lambda p: F.regexp_extract(p, r"^\*\s*\{\s*(\d+)\s*\}", 1).cast("int")
        body = lambda p: F.regexp_extract(p, r"\{([^{}*]*)\}$", 1)
        plain = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{star}$"), F.repeat(body(p), times(p))).otherwise(p)), "")
    letters = F.regexp_extract_all(plain, F.lit("[lcrXpmb]"), F.lit(0))
    names = F.create_map(*(F.lit(x) for pair in ALIGN.items() for x in pair))
    return F.transform(letters, lambda c: names[c])


def native_tables(docs: DataFrame, text: str = "tex", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, table_idx, name, columns and rows of the tables of documents that are `readable`."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?s)\\begin\{{(?:{_TABLE})\}}(?:(?!\\end\{{).)*\\end\{{"), F.lit(0))
    head = rf"(?s)^\\begin\{{([^}}]*)\}}(?:(?<=[x*]\}})(?<!longtable\*\}})\s*\{{{_THREE}\}})?\s*(?:\[[^\]]*\])?\s*(?:\{{({_THREE})\}})?(.*)\\end\{{$"
    rows = docs.select(*keys, F.posexplode(found).alias("table_idx", "_table"))
    parts = [F.regexp_extract("_table", head, k) for k in (1, 2, 3)]
    return rows.select(*keys, "table_idx", parts[0].alias("name"), columns_of(parts[1]).alias("columns"), rows_of(parts[2]).alias("rows"))


def parsed_tables(docs: DataFrame, text: str = "tex", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The same, of any documents, by the parser."""
    table = nodes.nodes(docs, text=text, keys=keys, kinds=("Table",), columns=("node_id", "name", "columns", "rows"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("node_id")) - 1
    return table.select(*keys, rank.alias("table_idx"), "name", "columns", "rows")


def tables(docs: DataFrame, text: str = "tex", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, table_idx, name, columns and rows of all tables, by the cheaper way that each document allows; keys must differ."""
    fits = readable(F.col(text))
    return native_tables(docs.where(fits), text, keys).unionByName(parsed_tables(docs.where(~fits), text, keys))
