"""Single constructs by expressions where a source proves itself flat, by the parser elsewhere; both together give what the parser gives.

A source is flat if it has no macros, comments, formulas or verbatim text, no
group within a group or an option, no environment but those whose contents are
read in place, and as many closing braces as opening ones, in order. In such a
source a command stands where it is written, and its argument holds no braces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.operators import nodes

#: Environments whose contents are read in place.
IN_PLACE = ("document", "center", "quote", "quotation", "abstract", "flushleft", "flushright")
#: Constructs: the commands that make them, the node's kind, and the column that holds the argument.
CONSTRUCTS = {
    "label": (("label",), "Label", "text"), "caption": (("caption",), "Caption", "text"), "footnote": (("footnote", "thanks"), "Footnote", "text"), "image": (("includegraphics",), "Image", "path"),
    "reference": (("ref", "eqref", "autoref", "nameref", "cref", "Cref", "footref"), "Ref", "text"), "section": (("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph"), "Section", "text"),
}


def flat(tex: Column) -> Column:
    """Whether a source is flat; a null one is."""
    names = F.regexp_extract_all(tex, F.lit(r"\\(?:begin|end)\s*\{([^{}]*)\}"), F.lit(1))
    known = F.size(F.array_except(names, F.array(*map(F.lit, IN_PLACE)))) == 0
    once = F.size(F.filter(names, lambda n: n == "document")).isin(0, 2)
    out = known & once
    for odd in (
        r"[%$]|\\(?:newcommand|renewcommand|providecommand|def|let|newacronym|newglossaryentry|verb|lstinline|caption\*|texorpdfstring)(?![A-Za-z])|\\[(\[{}\\]",
        r"\{[^{}]*\{|\}[^{}]*\}|^[^{]*\}|\{[^{}]*$",  # a group in a group, or one that isn't closed
        r"\[[^\]]*[{}\\]|\[[^\]]*$",
        r"\\(?:begin|end)(?![A-Za-z])\s*[^{\s]|(?s)\\begin\{document\}.*\\begin\{document\}|\\end\{document\}.*\\",
        r"(?s)^(?=.*\\begin\{document\}).*\\(?:label|caption|footnote|thanks|includegraphics|ref|eqref|autoref|nameref|cref|Cref|footref|part|chapter|(?:sub)*section|(?:sub)?paragraph)(?![A-Za-z]).*\\begin\{document\}",
    ):
        out = out & ~tex.rlike("(?s)" + odd)
    return F.coalesce(out, F.lit(True))


def by_expression(docs: DataFrame, construct: str, text: str = "tex", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, idx and value of a construct in flat sources."""
    commands = "|".join(CONSTRUCTS[construct][0])
    value = lambda v: F.trim(v) if construct == "image" else F.translate(v, "~", " ") if construct == "section" else v
    found = F.regexp_extract_all(F.col(text), F.lit(rf"\\(?:{commands})(?![A-Za-z])\*?\s*(?:\[[^\]]*\])?\s*\{{([^{{}}]*)\}}"), F.lit(1))
    return docs.select(*keys, F.posexplode(F.transform(found, value)).alias("idx", "value"))


def by_parser(docs: DataFrame, construct: str, text: str = "tex", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    _, kind, column = CONSTRUCTS[construct]
    rows = nodes.nodes(docs, text=text, keys=keys, kinds=(kind,), columns=("node_id", column))
    return rows.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("node_id")) - 1).alias("idx"), F.col(column).alias("value"))


def extract(docs: DataFrame, construct: str, text: str = "tex", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys, idx and value: a construct in any sources, each read by the cheaper way that it allows; keys must differ."""
    fits = flat(F.col(text))
    return by_expression(docs.where(fits), construct, text, keys).unionByName(by_parser(docs.where(~fits), construct, text, keys))


def citations(docs: DataFrame, text: str = "tex", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Keys and `key`: cited keys, by both ways."""
    from quire.functions import parser

    fits = flat(F.col(text))
    commands = "|".join(sorted(parser.CITES, key=len, reverse=True))
    found = F.regexp_extract_all(F.col(text), F.lit(rf"\\(?:{commands})(?![A-Za-z])\*?\s*(?:\[[^\]]*\]\s*){{0,2}}\{{([^{{}}]*)\}}"), F.lit(1))
    fast = docs.where(fits).select(*keys, F.explode(F.flatten(F.transform(found, C.split_keys))).alias("key"))
    slow = nodes.nodes(docs.where(~fits), text=text, keys=keys, kinds=("Citation",), columns=("keys",)).select(*keys, F.explode("keys").alias("key"))
    return fast.unionByName(slow)
