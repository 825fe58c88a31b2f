"""The parser as a table function of SQL: `FROM documents, LATERAL tex_parse(tex)`.

    SELECT d.doc_id, n.level, n.text FROM documents d, LATERAL tex_parse(d.tex, 'Section') n

`tex_parse(tex, kinds)` gives the rows of the node table; `kinds`, a constant of
names parted by commas, keeps those kinds alone and narrows the columns to the
ones that they fill. A null source reads as empty, and one that can't be read
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quire.functions import parser
from quire.operators.nodes import _PLACE, _STRUCTS, NODE

#: Places of a node, which every row has, and what nodes of some kinds hold besides; of other kinds all columns are given.
PLACES = ("node_id", "parent_id", "subtree_end", "depth", "slot", "slot_idx", "ordinal", "kind")
HOLDS = {
    "Section": ("name", "level", "text"), "Citation": ("name", "keys"), "Label": ("text",), "Ref": ("name", "text"), "PageRef": ("name", "text"), "Text": ("text",), "Caption": ("text",),
    "Footnote": ("text",), "CodeBlock": ("name", "text"), "Image": ("path", "width", "height"), "Table": ("name", "columns", "rows"), "Bibliography": ("bib",), "MathInline": ("text",),
    "MathDisplay": ("text",), "MathLines": ("name", "lines"), "ColoredText": ("name", "text"), "Command": ("name", "args"), "Theorem": ("name", "label", "starts"), "ItemList": ("name", "args", "ordered", "starts"),
}


def columns_of(kinds: frozenset[str]) -> tuple[str, ...]:
    if not kinds or not kinds <= HOLDS.keys():
        return parser.COLUMNS
    held = {c for k in kinds for c in HOLDS[k]}
    return PLACES + tuple(c for c in parser.COLUMNS if c in held)


def _kinds(value: str | None) -> frozenset[str]:
    return frozenset(k.strip() for k in (value or "").split(",") if k.strip())


class TexParse:
    @staticmethod
    def analyze(tex: AnalyzeArgument, kinds: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(tex.dataType, (T.StringType, T.NullType)):
            raise ValueError("tex_parse reads a string")
        if kinds is not None and not kinds.isConstantExpression:
            raise ValueError("the kinds of tex_parse are a constant")
        return AnalyzeResult(T.StructType([NODE[c] for c in columns_of(_kinds(kinds.value if kinds else None))]))

    def eval(self, tex: str | None, kinds: str | None = None) -> Iterator[tuple]:
        wanted = _kinds(kinds)
        try:
            rows = parser.flatten(parser.parse(tex or ""), wanted or None)
        except Exception:  # one document's fault stops no job
            return
        places = [(_PLACE[c], _STRUCTS.get(c)) for c in columns_of(wanted)]
        for r in rows:
            yield tuple(r[k] if f is None else f(r[k]) for k, f in places)


def register(spark: SparkSession) -> None:
    spark.udtf.register("tex_parse", udtf(TexParse, useArrow=True))
