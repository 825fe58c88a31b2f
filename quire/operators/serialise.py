"""Trees written out as relations: fragments of text at places of the node table, gathered in order.

A node covers the interval [node_id, subtree_end) of its document. It gives an
opening fragment at its start and a closing one at its end; the items of a list
give theirs at the list's `starts`. What ends at a place comes before what
starts there, what ends deeper comes first, what starts deeper last. One
`listagg` within each document puts the fragments together; fragments are CASE
expressions over the node table's columns, so only parsing and the forms of
single formulas need Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.functions import dims, render

#: Columns of the node table that the fragments read.
READ = ("node_id", "subtree_end", "depth", "kind", "name", "level", "text", "args", "keys", "ordered", "label", "path", "width", "height", "rows", "bib", "starts")
LISTS = ("ItemList", "DescriptionList")
FORMULAS = ("MathInline", "MathDisplay", "MathLines")


def _case(of: Column, table: dict[str, Column | str], otherwise: Column | str | None = None) -> Column:
    out = None
    for value, made in table.items():
        made = F.lit(made) if isinstance(made, str) else made
        out = F.when(of == value, made) if out is None else out.when(of == value, made)
    return out if otherwise is None else out.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def _cat(*parts: Column | str) -> Column:
    """Parts one after another; null is empty."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


def _joined(values: Column, between: str = "") -> Column:
    return F.array_join(values, between)


def _event(pos: Column, phase: int | Column, order: Column, sub: int | Column, frag: Column) -> Column:
    held = {"pos": pos, "phase": phase, "ord": order, "sub": sub}
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).cast("int").alias(k) for k, v in held.items()), F.coalesce(frag, F.lit("")).alias("frag"))


def _events(opening: Column, closing: Column, item_open: Column, item_close: Column) -> Column:
    """The fragments of a node with their places; `item_open` and `item_close` may read `label`, that of the item."""
    depth = F.col("depth")
    own = F.array(_event(F.col("node_id"), 1, 2 * depth, 0, opening))
    end = F.when(closing.isNotNull(), F.array(_event(F.col("subtree_end"), 0, -2 * depth, 0, closing))).otherwise(F.array())
    after = lambda k: F.coalesce(F.get("starts", k + 1), F.col("subtree_end"))

    def item(start: Column, k: Column) -> Column:
        """An empty item is one fragment: before the item after it starts, or where the list ends."""
        last = start == F.col("subtree_end")
        whole = _event(start, F.when(last, 0).otherwise(1), F.when(last, -(2 * depth + 1)).otherwise(2 * depth + 1), k, _cat(item_open(k), item_close))
        return F.when(start == after(k), F.array(whole)).otherwise(F.array(_event(start, 1, 2 * depth + 1, k, item_open(k)), _event(after(k), 0, -(2 * depth + 1), k, item_close)))

    items = F.when(F.col("kind").isin(*LISTS), F.flatten(F.transform(F.coalesce("starts", F.array().cast("array<int>")), item))).otherwise(F.array().cast("array<struct<pos:int,phase:int,ord:int,sub:int,frag:string>>"))
    return F.concat(own, end, items)


def _parts(table: DataFrame) -> int:
    """As many parts as the nodes come in, so that their shuffle keeps tasks as small as those that made them, however well the rows pack."""
    return max(table.sparkSession.sparkContext.defaultParallelism, table.rdd.getNumPartitions())


def gathered(docs: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """doc_id and the text of each document; one without nodes has an empty one."""
    none = docs.select("doc_id", F.expr("named_struct('pos', -1, 'phase', 0, 'ord', 0, 'sub', 0, 'frag', '')").alias("e"))
    rows = events.unionByName(none).select("doc_id", F.struct("e.pos", "e.phase", "e.ord", "e.sub").alias("at"), "e.frag")
    return rows.repartition(_parts(events), "doc_id").groupBy("doc_id").agg(F.expr("listagg(frag, '') WITHIN GROUP (ORDER BY at)").alias(name))


def _first(n: int = 0) -> Column:
    return F.get(F.col("args"), F.lit(n))


def _shown() -> Column:
    """The argument that a command shows."""
    shown = _case(F.col("name"), {k: F.coalesce(_first(n), _first()) for k, n in render.SHOWN.items()}, _first())
    size = F.size(F.col("args"))
    shown = F.when((F.col("name") == "SI") & (size > 1), F.concat(_first(), F.lit(" "), _first(1))).otherwise(shown)
    return F.when((F.col("name") == "SIrange") & (size > 2), F.concat(_first(), F.lit("–"), _first(1), F.lit(" "), _first(2))).otherwise(shown)


def _cited(html: bool) -> Column:
    keys = _joined(F.col("keys"), ", ")
    out = F.concat(F.lit("["), keys, F.lit("]"))
    out = C.escape_html(out) if html else out
    for name, rule in dims.CITATIONS.items():
        if rule is None:
            made = F.lit("")
        elif html and rule[2]:
            made = F.concat(F.lit('<sup class="footnote">' if rule[2] == "footnote" else "<sup>"), C.escape_html(keys), F.lit("</sup>"))
        else:
            made = F.concat(F.lit(rule[0]), keys, F.lit(rule[1]))
            made = C.escape_html(made) if html else made
        out = F.when(F.col("name") == name, made).otherwise(out)
    return out


def _formula(tag: str, kind: str | None, end: str = "") -> Column:
    attributes = f' class="math {kind}"' if kind else ""
    one = lambda shown, plain: F.concat(shown, F.lit(f'<{tag}{attributes} aria-hidden="true">'), C.escape_html(plain), F.lit(f"</{tag}>{end}"))
    return _joined(F.zip_with("mathml", "unicode", one), "<br />")


def html(docs: DataFrame, table: DataFrame, today: str = "") -> DataFrame:
    """doc_id and `html`: the documents' bodies. `table`: their nodes with `forms`; ids must differ."""
    esc = C.escape_html
    heading = _cat(C.first_upper(F.col("name")), F.when(F.col("label").isNotNull(), F.concat(F.lit(" ("), F.col("label"), F.lit(")"))))
    level = F.coalesce(_case(F.col("level").cast("string"), {str(k): str(h) for k, h in render.HEADINGS.items()}), F.lit("6"))
    has = F.size(F.col("args")) > 0
    command = F.when(F.col("name").isin(*render.FIXED), _case(F.col("name"), render.FIXED)).when(F.col("name") == "today", today)
    link = F.concat(F.lit('<a href="'), esc(_first()), F.lit('">'), esc(F.element_at(F.col("args"), -1)), F.lit("</a>"))
    wrap = _case(F.col("name"), {k: F.concat(F.lit(a), esc(_first()), F.lit(b)) for k, (a, b) in render.WRAP.items()})
    command = command.when(F.col("name").isin("url", "href") & has, link).when(F.col("name").isin(*render.WRAP) & has, wrap).otherwise(esc(_shown()))
    cells = lambda r: F.concat(F.lit("<tr>"), _joined(F.transform(r["cells"], lambda c: F.concat(F.lit("<td>"), esc(c), F.lit("</td>")))), F.lit("</tr>\n"))
    rows = _joined(F.transform(F.filter("rows", lambda r: ~r["is_separator"]), cells))
    entry = lambda e, k: F.concat(F.lit('<li id="bib-'), esc(e["key"]), F.lit('"><span class="label">['), (k + 1).cast("string"), F.lit("]</span> "), esc(e["text"]), F.lit("</li>\n"))
    size = lambda n: F.when(F.col(n).isNotNull(), F.concat(F.lit(f' {n}="'), esc(F.col(n)), F.lit('"')))
    opening = _case(F.col("kind"), {
        "Command": command, "Section": _cat("<h", level, ">", esc(F.col("text")), "</h", level, ">\n"), **render.LISTS, **{k: a for k, (a, _) in render.BLOCKS.items()},
        "MathInline": _formula("span", "inline"), "MathDisplay": _formula("div", "display", "\n"),
        "MathLines": _cat('<div class="math display multi">', _formula("span", None), "</div>\n"),
        "ItemList": F.when(F.col("ordered"), "<ol>\n").otherwise("<ul>\n"), "DescriptionList": "<dl>\n",
        "Theorem": _cat('<section class="theorem"><h3 class="theorem-heading">', esc(heading), "</h3>"), "CodeBlock": _cat("<pre><code>", esc(F.col("text")), "</code></pre>\n"),
        "Image": _cat('<img src="', esc(F.col("path")), '" alt="', esc(F.col("path")), '"', size("width"), size("height"), " />\n"), "Table": _cat("<table>\n", rows, "</table>\n"),
        "ColoredText": _cat('<span style="color:', esc(F.col("name")), '">', esc(F.col("text")), "</span>"), "Citation": _cited(True),
        "Bibliography": _cat('<section class="bibliography"><h2>References</h2><ol>\n', _joined(F.transform("bib", entry)), "</ol></section>\n"),
        "Label": _cat('<span id="', esc(F.col("text")), '"></span>'), "PageRef": _cat("page ", esc(F.col("text"))), "Footnote": _cat('<sup class="footnote">', esc(F.col("text")), "</sup>"),
        "Caption": _cat("<figcaption>", esc(F.col("text")), "</figcaption>\n"),
    }, esc(F.col("text")))
    closing = _case(F.col("kind"), {**{k: b for k, (_, b) in render.BLOCKS.items()}, "ItemList": F.when(F.col("ordered"), "</ol>\n").otherwise("</ul>\n"), "DescriptionList": "</dl>\n", "Theorem": "</section>\n"})

    def item_open(k: Column) -> Column:
        label = F.get(F.col("args"), k)
        mark = F.when(label.isNotNull(), F.concat(F.lit('<span class="label">'), esc(label), F.lit("</span> ")))
        return F.when(F.col("kind") == "ItemList", _cat("<li>", mark)).otherwise(_cat(F.when(label != "", F.concat(F.lit("<dt>"), esc(label), F.lit("</dt>\n"))), "<dd>"))

    events = _events(opening, closing, item_open, F.when(F.col("kind") == "ItemList", "</li>\n").otherwise("</dd>\n"))
    return gathered(docs, table.select("doc_id", F.explode(events).alias("e")), "html")


def plain(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id and `plain`: the documents' text. `table` as for `html`."""
    spaces = ("comma", "colon", "semicolon", "control_space", "quad", "qquad")
    command = F.when(F.size(F.col("args")) > 0, _first()).when(F.col("name").isin(*spaces), " ").otherwise("")
    rows = F.transform(F.filter("rows", lambda r: ~r["is_separator"]), lambda r: F.concat(_joined(r["cells"], "\t"), F.lit("\n")))
    title = F.when(F.col("label").isNotNull(), F.concat(F.lit(" ("), F.col("label"), F.lit(")")))
    as_it_is = dict.fromkeys(("Text", "ColoredText", "Footnote", "Caption", "Ref", "PageRef"), F.col("text"))
    opening = _case(F.col("kind"), as_it_is | {
        "Command": command, "Section": _cat(F.col("text"), "\n"), "CodeBlock": _cat(F.col("text"), "\n"), **{k: _joined(F.col("unicode"), "\n") for k in FORMULAS}, "Table": _joined(rows),
        "Bibliography": _joined(F.transform("bib", lambda e: F.concat(e["text"], F.lit("\n")))), "Theorem": _cat(F.upper(F.col("name")), title, ": "), "Paragraph": "\n\n",
        "LineBreak": "\n", "Image": _cat(F.col("path"), "\n"), "Citation": _cited(False),
    }, "")

    def item_open(k: Column) -> Column:
        label = F.get(F.col("args"), k)
        return F.when(F.col("kind") == "ItemList", "• ").otherwise(F.when(label != "", F.concat(label, F.lit(": "))))

    events = _events(opening, _case(F.col("kind"), {"Theorem": "\n"}), item_open, F.lit("\n"))
    return gathered(docs, table.select("doc_id", F.explode(events).alias("e")), "plain")


def contents(table: DataFrame, kind: str) -> DataFrame:
    """doc_id, outer_id and `text`: the text within each node of a kind. Ids must differ.

    No pairs of nodes are made: the texts of a document are one string of bytes, in which a node's are a slice between two
    running sums, the lengths of the texts before its start and before its end. All of it follows one shuffle by document.
    """
    edges = lambda *marks: F.array(*(F.struct(F.col(at).alias("at"), F.lit(edge).alias("edge")) for at, edge in marks))
    marks = F.when(F.col("kind") == "Text", edges(("node_id", 2))).otherwise(edges(("node_id", 1), ("subtree_end", 0)))
    outer = F.when(F.col("kind") != "Text", F.col("node_id"))
    rows = table.where(F.col("kind").isin(kind, "Text")).select("doc_id", outer.alias("outer_id"), F.col("text"), F.explode(marks).alias("m")).select("doc_id", "outer_id", "m.*", F.when(F.col("edge") == 2, F.col("text")).alias("text"))
    sum_before = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.partitionBy("doc_id").orderBy("at", "edge").rowsBetween(Window.unboundedPreceding, -1))
    placed = rows.repartition(_parts(table), "doc_id").withColumn("first", F.coalesce(sum_before, F.lit(0)).cast("int"))
    placed = placed.withColumn("last", F.lead("first").over(Window.partitionBy("doc_id", "outer_id").orderBy("at", "edge")))
    held = F.collect_list(F.when(F.col("edge") == 1, F.struct("outer_id", "first", "last"))).alias("spans")
    whole = placed.groupBy("doc_id").agg(F.expr("listagg(text, '') WITHIN GROUP (ORDER BY at)").cast("binary").alias("all"), held)
    cut = lambda s: F.struct(s["outer_id"].alias("outer_id"), F.coalesce(F.substring("all", s["first"] + 1, s["last"] - s["first"]).cast("string"), F.lit("")).alias("text"))
    return whole.select("doc_id", F.explode(F.transform("spans", cut)).alias("s")).select("doc_id", "s.*")
