"""Trees of nodes as HTML, plain text, layout elements, JSON and packaged documents."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable
from html import escape as _quote

from quire.functions import dims, mathml
from quire.functions.mathfmt import to_unicode
from quire.functions.parser import Node

HEADINGS = {0: 1, 6: 1, 1: 2, 2: 3, 3: 4, 4: 5}
#: Commands that wrap their first argument (fixed values).
WRAP = {
    "textbf": ("<strong>", "</strong>"), "bf": ("<strong>", "</strong>"), "textit": ("<em>", "</em>"), "it": ("<em>", "</em>"), "emph": ("<em>", "</em>"),
    "textsl": ("<em>", "</em>"), "texttt": ("<code>", "</code>"), "tt": ("<code>", "</code>"), "underline": ("<u>", "</u>"), "sout": ("<s>", "</s>"),
    "textsc": ('<span style="font-variant:small-caps">', "</span>"), "textrm": ('<span style="font-family:serif">', "</span>"),
    "textnormal": ('<span style="font-family:serif">', "</span>"), "textsf": ('<span style="font-family:sans-serif">', "</span>"),
    "enquote": ("&ldquo;", "&rdquo;"), "overline": ('<span style="text-decoration:overline">', "</span>"), "textsuperscript": ("<sup>", "</sup>"),
    "textsubscript": ("<sub>", "</sub>"), "fbox": ('<span style="border:1px solid #ccc;padding:0.2em">', "</span>"),
    "footnotetext": ('<sup class="footnote">', "</sup>"),
}
#: Commands that read the same whatever their arguments (fixed values).
FIXED = {
    "newline": "<br />\n", "linebreak": "<br />\n", "hfill": '<span class="hfill"></span>', "fill": '<span class="hfill"></span>', "hrulefill": "<hr />\n",
    "dotfill": '<span class="dotfill">…</span>', "strut": "", "mathstrut": "", "hspace": " ", "hspace*": " ", "vspace": " ", "vspace*": " ", "quad": " ",
    "qquad": " ", "comma": "\u2009", "colon": "\u2009", "semicolon": "\u2009", "control_space": "\u2009", "bang": "", "title": "", "author": "", "date": "",
    "footnotemark": "", "cline": "", "rule": "", "phantom": "", "vphantom": "", "hphantom": "",
}
#: The argument that shows, where it isn't the first (fixed values).
SHOWN = {"raisebox": 1, "rotatebox": 1, "scalebox": 1, "colorbox": 1, "fcolorbox": 2, "multicolumn": 2, "multirow": 2, "resizebox": 2}
BLOCKS = {
    "Center": ('<div class="center">', "</div>\n"), "Quote": ("<blockquote>", "</blockquote>\n"),
    "Abstract": ('<section class="abstract"><h2>Abstract</h2>', "</section>\n"), "FlushLeft": ('<div style="text-align:left">', "</div>\n"),
    "FlushRight": ('<div style="text-align:right">', "</div>\n"),
}
LISTS = {
    "TableOfContents": '<nav class="toc"><em>Table of Contents</em></nav>\n', "ListOfFigures": '<section class="lof"><em>List of Figures</em></section>\n',
    "ListOfTables": '<section class="lot"><em>List of Tables</em></section>\n', "LineBreak": "<br />\n", "Paragraph": "<p></p>\n",
}


def escape(text: str) -> str:
    return _quote(text or "").replace("&#x27;", "&#39;")


def heading(node: Node) -> str:
    return node.name[:1].upper() + node.name[1:] + (f" ({node.label})" if node.label is not None else "")


def citation(node: Node, html: bool = False) -> str:
    rule = dims.CITATIONS.get(node.name, ("[", "]", False))
    if rule is None:
        return ""
    before, after, raised = rule
    keys = ", ".join(node.keys)
    if html and raised:
        return f"<sup{' class=' + chr(34) + 'footnote' + chr(34) if raised == 'footnote' else ''}>{escape(keys)}</sup>"
    return (escape(before + keys + after) if html else before + keys + after)


def shown_argument(node: Node) -> str | None:
    args, k = node.args or [], SHOWN.get(node.name, 0)
    if node.name == "SI" and len(args) > 1:
        return f"{args[0]} {args[1]}"
    if node.name == "SIrange" and len(args) > 2:
        return f"{args[0]}–{args[1]} {args[2]}"
    return args[k] if len(args) > k else args[0] if args else None


def written(nodes: list[Node], one: Callable[[Node], str | list]) -> str:
    """Text of a tree: `one` gives a node's, or its pieces with the nodes between them. Trees may be of any depth."""
    out, work = [], list(reversed(nodes))
    while work:
        x = work.pop()
        if isinstance(x, Node):
            x = one(x)
        if isinstance(x, str):
            out.append(x)
        else:
            work += reversed(x)
    return "".join(out)


def _within(node: Node) -> list[Node]:
    return [n for *_, children in node.parts for n in children]


def html(nodes: list[Node], today: str = "") -> str:
    return written(nodes, lambda n: _html(n, today))


def _command(node: Node, today: str) -> str:
    args = node.args or []
    if node.name in FIXED:
        return FIXED[node.name]
    if node.name == "today":
        return today
    if node.name in ("url", "href") and args:
        return f'<a href="{escape(args[0])}">{escape(args[-1])}</a>'
    if node.name in WRAP and args:
        before, after = WRAP[node.name]
        return before + escape(args[0]) + after
    return escape(shown_argument(node) or "")


def _formula(text: str, tag: str, kind: str | None, end: str = "") -> str:
    attributes = f' class="math {kind}"' if kind else ""
    made = mathml.inline(text) if kind == "inline" else mathml.display(text)
    return f'{made}<{tag}{attributes} aria-hidden="true">{escape(to_unicode(text))}</{tag}>{end}'


def _html(node: Node, today: str) -> str | list:
    kind = node.kind
    if kind == "Text":
        return escape(node.text)
    if kind == "Command":
        return _command(node, today)
    if kind == "Section":
        h = HEADINGS.get(node.level, 6)
        return f"<h{h}>{escape(node.text)}</h{h}>\n"
    if kind in LISTS:
        return LISTS[kind]
    if kind in BLOCKS:
        before, after = BLOCKS[kind]
        return [before, *_within(node), after]
    if kind == "MathInline":
        return _formula(node.text, "span", "inline")
    if kind == "MathDisplay":
        return _formula(node.text, "div", "display", "\n")
    if kind == "MathLines":
        return '<div class="math display multi">' + "<br />".join(_formula(x, "span", None) for x in node.lines) + "</div>\n"
    if kind == "ItemList":
        tag = "ol" if node.ordered else "ul"
        out: list = [f"<{tag}>\n"]
        for (_, _, children), label in zip(node.parts, node.args):
            out += ["<li>" + (f'<span class="label">{escape(label)}</span> ' if label is not None else ""), *children, "</li>\n"]
        return [*out, f"</{tag}>\n"]
    if kind == "DescriptionList":
        out = ["<dl>\n"]
        for (_, _, children), term in zip(node.parts, node.args):
            out += [(f"<dt>{escape(term)}</dt>\n" if term else "") + "<dd>", *children, "</dd>\n"]
        return [*out, "</dl>\n"]
    if kind == "Theorem":
        return [f'<section class="theorem"><h3 class="theorem-heading">{escape(heading(node))}</h3>', *_within(node), "</section>\n"]
    if kind == "CodeBlock":
        return f"<pre><code>{escape(node.text)}</code></pre>\n"
    if kind == "Image":
        sizes = "".join(f' {n}="{escape(v)}"' for n, v in (("width", node.width), ("height", node.height)) if v is not None)
        return f'<img src="{escape(node.path)}" alt="{escape(node.path)}"{sizes} />\n'
    if kind == "Table":
        rows = ("<tr>" + "".join(f"<td>{escape(c)}</td>" for c in cells) + "</tr>\n" for cells, rule in node.rows if not rule)
        return f"<table>\n{''.join(rows)}</table>\n"
    if kind == "ColoredText":
        return f'<span style="color:{escape(node.name)}">{escape(node.text)}</span>'
    if kind == "Citation":
        return citation(node, html=True)
    if kind == "Bibliography":
        rows = (f'<li id="bib-{escape(key)}"><span class="label">[{k}]</span> {escape(text)}</li>\n' for k, (key, text) in enumerate(node.bib, 1))
        return f'<section class="bibliography"><h2>References</h2><ol>\n{"".join(rows)}</ol></section>\n'
    if kind == "Label":
        return f'<span id="{escape(node.text)}"></span>'
    if kind == "PageRef":
        return f"page {escape(node.text)}"
    if kind == "Footnote":
        return f'<sup class="footnote">{escape(node.text)}</sup>'
    if kind == "Caption":
        return f"<figcaption>{escape(node.text)}</figcaption>\n"
    return escape(node.text)  # Ref


def shape(nodes: list[Node]) -> str:
    """The tree in one line: kind, :name, what it holds after =, and children in braces."""

    def one(n: Node) -> list:
        held = next((v for v in (n.text, n.args, n.keys, n.lines, n.path, n.columns) if v is not None), None)
        if isinstance(held, list):
            held = "|".join("" if x is None else x for x in held)
        more = "".join(f"[{x}]" for x in (n.level, n.label, n.width, n.height) if x is not None)
        more += "".join(f"[{'--' if rule else '&'.join(cells)}]" for cells, rule in n.rows or ()) + "".join(f"[{k}={t}]" for k, t in n.bib or ())
        out: list = [n.kind + (f":{n.name}" if n.name else "") + more + ("=" + held if held else "")]
        for *_, children in n.parts:
            out += ["{", *_spaced(children), "}"]
        return out

    return written(_spaced(nodes), one)


def _spaced(nodes: list[Node]) -> list:
    return [x for n in nodes for x in (" ", n)][1:]


def metadata(nodes: list[Node]) -> dict[str, str | None]:
    """Title, author and date; the last one of each counts."""
    out: dict[str, str | None] = {"title": None, "author": None, "date": None}
    for n in nodes:
        if n.kind == "Command" and n.name in out and n.args:
            out[n.name] = n.args[0]
    return out


def page(nodes: list[Node], today: str = "") -> str:
    """A whole HTML document."""
    meta = metadata(nodes)
    date = today if (meta["date"] or "").strip() == "\\today" else meta["date"]
    parts = [(meta["title"], "h1"), (meta["author"], "p"), (date, "p")]
    head = "".join(f"<{tag}>{escape(text)}</{tag}>\n" for text, tag in parts if text)
    head = f"<header>\n{head}</header>\n" if head else ""
    return f'<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8" />\n<title>{escape(meta["title"] or "Document")}</title>\n</head>\n<body>\n{head}{html(nodes, today)}</body>\n</html>\n'


def plain(nodes: list[Node]) -> str:
    return written(nodes, _plain)


def _plain(node: Node) -> str | list:
    kind = node.kind
    if kind in ("Text", "ColoredText", "Footnote", "Caption", "Ref", "PageRef"):
        return node.text
    if kind == "Command":
        return node.args[0] if node.args else " " if node.name in ("comma", "colon", "semicolon", "control_space", "quad", "qquad") else ""
    if kind in ("Section", "CodeBlock"):
        return node.text + "\n"
    if kind in ("MathInline", "MathDisplay"):
        return to_unicode(node.text)
    if kind == "MathLines":
        return "\n".join(map(to_unicode, node.lines))
    if kind == "ItemList":
        return [x for *_, children in node.parts for x in ("• ", *children, "\n")]
    if kind == "DescriptionList":
        return [x for (*_, children), term in zip(node.parts, node.args) for x in (f"{term}: " if term else "", *children, "\n")]
    if kind == "Table":
        return "".join("\t".join(cells) + "\n" for cells, rule in node.rows if not rule)
    if kind == "Bibliography":
        return "".join(text + "\n" for _, text in node.bib)
    if kind == "Theorem":
        title = f" ({node.label})" if node.label is not None else ""
        return [f"{node.name.upper()}{title}: ", *_within(node), "\n"]
    return {"Paragraph": "\n\n", "LineBreak": "\n", "Image": (node.path or "") + "\n", "Citation": citation(node) if kind == "Citation" else ""}.get(kind, _within(node))


#: Commands that a page leaves out (fixed values).
_UNSEEN = set(
    "title author date newpage clearpage pagebreak hspace hspace* vspace vspace* footnotemark cline rule linebreak nopagebreak samepage enlargethispage "
    "raggedright raggedleft centering appendix bibliography bibliographystyle index glossary bang".split()
)
_SEGMENTS = {"textbf": "bold", "textit": "italic", "emph": "italic", "textsc": "italic", "texttt": "code"}


class _Page:
    """Collects layout elements; running text gathers in a paragraph of segments until a block ends it."""

    def __init__(self):
        self.out: list[dict] = []
        self.segments: list[list[str]] = []

    def text(self, text: str, style: str = "plain") -> None:
        if style != "plain":
            self.segments.append([style, text])
            return
        text = text.replace("\n", " ")
        if not text.strip():
            return
        if self.segments and self.segments[-1][0] == "plain":
            last = self.segments[-1]
            last[1] += ("" if last[1].endswith(" ") or text.startswith(" ") else " ") + text
        else:
            self.segments.append(["plain", text])

    def flush(self) -> None:
        if self.segments:
            self.out.append({"element": "rich_paragraph", "text": "".join(t for _, t in self.segments), "segments": [f"{s}:{t}" for s, t in self.segments]})
            self.segments = []

    def block(self, element: str, text: str = "", **more) -> None:
        self.flush()
        self.out.append({"element": element, "text": text} | more)


def _spans(page: _Page, text: str) -> None:
    """Running text whose formulas are set in Unicode."""
    pieces = text.split("$")
    page.text("".join(to_unicode(p) if k % 2 and k < len(pieces) - 1 else p for k, p in enumerate(pieces)))


def _item_text(children: list[Node]) -> tuple[str, list[str]]:
    """A list item's text in one line, and its displayed formulas."""
    words, shown = [], []
    for n in children:
        if n.kind in ("MathDisplay", "MathLines"):
            shown.append(n.text if n.kind == "MathDisplay" else "\n".join(n.lines))
        elif n.kind != "ItemList":
            words += (to_unicode(n.text) if n.kind == "MathInline" else plain([n])).split()
    return " ".join(words), shown


def layout(nodes: list[Node], today: str = "") -> list[dict]:
    """Elements of a page: headings, paragraphs of styled segments, list items, formulas, tables and the like."""
    page, meta = _Page(), metadata(nodes)
    work: list = [(n, 0) for n in reversed(nodes)]
    while work:
        node, depth = work.pop()
        work += reversed(_lay(node, page, depth, today) or ())
    page.flush()
    head = [{"element": "heading", "text": meta["title"], "level": 1}] if meta["title"] else []
    date = today if meta["date"] == "\\today" else meta["date"]
    head += [{"element": "paragraph", "text": t} for t in (meta["author"], date) if t]
    return [*head, {"element": "empty_line", "text": ""}, *page.out] if head else page.out


def _lay(node: Node | Callable[[], None], page: _Page, depth: int, today: str) -> list | None:
    """Lays a node out, or does what is left of one; gives what comes next: nodes with their depth, and what is left to do between them."""
    if not isinstance(node, Node):
        return node()
    kind = node.kind
    if kind == "Text":
        _spans(page, node.text)
    elif kind == "Paragraph":
        page.block("empty_line")
    elif kind == "Section":
        page.block("heading", node.text, level=6 if node.level == 6 else max(1, node.level))
    elif kind == "MathInline":
        if any(c in node.text for c in ("\\frac", "\\sqrt")):
            page.block("math", node.text)
        else:
            page.text(to_unicode(node.text))
    elif kind == "MathDisplay":
        page.block("math", node.text)
    elif kind == "MathLines":
        page.block("math", "\n".join(x.replace("&", " ").replace("  ", " ") if node.name == "align" else x.replace("&", " ") for x in node.lines))
    elif kind == "ItemList":
        page.flush()
        after: list = []
        for k, ((*_, children), label) in enumerate(zip(node.parts, node.args), 1):
            after.append((lambda k=k, children=children, label=label: _lay_item(page, node, k, children, label, depth), depth))
            after += [(child, depth + 1) for child in children if child.kind == "ItemList"]
        return after
    elif kind == "DescriptionList":
        for (*_, children), term in zip(node.parts, node.args):
            page.block("definition", _item_text(children)[0], term=term or "")
    elif kind == "Theorem":
        page.block("heading", heading(node), level=4)
        return [(child, depth) for child in _within(node)]
    elif kind == "CodeBlock":
        page.block("code", node.text)
    elif kind == "Image":
        page.block("image", node.path)
    elif kind == "Table":
        rows = [cells for cells, rule in node.rows if not rule]
        page.block("table", "\n".join("\t".join(cells) for cells in rows), columns=len(node.columns))
    elif kind == "Bibliography":
        for key, text in node.bib:
            page.block("citation", text, term=key)
        page.block("bibliography")
    elif kind == "Citation":
        page.text(citation(node))
    elif kind in ("Ref", "PageRef"):
        page.text(f"?? ({node.text})")
    elif kind in ("Center", "Quote", "Abstract"):
        if kind == "Abstract":
            page.block("heading", "Abstract", level=3)
        quoted = lambda child: lambda: page.block("block_quote", child.text.strip())
        return [(quoted(child) if child.kind == "Text" and child.text.strip() else child, depth) for child in _within(node)]
    elif kind in ("FlushLeft", "FlushRight"):
        return [(child, depth) for child in _within(node)]
    elif kind == "Footnote":
        page.block("footnote", node.text)
    elif kind in ("Caption", "ColoredText"):
        page.text(node.text)
    elif kind == "TableOfContents":
        page.block("toc")
    elif kind in ("ListOfFigures", "ListOfTables"):
        page.block("heading", "List of Figures" if kind == "ListOfFigures" else "List of Tables", level=2)
    elif kind == "Command":
        _lay_command(node, page, today)
    return None


def _lay_item(page: _Page, node: Node, number: int, children: list[Node], label: str | None, depth: int) -> None:
    text, shown = _item_text(children)
    if any(c.kind != "ItemList" for c in children):
        if node.ordered:
            page.block("ordered_item", text, number=number, depth=depth)
        else:
            page.block("unordered_item", " ".join(x for x in (label, text) if x), depth=depth)
    for formula in shown:
        page.block("math", formula)


def _lay_command(node: Node, page: _Page, today: str) -> None:
    name, args = node.name, node.args or []
    if name in _UNSEEN:
        return
    if name in ("maketitle", "noindent"):
        page.flush()
    elif name in ("href", "url") and args:
        page.text(args[-1], "link")
    elif name in _SEGMENTS and args:
        page.text(args[0], _SEGMENTS[name])
    elif name == "today":
        page.text(today)
    elif name == "hrulefill":
        page.block("rule")
    elif name in ("quad", "qquad", "comma", "colon", "semicolon", "control_space"):
        pass  # a space alone adds nothing to running text
    elif name == "enquote" and args:
        page.text(f"“{args[0]}”")
    elif name in ("textsuperscript", "textsubscript") and args:
        page.text(("^" if name == "textsuperscript" else "_") + args[0])
    elif name in ("SI", "SIrange"):
        page.text(shown_argument(node) or "")
    elif name in ("multicolumn", "multirow"):
        page.text(shown_argument(node) or "")
    elif args:
        page.text(args[0])


def layout_shape(nodes: list[Node], today: str = "") -> str:
    """The layout elements in one line: element, level, depth, number and columns in brackets, term and text after =."""
    out = []
    for e in layout(nodes, today):
        more = "".join(f"[{e[k]}]" for k in ("level", "depth", "number", "columns") if k in e)
        out.append(e["element"] + more + "".join(f"={e[k]}" for k in ("term", "text") if e.get(k)))
    return "; ".join(out)


def tree(nodes: list[Node]) -> list[dict]:
    """Nodes as externally tagged objects, without empty fields."""
    out = []
    for n in nodes:
        fields = {c: getattr(n, c) for c in Node.FIELDS if getattr(n, c) is not None}
        if n.parts:
            fields["parts"] = [{"slot": slot, "nodes": tree(children)} for slot, _, children in n.parts]
        out.append({n.kind: fields} if fields else n.kind)
    return out


def ast_json(nodes: list[Node]) -> str:
    return json.dumps(tree(nodes), ensure_ascii=False, indent=2)


def _package(parts: list[tuple[str, str]], stored: int = 0) -> bytes:
    """A zip archive with fixed times; the first `stored` parts aren't compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, (name, text) in enumerate(parts):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if k < stored else zipfile.ZIP_DEFLATED
            z.writestr(info, text)
    return out.getvalue()


def docx(nodes: list[Node]) -> bytes:
    """A word-processor document: the title, then paragraphs of plain text."""
    title = metadata(nodes)["title"]
    paragraphs = [p.strip() for p in plain(nodes).split("\n\n") if p.strip()]
    made = [f'<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>{escape(title)}</w:t></w:r></w:p>'] if title else []
    made += [f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    types = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument"
    return _package(
        [
            ("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{types}"/></Types>'),
            ("_rels/.rels", f'{head}<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{office}" Target="word/document.xml"/></Relationships>'),
            ("word/_rels/document.xml.rels", f'{head}<Relationships xmlns="{rels}"/>'),
            ("word/document.xml", f'{head}<w:document xmlns:w="{w}"><w:body>{"".join(made)}</w:body></w:document>'),
        ]
    )


def epub(nodes: list[Node], today: str = "", creator: str = "quire", date: str = "2026-01-01") -> bytes:
    """An electronic book of one chapter."""
    meta = metadata(nodes)
    title, head = escape(meta["title"] or "Document"), '<?xml version="1.0" encoding="UTF-8"?>\n'
    body = f'{head}<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{title}</title></head><body>{html(nodes, today)}</body></html>'
    nav = f'{head}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{title}</title></head><body><nav epub:type="toc"><ol><li><a href="content.xhtml">{title}</a></li></ol></nav></body></html>'
    opf = f'{head}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{title}</dc:identifier><dc:title>{title}</dc:title><dc:creator>{escape(meta["author"] or creator)}</dc:creator><dc:date>{escape(date)}</dc:date><dc:language>en</dc:language></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="content" href="content.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="content"/></spine></package>'
    container = f'{head}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    return _package([("mimetype", "application/epub+zip"), ("META-INF/container.xml", container), ("OEBPS/content.opf", opf), ("OEBPS/nav.xhtml", nav), ("OEBPS/content.xhtml", body)], stored=1)
