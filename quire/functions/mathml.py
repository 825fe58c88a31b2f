"""Mathematics as MathML in three steps: tokens become a tree of groups, a table of handlers makes elements of it, and elements are written out."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from quire.functions import dims
from quire.functions.lexer import MOST_LEVELS, environment_end, levels, read_group

_TOKEN = re.compile(r"\\(?P<name>[^\W\d_]+)\*?|\\(?P<sign>.)|(?P<blank>\s+)|(?P<char>.)", re.DOTALL)
_ENTITIES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"})
#: Marks over or under a base (fixed values).
_MARKS = {
    "vec": "→", "overrightarrow": "→", "overleftarrow": "←", "hat": "^", "widehat": "^", "tilde": "~", "widetilde": "~", "bar": "¯", "overline": "¯",
    "dot": "˙", "ddot": "¨", "check": "ˇ", "breve": "˘", "acute": "´", "grave": "`", "mathring": "˚", "underline": "_",
}
_FENCES = {"pmatrix": "()", "smallmatrix": "()", "bmatrix": "[]", "Bmatrix": "{}", "vmatrix": "||", "Vmatrix": "‖‖", "cases": "{}"}
_GRIDS = {"matrix", "aligned", "align", "align*", "gather", "gather*", "multline", "multline*", "split", "gathered", "eqnarray", "displaymath", "math", "array"}
_PLAIN = {"text", "textrm", "textnormal", "mathrm", "mathit", "mathbf", "mathsf", "mathtt", "mathscr", "mathnormal"}
_FUNCTIONS = {w for w in dims.WORDS if w not in ("dx", "dy", "dt", "det", "dim", "deg", "arcsin", "arccos", "arctan")}
_FUNCTIONS |= {"limsup", "liminf", "projlim", "injlim", "varlimsup", "varliminf", "varinjlim", "varprojlim"}
_DOTS = {"cdots": "⋯", "dots": "⋯", "dotsc": "⋯", "dotsb": "⋯", "dotsm": "⋯", "dotsi": "⋯", "dotso": "⋯", "ldots": "…", "vdots": "⋮", "ddots": "⋱", "adots": "⋰"}
_OPERATORS = {"prime": "′", "degree": "°", "bmod": "mod", "not": "/", "colon": ":"} | _DOTS
_WIDTHS = {"quad": "1em", "qquad": "2em", "enspace": "0.5em", "enskip": "0.5em", "emsp": "1em"}
_NOTHING = {"thinspace", "negthinspace", "medspace", "negmedspace", "thickspace", "negthickspace", "displaystyle", "textstyle", "scriptstyle", "scriptscriptstyle", "limits", "nolimits", "displaylimits"}
_DROPPED = {"hspace", "vspace", "kern", "mskip", "mkern"}
_HIDDEN = {"phantom", "hphantom", "vphantom", "smash", "textsuperscript", "textsubscript"}
_SIZED = {"left", "right", "big", "Big", "bigg", "Bigg", "bigl", "Bigl", "bigr", "Bigr"}
#: Width of a thin space (fixed value).
_THIN = "0.167em"


def escape(text: str) -> str:
    return text.translate(_ENTITIES)


# elements


@dataclass
class Element:
    tag: str
    parts: list[Element] | str = ""
    attributes: dict[str, str] = field(default_factory=dict)

    def write(self) -> str:
        shown = "".join(f' {k}="{v}"' for k, v in self.attributes.items())
        if self.tag == "mspace":
            return f"<mspace{shown} />"
        inner = escape(self.parts) if isinstance(self.parts, str) else write(self.parts)
        return f"<{self.tag}{shown}>{inner}</{self.tag}>"

    def leaves(self) -> list[Element]:
        return [self] if isinstance(self.parts, str) else [x for p in self.parts for x in p.leaves()]


def write(elements: list[Element]) -> str:
    return "".join(e.write() for e in elements)


def _space(width: str) -> list[Element]:
    return [Element("mspace", attributes={"width": width})]


def _fenced(before: str, inner: list[Element], after: str) -> list[Element]:
    return [Element("mrow", [Element("mo", before), *inner, Element("mo", after)])]


def is_operator(symbol: str) -> bool:
    """One character that is no letter, other than those of the number sets."""
    return len(symbol) == 1 and (not symbol.isalpha() or symbol in "ℵℏℓ℧Ⅎðℂℕℚℝℤ𝕜")


def _character(c: str) -> list[Element]:
    if c.isascii() and c.isdigit():
        return [Element("mn", c)]
    return [Element("mi" if c.isascii() and c.isalpha() or "Α" <= c <= "ω" else "mo", c)]


# the tree of groups


@dataclass
class Item:
    """A character, a sign (an escaped character), a name, a group or an environment, and where it stands in the source."""

    kind: str
    value: str
    start: int
    end: int
    items: list[Item] = field(default_factory=list)
    #: What braces or the environment hold, as it was written.
    raw: str = ""


def tree(text: str) -> list[Item]:
    """Items without white space. What is unclosed ends with the text, and a stray closing brace is passed over."""
    open_: list[Item] = [Item("group", "", 0, len(text))]
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:  # a backslash at the end
            break
        start, at = at, m.end()
        kind = m.lastgroup
        value = m[kind]
        if kind == "char" and value == "{":
            open_.append(Item("group", "", start, len(text)))
        elif kind == "char" and value == "}":
            if len(open_) > 1:
                _close(open_, text, start, at)
        elif kind == "name" and value in ("begin", "end"):
            name = read_group(text, at)
            if name is None or value == "end":
                at = name[1] if name else at
                continue
            stop, after = environment_end(text, name[0], name[1])
            open_[-1].items.append(Item("environment", name[0], start, after, raw=text[name[1] : stop]))
            at = after
        elif kind != "blank":
            open_[-1].items.append(Item(kind, value, start, at))
    while len(open_) > 1:
        _close(open_, text, len(text), len(text))
    return open_[0].items


def _close(open_: list[Item], text: str, stop: int, end: int) -> None:
    done = open_.pop()
    done.end, done.raw = end, text[done.start + 1 : stop]
    open_[-1].items.append(done)


class Cursor:
    """Takes items of a group, one after another, and arguments as commands ask for them."""

    def __init__(self, items: list[Item]):
        self.items, self.at = items, 0

    def peek(self) -> Item | None:
        return self.items[self.at] if self.at < len(self.items) else None

    def take(self) -> Item | None:
        item = self.peek()
        self.at += item is not None
        return item

    def all(self) -> list[Element]:
        out: list[Element] = []
        while self.peek():
            out += self.scripted()
        return out

    def scripted(self) -> list[Element]:
        """An item's elements, within their scripts: at most one below and one above, without a blank before."""
        base = self.plain()
        held: dict[str, list[Element]] = {}
        while base and (mark := self.peek()) and mark.kind == "char" and mark.value in "_^" and mark.value not in held and mark.start == self.items[self.at - 1].end:
            self.take()
            held[mark.value] = self.argument()
        if not held:
            return base
        tag = {"_": "msub", "^": "msup", "_^": "msubsup"}["".join(sorted(held, reverse=True))]
        return [Element(tag, [*base, *held.get("_", []), *held.get("^", [])])]

    def plain(self) -> list[Element]:
        item = self.take()
        if item is None:
            return []
        if item.kind == "group":
            return [Element("mrow", Cursor(item.items).all())]
        if item.kind == "environment":
            return _environment(item)
        if item.kind == "sign":
            return _SIGNS[item.value]() if item.value in _SIGNS else _character(item.value)
        if item.kind == "name":
            return _HANDLERS[item.value](self, item.value) if item.value in _HANDLERS else _symbol(item.value)
        return _character(item.value)

    def argument(self) -> list[Element]:
        """What braces hold, without a row of its own; a command with its scripts; or one character."""
        item = self.peek()
        if item and item.kind == "group":
            return Cursor(self.take().items).all()
        return self.scripted() if item and item.kind != "char" else self.plain()

    def written(self) -> str:
        """The next argument as it stands in the source."""
        item = self.take()
        return "" if item is None else item.raw if item.kind == "group" else item.value


# handlers


def _symbol(name: str) -> list[Element]:
    if name not in dims.SYMBOLS:
        return [Element("mtext", "\\" + name)]
    symbol = dims.SYMBOLS[name]
    return [Element("mo" if is_operator(symbol) else "mi", symbol)] if symbol else []


def _fraction(c: Cursor, _: str) -> list[Element]:
    return [Element("mfrac", c.argument() + c.argument())]


def _binomial(c: Cursor, _: str) -> list[Element]:
    return _fenced("(", [Element("mfrac", c.argument() + c.argument(), {"linethickness": "0"})], ")")


def _root(c: Cursor, _: str) -> list[Element]:
    index = None
    if (item := c.peek()) and item.value == "[" and item.kind == "char":
        close = next((k for k in range(c.at, len(c.items)) if c.items[k].value == "]" and c.items[k].kind == "char"), None)
        if close is not None:
            index = "".join(x.raw if x.kind == "group" else "\\" * (x.kind in ("name", "sign")) + x.value for x in c.items[c.at + 1 : close])
            c.at = close + 1
    inner = c.argument()
    if index is None:
        return [Element("msqrt", inner)]
    alone = len(inner) == 1 and isinstance(inner[0].parts, str)
    if inner and not alone and (inner[0].tag != "mrow" or inner[0].attributes):
        inner = [Element("mrow", inner)]
    return [Element("mroot", [*inner, Element("mn", index)])]


def _marked(c: Cursor, name: str) -> list[Element]:
    accent = "false" if name in ("underline", "overline") else "true"
    return [Element("munder" if name == "underline" else "mover", [*c.argument(), Element("mo", _MARKS[name])], {"accent": accent})]


def _stacked(c: Cursor, name: str) -> list[Element]:
    mark, base = c.argument(), c.scripted()
    return [Element("munder" if name == "underset" else "mover", base + mark)]


def _sized(c: Cursor, _: str) -> list[Element]:
    """A delimiter; a dot is an invisible one."""
    item = c.peek()
    if item and item.kind == "char":
        return [] if c.take().value == "." else [Element("mo", item.value)]
    return c.plain()


def _alphabet(c: Cursor, name: str) -> list[Element]:
    return [Element("mi", "".join(dims.alphabet(x, dims.MATH_ALPHABETS[name]) for x in c.written()))]


def _bold(c: Cursor, _: str) -> list[Element]:
    inner = c.argument()
    for leaf in (x for e in inner for x in e.leaves()):
        if leaf.tag in ("mi", "mn") and not leaf.attributes:
            leaf.attributes = {"mathvariant": "bold"}
    return inner


def _passed(c: Cursor, _: str) -> list[Element]:
    c.written()
    return []


def _passed_group(c: Cursor, _: str) -> list[Element]:
    if (item := c.peek()) and item.kind == "group":
        c.take()
    return []


def _rows(text: str, cut: str | None) -> Element:
    rows = (row.strip() for row in text.split("\\\\"))
    return Element("mtable", [Element("mtr", [Element("mtd", elements(cell.strip())) for cell in (row.split(cut) if cut else [row])]) for row in rows if row or not cut])


def _environment(item: Item) -> list[Element]:
    name, body = item.value, item.raw
    if (spec := read_group(body, 0)) and spec[0] and set(spec[0]) <= set("|lcr "):
        body = body[spec[1] :]
    if name in _FENCES:
        return _fenced(_FENCES[name][0], [_rows(body, "&")], _FENCES[name][1])
    return [_rows(body, "&")] if name in _GRIDS else [Element("mrow", elements(body))]


_SIGNS: dict[str, Callable[[], list[Element]]] = {c: lambda: _space(_THIN) for c in " ,;:"} | {c: lambda: [] for c in "\\!"}
_Handler = Callable[[Cursor, str], list[Element]]
_HANDLERS: dict[str, _Handler] = (
    {n: lambda c, name: [Element("mi", dims.SYMBOLS[name], {"mathvariant": "normal"})] for n in _FUNCTIONS}
    | {n: lambda c, name: [Element("mo", _OPERATORS[name])] for n in _OPERATORS}
    | {n: lambda c, name: _space(_WIDTHS[name]) for n in _WIDTHS}
    | {n: lambda c, name: [] for n in _NOTHING}
    | dict.fromkeys(_DROPPED, _passed_group)
    | dict.fromkeys(_HIDDEN, _passed)
    | dict.fromkeys(_SIZED, _sized)
    | dict.fromkeys(_MARKS, _marked)
    | {n: lambda c, name: [Element("mtext", c.written())] for n in _PLAIN}
    | dict.fromkeys(("mathbb", "mathcal", "mathfrak"), _alphabet)
    | dict.fromkeys(("frac", "dfrac", "tfrac", "cfrac"), _fraction)
    | dict.fromkeys(("binom", "dbinom", "tbinom"), _binomial)
    | dict.fromkeys(("overset", "underset", "stackrel"), _stacked)
    | dict.fromkeys(("boldsymbol", "pmb"), _bold)
    | {
        "sqrt": _root,
        "operatorname": lambda c, _: [Element("mi", c.written(), {"mathvariant": "normal"})],
        "mod": lambda c, _: [Element("mi", "mod"), *_space(_THIN), *c.argument()],
        "pmod": lambda c, _: _fenced("(", [Element("mi", "mod"), *_space(_THIN), *c.argument()], ")"),
        "pod": lambda c, _: _fenced("(", c.argument(), ")"),
        "boxed": lambda c, _: [Element("menclose", c.argument(), {"notation": "box"})],
        "substack": lambda c, _: [_rows(c.written(), None)],
    }
)


def elements(text: str) -> list[Element]:
    return Cursor(tree(text)).all()


def to_mathml(text: str) -> str:
    """The elements of an expression, without the outer `math`; of one that is too deep (see `mathfmt`), its source as text."""
    if levels(text) <= MOST_LEVELS:
        try:
            return write(elements(text))
        except RecursionError:
            pass
    return write([Element("mtext", text)])


def inline(text: str) -> str:
    return f"<math>{to_mathml(text)}</math>"


def display(text: str) -> str:
    return f'<math display="block">{to_mathml(text)}</math>'
