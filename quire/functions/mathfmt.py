"""Mathematics as plain Unicode text.

A formula of more than 255 levels of braces and environments, TeX's own limit,
stays as it is written; so does one whose commands take each other as arguments
without braces to more than a few thousand levels.
"""

from __future__ import annotations

import re
import sys

from quire.functions import dims
from quire.functions.lexer import MOST_LEVELS, levels, read_group

#: Room for the levels of a formula, each of which takes several calls.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))

_OLD = re.compile(r"\\(over|choose|brack|brace)(?![A-Za-z])")
_MATRIX = {"pmatrix": "()", "bmatrix": "[]", "Bmatrix": "{}", "vmatrix": "||", "Vmatrix": "‖‖", "matrix": "", "smallmatrix": ""}
_BEGIN = re.compile(r"\\begin\{(" + "|".join(_MATRIX) + r")\}")
_TOKEN = re.compile(r"\\([^\W\d_]+\*?|.)|[&{}]|[^\\&{}]+|\\", re.DOTALL)
_INLINE = {"text", "mathrm", "mathscr", "mathnormal", "boldsymbol", "pmb", "operatorname"}
_CONTENTS = {"boxed", "mathop", "mathbin", "mathrel", "mathord", "mathpunct", "smash", "overbrace", "underbrace", "substack"}
_SPACES = {"\\": " ", "{": "{", "}": "}", ",": " ", ";": " ", ":": " ", ">": " ", "~": " ", "!": "", " ": " "}


def _calls(text: str, names: str, make, count: int = 1, option: bool = False):
    """Replaces each command of the alternation `names` and its `count` groups by make(name, option, *groups)."""
    out, at = [], 0
    for m in re.finditer(rf"\\({names})(?![A-Za-z])", text):
        if m.start() < at:
            continue
        k, given = m.end(), None
        if option and text.startswith("[", k) and (close := text.find("]", k)) >= 0:
            given, k = text[k + 1 : close].strip(), close + 1
        groups = []
        while len(groups) < count and (got := read_group(text, k, blank=bool(groups))):
            groups.append(got[0])
            k = got[1]
        made = make(m[1], given, *groups) if len(groups) == count else make(m[1], given, *groups, *[None] * (count - len(groups)))
        if made is not None:
            out += [text[at : m.start()], made]
            at = k if len(groups) == count else m.end()
    return "".join([*out, text[at:]])


def _old_fractions(text: str) -> str:
    """`{a \\over b}` and its like, the first one first, until none is left within braces."""
    forms = {"over": "\\frac{{{0}}}{{{1}}}", **dict.fromkeys(("choose", "brack", "brace"), "\\binom{{{0}}}{{{1}}}")}
    for _ in range(text.count("\\")):
        m = _OLD.search(text)
        if not m:
            break
        depth, start = 0, -1
        for k in range(m.start() - 1, -1, -1):
            if text[k] == "}":
                depth += 1
            elif text[k] == "{":
                if depth == 0:
                    start = k
                    break
                depth -= 1
        if start < 0:
            break
        group = read_group(text, start)
        upper, lower = text[start + 1 : m.start()].strip(), group[0][m.end() - start - 1 :].strip()
        text = text[:start] + forms[m[1]].format(upper, lower) + text[group[1] :]
    return text


def _matrices(text: str) -> str:
    out, at = [], 0
    while m := _BEGIN.search(text, at):
        name, depth, end = m[1], 0, None
        for e in re.finditer(r"\\(begin|end)\{" + name + r"\}", text[m.start() :]):
            depth += 1 if e[1] == "begin" else -1
            if depth == 0:
                end = e
                break
        if end is None:
            out.append(text[at : m.end()])
            at = m.end()
            continue
        sides = _MATRIX[name] or ("", "")
        out += [text[at : m.start()], sides[0], _matrices(text[m.end() : m.start() + end.start()]), sides[1]]
        at = m.start() + end.end()
    return "".join([*out, text[at:]])


def _root(_: str, index: str | None, inner: str | None) -> str:
    if inner is None:
        return "√"
    inner = to_unicode(inner)
    sign = {None: "√", "3": "∛", "4": "∜"}.get(index) or "".join(dims.SUPERSCRIPTS.get(c, c) for c in index) + "√"
    return f"{sign}({inner})" if any(c in inner for c in "+-, ÷[]") else sign + inner


def _fraction(_: str, __, upper: str | None, lower: str | None) -> str | None:
    if lower is None:
        return None
    upper, lower = to_unicode(upper), to_unicode(lower)
    return dims.VULGAR.get(f"{upper}/{lower}") or f"[{upper}] ÷ [{lower}]"


def _choose(_: str, __, upper: str | None, lower: str | None) -> str | None:
    return None if lower is None else f"C({to_unicode(upper)}, {to_unicode(lower)})"


def symbols(text: str) -> str:
    """One pass over commands: symbols, spacing, and commands that show their argument. Unknown ones stay."""
    out, k = [], 0
    while m := _TOKEN.match(text, k):
        k = m.end()
        name = m[1]
        if name is None:
            out.append(" " if m[0] == "&" else m[0])
        elif name in _SPACES:
            out.append(_SPACES[name])
        elif not name[0].isalpha():
            out.append(m[0])
        elif name in _INLINE:
            if got := read_group(text, k, blank=False):
                out.append(got[0])
                k = got[1]
        elif name in _CONTENTS:
            if got := read_group(text, k, blank=False):
                out.append(symbols(got[0]))
                k = got[1]
        elif name in ("phantom", "hphantom", "vphantom"):
            if got := read_group(text, k, blank=False):
                k = got[1]
        elif name in ("overset", "underset", "stackrel"):
            parts = []
            while len(parts) < 2 and (got := read_group(text, k, blank=False)):
                parts.append(symbols(got[0]))
                k = got[1]
            out.append(" ".join(parts))
        elif name in ("left", "right"):
            k += text.startswith(".", k)
        else:
            out.append(dims.SYMBOLS.get(name, m[0]))
    return "".join(out)


def _alphabet(name: str, _, inner: str | None) -> str | None:
    return None if inner is None else "".join(dims.alphabet(c, dims.MATH_ALPHABETS[name]) for c in to_unicode(inner))


def _accent(name: str, _, inner: str | None) -> str | None:
    return None if inner is None else "".join(c + dims.MATH_ACCENTS[name] for c in to_unicode(inner))


def _scripts(text: str, mark: str, table: dict[str, str]) -> str:
    def script(token: str) -> str:
        token = symbols(token)
        if all(c in table for c in token):
            return "".join(table[c] for c in token)
        return mark + token if len(token) == 1 else f"{mark}({token})"

    out, k = [], 0
    while (at := text.find(mark, k)) >= 0:
        out.append(text[k:at])
        k = at + 1
        if got := read_group(text, k, blank=False):
            token, k = got
        elif m := re.compile(r"\\[^\W\d_*]*\*?|.", re.DOTALL).match(text, k):
            token, k = m[0], m.end()
        else:
            out.append(mark)
            break
        out.append(script(token))
    return "".join([*out, text[k:]])


_NAMES = {name: "|".join(sorted(table, key=len, reverse=True)) for name, table in (("alphabets", dims.MATH_ALPHABETS), ("accents", dims.MATH_ACCENTS))}


def to_unicode(text: str) -> str:
    """All steps, in their order: old fractions, matrices, roots, fractions, symbols, alphabets, accents, scripts."""
    if levels(text) > MOST_LEVELS:
        return text
    try:
        return _steps(text)
    except RecursionError:
        return text


def _steps(text: str) -> str:
    text = _matrices(_old_fractions(text))
    text = _calls(text, "sqrt", _root, 1, option=True)
    text = _calls(text, "[dt]?frac", _fraction, 2)
    text = _calls(text, "[dt]?binom", _choose, 2)
    # Alphabets and accents work on their arguments' text, so they come before the symbols around them.
    text = _calls(text, _NAMES["alphabets"], _alphabet)
    text = _calls(text, _NAMES["accents"], _accent)
    text = symbols(text)
    return _scripts(_scripts(text, "^", dims.SUPERSCRIPTS), "_", dims.SUBSCRIPTS)


def roots_only(text: str) -> str:
    return _calls(text, "sqrt", _root, 1, option=True)
