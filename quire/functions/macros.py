"""Macro definitions and their expansion."""

from __future__ import annotations

import re

from quire.functions.lexer import read_group, skip_blank

ROUNDS = 10
_DEFINITION = re.compile(r"\\(newcommand|renewcommand|providecommand|def|let)(?![A-Za-z@])\*?")
_CALL = re.compile(r"\\([^\W\d_*][^\W\d_]*\*?|[^\W\d_]+)", re.UNICODE)
_MACRO = re.compile(r"\\((?:[^\W\d_]|\*)+)")
_COUNT = re.compile(r"\s*\[\s*(\d+)\s*\]")
_SLOT = re.compile(r"#(\d)")
_TARGET = re.compile(r"\s*\\((?:[^\W\d_]|\*)+|.)")


def _named(text: str, at: int) -> tuple[str, int] | None:
    """A macro's name, braced or bare."""
    start = skip_blank(text, at)
    braced = read_group(text, start)
    if braced and text[start] == "{":
        return braced[0].strip().removeprefix("\\"), braced[1]
    m = _MACRO.match(text, start)
    return (m[1], m.end()) if m else None


def extract(text: str) -> tuple[str, dict[str, tuple[int, str]], dict[str, str]]:
    """The text without its definitions, the macros (parameters, body) and the aliases; a malformed definition stays."""
    macros: dict[str, tuple[int, str]] = {}
    aliases: dict[str, str] = {}
    out, at = [], 0
    for m in _DEFINITION.finditer(text):
        if m.start() < at:
            continue
        end = _define(m[1], text, m.end(), macros, aliases)
        if end is not None:
            out.append(text[at : m.start()])
            at = end
    return "".join([*out, text[at:]]), macros, aliases


def _define(how: str, text: str, at: int, macros: dict, aliases: dict) -> int | None:
    if how == "let":
        m = _MACRO.match(text, skip_blank(text, at))
        if not m:
            return None
        k = skip_blank(text, m.end())
        k += text.startswith("=", k)
        target = _TARGET.match(text, k)
        if not target:
            return None
        aliases[m[1]] = target[1]
        return target.end()
    named = _named(text, at)
    if not named:
        return None
    name, k = named
    if how == "def":
        body_at = text.find("{", k)
        if body_at < 0:
            return None
        count = max((int(d) for d in _SLOT.findall(text[k:body_at])), default=0)
        k = body_at
    else:
        m = _COUNT.match(text, k)
        count, k = (int(m[1]), m.end()) if m else (0, k)
    body = read_group(text, k)
    if not body:
        return None
    if not (how == "providecommand" and name in macros):
        macros[name] = count, body[0]
    return body[1]


def _once(text: str, macros: dict[str, tuple[int, str]], aliases: dict[str, str]) -> str:
    out, at = [], 0
    for m in _MACRO.finditer(text):
        if m.start() < at:
            continue
        name = m[1]
        if name in macros:
            count, body = macros[name]
            args, k = [], m.end()
            while len(args) < count and (got := read_group(text, k)):
                args.append(got[0])
                k = got[1]
            made = _SLOT.sub(lambda s: args[int(s[1]) - 1] if 0 < int(s[1]) <= len(args) else "", body)
            out += [text[at : m.start()], made]
            at = k
        elif name in aliases:
            out += [text[at : m.start()], "\\" + aliases[name]]
            at = m.end()
    return "".join([*out, text[at:]])


def expand(text: str) -> str:
    """Definitions removed and calls replaced, for at most ten rounds or until nothing changes."""
    if not _DEFINITION.search(text):
        return text
    text, macros, aliases = extract(text)
    for _ in range(ROUNDS):
        after = _once(text, macros, aliases)
        if after == text:
            break
        text = after
    return text
