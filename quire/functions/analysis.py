"""Findings, outlines, completions and hover texts of TeX sources. Offsets are UTF-8 bytes."""

from __future__ import annotations

import re

from quire.functions import dims
from quire.functions.lexer import byte_offset
from quire.functions.parser import parse

_COMMENT = re.compile(r"%[^\n]*")
_MARKS = re.compile(r"\\(begin|end)\{([^}]*)\}")


def _visible(text: str) -> str:
    """The source with comments blanked, at unchanged offsets."""
    return _COMMENT.sub(lambda m: " " * len(m[0]), text)


def _finding(text: str, start: int, end: int, severity: str, message: str, code: str) -> dict:
    return {"start": byte_offset(text, start), "end": byte_offset(text, end), "severity": severity, "message": message, "code": code}


def braces(text: str) -> list[dict]:
    """Braces without a partner; escaped braces count as braces do."""
    held, out = [], []
    for m in re.finditer(r"[{}]", _visible(text)):
        if m[0] == "{":
            held.append(m.start())
        elif held:
            held.pop()
        else:
            out.append(_finding(text, m.start(), m.end(), "error", "Unmatched closing brace '}'", "unmatched-brace"))
    return out + [_finding(text, k, k + 1, "error", "Unclosed '{' — missing closing brace", "unclosed-brace") for k in held]


def environments(text: str, compat: bool = False) -> list[dict]:
    """Environments that don't begin and end in pairs. `compat` reads all beginnings before any end that follows the last of them."""
    marks = list(_MARKS.finditer(text))
    if compat:
        begins = [m for m in marks if m[1] == "begin"]
        last = begins[-1].start() if begins else -1
        marks = begins + [m for m in marks if m[1] == "end" and m.start() > last]
    held, out = [], []
    for m in marks:
        if m[1] == "begin":
            held.append(m)
        elif not held:
            out.append(_finding(text, m.start(), m.end(), "error", f"\\end{{{m[2]}}} without matching \\begin{{{m[2]}}}", "env-unmatched-end"))
        elif (opened := held.pop())[2] != m[2]:
            out.append(_finding(text, m.start(), m.end(), "error", f"Environment mismatch: expected \\end{{{opened[2]}}}, found \\end{{{m[2]}}}", "env-mismatch"))
    return out + [_finding(text, m.start(), m.end(), "error", f"Unclosed environment '{m[2]}'", "env-unclosed") for m in held]


def math_delimiters(text: str) -> list[dict]:
    """An odd number of dollars; escaped ones count too."""
    found = [m.start() for m in re.finditer(r"\$", _visible(text))]
    return [_finding(text, found[-1], found[-1] + 1, "error", "Unclosed inline math delimiter '$'", "unclosed-math")] if len(found) % 2 else []


def structure(text: str) -> list[dict]:
    begin, end = text.find("\\begin{document}"), text.find("\\end{document}")
    out = []
    if "\\documentclass" not in text and "\\begin{" in text:
        out.append(_finding(text, 0, min(1, len(text)), "warning", "Missing \\documentclass declaration", "missing-documentclass"))
    if begin >= 0 > end:
        out.append(_finding(text, begin, begin + 16, "warning", "Missing \\end{document}", "missing-end-document"))
    if end >= 0 > begin:
        out.append(_finding(text, end, end + 14, "error", "\\end{document} without \\begin{document}", "orphan-end-document"))
    return out


def findings(text: str, compat: bool = False) -> list[dict]:
    return braces(text) + environments(text, compat) + math_delimiters(text) + structure(text)


def outline(text: str) -> list[dict]:
    """Sections nested by rank, and labels at the root; the offset is that of the first command with that title.

    A chapter ranks above a section, whatever its level number.
    """
    out: list[dict] = []
    held: list[tuple[int, int]] = []
    for node in parse(text):
        if node.kind == "Section":
            rank = {0: 0, 6: 1}.get(node.level, node.level + 1)
            while held and held[-1][0] >= rank:
                held.pop()
            m = re.search(r"\\(?:part|chapter|(?:sub)*section|(?:sub)?paragraph)\*?\{" + re.escape(node.text) + r"\}", text)
            start = m.start() if m else 0
            out.append({"symbol_id": len(out), "parent_id": held[-1][1] if held else -1, "depth": len(held), "name": node.text, "kind": "section" if node.level <= 1 or node.level == 6 else "subsection", "start": byte_offset(text, start), "end": byte_offset(text, m.end() if m else 0)})
            held.append((rank, out[-1]["symbol_id"]))
        elif node.kind == "Label":
            start = max(0, text.find(f"\\label{{{node.text}}}"))
            out.append({"symbol_id": len(out), "parent_id": -1, "depth": 0, "name": f"#{node.text}", "kind": "label", "start": byte_offset(text, start), "end": byte_offset(text, start + len(node.text) + 8)})
    return out


def completions(text: str, at: int) -> list[tuple[str, str, str, str]]:
    """(label, inserted text, detail, kind) for the cursor at a byte offset."""
    before = text.encode()[:at].decode("utf-8", "ignore")
    start = max(before.rfind("\\"), -1)
    start = start if start >= 0 else before.rfind("{")
    word = before[start:].lstrip("\\") if start >= 0 else ""
    for opening in ("begin{", "end{"):
        if word.startswith(opening):
            return [(n, n, d, "environment") for n, d in dims.ENVIRONMENTS if n.startswith(word[len(opening) :])]
    blocks = {n for n, _ in dims.ENVIRONMENTS} | {"begin", "end"}
    return [(n, n + "{}", d, "environment" if n in blocks else "command") for n, d in dims.COMPLETIONS if n.startswith(word)]


def hover(text: str, at: int) -> str | None:
    """What the command at or before a byte offset means."""
    before = text.encode()[:at].decode("utf-8", "ignore")
    start = before.rfind("\\")
    if start < 0:
        return None
    name = re.match(r"[A-Za-z*]*", text[start + 1 :])[0]
    detail = dict(dims.COMPLETIONS).get(name)
    return f"`\\{name}` — {detail}" if detail else None
