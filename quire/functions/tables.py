"""The tabular sub-language: column specifications, rows and cells."""

from __future__ import annotations

import re

from quire.functions.lexer import group_end, read_group

_RULE = re.compile(r"\\(?:toprule|midrule|bottomrule|hline|cline|cmidrule)(?![A-Za-z])")
_SPAN = re.compile(r"\\multicolumn(?![A-Za-z])")
_ALIGN = {"l": "left", "c": "center", "r": "right", "X": "left", "p": "left", "m": "left", "b": "left"}


def column_spec(spec: str) -> list[str]:
    """Alignments of the columns: `*{n}{spec}` repeats, widths and decorations have no column of their own."""
    out, k = [], 0
    while k < len(spec):
        c = spec[k]
        k += 1
        if c == "*":
            times = read_group(spec, k)
            body = read_group(spec, times[1]) if times else None
            if body and times[0].strip().isdigit():
                out += column_spec(body[0]) * int(times[0])
                k = body[1]
        elif c in "@!><":
            end = group_end(spec, k) if spec[k : k + 1] == "{" else k
            k = len(spec) if end < 0 else end
        elif c in _ALIGN:
            out.append(_ALIGN[c])
            if c in "pmb" and spec[k : k + 1] == "{":
                end = group_end(spec, k)
                k = len(spec) if end < 0 else end
    return out


def _cut(line: str, mark: str) -> list[str]:
    """Split on a mark that no backslash escapes and no brace holds."""
    if mark not in line:
        return [line]
    if "{" not in line and "}" not in line and line.count("\\") == (2 * line.count(mark) if mark == "\\\\" else 0):  # nothing escapes or holds
        return line.split(mark)
    out, start, k, depth = [], 0, 0, 0
    while k < len(line):
        if depth <= 0 and line.startswith(mark, k):
            out.append(line[start:k])
            k = start = k + len(mark)
        elif line[k] == "\\":
            k += 2
        else:
            depth += (line[k] == "{") - (line[k] == "}")
            k += 1
    return [*out, line[start:]]


def cells_of(text: str) -> list[str]:
    """A cell, or as many as it spans: the first holds the contents."""
    text = text.strip()
    if "\\" not in text:
        return [text]
    if m := _SPAN.match(text):
        args, k = [], m.end()
        while len(args) < 3 and (got := read_group(text, k)):
            args.append(got[0])
            k = got[1]
        if len(args) == 3 and args[0].strip().isdigit():
            return [args[2].strip(), *[""] * (max(1, int(args[0])) - 1)]
    return [text.replace("\\$", "$").replace("\\&", "&")]


def parse_rows(body: str) -> list[tuple[list[str], bool]]:
    """(cells, is a rule) of each row. Rows end with a line or `\\\\`; a line without `&` is no row unless it spans columns."""
    rows: list[tuple[list[str], bool]] = []
    for line in body.splitlines():
        for part in _cut(line, "\\\\"):
            part = part.strip()
            if not part:
                continue
            if _RULE.match(part):
                rows.append(([], True))
                continue
            cells = _cut(part, "&")
            if len(cells) > 1:
                rows.append(([c for cell in cells for c in cells_of(cell)], False))
            elif _SPAN.match(part):
                rows.append((cells_of(part), False))
    return rows
