"""Scanning helpers for TeX source: balanced groups, comments, positions."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from functools import cached_property

_BRACE = re.compile(r"\\.|[{}]", re.DOTALL)
_BLANK = re.compile(r"(?:\s|%[^\n]*\n?)*")
_NAME = re.compile(r"[A-Za-z@]+")


def group_end(text: str, at: int) -> int:
    """Index just after the brace that closes the one at `at`; -1 if there is none. Escaped braces don't count."""
    depth = 0
    for m in _BRACE.finditer(text, at):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if depth == 0:
                return m.end()
    return -1


def skip_blank(text: str, at: int) -> int:
    """Past white space and comments."""
    return _BLANK.match(text, at).end()


def read_group(text: str, at: int, blank: bool = True) -> tuple[str, int] | None:
    """(contents, index after) of the brace group at `at`; an unclosed group runs to the end of the text."""
    start = skip_blank(text, at) if blank else at
    if start >= len(text) or text[start] != "{":
        return None
    end = group_end(text, start)
    return (text[start + 1 :], len(text)) if end < 0 else (text[start + 1 : end - 1], end)


def read_option(text: str, at: int) -> tuple[str, int] | None:
    """(contents, index after) of the bracket group at `at`; brackets within braces belong to it."""
    start = skip_blank(text, at)
    if start >= len(text) or text[start] != "[":
        return None
    k, depth = start + 1, 0
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 2
            continue
        depth += (c == "{") - (c == "}")
        if c == "]" and depth <= 0:
            return text[start + 1 : k], k + 1
        k += 1
    return None


def read_name(text: str, at: int) -> tuple[str, int]:
    """(name, index after) of the control sequence whose backslash is at `at`: letters, or one other character."""
    m = _NAME.match(text, at + 1)
    if m:
        return m[0], m.end()
    return text[at + 1 : at + 2], min(at + 2, len(text))


def environment_end(text: str, name: str, at: int) -> tuple[int, int]:
    """(end of the body, index after `\\end{name}`) for a body that starts at `at`; environments of the same name nest.

    Without an end, the body runs to `\\end{document}` or the end of the text.
    """
    depth = 0
    for m in re.finditer(r"\\(begin|end)\s*\{" + re.escape(name) + r"\}", text[at:]):
        if m[1] == "begin":
            depth += 1
        elif depth:
            depth -= 1
        else:
            return at + m.start(), at + m.end()
    last = text.find("\\end{document}", at)
    last = len(text) if last < 0 else last
    return last, last


def split_top(text: str, mark: str) -> list[str]:
    """Split on `mark` (`\\\\` or `&`) outside braces and environments; escaped characters are no marks."""
    out, start, k, depth = [], 0, 0, 0
    while k < len(text):
        if depth == 0 and text.startswith(mark, k):
            out.append(text[start:k])
            k += len(mark)
            start = k
            continue
        if text[k] == "\\":
            if text.startswith("\\begin{", k):
                depth += 1
                k += 7
                k = max(k, text.find("}", k) + 1)
                continue
            if text.startswith("\\end{", k):
                depth = max(0, depth - 1)
                k = max(k + 5, text.find("}", k) + 1)
                continue
            k += 2
            continue
        if text[k] == "{":
            depth += 1
        elif text[k] == "}":
            depth = max(0, depth - 1)
        k += 1
    return [*out, text[start:]]


def byte_offset(text: str, at: int) -> int:
    return len(text[:at].encode("utf-8", "surrogatepass"))


def line_and_column(text: str, at: int) -> tuple[int, int]:
    """Zero-based line, and characters since its start."""
    before = text[:at]
    line = before.count("\n")
    return line, len(before) - (before.rfind("\n") + 1)


_MARK = re.compile(r"\\.|[{}\[\]$]|\n\n", re.DOTALL)
_ENVIRONMENT = re.compile(r"\\(begin|end)\s*\{([^{}\\]*)\}")
_ITEM = re.compile(_ENVIRONMENT.pattern + r"|\\(?:bib)?item(?![A-Za-z])|\\.|[{}]", re.DOTALL)
_DOCUMENT_END = "\\end{document}"


#: Levels of braces and environments within a formula, as many as TeX itself allows; a deeper one stays as it is written.
MOST_LEVELS = 255
_LEVEL = re.compile(r"\\(begin|end)(?![A-Za-z])|\\.|[{}]", re.DOTALL)


def levels(text: str) -> int:
    """The greatest depth in braces and environments."""
    depth = most = 0
    if text.count("{") + text.count("\\begin") <= MOST_LEVELS:
        return 0  # no need to know
    for m in _LEVEL.finditer(text):
        if m[0] == "{" or m[1] == "begin":
            depth += 1
            most = max(most, depth)
        elif m[0] == "}" or m[1] == "end":
            depth -= 1
    return most


class Source:
    """A text whose braces, brackets, dollars and environments are matched once, so that windows of it are read in place.

    Windows are (start, end). What closes beyond a window's end is unclosed in it.
    """

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def _marks(self) -> tuple[dict[int, int], dict[int, int], dict[int, int]]:
        """Of each opening brace the index after its closing one; of each bracket and dollar the place of what closes it; -1 for none.

        A bracket or dollar is closed by the first one after it that is no deeper in braces; a dollar within its paragraph.
        """
        braces, brackets, dollars = {}, {}, {}
        opened: list[int] = []
        squares: list[tuple[int, int]] = []
        sums: list[tuple[int, int]] = []
        depth = 0
        for m in _MARK.finditer(self.text):
            c, at = m[0], m.start()
            if c == "{":
                braces[at] = -1
                opened.append(at)
                depth += 1
            elif c == "}":
                depth -= 1
                if opened:
                    braces[opened.pop()] = at + 1
            elif c == "[":
                brackets[at] = -1
                heapq.heappush(squares, (-depth, at))
            elif c == "]":
                while squares and -squares[0][0] >= depth:
                    brackets[heapq.heappop(squares)[1]] = at
            elif c == "$":
                while sums and -sums[0][0] >= depth:
                    dollars[heapq.heappop(sums)[1]] = at
                dollars[at] = -1
                heapq.heappush(sums, (-depth, at))
            elif c == "\n\n":
                sums.clear()
        return braces, brackets, dollars

    def blank(self, at: int, end: int) -> int:
        return _BLANK.match(self.text, at, end).end()

    def name(self, at: int, end: int) -> tuple[str, int]:
        m = _NAME.match(self.text, at + 1, end)
        if m:
            return m[0], m.end()
        return self.text[at + 1 : min(at + 2, end)], min(at + 2, end)

    def group_end(self, at: int, end: int) -> int:
        stop = self._marks[0].get(at)
        if stop is None:  # a brace that a backslash of a verbatim text stands before
            stop = group_end(self.text, at)
        return stop if stop <= end else -1

    def group(self, at: int, end: int) -> tuple[int, int, int] | None:
        """(start, end, index after) of a brace group's contents; an unclosed one runs to the end of the window."""
        start = self.blank(at, end)
        if start >= end or self.text[start] != "{":
            return None
        stop = self.group_end(start, end)
        return (start + 1, end, end) if stop < 0 else (start + 1, stop - 1, stop)

    def option(self, at: int, end: int) -> tuple[int, int, int] | None:
        start = self.blank(at, end)
        if start >= end or self.text[start] != "[":
            return None
        stop = self._marks[1].get(start)
        if stop is None:
            got = read_option(self.text, start)
            stop = got[1] - 1 if got else -1
        return (start + 1, stop, stop + 1) if 0 <= stop < end else None

    def dollar(self, at: int, end: int) -> int:
        """The dollar that closes the one at `at`; -1 if there is none."""
        stop = self._marks[2].get(at)
        if stop is None:
            depth, k, stop = 0, at + 1, -1
            while k < end:
                c = self.text[k]
                if c == "\\":
                    k += 2
                    continue
                if c == "$" and depth <= 0:
                    stop = k
                    break
                if self.text.startswith("\n\n", k):
                    break
                depth += (c == "{") - (c == "}")
                k += 1
        return stop if stop < end else -1

    @cached_property
    def _environments(self) -> dict[str, tuple[list[int], list[int], list[int]]]:
        """By name: where beginnings and ends start and end, and for each the next end that none of those from it on opens."""
        found: dict[str, list] = {}
        for m in _ENVIRONMENT.finditer(self.text):
            found.setdefault(m[2], []).append((m.start(), m.end(), m[1] == "end"))
        out = {}
        for name, marks in found.items():
            n = len(marks)
            free = [n] * (n + 1)
            for k in range(n - 1, -1, -1):
                own = free[k + 1]
                free[k] = k if marks[k][2] else free[own + 1] if own < n else n
            out[name] = [a for a, _, _ in marks], [b for _, b, _ in marks], free
        return out

    @cached_property
    def _document_ends(self) -> list[int]:
        return [m.start() for m in re.finditer(re.escape(_DOCUMENT_END), self.text)]

    def environment_end(self, name: str, at: int, end: int) -> tuple[int, int]:
        """As the function of this name, within a window."""
        if any(c in name for c in "{}\\"):
            stop, after = environment_end(self.text[:end], name, at)
            return stop, after
        starts, ends, free = self._environments.get(name, ([], [], [0]))
        k = free[bisect_left(starts, at)]
        if k < len(starts) and ends[k] <= end:
            return starts[k], ends[k]
        k = bisect_left(self._document_ends, at)
        last = self._document_ends[k] if k < len(self._document_ends) else end
        last = last if last + len(_DOCUMENT_END) <= end else end
        return last, last

    @cached_property
    def _items(self) -> tuple[list[int], list[int], dict[tuple[str, int], tuple[list[int], list[int]]]]:
        """Places where the depth in braces and environments changes, the depths after them, and the marks of items by name and depth."""
        places, depths, items, depth = [], [], {}, 0
        for m in _ITEM.finditer(self.text):
            step = (m[1] == "begin") - (m[1] == "end") + (m[0] == "{") - (m[0] == "}")
            if step:
                depth += step
                places.append(m.start())
                depths.append(depth)
            elif m[0] in ("\\item", "\\bibitem"):
                of = items.setdefault((m[0], depth), ([], []))
                of[0].append(m.start())
                of[1].append(m.end())
        return places, depths, items

    def items(self, mark: str, at: int, end: int) -> list[tuple[int, int]]:
        """Windows of what follows each `mark` outside braces and inner environments."""
        places, depths, items = self._items
        k = bisect_left(places, at)
        starts, ends = items.get((mark, depths[k - 1] if k else 0), ([], []))
        a, b = bisect_left(starts, at), bisect_left(starts, end)
        return [(ends[k], starts[k + 1] if k + 1 < b else end) for k in range(a, b)]
