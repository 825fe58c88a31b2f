"""Conversion of single sources, for callers without a corpus."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from quire.functions import dims, macros, parser, render
from quire.functions.columns import CALL

#: What made an output.
PRODUCER = "quire"
#: Bytes of a file that are read between two reports.
CHUNK = 1 << 20
Report = Callable[[str, float], None]


class UnsupportedFormat(ValueError):
    pass


class ParseError(ValueError):
    """A source that can't be read as text."""


@dataclass(frozen=True)
class Options:
    """`form`: html, docx, epub or txt, or another name of one; `today`: what `\\today` reads; `plugins`: handlers of unknown commands;
    `base_dir`: where names of files are looked for first (None: nowhere, for strings), then `search_paths`, then as they are.
    """

    form: str = "html"
    today: str = ""
    plugins: tuple = ()
    base_dir: str | None = None
    search_paths: tuple[str, ...] = ()


def format_name(name: str) -> str:
    """The format of a name, whatever its case; UnsupportedFormat if there is none."""
    low = name.strip().lower()
    for form, _, _, others in dims.FORMATS:
        if low == form or low in others:
            return form
    if low == "txt":
        return low
    raise UnsupportedFormat(name)


def parse(source: str, plugins: tuple = ()) -> list[parser.Node]:
    for plugin in plugins:
        plugin.on_load()
    made = parser.parse(source, plugins)
    for plugin in plugins:
        made = plugin.transform(made)
    return made


def splice(source: str, options: Options, within: tuple[str, ...] = ()) -> str:
    """The source with the files that it names put in; a missing file, and one within itself, reads as nothing."""

    def text(m: re.Match) -> str:
        braced = re.fullmatch(r"(?s)\\(input|include)\s*\{(.*)\}", m[0])
        name = (braced[2] if braced else m[0][len("\\input") :]).strip()
        if not name:
            return m[0]
        name += "" if os.path.splitext(name)[1] else ".tex"
        folders = ([] if options.base_dir is None else [options.base_dir]) + [*options.search_paths, ""]
        path = next((p for p in (os.path.join(f, name) for f in folders) if os.path.isfile(p)), None)
        inner = "" if path is None or os.path.realpath(path) in within else splice(read_file(path), options, (*within, os.path.realpath(path)))
        return f"\\clearpage {inner}\\clearpage " if braced and braced[1] == "include" else inner

    return re.sub(CALL, text, source)


def read_file(path: str, report: Report | None = None) -> str:
    """A file's text, read in chunks; `report` is told of the stage `reading` and how far it is, up to 30 per cent."""
    size, parts = max(1, os.path.getsize(path)), []
    with open(path, "rb") as f:
        while chunk := f.read(CHUNK):
            parts.append(chunk)
            if report:
                report("reading", 30 * min(1.0, sum(map(len, parts)) / size))
    try:
        return b"".join(parts).decode()
    except UnicodeDecodeError as e:
        raise ParseError(f"{path} is not valid UTF-8: {e.reason} at byte {e.start}") from e


def expand(source: str) -> str:
    return macros.expand(source)


def convert_string(source: str, options: Options = Options()) -> bytes:
    """The source in the format of the options. PDF pages are given as layout elements only, by `operators.nodes.layout`."""
    form = format_name(options.form)
    if options.base_dir is not None or options.search_paths:
        source = splice(source, options)
    made = parse(source, options.plugins)
    if form == "html":
        return render.page(made, options.today).encode()
    if form == "docx":
        return render.docx(made)
    if form == "epub":
        return render.epub(made, options.today)
    if form == "txt":
        return render.plain(made).encode()
    raise UnsupportedFormat(form)


def convert_file(path: str, options: Options = Options(), report: Report | None = None) -> bytes:
    """As `convert_string`; names of files are looked for in the file's folder. `report` is told of each stage, and of its end."""
    tell = report or (lambda stage, percent: None)
    tell("reading", 0)
    source = read_file(path, report)
    tell("parsing", 30)
    if options.base_dir is None:
        options = replace(options, base_dir=os.path.dirname(os.path.abspath(path)))
    source = splice(source, options, (os.path.realpath(path),))
    tell("building", 60)
    made = convert_string(source, replace(options, base_dir=None, search_paths=()))
    tell("done", 100)
    return made
