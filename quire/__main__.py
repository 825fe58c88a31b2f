"""python -m quire INPUT... --format html,docx --output FOLDER: files, one output for each format."""

from __future__ import annotations

import argparse
import os
import sys

from quire import api


def main(argv: list[str] | None = None) -> int:
    ask = argparse.ArgumentParser(prog="quire", description="Converts TeX sources.")
    ask.add_argument("inputs", nargs="+")
    ask.add_argument("--format", default="html", help="formats, separated by commas: html, docx, epub, txt")
    ask.add_argument("--output", default=".", help="folder of the outputs")
    ask.add_argument("--today", default="")
    ask.add_argument("--search-path", action="append", default=[], help="a folder of files that sources read; may be given again")
    ask.add_argument("--progress", action="store_true", help="say what stage a file has reached")
    ask.add_argument("--keep-intermediate", action="store_true", help="also write the expanded source")
    given = ask.parse_args(argv)
    failed = 0
    for path in given.inputs:
        stem = os.path.splitext(os.path.basename(path))[0]
        for name in given.format.split(","):
            try:
                report = (lambda stage, percent: print(f"{path}: {stage} {percent:.0f} %", file=sys.stderr)) if given.progress else None  # noqa: B023
                made = api.convert_file(path, api.Options(name, given.today, search_paths=tuple(given.search_path)), report)
            except (OSError, api.ParseError, api.UnsupportedFormat) as e:
                print(f"{path}: {type(e).__name__}: {e}", file=sys.stderr)
                failed = 1
                continue
            with open(os.path.join(given.output, f"{stem}.{api.format_name(name)}"), "wb") as out:
                out.write(made)
        if given.keep_intermediate and os.path.exists(path):
            with open(path, encoding="utf-8") as f, open(os.path.join(given.output, f"{stem}.expanded.tex"), "w", encoding="utf-8") as out:
                out.write(api.expand(f.read()))
    return failed


if __name__ == "__main__":
    sys.exit(main())
