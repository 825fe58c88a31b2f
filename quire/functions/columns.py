"""Column functions of the engine that need no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
#: What TeX needs escaped in running text; the backslash comes first.
_TEX = (("\\", "\\textbackslash{}"), ("{", "\\{"), ("}", "\\}"), ("$", "\\$"), ("&", "\\&"), ("#", "\\#"), ("%", "\\%"), ("_", "\\_"), ("~", "\\textasciitilde{}"), ("^", "\\textasciicircum{}"))


def _replaced(text: Column, pairs) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_html(text: Column) -> Column:
    return _replaced(text, _ESCAPES)


def escape_tex(text: Column) -> Column:
    """Text that reads as itself in a TeX source; the braces of the backslash's own escape are spared."""
    return F.array_join(F.transform(F.split(text, r"\\", -1), lambda part: _replaced(part, _TEX[1:])), "\\textbackslash{}")


def ligatures(text: Column) -> Column:
    """Dashes and double quotes, outside of `$...$`; an unclosed dollar is text."""
    runs = F.regexp_extract_all(text, F.lit(r"\$[^$]*\$|[^$]+|\$"), F.lit(0))
    made = lambda run: _replaced(run, (("---", "—"), ("--", "–"), ("``", "“"), ("''", "”")))
    return F.array_join(F.transform(runs, lambda run: F.when(run.startswith("$"), run).otherwise(made(run))), "")


def split_keys(keys: Column) -> Column:
    return F.filter(F.transform(F.split(keys, ","), lambda k: F.trim(k)), lambda k: k != "")


def first_upper(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def plural(text: Column) -> Column:
    return F.concat(text, F.lit("s"))


def today(as_of: Column) -> Column:
    return F.date_format(as_of, "MMMM dd, yyyy")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def stem(path: Column) -> Column:
    """A path without its last extension."""
    return F.regexp_replace(path, r"\.[^./]*$", "")


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, r"%[^\n]*", "")


def line_of(text: Column, at: Column) -> Column:
    """Zero-based line of a character offset."""
    before = F.substring(text, F.lit(1), at)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def column_of(text: Column, at: Column) -> Column:
    """Characters between the start of its line and an offset."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1))


def byte_offset(text: Column, at: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), at))


def odd_dollars(text: Column) -> Column:
    shown = without_comments(text)
    return (F.length(shown) - F.length(F.replace(shown, F.lit("$"), F.lit("")))) % 2 == 1


def brace_counts(text: Column) -> Column:
    """Struct of the closing braces without an opening one, and of the opening ones that stay open."""
    marks = F.regexp_extract_all(without_comments(text), F.lit(r"[{}]"), F.lit(0))

    def step(held: Column, mark: Column) -> Column:
        opening = mark == "{"
        low = ~opening & (held["depth"] == 0)
        depth = F.when(opening, held["depth"] + 1).when(low, held["depth"]).otherwise(held["depth"] - 1)
        return F.struct(depth.alias("depth"), F.when(low, held["unmatched"] + 1).otherwise(held["unmatched"]).alias("unmatched"))

    out = F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("unmatched")), step)
    return F.struct(out["unmatched"].alias("unmatched"), out["depth"].alias("unclosed"))


def packages(text: Column) -> Column:
    """Files that the preamble asks for, each once, in order: the class, then packages."""
    preamble = F.split(text, r"\\begin\{document\}")[0]

    def files(pattern: str, ending: str) -> Column:
        lists = F.regexp_extract_all(preamble, F.lit(pattern + r"\s*(?:\[[^\]]*\])?\s*\{([^}]*)\}"), F.lit(1))
        names = F.flatten(F.transform(lists, split_keys))
        return F.transform(names, lambda n: F.concat(F.regexp_replace(n, r"\[.*", ""), F.lit(ending)))

    return F.array_distinct(F.concat(files(r"\\documentclass", ".cls"), files(r"\\(?:usepackage|RequirePackage)", ".sty")))


#: How a source reads a file: `\\input{name}`, `\\include{name}`, or `\\input name` up to a blank, a command, a comment or a brace.
CALL = r"\\(?:input|include)\s*\{[^{}]*\}|\\input\s+[^\s\\%{}]+"


def input_calls(text: Column) -> Column:
    """Array of (call, name) as they stand in the source, each once; calls without a name are none."""
    calls = F.array_distinct(F.regexp_extract_all(text, F.lit(CALL), F.lit(0)))
    name = lambda c: F.trim(F.regexp_extract(c, r"(?s)^\\(?:input|include)\s*(?:\{(.*)\})?(.*)$", 1))
    bare = lambda c: F.trim(F.regexp_extract(c, r"^\\input\s+([^\s\\%{}]+)$", 1))
    found = F.transform(calls, lambda c: F.struct(c.alias("call"), F.when(c.endswith("}"), name(c)).otherwise(bare(c)).alias("name")))
    return F.filter(found, lambda x: x["name"] != "")


def inputs(text: Column) -> Column:
    """Names of the files that the source reads."""
    return F.array_distinct(F.transform(input_calls(text), lambda x: x["name"]))


def flat_command(text: Column, name: str) -> Column:
    """Arguments of a command, where they hold no braces and no macro makes the command."""
    return F.regexp_extract_all(text, F.lit(r"\\" + name + r"(?![A-Za-z])\*?\s*(?:\[[^\]]*\])?\s*\{([^{}]*)\}"), F.lit(1))


def hit_rate(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0))
