import random
import time
from functools import partial
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from quire.functions import analysis, mathfmt, mathml, parser, render, tables
from quire.functions.plugins import Plugin
from quire.operators import extractors, nodes, outlines, serialise, table_functions, tabular
from quire.plans import catalogue, relational  # noqa: F401
from quire.plans import corpus as B

BUILDERS = (B.lineitem_tables, B.nation_tables, B.geo_outline, B.customer_citations, B.order_labels, B.nation_lists, B.part_notes, B.macro_docs, B.order_meta, B.broken_docs, B.mixed_docs)
ODD = [
    "\\begin{itemize}\\item\\item a\\item\\item[x] b\\begin{enumerate}\\item\\item c\\end{enumerate}\\item\\end{itemize}", "", None,
    "\\begin{description}\\item[t]\\item\\item[u] v\\item[]\\end{description}x\\begin{itemize}\\end{itemize}",
    "\\begin{quote}a\\begin{lemma}[l]b $x^2$\\end{lemma}\\end{quote}\\[\\frac{1}{2}\\]\\begin{align}a&=b\\\\c\\end{align}\\(y<z\\)",
    "\\cite{a,b}\\supercite{k}\\footcite{<}\\nocite{z}\\ref{q}\\pageref{w}\\url{a&b}\\SI{5}{kg}\\SIrange{1}{2}{m}\\raisebox{1pt}{up}\\multirow{2}{*}{m}\\today\\chapter{C}\\paragraph{P}\\caption{d}\\textbf{}\\quad\\,",
]


def docs_of(spark, texts, name="tex"):
    return spark.createDataFrame(list(enumerate(texts)), f"doc_id long, {name} string")


def written(spark, docs):
    table = nodes.nodes(docs, columns=serialise.READ, forms=True)
    for name, made, exact in (("html", serialise.html(docs, table, "May 1"), nodes.html(docs, "May 1")), ("plain", serialise.plain(docs, table), nodes.plain_text(docs))):
        assert {r.doc_id: r[name] for r in made.collect()} == {r.doc_id: r[name] for r in exact.collect()}


@pytest.mark.parametrize("builder", BUILDERS, ids=lambda b: b.__name__)
def test_trees_written_by_sql_equal_the_renderers(spark, small, builder):
    written(spark, builder(spark, small))


def test_odd_trees_written_by_sql(spark):
    written(spark, docs_of(spark, ODD))
    written(spark, docs_of(spark, ODD).limit(0))


def test_contents_equal_slices_of_the_tree(spark):
    docs = docs_of(spark, [*ODD, "é\\begin{quote}ü\\begin{quote}\\end{quote}ß\\begin{quote}漢\\end{quote}\\end{quote}z"])
    table = nodes.nodes(docs)
    for kind in ("Quote", "ItemList", "Theorem"):
        got = {(r.doc_id, r.outer_id): r.text for r in serialise.contents(table, kind).collect()}
        assert got == {(r.doc_id, r.node_id): r.text for r in nodes.texts_of(docs, kind).collect()}


def table_source(rng):
    cell = lambda: rng.choice(["a", " b ", "\\$5", "x\\&y", "{p & q}", "{r \\\\ s}", "\\multicolumn{2}{c}{wide {x} y}", "\\textbf{k}", "{a {b & c} d}", "é", "", "\\multicolumn{3}{|c|}{ }"])
    line = lambda: rng.choice(["\\hline", "\\toprule", "\\multicolumn{2}{l}{all}", "lone", "\\midrule a & b", " & ".join(cell() for _ in range(rng.randint(1, 4)))])
    body = "".join(line() + rng.choice([" \\\\\n", "\n", " \\\\ ", "\\\\\n\n"]) for _ in range(rng.randint(0, 6)))
    name = rng.choice(["tabular", "tabular", "longtable", "tabularx", "tabular*"])
    spec = rng.choice(["lcr", "|l|p{3cm}|", "*{2}{r}|c", "l*{2}{c*{2}{r}}", "@{}l@{ }r", "X>{\\bfseries}c", "m{1{a}}b{2}", "*{3}{p{1cm}}"])
    return "\\begin{%s}%s%s{%s}%s\\end{%s}" % (name, "{5cm}" if name in ("tabularx", "tabular*") else "", rng.choice(["", "[t]"]), spec, body, name)


def test_tables_by_expressions_equal_the_parser(spark):
    rng = random.Random(5)
    around = lambda: rng.choice(["", "\\begin{document}", "text "])
    texts = [around() + "".join(rng.choice(["", "a{b}", "\n\n"]) + table_source(rng) for _ in range(rng.randint(0, 3))) + rng.choice(["", "\\end{document}", "$x$", "% c"]) for _ in range(300)]
    texts += ["\\begin{center}" + table_source(rng) + "\\end{center}" for _ in range(40)] + [None, "", "\\footnote{" + table_source(rng) + "}", "\\begin{odd}" + table_source(rng) + "\\end{odd}", "\\begin{tabular}{l}a & b", "\\begin{tabular}{l}\\begin{tabular}{l}a & b\\end{tabular} & c\\end{tabular}"]
    docs = docs_of(spark, texts)
    fits = docs.where(tabular.readable(F.col("tex")))
    assert fits.count() > 80
    row = lambda r: (r.doc_id, r.table_idx, r.name, tuple(r.columns), tuple((tuple(x.cells), x.is_separator) for x in r.rows))
    native, exact = sorted(map(row, tabular.native_tables(fits).collect())), sorted(map(row, tabular.parsed_tables(fits).collect()))
    assert native == exact and len(native) > 80
    assert sorted(map(row, tabular.tables(docs).collect())) == sorted(map(row, tabular.parsed_tables(docs).collect()))


def test_outlines_by_windows_equal_the_stack(spark):
    rng = random.Random(6)
    pieces = ["\\part{P}", "\\chapter{C}", "\\section{S}", "\\subsection{SS}", "\\subsubsection{T}", "\\paragraph{Q}", "\\subparagraph{R}", "\\label{l}", " x ", "\\begin{quote}\\section{in}\\end{quote}"]
    docs = docs_of(spark, ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(200)])
    columns = ("doc_id", "symbol_id", "parent_id", "depth", "name", "kind", "parent")
    assert sorted(map(repr, outlines.headings(docs).select(*columns).collect())) == sorted(map(repr, nodes.outline(docs).select(*columns).collect()))


def test_an_outline_of_many_headings(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("\\section{s}\\subsection{t}"), 50_000).alias("tex"))
    assert [tuple(r) for r in outlines.headings(docs).groupBy("depth").count().orderBy("depth").collect()] == [(0, 50_000), (1, 50_000)]


def test_brackets_by_windows_equal_the_stack(spark):
    rng = random.Random(7)
    pieces = ["\\begin{a}", "\\end{a}", "\\begin{b}", "\\end{b}", "é{", "}", "% } {\n", "\\begin{}", "\\{", "\\end{é}"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(400)] + [None, ""]
    docs = docs_of(spark, texts)
    for made, exact in ((outlines.environment_findings, analysis.environments), (outlines.brace_findings, analysis.braces)):
        assert sorted(tuple(r) for r in made(docs).collect()) == sorted((k, *x.values()) for k, t in enumerate(texts) for x in exact(t or ""))


def test_marks_of_a_task_are_bounded(spark, monkeypatch):
    """Sources that pack well were put into one task, whatever the number of their marks."""
    monkeypatch.setattr(outlines, "MARKS", 2_000, raising=False)
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("{\\begin{a}{}{}").alias("tex"))
    for made, parts in ((outlines.environment_findings, 8), (outlines.brace_findings, 14)):
        sizes = [r["count"] for r in made(docs).groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 4_000 and len(sizes) >= parts and max(sizes) < 1_000


def test_lines_and_columns_by_sums(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["a", "é", "\n", "漢", "🙂"]) for _ in range(rng.randint(0, 60))) for _ in range(100)] + [None, "", "\n" * 21]
    expected = sorted((k, at, t[:at].count("\n"), len(t[:at].rsplit("\n", 1)[-1]), len(t[:at].encode())) for k, t in enumerate(texts) if t is not None for at in {*range(0, len(t) + 1, 7), len(t)})
    assert sorted(tuple(r) for r in outlines.lines_and_columns(docs_of(spark, texts, "text"), 7).collect()) == expected


def test_lines_and_columns_of_a_long_text_take_linear_work(spark):
    docs = spark.range(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words\n"), 400_000).alias("text"))
    began = time.time()
    assert outlines.lines_and_columns(docs, 100).agg(F.max("line")).first()[0] == 400_000
    assert time.time() - began < 60


def test_constructs_by_expressions_equal_the_parser(spark):
    rng = random.Random(12)
    pieces = ["\\label{a}", "\\label {b~c}", "\\caption[s]{cap}", "\\footnote{note}", "\\thanks{t}", "\\includegraphics[width=2cm]{ p.png }", "\\ref{r}", "\\eqref{e}", "\\section*{S~T}", "\\chapter[x]{C}", "\\cite{k, l}", "\\citep[p][q]{m,}", "\\emph{w}", "text ", "\n\n", "\\begin{center}", "\\end{center}"]
    odd = ["{\\label{g}}", "\\textbf{\\label{h}}", "% \\label{i}\n", "$\\label{j}$", "\\begin{itemize}\\item \\label{k}\\end{itemize}", "\\begin{odd}\\label{l}\\end{odd}", "\\verb|\\label{m}|", "\\label{", "}", "\\end{document}", "\\\\[2pt]", "\\newcommand{\\x}{\\label{n}}\\x"]
    made = lambda: "".join(rng.choice(pieces if rng.random() < 0.95 else odd) for _ in range(rng.randint(0, 8)))
    docs = docs_of(spark, [rng.choice(["", "", "\\documentclass{a}\\begin{document}"]) + made() + rng.choice(["", "", "\\end{document}"]) for _ in range(500)] + [None, ""])
    fits = docs.where(extractors.flat(F.col("tex")))
    assert fits.count() > 100
    rows = lambda frame: sorted(map(tuple, frame.collect()))
    for construct in extractors.CONSTRUCTS:
        assert rows(extractors.by_expression(fits, construct)) == rows(extractors.by_parser(fits, construct)), construct
        assert rows(extractors.extract(docs, construct)) == rows(extractors.by_parser(docs, construct))
    exact = nodes.nodes(docs, kinds=("Citation",), columns=("keys",)).select("doc_id", F.explode("keys").alias("key"))
    assert rows(extractors.citations(docs)) == rows(exact)


def test_the_table_function_narrows_kinds_and_columns(spark):
    table_functions.register(spark)
    docs_of(spark, ["\\section{a}\\label{l}b", None, ""]).createOrReplaceTempView("tex_docs")
    made = spark.sql("SELECT d.doc_id, n.* FROM tex_docs d, LATERAL tex_parse(d.tex, 'Section, Label') n")
    assert made.columns == ["doc_id", *table_functions.PLACES, "name", "level", "text"]
    assert [(r.doc_id, r.kind, r.text) for r in made.collect()] == [(0, "Section", "a"), (0, "Label", "l")]
    whole = spark.sql("SELECT d.doc_id, n.* FROM tex_docs d, LATERAL tex_parse(d.tex) n")
    assert whole.columns == ["doc_id", *parser.COLUMNS] and whole.count() == 3
    assert sorted(map(str, whole.collect())) == sorted(map(str, nodes.nodes(spark.table("tex_docs")).collect()))


# nesting

DEEP = 100_000
CONSTRUCTS = {
    "braces": ("{a", "}"), "open braces": ("{", ""), "quote": ("\\begin{quote}a ", "\\end{quote}"), "open quote": ("\\begin{quote} ", ""), "items": ("\\begin{itemize}\\item a ", "\\end{itemize}"),
    "terms": ("\\begin{description}\\item[x] a ", "\\end{description}"), "theorem": ("\\begin{lemma}[x]a ", "\\end{lemma}"), "dollars": ("${", ""), "options": ("\\\\[", ""), "open begin": ("\\begin{", ""),
    "symbols": ("\\% a", ""), "floats": ("\\begin{table}", "\\caption{x}\\end{table}"), "bold": ("\\textbf{", "}"), "titles": ("\\section{", ""), "cells": ("\\begin{tabular}{l}a & ", "\\end{tabular}"),
}


@pytest.mark.parametrize("name", CONSTRUCTS)
def test_any_depth_is_read_in_linear_time(name):
    before, after = CONSTRUCTS[name]
    began = time.time()
    made = parser.parse(before * DEEP + after * DEEP)
    rows = parser.flatten(made)
    assert all(r[1] < r[0] < r[2] for r in rows)
    render.html(made), render.plain(made), render.layout(made), render.shape(made)
    assert time.time() - began < 60
    analysis.findings(before * 1000 + after * 1000)


def test_deep_formulas_stay_as_they_are_written():
    for deep in ("\\frac{" * 400 + "1" + "}{2}" * 400, "\\sqrt{" * 5000 + "x" + "}" * 5000, "x^{" * 3000 + "}" * 3000, "\\begin{pmatrix}" * 300 + "\\end{pmatrix}" * 300):
        assert mathfmt.to_unicode(deep) == deep
        assert mathml.to_mathml(deep).startswith("<mtext>")
    assert isinstance(mathml.to_mathml("\\frac" * 30_000 + " x"), str)
    fine = "\\sqrt{" * 100 + "x" + "}" * 100
    assert mathfmt.to_unicode(fine) == "√" * 100 + "x" and mathml.to_mathml(fine).count("<msqrt>") == 100


def test_no_document_stops_a_job(spark, monkeypatch):
    docs = docs_of(spark, ["{" * 5000 + "}" * 5000 + "a", "$" + "\\frac{" * 400 + "}{1}" * 400 + "$", "ok"])
    assert {r.doc_id for r in nodes.nodes(docs).collect()} == {0, 1, 2}
    assert nodes.plain_text(docs).where("doc_id = 2").first().plain == "ok"

    def odd(source):
        raise ValueError("odd")

    failing = nodes.rows_of(docs, odd, nodes.FINDING, failed=lambda e: [(0, 0, "error", str(e), "unreadable")])
    assert [r.code for r in failing.collect()] == ["unreadable"] * 3


def test_a_failure_is_no_empty_page(spark, small, monkeypatch):
    """A document that could not be read gave no nodes, and so an empty page like that of an empty document."""

    class Odd(Plugin):
        def transform(self, made):
            if any("Part 7" in row for row in parser.flatten(made)):
                raise RuntimeError("odd")
            return made

    monkeypatch.setattr(nodes, "nodes", partial(nodes.nodes, plugins=(Odd(),)))
    with pytest.raises(PythonException, match="Unreadable: doc_id=7: RuntimeError: odd"):
        relational.html_tree(spark, small).collect()


def failing(of):
    """A renderer that fails on order 7."""

    def odd(made, *more):
        if any(n.args and n.args[0].startswith("Order 7 ") for n in made):
            raise RuntimeError("odd")
        return of(made, *more)

    return odd


def test_a_failure_is_no_missing_page(spark, small, monkeypatch):
    """A document that could not be laid out had no elements, and so was missing like one without any."""
    monkeypatch.setattr(nodes, "render", SimpleNamespace(layout=failing(render.layout)))
    with pytest.raises(PythonException, match="Unreadable: doc_id=7: RuntimeError: odd"):
        catalogue.pdf_layout_elements(spark, small).collect()


def test_a_failure_is_no_missing_text(spark, small, monkeypatch):
    """A document of which no text could be made had no row."""
    monkeypatch.setattr(nodes, "render", SimpleNamespace(plain=failing(render.plain)))
    with pytest.raises(PythonException, match="Unreadable: doc_id=7: RuntimeError: odd"):
        catalogue.plain_text(spark, small).collect()


RELATIONAL = sorted(n for n, f in catalogue.QUERIES.items() if f.__module__ == "quire.plans.relational")


@pytest.mark.parametrize("name", RELATIONAL)
def test_query_agrees_with_sql(spark, small, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents".split():
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    frame = catalogue.QUERIES[name](spark, small)
    names = sorted(frame.columns)
    found = con.execute(catalogue.ORACLE[name])
    at = [[d[0] for d in found.description].index(c) for c in names]
    assert sorted(repr([r[c] for c in names]) for r in frame.collect()) == sorted(repr([r[k] for k in at]) for r in found.fetchall())


def test_documents_are_dealt_by_their_number(spark, small, monkeypatch):
    """Few splits of many rows made one task each, which grew with the table."""
    monkeypatch.setattr(B, "ROWS", 100, raising=False)
    sizes = [r["count"] for r in B.order_meta(spark, small).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 1_500 and len(sizes) == 15 and max(sizes) < 200


def test_rows_are_gathered_by_their_number(spark, small, monkeypatch):
    """Adaptive coalescing put rows that pack well into few tasks."""
    monkeypatch.setattr(B, "LINES", 200, raising=False)
    docs = B.lineitem_tables(spark, small)
    assert docs.groupBy(F.spark_partition_id().alias("p")).count().count() >= 20


def test_nodes_are_gathered_in_as_many_parts_as_they_come(spark):
    docs = spark.range(0, 64, 1, 32).select(F.col("id").alias("doc_id"), F.lit("\\begin{quote}a\\end{quote}").alias("tex"))
    table = nodes.nodes(docs, columns=serialise.READ, forms=True)
    for made in (serialise.html(docs, table), serialise.plain(docs, table), serialise.contents(table, "Quote")):
        assert made.groupBy(F.spark_partition_id().alias("p")).count().count() > 20


def test_cells_without_braces_or_escapes_equal_the_scan():
    rng = random.Random(9)
    for _ in range(2_000):
        text = "".join(rng.choice("\\&a {}") for _ in range(rng.randint(0, 12)))
        for mark in ("&", "\\\\"):
            assert tables._cut(text, mark) == [p[:-1] for p in _scan(text, mark)]


def _scan(text, mark):
    """Each piece with a sign at its end, so that empty ones count."""
    out, k, depth = [""], 0, 0
    while k < len(text):
        if depth <= 0 and text.startswith(mark, k):
            out.append("")
            k += len(mark)
            continue
        n = 2 if text[k] == "\\" else 1
        depth += (text[k] == "{") - (text[k] == "}")
        out[-1] += text[k : k + n]
        k += n
    return [p + "." for p in out]
