"""The queries of the engine, each with SQL over the base tables that gives the same rows without TeX."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from io import BytesIO
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import columns as C
from quire.functions import dims
from quire.functions.plugins import CustomFormat, Today, Url
from quire.operators import incremental, nodes, outlines
from quire.functions import mathfmt, mathml, parser, render
from quire.plans import corpus as B
from quire.plans import forms
from quire.sources import files, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _quoted(x) for x in row) + ")" for row in rows)


# tables


@query("SELECT l_returnflag AS flag, sum(cast(l_quantity AS BIGINT))::BIGINT AS quantity, sum(cast(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cents, count(*) AS n FROM lineitem GROUP BY 1")
def table_extract_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items through a table of TeX and back, summed by flag."""
    table = nodes.nodes(B.lineitem_tables(spark, sf_dir), kinds=("Table",), columns=("rows",)).select(F.posexplode("rows").alias("k", "row")).where("not row.is_separator and k > 2")
    cells = table.select(F.col("row.cells")[3].alias("flag"), F.expr("try_cast(row.cells[1] AS bigint)").alias("q"), F.expr("try_cast(row.cells[2] AS bigint)").alias("c"))
    return cells.groupBy("flag").agg(F.sum("q").alias("quantity"), F.sum("c").alias("cents"), F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation)
SELECT n_regionkey::BIGINT AS region, (2 + k)::BIGINT AS row_idx, c.col::BIGINT AS col_idx, CASE c.col WHEN 0 THEN n_nationkey::VARCHAR ELSE n_name END AS value FROM r, (VALUES (0), (1)) c(col)"""
)
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = nodes.table_cells(nodes.nodes(B.nation_tables(spark, sf_dir), kinds=("Table",), columns=("node_id", "kind", "rows"))).where("row_idx >= 3")
    return cells.select(F.col("doc_id").alias("region"), *_long("row_idx", "col_idx"), "value")


@query("SELECT n_regionkey::BIGINT AS region, 3::BIGINT AS separators, (count(*) + 1)::BIGINT AS others FROM nation GROUP BY 1")
def table_separator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes.nodes(B.nation_tables(spark, sf_dir)).where("kind = 'Table'").select("doc_id", F.explode("rows").alias("row"))
    return rows.groupBy(F.col("doc_id").alias("region")).agg(F.sum(F.col("row.is_separator").cast("long")).alias("separators"), F.sum((~F.col("row.is_separator")).cast("long")).alias("others"))


_SPECS = {"l*{2}{c}r": "left,center,center,right", ">{\\raggedright}p{3cm}|X": "left,left", "m{3cm}l@{}r": "left,left,right", "*{2}{|c*{2}{r}}": "center,right,right,center,right,right"}


@query("SELECT n_nationkey::BIGINT AS nation, s.spec, s.columns FROM nation, (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _SPECS.items()) + ") s(spec, columns)")
def table_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = F.explode(F.array(*map(F.lit, _SPECS)))
    docs = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nation"), "n_name", specs.alias("spec"))
    docs = docs.withColumn("tex", B.cat("\\begin{tabular}{", F.col("spec"), "}", F.col("n_name"), " & b \\\\\\end{tabular}"))
    return nodes.nodes(docs, keys=("nation", "spec")).where("kind = 'Table'").select("nation", "spec", F.array_join("columns", ",").alias("columns"))


@query("SELECT r_regionkey::BIGINT AS region, 'Nations|' AS cells FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def table_multicolumn(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = nodes.table_cells(nodes.nodes(B.nation_tables(spark, sf_dir), kinds=("Table",), columns=("node_id", "kind", "rows"))).where("row_idx = 1")
    return cells.groupBy(F.col("doc_id").alias("region")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "value"))), lambda x: x["value"]), "|").alias("cells"))


# structure

_LOCATED = "WITH g AS (SELECT s_suppkey::BIGINT AS supplier, s_name, n_name, n_nationkey, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"{_LOCATED} SELECT supplier, r_name AS title, 6 AS level FROM g UNION ALL SELECT supplier, n_name, 1 FROM g UNION ALL SELECT supplier, s_name, 2 FROM g")
def section_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.sections(nodes.nodes(B.geo_outline(spark, sf_dir), kinds=("Section",), columns=("node_id", "kind", "level", "text"))).select(F.col("doc_id").alias("supplier"), "title", "level")


@query(f"{_LOCATED} SELECT supplier, r_name AS name, NULL AS parent, 0 AS depth FROM g UNION ALL SELECT supplier, n_name, r_name, 1 FROM g UNION ALL SELECT supplier, s_name, n_name, 2 FROM g")
def section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.outline(B.geo_outline(spark, sf_dir)).select(F.col("doc_id").alias("supplier"), "name", "parent", "depth")


@query("SELECT o_orderkey::BIGINT AS o, ('Order ' || o_orderkey || ' \\emph{of} note') AS title, (CASE WHEN o_orderkey % 5 = 0 THEN 'D' ELSE 'C' END || o_custkey) AS author, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def metadata_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.metadata(nodes.nodes(B.order_meta(spark, sf_dir), kinds=("Command",), columns=("node_id", "kind", "depth", "name", "args"))).withColumnRenamed("doc_id", "o")


# citations, references, bibliographies

_CITED = {"kinds": ("Citation",), "columns": ("node_id", "kind", "name", "keys")}
_LISTED = {"kinds": ("Bibliography",), "columns": ("node_id", "kind", "bib")}
_KINDS = "(CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(B.CITES)) + " END)"


@query("SELECT o_custkey::BIGINT AS c, 'o' || o_orderkey AS key, 0 AS key_idx FROM orders UNION ALL SELECT o_custkey, 's' || o_orderkey % 10, 1 FROM orders")
def citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = nodes.candidates(B.customer_citations(spark, sf_dir), *B.CITES)
    return nodes.citations(nodes.nodes(docs, **_CITED)).select(F.col("doc_id").alias("c"), "key", "key_idx")


@query(f"SELECT {_KINDS} AS cite_kind, count(*) AS n FROM orders GROUP BY 1")
def citation_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.citations(nodes.nodes(B.customer_citations(spark, sf_dir), **_CITED)).where("key_idx = 0").groupBy("cite_kind").agg(F.count("*").alias("n"))


@query(
    f"""SELECT o_custkey::BIGINT AS c, CASE {_KINDS} WHEN 'nocite' THEN '' WHEN 'citeauthor' THEN k WHEN 'footcite' THEN '<sup class="footnote">' || k || '</sup>' WHEN 'supercite' THEN '<sup>' || k || '</sup>'
    WHEN 'parencite' THEN '(' || k || ')' WHEN 'autocite' THEN '(' || k || ')' ELSE '[' || k || ']' END AS html FROM (SELECT *, 'o' || o_orderkey || ', s' || o_orderkey % 10 AS k FROM orders)"""
)
def citation_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations as HTML, joined to the table of their forms."""
    forms = [(k, *(("", "", "") if v is None else ("", "", v[2]) if v[2] else (v[0], v[1], ""))) for k, v in dims.CITATIONS.items()]
    table = spark.createDataFrame(forms, "cite_kind string, before string, after string, raised string")
    rows = nodes.nodes(B.customer_citations(spark, sf_dir), **_CITED).select("doc_id", F.col("name").alias("cite_kind"), F.array_join("keys", ", ").alias("keys"))
    open_ = F.when(F.col("raised") == "footnote", '<sup class="footnote">').when(F.col("raised") == "sup", "<sup>").otherwise(F.col("before"))
    close = F.when(F.col("raised") != "", "</sup>").otherwise(F.col("after"))
    html = F.when(F.col("cite_kind") == "nocite", "").otherwise(F.concat(open_, C.escape_html(F.col("keys")), close))
    return rows.join(F.broadcast(table), "cite_kind").select(F.col("doc_id").alias("c"), html.alias("html"))


@query("SELECT o_custkey::BIGINT AS c, 'o' || o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS number, 'Order ' || o_orderkey || ' of ' || o_orderpriority || '.' AS text FROM orders WHERE o_orderkey % 2 = 0")
def bibliography_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.bibliography(nodes.nodes(B.customer_citations(spark, sf_dir), **_LISTED)).select(F.col("doc_id").alias("c"), "key", "number", "text")


@query("SELECT o_custkey::BIGINT AS c, count(*) AS entries, max(o_orderkey)::BIGINT AS last_key FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def bib_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of the last entry of each bibliography is the count of its entries."""
    bib = nodes.bibliography(nodes.nodes(B.customer_citations(spark, sf_dir), **_LISTED))
    return bib.groupBy(F.col("doc_id").alias("c")).agg(F.max("number").cast("long").alias("entries"), F.max_by(F.substring("key", F.lit(2), F.length("key")).cast("long"), F.col("number")).alias("last_key"))


@query("SELECT o_custkey::BIGINT AS c, count(*) FILTER (o_orderkey % 2 = 0) AS resolved, (count(*) FILTER (o_orderkey % 2 = 1) + count(*)) AS dangling FROM orders GROUP BY 1")
def cite_bib_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: citations joined to the entries of their document."""
    joined = nodes.resolved_citations(B.customer_citations(spark, sf_dir))
    return joined.groupBy(F.col("doc_id").alias("c")).agg(F.count("number").alias("resolved"), F.sum(F.col("number").isNull().cast("long")).alias("dangling"))


@query("SELECT o_custkey::BIGINT AS c, (2 * count(*))::BIGINT AS resolved, count(*) FILTER (o_orderkey % 3 = 0) AS dangling FROM orders GROUP BY 1")
def label_ref_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: references joined to the labels of their document."""
    joined = nodes.resolved_references(B.order_labels(spark, sf_dir))
    return joined.groupBy(F.col("doc_id").alias("c")).agg(F.sum(F.col("found").cast("long")).alias("resolved"), F.sum((~F.col("found")).cast("long")).alias("dangling"))


@query("SELECT o_custkey::BIGINT AS c, 'x' || o_orderkey AS key, 'eqref' AS command FROM orders WHERE o_orderkey % 3 = 0")
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.resolved_references(B.order_labels(spark, sf_dir)).where("not found").select(F.col("doc_id").alias("c"), "key", "command")


# lists and blocks


@query(f"{_LOCATED} SELECT supplier, n_name AS item, 0 AS depth FROM g UNION ALL SELECT supplier, s_name || '-' || k, 1 FROM g, (VALUES (1), (2), (3)) n(k) WHERE k <= supplier % 4")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = nodes.nodes(B.nation_lists(spark, sf_dir), kinds=("Text",), columns=("slot", "depth", "text")).where("slot = 'item'")
    return items.select(F.col("doc_id").alias("supplier"), F.trim(F.replace("text", F.lit("\n"), F.lit(" "))).alias("item"), (F.col("depth") - 1).alias("depth"))


@query(f"{_LOCATED} SELECT supplier, 1::BIGINT AS outer_items, (supplier % 4)::BIGINT AS inner_items FROM g")
def list_nested_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = nodes.nodes(B.nation_lists(spark, sf_dir), kinds=("ItemList",), columns=("depth", "args"))
    count = lambda d: F.coalesce(F.sum(F.when(F.col("depth") == d, F.size("args"))), F.lit(0)).cast("long")
    return lists.groupBy(F.col("doc_id").alias("supplier")).agg(count(0).alias("outer_items"), count(1).alias("inner_items"))


@query(f"{_LOCATED} SELECT supplier, n_name AS term, 'Number ' || n_nationkey || ' of its kind.' AS body FROM g")
def description_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.described(B.nation_lists(spark, sf_dir)).select(F.col("doc_id").alias("supplier"), "term", F.trim("body").alias("body"))


@query("SELECT p_partkey::BIGINT AS p, CASE WHEN p_partkey % 2 = 0 THEN 'theorem' ELSE 'lemma' END AS name, p_name AS title, 'Every part of size ' || p_size || ' is .' AS body FROM part")
def theorem_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.trim(F.replace("text", F.lit("\n"), F.lit("")))
    return nodes.texts_of(B.part_notes(spark, sf_dir), "Theorem").select(F.col("doc_id").alias("p"), "name", F.col("label").alias("title"), body.alias("body"))


@query("SELECT p_partkey::BIGINT AS p, 'Note on ' || p_brand AS text FROM part")
def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.nodes(nodes.candidates(B.part_notes(spark, sf_dir), "footnote", "thanks"), kinds=("Footnote",), columns=("text",)).select(F.col("doc_id").alias("p"), "text")


@query("SELECT p_partkey::BIGINT AS p, 'Part ' || p_partkey AS caption, 'fig' || p_partkey AS label FROM part")
def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with the labels of the same float."""
    kids = nodes.nodes(B.part_notes(spark, sf_dir), kinds=("Caption", "Label"), columns=("parent_id", "kind", "text")).where("parent_id >= 0")
    text = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("text")))
    return kids.groupBy("doc_id", "parent_id").agg(text("Caption").alias("caption"), text("Label").alias("label")).where("caption is not null").select(F.col("doc_id").alias("p"), "caption", "label")


@query("SELECT p_partkey::BIGINT AS p, 'size = ' || p_size AS code FROM part")
def code_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.nodes(B.part_notes(spark, sf_dir), kinds=("CodeBlock",)).select(F.col("doc_id").alias("p"), F.col("text").alias("code"))


@query("SELECT p_partkey::BIGINT AS p, 'part' || p_partkey || '.png' AS path, p_size || 'cm' AS width FROM part")
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.nodes(B.part_notes(spark, sf_dir), kinds=("Image",)).select(F.col("doc_id").alias("p"), "path", "width")


@query("SELECT p_partkey::BIGINT AS p, 'http://parts.example/' || p_partkey AS url, p_name AS text FROM part UNION ALL SELECT p_partkey, 'http://parts.example/all', 'http://parts.example/all' FROM part")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes.nodes(B.part_notes(spark, sf_dir), kinds=("Command",), columns=("kind", "name", "args")).where("kind = 'Command' and name in ('href', 'url')")
    return rows.select(F.col("doc_id").alias("p"), F.col("args")[0].alias("url"), F.element_at("args", -1).alias("text"))


@query("SELECT p_partkey::BIGINT AS p, l.k AS line_no, CASE l.k WHEN 0 THEN 'a &= ' || p_size ELSE 'b &= ' || (p_size + 1) END AS expr FROM part, (VALUES (0), (1)) l(k)")
def math_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.nodes(B.mixed_docs(spark, sf_dir), kinds=("MathLines",)).select(F.col("doc_id").alias("p"), F.posexplode("lines").alias("line_no", "expr"))


@query("SELECT p_partkey::BIGINT AS p, 'SI' AS name, p_size::DOUBLE AS value, 'kg' AS unit FROM part UNION ALL SELECT p_partkey, 'num', p_size::DOUBLE, NULL FROM part")
def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes.nodes(nodes.candidates(B.mixed_docs(spark, sf_dir), "SI", "num", "si", "unit"), kinds=("Command",), columns=("kind", "name", "args")).where("kind = 'Command' and name in ('SI', 'num')")
    return rows.select(F.col("doc_id").alias("p"), "name", F.expr("try_cast(args[0] AS double)").alias("value"), F.get("args", F.lit(1)).alias("unit"))


@query("SELECT p_partkey::BIGINT AS p, c.name, c.arg FROM part, (VALUES ('raisebox', 'up'), ('fcolorbox', 'box'), ('vspace', '2cm'), ('quad', NULL), ('today', NULL)) c(name, arg)")
def command_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes.nodes(B.mixed_docs(spark, sf_dir), kinds=("Command",), columns=("kind", "name", "args")).where("kind = 'Command' and name in ('raisebox', 'fcolorbox', 'vspace', 'quad', 'today')")
    return rows.select(F.col("doc_id").alias("p"), "name", F.when(F.size("args") > 0, F.element_at("args", -1)).alias("arg"))


@query("SELECT p_partkey::BIGINT AS p, c.kind, c.t || CASE c.kind WHEN 'Quote' THEN p_partkey::VARCHAR ELSE '' END AS text FROM part, (VALUES ('Quote', 'Quoted '), ('Center', 'Centred ')) c(kind, t)")
def container_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.texts_of(B.mixed_docs(spark, sf_dir), "Quote", "Center").select(F.col("doc_id").alias("p"), "kind", "text")


@query("SELECT p_partkey::BIGINT AS p, 'green' AS color, 'col' || p_partkey AS text FROM part")
def colored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.nodes(B.mixed_docs(spark, sf_dir), kinds=("ColoredText",)).select(F.col("doc_id").alias("p"), F.col("name").alias("color"), "text")


@query("SELECT p_partkey::BIGINT AS p, 'part' AS entry, p_partkey::VARCHAR AS sub FROM part")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes.nodes(B.mixed_docs(spark, sf_dir), kinds=("Command",), columns=("kind", "name", "args")).where("kind = 'Command' and name = 'index'")
    parts = F.split(F.col("args")[0], "!")
    return rows.select(F.col("doc_id").alias("p"), parts[0].alias("entry"), F.get(parts, F.lit(1)).alias("sub"))


@query("SELECT c.name, count(*) AS n FROM part, (VALUES ('strange'), ('mystery')) c(name) GROUP BY 1")
def unknown_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.unknown(B.mixed_docs(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"))


# mathematics


def _digits(text: str, plain: str, marked: str) -> str:
    return f"translate({text}, '{plain}', '{marked}')"


_UP, _DOWN = "⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉"
_N, _M = "p_size::VARCHAR", "(p_size % 9 + 2)::VARCHAR"
_VULGAR = "CASE p_size || '/' || (p_size % 9 + 2) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.VULGAR.items()) + f" ELSE '[' || {_N} || '] ÷ [' || {_M} || ']' END"
_FORMS = {
    "fraction": _VULGAR,
    "script": f"'x' || {_digits(_N, '0123456789', _UP)} || {_digits(_M, '0123456789', _DOWN)} || '₊₁'",
    "root": f"(CASE {_M} WHEN '3' THEN '∛' WHEN '4' THEN '∜' ELSE {_digits(_M, '0123456789', _UP)} || '√' END) || '(' || {_N} || '+a)'",
    "binomial": f"'C(' || {_N} || ', ' || {_M} || ')'",
    "alphabet": f"'ℝ' || {_digits('left(' + _M + ', 1)', '0123456789', _UP)} || substr({_M}, 2) || ' ℒ'",
    "accent": f"'x' || chr(770) || {_digits('left(' + _M + ', 1)', '0123456789', _DOWN)} || substr({_M}, 2)",
    "symbol": f"'α ≤ ' || {_N} || ' → ∞'",
}


def _form(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = B.part_formulas(spark, sf_dir).where(F.col("form") == name)
        return nodes.math_unicode(rows).select(F.col("doc_id").alias("p"), "unicode")

    run.__name__ = {"fraction": "math_fractions", "script": "math_scripts", "root": "math_roots", "binomial": "math_binom", "alphabet": "math_alphabet", "accent": "math_accent", "symbol": "math_symbols_unicode"}[name]
    query(f"SELECT p_partkey::BIGINT AS p, {_FORMS[name]} AS unicode FROM part")(run)


for _name in _FORMS:
    _form(_name)


@query("""SELECT p_partkey::BIGINT AS p, '<math><mfrac>' || regexp_replace(p_size::VARCHAR, '([0-9])', '<mn>\\1</mn>', 'g') || regexp_replace((p_size % 9 + 2)::VARCHAR, '([0-9])', '<mn>\\1</mn>', 'g') || '</mfrac></math>' AS mathml FROM part""")
def math_mathml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.math_mathml(B.part_formulas(spark, sf_dir).where("form = 'fraction'")).select(F.col("doc_id").alias("p"), "mathml")


@query("SELECT p_partkey::BIGINT AS p, replace(replace(f.formula, '#', p_partkey::VARCHAR), '%', p_size::VARCHAR) AS formula, f.n::BIGINT AS n FROM part, (VALUES ('m_{%}', 2), ('# + 1', 1), ('a_{#}', 1), ('x \\$ y', 1), ('e^{%}', 1)) f(formula, n)")
def math_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas within text, at the start of a construct, in each of the ways to write one; dollars that pair with none are text."""
    p = B.spread(B.read(spark, sf_dir, "part"))
    key, size = F.col("p_partkey"), F.col("p_size")
    tex = B.cat("Mass $m_{", size, "}$ of $", key, " + 1$, then $m_{", size, "}$.\n\n\\(a_{", key, "}\\) for \\$5\n\n$x \\$ y$\\begin{math}e^{", size, "}\\end{math}\\[shown\\] and $$shown$$ but $ alone")
    table = nodes.nodes(p.select(key.cast("long").alias("doc_id"), tex.alias("tex")), kinds=("Text", "MathInline"), columns=("node_id", "kind", "text"))
    return nodes.math_spans(table).groupBy(F.col("doc_id").alias("p"), "formula").agg(F.count("*").alias("n"))


@query()
def math_spans_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas in all raw documents, read as they are."""
    docs = B.read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("tex"))
    return nodes.math_spans(nodes.nodes(docs)).groupBy("doc_id", "formula").agg(F.count("*").alias("n"))


# macros, acronyms, files


@query("SELECT c_custkey::BIGINT AS c, c_name || ' in ' || c_mktsegment || ' [' || c_custkey || '] [' || c_nationkey || ']' AS expanded FROM customer")
def macro_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.expanded(B.macro_docs(spark, sf_dir)).withColumnRenamed("doc_id", "c")


@query("SELECT c_custkey::BIGINT AS c, (CASE c_custkey % 3 WHEN 0 THEN 'b-a' WHEN 1 THEN '-a' ELSE '-' END) AS expanded FROM customer")
def macro_args(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments out of order, and calls with fewer arguments than parameters."""
    key = F.col("c_custkey") % 3
    call = F.when(key == 0, "\\swap{a}{b}").when(key == 1, "\\swap{a}").otherwise("\\swap")
    docs = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), B.cat("\\def\\swap#1#2{#2-#1}", call).alias("tex"))
    return nodes.expanded(docs).withColumnRenamed("doc_id", "c")


@query("SELECT c_custkey::BIGINT AS c, 'textbf' AS name, c_mktsegment AS arg FROM customer")
def let_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), B.cat("\\let\\strong=\\textbf\\strong{", F.col("c_mktsegment"), "}").alias("tex"))
    return nodes.nodes(docs).where("kind = 'Command'").select(F.col("doc_id").alias("c"), "name", F.col("args")[0].alias("arg"))


@query("SELECT n_nationkey::BIGINT AS n, 'n' || n_nationkey || ' ' || n_name || ' N' || n_nationkey || ' n' || n_nationkey || 's ' || n_name || ' (n' || n_nationkey || ') none' AS text FROM nation")
def acronym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("n_nationkey"), F.col("n_name")
    tex = B.cat("\\newacronym{a}{n", k, "}{", name, "}\\gls{a} \\acrlong{a} \\Gls{a} \\glspl{a} \\acrfull{a} \\gls{none}")
    docs = B.read(spark, sf_dir, "nation").select(k.cast("long").alias("doc_id"), tex.alias("tex"))
    return nodes.nodes(docs).where("kind = 'Text'").select(F.col("doc_id").alias("n"), "text")


@query("SELECT n_regionkey::BIGINT AS region, string_agg('[' || n_name || ':' || n_nationkey || ']', '' ORDER BY n_nationkey) || 'end' AS text FROM nation GROUP BY 1")
def input_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A root for each region that reads a file for each nation, which reads another one."""
    n = B.read(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    outer = n.select(B.cat("n", key, ".tex").alias("path"), B.cat("[", F.col("n_name"), ":\\input{k", key, "}]").alias("tex"))
    inner = n.select(B.cat("k", key, ".tex").alias("path"), key.cast("string").alias("tex"))
    roots = B.gathered(n, "n_regionkey", B.cat("\\input{n", key, "}"), "n_nationkey", between="")
    roots = roots.select(F.col("doc_id").cast("string").alias("path"), B.cat(F.col("body"), "\\input{nowhere}end").alias("tex"), F.col("doc_id").alias("region"))
    docs = files.resolve_inputs(roots, outer.unionByName(inner))
    return nodes.nodes(docs, keys=("region",)).where("kind = 'Text'").select("region", "text")


_PLACES = "CASE n_nationkey % 3 WHEN 0 THEN 'own' WHEN 1 THEN 'lib' ELSE 'top' END"


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A document for each nation, and files in its own folder, in a search path, and at the top: of one name, the first place counts."""
    n, key = B.read(spark, sf_dir, "nation"), F.col("n_nationkey")
    tex = B.cat("[\\input{part", key, "}]\\input part", key, " \\include{deep", key, "}\\input{none}\\input self", key, " end")
    docs = n.select(B.cat("doc", key).alias("path"), B.cat("dir", key).alias("base_dir"), tex.alias("tex"), key.cast("long").alias("n"))
    file = lambda path, text: n.select(path.alias("path"), text.alias("tex"))
    own = file(B.cat("dir", key, "/part", key, ".tex"), F.lit("own")).where("tex = 'own'").join(n.where("n_nationkey % 3 = 0").select(B.cat("dir", key, "/part", key, ".tex").alias("path")), "path", "left_semi")
    lib = file(B.cat("lib/part", key, ".tex"), F.lit("lib")).join(n.where("n_nationkey % 3 < 2").select(B.cat("lib/part", key, ".tex").alias("path")), "path", "left_semi")
    top = file(B.cat("part", key, ".tex"), F.lit("top"))
    deep = file(B.cat("lib/deep", key, ".tex"), B.cat("d\\input{part", key, "}"))
    loop = file(B.cat("self", key, ".tex"), B.cat("s\\input{self", key, "}\\input lost "))
    return docs, own.unionByName(lib).unionByName(top).unionByName(deep).unionByName(loop)


@query(f"SELECT n_nationkey::BIGINT AS n, f.kind, f.name, CASE f.kind WHEN 'Text' THEN replace(f.text, '@', {_PLACES}) END AS text FROM nation, (VALUES ('Text', NULL, '[@]@ '), ('Command', 'clearpage', ''), ('Text', NULL, ' d@'), ('Command', 'clearpage', ''), ('Text', NULL, ' s end')) f(kind, name, text)")
def input_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named with and without braces, included between page breaks, found in three places, and within themselves."""
    docs, held = _library(spark, sf_dir)
    made = files.resolve_inputs(docs, held, ("lib",)).withColumn("tex", F.replace("tex", F.lit("  "), F.lit(" ")))
    return nodes.nodes(made, keys=("n",), kinds=("Text", "Command"), columns=("kind", "name", "text"))


@query("SELECT 'doc' || n_nationkey AS path, 'none' AS name, 'missing' AS reason FROM nation UNION ALL SELECT 'self' || n_nationkey || '.tex', 'lost', 'missing' FROM nation UNION ALL SELECT 'self' || n_nationkey || '.tex', 'self' || n_nationkey, 'loop' FROM nation")
def input_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be read: names without a file, and files within themselves."""
    return files.unresolved_inputs(*_library(spark, sf_dir), ("lib",))


_REQUESTS = """SELECT p_partkey::BIGINT AS p, 0 AS ordinal, 'article.cls' AS file_name FROM part UNION ALL SELECT p_partkey, 1, 'b' || p_size || '.sty' FROM part
UNION ALL SELECT p_partkey, 2, 'common.sty' FROM part"""


def _with_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    tex = B.cat("\\documentclass[11pt]{article}\n\\usepackage[x, y]{b", F.col("p_size"), " , common}\n\\RequirePackage{common}\n\\begin{document}\\usepackage{late}\\end{document}")
    return B.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), tex.alias("tex"))


@query(_REQUESTS)
def package_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.package_requests(_with_packages(spark, sf_dir)).select(F.col("doc_id").alias("p"), "ordinal", "file_name")


@query(f"SELECT p, file_name FROM ({_REQUESTS}) WHERE file_name <> 'common.sty' AND file_name NOT IN (SELECT 'b' || p_size || '.sty' FROM part WHERE p_size % 2 = 0)")
def missing_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = B.read(spark, sf_dir, "part").where("p_size % 2 = 0").select(B.cat("b", F.col("p_size"), ".sty").alias("file_name")).union(spark.range(1).select(F.lit("common.sty")))
    return files.missing_packages(files.package_requests(_with_packages(spark, sf_dir)), cache).select(F.col("doc_id").alias("p"), "file_name")


# analysis of raw texts


@query(
    """WITH marks AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '%[^\\n]*', '', 'g'), '[{}]')) AS m, generate_subscripts(regexp_extract_all(regexp_replace(html, '%[^\\n]*', '', 'g'), '[{}]'), 1) AS k FROM pages),
    runs AS (SELECT page_id, k, sum(CASE m WHEN '{' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY k) AS d FROM marks),
    low AS (SELECT page_id, greatest(0, -min(d)) AS unmatched, arg_max(d, k) AS final FROM runs GROUP BY 1)
    SELECT page_id::BIGINT AS page_id, coalesce(unmatched, 0)::INT AS unmatched, coalesce(final + unmatched, 0)::INT AS unclosed FROM pages LEFT JOIN low USING (page_id)"""
)
def brace_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = C.brace_counts(F.col("html"))
    return B.read(spark, sf_dir, "pages").select("page_id", counts.alias("c")).select("page_id", "c.unmatched", "c.unclosed")


@query("SELECT doc_id::BIGINT AS doc_id, length(regexp_replace(regexp_replace(text, '%[^\\n]*', '', 'g'), '[^$]', '', 'g')) % 2 = 1 AS odd FROM documents")
def math_delim_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "documents").select("doc_id", C.odd_dollars(F.col("text")).alias("odd"))


@query("SELECT doc_id::BIGINT AS doc_id, (length(split_part(x.t, chr(1), 1)) - length(replace(split_part(x.t, chr(1), 1), '$', ''))) % 2 = 1 AS flagged FROM (SELECT doc_id, regexp_replace(text, '%[^\\n]*', '', 'g') AS t FROM documents) x")
def math_delim_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The finding of the exact path, for the same documents as the fast one."""
    docs = B.read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("tex"))
    found = nodes.findings(docs).where("code = 'unclosed-math'").select("doc_id", F.lit(True).alias("f"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("f", F.lit(False)).alias("flagged"))


_LINT = {
    "missing-documentclass": "o_orderkey % 2 <> 0", "missing-end-document": "o_orderkey % 4 <> 0",
    "unclosed-math": "o_orderkey % 5 = 0",
}


@query(" UNION ALL ".join(f"SELECT o_orderkey::BIGINT AS o, '{code}' AS code FROM orders WHERE {when}" for code, when in _LINT.items()))
def structure_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.findings(B.broken_docs(spark, sf_dir)).where("code in ('missing-documentclass', 'missing-end-document', 'orphan-end-document', 'unclosed-math')")
    return found.select(F.col("doc_id").alias("o"), "code")


@query(
    """SELECT o_orderkey::BIGINT AS o, 'unclosed-brace' AS code, 1::BIGINT AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0
    UNION ALL SELECT o_orderkey, 'unmatched-brace', CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END FROM orders WHERE o_orderkey % 7 = 0"""
)
def brace_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.findings(B.broken_docs(spark, sf_dir)).where("code like '%-brace'")
    return found.groupBy(F.col("doc_id").alias("o"), "code").agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT o_orderkey AS k, o_orderkey % 11 = 0 AS swapped, o_orderkey % 13 = 0 AS open, o_orderkey % 4 = 0 AS ended FROM orders)
    SELECT k::BIGINT AS o, 'env-mismatch' AS code, (swapped::INT + (ended AND open)::INT)::BIGINT AS n FROM d WHERE swapped OR (ended AND open)
    UNION ALL SELECT k, 'env-unclosed', CASE WHEN ended THEN 1 ELSE 1 + open::INT END FROM d WHERE NOT ended OR open"""
)
def env_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nodes.findings(B.broken_docs(spark, sf_dir)).where("code like 'env-%'")
    return found.groupBy(F.col("doc_id").alias("o"), "code").agg(F.count("*").alias("n"))


@query("SELECT page_id::BIGINT AS page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages")
def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "pages").select("page_id", F.md5(C.escape_html(F.col("html"))).alias("digest"))


_LIGATED = "replace(replace(replace(replace({0}, '---', '—'), '--', '–'), '``', '“'), '''''', '”')"
_LIGATURES = f"SELECT doc_id::BIGINT AS doc_id, md5(array_to_string(list_transform(string_split(text, '$'), lambda x, i: CASE WHEN i % 2 = 0 AND i < len(string_split(text, '$')) THEN x ELSE {_LIGATED.format('x')} END), '$')) AS digest FROM documents"


@query(_LIGATURES)
def ligatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all documents; formulas stay as they are."""
    return B.read(spark, sf_dir, "documents").select("doc_id", F.md5(C.ligatures(F.col("text"))).alias("digest"))


#: White space that a run of text alone is made of, and the characters that stand escaped in a source.
_BLANK, _ESCAPED = r"[ \t\n\r\f\x0b\x1c-\x1f\x{85}\x{a0}]", r"[\\{}$&#%_~^]"
_RUNS = f"list_transform(regexp_extract_all(p, '{_ESCAPED}|[^{_ESCAPED[1:]}+'), lambda x: CASE WHEN regexp_full_match(x, '{_BLANK}+') THEN CASE WHEN contains(x, ' ') THEN ' ' ELSE '' END ELSE {_LIGATED.format('x')} END)"


@query(f"SELECT doc_id, digest, count(*) AS n FROM (SELECT doc_id::BIGINT AS doc_id, md5(t) AS digest FROM (SELECT doc_id, array_to_string({_RUNS}, '') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p FROM documents)) WHERE t <> '') GROUP BY 1, 2")
def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw documents with all specials escaped, read back as their runs of text; blank lines part them."""
    docs = B.read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", B.cat("\\begin{document}", C.escape_tex(F.col("text")), "\\end{document}").alias("tex"))
    return nodes.nodes(rows, kinds=("Text",), columns=("text",)).groupBy("doc_id", F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


_OFFSETS = """SELECT doc_id::BIGINT AS doc_id, k AS "at", (length(a) - length(replace(a, chr(10), '')))::INT AS line, length(regexp_extract(a, '[^\\n]*$'))::INT AS col, strlen(a)::INT AS bytes
    FROM (SELECT doc_id, k::INT AS k, left(text, k) AS a FROM (SELECT doc_id, text, unnest(list_distinct(list_append(range(0, length(text) + 1, 100), length(text)))) AS k FROM documents WHERE text IS NOT NULL))"""


@query(_OFFSETS)
def offset_to_linecol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth character of every document, and its end, by running sums over pieces."""
    return outlines.lines_and_columns(B.read(spark, sf_dir, "documents"), 100)


@query(_LIGATURES)
def ligatures_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as `ligatures`, which once left documents out."""
    return ligatures(spark, sf_dir)


@query()
def text_runs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `text_runs`, with the place of each run."""
    docs = B.read(spark, sf_dir, "documents")
    rows = docs.select("doc_id", B.cat("\\begin{document}", C.escape_tex(F.col("text")), "\\end{document}").alias("tex"))
    return nodes.nodes(rows, kinds=("Text",), columns=("node_id", "text")).select("doc_id", "node_id", F.md5("text").alias("digest"))


@query(_OFFSETS)
def offset_to_linecol_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as `offset_to_linecol`, which once looked at one place."""
    return offset_to_linecol(spark, sf_dir)


@query("SELECT n_nationkey::BIGINT AS n, a.made || n_name AS text FROM nation, (VALUES ('é'), ('ü'), ('ç'), ('Å'), ('ô'), ('ñ')) a(made)")
def accent_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.explode(F.array(*map(F.lit, ("\\'e", '\\"{u}', "\\c{c}", "\\r{A}", "\\^{o}", "\\~n"))))
    docs = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), "n_name", forms.alias("f"))
    return nodes.nodes(docs.select("doc_id", B.cat(F.col("f"), F.col("n_name")).alias("tex"))).where("kind = 'Text'").select(F.col("doc_id").alias("n"), "text")


@query("SELECT n_nationkey::BIGINT AS n, 'Straße 50% & $3 #1 a_b {x} © ' || n_name || ' LaTeX' AS text FROM nation")
def text_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    tex = B.cat("Stra\\ss e 50\\% \\& \\$3 \\#1 a\\_b \\{x\\} \\copyright{} ", F.col("n_name"), " \\LaTeX")
    docs = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), tex.alias("tex"))
    return nodes.nodes(docs).where("kind = 'Text'").select(F.col("doc_id").alias("n"), "text")


# renderers


@query("SELECT o_orderkey::BIGINT AS o, ('Order ' || o_orderkey || ' \\emph{of} note' || 'C' || o_custkey || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 5 = 0 THEN 'D' || o_custkey ELSE '' END || 'Text.') AS plain FROM orders")
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nodes.plain_text(B.order_meta(spark, sf_dir))
    return rows.select(F.col("doc_id").alias("o"), F.trim(F.replace("plain", F.lit("\n"), F.lit(""))).alias("plain"))


@query(f"SELECT doc_id::BIGINT AS doc_id, len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(regexp_replace(p, '{_BLANK}', '', 'g'), '.')))::INT AS paragraphs FROM documents")
def docx_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents with all specials escaped: blank lines part them."""
    tex = B.cat("\\begin{document}", C.escape_tex(F.coalesce("text", F.lit(""))), "\\end{document}")
    rows = nodes.plain_text(B.read(spark, sf_dir, "documents").select("doc_id", tex.alias("tex")))
    return rows.select("doc_id", F.size(F.filter(F.split("plain", "\n\n"), lambda p: p.rlike(r"[^ \t\n\r]"))).alias("paragraphs"))


@query()
def docx_paragraphs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of all documents, read as they are."""
    rows = nodes.plain_text(B.read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("tex")))
    return rows.select("doc_id", F.size(F.filter(F.split("plain", "\n\n"), lambda p: p.rlike(r"[^ \t\n\r]"))).alias("paragraphs"))


@query("SELECT r_regionkey::BIGINT AS region, '<table>' || chr(10) || '<tr><td>Nations</td><td></td></tr>' || chr(10) || string_agg('<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>' || chr(10), '' ORDER BY n_nationkey) || '</table>' || chr(10) AS html FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.html(B.nation_tables(spark, sf_dir)).withColumnRenamed("doc_id", "region")


@query(
    """SELECT o_orderkey::BIGINT AS o, e.element, CASE e.element WHEN 'heading' THEN 'Order ' || o_orderkey || ' \\emph{of} note' WHEN 'rich_paragraph' THEN 'Text.' WHEN 'empty_line' THEN ''
    WHEN 'paragraph' THEN CASE WHEN e.k = 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'D' ELSE 'C' END || o_custkey ELSE strftime(o_orderdate, '%Y-%m-%d') END END AS text
    FROM orders, (VALUES ('heading', 0), ('paragraph', 0), ('paragraph', 1), ('empty_line', 0), ('rich_paragraph', 0)) e(element, k)"""
)
def pdf_layout_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.layout(B.order_meta(spark, sf_dir)).select(F.col("doc_id").alias("o"), "element", F.trim("text").alias("text"))


@query("SELECT k.kind, (k.n * (SELECT count(*) FROM part))::BIGINT AS n FROM (VALUES ('Theorem', 1), ('Footnote', 1), ('CodeBlock', 1), ('Center', 1), ('Image', 1), ('Caption', 1), ('Label', 1), ('Command', 4), ('Paragraph', 1), ('Text', 5)) k(kind, n)")
def element_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = nodes.nodes(B.part_notes(spark, sf_dir), columns=("kind",))
    return table.groupBy("kind").agg(F.count("*").alias("n"))




_COMMAND = """'{"Command":{"args":[' || coalesce('"' || {0} || '"', '') || '],"name":"{1}"}}'"""
_TREE = " || ',' || ".join(_COMMAND.replace("{0}", value).replace("{1}", name) for value, name in ((r"'Order ' || o_orderkey || ' \\emph{of} note'", "title"), ("'C' || o_custkey", "author"), ("strftime(o_orderdate, '%Y-%m-%d')", "date"), ("NULL", "maketitle")))
_AGAIN = _COMMAND.replace("{0}", "'D' || o_custkey").replace("{1}", "author")


@query(rf"""SELECT o_orderkey::BIGINT AS doc_id, 'Order ' || o_orderkey || ' \emph{{of}} note' AS title, '[' || {_TREE} || ',' || CASE WHEN o_orderkey % 5 = 0 THEN {_AGAIN} || ',{{"Text":{{"text":"' ELSE '{{"Text":{{"text":"\n' END || 'Text.\n"}}}}]' AS ast FROM orders""")
def ast_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees as JSON, and as VARIANT for paths."""
    return nodes.ast_json(B.order_meta(spark, sf_dir)).select("doc_id", F.parse_json("ast").alias("v")).select("doc_id", F.expr("variant_get(v, '$[0].Command.args[0]', 'string')").alias("title"), F.to_json("v").alias("ast"))


def _entries(content: bytes) -> str:
    return ",".join(zipfile.ZipFile(BytesIO(content)).namelist())


@query("SELECT f.format, f.entries, count(*) AS n FROM nation, (VALUES ('docx', '[Content_Types].xml,_rels/.rels,word/_rels/document.xml.rels,word/document.xml'), ('epub', 'mimetype,META-INF/container.xml,OEBPS/content.opf,OEBPS/nav.xhtml,OEBPS/content.xhtml')) f(format, entries) GROUP BY 1, 2")
def packaged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), B.cat("\\title{T}\\section{", F.col("n_name"), "} Text.").alias("tex"))
    made = [nodes.packaged(docs, form).withColumn("format", F.lit(form)) for form in ("docx", "epub")]
    return nodes.mapped(made[0].unionByName(made[1]), _entries, "entries", T.StringType(), "content", ("format",)).groupBy("format", "entries").agg(F.count("*").alias("n"))


def _parts(content: bytes) -> list[tuple[str, str]]:
    """(part, text) of a package: paragraphs of a text document, or what a book says of itself, its first link and its body."""
    package = zipfile.ZipFile(BytesIO(content))
    if "word/document.xml" in package.namelist():
        paragraphs = ElementTree.fromstring(package.read("word/document.xml")).iter("{http://schemas.openxmlformats.org/wordprocessingml/2006/main}p")
        return [(f"paragraph {k}", "".join(p.itertext())) for k, p in enumerate(paragraphs)]
    about = ElementTree.fromstring(package.read("OEBPS/content.opf"))
    out = [(name, about.find(f".//{{http://purl.org/dc/elements/1.1/}}{name}").text) for name in ("title", "creator", "date")]
    link = ElementTree.fromstring(package.read("OEBPS/nav.xhtml")).find(".//{http://www.w3.org/1999/xhtml}a")
    body = package.read("OEBPS/content.xhtml").decode()
    return [*out, ("link", link.text), ("body", body[body.index("<body>") + 6 : body.index("</body>")])]


_PARTS = {
    "docx": {"paragraph 0": "On @", "paragraph 1": "On @A & B@\n First.", "paragraph 2": "Second."},
    "epub": {"title": "On @", "creator": "A & B", "date": "2026-01-01", "link": "On @", "body": "<h2>@</h2>\n First.<p></p>\nSecond."},
}


@query(f"SELECT n_nationkey::BIGINT AS n, f.format, f.part, replace(f.text, '@', n_name) AS text FROM nation, (VALUES {_values((form, part, text) for form, parts in _PARTS.items() for part, text in parts.items())}) f(format, part, text)")
def packaged_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packages hold, read back from their bytes."""
    tex = B.cat("\\title{On ", F.col("n_name"), "}\\author{A & B}\\section{", F.col("n_name"), "} First.\n\nSecond.")
    docs = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), tex.alias("tex"))
    made = sinks.outputs(docs, tuple(_PARTS))
    rows = nodes.rows_of(made, _parts, T.StructType([T.StructField("part", T.StringType()), T.StructField("text", T.StringType())]), "content", ("doc_id", "format"))
    return rows.withColumnRenamed("doc_id", "n")


_PAGE = "<!DOCTYPE html>\n<html>\n<head>\n<meta charset=\"utf-8\" />\n<title>On @</title>\n</head>\n<body>\n<header>\n<h1>On @</h1>\n<p>A</p>\n<p>May 1, 2024</p>\n</header>\nText <strong>@</strong></body>\n</html>\n"


@query(f"SELECT n_nationkey::BIGINT AS n, replace({_quoted(_PAGE)}, '@', n_name) AS html FROM nation")
def html_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, with a header, and the date that the caller gives."""
    tex = B.cat("\\title{On ", F.col("n_name"), "}\\author{A}\\date{\\today}\\begin{document}Text \\textbf{", F.col("n_name"), "}\\end{document}")
    docs = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), tex.alias("tex"))
    return nodes.html(docs, "May 1, 2024", whole=True).select(F.col("doc_id").alias("n"), "html")


@query("SELECT r_regionkey::BIGINT AS region, f.format, r_regionkey || '.' || f.extension AS file FROM region, (VALUES ('pdf', 'pdf'), ('html', 'html'), ('docx', 'docx'), ('epub', 'epub')) f(format, extension)")
def format_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One output for each document and format; the formats are a table of four rows."""
    formats = spark.createDataFrame([f[:3] for f in dims.FORMATS], "format string, extension string, media_type string")
    docs = B.read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("region"), B.cat(F.col("r_regionkey"), ".tex").alias("path"))
    return docs.crossJoin(F.broadcast(formats)).select("region", "format", F.concat(C.stem(F.col("path")), F.lit("."), F.col("extension")).alias("file"))


@query("SELECT o_orderkey::BIGINT AS o, (CASE WHEN o_orderkey % 5 = 0 THEN 6 ELSE 5 END)::BIGINT AS element_count, 'Order ' || o_orderkey || ' \\emph{of} note' AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'D' ELSE 'C' END || o_custkey AS author FROM orders")
def intermediate_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.meta(B.order_meta(spark, sf_dir)).withColumnRenamed("doc_id", "o")


@query("SELECT f.format, count(*) AS n FROM region, (VALUES ('html'), ('docx'), ('epub'), ('txt')) f(format) WHERE r_regionkey IN (SELECT n_regionkey FROM nation) GROUP BY 1")
def output_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in every format, parsed once."""
    made = sinks.outputs(B.nation_tables(spark, sf_dir), ("html", "docx", "epub", "txt"))
    return made.where("octet_length(content) > 0").groupBy("format").agg(F.count("*").alias("n"))


# completion, state, plugins

_COMMANDS = ", ".join(f"('{n}')" for n, _ in dims.COMPLETIONS)


@query(f"SELECT p.prefix, c.name FROM (SELECT DISTINCT lower(left(p_type, k)) AS prefix FROM part, (VALUES (0), (1), (2), (3)) v(k)) p, (VALUES {_COMMANDS}) c(name) WHERE starts_with(c.name, p.prefix)")
def completion_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first letters of the parts' types may go on to."""
    table = spark.createDataFrame(list(dims.COMPLETIONS), "name string, detail string")
    typed = F.explode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.lower(F.substring(F.col("p_type"), F.lit(1), k))))
    asked = B.read(spark, sf_dir, "part").select(typed.alias("prefix")).distinct()
    return asked.join(F.broadcast(table), F.startswith(F.col("name"), F.col("prefix"))).select("prefix", "name")


@query("SELECT n_nationkey::BIGINT AS n, e.name FROM nation, (VALUES ('tabular'), ('table')) e(name) UNION ALL SELECT -1 - n_nationkey, c.name FROM nation, (VALUES ('textbf'), ('textit'), ('texttt'), ('textcolor')) c(name)")
def completion_at_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments or commands, by what stands before the cursor."""
    from quire.functions import analysis

    n = B.read(spark, sf_dir, "nation")
    docs = n.select(F.col("n_nationkey").cast("long").alias("n"), B.cat(F.col("n_name"), " \\begin{ta").alias("tex"))
    docs = docs.union(n.select((-1 - F.col("n_nationkey")).cast("long"), B.cat("\\begin{a}é", F.col("n_name"), " \\text")))
    return nodes.rows_of(docs, lambda s: [(c[0],) for c in analysis.completions(s, len(s.encode()))], T.StructType([T.StructField("name", T.StringType())]), keys=("n",))


@query("SELECT n_nationkey::BIGINT AS n, '`\\section` — Section heading' AS hover FROM nation")
def hover_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions import analysis

    docs = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), B.cat("é \\section{", F.col("n_name"), "}").alias("tex"))
    return nodes.mapped(docs, lambda s: analysis.hover(s, len(s.encode())), "hover", T.StringType(), keys=("n",))


@query("SELECT doc_id::BIGINT AS doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0")
def incremental_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a manifest of every third document, those of every fifth have changed, and every seventh has a newer file."""
    return incremental.stale(*_versions(spark, sf_dir)).select("doc_id")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = B.read(spark, sf_dir, "documents")
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")
    path, form = F.col("doc_id").cast("string").alias("path"), F.lit("html").alias("format")
    now = docs.select("doc_id", path, form, C.content_hash(F.col("text")).alias("content_hash"), F.when(F.col("doc_id") % 7 == 0, at(3)).otherwise(at(1)).alias("newest_dep"))
    seen = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    manifest = docs.where("doc_id % 3 = 0").select(path, form, C.content_hash(seen).alias("content_hash"), at(2).alias("oldest_output"))
    return now, manifest


@query("SELECT doc_id::BIGINT AS doc_id, min(doc_id) OVER (PARTITION BY text)::BIGINT AS first FROM documents")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.read(spark, sf_dir, "documents").select("doc_id", C.content_hash(F.col("text")).alias("content_hash"))
    return incremental.first_of_each_content(docs)


@query(
    """WITH s AS (SELECT user_id AS u, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b, count(*) FILTER (event_type = 'error') AS c, count(*) FILTER (event_type = 'none') AS d FROM events GROUP BY 1)
    SELECT u::BIGINT AS u, CASE WHEN a + b = 0 THEN 0.0 ELSE a / (a + b) END::DOUBLE AS parse_rate, CASE WHEN c + d = 0 THEN 0.0 ELSE c / (c + d) END::DOUBLE AS output_rate, CASE WHEN a + b + c + d = 0 THEN 0.0 ELSE (a + c) / (a + b + c + d) END::DOUBLE AS total_rate FROM s"""
)
def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    stats = B.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u")).agg(count("click").alias("parse_hits"), count("view").alias("parse_misses"), count("error").alias("output_hits"), count("none").alias("output_misses"))
    return incremental.hit_rates(stats).select("u", "parse_rate", "output_rate", "total_rate")


@query(
    """WITH e AS (SELECT event_type AS cache, user_id::VARCHAR AS key, max(ts) AS t FROM events GROUP BY 1, 2), now AS (SELECT max(t) AS n FROM e),
    x AS (SELECT cache, key, t, date_trunc('second', n) - date_trunc('second', t) > INTERVAL 86400 SECOND AS expired FROM e, now)
    SELECT cache, key, expired FROM (SELECT *, row_number() OVER (PARTITION BY cache, expired ORDER BY t DESC, key) AS r FROM x) WHERE expired OR r > 20"""
)
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache for each event type drops that holds 20 entries for a day."""
    entries = B.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("cache"), F.col("user_id").cast("string").alias("key")).agg(F.max("ts").alias("last_accessed"))
    now = entries.agg(F.max("last_accessed").alias("_now"))
    return incremental.evicted(entries.crossJoin(F.broadcast(now)), 20, F.col("_now"), 86400).select("cache", "key", "expired")


@query("SELECT c_custkey::BIGINT AS c, t.kind, t.name, CASE t.name WHEN 'textbf' THEN c_mktsegment WHEN 'url' THEN 'http://c/' || c_custkey ELSE NULL END AS arg FROM customer, (VALUES ('Command', 'textbf'), ('Command', 'url'), ('Text', NULL)) t(kind, name)")
def plugin_custom_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands that three plugins read."""
    tex = B.cat("\\custombold{", F.col("c_mktsegment"), "}\\weblink{http://c/", F.col("c_custkey"), "}\\currentdate")
    docs = B.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), tex.alias("tex"))
    made = nodes.nodes(docs, plugins=(CustomFormat(), Url(), Today("May 1, 2024")))
    return made.select(F.col("doc_id").alias("c"), "kind", "name", F.get("args", F.lit(0)).alias("arg"))


@query("SELECT o_orderkey::BIGINT AS o, strftime(o_orderdate, '%B %d, %Y') AS today FROM orders")
def today_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("o"), C.today(F.col("o_orderdate")).alias("today"))


@query("SELECT o_custkey::BIGINT AS c, 'o' || o_orderkey AS key FROM orders")
def fast_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels without parsing: sources are free of macros and comments, and labels of braces."""
    return B.order_labels(spark, sf_dir).select(F.col("doc_id").alias("c"), F.explode(C.flat_command(F.col("tex"), "label")).alias("key"))


@query("SELECT p_partkey::BIGINT AS p, '{' || p_name || '}$_' AS escaped FROM part")
def escape_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specials that are escaped for TeX read back as themselves."""
    raw = B.cat("{", F.col("p_name"), "}$_")
    docs = B.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), C.escape_tex(raw).alias("tex"))
    return nodes.nodes(docs).where("kind = 'Text'").select(F.col("doc_id").alias("p"), F.col("text").alias("escaped"))


_SOURCES = "(SELECT n_regionkey AS r, count(DISTINCT n_nationkey) + count(s_suppkey) + 2 AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)"


@query(f"SELECT 0::BIGINT AS batch, 'r' || r || '.tex' AS file, n::INT AS elements FROM {_SOURCES} UNION ALL SELECT 1, 'r' || r || '.tex', (n + 1)::INT FROM {_SOURCES} WHERE r = (SELECT min_by(n_regionkey, n_nationkey) FROM nation)")
def watch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region, which reads one for each nation, watched; then one nation's file changes, and the document that reads it is built again.

    Files end with a line feed, so a document ends with a blank line: one element more than its headings.
    """
    from quire.operators.shared import scratch_folder
    from quire.streaming import watch

    folder = scratch_folder(spark)
    nation, supplier = B.read(spark, sf_dir, "nation"), B.read(spark, sf_dir, "supplier")
    subs = B.gathered(supplier, "s_nationkey", B.cat("\\subsection{", F.col("s_name"), "}"), "s_suppkey", between="")
    lines = nation.join(subs, nation.n_nationkey == subs.doc_id, "left").withColumn("body", B.cat("\\section{", F.col("n_name"), "}", F.coalesce("body", F.lit(""))))
    inner = lines.select(B.cat("n", F.col("n_nationkey"), ".tex").alias("file"), F.col("body").alias("tex"))
    outer = B.gathered(nation, "n_regionkey", B.cat("\\input{n", F.col("n_nationkey"), "}"), "n_nationkey", between="")
    outer = outer.select(B.cat("r", F.col("doc_id"), ".tex").alias("file"), B.cat("\\chapter{r}", F.col("body")).alias("tex"))
    first = lines.orderBy("n_nationkey").limit(1).select(B.cat("n", F.col("n_nationkey"), ".tex").alias("file"), B.cat(F.col("body"), "\\section{new}").alias("tex"))
    build = watch.rebuilder(spark, f"{folder}/raw", f"{folder}/built")
    for change in (inner.unionByName(outer), first):
        sinks.write_sources(change, f"{folder}/raw")
        watch.wait(watch.watch(watch.ticks(spark), build, f"{folder}/state"))
    made = spark.read.parquet(f"{folder}/built/out")
    return made.select(F.col("batch").cast("long").alias("batch"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "elements")


# small forms, each with what it reads as

_READS = {
    "html_commands": lambda s: render.html(parser.parse(s)), "html_elements": lambda s: render.html(parser.parse(s)), "node_forms": lambda s: render.shape(parser.parse(s)),
    "environment_forms": lambda s: render.shape(parser.parse(s)), "math_forms": mathfmt.to_unicode, "mathml_forms": mathml.to_mathml, "plain_forms": lambda s: render.plain(parser.parse(s)),
    "layout_forms": lambda s: render.layout_shape(parser.parse(s), "May 1, 2024"),
}


def _forms(name: str, table: dict[str, str]) -> None:
    """Every form with every nation's name in it. In formulas names have no marks of their own."""
    mathematics = name.startswith("math")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("n_nationkey").cast("long").alias("n")
        word = B.cat("k", F.col("n_nationkey")) if mathematics else F.col("n_name")
        each = F.posexplode(F.array(*map(F.lit, table))).alias("form", "tex")
        docs = B.spread(B.read(spark, sf_dir, "nation")).select(key, word.alias("word"), each).withColumn("tex", F.replace("tex", F.lit("@"), F.col("word")))
        return nodes.mapped(docs, _READS[name], "made", T.StringType(), keys=("n", "form"))

    run.__name__ = name
    word = "'k' || n_nationkey" if mathematics else "n_name"
    query(f"SELECT n_nationkey::BIGINT AS n, f.form, replace(f.made, '@', {word}) AS made FROM nation, (VALUES {_values(enumerate(table.values()))}) f(form, made)")(run)


for _name, _table in forms.TABLES.items():
    _forms(_name, _table)


@query(f"SELECT r_regionkey::BIGINT AS region, f.name, f.symbol || r_regionkey AS made FROM region, (VALUES {_values(forms.SYMBOLS.items())}) f(name, symbol)")
def math_symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol that a formula can name."""
    docs = B.read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("region"), F.explode(F.array(*map(F.lit, forms.SYMBOLS))).alias("name"))
    docs = B.spread(docs).withColumn("tex", F.concat(F.lit("\\"), F.col("name"), F.lit("{}"), F.col("region").cast("string")))
    made = nodes.mapped(docs, mathfmt.to_unicode, "made", T.StringType(), keys=("region", "name"))
    return made.withColumn("made", F.regexp_replace("made", r"\{\}", ""))


_ACCENTS = {"acute": "'", "grave": "`", "circumflex": "^", "diaeresis": '"', "tilde": "~", "macron": "=", "dot": ".", "breve": "u", "caron": "v", "double": "H", "cedilla": "c", "ogonek": "k", "ring": "r", "bar": "b", "below": "d", "tie": "t"}


@query(f"SELECT n_nationkey::BIGINT AS n, a.name AS accent, l.c AS letter, nfc_normalize(l.c || chr(a.mark)) || n_name AS text FROM nation, (VALUES {_values((k, ord(dims.TEXT_ACCENTS[v])) for k, v in _ACCENTS.items())}) a(name, mark), (VALUES {_values((c,) for c in forms.LETTERS)}) l(c)")
def accent_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every accent over many letters."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("accent"), F.lit(c).alias("letter"), F.lit(f"\\{v}{{{c}}}").alias("tex")) for k, v in _ACCENTS.items() for c in forms.LETTERS)))
    docs = B.spread(B.read(spark, sf_dir, "nation")).select(F.col("n_nationkey").cast("long").alias("n"), "n_name", pairs.alias("p")).select("n", "p.accent", "p.letter", F.concat("p.tex", "n_name").alias("tex"))
    return nodes.nodes(docs, keys=("n", "accent", "letter"), kinds=("Text",), columns=("text",))


@query(f"SELECT n_nationkey::BIGINT AS n, f.name, f.symbol || n_name AS text FROM nation, (VALUES {_values(dims.TEXT_SYMBOLS.items())}) f(name, symbol)")
def text_symbol_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol that text can name."""
    docs = B.spread(B.read(spark, sf_dir, "nation")).select(F.col("n_nationkey").cast("long").alias("n"), "n_name", F.explode(F.array(*map(F.lit, dims.TEXT_SYMBOLS))).alias("name"))
    docs = docs.withColumn("tex", F.concat(F.lit("\\"), F.col("name"), F.when(F.col("name").rlike("^[A-Za-z]"), "{}").otherwise(""), F.col("n_name")))
    return nodes.nodes(docs, keys=("n", "name"), kinds=("Text",), columns=("text",))


_GLOSSARY = {"gls": "ab", "glspl": "abs", "Gls": "Ab", "GLS": "AB", "acrshort": "ab", "acrlong": "a long one", "acrfull": "a long one (ab)"}


@query(f"SELECT n_nationkey::BIGINT AS n, f.command, f.made || ' ' || n_name AS text FROM nation, (VALUES {_values(_GLOSSARY.items())}) f(command, made)")
def glossary_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), "n_name", F.explode(F.array(*map(F.lit, _GLOSSARY))).alias("command"))
    docs = docs.withColumn("tex", F.concat(F.lit("\\newacronym[x]{k}{ab}{a long one}\\"), F.col("command"), F.lit("{k} "), F.col("n_name")))
    return nodes.nodes(docs, keys=("n", "command"), kinds=("Text",), columns=("text",))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_extract_agg(spark, sf_dir)


