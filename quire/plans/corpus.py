"""Builders of TeX corpora from the relational tables: what they hold can be recomputed without TeX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of a part from which documents are built, and rows of a part in which they are gathered.
ROWS, LINES = 25_000, 25_000


def _parts(rows: DataFrame, most: int) -> int:
    """At least one part for each core, and as many as keep to `most` rows: splits and shuffles go by packed bytes, which say little about the work on a row."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))


def spread(rows: DataFrame) -> DataFrame:
    """A scan dealt over parts of at most `ROWS` rows (as counted from the files' footers) and over all cores; one that has such parts stays as it is."""
    parts = _parts(rows, ROWS)
    return rows.repartition(parts) if rows.rdd.getNumPartitions() < parts else rows


def cat(*parts: str | Column) -> Column:
    """Literal strings and columns (as text) one after another."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def gathered(rows: DataFrame, key: str, text: Column, *order: str, between: str = "\n", **more: Column) -> DataFrame:
    """doc_id and `body`: the texts of each key in order, and further texts by name; null texts are left out. Rows are shuffled once, to parts of about `LINES`."""
    texts = {"body": text} | more
    held = rows.select(F.col(key).cast("long").alias("doc_id"), F.struct(*order, *(t.alias(f"_{n}") for n, t in texts.items())).alias("_s"))
    held = held.repartition(_parts(rows, LINES), "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list("_s")).alias("_s"))
    return held.select("doc_id", *(F.array_join(F.col(f"_s._{n}"), between).alias(n) for n in texts))


def wrapped(rows: DataFrame, before: str, after: str) -> DataFrame:
    return rows.select("doc_id", cat(before, F.col("body"), after).alias("tex"))


def whole(before: str, after: str = "") -> tuple[str, str]:
    """The bounds of a complete document around a body."""
    return "\\documentclass{article}\n\\begin{document}\n" + before, after + "\n\\end{document}\n"


def lineitem_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each order: line, quantity, cents and flag of its lines."""
    rows = read(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    line = cat(F.col("l_linenumber"), " & ", F.col("l_quantity").cast("long"), " & ", cents, " & ", F.col("l_returnflag"), r" \\")
    held = gathered(rows.withColumn("_c", cents), "l_orderkey", line, "l_linenumber", "l_quantity", "_c", "l_returnflag")
    return wrapped(held, *whole("\\begin{tabular}{l*{2}{r}|c}\n\\toprule\nline & quantity & cents & flag \\\\\n\\midrule\n", "\n\\bottomrule\n\\end{tabular}"))


def nation_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table for each region, with a spanning title row and one row for each nation."""
    rows = read(spark, sf_dir, "nation")
    line = cat(F.col("n_nationkey"), " & ", F.col("n_name"), r" \\")
    return wrapped(gathered(rows, "n_regionkey", line, "n_nationkey"), "\\begin{tabular}{|r|p{3cm}|}\n\\hline\n\\multicolumn{2}{|c|}{Nations} \\\\\n\\hline\n", "\n\\hline\n\\end{tabular}\n")


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier, region = (read(spark, sf_dir, t) for t in ("nation", "supplier", "region"))
    return spread(supplier).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def geo_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier a chapter for its region, a section for its nation, a subsection of its own."""
    text = cat(whole("\\chapter{")[0], F.col("r_name"), "}\n\\section{", F.col("n_name"), "}\n\\subsection{", F.col("s_name"), "}\n", whole("")[1])
    return _located(spark, sf_dir).select(F.col("s_suppkey").cast("long").alias("doc_id"), text.alias("tex"))


#: Citation commands in use, by the order's key modulo their number.
CITES = ("cite", "parencite", "footcite", "citeauthor", "supercite", "textcite", "autocite", "nocite")


def cite_name(key: str) -> Column:
    out = F.lit(CITES[0])
    for k, name in enumerate(CITES[1:], 1):
        out = F.when(F.col(key) % len(CITES) == k, name).otherwise(out)
    return out


def customer_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer its orders, cited in pairs of keys, and a bibliography of the even ones."""
    rows = read(spark, sf_dir, "orders")
    mention = cat("See \\", cite_name("o_orderkey"), "{o", F.col("o_orderkey"), ", s", F.col("o_orderkey") % 10, "}.")
    entry = F.when(F.col("o_orderkey") % 2 == 0, cat("\\bibitem{o", F.col("o_orderkey"), "} Order ", F.col("o_orderkey"), " of ", F.col("o_orderpriority"), "."))
    both = gathered(rows, "o_custkey", mention, "o_orderkey", bib=entry)
    bib = F.when(F.col("bib") != "", cat("\n\\begin{thebibliography}{99}\n", F.col("bib"), "\n\\end{thebibliography}")).otherwise("")
    return both.select("doc_id", cat(whole("")[0], F.col("body"), bib, whole("")[1]).alias("tex"))


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer a label for each order, and references to it and, of every third, to one that doesn't exist."""
    rows = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = cat("\\label{o", key, "} see \\ref{o", key, "} and \\pageref{o", key, "}", F.when(key % 3 == 0, cat(" but \\eqref{x", key, "}")).otherwise(""), ".")
    return wrapped(gathered(rows, "o_custkey", text, "o_orderkey"), *whole(""))


def nation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier a list with its nation, within it a list of up to three numbered names, and a description of the nation."""
    n = F.col("s_suppkey") % 4
    names = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1))), lambda k: cat("\\item ", F.col("s_name"), "-", k, "\n"))
    inner = F.when(n > 0, cat("\\begin{enumerate}\n", F.array_join(names, ""), "\\end{enumerate}\n")).otherwise("")
    text = cat(
        whole("\\begin{itemize}\n\\item ")[0], F.col("n_name"), "\n", inner, "\\end{itemize}\n\n\\begin{description}\n\\item[", F.col("n_name"),
        "] Number ", F.col("n_nationkey"), " of its kind.\n\\end{description}", whole("")[1],
    )
    return _located(spark, sf_dir).select(F.col("s_suppkey").cast("long").alias("doc_id"), text.alias("tex"))


def part_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part a document with a theorem, notes, code, a figure and links."""
    p = spread(read(spark, sf_dir, "part"))
    key, name = F.col("p_partkey"), F.col("p_name")
    text = cat(
        whole("\\begin{")[0], F.when(key % 2 == 0, "theorem").otherwise("lemma"), "}[", name, "]\nEvery part of size ", F.col("p_size"), " is \\emph{small}.\n\\end{",
        F.when(key % 2 == 0, "theorem").otherwise("lemma"), "}\nA word\\footnote{Note on ", F.col("p_brand"), "} here.\n\n\\begin{verbatim}\nsize = ", F.col("p_size"),
        "\n\\end{verbatim}\n\\begin{figure}[h]\n\\centering\n\\includegraphics[width=", F.col("p_size"), "cm]{part", key, ".png}\n\\caption{Part ", key,
        "}\n\\label{fig", key, "}\n\\end{figure}\n\\href{http://parts.example/", key, "}{", name, "} and \\url{http://parts.example/all}", whole("")[1],
    )
    return p.select(key.cast("long").alias("doc_id"), text.alias("tex"))


def macro_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer definitions of all kinds, and calls of them."""
    c = spread(read(spark, sf_dir, "customer"))
    text = cat("\\newcommand{\\seg}[2]{#1 in #2}\\def\\key#1{[#1]}\\let\\again\\key\\providecommand{\\seg}{no}\\seg{", F.col("c_name"), "}{", F.col("c_mktsegment"), "} \\key{", F.col("c_custkey"), "} \\again{", F.col("c_nationkey"), "}")
    return c.select(F.col("c_custkey").cast("long").alias("doc_id"), text.alias("tex"))


def order_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order a document with title, author and date; of every fifth, the body gives the author anew."""
    o = spread(read(spark, sf_dir, "orders"))
    text = cat(
        "\\documentclass[a4paper]{article}\n\\title{Order ", F.col("o_orderkey"), " \\emph{of} note}\n\\author{C", F.col("o_custkey"), "}\n\\date{",
        F.date_format("o_orderdate", "yyyy-MM-dd"), "}\n\\begin{document}\n\\maketitle\n", F.when(F.col("o_orderkey") % 5 == 0, cat("\\author{D", F.col("o_custkey"), "}")).otherwise(""), "Text.\n\\end{document}\n",
    )
    return o.select(F.col("o_orderkey").cast("long").alias("doc_id"), text.alias("tex"))


def broken_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order a document with the defects that its key decides."""
    key = F.col("o_orderkey")
    o = spread(read(spark, sf_dir, "orders"))
    pick = lambda n, r, text: F.when(key % n == r, text).otherwise("")
    text = cat(
        pick(2, 0, "\\documentclass{article}\n"), "\\begin{document}\n", pick(3, 0, "{"), pick(7, 0, "}}"), pick(5, 0, " $x$ $ "), "% } $\n",
        "\\begin{center}a\\end{center}", pick(11, 0, "\\begin{quote}b\\end{itemize}"), pick(13, 0, "\\begin{quote}"), pick(4, 0, "\n\\end{document}\n"),
    )
    return o.select(key.cast("long").alias("doc_id"), text.alias("tex"))


def part_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, form and tex: a formula of each form for each part."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("doc_id"), F.col("p_size").alias("n"))
    n, m = F.col("n"), F.col("n") % 9 + 2
    forms = {
        "fraction": cat("\\frac{", n, "}{", m, "}"), "script": cat("x^{", n, "}_{", m, "+1}"), "root": cat("\\sqrt[", m, "]{", n, "+a}"),
        "binomial": cat("\\binom{", n, "}{", m, "}"), "alphabet": cat("\\mathbb{R}^", m, " \\mathcal{L}"), "accent": cat("\\hat{x}_", m), "symbol": cat("\\alpha \\leq ", n, " \\rightarrow \\infty"),
    }
    return p.select("doc_id", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("form"), v.alias("tex")) for k, v in forms.items()))).alias("f")).select("doc_id", "n", "f.form", "f.tex")


def mixed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part text with boxes, spacing, units, containers, lines of formulas, and commands that nothing reads."""
    p = spread(read(spark, sf_dir, "part"))
    key, size = F.col("p_partkey"), F.col("p_size")
    text = cat(
        whole("\\begin{quote}Quoted ")[0], key, "\\end{quote}\\begin{center}Centred \\textbf{", F.col("p_brand"), "}\\end{center}\n\\begin{align*}\na &= ", size, " \\\\\nb &= ", size + 1,
        "\n\\end{align*}\nMass \\SI{", size, "}{kg} to \\num{", size, "}\\quad\\raisebox{1pt}{up}\\fcolorbox{red}{blue}{box} \\textcolor{green}{col", key,
        "}\\strange{word}\\vspace{2cm}\\today\\index{part!", key, "}\\mystery", whole("")[1],
    )
    return p.select(key.cast("long").alias("doc_id"), text.alias("tex"))
