"""Queries whose work is relational where the parser's own route would take a document whole: trees written out, tables, outlines, brackets, places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import extractors, incremental, nodes, outlines, serialise, tabular
from quire.plans import corpus as B
from quire.plans.catalogue import _LOCATED, _versions, ORACLE, query

_LISTED = rf"""{_LOCATED}, x AS (SELECT supplier, n_name, n_nationkey, list_transform(range(1, supplier % 4 + 1), lambda k: s_name || '-' || k) AS names FROM g)"""


def _tree(docs: DataFrame, made, name: str) -> DataFrame:
    return made(docs, nodes.nodes(docs, columns=serialise.READ, forms=True)).select("doc_id", name)


@query(
    rf"""{_LISTED} SELECT supplier AS doc_id, 'list' AS kind, '<ul>\n<li>' || n_name || CASE WHEN len(names) > 0 THEN '\n<ol>\n' || array_to_string(list_transform(names, lambda s: '<li>' || s || '</li>\n'), '') || '</ol>\n' ELSE '' END
        || '</li>\n</ul>\n<p></p>\n<dl>\n<dt>' || n_name || '</dt>\n<dd>Number ' || n_nationkey || ' of its kind.</dd>\n</dl>\n' AS html FROM x
    UNION ALL SELECT p_partkey::BIGINT, 'part', '<section class="theorem"><h3 class="theorem-heading">' || CASE WHEN p_partkey % 2 = 0 THEN 'Theorem' ELSE 'Lemma' END || ' (' || p_name || ')</h3>\nEvery part of size ' || p_size
        || ' is <em>small</em>.\n</section>\n\nA word<sup class="footnote">Note on ' || p_brand || '</sup> here.<p></p>\n<pre><code>size = ' || p_size || '</code></pre>\n<div class="center"><img src="part' || p_partkey || '.png" alt="part' || p_partkey || '.png" width="' || p_size
        || 'cm" />\n<figcaption>Part ' || p_partkey || '</figcaption>\n<span id="fig' || p_partkey || '"></span></div>\n<a href="http://parts.example/' || p_partkey || '">' || p_name || '</a> and <a href="http://parts.example/all">http://parts.example/all</a>' FROM part""".replace("\\n", "' || chr(10) || '")
)
def html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML as an ordered aggregate over the node table: nested lists, descriptions, and documents of many kinds of nodes."""
    listed, parts = _tree(B.nation_lists(spark, sf_dir), serialise.html, "html"), _tree(B.part_notes(spark, sf_dir), serialise.html, "html")
    return listed.select("doc_id", F.lit("list").alias("kind"), "html").unionByName(parts.select("doc_id", F.lit("part").alias("kind"), "html"))


@query(
    rf"""{_LISTED} SELECT supplier AS doc_id, 'list' AS kind, '• ' || n_name || '\n' || array_to_string(list_transform(names, lambda s: '• ' || s || '\n'), '') || CASE WHEN len(names) > 0 THEN '\n' ELSE '' END
        || '\n\n' || n_name || ': Number ' || n_nationkey || ' of its kind.\n' AS plain FROM x
    UNION ALL SELECT p_partkey::BIGINT, 'part', CASE WHEN p_partkey % 2 = 0 THEN 'THEOREM' ELSE 'LEMMA' END || ' (' || p_name || '): \nEvery part of size ' || p_size || ' is small.\n\n\nA wordNote on ' || p_brand
        || ' here.\n\nsize = ' || p_size || '\npart' || p_partkey || '.png\nPart ' || p_partkey || 'http://parts.example/' || p_partkey || ' and http://parts.example/all' FROM part""".replace("\\n", "' || chr(10) || '")
)
def plain_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text as an ordered aggregate over the node table."""
    listed, parts = _tree(B.nation_lists(spark, sf_dir), serialise.plain, "plain"), _tree(B.part_notes(spark, sf_dir), serialise.plain, "plain")
    return listed.select("doc_id", F.lit("list").alias("kind"), "plain").unionByName(parts.select("doc_id", F.lit("part").alias("kind"), "plain"))


@query(ORACLE["table_extract_agg"])
def table_extract_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items through a table of TeX and back by column expressions alone: no Python runs on executors."""
    found = tabular.native_tables(B.lineitem_tables(spark, sf_dir)).select(F.posexplode("rows").alias("k", "row")).where("not row.is_separator and k > 2")
    cells = found.select(F.col("row.cells")[3].alias("flag"), F.expr("try_cast(row.cells[1] AS bigint)").alias("q"), F.expr("try_cast(row.cells[2] AS bigint)").alias("c"))
    return cells.groupBy("flag").agg(F.sum("q").alias("quantity"), F.sum("c").alias("cents"), F.count("*").alias("n"))


@query(
    """SELECT p_partkey::BIGINT AS p, t.k AS table_idx, t.columns, r.k AS row_idx, replace(replace(r.cells, '#', p_partkey::VARCHAR), '@', p_name) AS cells
    FROM part, (VALUES (0, 'left,right,right,center'), (1, 'left,left')) t(k, columns), (VALUES (0, 0, 'Part #|||'), (0, 1, '--'), (0, 2, 'a & b|@|$#|x & y'), (0, 3, '1|wide|{z}|'), (1, 0, '#|@')) r(t, k, cells)
    WHERE r.t = t.k AND (p_partkey % 3 <> 0 OR t.k = 0 OR r.t = 1)"""
)
def table_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spanning cells, rules, escapes, marks within braces and repeated columns; a third of the documents hold a comment, so the parser reads them."""
    part, key, name = B.spread(B.read(spark, sf_dir, "part")), F.col("p_partkey"), F.col("p_name")
    one = B.cat("\\begin{tabular}{l*{2}{r}|c@{ }}\n\\multicolumn{4}{c}{Part ", key, "} \\\\ \\hline\na \\& b & ", name, " & \\$", key, " & x \\& y \\\\\nlone\\\\ 1 & wide & {z} & \\\\\n\\end{tabular}")
    two = B.cat("\\begin{longtable}[t]{p{3cm}X}", key, " & ", name, "\\end{longtable}")
    tex = B.cat("\\begin{document}", one, "\n\n\\begin{center}", two, "\\end{center}", F.when(key % 3 == 0, "% a comment\n").otherwise(""), "\\end{document}")
    found = tabular.tables(part.select(key.cast("long").alias("doc_id"), tex.alias("tex")))
    rows = found.select(F.col("doc_id").alias("p"), F.col("table_idx").cast("int").alias("table_idx"), F.array_join("columns", ",").alias("columns"), F.posexplode("rows").alias("row_idx", "row"))
    return rows.select("p", "table_idx", "columns", "row_idx", F.when(F.col("row.is_separator"), "--").otherwise(F.array_join("row.cells", "|")).alias("cells"))


@query(ORACLE["section_outline"])
def outline_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings and what they stand under, by windows over the node table."""
    return outlines.headings(B.geo_outline(spark, sf_dir)).select(F.col("doc_id").alias("supplier"), "name", "parent", "depth")


_COMMANDS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")


@query(
    """WITH RECURSIVE h AS (SELECT c_nationkey::BIGINT AS n, c_name AS name, (c_custkey * 5 + c_custkey // 7) % 7 AS rank, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i FROM customer),
    p AS (SELECT a.n, a.i, a.name, max(b.i) AS up FROM h a LEFT JOIN h b ON b.n = a.n AND b.i < a.i AND b.rank < a.rank GROUP BY a.n, a.i, a.name),
    d AS (SELECT n, i, name, NULL::VARCHAR AS parent, 0 AS depth FROM p WHERE up IS NULL UNION ALL SELECT p.n, p.i, p.name, d.name, d.depth + 1 FROM p JOIN d ON p.n = d.n AND p.up = d.i)
    SELECT n, (i - 1)::INT AS symbol_id, name, parent, depth::INT AS depth FROM d"""
)
def outline_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each nation with a heading for each of its customers, of ranks in no order; SQL finds what each stands under by pairs."""
    rank = (F.col("c_custkey") * 5 + F.floor(F.col("c_custkey") / 7)) % 7
    command = F.element_at(F.array(*map(F.lit, _COMMANDS)), (rank + 1).cast("int"))
    docs = B.gathered(B.read(spark, sf_dir, "customer"), "c_nationkey", B.cat("\\", command, "{", F.col("c_name"), "}"), "c_custkey").withColumnRenamed("body", "tex")
    return outlines.headings(docs).select(F.col("doc_id").alias("n"), "symbol_id", "name", "parent", "depth")


_BROKEN = """WITH x AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN '\\documentclass{article}' || chr(10) ELSE '' END || '\\begin{document}' || chr(10) || CASE WHEN o_orderkey % 3 = 0 THEN '{' ELSE '' END
        || CASE WHEN o_orderkey % 7 = 0 THEN '}}' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN ' $x$ $ ' ELSE '' END || '% } $' || chr(10) || '\\begin{center}a\\end{center}' || CASE WHEN o_orderkey % 11 = 0 THEN '\\begin{quote}b\\end{itemize}' ELSE '' END
        || CASE WHEN o_orderkey % 13 = 0 THEN '\\begin{quote}' ELSE '' END || CASE WHEN o_orderkey % 4 = 0 THEN chr(10) || '\\end{document}' || chr(10) ELSE '' END AS t FROM orders)"""


@query(
    _BROKEN + """ SELECT k::BIGINT AS o, (instr(t, '\\end{itemize}') - 1)::INT AS start, (instr(t, '\\end{itemize}') + 12)::INT AS "end", 'env-mismatch' AS code, 'Environment mismatch: expected \\end{quote}, found \\end{itemize}' AS message FROM x WHERE k % 11 = 0
    UNION ALL SELECT k, (instr(t, '\\end{document}') - 1)::INT, (instr(t, '\\end{document}') + 13)::INT, 'env-mismatch', 'Environment mismatch: expected \\end{quote}, found \\end{document}' FROM x WHERE k % 13 = 0 AND k % 4 = 0
    UNION ALL SELECT k, (instr(t, '\\begin{document}') - 1)::INT, (instr(t, '\\begin{document}') + 15)::INT, 'env-unclosed', 'Unclosed environment ''document''' FROM x WHERE k % 13 = 0 OR k % 4 <> 0
    UNION ALL SELECT k, (length(t) - 13)::INT, length(t)::INT, 'env-unclosed', 'Unclosed environment ''quote''' FROM x WHERE k % 13 = 0 AND k % 4 <> 0"""
)
def environment_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments without a partner, with their places, by windows over their marks."""
    return outlines.environment_findings(B.broken_docs(spark, sf_dir)).select(F.col("doc_id").alias("o"), "start", "end", "code", "message")


@query(
    _BROKEN + """ SELECT k::BIGINT AS o, (instr(t, '{%') - 1)::INT AS start, instr(t, '{%')::INT AS "end", 'unclosed-brace' AS code FROM (SELECT k, replace(t, '{ $x$', '{% x$') AS t FROM x WHERE k % 3 = 0 AND k % 7 <> 0)
    UNION ALL SELECT k, (instr(t, '}}') + CASE WHEN k % 3 = 0 THEN 0 ELSE -1 + b END)::INT, (instr(t, '}}') + CASE WHEN k % 3 = 0 THEN 1 ELSE b END)::INT, 'unmatched-brace' FROM x, (VALUES (0), (1)) v(b) WHERE k % 7 = 0 AND (k % 3 <> 0 OR b = 0)"""
)
def brace_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Braces without a partner outside of comments, with their places."""
    return outlines.brace_findings(B.broken_docs(spark, sf_dir)).select(F.col("doc_id").alias("o"), "start", "end", "code")


@query("SELECT p_partkey::BIGINT AS p, c.kind, c.t || CASE c.kind WHEN 'Quote' THEN p_partkey::VARCHAR ELSE '' END AS text FROM part, (VALUES ('Quote', 'Quoted '), ('Center', 'Centred ')) c(kind, t)")
def contents_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text within containers as slices between running sums, from the node table alone."""
    docs = B.mixed_docs(spark, sf_dir)
    table = nodes.nodes(docs, kinds=("Quote", "Center", "Text"), columns=("node_id", "subtree_end", "kind", "text"))
    each = [serialise.contents(table, kind).select(F.col("doc_id").alias("p"), F.lit(kind).alias("kind"), "text") for kind in ("Quote", "Center")]
    return each[0].unionByName(each[1])


_NESTED = ("quote", "itemize", "lemma", "braces", "open")


@query(
    """SELECT n_nationkey::BIGINT AS n, c.kind, l::INT AS levels, CASE WHEN c.k < 3 THEN 2 * l ELSE 1 END::BIGINT AS nodes, CASE WHEN c.k < 3 THEN l ELSE 0 END::INT AS depth
    FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 12 = 0 THEN 100000 ELSE 1000 * (n_nationkey + 1) END AS l FROM nation), (VALUES (0, 'quote'), (1, 'itemize'), (2, 'lemma'), (3, 'braces'), (4, 'open')) c(k, kind) WHERE n_nationkey % 5 = c.k"""
)
def nested_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 1,000 to 100,000 levels of environments, lists and braces, closed and unclosed: nodes and greatest depth."""
    key = F.col("n_nationkey")
    levels = F.when(key % 12 == 0, 100_000).otherwise(1000 * (key + 1)).cast("int")
    body = lambda a, b: B.cat(F.repeat(F.lit(a), levels), F.repeat(F.lit(b), levels))
    forms = (body("\\begin{quote}a ", "\\end{quote}"), body("\\begin{itemize}\\item a ", "\\end{itemize}"), body("\\begin{lemma}a ", "\\end{lemma}"), body("{a ", "}"), body("{a ", ""))
    pick = lambda values: F.element_at(F.array(*values), (key % 5 + 1).cast("int"))
    docs = B.spread(B.read(spark, sf_dir, "nation").select(key.cast("long").alias("doc_id"), levels.alias("levels"), pick(map(F.lit, _NESTED)).alias("kind"), pick(forms).alias("tex")))
    made = nodes.nodes(docs, keys=("doc_id", "kind", "levels"), columns=("depth",))
    return made.groupBy(F.col("doc_id").alias("n"), "kind", "levels").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"))


@query(
    """WITH x AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), s AS (SELECT r, count(*)::INT AS n, min(k) AS first, max(k) AS last FROM x GROUP BY r), t AS (SELECT min(r) AS low, max(r) AS high FROM s)
    SELECT 0::BIGINT AS batch, 'r' || r || '.tex' AS file, (n + 2)::INT AS elements FROM s
    UNION ALL SELECT 1, 'r' || r || '.tex', (n + 3)::INT FROM s, t WHERE r = low
    UNION ALL SELECT 2, 'old.tex', 1
    UNION ALL SELECT 3, 'r' || r || '.tex', (n + 1)::INT FROM s, t WHERE r = high
    UNION ALL SELECT 4, 'n' || last || '.tex', 1 FROM s, t WHERE r = high UNION ALL SELECT 4, 'r' || r || '.tex', n::INT FROM s, t WHERE r = high"""
)
def watch_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each region, which reads one for each nation, watched over changes: a file that was asked for comes late and with an
    old time, an old file comes that nobody asks for, a file that is read goes, and a document no longer reads another.

    Files end with a line feed, so a document that ends with one that it reads ends with a blank line: one element more.
    """
    from quire.operators.shared import scratch_folder
    from quire.sources import sinks
    from quire.streaming import watch

    folder, nation = scratch_folder(spark), B.read(spark, sf_dir, "nation")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    build = watch.rebuilder(spark, f"{folder}/raw", f"{folder}/built")

    def step(rows: DataFrame | None = None, gone: str | None = None, old: str | None = None) -> None:
        if rows is not None:
            sinks.write_sources(rows, f"{folder}/raw")
        if old:
            system.setTimes(path(f"{folder}/raw/{old}"), 86_400_000, -1)
        if gone:
            system.delete(path(f"{folder}/raw/{gone}"), False)
        watch.wait(watch.watch(watch.ticks(spark), build, f"{folder}/state"))

    ends = nation.agg(F.min("n_regionkey"), F.max("n_regionkey")).first()
    keys = [r[0] for r in nation.where(F.col("n_regionkey") == ends[1]).select("n_nationkey").orderBy("n_nationkey").collect()]  # of one region
    call = lambda k: B.cat("\\input{n", k, "}")
    inner = nation.select(B.cat("n", F.col("n_nationkey"), ".tex").alias("file"), B.cat("\\section{", F.col("n_name"), "}").alias("tex"))
    outer = B.gathered(nation, "n_regionkey", call(F.col("n_nationkey")), "n_nationkey", between="").select(B.cat("r", F.col("doc_id"), ".tex").alias("file"), B.cat("\\chapter{r}", F.col("body"), F.when(F.col("doc_id") == ends[0], "\\input{late}").otherwise("")).alias("tex"))
    one = lambda name, tex: spark.range(1).select(F.lit(name).alias("file"), F.lit(tex).alias("tex"))
    step(inner.unionByName(outer))
    step(one("late.tex", "\\section{late}"), old="late.tex")
    step(one("old.tex", "\\section{old}"), old="old.tex")
    step(gone=f"n{keys[0]}.tex")
    kept = "".join(f"\\input{{n{k}}}" for k in keys[1:-1])
    step(one(f"r{ends[1]}.tex", "\\chapter{r}" + kept))
    made = spark.read.parquet(f"{folder}/built/out")
    return made.select(F.col("batch").cast("long").alias("batch"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "elements")


def _view(spark: SparkSession, docs: DataFrame, name: str) -> None:
    from quire.operators import table_functions

    table_functions.register(spark)
    docs.createOrReplaceTempView(name)


@query(ORACLE["section_levels"])
def sql_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings in SQL, by the table function."""
    _view(spark, B.geo_outline(spark, sf_dir), "quire_outlines")
    return spark.sql("SELECT d.doc_id AS supplier, n.text AS title, n.level FROM quire_outlines d, LATERAL tex_parse(d.tex, 'Section') n")


@query(ORACLE["citation_keys"])
def sql_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited keys in SQL, by the table function."""
    _view(spark, B.customer_citations(spark, sf_dir), "quire_cited")
    return spark.sql("SELECT d.doc_id AS c, k.key, k.key_idx FROM quire_cited d, LATERAL tex_parse(d.tex, 'Citation') n, LATERAL posexplode(n.keys) k(key_idx, key)")


@query("SELECT count(*) FILTER (doc_id % 3 <> 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0)::BIGINT AS builds, count(*) FILTER (NOT (doc_id % 3 <> 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0))::BIGINT AS skips FROM documents")
def incremental_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were skipped and that are to be built, as observed while the latter were written."""
    from quire.operators.shared import cut

    rows, seen = incremental.counted(*_versions(spark, sf_dir))
    cut(rows)
    return spark.createDataFrame([(seen.get["builds"], seen.get["skips"])], "builds long, skips long")


@query("SELECT o_custkey::BIGINT AS c, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS idx, 'o' || o_orderkey AS key FROM orders")
def labels_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by expressions where a source is flat; a third of the documents hold a comment, so the parser reads them."""
    docs = B.order_labels(spark, sf_dir).withColumn("tex", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\\n\\n% a comment\\n"), "tex")).otherwise(F.col("tex")))
    return extractors.extract(docs, "label").select(F.col("doc_id").alias("c"), F.col("idx").cast("int").alias("idx"), F.col("value").alias("key"))


@query("SELECT o_custkey::BIGINT AS c, 'o' || o_orderkey AS key FROM orders UNION ALL SELECT o_custkey, 's' || o_orderkey % 10 FROM orders")
def citations_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited keys by both ways: documents with a bibliography go to the parser."""
    return extractors.citations(B.customer_citations(spark, sf_dir)).select(F.col("doc_id").alias("c"), "key")


@query("SELECT doc_id::BIGINT AS doc_id, a.action, CASE WHEN a.action = 'build' AND doc_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n FROM documents, (VALUES ('build'), ('skip')) a(action) WHERE a.action = 'build' OR doc_id % 3 <> 0")
def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of all documents as a stream, taken twice by one query that stops in between: what is new is built, what has not changed is skipped."""
    from quire.operators.shared import scratch_folder
    from quire.streaming import stateful, watch

    folder, docs = scratch_folder(spark), B.read(spark, sf_dir, "documents")
    for day in (1, 2):
        text = F.when((F.col("doc_id") % 3 == 0) & F.lit(day == 2), F.concat("text", F.lit(" new"))).otherwise(F.col("text"))
        rows = docs.select(F.col("doc_id").cast("string").alias("path"), F.sha2(text, 256).alias("content_hash"), F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp").alias("mtime"))
        rows.write.mode("append").parquet(f"{folder}/versions")
        watch.wait(stateful.decide(stateful.versions(spark, f"{folder}/versions"), f"{folder}/out", f"{folder}/state"))
    return spark.read.schema(stateful.OUTPUT).parquet(f"{folder}/out").groupBy(F.col("path").cast("long").alias("doc_id"), "action").agg(F.count("*").alias("n"))
