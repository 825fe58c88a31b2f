import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.functions import columns as C
from quire.functions import parser, render
from quire.operators import nodes
from quire.plans import catalogue
from quire.plans import corpus as B
from quire.sources import files

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_agrees_with_sql(spark, small, duck, name):
    frame = catalogue.QUERIES[name](spark, small)
    names = sorted(frame.columns)
    got = sorted(repr([norm(r[c]) for c in names]) for r in frame.collect())
    found = duck.execute(catalogue.ORACLE[name])
    at = [[d[0] for d in found.description].index(c) for c in names]
    assert got == sorted(repr([norm(r[k]) for k in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_gives_rows(spark, small, name):
    assert catalogue.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_node_table_is_well_formed(spark, small):
    table = nodes.nodes(B.nation_lists(spark, small)).cache()
    assert table.where("subtree_end <= node_id or parent_id >= node_id").count() == 0
    dense = table.groupBy("doc_id").agg(F.max("node_id").alias("m"), F.count("*").alias("n"), F.countDistinct("node_id").alias("d"))
    assert dense.where("m + 1 <> n or n <> d").count() == 0
    again = nodes.nodes(B.nation_lists(spark, small).repartition(3))
    assert table.exceptAll(again).count() == 0 and again.exceptAll(table).count() == 0


def test_fast_paths_agree_with_the_parser(spark, small):
    docs = B.part_notes(spark, small)
    for command, kind, field in (("footnote", "Footnote", "text"), ("caption", "Caption", "text"), ("label", "Label", "text"), ("includegraphics", "Image", "path")):
        fast = docs.select("doc_id", F.explode(C.flat_command(F.col("tex"), command)).alias("v"))
        exact = nodes.nodes(docs).where(F.col("kind") == kind).select("doc_id", F.col(field).alias("v"))
        assert fast.exceptAll(exact).count() == 0 and exact.exceptAll(fast).count() == 0


def test_null_empty_and_broken_sources(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "\\begin{"), (4, "a")], "doc_id long, tex string")
    assert {r.doc_id for r in nodes.nodes(docs).collect()} == {4}
    assert nodes.findings(docs).where("doc_id < 3").count() == 0 and nodes.nodes(docs.limit(0)).count() == 0
    assert nodes.html(docs).count() == 4


def test_layout_limit(spark):
    docs = spark.createDataFrame([(1, "\\section{a}" * 6)], "doc_id long, tex string")
    assert [r.element for r in nodes.layout(docs, most=5).collect()] == ["error"] and nodes.layout(docs, most=6).count() == 6


def test_files_that_read_themselves(spark):
    docs = spark.createDataFrame([("r", "\\input{a}")], "path string, tex string")
    other = spark.createDataFrame([("a.tex", "x\\input{a.tex}"), ("b", "")], "path string, tex string")
    assert files.resolve_inputs(docs, other).first().tex == "x"
    assert [tuple(r) for r in files.unresolved_inputs(docs, other).collect()] == [("a.tex", "a.tex", "loop")]
    assert files.resolve_inputs(docs.limit(0), other).count() == 0


def test_files_on_disk(spark, tmp_path):
    (tmp_path / "a.tex").write_text("\\section{é}")
    (tmp_path / "b.tex").write_bytes(b"\xff\xfe")
    docs, errors = files.read_bytes(spark, f"file://{tmp_path}/*.tex")
    assert docs.count() == 1 and errors.first().kind == "parse_error"
    assert files.read_text(spark, f"file://{tmp_path}/a.tex").first().tex == "\\section{é}"


def test_filters_reach_the_scan(spark, small):
    plan = catalogue.QUERIES["brace_balance"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "url" not in plan.split("ReadSchema")[1]


def test_sinks(spark, small, tmp_path):
    from quire.sources import sinks

    docs = B.nation_tables(spark, small)
    sinks.write_outputs(docs, f"file://{tmp_path}/out", ("html", "txt"))
    sinks.write_intermediates(docs, f"file://{tmp_path}/between")
    assert spark.read.parquet(f"file://{tmp_path}/out").where("format = 'txt'").count() == docs.count()
    assert spark.read.json(f"file://{tmp_path}/between/meta").count() == docs.count()
    with pytest.raises(ValueError):
        sinks.outputs(docs, ("pdf",))


def test_single_sources(tmp_path):
    from quire import __main__, api

    assert b"<strong>b</strong>" in api.convert_string("\\textbf{b}") and api.format_name("HTM") == "html"
    assert api.convert_string("\\section{a}", api.Options("word"))[:2] == b"PK"
    with pytest.raises(api.UnsupportedFormat):
        api.convert_string("a", api.Options("pdf"))
    (tmp_path / "a.tex").write_text("\\def\\x{1}\\x")
    assert __main__.main([str(tmp_path / "a.tex"), "--format", "html,txt", "--output", str(tmp_path), "--keep-intermediate"]) == 0
    assert (tmp_path / "a.txt").read_text() == "1" and (tmp_path / "a.expanded.tex").read_text() == "1"
    assert __main__.main([str(tmp_path / "none.tex"), "--output", str(tmp_path)]) == 1


def test_whole_documents_agree_with_brute_force(spark, small, tmp_path):
    """Queries over all documents and whole texts, with some that simple SQL can't follow."""
    read = spark.read.parquet(f"{small}/documents.parquet")
    more = ["a--b $x--y$ ``c'' $", "$$a--b$$ --- {x} % y\nz", "p\n\nq ~ $u$\n\n\nr \\alpha", "é\nü--", "", "--$--$--$--"]
    extra = spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(more)], "doc_id long, text string")
    read.unionByName(extra, allowMissingColumns=True).write.parquet(f"file://{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"file://{tmp_path}/documents.parquet").collect()}
    run = lambda name: catalogue.QUERIES[name](spark, f"file://{tmp_path}").collect()
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()

    def ligatures(text):  # one character at a time, as the reference has it
        out, k = "", 0
        while k < len(text):
            if text[k] == "$" and (end := text.find("$", k + 1)) > 0:
                out, k = out + text[k : end + 1], end + 1
                continue
            old, new = next(((o, n) for o, n in (("---", "—"), ("--", "–"), ("``", "“"), ("''", "”")) if text.startswith(o, k)), (text[k], text[k]))
            out, k = out + new, k + len(old)
        return out

    assert {r.doc_id: r.digest for r in run("ligatures_all")} == {i: md5(ligatures(t)) for i, t in texts.items()}
    places = {(i, at) for i, t in texts.items() for at in {*range(0, len(t) + 1, 100), len(t)}}
    expected = {(i, at, texts[i][:at].count("\n"), len(texts[i][:at].split("\n")[-1]), len(texts[i][:at].encode())) for i, at in places}
    got = run("offset_to_linecol_all")
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)

    def walk(made):
        for node in made:
            yield node
            for *_, children in node.parts:
                yield from walk(children)

    spans, runs, paragraphs = Counter(), Counter(), {}
    for i, t in texts.items():
        for node in walk(parser.parse(t)):
            found = re.findall(r"\$([^$]*)\$", node.text) if node.kind == "Text" else [node.text] if node.kind == "MathInline" else []
            spans.update((i, f) for f in found)
        paragraphs[i] = len([p for p in render.plain(parser.parse(t)).split("\n\n") if re.search(r"[^ \t\n\r]", p)])
    assert {(r.doc_id, r.formula): r.n for r in run("math_spans_all")} == spans
    assert {r.doc_id: r.paragraphs for r in run("docx_paragraphs_all")} == paragraphs
    escaped = catalogue.QUERIES["text_runs_all"](spark, f"file://{tmp_path}")
    for r in escaped.select("doc_id").distinct().collect():
        runs[r.doc_id] += 1
    assert set(runs) == {i for i, t in texts.items() if t.strip()}


def test_inputs_at_any_depth(spark):
    files_ = [("a.tex", "A\\input b ;"), ("b.tex", "B\\include{sub/c};"), ("lib/sub/c.tex", "C\\input{d.txt}"), ("d.txt", "D"), ("root/a.tex", "local"), ("x.tex", "X\\input{y}!"), ("y.tex", "Y\\input x ?"), ("self.tex", "S\\input{self}s")]
    files_ += [(f"deep{k}.tex", f"{k}\\input{{deep{k + 1}}}") for k in range(11)] + [("deep11.tex", "end")]
    table = spark.createDataFrame(files_, "path string, tex string")
    docs = spark.createDataFrame(
        [("r1", "", "<\\input{a}>", 1), ("r2", "root", "<\\input { a }\\input  a\n>", 2), ("r3", None, "\\input{x} \\input self", 3), ("r4", "", "\\input{deep0}", 4), ("r5", "", "plain \\includegraphics{a} \\input{}", 5), ("r6", "", "\\input{nowhere}\\input a%\\input ab", 6)],
        "path string, base_dir string, tex string, k int",
    )
    made = {r.path: r for r in files.resolve_inputs(docs, table, ("lib",)).collect()}
    assert made["r1"].tex == "<AB\\clearpage CD\\clearpage ; ;>"
    assert made["r2"].tex == "<locallocal\n>"
    assert made["r3"].tex == "XY ?! Ss"
    assert made["r4"].tex == "".join(map(str, range(11))) + "end"
    assert made["r5"].tex == "plain \\includegraphics{a} \\input{}" and made["r5"].k == 5
    assert made["r6"].tex == "AB\\clearpage CD\\clearpage ; ;%"
    lost = {tuple(r) for r in files.unresolved_inputs(docs, table, ("lib",)).collect()}
    assert lost == {("r6", "nowhere", "missing"), ("r6", "ab", "missing"), ("x.tex", "y", "loop"), ("y.tex", "x", "loop"), ("self.tex", "self", "loop")}
    assert files.resolve_inputs(docs.limit(0), table).count() == 0 and files.resolve_inputs(docs, table.limit(0)).where("k <> 5 and tex like '%input%'").count() == 0


def test_a_watch_builds_what_a_change_reaches(spark, tmp_path):
    from quire.streaming import watch

    raw, told = tmp_path / "raw", []
    (raw / "sub").mkdir(parents=True)
    put = lambda name, text: (raw / name).write_text(text)
    put("a.tex", "A \\input{sub/b}")
    put("sub/b.tex", "B \\input c ")
    put("c.tex", "\\section{C}")  # read from the document's folder
    put("lone.tex", "L")
    put("loop.tex", "\\input{loop}")
    (raw / "notes.txt").write_text("no source")
    build = watch.rebuilder(spark, f"file://{raw}", str(tmp_path / "built"), report=lambda *x: told.append(x))
    run = lambda: watch.wait(watch.watch(watch.ticks(spark), build, str(tmp_path / "state")))
    run()
    run()  # nothing has changed
    put("c.tex", "\\section{C}\\section{D}")
    (raw / "sub" / "bad.tex").write_bytes(b"\xff\xfe")
    run()
    rows = spark.read.parquet(str(tmp_path / "built" / "out")).collect()
    got = {(r.batch, r.path.rsplit("/raw/", 1)[1]): r.elements for r in rows}
    assert got[0, "a.tex"] == 3 and got[0, "lone.tex"] == 1 and {k for k in got if k[0] == 0} == {(0, "a.tex"), (0, "lone.tex")}
    assert got[2, "a.tex"] == 4 and {k for k in got if k[0]} == {(2, "a.tex"), (2, "sub/bad.tex")}
    assert told == [*watch.STAGES, watch.STAGES[0], watch.STAGES[3], *watch.STAGES]


def test_a_watch_sees_old_late_and_lost_files(spark, tmp_path):
    import os

    from quire.streaming import watch

    raw = tmp_path / "raw"
    raw.mkdir()
    built = []

    def put(name, text, day=None):
        (raw / name).write_text(text)
        if day:
            os.utime(raw / name, (day * 86400, day * 86400))

    def make(docs):
        built.append({r.path.rsplit("/", 1)[1]: r.tex for r in docs.collect()})
        return watch.element_counts(docs)

    build = watch.rebuilder(spark, f"file://{raw}", str(tmp_path / "built"), make)
    run = lambda: watch.wait(watch.watch(watch.ticks(spark), build, str(tmp_path / "state")))
    put("a.tex", "A\\input{b}\\input{late}")
    put("b.tex", "B")
    put("lone.tex", "L")
    run()
    assert built[-1] == {"a.tex": "AB", "lone.tex": "L"}
    put("late.tex", "[late]", day=1)  # older than all that were seen; a document asked for it before it came
    put("old.tex", "O", day=2)
    run()
    assert built[-1] == {"a.tex": "AB[late]", "old.tex": "O"}
    put("b.tex", "B", day=3)  # another time, the same content
    n = len(built)
    run()
    assert len(built) == n
    put("b.tex", "C", day=4)
    run()
    assert built[-1] == {"a.tex": "AC[late]"}
    (raw / "late.tex").unlink()
    (raw / "old.tex").unlink()
    run()
    assert built[-1] == {"a.tex": "AC"}
    assert {r.path.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "built" / "gone")).collect()} == {"late.tex", "old.tex"}
    put("late.tex", "again", day=1)
    put("a.tex", "now alone")
    run()
    assert built[-1] == {"a.tex": "now alone", "b.tex": "C", "late.tex": "again"}  # nothing reads the latter two any longer
    sources = spark.read.parquet(str(tmp_path / "built" / "sources"))
    assert sources.groupBy("batch").count().orderBy("batch").select("count").collect()[1:] == [(2,), (1,), (2,)]  # only what changed is written


def test_scratch_folders_go_with_their_scope(spark):
    import os

    from quire.operators import shared

    with shared.scratch():
        path = shared.scratch_folder(spark)
        shared.cut(spark.range(3))
        spark.range(1).write.parquet(path)
    assert not os.path.exists(path.removeprefix("file:"))


def test_plugins_change_the_tree(spark):
    from quire.functions.plugins import Plugin, PluginError

    class Quiet(Plugin):
        def on_load(self):
            loaded.append(1)

        def transform(self, made):
            return [n for n in made if n.kind != "Footnote"]

    class Broken(Plugin):
        def on_load(self):
            raise PluginError("broken", "needs a table")

    loaded = []
    docs = spark.createDataFrame([(1, "a\\footnote{b}c")], "doc_id long, tex string")
    assert [r.kind for r in nodes.nodes(docs, plugins=(Quiet(),)).collect()] == ["Text", "Text"] and loaded == [1]
    with pytest.raises(PluginError) as e:
        nodes.nodes(docs, plugins=(Broken(),))
    assert e.value.plugin == "broken"


def test_kinds_and_columns(spark):
    docs = B.part_notes(spark, "/root/testdata/sf0.001").limit(20)
    whole = nodes.nodes(docs)
    some = nodes.nodes(docs, kinds=("Text", "Theorem"), columns=("node_id", "subtree_end", "kind", "text"))
    assert sorted(some.collect()) == sorted(whole.where("kind in ('Text', 'Theorem')").select(*some.columns).collect())
    one = nodes.texts_within(whole, "Theorem").withColumnRenamed("outer_id", "node_id")
    assert sorted(one.collect()) == sorted(nodes.texts_of(docs, "Theorem").select("doc_id", "node_id", "text").collect())

    lists = B.nation_lists(spark, "/root/testdata/sf0.001")
    kids = nodes.children_of(nodes.nodes(lists), "DescriptionList").select("doc_id", "node_id", F.col("parent_args")[F.col("slot_idx")].alias("term"), F.col("text").alias("body"))
    assert sorted(kids.collect()) == sorted(nodes.described(lists).collect())
