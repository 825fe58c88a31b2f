import zipfile
from io import BytesIO

import pytest

from quire.functions import analysis, dims, macros, mathfmt, mathml, parser, render, tables
from quire.functions.lexer import environment_end, group_end, line_and_column, split_top
from quire.functions.plugins import CustomFormat


@pytest.mark.parametrize(
    "tex, expected",
    [
        (r"\frac{a+b}{c-d}", "[a+b] ÷ [c-d]"), (r"\frac{1}{2}", "½"), (r"\sqrt{b^2-4ac}", "√(b²-4ac)"), (r"\sqrt[3]{8}", "∛8"), (r"\sqrt[5]{32}", "⁵√32"),
        (r"x_{i+1}=\alpha", "xᵢ₊₁=α"), (r"x^\infty", "x^∞"), (r"\dbinom{2n}{n}", "C(2n, n)"), (r"{a \over b}", "[a] ÷ [b]"), (r"x^{q}", "x^q"), (r"x^{Ab}", "x^(Ab)"),
        (r"\mathbb{R}", "ℝ"), (r"\mathcal{B}", "ℬ"), (r"\mathfrak{C}", "ℭ"), (r"\mathbf{x1}", "𝐱𝟏"), (r"\mathit{h}", "ℎ"), (r"\hat{x}", "x̂"), (r"\vec{ab}", "a⃗b⃗"),
        (r"\left. x \right)", " x )"), (r"\boxed{\alpha}", "α"), (r"\phantom{xx}y", "y"), (r"\overset{a}{b}", "a b"), (r"a\\b & c", "a b   c"), (r"\unknown{x}", r"\unknown{x}"),
        (r"\begin{pmatrix}a \begin{bmatrix}x\end{bmatrix} b\end{pmatrix}", "(a [x] b)"), (r"{n \choose k}", "C(n, k)"), (r"\text{if }x", "if x"), (r"\nleq \nsubseteq", "≰ ⊈"),
    ],
)
def test_math_as_unicode(tex, expected):
    assert mathfmt.to_unicode(tex) == expected


@pytest.mark.parametrize(
    "tex, expected",
    [
        (r"\frac{1}{2}", "<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>"),
        ("x_i^2", "<math><msubsup><mi>x</mi><mi>i</mi><mn>2</mn></msubsup></math>"),
        (r"\sqrt[3]{x}", "<math><mroot><mi>x</mi><mn>3</mn></mroot></math>"),
        (r"a<b\quad\text{a & b}", '<math><mi>a</mi><mo>&lt;</mo><mi>b</mi><mspace width="1em" /><mtext>a &amp; b</mtext></math>'),
        (r"\begin{bmatrix}1&2\\3&4\end{bmatrix}", "<math><mrow><mo>[</mo><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd><mtd><mn>4</mn></mtd></mtr></mtable><mo>]</mo></mrow></math>"),
        (r"\sin\alpha\leq\nothing", '<math><mi mathvariant="normal">sin</mi><mi>α</mi><mo>≤</mo><mtext>\\nothing</mtext></math>'),
        ("{", "<math><mrow></mrow></math>"), ("}a", "<math><mi>a</mi></math>"), ("", "<math></math>"),
    ],
)
def test_mathml(tex, expected):
    assert mathml.inline(tex) == expected


def test_symbols():
    assert len(dims.SYMBOLS) > 600 and all(isinstance(v, str) for v in dims.SYMBOLS.values())
    for name, char in {"omega": "ω", "Lambda": "Λ", "varphi": "φ", "hookleftarrow": "↩", "nLeftrightarrow": "⇎", "BbbN": "ℕ", "limsup": "lim sup", "quad": "  ", "left": ""}.items():
        assert dims.SYMBOLS[name] == char


def test_tables():
    assert tables.column_spec("l*{2}{c}r") == ["left", "center", "center", "right"]
    assert tables.column_spec(r">{\raggedright}p{3cm}") == ["left"] and tables.column_spec("*{2}{|c*{2}{r}}") == ["center", "right", "right"] * 2
    assert tables.cells_of(r"\multicolumn{2}{c}{Header}") == ["Header", ""]
    rows = tables.parse_rows("\\toprule\nA & B \\\\\n\\midrule\n1 & \\$2 \\\\ 3 & x \\& y\\\\\n\\bottomrule\nplain\n\\caption{c}")
    assert rows == [([], True), (["A", "B"], False), ([], True), (["1", "$2"], False), (["3", "x & y"], False), ([], True)]


def test_macros():
    assert macros.expand(r"\newcommand{\R}[1]{<#1>}\R{a}") == "<a>"
    assert macros.expand(r"\def\x#1#2{#2#1}\x{1}{2}") == "21"
    assert macros.expand(r"\let\a\textbf\a{b}") == r"\textbf{b}"
    assert macros.expand(r"\newcommand\z{1}\renewcommand{\z}{2}\providecommand{\z}{3}\z") == "2"
    assert macros.expand(r"\newcommand{\l}{\l x}\l").count("x") == 10
    assert macros.expand(r"\newcommand\q[1][d]{x}") == r"\newcommand\q[1][d]{x}"
    assert macros.expand("plain") == "plain"


def kinds(tex, **options):
    return [n.kind for n in parser.parse(tex, **options)]


def one(tex):
    made = parser.parse(tex)
    assert len(made) == 1, [n.kind for n in made]
    return made[0]


def test_text():
    assert one("x---y, pages 10--20 ``q'' $a -- b$").text == "x—y, pages 10–20 “q” $a -- b$"
    assert one(r"a {b} c~d \% \&").text == "a b c d % &"
    assert one(r"\'e\"{u}\c{c}\^{\i}\ss{} \LaTeX").text == "éüçîß LaTeX"
    assert one("100% sure").text == "100% sure" and kinds("% note\ntext") == ["Text"]
    assert kinds("a\n\nb") == ["Text", "Paragraph", "Text"] and kinds("  ") == ["Text"] and kinds("\n") == []
    assert one("costs $5 only").text == "costs $5 only"


def test_commands():
    assert one(r"\section*[s]{A\texorpdfstring{~x}{ y}}").text == "A x"
    assert (one(r"\cite[p.~3]{a, b ,}").keys, one(r"\citeauthor*{a}").name) == (["a", "b"], "citeauthor*")
    assert (one(r"\Cref{k}").name, one(r"\pageref{k}").kind) == ("Cref", "PageRef")
    assert one(r"\SIrange{1}{2}{m}").args == ["1", "2", "m"] and one(r"\href{u}{t}").args == ["u", "t"]
    assert kinds(r"\partial") == []
    assert kinds(r"\parindent \emptyset \smallcaps") == ["Text"]
    assert one(r"\verb|a{b|").text == "a{b" and kinds(r"\\[2pt]\\*") == ["LineBreak"] * 2
    assert one(r"\newacronym{k}{S}{Long}\acrfull{k}").text == "Long (S)"
    image = one(r"\includegraphics[width=3cm, height = 2]{f.png}")
    assert (image.path, image.width, image.height) == ("f.png", "3cm", "2")
    assert kinds(r"$x$") == ["MathInline"] and kinds(r"\[x\]") == ["MathDisplay"] and kinds("$$x$$") == ["MathDisplay"]
    cases = one(r"$f = \begin{cases}1 & a\\2 & b\end{cases} .$")
    assert cases.lines == ["f = 1 & a", "2 & b ."]


def test_environments():
    nested = one(r"\begin{itemize}\item A \begin{itemize}\item B\end{itemize}\item[x] C\end{itemize}")
    assert nested.args == [None, "x"] and [c.kind for c in nested.parts[0][2]] == ["Text", "ItemList"]
    assert one(r"\begin{theorem}[T]x\end{theorem}").label == "T"
    assert one("\\begin{align*}a&=b\\\\c&=d\\end{align*}").lines == ["a&=b", "c&=d"] and one(r"\begin{gather}x\end{gather}").kind == "MathDisplay"
    assert one("\\begin{equation*}x\\end{equation*}").text == "x"
    assert kinds("\\begin{table}\\centering\\begin{tabular}{l}a & b\\end{tabular}\\caption{C}\\label{t}\\end{table}") == ["Table", "Caption", "Label"]
    assert one("\\begin{center}a\\begin{center}b\\end{center}c\\end{center}").parts[0][2][-1].text == "c"
    assert one("\\begin{thebibliography}{9}\\bibitem[x]{k} A\n B\\bibitem{l} C\\end{thebibliography}").bib == [("k", "A B"), ("l", "C")]
    assert one("\\begin{verbatim} \\x{ \\end{verbatim}").text == "\\x{" and kinds("\\begin{comment}x\\end{comment}\\begin{odd}y\\end{odd}") == []


def test_document():
    made = parser.parse("\\title{A {b}}\\author{C}\\begin{document}\\maketitle x\\end{document}y")
    assert [n.kind for n in made] == ["Command"] * 3 + ["Text"] and made[0].args == ["A {b}"]
    rows = parser.flatten(parser.parse("\\begin{itemize}\\item a\\item \\begin{quote}b\\end{quote}\\end{itemize}c"))
    assert [r[0] for r in rows] == list(range(len(rows))) and [r[2] for r in rows] == [4, 2, 4, 4, 5]


def test_plugins():
    made = parser.parse(r"\custombold{x}\other{y}", plugins=(CustomFormat(),))
    assert (made[0].name, made[1].text) == ("textbf", "y")
    inner = parser.parse(r"\begin{quote}\custombold{x}\end{quote}", plugins=(CustomFormat(),))
    assert inner[0].parts[0][2][0].name == "textbf"


def test_html():
    page = lambda t: render.html(parser.parse(t))
    assert page(r"\textbf{a<b} it's") == "<strong>a&lt;b</strong> it&#39;s"
    assert page(r"\section{A}\subsection{B}\chapter{C}") == "<h2>A</h2>\n<h3>B</h3>\n<h1>C</h1>\n"
    assert page(r"\parencite{a,b}\nocite{c}\supercite{d}") == "(a, b)<sup>d</sup>"
    assert page(r"\begin{enumerate}\item x\end{enumerate}") == "<ol>\n<li>x</li>\n</ol>\n"
    assert page("\\begin{description}\\item[t] b\\end{description}") == "<dl>\n<dt>t</dt>\n<dd>b</dd>\n</dl>\n"
    assert "<title>T</title>" in render.page(parser.parse(r"\title{T}\begin{document}x\end{document}")) and "<title>Document</title>" in render.page([])


def test_plain_layout_and_packages():
    made = parser.parse("\\title{T}\\begin{document}\\section{S}a \\textbf{b} $x^2$\n\n\\begin{itemize}\\item i\\end{itemize}\\ref{k}\\end{document}")
    assert render.plain(made) == "TS\na b $x^2$\n\n• i\nk"
    elements = [(e["element"], e["text"]) for e in render.layout(made)]
    assert elements == [("heading", "T"), ("empty_line", ""), ("heading", "S"), ("rich_paragraph", "a b x²"), ("empty_line", ""), ("unordered_item", "i"), ("rich_paragraph", "?? (k)")]
    assert zipfile.ZipFile(BytesIO(render.docx(made))).testzip() is None and render.docx(made) == render.docx(made)
    book = zipfile.ZipFile(BytesIO(render.epub(made)))
    assert book.infolist()[0].filename == "mimetype" and book.infolist()[0].compress_type == zipfile.ZIP_STORED


@pytest.mark.parametrize(
    "tex, codes",
    [
        (r"\section{Intro", ["unclosed-brace"]), ("}", ["unmatched-brace"]), (r"\begin{itemize}\end{enumerate}", ["env-mismatch", "missing-documentclass"]),
        ("The value is $x = 1", ["unclosed-math"]), (r"\end{document}", ["env-unmatched-end", "orphan-end-document"]), ("% { $\n", []),
        (r"\documentclass{a}\begin{document}", ["env-unclosed", "missing-end-document"]), (r"\documentclass{a}\begin{a}\end{a}\begin{b}\end{b}", []),
    ],
)
def test_findings(tex, codes):
    assert [f["code"] for f in analysis.findings(tex)] == codes


def test_compatible_environment_check():
    assert [f["code"] for f in analysis.environments(r"\begin{a}\end{a}\begin{b}\end{b}", compat=True)] == ["env-unclosed"]


def test_outline_completion_hover():
    tree = analysis.outline("\\chapter{C}\\section{Introduction}\\subsection{Background}\\section{é}\\label{k}")
    assert [(s["name"], s["parent_id"]) for s in tree] == [("C", -1), ("Introduction", 0), ("Background", 1), ("é", 0), ("#k", -1)]
    assert {c[0] for c in analysis.completions("\\sec", 4)} == {"section"} and {c[0] for c in analysis.completions("\\begin{ta", 9)} == {"tabular", "table"}
    assert analysis.hover("é \\section{", 12) == "`\\section` — Section heading" and analysis.hover("\\nope", 5) is None and analysis.hover("x", 1) is None


def test_scanning():
    assert group_end("{a\\}{b}}c", 0) == 8 and group_end("{a", 0) == -1 and line_and_column("abc\ndef", 4) == (1, 0)
    assert environment_end("x\\begin{a}y\\end{a}z\\end{a}w", "a", 0) == (19, 26) and split_top("a\\\\{b\\\\c}", "\\\\") == ["a", "{b\\\\c}"]


HARD = [
    "\\documentclass{a}\\title{T}\\begin{document}\\section{A}\\begin{itemize}\\item[x] a\\begin{tabular}{l|p{2cm}}a&b\\\\\\hline\\end{tabular}\\end{itemize}$a_{b}^c$\\[\\frac{1}{2}\\]\\end{document}",
    "\\section{Data Table}\n\n\\begin{tabular}{lcc}\n\\hline\nItem & Price & Size \\\\\n\\hline\nPear & \\$2 & 3\\\\\n\\end{tabular}\n\n\\begin{description}\\item[Term] Meaning \\emph{of it}\\end{description}\\begin{thebibliography}{9}\\bibitem{k} Text\\end{thebibliography}",
    "\\newcommand{\\x}[2]{#1 \\y{#2}}\\x{a}{\\begin{cases}1\\\\2\\end{cases}}\\verb|x|\\cite[a]{b}\\href{u}{t}\\footnotetext{f}\\'{\\i}\\begin{figure*}\\includegraphics{x}\\end{figure*}",
]


@pytest.mark.parametrize("tex", HARD)
def test_every_prefix_can_be_read(tex):
    for k in range(0, len(tex) + 1, 1 if len(tex) < 400 else 11):
        made = parser.parse(tex[:k])
        parser.flatten(made)
        render.page(made), render.plain(made), render.layout(made), render.ast_json(made)
        analysis.findings(tex[:k]), analysis.outline(tex[:k]), mathfmt.to_unicode(tex[:k]), mathml.display(tex[:k])


def test_files_within_files(tmp_path, monkeypatch):
    from quire import api

    monkeypatch.setattr(api, "CHUNK", 8)
    (tmp_path / "lib").mkdir()
    (tmp_path / "main.tex").write_text("\\section{M}\\input{a}\\input lone \\include{b}\\input{none}\\input{main}")
    (tmp_path / "a.tex").write_text("A\\input a ")
    (tmp_path / "lib" / "lone.tex").write_text("L")
    (tmp_path / "b.tex").write_text("B")
    told = []
    options = api.Options("txt", search_paths=(str(tmp_path / "lib"),))
    assert api.convert_file(str(tmp_path / "main.tex"), options, lambda *x: told.append(x)).decode() == "M\nA L  B "
    assert told[0] == ("reading", 0) and [t for t in told if t[0] != "reading"] == [("parsing", 30), ("building", 60), ("done", 100)]
    assert len(told) > 6 and max(p for s, p in told if s == "reading") == 30
    (tmp_path / "bad.tex").write_bytes(b"a\xff")
    with pytest.raises(api.ParseError):
        api.convert_file(str(tmp_path / "bad.tex"))
    assert api.convert_string("x\\input{a}", api.Options("txt")).decode() == "x"
