"""Small sources with what they read as: `@` stands for a name that comes from a table."""

from __future__ import annotations

from quire.functions import dims

#: Inline commands as HTML (fixed values).
HTML_COMMANDS = {
    r"\textbf{@}": "<strong>@</strong>", r"\textit{@}": "<em>@</em>", r"\emph{@}": "<em>@</em>", r"\textsl{@}": "<em>@</em>", r"\texttt{@}": "<code>@</code>",
    r"\underline{@}": "<u>@</u>", r"\sout{@}": "<s>@</s>", r"\textsc{@}": '<span style="font-variant:small-caps">@</span>', r"\textrm{@}": '<span style="font-family:serif">@</span>',
    r"\textnormal{@}": '<span style="font-family:serif">@</span>', r"\textsf{@}": '<span style="font-family:sans-serif">@</span>', r"\textup{@}": "@", r"\textmd{@}": "@",
    r"\text{@}": "@", r"\ensuremath{@}": "@", r"\mbox{@}": "@", r"\makebox[2cm]{@}": "@", r"\parbox{2cm}{@}": "@", r"\enquote{@}": "&ldquo;@&rdquo;",
    r"\overline{@}": '<span style="text-decoration:overline">@</span>', r"x\textsuperscript{@}": "x<sup>@</sup>", r"x\textsubscript{@}": "x<sub>@</sub>",
    r"\fbox{@}": '<span style="border:1px solid #ccc;padding:0.2em">@</span>', r"\multicolumn{2}{c}{@}": "@", r"\footnotetext{@}": '<sup class="footnote">@</sup>',
    r"\footnote{@}": '<sup class="footnote">@</sup>', r"a\hspace{1cm}@": "a @", r"a\vspace*{1cm}@": "a @", r"a\quad @": "a  @", r"a\qquad @": "a  @", r"a\,@": "a" + "\u2009" + "@", r"a\;@": "a" + "\u2009" + "@",
    r"a\:@": "a" + "\u2009" + "@", r"a\!@": "a@", r"\SI{5}{@}": "5 @", r"\SIrange{1}{2}{@}": "1–2 @", r"\si{@}": "@", r"\unit{@}": "@", r"\num{@}": "@", r"\footnotemark[3]@": "@",
    r"\cline{1-2}@": "@", r"\rule{1cm}{2pt}@": "@", r"\phantom{x}@": "@", r"\vphantom{x}@": "@", r"\hphantom{x}@": "@", r"\raisebox{1pt}{@}": "@", r"\rotatebox{90}{@}": "@",
    r"\scalebox{2}{@}": "@", r"\colorbox{red}{@}": "@", r"\fcolorbox{red}{blue}{@}": "@", r"\url{@}": '<a href="@">@</a>', r"\href{http://a?b&c}{@}": '<a href="http://a?b&amp;c">@</a>',
    r"@\newline ": "@<br />\n ", r"\hfill @": '<span class="hfill"></span> @', r"\hrulefill{}@": "<hr />\n@", r"\dotfill{}@": '<span class="dotfill">…</span>@', r"\strut{}@": "@",
    r"\textcolor{red}{@}": '<span style="color:red">@</span>', r"\label{@}": '<span id="@"></span>', r"\ref{@}": "@", r"\pageref{@}": "page @", r"\uline{@}": "@",
}
#: Blocks as HTML (fixed values).
HTML_ELEMENTS = {
    r"\part{@}": "<h1>@</h1>\n", r"\chapter*{@}": "<h1>@</h1>\n", r"\section{@}": "<h2>@</h2>\n", r"\subsection{@}": "<h3>@</h3>\n", r"\subsubsection{@}": "<h4>@</h4>\n", r"\paragraph{@}": "<h5>@</h5>\n", r"\subparagraph{@}": "<h6>@</h6>\n",
    "a\n\n@": "a<p></p>\n@", r"\begin{center}@\end{center}": '<div class="center">@</div>' + "\n", r"\begin{quote}@\end{quote}": "<blockquote>@</blockquote>\n", r"\begin{quotation}@\end{quotation}": "<blockquote>@</blockquote>\n",
    r"\begin{abstract}@\end{abstract}": '<section class="abstract"><h2>Abstract</h2>@</section>' + "\n", r"\begin{flushleft}@\end{flushleft}": '<div style="text-align:left">@</div>' + "\n", r"\begin{flushright}@\end{flushright}": '<div style="text-align:right">@</div>' + "\n",
    r"\begin{minipage}{2cm}@\end{minipage}": '<div class="center">@</div>' + "\n", r"\tableofcontents @": '<nav class="toc"><em>Table of Contents</em></nav>' + "\n @", r"\listoffigures": '<section class="lof"><em>List of Figures</em></section>' + "\n",
    r"\listoftables": '<section class="lot"><em>List of Tables</em></section>' + "\n", r"a\\@": "a<br />\n@", r"\begin{itemize}\item @\item[x] b\end{itemize}": "<ul>\n<li>@</li>\n" + '<li><span class="label">x</span> b</li>' + "\n</ul>\n",
    r"\begin{enumerate}\item @\end{enumerate}": "<ol>\n<li>@</li>\n</ol>\n", r"\begin{description}\item[@] b\end{description}": "<dl>\n<dt>@</dt>\n<dd>b</dd>\n</dl>\n",
    r"\begin{proof}[@]x\end{proof}": '<section class="theorem"><h3 class="theorem-heading">Proof (@)</h3>x</section>' + "\n", r"\begin{verbatim}@<\end{verbatim}": "<pre><code>@&lt;</code></pre>\n",
    r"\begin{lstlisting}[language=C]@\end{lstlisting}": "<pre><code>@</code></pre>\n", r"\verb|@{|": "<pre><code>@{</code></pre>\n", r"\includegraphics[height=2cm]{@}": '<img src="@" alt="@" height="2cm" />' + "\n",
    r"\begin{figure}\caption{@}\end{figure}": '<div class="center"><figcaption>@</figcaption>' + "\n</div>\n",
    r"\begin{thebibliography}{9}\bibitem{k} @\end{thebibliography}": '<section class="bibliography"><h2>References</h2><ol>' + "\n" + '<li id="bib-k"><span class="label">[1]</span> @</li>' + "\n</ol></section>\n",
    r"\cite{@,b}": "[@, b]", r"\citetitle{@}": "@", r"\fullcite{@}": "@", r"\notecite{@}": "@", r"\fnotecite{@}": '<sup class="footnote">@</sup>', r"\volcite{@}": "@", r"\smartcite{@}": "(@)", r"\cite*{@}": "[@]", r"\citeyear*{@}": "@", r"\autocite*{@}": "(@)", r"\textcite{@}": "[@]",
}
#: Constructs and the nodes that they become, as `render.shape` writes them (fixed values).
NODES = {
    r"\newpage @": "Command:newpage Text= @", r"\clearpage{}": "Command:clearpage", r"\pagebreak[2]": "Command:pagebreak", r"\raggedright": "Command:raggedright", r"\flushright": "Command:raggedleft", r"\noindent @": "Command:noindent Text= @",
    r"\normalcolor": "Command:normalcolor", r"\appendix": "Command:appendix", r"\Huge": "Command:Huge", r"\footnotesize": "Command:footnotesize", r"\twocolumn": "Command:twocolumn", r"\em @": "Command:em Text= @", r"\bf": "Command:bf",
    r"\bibliography{@}": "Command:bibliography=@", r"\bibliographystyle{plain}": "Command:bibliographystyle=plain", r"\addbibresource{@.bib}": "Command:addbibresource=@.bib", r"\printbibliography[title=@]": "Command:printbibliography",
    r"\glossary{@}": "Command:glossary=@", r"\thanks{@}": "Footnote=@", r"\MakeUppercase{a@}": "Text=A@", r"a\and @": "Text=a,  @", r"\tag{@}": "Command:tag=@", r"\tag*{@}": "Command:tag*=@", r"\intertext{@}": "Command:intertext=@",
    r"\shortintertext{@}": "Command:shortintertext=@", r"\multirow{2}{*}{@}": "Command:multirow=2|*|@", r"\rowcolor{@}": "Command:rowcolor=@", r"\cellcolor{red}@": "Command:cellcolor=red Text=@", r"\caption*{@}": "Command:caption*=@", r"\caption[s]{@}": "Caption=@",
    r"\resizebox{1}{2}{@}": "Command:resizebox=1|2|@", r"\reflectbox{@}": "Command:reflectbox=@", r"\vspace*{@}": "Command:vspace*=@", r"a\ b": "Text=a Command:control_space Text=b", r"\bigskip": "Command:bigskip",
    r"\setlength{\x}{1pt}@": "Text=@", r"\pagestyle{plain}@": "Text=@", r"\definecolor{a}{b}{c}@": "Text=@", r"\arabic{page}@": "Text=@", r"\thepage @": "Text= @", r"\marginpar{x}@": "Text=@", r"\todo[inline]{x}@": "Text=@",
    r"\newacronym{k}{s}{l}@": "Text=@", r"{a {@} b}": "Text=a @ b", r"\autoref{@}": "Ref:autoref=@", r"\nameref{@}": "Ref:nameref=@", r"\cref{@}": "Ref:cref=@", r"\Cref{@}": "Ref:Cref=@", r"\footref{@}": "Ref:footref=@", r"\pageref{@}": "PageRef:pageref=@",
    r"\section{A\texorpdfstring{~@}{ y}}": "Section:section[1]=A @", r"\title{@}": "Command:title=@", r"\verb*+@+": "CodeBlock:verb=@", r"\lstinline[x]{@}": "CodeBlock:lstinline=@", r"\lstinline!@!": "CodeBlock:verb=@",
    r"\includegraphics[width=3cm,height=2]{@}": "Image[3cm][2]=@", r"\par @": "Paragraph Text= @", r"\textcolor{red}{@}": "ColoredText:red=@", r"\nolinkurl{@}": "Command:url=@",
}
#: Environments and their nodes (fixed values).
ENVIRONMENTS = {
    r"\begin{equation}@\end{equation}": "MathDisplay=@", r"\begin{equation*}@\end{equation*} b": "MathDisplay=@ Text= b", r"\begin{displaymath}@\end{displaymath}": "MathDisplay=@", r"\begin{math}@\end{math}": "MathInline=@",
    r"\[@\]": "MathDisplay=@", r"$$@$$": "MathDisplay=@", r"\(@\)": "MathInline=@", r"$@$": "MathInline=@", r"a $@$ b": "Text=a $@$ b", r"\begin{gather}@\\b\end{gather}": "MathLines:gather=@|b", r"\begin{multline*}@\\b\end{multline*}": "MathLines:multline=@|b",
    r"\begin{eqnarray}@\\b\end{eqnarray}": "MathLines:align=@|b", r"\begin{alignat}{2}@\\b\end{alignat}": "MathLines:align=@|b", r"\begin{flalign}@\end{flalign}": "MathDisplay=@", r"\begin{cases}@\\b\end{cases}": "MathLines:cases=@|b",
    r"\begin{split}@\\b\end{split}": "MathLines:align=@|b", r"\begin{align}\end{align}@": "Text=@", r"\begin{table*}\begin{tabular}{lr}@ & 1\\\end{tabular}\caption{C}\label{t}\end{table*}": "Table:tabular[@&1]=left|right Caption=C Label=t",
    r"\begin{wraptable}{r}{2cm}\begin{tabular}{l}@ & 1\end{tabular}\end{wraptable}": "Table:tabular[@&1]=left", r"\begin{longtable}{c}a & @\end{longtable}": "Table:longtable[a&@]=center", r"\begin{tabularx}{5cm}{Xl}a & @\end{tabularx}": "Table:tabularx[a&@]=left|left",
    "\\begin{tabular}{l}\\hline\na & @ \\\\ \\hline\n\\end{tabular}": "Table:tabular[--][a&@][--]=left", r"\begin{wrapfigure}{r}{2cm}@\end{wrapfigure}": "Center:wrapfigure{Text=@}", r"\begin{subfigure}{2cm}@\end{subfigure}": "Center:subfigure{Text=@}",
    r"\begin{multicols}{2}@\end{multicols}": "Center:multicols{Text=@}", r"\begin{algorithm}[h]@\end{algorithm}": "Center:algorithm{Text=@}", r"\begin{comment}x\end{comment}@": "Text=@", r"\begin{strange}x\end{strange}@": "Text=@", r"\begin{alltt}@\end{alltt}": "CodeBlock:alltt=@",
    r"\begin{remark}@\end{remark}": "Theorem:remark{Text=@}", r"\begin{definition}[@]x\end{definition}": "Theorem:definition[@]{Text=x}", r"\begin{quote}a\begin{quote}@\end{quote}\end{quote}": "Quote:quote{Text=a Quote:quote{Text=@}}",
    r"\begin{enumerate}\item a\begin{itemize}\item @\end{itemize}\end{enumerate}": "ItemList:enumerate{Text=a ItemList:itemize{Text=@}}", r"\begin{document}@\end{document}x": "Text=@", "% note\n@": "Text=@",
}
#: Formulas as Unicode (fixed values); the name stands in none of them but as a name.
MATH = {
    r"{1 \over 2} @": "½ @", r"{n \choose k}": "C(n, k)", r"{a \brack b}": "C(a, b)", r"{a \brace b}": "C(a, b)", r"a \overline{b}": "a b̅", r"\begin{pmatrix}a & b\end{pmatrix}": "(a   b)", r"\begin{bmatrix}a\end{bmatrix}": "[a]", r"\begin{Vmatrix}a\end{Vmatrix}": "‖a‖",
    r"\begin{vmatrix}a\end{vmatrix}": "|a|", r"\begin{matrix}a\end{matrix}": "a", r"\begin{smallmatrix}a\end{smallmatrix}": "a", r"\sqrt{x}": "√x", r"\sqrt{a+b}": "√(a+b)", r"\sqrt[3]{8}": "∛8", r"\sqrt[4]{x}": "∜x", r"\sqrt[5]{32}": "⁵√32", r"\dfrac{3}{4}": "¾", r"\tfrac{7}{9}": "[7] ÷ [9]",
    r"\dbinom{2n}{n}": "C(2n, n)", r"\tbinom{n}{2}": "C(n, 2)", r"\mathbf{A}": "𝐀", r"\mathit{h}": "ℎ", r"\mathsf{x1}": "𝗑𝟣", r"\mathtt{b}": "𝚋", r"\mathfrak{C}": "ℭ", r"\vec{v}": "v⃗", r"\tilde{a}": "a\u0303", r"\ddot{x}": "x\u0308", r"\overline{ab}": "a̅b̅", r"x^{ab}": "xᵃᵇ", r"x^q": "x^q", r"x_{bc}": "x_(bc)", r"x^\infty": "x^∞",
    r"a \, b": "a   b", r"a\!b": "ab", r"\text{as @}": "as @", r"\operatorname{@}": "@", r"\phantom{x}@": "@", r"\left. x \right)": " x )", r"\unknown": r"\unknown", r"\overset{a}{b}": "a b", r"\hbar \nabla \partial": "ℏ ∇ ∂",
}
#: Formulas as MathML (fixed values).
MATHML = {
    r"x_i^2": "<msubsup><mi>x</mi><mi>i</mi><mn>2</mn></msubsup>", r"x^{a+b}": "<msup><mi>x</mi><mi>a</mi><mo>+</mo><mi>b</mi></msup>", r"{x}_1": "<msub><mrow><mi>x</mi></mrow><mn>1</mn></msub>", r"\frac{a}{b}": "<mfrac><mi>a</mi><mi>b</mi></mfrac>",
    r"\binom{n}{k}": '<mrow><mo>(</mo><mfrac linethickness="0"><mi>n</mi><mi>k</mi></mfrac><mo>)</mo></mrow>', r"\sqrt{x}": "<msqrt><mi>x</mi></msqrt>", r"\sqrt[3]{x}": "<mroot><mi>x</mi><mn>3</mn></mroot>", r"\sqrt[n]{x+1}": "<mroot><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow><mn>n</mn></mroot>",
    r"\text{if @}": "<mtext>if @</mtext>", r"\mathbb{R}": "<mi>ℝ</mi>", r"\mathcal{L}": "<mi>ℒ</mi>", r"\hat{x}": '<mover accent="true"><mi>x</mi><mo>^</mo></mover>', r"\overline{x}": '<mover accent="false"><mi>x</mi><mo>¯</mo></mover>', r"\underline{x}": '<munder accent="false"><mi>x</mi><mo>_</mo></munder>',
    r"\overset{a}{b}": "<mover><mrow><mi>b</mi></mrow><mi>a</mi></mover>", r"\underset{a}b": "<munder><mi>b</mi><mi>a</mi></munder>", r"\left( x \right]": "<mo>(</mo><mi>x</mi><mo>]</mo>", r"\left. x \right|": "<mi>x</mi><mo>|</mo>", r"\big(": "<mo>(</mo>",
    r"\begin{pmatrix}a & b\\c & d\end{pmatrix}": "<mrow><mo>(</mo><mtable><mtr><mtd><mi>a</mi></mtd><mtd><mi>b</mi></mtd></mtr><mtr><mtd><mi>c</mi></mtd><mtd><mi>d</mi></mtd></mtr></mtable><mo>)</mo></mrow>", r"\begin{array}{c}a\end{array}": "<mtable><mtr><mtd><mi>a</mi></mtd></mtr></mtable>",
    r"a \quad b": '<mi>a</mi><mspace width="1em" /><mi>b</mi>', r"a\,b": '<mi>a</mi><mspace width="0.167em" /><mi>b</mi>', r"a\!b": "<mi>a</mi><mi>b</mi>", r"\sin x": '<mi mathvariant="normal">sin</mi><mi>x</mi>', r"\operatorname{@}": '<mi mathvariant="normal">@</mi>', r"\cdots": "<mo>⋯</mo>",
    r"a \bmod n": "<mi>a</mi><mo>mod</mo><mi>n</mi>", r"\pmod{p}": '<mrow><mo>(</mo><mi>mod</mi><mspace width="0.167em" /><mi>p</mi><mo>)</mo></mrow>', r"\pod{p}": "<mrow><mo>(</mo><mi>p</mi><mo>)</mo></mrow>", r"\boxed{x}": '<menclose notation="box"><mi>x</mi></menclose>',
    r"\substack{a\\b}": "<mtable><mtr><mtd><mi>a</mi></mtd></mtr><mtr><mtd><mi>b</mi></mtd></mtr></mtable>", r"\boldsymbol{x1}": '<mi mathvariant="bold">x</mi><mn mathvariant="bold">1</mn>', r"\alpha \leq \infty": "<mi>α</mi><mo>≤</mo><mo>∞</mo>", r"\unknown": r"<mtext>\unknown</mtext>", r"a < b": "<mi>a</mi><mo>&lt;</mo><mi>b</mi>",
}
#: Sources of whole pages with their plain text (fixed values).
PLAIN = {
    "a\n\n@": "a\n\n@", r"\section{@}b": "@\nb", r"\begin{itemize}\item @\item b\end{itemize}": "• @\n• b\n", r"\begin{description}\item[@] b\end{description}": "@: b\n", r"\begin{tabular}{ll}a & @\end{tabular}": "a\t@\n", r"\begin{theorem}[T]@\end{theorem}": "THEOREM (T): @\n",
    r"\begin{thebibliography}{9}\bibitem{k} @\end{thebibliography}": "@\n", r"\[x^2\]": "x²", r"a\quad @": "a  @", r"\cite{@}": "[@]", r"\supercite{@}": "^@", r"\includegraphics{@}": "@\n", r"\begin{verbatim}@\end{verbatim}": "@\n", r"a\\@": "a\n@",
}
#: Sources and the elements of their pages, as `render.layout_shape` writes them (fixed values).
LAYOUT = {
    r"\section{@}a \textbf{b} c": "heading[1]=@; rich_paragraph=a b c", r"\chapter{@}": "heading[6]=@", "a\n\n@": "rich_paragraph=a; empty_line; rich_paragraph=@", r"\[@\]": "math=@", r"$x^2$@": "rich_paragraph=x² @",
    r"\begin{itemize}\item @\item[x] b\begin{enumerate}\item c\end{enumerate}\end{itemize}": "unordered_item[0]=@; unordered_item[0]=x b; ordered_item[1][1]=c", r"\begin{description}\item[@] b\end{description}": "definition=@=b",
    r"\begin{align}a&=@\\b&=2\end{align}": "math=a =@\nb =2", r"\begin{tabular}{lr}a & @\end{tabular}": "table[2]=a\t@", r"\begin{verbatim}@\end{verbatim}": "code=@", r"\includegraphics{@}": "image=@", r"a\footnote{@}": "rich_paragraph=a; footnote=@",
    r"\cite{@} \ref{@} \pageref{@}": "rich_paragraph=[@] ?? (@) ?? (@)", r"\label{k}@": "rich_paragraph=@", r"\begin{quote}@\end{quote}": "block_quote=@", r"\begin{theorem}[T]@\end{theorem}": "heading[4]=Theorem (T); rich_paragraph=@",
    r"\begin{thebibliography}{9}\bibitem{k} @\end{thebibliography}": "citation=k=@; bibliography", r"\tableofcontents": "toc", r"\listoffigures": "heading[2]=List of Figures", r"\begin{abstract}@\end{abstract}": "heading[3]=Abstract; block_quote=@",
    r"\title{@}\author{A}\date{\today}x": "heading[1]=@; paragraph=A; paragraph=May 1, 2024; empty_line; rich_paragraph=x", r"a\hrulefill": "rich_paragraph=a; rule", r"\enquote{@}": "rich_paragraph=“@”", r"\SI{5}{@}": "rich_paragraph=5 @",
    r"x\textsuperscript{@}": "rich_paragraph=x ^@", r"\textcolor{red}{@}": "rich_paragraph=@", r"\newpage{}\centering @": "rich_paragraph= @", r"\begin{flushright}@\end{flushright}": "rich_paragraph=@",
}
LETTERS = "aeiouycnszAEIOUYCNSZ"
TABLES = {"html_commands": HTML_COMMANDS, "html_elements": HTML_ELEMENTS, "node_forms": NODES, "environment_forms": ENVIRONMENTS, "math_forms": MATH, "mathml_forms": MATHML, "plain_forms": PLAIN, "layout_forms": LAYOUT}
#: Symbols that read as themselves in a formula of their own.
SYMBOLS = {name: symbol for name, symbol in dims.SYMBOLS.items() if symbol.strip() and name.isalpha()}
