"""TeX source to a tree of typed nodes.

Commands are found by their whole name in tables that say what they take and
what they become. Unknown commands are dropped, and their arguments read as
text. Nothing raises: what is unclosed runs to the end of its surroundings.

A document is one text that is read in windows; readers of windows within
windows wait on a list, so neither the depth of nesting nor what is left
unclosed matters to the work, which grows with the text.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from collections.abc import Callable, Generator, Iterable, Iterator

from quire.functions import dims, macros, tables
from quire.functions.lexer import Source, environment_end, read_group, read_option, split_top

BEGIN, END = "\\begin{document}", "\\end{document}"
LEVELS = {"part": 0, "chapter": 6, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}

#: Commands that become a command node with so many arguments (fixed values).
ARGUMENTS = dict.fromkeys("maketitle newpage clearpage pagebreak raggedright raggedleft noindent today normalcolor appendix centering".split(), 0)
ARGUMENTS |= dict.fromkeys("hfill vfill hrulefill dotfill fill medskip bigskip smallskip strut mathstrut qquad quad".split(), 0)
ARGUMENTS |= dict.fromkeys("tiny scriptsize footnotesize small normalsize large Large LARGE huge Huge".split(), 0)
ARGUMENTS |= dict.fromkeys("indent newline linebreak nolinebreak nopagebreak samepage onecolumn twocolumn em bf it rm sf tt sc sl printbibliography".split(), 0)
ARGUMENTS |= dict.fromkeys("texttt textbf textit emph text ensuremath overline sout textsc textrm textsf textsl textup textmd textcircled hl st uline uuline uwave dotuline color".split(), 1)
ARGUMENTS |= dict.fromkeys("phantom vphantom hphantom smash textsuperscript textsubscript fbox url nolinkurl vspace hspace underline textnormal enquote tag intertext shortintertext".split(), 1)
ARGUMENTS |= dict.fromkeys("bibliography bibliographystyle addbibresource index glossary reflectbox mbox makebox footnotetext cline rowcolor cellcolor si unit num title author date enlargethispage".split(), 1)
ARGUMENTS |= dict.fromkeys("href raisebox rotatebox scalebox colorbox rule SI".split(), 2)
ARGUMENTS |= dict.fromkeys("resizebox fcolorbox multicolumn multirow SIrange".split(), 3)
#: Commands of other names that become the same node.
SAME = {"flushleft": "raggedright", "flushright": "raggedleft", "nolinkurl": "url"}
#: One-character commands that become spacing.
SPACING = {",": "comma", ";": "semicolon", ":": "colon", "!": "bang", " ": "control_space", "\n": "control_space"}
CITES = set("cite nocite textcite parencite footcite citeauthor citeyear citetitle fullcite autocite notecite supercite fnotecite volcite smartcite citep citet".split())
REFS = set("ref eqref autoref nameref cref Cref footref".split())
#: Commands that are passed over with their arguments (fixed values).
SKIPPED = set(
    "setlength addtolength newlength setcounter newcounter stepcounter refstepcounter addtocounter ignorespaces ignorespacesafterend protect typeout obeylines "
    "obeyspaces baselinestretch linespread selectfont resetfontparameters normalfont rmfamily sffamily ttfamily bfseries mdseries upshape itshape slshape scshape "
    "sloppy fussy raggedbottom flushbottom columnsep columnwidth textwidth linewidth pagewidth paperwidth paperheight textheight unitlength tabcolsep arraycolsep "
    "arrayrulewidth doublerulesep arraystretch pagestyle thispagestyle pagenumbering definecolor DeclareMathOperator numberwithin counterwithin counterwithout "
    "renewcommand providecommand newcommand DeclareRobustCommand hypersetup urlstyle babelhyphenation frenchspacing nonfrenchspacing thicklines thinlines "
    "baselineskip topskip bottomskip parindent parskip headheight headsep footskip topmargin bottommargin leftmargin rightmargin oddsidemargin evensidemargin "
    "marginparwidth marginparsep marginparpush floatsep intextsep textfloatsep abovecaptionskip belowcaptionskip let edef xdef global mathversion "
    "restoremathversion sloppypar endsloppypar nonumber notag qedhere theoremstyle swapnumbers qedsymbol theoremheaderfont theorembodyfont newtheorem "
    "newtheoremstyle settowidth settodepth settoheight sbox savebox usebox adjustbox span hide captionof subfloat subcaption subcaptionbox stretch "
    "widowpenalty clubpenalty interlinepenalty hyphenpenalty exhyphenpenalty brokenpenalty floatingpenalty hyphenation tolerance pretolerance "
    "emergencystretch hbadness vbadness sisetup marginpar reversemarginpar normalmarginpar floatplacement floatbarrier FloatBarrier todo newacronym "
    "newglossaryentry documentclass usepackage RequirePackage value arabic roman Roman alph Alph input include".split()
)
THEOREMS = set("theorem lemma proof definition corollary proposition remark example".split())
LINES = {"align": "align", "gather": "gather", "multline": "multline", "cases": "cases"}
LINES |= dict.fromkeys("eqnarray split aligned alignat flalign".split(), "align") | {"gathered": "gather"}
CONTAINERS = {"center": "Center", "quote": "Quote", "quotation": "Quote", "abstract": "Abstract", "flushleft": "FlushLeft", "flushright": "FlushRight", "minipage": "Center"}
CONTAINERS |= dict.fromkeys("figure subfigure subfig wrapfigure multicols tabbing algorithm algorithmic".split(), "Center")
VERBATIM = {"verbatim", "lstlisting", "alltt", "comment"}
_RUN = re.compile(r"(?:[^\\{}$\n]|\n(?!\n))+")
_LIGATURES = (("---", "—"), ("--", "–"), ("``", "“"), ("''", "”"))
_TEXORPDF = re.compile(r"\\texorpdfstring(?![A-Za-z])")


class Node:
    """A node of the tree; `parts` are (slot, index in the slot, children). What a node doesn't set is None."""

    FIELDS = ("name", "level", "text", "args", "keys", "ordered", "label", "path", "width", "height", "lines", "columns", "rows", "bib")
    name = level = text = args = keys = ordered = label = path = width = height = lines = columns = rows = bib = None

    def __init__(self, kind: str, **fields):
        self.__dict__ = fields
        self.kind, self.parts = kind, []


def ligatures(text: str) -> str:
    """Dashes and double quotes, outside of `$...$`."""
    pieces = re.split(r"(\$[^$]*\$)", text)
    for k in range(0, len(pieces), 2):
        for old, new in _LIGATURES:
            pieces[k] = pieces[k].replace(old, new)
    return "".join(pieces)


def compose(accent: str, base: str) -> str:
    """A letter under an accent: one character if Unicode has it. Dotless letters take their accent as dotted ones do."""
    made = unicodedata.normalize("NFC", {"ı": "i", "ȷ": "j"}.get(base, base) + dims.TEXT_ACCENTS[accent])
    return made if len(made) == 1 else base + dims.TEXT_ACCENTS[accent]


def clean_title(text: str) -> str:
    out, at = [], 0
    while m := _TEXORPDF.search(text, at):
        first = read_group(text, m.end())
        second = read_group(text, first[1]) if first else None
        if not second:
            break
        out += [text[at : m.start()], first[0]]
        at = second[1]
    return "".join([*out, text[at:]]).replace("~", " ")


def acronyms(text: str) -> dict[str, tuple[str, str]]:
    """Short and long forms by key, of acronyms and glossary entries."""
    out = {}
    for m in re.finditer(r"\\(newacronym|newglossaryentry)(?![A-Za-z])", text):
        k, fields = m.end(), []
        while got := read_option(text, k):
            k = got[1]
        while len(fields) < (3 if m[1] == "newacronym" else 2) and (got := read_group(text, k)):
            fields.append(got[0])
            k = got[1]
        if m[1] == "newacronym" and len(fields) == 3:
            out[fields[0]] = fields[1], fields[2]
        elif m[1] == "newglossaryentry" and len(fields) == 2:
            for part in fields[1].split(","):
                name, _, value = part.strip().partition("=")
                if name == "name" and value.strip():
                    out[fields[0]] = (value.strip().strip("{}"),) * 2
                    break
    return out


class Parser:
    """Reads one source. `plugins` are asked about unknown commands and environments, in order."""

    def __init__(self, source: str, plugins: Iterable = (), known: dict | None = None):
        self.source, self.plugins, self.at = source, tuple(plugins), 0
        self.marks, self.end = Source(source), len(source)
        self.known = acronyms(source) if known is None else known
        self.unknown: list[str] = []
        self.floats = 0  # that are open around this place

    def document(self) -> list[Node]:
        """Title, author and date of the preamble, then the body."""
        begin = self.source.find(BEGIN)
        out, start = [], 0
        if begin >= 0:
            for name in ("title", "author", "date"):
                at = self.source.find(f"\\{name}{{", 0, begin)
                if at >= 0 and (got := self.marks.group(at + len(name) + 1, self.end)):
                    out.append(Node("Command", name=name, args=[self.source[got[0] : got[1]]]))
            start = begin + len(BEGIN)
        return out + self.read(start, self.end)

    def read(self, start: int, end: int) -> list[Node]:
        """The nodes of a window. A reader that needs those of a window within it asks for them by `yield`."""
        readers, made = [self.window(start, end)], None
        while readers:
            try:
                asked = readers[-1].send(made)
            except StopIteration as e:
                readers.pop()
                made = e.value
            else:
                readers.append(asked if isinstance(asked, Generator) else self.window(*asked))
                made = None
        return made

    def window(self, start: int, end: int) -> Generator:
        out: list[Node] = []
        texts: list[str] = []  # of the last node, while it is text
        after: list[tuple[int, int]] = []  # of the groups around this place: where they and their surroundings end
        self.at, self.end = start, end
        while True:
            if self.at >= self.end:
                if not after:
                    break
                self.at, self.end = after.pop()
                continue
            if self.source[self.at] == "{":
                stop = self.marks.group_end(self.at, self.end)
                self.at += 1
                if stop >= 0:
                    after.append((stop, self.end))
                    self.end = stop - 1
                continue
            made = self.step()
            if isinstance(made, Generator):
                back = self.at, self.end
                made = yield made
                self.at, self.end = back
            for node in made:
                if node.kind != "Text":
                    _whole(out, texts)
                elif texts:
                    texts.append(node.text)
                    continue
                else:
                    texts.append(node.text)
                out.append(node)
        _whole(out, texts)
        return [n for n in out if n.kind != "Text" or n.text]

    def step(self) -> list[Node] | Generator:
        s, at = self.source, self.at
        c = s[at]
        if c == "%":
            stop = s.find("\n", at, self.end)
            self.at = self.end if stop < 0 else stop + 1
            return []
        if c == "}":
            self.at += 1
            return []
        if c == "$":
            return self.dollars()
        if c == "\\":
            if s.startswith(END, at, self.end):
                self.at = self.end
                return []
            return self.command()
        if s.startswith("\n\n", at, self.end):
            self.at += 2
            return [Node("Paragraph")]
        return self.run()

    def run(self) -> list[Node]:
        """Text up to a command, brace or blank line; a formula inside stays part of it."""
        s, out = self.source, []
        while self.at < self.end:
            if m := _RUN.match(s, self.at, self.end):
                out.append(m[0].replace("~", " "))
                self.at = m.end()
            elif s[self.at] == "$" and not s.startswith("$$", self.at, self.end):
                stop = self.marks.dollar(self.at, self.end)
                if stop < 0:
                    out.append("$")
                    self.at += 1
                else:
                    out.append(s[self.at : stop + 1])
                    self.at = stop + 1
            else:
                break
        text = "".join(out)
        if not text.strip():
            return [Node("Text", text=" ")] if " " in text else []
        return [Node("Text", text=ligatures(text))]

    def dollars(self) -> list[Node]:
        s = self.source
        if s.startswith("$$", self.at, self.end):
            stop = s.find("$$", self.at + 2, self.end)
            if stop >= 0:
                body, self.at = s[self.at + 2 : stop], stop + 2
                return self.formula(body, True)
        elif (stop := self.marks.dollar(self.at, self.end)) >= 0:
            body, self.at = s[self.at + 1 : stop], stop + 1
            return self.formula(body, False)
        self.at += 1
        return [Node("Text", text="$")]

    def formula(self, body: str, shown: bool) -> list[Node]:
        begin = body.find("\\begin{cases}")
        if begin >= 0:
            stop, after = environment_end(body, "cases", begin + 13)
            lines = [x.strip() for x in split_top(body[begin + 13 : stop], "\\\\") if x.strip()]
            if lines:
                lines[0] = body[:begin].strip() + (" " if body[:begin].strip() else "") + lines[0]
                lines[-1] += body[after:].rstrip()
                return [Node("MathLines", name="cases", lines=lines)]
        return [Node("MathDisplay" if shown else "MathInline", text=body.strip())]

    # commands

    def option(self) -> str | None:
        return self._taken(self.marks.option(self.at, self.end))

    def group(self) -> str | None:
        return self._taken(self.marks.group(self.at, self.end))

    def _taken(self, got: tuple[int, int, int] | None) -> str | None:
        if got is None:
            return None
        self.at = got[2]
        return self.source[got[0] : got[1]]

    def arguments(self, count: int) -> list[str]:
        return [self.group() or "" for _ in range(count)]

    def command(self) -> list[Node] | Generator:
        s, start = self.source, self.at
        name, self.at = self.marks.name(start, self.end)
        word = name[:1].isalpha()
        star = word and s.startswith("*", self.at, self.end)
        if star:
            self.at += 1
        handler = getattr(self, f"do_{name}", None) if word else None
        if handler:
            return handler(star)
        if name in LEVELS:
            self.option()
            title = self.group()
            return [] if title is None else [Node("Section", level=LEVELS[name], text=clean_title(title), name=name)]
        if name in CITES:
            return self.cite(name + "*" * star)
        if name in REFS:
            key = self.group()
            return [] if key is None else [Node("Ref", text=key, name=name)]
        if name == "\\":
            if s.startswith("*", self.at, self.end):
                self.at += 1
            if s.startswith("[", self.at, self.end):
                self.option()
            return [Node("LineBreak")]
        if name in "([" and name:
            stop = s.find("\\)" if name == "(" else "\\]", self.at, self.end)
            body, self.at = (s[self.at : self.end], self.end) if stop < 0 else (s[self.at : stop], stop + 2)
            return self.formula(body, name == "[")
        if name in dims.TEXT_ACCENTS:
            return self.accent(name)
        if name in dims.TEXT_SYMBOLS and not star:
            if word:
                self.at = self.marks.blank(self.at, self.end) if not s.startswith("{}", self.at, self.end) else self.at + 2
            return [Node("Text", text=dims.TEXT_SYMBOLS[name])]
        if name in SPACING:
            return [Node("Command", name=SPACING[name], args=[])]
        if name in SAME or name in ARGUMENTS:
            return self.plain(SAME.get(name, name), ARGUMENTS[SAME.get(name, name)], star)
        if name in SKIPPED or name.startswith("the") and len(name) > 3:  # \\thepage and its like
            self.skip()
            return []
        return self.other(name, start)

    def plain(self, name: str, count: int, star: bool) -> list[Node]:
        if name in ("makebox", "parbox", "printbibliography", "raisebox", "rotatebox", "SI", "si", "num", "unit", "SIrange", "index", "intertext", "enlargethispage"):
            while self.option() is not None:
                pass
        if name in ("colorbox", "fcolorbox", "color", "linebreak", "nolinebreak", "nopagebreak", "pagebreak"):
            self.option()
        if count == 0:
            if self.source.startswith("{}", self.at, self.end):
                self.at += 2
            return [Node("Command", name=name, args=[])]
        full = name + "*" if star and name in ("vspace", "hspace", "tag") else name
        return [Node("Command", name=full, args=self.arguments(count))]

    def skip(self) -> None:
        while self.group() is not None or self.option() is not None:
            pass

    def other(self, name: str, start: int) -> list[Node]:
        """A plugin's node, or nothing: the name is dropped and what follows is read on."""
        back, args = self.at, []
        if self.plugins:
            while (got := self.group()) is not None:
                args.append(got)
            for plugin in self.plugins:
                made = plugin.command(name, args)
                if made is not None:
                    return [made]
            self.at = back
        self.unknown.append(name)
        return []

    def accent(self, name: str) -> list[Node]:
        s, end = self.source, self.end
        if (got := self.marks.group(self.at, end)) and (s[self.at : self.at + 1] == "{" or name.isalpha()):
            inner = self._taken(got)
        else:
            if name.isalpha():
                self.at = self.marks.blank(self.at, end)
            if s.startswith(("\\i", "\\j"), self.at, end) and not s[self.at + 2 : min(self.at + 3, end)].isalpha():
                inner, self.at = s[self.at : self.at + 2], self.at + 2
            elif s[self.at : min(self.at + 1, end)].isalpha():
                inner, self.at = s[self.at], self.at + 1
            else:
                return []
        inner = re.sub(r"^\\([ij])\s*", lambda m: {"i": "ı", "j": "ȷ"}[m[1]], inner.strip())
        return [Node("Text", text=compose(name, inner[0]) + inner[1:])] if inner else []

    def cite(self, kind: str) -> list[Node]:
        self.option()
        self.option()
        keys = self.group()
        return [] if keys is None else [Node("Citation", keys=[k for k in (x.strip() for x in keys.split(",")) if k], name=kind)]

    def do_textcolor(self, _) -> list[Node]:
        self.option()
        color, text = self.arguments(2)
        return [Node("ColoredText", name=color, text=text)]

    def do_includegraphics(self, _) -> list[Node]:
        options = {k.strip(): v.strip() for k, _, v in (p.partition("=") for p in (self.option() or "").split(","))}
        path = self.group()
        return [] if path is None else [Node("Image", path=path.strip(), width=options.get("width"), height=options.get("height"))]

    def do_label(self, _) -> list[Node]:
        key = self.group()
        return [] if key is None else [Node("Label", text=key)]

    def do_pageref(self, _) -> list[Node]:
        key = self.group()
        return [] if key is None else [Node("PageRef", text=key, name="pageref")]

    def do_footnote(self, _) -> list[Node]:
        self.option()
        text = self.group()
        return [] if text is None else [Node("Footnote", text=text)]

    def do_thanks(self, _) -> list[Node]:
        return self.do_footnote(_)

    def do_footnotemark(self, _) -> list[Node]:
        mark = self.option()
        return [Node("Command", name="footnotemark", args=[] if mark is None else [mark])]

    def do_caption(self, star) -> list[Node]:
        self.option()
        text = self.group()
        if text is None:
            return []
        return [Node("Command", name="caption*", args=[text]) if star else Node("Caption", text=text)]

    def do_parbox(self, _) -> list[Node]:
        while self.option() is not None:
            pass
        return [Node("Command", name="parbox", args=self.arguments(2)[1:])]

    def do_par(self, _) -> list[Node]:
        return [Node("Paragraph")]

    def do_and(self, _) -> list[Node]:
        return [Node("Text", text=", ")]

    def do_tableofcontents(self, _) -> list[Node]:
        return [Node("TableOfContents")]

    def do_listoffigures(self, _) -> list[Node]:
        return [Node("ListOfFigures")]

    def do_listoftables(self, _) -> list[Node]:
        return [Node("ListOfTables")]

    def do_MakeUppercase(self, _) -> list[Node]:
        return [Node("Text", text=(self.group() or "").upper())]

    def do_MakeLowercase(self, _) -> list[Node]:
        return [Node("Text", text=(self.group() or "").lower())]

    def do_verb(self, _) -> list[Node]:
        mark = self.source[self.at : min(self.at + 1, self.end)]
        stop = self.source.find(mark, self.at + 1, self.end) if mark else -1
        if stop < 0:
            return []
        body, self.at = self.source[self.at + 1 : stop], stop + 1
        return [Node("CodeBlock", text=body, name="verb")]

    def do_lstinline(self, _) -> list[Node]:
        self.option()
        if self.source.startswith("{", self.at, self.end):
            return [Node("CodeBlock", text=self.group(), name="lstinline")]
        return self.do_verb(_)

    def glossary(self, shape: Callable[[str, str], str]) -> list[Node]:
        key = self.group()
        if key is None:
            return []
        short, long = self.known.get(key, (key, key))
        return [Node("Text", text=shape(short, long))]

    def do_gls(self, _) -> list[Node]:
        return self.glossary(lambda short, _: short)

    def do_glspl(self, _) -> list[Node]:
        return self.glossary(lambda short, _: short + "s")

    def do_Gls(self, _) -> list[Node]:
        return self.glossary(lambda short, _: short[:1].upper() + short[1:])

    def do_GLS(self, _) -> list[Node]:
        return self.glossary(lambda short, _: short.upper())

    def do_acrshort(self, _) -> list[Node]:
        return self.glossary(lambda short, _: short)

    def do_acrlong(self, _) -> list[Node]:
        return self.glossary(lambda _, long: long)

    def do_acrfull(self, _) -> list[Node]:
        return self.glossary(lambda short, long: f"{long} ({short})")

    # environments

    def do_end(self, _) -> list[Node]:
        self.group()
        return []

    def do_begin(self, _) -> list[Node] | Generator:
        name = (self.group() or "").strip()
        start, end = self.at, self.end
        if name in VERBATIM:
            stop = self.source.find(f"\\end{{{name}}}", start, end)
            stop, after = (end, end) if stop < 0 else (stop, stop + len(name) + 6)
        else:
            stop, after = self.marks.environment_end(name, start, end)
        self.at = max(after, start)
        plain = name.rstrip("*")
        if name == "comment":
            return []
        if plain in ("itemize", "enumerate", "description"):
            return self.item_list(plain, start, stop)
        if plain in THEOREMS:
            return self.theorem(plain, start, stop)
        if plain in ("table", "wraptable"):
            if self.floats:  # read in place, as the float around it takes what it holds
                self.at = self._past(start, end, 2 if plain == "wraptable" else 0)
                return []
            return self.floating(plain, start, stop)
        if plain in CONTAINERS:
            return self.container(plain, start, stop)
        if name == "document":
            self.at = start
            return []
        body = self.source[start:stop]
        if plain in VERBATIM:
            got = read_option(body, 0) if plain == "lstlisting" and body[:1] == "[" else None
            return [Node("CodeBlock", text=(body[got[1] :] if got else body).strip(), name=plain)]
        if plain in ("equation", "displaymath"):
            return self.formula(body, True)
        if plain == "math":
            return self.formula(body, False)
        if plain in LINES:
            if plain == "alignat" and (got := read_group(body, 0)):
                body = body[got[1] :]
            lines = [x.strip() for x in split_top(body, "\\\\") if x.strip()]
            if len(lines) == 1 and plain != "cases":
                return [Node("MathDisplay", text=lines[0])]
            return [Node("MathLines", name=LINES[plain], lines=lines)] if lines else []
        if plain in ("tabular", "longtable", "tabularx", "array"):
            return self.tabular(name, body)
        if plain == "thebibliography":
            return self.bibliography(start, stop)
        for plugin in self.plugins:
            made = plugin.environment(name, body)
            if made is not None:
                return [made]
        self.unknown.append(f"begin:{name}")
        return []

    def _past(self, start: int, stop: int, groups: int) -> int:
        """Past an option, and as many groups."""
        if got := self.marks.option(start, stop):
            start = got[2]
        for _ in range(groups):
            if got := self.marks.group(start, stop):
                start = got[2]
        return start

    def theorem(self, name: str, start: int, stop: int) -> Generator:
        got = self.marks.option(start, stop)
        node = Node("Theorem", name=name, label=self.source[got[0] : got[1]] if got else None)
        node.parts.append(("body", 0, (yield got[2] if got else start, stop)))
        return [node]

    def container(self, name: str, start: int, stop: int) -> Generator:
        start = self._past(start, stop, {"minipage": 1, "multicols": 1, "subfigure": 1, "subfig": 1, "wrapfigure": 2}.get(name, 0))
        node = Node(CONTAINERS[name], name=name)
        node.parts.append(("body", 0, (yield start, stop)))
        return [node]

    def item_list(self, name: str, start: int, stop: int) -> Generator:
        node = Node("DescriptionList" if name == "description" else "ItemList", ordered=name == "enumerate" if name != "description" else None, name=name)
        node.args = []
        for k, (at, end) in enumerate(self.marks.items("\\item", start, stop)):
            got = self.marks.option(at, end)
            node.args.append(self.source[got[0] : got[1]].strip() if got else None)
            at = got[2] if got else at
            while at < end and self.source[at].isspace():
                at += 1
            while at < end and self.source[end - 1].isspace():
                end -= 1
            node.parts.append(("desc" if name == "description" else "item", k, (yield at, end)))
        return [node]

    def tabular(self, name: str, body: str) -> list[Node]:
        at = 0
        if name in ("tabular*", "tabularx") and (got := read_group(body, at)):
            at = got[1]
        if got := read_option(body, at):
            at = got[1]
        spec = read_group(body, at)
        spec, at = spec if spec else ("", at)
        return [Node("Table", name=name, columns=tables.column_spec(spec), rows=tables.parse_rows(body[at:]))]

    def floating(self, name: str, start: int, stop: int) -> Generator:
        """The tables of a float, with its captions and labels beside them."""
        self.floats += 1
        made = yield self._past(start, stop, 2 if name == "wraptable" else 0), stop
        self.floats -= 1
        return [n for n in descendants(made) if n.kind in ("Table", "Caption", "Label", "Footnote")]

    def bibliography(self, start: int, stop: int) -> list[Node]:
        got = self.marks.group(start, stop)
        entries = []
        for at, end in self.marks.items("\\bibitem", got[2] if got else start, stop):
            if option := self.marks.option(at, end):
                at = option[2]
            if key := self.marks.group(at, end):
                entries.append((self.source[key[0] : key[1]].strip(), " ".join(self.source[key[2] : end].split())))
        return [Node("Bibliography", bib=entries)]


def _whole(out: list[Node], texts: list[str]) -> None:
    """Gives the last node its text, if texts are waiting."""
    if texts:
        out[-1].text = texts[0] if len(texts) == 1 else "".join(texts)
        texts.clear()


def descendants(nodes: list[Node]) -> Iterator[Node]:
    """All nodes in pre-order."""
    open_ = [iter(nodes)]
    while open_:
        node = next(open_[-1], None)
        if node is None:
            open_.pop()
            continue
        yield node
        if node.parts:
            open_.append(n for *_, children in node.parts for n in children)


def parse(source: str, plugins: Iterable = ()) -> list[Node]:
    """Macros expanded, then the document's nodes."""
    return Parser(macros.expand(source), plugins).document()


#: Columns of the node table besides the document's key.
COLUMNS = (
    "node_id", "parent_id", "subtree_end", "depth", "slot", "slot_idx", "ordinal", "kind", "name", "level", "text", "args", "keys", "ordered", "label",
    "path", "width", "height", "lines", "columns", "rows", "bib", "starts",
)


_FIELDS = operator.attrgetter(*COLUMNS[7:-1])


def flatten(nodes: list[Node], kinds: frozenset[str] | None = None) -> list[tuple]:
    """Rows in pre-order; a node's descendants are those with ids up to its `subtree_end`, and the k-th of its parts begins at the k-th of its `starts`.

    With `kinds`, rows of those kinds alone.
    """
    out: list[tuple] = []
    count = 0

    def within(node: Node, starts: list[int]) -> Iterator[tuple[str, int, int, Node]]:
        for slot, index, children in node.parts:
            starts.append(count)
            for i, child in enumerate(children):
                yield slot, index, i, child

    # Of each node around this place: its children left, its id, its depth, and its row, which is made when its last child is.
    open_: list[tuple] = [((("root", 0, i, n) for i, n in enumerate(nodes)), -1, -1, None, ())]
    while open_:
        children, parent, depth, place, row = open_[-1]
        found = next(children, None)
        if found is None:
            open_.pop()
            if place is not None:
                node, above, *first, starts = row
                out[place] = (parent, above, count, *first, *_FIELDS(node), starts)
            continue
        slot, index, ordinal, node = found
        k, place = count, None
        count += 1
        if kinds is None or node.kind in kinds:
            place = len(out)
            out.append((k, parent, count, depth + 1, slot, index, ordinal, *_FIELDS(node), None) if not node.parts else ())
        if node.parts:
            starts: list[int] = []
            open_.append((within(node, starts), k, depth + 1, place, (node, parent, depth + 1, slot, index, ordinal, starts)))
    return out
