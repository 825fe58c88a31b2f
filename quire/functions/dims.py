"""Dimension tables: symbols, accents, formats, completions. Large ones are built from Unicode names."""

from __future__ import annotations

import unicodedata as U

#: Letters that Unicode calls otherwise.
_GREEK = {"lambda": "LAMDA"}
_SMALL = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau upsilon phi chi psi omega".split()
_CAPITAL = "Gamma Delta Epsilon Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega".split()
_WAYS = {"left": "LEFTWARDS", "right": "RIGHTWARDS", "up": "UPWARDS", "down": "DOWNWARDS", "leftright": "LEFT RIGHT", "updown": "UP DOWN"}

#: Names that stand for themselves (fixed values).
WORDS = (
    "sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh coth log ln lg exp lim min max sup inf det dim deg arg gcd hom ker Pr "
    "arcsec arccsc arccot arcsinh arccosh arctanh dx dy dt"
).split()
#: Names without a visible form (fixed values).
SILENT = (
    "left right big Big bigg Bigg bigl bigr Bigl Bigr biggl biggr Biggl Biggr mathscr mathnormal thinspace medspace thickspace negthinspace "
    "negmedspace negthickspace enspace emsp enskip hspace vspace kern mskip mkern phantom hphantom vphantom smash displaystyle textstyle "
    "scriptstyle scriptscriptstyle overbrace underbrace overset underset stackrel frac dfrac tfrac cfrac genfrac binom tbinom dbinom matrix "
    "pmatrix bmatrix Bmatrix vmatrix Vmatrix smallmatrix limits nolimits displaylimits mathclap mathllap mathrlap boxed substack cr"
).split()
#: Relations without a rule below (fixed values).
_RELATIONS = {
    "in": "∈", "leq": "≤", "geq": "≥", "ll": "≪", "gg": "≫", "prec": "≺", "succ": "≻", "preceq": "≼", "succeq": "≽", "equiv": "≡", "sim": "∼",
    "simeq": "≃", "cong": "≅", "approx": "≈", "notin": "∉", "neq": "≠", "perp": "⊥", "parallel": "∥", "mid": "|", "models": "⊨", "propto": "∝",
    "pitchfork": "⋔", "therefore": "∴", "because": "∵", "triangleq": "≜", "circeq": "≗", "risingdotseq": "≓", "fallingdotseq": "≒", "eqcirc": "≖",
    "doteqdot": "≑", "eqqsim": "⩳", "eqsim": "≂", "leqq": "≦", "geqq": "≧", "leqslant": "⩽", "geqslant": "⩾", "eqslantless": "⪕", "eqslantgtr": "⪖",
    "lesssim": "≲", "gtrsim": "≳", "lessapprox": "⪅", "gtrapprox": "⪆", "approxeq": "≊", "lessgtr": "≶", "gtrless": "≷", "lesseqqgtr": "⪋",
    "gtreqqless": "⪌", "doteq": "≐", "precsim": "≾", "succsim": "≿", "precnsim": "⋨", "succnsim": "⋩", "precnapprox": "⪹", "succnapprox": "⪺",
    "lneq": "⪇", "gneq": "⪈", "lneqq": "≨", "gneqq": "≩", "lll": "⋘", "ggg": "⋙", "lesseqgtr": "⋚", "gtreqless": "⋛", "asymp": "≍", "Bumpeq": "≎",
    "bumpeq": "≏", "between": "≬", "backsim": "∽", "backsimeq": "⋍", "vdash": "⊢", "vDash": "⊨", "Vdash": "⊩", "Vvdash": "⊪", "dashv": "⊣",
    "VDash": "⊫", "Lsh": "↰", "Rsh": "↱", "Join": "⋈", "smile": "⌣", "frown": "⌢", "coloneq": "≔", "eqcolon": "≕", "shortmid": "∣", "multimap": "⊸",
    "Subset": "⋐", "Supset": "⋑",
}
#: Operations without a rule below (fixed values).
_OPERATIONS = {
    "int": "∫", "pm": "±", "mp": "∓", "times": "×", "cdot": "·", "ast": "∗", "star": "⋆", "circ": "∘", "bullet": "•", "diamond": "⋄", "neg": "¬",
    "land": "∧", "lor": "∨", "setminus": "∖", "Cap": "⋒", "Cup": "⋓", "cap": "∩", "cup": "∪", "wedge": "∧", "vee": "∨", "uplus": "⊎", "sqcap": "⊓",
    "sqcup": "⊔", "dotplus": "∔", "ltimes": "⋉", "rtimes": "⋊", "leftthreetimes": "⋋", "rightthreetimes": "⋌", "curlywedge": "⋏", "curlyvee": "⋎",
    "doublebarwedge": "⩞", "barwedge": "⊼", "veebar": "⊻", "wedgebar": "⩟", "divideontimes": "⋇", "lessdot": "⋖", "gtrdot": "⋗", "intercal": "⊺",
    "centerdot": "⋅", "wr": "≀", "amalg": "⨿", "surd": "√", "bigcirc": "◯", "dotminus": "∸", "not": "¬",
}
#: Signs that are read like letters (fixed values).
_LETTERS = {
    "infty": "∞", "hbar": "ℏ", "nabla": "∇", "partial": "∂", "angle": "∠", "emptyset": "∅", "forall": "∀", "exists": "∃", "top": "⊤", "bot": "⊥",
    "wp": "℘", "Re": "ℜ", "Im": "ℑ", "imath": "ı", "jmath": "ȷ", "beth": "ℶ", "gimel": "ℷ", "daleth": "ℸ", "Game": "⅁", "mho": "℧", "Finv": "Ⅎ",
    "eth": "ð", "comp": "∁", "degree": "°", "prime": "′", "backprime": "‵",
}
#: Shapes and delimiters (fixed values).
_SHAPES = {
    "lmoustache": "⎰", "rmoustache": "⎱", "lgroup": "︷", "rgroup": "︸", "bracevert": "│", "Vert": "‖", "vert": "|", "flat": "♭", "natural": "♮",
    "sharp": "♯", "clubsuit": "♣", "diamondsuit": "♢", "heartsuit": "♡", "spadesuit": "♠", "bigstar": "★", "Sun": "☉", "Venus": "♀", "Mars": "♂",
    "Moon": "☽", "triangle": "△", "square": "□", "blacksquare": "■", "lozenge": "◊", "blacklozenge": "◆", "triangledown": "▽", "circledR": "®",
    "circledS": "Ⓢ", "checkmark": "✓", "ballotbox": "☐", "maltese": "✠", "blacktriangle": "▲", "blacktriangledown": "▼",
}
#: Dots (fixed values).
_DOTS = {
    "ldots": "…", "cdots": "⋯", "vdots": "⋮", "ddots": "⋱", "adots": "⋰", "hdotsfor": "...", "ldotp": ".",
}
#: Other names of symbols (fixed values).
_OTHER_NAMES = {
    "le": "leq", "ge": "geq", "ne": "neq", "dots": "ldots", "empty": "emptyset", "varnothing": "emptyset", "lnot": "neg", "to": "rightarrow",
    "gets": "leftarrow", "leadsto": "rightsquigarrow", "iff": "Longleftrightarrow", "smallsetminus": "setminus", "doublecap": "Cap",
    "doublecup": "Cup", "smallcirc": "circ", "lhd": "vartriangleleft", "rhd": "vartriangleright", "unlhd": "trianglelefteq",
    "unrhd": "trianglerighteq", "preccurlyeq": "preceq", "succcurlyeq": "succeq", "lvertneqq": "lneqq", "gvertneqq": "gneqq", "llless": "lll",
    "gggtr": "ggg", "arrowvert": "vert", "Arrowvert": "parallel", "complement": "comp", "bigtriangleup": "triangle",
    "bigtriangledown": "triangledown", "vartriangle": "triangle", "Box": "square", "Diamond": "lozenge", "smallsmile": "smile", "smallfrown": "frown",
    "coloneqq": "eqcolon", "shortparallel": "parallel", "varpropto": "propto", "dasharrow": "dashrightarrow", "cdotp": "cdot", "varprod": "prod",
    "dotsc": "ldots", "dotso": "ldots", "dotsb": "cdots", "dotsm": "cdots", "dotsi": "cdots", "Earth": "oplus", "subseteqq": "subseteq",
    "supseteqq": "supseteq", "nleqq": "leqq", "ngeqq": "geqq",
}


def math_symbols() -> dict[str, str]:
    """What each math command without arguments reads as. Single signs are fixed values; families are made by rule."""
    out = dict.fromkeys(SILENT, "") | {w: w for w in WORDS} | {"quad": "  ", "qquad": "    "}
    out |= {n: U.lookup(f"GREEK SMALL LETTER {_GREEK.get(n, n).upper()}") for n in _SMALL}
    out |= {f"var{n}": out[n] for n in "epsilon theta pi rho sigma phi".split()}
    out |= {n: U.lookup(f"GREEK CAPITAL LETTER {_GREEK.get(n.lower(), n).upper()}") for n in _CAPITAL}
    out |= {"digamma": "ϝ", "Digamma": "Ϝ", "backepsilon": "϶"}
    out |= _RELATIONS | _OPERATIONS | _LETTERS | _SHAPES | _DOTS
    out |= {"aleph": "ℵ", "ell": "ℓ", "langle": "⟨", "rangle": "⟩"}
    for side, way in (("l", "LEFT"), ("r", "RIGHT")):
        out |= {f"{side}ceil": U.lookup(f"{way} CEILING"), f"{side}floor": U.lookup(f"{way} FLOOR")}
    # arrows and harpoons
    for way, name in _WAYS.items():
        cap = way.capitalize()
        out[f"{way}arrow"] = U.lookup(f"{name} ARROW")
        out[f"{cap}arrow"] = U.lookup(f"{name} DOUBLE ARROW")
        if "right" in way or "left" in way:
            out |= {f"long{way}arrow": U.lookup(f"LONG {name} ARROW"), f"Long{way}arrow": U.lookup(f"LONG {name} DOUBLE ARROW")}
            out |= {f"n{way}arrow": U.lookup(f"{name} ARROW WITH STROKE"), f"n{cap}arrow": U.lookup(f"{name} DOUBLE ARROW WITH STROKE")}
            out |= {f"x{way}arrow": out[f"{way}arrow"], f"x{cap}arrow": out[f"{cap}arrow"]}
        if way in ("left", "right"):
            out |= {f"hook{way}arrow": U.lookup(f"{name} ARROW WITH HOOK"), f"{way}arrowtail": U.lookup(f"{name} ARROW WITH TAIL"), f"twohead{way}arrow": U.lookup(f"{name} TWO HEADED ARROW")}
            out |= {f"looparrow{way}": U.lookup(f"{name} ARROW WITH LOOP"), f"{way}squigarrow": U.lookup(f"{name} SQUIGGLE ARROW"), f"dash{way}arrow": U.lookup(f"{name} DASHED ARROW")}
            out |= {f"{way}harpoon{turn}": U.lookup(f"{name} HARPOON WITH BARB {turn.upper()}WARDS") for turn in ("up", "down")}
            out |= {f"{turn}harpoon{way}": U.lookup(f"{turn.upper()}WARDS HARPOON WITH BARB {name}") for turn in ("up", "down")}
    out |= {f"{p}{q}arrow": U.lookup(f"{x} {y} ARROW") for p, x in (("n", "NORTH"), ("s", "SOUTH")) for q, y in (("e", "EAST"), ("w", "WEST"))}
    out |= {"mapsto": "↦", "mapsfrom": "↤", "longmapsto": "⟼", "longmapsfrom": "⟻"}
    out |= {"rightleftharpoons": "⇌", "leftrightharpoons": "⇋", "leftrightsquigarrow": "↭", "upuparrows": "⇈", "downdownarrows": "⇊", "twoheadmapsto": "⤤"}
    for way, turn in (("right", "CLOCKWISE"), ("left", "ANTICLOCKWISE")):
        out[f"curvearrow{way}"] = U.lookup(f"{turn} TOP SEMICIRCLE ARROW")
    out |= {"circlearrowright": "↺", "circlearrowleft": "↻"}
    # operators by shape
    for name, word in (("plus", "PLUS"), ("minus", "MINUS"), ("times", "TIMES"), ("dot", "DOT OPERATOR")):
        out |= {f"o{name}": U.lookup(f"CIRCLED {word}"), f"box{name}": U.lookup(f"SQUARED {word}")}
    out |= {f"bigo{n}": out[f"o{n}"] for n in ("plus", "times", "dot")} | {"bigtimes": "⨯"}
    out |= {"circledast": "⊛", "circledcirc": "⊚", "circleddash": "⊝", "measuredangle": "∡", "sphericalangle": "∢"}
    for name, word in (("sum", "SUMMATION"), ("prod", "PRODUCT"), ("coprod", "COPRODUCT"), ("bigcap", "INTERSECTION"), ("bigcup", "UNION"), ("bigvee", "LOGICAL OR"), ("bigwedge", "LOGICAL AND"), ("bigsqcap", "SQUARE INTERSECTION OPERATOR"), ("bigsqcup", "SQUARE UNION OPERATOR"), ("biguplus", "UNION OPERATOR WITH PLUS")):
        out[name] = U.lookup(f"N-ARY {word}")
    for name, word in (("iint", "DOUBLE INTEGRAL"), ("iiint", "TRIPLE INTEGRAL"), ("iiiint", "QUADRUPLE INTEGRAL OPERATOR"), ("oint", "CONTOUR INTEGRAL"), ("oiint", "SURFACE INTEGRAL"), ("oiiint", "VOLUME INTEGRAL"), ("varointclockwise", "CLOCKWISE CONTOUR INTEGRAL"), ("ointctrclockwise", "ANTICLOCKWISE CONTOUR INTEGRAL"), ("fint", "INTEGRAL AVERAGE WITH SLASH"), ("sqint", "QUATERNION INTEGRAL OPERATOR"), ("landupint", "ANTICLOCKWISE INTEGRATION"), ("lownint", "INTEGRAL AROUND A POINT OPERATOR"), ("sumint", "SUMMATION WITH INTEGRAL"), ("intbar", "FINITE PART INTEGRAL"), ("intBar", "INTEGRAL WITH DOUBLE STROKE")):
        out[name] = U.lookup(word)
    out["idotsint"] = "∫⋯∫"
    # sets, orders and triangles
    for side, word in (("sub", "SUBSET OF"), ("sup", "SUPERSET OF")):
        image = "IMAGE" if side == "sub" else "ORIGINAL"
        out |= {f"{side}set": U.lookup(word), f"{side}seteq": U.lookup(f"{word} OR EQUAL TO"), f"{side}setneq": U.lookup(f"{word} WITH NOT EQUAL TO"), f"{side}setneqq": U.lookup(f"{word} ABOVE NOT EQUAL TO")}
        out |= {f"var{side}setneq": out[f"{side}setneq"], f"var{side}setneqq": out[f"{side}setneqq"], f"sq{side}set": U.lookup(f"SQUARE {image} OF"), f"sq{side}seteq": U.lookup(f"SQUARE {image} OF OR EQUAL TO")}
    for side, word in (("left", "NORMAL SUBGROUP OF"), ("right", "CONTAINS AS NORMAL SUBGROUP")):
        out |= {f"vartriangle{side}": U.lookup(word), f"triangle{side}eq": U.lookup(f"{word} OR EQUAL TO"), f"triangle{side}": U.lookup(f"WHITE {side.upper()}-POINTING TRIANGLE")}
    out |= {p: U.lookup(p.upper()) for p in ("Mercury", "Jupiter", "Saturn", "Uranus", "Neptune", "Pluto")}
    # alphabets
    for k in range(26):
        c = chr(65 + k)
        out |= {name + c: alphabet(c, name) for name in ("Bbb", "scr", "frak")}
    out |= {"Bbbk": "𝕜", "Bbb1": "𝟙"}
    for name, of in _OTHER_NAMES.items():
        out[name] = out[of]
    # limits of limits, and remainders
    for name, word in (("lim", "lim"), ("proj", "proj lim"), ("inj", "inj lim")):
        out |= {f"{name}lim": word, f"var{name}lim": word} if name != "lim" else {f"{v}lim{t}": f"lim {t}" for v in ("", "var") for t in ("sup", "inf")}
    out |= dict.fromkeys(("bmod", "mod", "pod"), "mod")
    # negations are the base with a stroke
    less = {"less": "<", "gtr": ">"}
    for base in "prec succ preceq succeq less gtr leq geq sim cong approx asymp parallel exists subset supset subseteq supseteq sqsubseteq sqsupseteq vdash vDash Vdash VDash".split():
        out[f"n{base}"] = U.normalize("NFC", less.get(base, out.get(base, "")) + "̸")
    for side in ("left", "right"):
        out[f"ntriangle{side}"] = U.normalize("NFC", out[f"vartriangle{side}"] + "̸")
        out[f"ntriangle{side}eq"] = U.normalize("NFC", out[f"triangle{side}eq"] + "̸")
    out |= {"nmid": "∤", "nshortmid": "∤", "nshortparallel": out["nparallel"], "nsqsubset": out["nsqsubseteq"], "nsqsupset": out["nsqsupseteq"]}
    out |= {"nleqslant": out["nleq"], "ngeqslant": out["ngeq"], "nsubseteqq": out["nsubseteq"], "nsupseteqq": out["nsupseteq"]}
    return out


#: First code points of mathematical alphabets: capitals, small letters, digits (0: none).
_STARTS = {"Bbb": (0x1D538, 0x1D552, 0x1D7D8), "scr": (0x1D49C, 0x1D4B6, 0), "frak": (0x1D504, 0x1D51E, 0), "sf": (0x1D5A0, 0x1D5BA, 0x1D7E2), "tt": (0x1D670, 0x1D68A, 0x1D7F6), "bf": (0x1D400, 0x1D41A, 0x1D7CE), "it": (0x1D434, 0x1D44E, 0)}
_OLDER = {"Bbb": "DOUBLE-STRUCK {} {}", "scr": "SCRIPT {} {}", "frak": "BLACK-LETTER {} {}", "it": "PLANCK CONSTANT"}


def alphabet(char: str, name: str) -> str:
    """The character in a mathematical alphabet; letters that Unicode had before stand at older places."""
    capital, small, digit = _STARTS[name]
    if "A" <= char <= "Z":
        code, case = capital + ord(char) - 65, "CAPITAL"
    elif "a" <= char <= "z":
        code, case = small + ord(char) - 97, "SMALL"
    elif char.isascii() and char.isdigit() and digit:
        return chr(digit + ord(char) - 48)
    else:
        return char
    if U.category(chr(code)) != "Cn":
        return chr(code)
    return U.lookup(_OLDER[name].format(case, char.upper()))


MATH_ALPHABETS = {"mathbb": "Bbb", "mathcal": "scr", "mathfrak": "frak", "mathsf": "sf", "mathtt": "tt", "mathbf": "bf", "mathit": "it"}
#: Combining marks of math accents (fixed values).
MATH_ACCENTS = {
    "vec": "⃗", "overrightarrow": "⃗", "overleftarrow": "⃖", "hat": "̂", "widehat": "̂", "tilde": "̃", "widetilde": "̃",
    "bar": "̄", "overline": "̅", "underline": "̲", "dot": "̇", "ddot": "̈", "dddot": "⃛", "ddddot": "⃜",
    "check": "̌", "breve": "̆", "acute": "́", "grave": "̀", "mathring": "̊",
}
#: Combining marks of text accents (fixed values).
TEXT_ACCENTS = {"'": "́", "`": "̀", "^": "̂", '"': "̈", "~": "̃", "=": "̄", ".": "̇", "u": "̆", "v": "̌", "H": "̋", "c": "̧", "k": "̨", "r": "̊", "b": "̱", "d": "̣", "t": "͡"}
SUPERSCRIPTS = dict(zip("0123456789+-=()abcdefghijklmnoprstuvwxyz", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻ"))
SUBSCRIPTS = dict(zip("0123456789+-=()aehijklmnoprstuvx", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ"))
#: Fractions with a character of their own (fixed values).
VULGAR = dict(zip("1/2 1/3 2/3 1/4 3/4 1/5 2/5 3/5 4/5 1/6 5/6 1/7 1/8 3/8 5/8 7/8 1/9 1/10".split(), "½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅐⅛⅜⅝⅞⅑⅒"))
SYMBOLS = math_symbols()

#: Text symbols by command (fixed values).
TEXT_SYMBOLS = {
    "%": "%", "&": "&", "$": "$", "#": "#", "_": "_", "{": "{", "}": "}", "textasciicircum": "^", "textasciitilde": "~", "textbackslash": "\\",
    "textbar": "|", "textbraceleft": "{", "textbraceright": "}", "textdollar": "$", "textgreater": ">", "textless": "<", "textellipsis": "…",
    "textcopyright": "©", "textregistered": "®", "texttrademark": "™", "copyright": "©", "pounds": "£", "S": "§", "P": "¶", "dag": "†", "ddag": "‡",
    "ldots": "…", "dots": "…", "LaTeXe": "LaTeX2ε", "LaTeX": "LaTeX", "TeX": "TeX", "AA": "Å", "aa": "å", "AE": "Æ", "ae": "æ", "OE": "Œ", "oe": "œ",
    "ss": "ß", "L": "Ł", "l": "ł", "O": "Ø", "o": "ø", "i": "ı", "j": "ȷ", "textexclamdown": "¡", "textquestiondown": "¿", "textquotedblleft": "„",
    "textquotedblright": "''", "textquoteleft": "‘", "textquoteright": "’", "textendash": "–", "textemdash": "—", "textbullet": "•",
    "textperiodcentered": "·", "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "textvisiblespace": "␣",
    "textcompwordmark": "­", "euro": "€", "textunderscore": "_", "textdegree": "°", "textcelsius": "℃", "textmu": "µ", "textohm": "Ω",
    "textnumero": "№", "textestimated": "℮", "textbrokenbar": "¦", "textordfeminine": "ª", "textordmasculine": "º", "textacutedbl": "˝",
    "textgravedbl": "˵", "texttildelow": "˷", "textcent": "¢", "texteuro": "€", "textyen": "¥", "textcurrency": "¤",
}

#: How a citation reads, by kind: before, after, and whether it is raised (fixed values).
CITATIONS = {"nocite": None}
CITATIONS |= dict.fromkeys(("parencite", "autocite", "autocite*", "smartcite", "citep"), ("(", ")", False))
CITATIONS |= dict.fromkeys(("footcite", "fnotecite"), ("[", "]", "footnote"))
CITATIONS |= dict.fromkeys(("citeauthor", "citeauthor*", "citeyear", "citeyear*", "citetitle", "fullcite", "notecite", "volcite"), ("", "", False))
CITATIONS |= {"supercite": ("^", "", "sup")} | dict.fromkeys(("cite", "cite*", "textcite", "citet"), ("[", "]", False))

#: Output formats: name, extension, media type, other names (fixed values).
FORMATS = (
    ("pdf", "pdf", "application/pdf", ()),
    ("html", "html", "text/html", ("htm",)),
    ("docx", "docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ("word",)),
    ("epub", "epub", "application/epub+zip", ()),
)

#: Commands that are offered for completion, with their meaning (fixed values).
COMPLETIONS = (
    ("documentclass", "Document class declaration"), ("usepackage", "Load a package"), ("begin", "Start an environment"), ("end", "End an environment"),
    ("title", "Document title"), ("author", "Document author"), ("date", "Document date"), ("maketitle", "Render title block"), ("section", "Section heading"),
    ("subsection", "Subsection heading"), ("subsubsection", "Subsubsection heading"), ("paragraph", "Paragraph heading"), ("chapter", "Chapter heading"),
    ("part", "Part heading"), ("label", "Define a cross-reference label"), ("ref", "Reference a label"), ("pageref", "Reference a page number"),
    ("cite", "Citation"), ("textbf", "Bold text"), ("textit", "Italic text"), ("texttt", "Monospace text"), ("emph", "Emphasized text"),
    ("textcolor", "Colored text"), ("includegraphics", "Include an image"), ("input", "Include another file"), ("tableofcontents", "Table of contents"),
    ("listoffigures", "List of figures"), ("listoftables", "List of tables"), ("footnote", "Footnote"), ("caption", "Caption"),
    ("newcommand", "Define a macro"), ("def", "Define a macro (plain TeX)"), ("today", "Current date"), ("url", "URL"), ("hline", "Table horizontal rule"),
    ("centering", "Center content"), ("raggedright", "Flush left"), ("raggedleft", "Flush right"), ("newpage", "Start a new page"),
    ("clearpage", "Clear page"), ("pagebreak", "Page break"), ("noindent", "Suppress paragraph indent"),
    ("indent", "Force paragraph indent"), ("newline", "Line break"), ("onecolumn", "One-column layout"), ("twocolumn", "Two-column layout"),
    ("marginpar", "Margin note"), ("abstract", "Abstract environment"), ("equation", "Numbered display math"), ("itemize", "Bulleted list"),
    ("enumerate", "Numbered list"), ("tabular", "Table"), ("table", "Floating table"), ("figure", "Floating figure"), ("center", "Centered block"),
    ("quote", "Quote block"), ("verbatim", "Verbatim text"), ("lstlisting", "Code listing"), ("thebibliography", "Bibliography list"),
    ("bibliography", "External bibliography file"), ("bibliographystyle", "Bibliography style"),
)
#: Environments that are offered for completion (fixed values).
ENVIRONMENTS = (
    ("document", "Main document body"), ("itemize", "Bulleted list"), ("enumerate", "Numbered list"), ("tabular", "Table"), ("table", "Floating table"),
    ("figure", "Floating figure"), ("equation", "Numbered display math"), ("center", "Centered block"), ("quote", "Quote block"),
    ("quotation", "Quotation block"), ("abstract", "Abstract"), ("verbatim", "Verbatim text"), ("lstlisting", "Code listing"),
    ("thebibliography", "Bibliography list"), ("align", "Aligned equations"), ("gather", "Gathered equations"), ("minipage", "Mini page box"),
)
