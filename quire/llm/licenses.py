"""Licence texts and notices, found by digests of canonical texts. DataFrame functions only.

A text is brought to a canonical form: ASCII letters in lower case, lines that
only claim a copyright removed, equivalent spellings made one, punctuation and
white space folded to single spaces, and whoever a clause names as the holder
read as one word, unless that says something else than a name would ("anyone
other than the user"; a name with such a word matches nothing). The digest of the entire text is hash-joined to those of known
licences, a table of fixed size. Lines that name a licence are looked up in the
same way among known notices.

One pass over the texts; nothing of them is shuffled. Defined results: null and
empty texts, and texts that are empty in canonical form, match nothing; very
long texts are read whole; an empty table stays empty; repeated rows match
alike; other columns are passed on, and those named like an output (in any
case) are replaced.

`python -m quire.llm.licenses FILE...` prints the digests of further texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.columns import fresh, without

#: Characters that fold to a space (fixed values): ASCII but letters and digits, no-break space, dashes, typographic quotes.
MARKS = r"[\x00-\x2f\x3a-\x60\x7b-\x7f\x{a0}\x{a9}\x{2010}-\x{2015}\x{2018}-\x{201f}\x{2026}]+"
#: Claims at the start of lines: a copyright with a year, a bracket or a name after it, or all rights reserved. A clause that is marked
#: (c) is none, and of a claim no more than 160 characters go.
CLAIMS = r"(^|\n)[ \t/*#;-]*((copyright[ \t]*(\(c\)|\x{a9}|[0-9]{4}|<|\[|by )|(\(c\)|\x{a9})[ \t]*(copyright|[0-9]{4}|<|\[|by ))[^\n]{0,160}|all rights reserved[., \t]*)"
#: Equivalent spellings (fixed values): each on the left reads as the one on the right.
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("behaviour", "behavior"), ("judgement", "judgment"),
    ("merchantibility", "merchantability"), ("analogue", "analog"), ("fulfil ", "fulfill "), ("cancelation", "cancellation"), ("centre", "center"),
    ("copyright owner", "copyright holder"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("https ", "http "),
)
#: Clauses that name the holder, in canonical form: whoever stands between the two parts, in up to ten words, reads as `holder`.
HOLDERS = r"(neither the name of|provided by|in no event shall) (?:[^ \n]+ ){1,10}?(nor the names? of|as is|be liable)"
#: Words that no holder's name has (fixed values): where one stands in its place the clause says something else, and is marked by a line feed.
_OTHERS = "anyone|anybody|any|everyone|everybody|nobody|none|other|others|than|except|user|users|you|your|licensee|licensees|recipient|recipients|not|unless|but|all|who|whoever|which|if|shall|must|may|without|only|where|when|while"
EXCEPTIONS = rf"(neither the name of|provided by|in no event shall) ((?:[^ \n]+ ){{0,9}}?(?:{_OTHERS}) (?:[^ \n]+ ){{0,9}}?(?:nor the names? of|as is|be liable))"

_GRANT_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_NAME_BSD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_DISCLAIMER_BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GRANT_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_DISCLAIMER_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_DISCLAIMER_ISC = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Entire licence texts (fixed values), with titles as separate variants.
TEXTS = {
    "MIT": [t + _GRANT_MIT + """, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
""" + _DISCLAIMER_MIT for t in ("", "MIT License\n", "The MIT License (MIT)\n", "The MIT License\n")],
    "MIT-0": [t + _GRANT_MIT + ".\n" + _DISCLAIMER_MIT for t in ("", "MIT No Attribution\n")],
    "BSD-2-Clause": [t + _GRANT_BSD + _DISCLAIMER_BSD for t in ("", "BSD 2-Clause License\n", "The 2-Clause BSD License\n")],
    "BSD-3-Clause": [t + _GRANT_BSD + _NAME_BSD + _DISCLAIMER_BSD for t in ("", "BSD 3-Clause License\n", "The 3-Clause BSD License\n")],
    "ISC": [t + "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _DISCLAIMER_ISC for t in ("", "ISC License\n", "The ISC License\n")],
    "0BSD": [t + "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _DISCLAIMER_ISC for t in ("", "BSD Zero Clause License\n", "Zero-Clause BSD\n")],
    "Zlib": [t + """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""" for t in ("", "zlib License\n")],
    "WTFPL": ["""DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION
0. You just DO WHAT THE FUCK YOU WANT TO."""],
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""],
}

#: Digests of long licences in canonical form (fixed values), of texts as they are distributed: whole, and up to the end of the terms.
DIGESTS = {
    "Apache-2.0": ("036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b", "f70a2718f78121f2da77cd6afbffffbd668d7c1fd36c85a3ef121e83cb5f48fe",),
    "Artistic-1.0": ("e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "GFDL-1.2": ("94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",),
    "GFDL-1.3": ("a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",),
    "GPL-1.0": ("8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",),
    "GPL-2.0": ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",),
    "GPL-3.0": ("eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",),
    "LGPL-2.0": ("61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",),
    "LGPL-2.1": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-1.1": ("a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",),
    "MPL-2.0": ("6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",),
}

#: Notices of one line (fixed values), from the names below.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("CC0 1.0",),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL version 3", "GPLv3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPLv3"),
    "MIT": ("MIT License", "MIT Licence"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
}
_PHRASES = ("Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}", "This file is licensed under {}", "SPDX-License-Identifier: {}")


def canonical_text(text: str) -> str:
    """The canonical form of a text, for the known table; `canonical` is its Spark twin."""
    java = lambda p: re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", p)
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    text = re.sub(java(CLAIMS), "\n", text)
    text = re.sub(java(MARKS), " ", text)
    for old, new in SPELLINGS:
        text = text.replace(old, new)
    return re.sub(HOLDERS, r"\1 holder \2", re.sub(EXCEPTIONS, r"\1 \n\2", text.strip(" ")))


def known(more: Iterable[tuple[str, str]] = ()) -> list[tuple[str, str, str]]:
    """(digest, licence, 'text' or 'notice') of all known texts, and of further (licence, entire text) rows; a table of fixed size."""
    out = {}
    for name, texts in TEXTS.items():
        for text in texts:
            out[hashlib.sha256(canonical_text(text).encode()).hexdigest()] = (name, "text")
    for name, digests in DIGESTS.items():
        for digest in digests:
            out[digest] = (name, "text")
    for name, spoken in NAMES.items():
        for phrase in _PHRASES:
            for x in (name, *spoken):
                for article in ("", "the "):
                    out.setdefault(hashlib.sha256(canonical_text(phrase.format(article + x)).encode()).hexdigest(), (name, "notice"))
    for name, text in more:
        out.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), (name, "text"))
    return sorted((d, *v) for d, v in out.items())


def canonical(text: Column) -> Column:
    text = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    text = F.regexp_replace(F.regexp_replace(text, CLAIMS, "\n"), MARKS, " ")
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.regexp_replace(F.regexp_replace(F.trim(text), EXCEPTIONS, "$1 \n$2"), HOLDERS, "$1 holder $2")


def find(docs: DataFrame, text: str = "text", more: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """Adds `digest` (of the canonical text), `licence` (of the entire text, or null) and `notices` (licences named by lines, distinct and sorted).

    `more`: further (licence, entire text) rows, such as the long licences that `TEXTS` lacks.
    """
    table = known(more)
    new, held, digest, licence = fresh(docs.columns, "new", "held", "digest", "licence")
    texts = docs.sparkSession.createDataFrame([(d, n) for d, n, _ in table], f"{digest} string, {licence} string")
    notices = F.create_map(*(F.lit(x) for d, n, _ in table for x in (d, n)))
    form = canonical(F.col(text))
    lines = F.filter(F.split(F.col(text), "\n", -1), lambda x: x.rlike("(?i)licen[sc]e|released under|distributed under"))
    named = F.transform(lines, lambda x: F.try_element_at(notices, F.sha2(canonical(x), 256)))
    found = F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))
    found = F.coalesce(found, F.expr("cast(array() as array<string>)"))
    out = docs.withColumns({new: F.when(F.length(form) > 0, F.sha2(form, 256)), held: found})
    out = out.join(F.broadcast(texts), F.col(new) == F.col(digest), "left")  # as many rows as the table above
    return out.select(*without(docs.columns, ["digest", "licence", "notices"]), F.col(new).alias("digest"), F.col(licence).alias("licence"), F.col(held).alias("notices"))


def planted() -> list[tuple[int, str]]:
    """(id, text) with negative ids: each known text as it is, and once more in capitals, with other line ends and a holder's line."""
    out = []
    for texts in TEXTS.values():
        for text in texts:
            out += [(-1 - len(out), text), (-2 - len(out), "Copyright (c) 2024 A. Holder\n\n" + text.upper().replace(", ", ",\n    "))]
    return out


def oracle(columns: str) -> str:
    """DuckDB SQL for `find` over documents and the planted texts, with one row for each of them."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def form(x: str) -> str:
        out = f"regexp_replace(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quote(CLAIMS)}, chr(10), 'g'), {quote(MARKS)}, ' ', 'g')"
        for old, new in SPELLINGS:
            out = f"replace({out}, {quote(old)}, {quote(new)})"
        out = f"regexp_replace(trim({out}, ' '), {quote(EXCEPTIONS)}, '\\1 ' || chr(10) || '\\2', 'g')"
        return f"regexp_replace({out}, {quote(HOLDERS)}, '\\1 holder \\2', 'g')"

    own = ", ".join(f"({i}, {quote(t)})" for i, t in planted())
    rows = ", ".join(f"({quote(d)}, {quote(n)})" for d, n, _ in known())
    return f"""WITH known(digest, licence) AS (VALUES {rows}),
documents AS (SELECT doc_id, text FROM main.documents UNION ALL SELECT * FROM (VALUES {own})),
forms AS (SELECT doc_id, text, {form("text")} AS form FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e|released under|distributed under')),
named AS (SELECT doc_id, licence FROM (SELECT doc_id, sha256({form("line")}) AS d FROM lines WHERE regexp_matches(line, '(?i)licen[sc]e|released under|distributed under')) JOIN known ON d = digest),
notices AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices FROM named GROUP BY doc_id),
whole AS (SELECT doc_id, CASE WHEN length(form) > 0 THEN sha256(form) END AS digest FROM forms)
SELECT {columns} FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (doc_id)"""


if __name__ == "__main__":
    import sys

    for path in sys.argv[1:]:
        with open(path, encoding="utf-8") as f:
            print(hashlib.sha256(canonical_text(f.read()).encode()).hexdigest(), path)
