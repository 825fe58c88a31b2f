"""Secrets in texts: fixed patterns, and strings that zstandard cannot predict from what is usual around them.

The novelty method counts the words of the whole corpus (`learn`), makes a
dictionary of the commonest ones, and primes zstandard with it, with identifiers
made of its words, and with the text around a candidate. What matters is how
many bytes the candidate adds to that. A string in a sensitive context is
reported if it adds as much as a random string of its length and kind of
characters would, rather than as much as an identifier of its length would: the
bound lies between the two, both measured in the same surroundings.

Two maps over Arrow batches; of the first, counts of words are shuffled, and the
`most` commonest reach the driver and all tasks. Defined results: a null or empty
text has no spans; very long texts are scanned whole; an empty table stays empty
(its dictionary holds the fixed identifiers alone); repeated rows give repeated
results; other columns are passed on, and one named `spans` (in any case) is
replaced. A string is looked at once, wherever several sensitive words lead to
it, and whether it touches an earlier span costs the logarithm of their number.
Not reported by the method: strings of letters alone or digits alone, as words
and numbers are, strings of less than 16 characters, strings before a sensitive
word.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.columns import without
from quire.llm.kernel import Words, give_back, pieces

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LIKELY = re.compile(rb"[0-9a-f]{24}")
_STEMS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that make the text just after them sensitive.
_SENSITIVE = re.compile(r"passw|passphrase|secret|token|api_?key|private_?key|access_?key|credential|bearer|authori[sz]ation|signature", re.ASCII | re.IGNORECASE)
_HINTS = (b"passw", b"passphrase", b"secret", b"token", b"key", b"credential", b"bearer", b"authori", b"signature")
#: Characters of the shortest candidate.
LEAST = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_REST = re.compile(r"[A-Za-z0-9+/_=-]*")
#: What code spells out often: these words are in every dictionary.
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key public_key credential bearer authorization "
    "signature client_id client_secret session_id request_id user_id username account configuration environment variable "
    "function return import export default class const static string integer boolean null true false undefined example "
    "placeholder changeme your-token-here insert_your_key_here xxxxxxxxxxxxxxxx 0000000000000000 1234567890abcdef "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 http https localhost application/json content-type "
    "getElementById addEventListener toString hashCode equals Exception Controller Service Repository Manager Factory"
)
#: Words of a corpus that a dictionary takes, and bytes of a word that are looked at.
MOST, LONGEST = 4000, 24
#: Where between an identifier (0) and a random string (1) what is reported begins.
RATIO = 0.65
#: Kinds of characters, from few to many; a candidate's own is the first that holds its letters and digits.
_DIGITS, _LOWER_CASE = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_ALPHABETS = (
    _DIGITS + "abcdef", "234567" + _LOWER_CASE, _DIGITS + _LOWER_CASE, _DIGITS + _LOWER_CASE + _LOWER_CASE.upper(),
)

_HEXBYTE = np.zeros(256, bool)
_HEXBYTE[list(b"0123456789abcdef")] = True
_LOWER = bytes(c + 32 if 65 <= c < 91 else c for c in range(256))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, in code points."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if len(m[0]) >= 24]
    return found


def _identifier(rng: random.Random, words: list[str], size: int) -> str:
    """Words joined as code joins them, at least `size` characters."""
    mark, out = rng.choice(["_", "-", "", "_", "/"]), ""
    while len(out) < size:
        word = rng.choice(words) if rng.random() < 0.8 else str(rng.randrange(10 ** rng.randint(1, 4)))
        out += (mark if out else "") + (word if mark or not out else word.capitalize())
    return out


class Dictionary:
    """zstandard primed with common words, the last ones nearest, and with identifiers made of them.

    Every second word primes; identifiers to compare with are made of the others, as a candidate's words may be new, too.
    """

    def __init__(self, words: tuple[str, ...] = ()):
        plain = [w for w in (*words[:MOST], *IDENTIFIERS.split()) if re.fullmatch("[a-z]{3,}", w)]
        primed, other, rng = plain[::2], plain[1::2], random.Random(1)
        self.samples = [" ".join([*(_identifier(rng, primed, rng.randint(8, 30)) for _ in range(120)), IDENTIFIERS]) for _ in range(4)]
        self.natural = [_identifier(rng, other, 60) for _ in range(200)]
        held = zstandard.ZstdCompressionDict(" ".join(primed).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=9)
        self._press = zstandard.ZstdCompressor(level=9, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self._press.compress(text.encode("utf-8", "replace")))

    def usual(self, size: int, k: int) -> str:
        """The k-th identifier of a size."""
        return "_".join(self.natural[(7 * k + i) % len(self.natural)] for i in range(size // 60 + 1))[:size]

    def marginal(self, candidates: list[str], around: str) -> list[float]:
        """Bytes that each of the candidates adds to the surroundings: the mean over several samples of identifiers, as one alone is off by a byte or two."""
        total = [0.0] * len(candidates)
        for sample in self.samples:
            base = f"{around}\n{sample}\n"
            held = self.size(base)
            total = [t + self.size(base + c) - held for t, c in zip(total, candidates)]
        return [t / len(self.samples) for t in total]


@lru_cache(4)
def dictionary(words: tuple[str, ...] = ()) -> Dictionary:
    return Dictionary(words)


def random_like(candidate: str, k: int = 0) -> str:
    """A random string with the candidate's kind of letters and digits, and its marks in their places; the same one for each k."""
    own = {c for c in candidate if c.isalnum()}
    letters = next(a for a in _ALPHABETS if own <= set(a))
    rng = random.Random(len(candidate) * 8 + k)
    return "".join(rng.choice(letters) if c.isalnum() else c for c in candidate)


def novel(candidate: str, around: str, ratio: float = RATIO, words: tuple[str, ...] = ()) -> bool:
    """Whether what the candidate adds lies beyond `ratio` of the way from an identifier to a random string.

    One without small letters is read in small letters, as the dictionary is.
    """
    if candidate == candidate.upper():
        candidate = candidate.lower()
    held, tries = dictionary(words), range(4)
    added, *others = held.marginal([candidate, *(held.usual(len(candidate), k) for k in tries), *(random_like(candidate, k) for k in tries)], around)
    low, high = sum(others[:4]) / 4, sum(others[4:]) / 4
    return high > low and added >= low + ratio * (high - low)


def surroundings(text: str, a: int, b: int, context: int) -> str:
    """Up to `context` characters on each side of text[a:b], with other places of it blanked: a secret that is told twice is no less one.

    A value is blanked without its name as well, so that `=x` is not primed by `: x`.
    """
    whole = text[a:b]
    before, after = text[max(0, a - context - len(whole)) : a], text[b : b + context + len(whole)]
    for part in (whole, whole.strip("=+/_-"), whole.rstrip("=").rpartition("=")[2]):
        if len(part) >= LEAST:
            before, after = before.replace(part, " " * len(part)), after.replace(part, " " * len(part))
    return before[max(0, len(before) - context) :] + " " + after[:context]


def novel_spans(text: str, taken: list[tuple[int, int, str]], reach: int, context: int, ratio: float, words: tuple[str, ...] = ()) -> list[tuple[int, int, str]]:
    """Candidates that start at most `reach` characters after a sensitive word and are novel by `ratio`."""
    held, found, tried = Spans((a, b) for a, b, _ in taken), [], set()
    for word in _SENSITIVE.finditer(text):
        for m in _CANDIDATE.finditer(text, word.end(), word.end() + reach + LEAST):
            a, b = m.start(), _REST.match(text, m.end()).end()  # the end of the search may cut a candidate
            if (a, b) in tried or held.touches(a, b):
                continue
            tried.add((a, b))
            s = text[a:b]
            if not (re.search(r"[0-9]", s) and re.search(r"[A-Za-z]", s)):
                continue
            if novel(s, surroundings(text, a, b, context), ratio, words):
                found.append((a, b, "novel"))
                held.add(a, b)
    return found


class Spans:
    """Spans of a text in order, those that touch made one; asking costs the logarithm of their number."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def touches(self, a: int, b: int) -> bool:
        """Whether a character of [a, b) lies in a span."""
        k = bisect_left(self.starts, b) - 1
        return k >= 0 and self.ends[k] > a

    def add(self, a: int, b: int) -> None:
        """A span that touches none."""
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def scan_text(text: str, reach: int = 40, context: int = 2048, ratio: float = RATIO, words: tuple[str, ...] = ()) -> list[tuple[int, int, str]]:
    """All spans of a text, by start and then kind."""
    base = base_spans(text)
    return sorted([*base, *novel_spans(text, base, reach, context, ratio, words)], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _worth(at: np.ndarray, data: np.ndarray) -> list[int]:
    """Rows of a piece that can hold any span; all others need no regular expression."""
    raw = data.tobytes()
    low = raw.translate(_LOWER)
    rows = set()

    def mark(places) -> None:
        rows.update((np.searchsorted(at, places, "right") - 1).tolist())

    edges = np.flatnonzero(np.diff(np.concatenate([[False], _HEXBYTE[data], [False]]).astype(np.int8)))
    long = edges[1::2] - edges[::2] >= 24
    mark(edges[::2][long])
    for a, b in zip(edges[::2][long].tolist(), edges[1::2][long].tolist()):  # a run may span rows
        mark(np.arange(a, b))
    for stem in (b"akia", *_HINTS):
        k = low.find(stem)
        while k >= 0:
            mark([k])
            k = low.find(stem, k + len(stem))
    return sorted(rows)


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())])


_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123], _LETTER[65:91] = np.arange(97, 123), np.arange(97, 123)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each piece of text: runs of ASCII letters, in lower case."""
    for batch in batches:
        for _, at, data in pieces(batch.column(0)):
            words = Words(at, _LETTER[data])
            size = words.end - words.start
            fit = np.flatnonzero((size >= 3) & (size <= LONGEST))
            _, first, count = np.unique(words.hash[fit], return_index=True, return_counts=True)
            raw = words.data.tobytes()
            spelt = [raw[a:b].decode() for a, b in zip(words.start[fit][first].tolist(), words.end[fit][first].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(spelt, pa.string()), pa.array(count, pa.int64())], names=["word", "n"])
    give_back()


def learn(docs: DataFrame, text: str = "text", most: int = MOST) -> tuple[str, ...]:
    """The `most` commonest words of all texts, the commonest last; ties by the word."""
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    few = counts.orderBy(F.desc("n"), "word").limit(most).coalesce(1)  # so that tasks merge what parts have, and not the driver
    return tuple(r["word"] for r in sorted(few.collect(), key=lambda r: (r["n"], [-ord(c) for c in r["word"]])))


def scan(docs: DataFrame, text: str = "text", reach: int = 40, context: int = 2048, ratio: float = RATIO, words: tuple[str, ...] = ()) -> DataFrame:
    """Adds `spans`: array of (start, end, kind), offsets in code points, end exclusive.

    `reach`: characters after a sensitive word in which candidates start; `context`: characters
    on each side that prime the compressor; `ratio`: where between an identifier (0) and a random
    string (1) of a candidate's length what is reported begins; `words`: of the corpus, by `learn`.
    """
    kept = without(docs.columns, ["spans"])
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept] + [T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            found: list[list[dict]] = [[] for _ in range(len(column))]
            for first, at, data in pieces(column):
                for i in _worth(at, data):
                    if at[i] < at[i + 1]:
                        s = data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace")
                        found[first + i] = [{"start": a, "end": b, "kind": k} for a, b, k in scan_text(s, reach, context, ratio, words)]
            old = [batch.column(batch.schema.get_field_index(c)).cast(target.field(c).type) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, pa.array(found, target.field("spans").type)], schema=target)

    return docs.mapInArrow(run, schema)
