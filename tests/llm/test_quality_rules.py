import math
import random
import re
from collections import Counter

import pytest

from quire.llm import quality_rules as Q
from quire.llm import queries


def brute(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {k for i, w in enumerate(windows) if count[w] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def rows_of(spark, rows):
    frame = spark.createDataFrame([(i, t, g, 0, "c") for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, n_words int, kept string")
    return {r.doc_id: r for r in Q.judge(frame, Q.references(frame)).collect()}


def check(row, text):
    expected = brute(text)
    assert tuple(row[c] for c in Q.COUNTS) == expected
    assert row.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
    assert not (row.base_failed and row.kept)


def test_counts_agree_with_brute_force(spark):
    rng = random.Random(1)
    pieces = ["the", "of", "a", "é", "#", "x|y", "\n", "\n\n", " ", "\t", "one two three four five six seven eight nine", "same line\n", "\r", "ß$"]
    rows = [(" ".join(rng.choices(pieces, k=rng.randint(0, 60))), rng.choice(["en", None, "xx"])) for _ in range(200)]
    rows += [(None, "en"), ("", None), ("\n\n", "de"), ("a\nb\na\n\na", "en"), (" x\n x\nx", "en"), ("w " * 100000, "en")]
    got = rows_of(spark, rows)
    for i, (text, _) in enumerate(rows):
        check(got[i], text)


def test_query_keeps_clean_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_quality_rules(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        check(got[i], text)
    sound = [i for i, q in quality.items() if q == 1 and not got[i].base_failed]
    junk = [i for i, q in quality.items() if q == 0]
    assert sum(got[i].kept for i in sound) >= 0.99 * len(sound)
    assert sum(not got[i].kept for i in junk) >= 0.8 * len(junk)


def test_empty_table_and_no_reference(spark):
    assert rows_of(spark, []) == {}
    got = rows_of(spark, [(" ".join(f"w{k}" for k in range(300)), "xx")])
    assert got[0].kept and got[0].nearest is None


@pytest.mark.parametrize("p, q, expected", [([1, 0], [0, 1], 1.0), ([0.5, 0.5], [0.5, 0.5], 0.0)])
def test_distance(p, q, expected):
    import numpy as np

    assert abs(Q.distance(np.array([p], float), np.array(q, float))[0] - expected) < 1e-12


def histograms(text):
    """Shares of classes of characters, and counts of common words, character by character."""
    kinds = dict.fromkeys(Q.CLASSES, 0)
    for c in text:
        if "a" <= c <= "z" or c > "\x7f":
            kinds["lower"] += 1
        elif "A" <= c <= "Z":
            kinds["upper"] += 1
        elif "0" <= c <= "9":
            kinds["digit"] += 1
        elif c in " \t\n\v\f\r":
            kinds["space"] += 1
        elif c in ".,;:'\"?!()-":
            kinds["stop"] += 1
        elif c in "#*$%&|<>@^_`~\\/{}[]=+":
            kinds["symbol"] += 1
        else:
            kinds["other"] += 1
    words = re.findall("[^\x20\x09-\x0d]+", text)
    known = {w for ws in Q.COMMON.values() for w in ws.split()}
    return Counter(kinds), Counter(w if w in known else None for w in words)


def js(p, q):
    keys, n, m = set(p) | set(q), sum(p.values()), sum(q.values())
    out = 0.0
    for k in keys:
        a, b = p.get(k, 0) / max(1, n), q.get(k, 0) / max(1, m)
        for x in (a, b):
            if x > 0:
                out += x * math.log2(2 * x / (a + b)) / 2
    return math.sqrt(max(0.0, out))


def test_verdict_agrees_with_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    own = {r.doc_id: (r.lang, brute(r.text), *histograms(r.text or "")) for r in docs}
    failed = lambda c: c[0] < 20 or 100 * c[4] > 30 * c[0]
    held = {}
    for lang, counts, chars, common in own.values():
        if lang in Q.LANGUAGES and not failed(counts):
            a, b = held.setdefault(lang, (Counter(), Counter()))
            a.update(chars)
            b.update(common)
    rejected = 0
    for r in queries.op3_quality_rules(spark, small).collect():
        lang, counts, chars, common = own[r.doc_id]
        worst = []
        for name, (a, b) in held.items():
            x, y = js(chars, a), js(common, b)
            worst.append((max(x / Q.MOST_CHARS if counts[0] >= 50 else 0, y / Q.MOST_COMMON if counts[0] >= 200 else 0), name, x, y))
        least = min(w for w, *_ in worst)
        assert any(abs(w - least) < 1e-9 and name == r.nearest and abs(x - r.char_distance) < 1e-9 and abs(y - r.word_distance) < 1e-9 for w, name, x, y in worst)
        assert r.kept == (not failed(counts) and least <= 1)
        rejected += not failed(counts) and least > 1
    assert rejected


def test_languages_without_a_reference(spark):
    text = " ".join(f"#{k}|{k}" for k in range(300))
    prose = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)} the of and" for k in range(100))
    rows = [(k, t, g) for k, (t, g) in enumerate([(prose, "en"), (text, "en"), (text, "xx"), (text, None), (prose, None)])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in Q.judge(frame, Q.references(frame.where("doc_id = 0"))).collect()}
    assert [got[k].kept for k in range(5)] == [True, False, True, False, True]
    assert [got[k].nearest for k in (0, 2, 4)] == ["en", None, "en"]


def test_names_that_clash(spark):
    frame = spark.createDataFrame([(1, "a b", "en", "x", "y")], "doc_id long, text string, lang string, KEPT string, N_words string")
    made = Q.judge(frame, Q.references(frame))
    assert made.columns[:3] == ["doc_id", "text", "lang"] and "KEPT" not in made.columns and len(made.columns) == 3 + len(Q.COUNTS) + 5
    assert Q.judge(frame.drop("lang"), {}).count() == 1
