import random
import re
from collections import Counter, defaultdict

import numpy as np

from quire.llm import divergence as D
from quire.llm import queries


def brute(rows, least=10, top=10):
    """Rows of the report; rows: (text, lang, source)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(low))
        n[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, k in docs[lang].items() if k >= least)
        share = lambda c: [1 + 10**9 * (c[t] + 2) // (sum(c[t] for t in kept) + 2 * len(kept)) for t in kept]
        far = lambda p, q: (p - q) ** 2 // (p + q)
        own = {s: share(c) for (g, s), c in n.items() if g == lang}
        whole = share(sum((c for (g, _), c in n.items() if g == lang), Counter()))
        for s, p in own.items():
            pairs = sorted(((-sum(map(far, p, q)), o.encode()) for o, q in own.items() if o != s))
            terms = sorted((-far(x, y), t.encode()) for t, x, y in zip(kept, p, whole) if n[lang, s][t] and x > y)[:top]
            out += [(lang, s, part, i.decode(), -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


def check(spark, rows, **how):
    frame = spark.createDataFrame([(t, g, s, 1, "x") for t, g, s in rows], "text string, lang string, source string, n int, term string").repartition(3)
    got = sorted(map(tuple, D.Audit(frame, **how).report().collect()))
    assert got == brute(rows, how.get("least_docs", 10), how.get("top", 10))
    return got


def corpus(rng, n, sources=7):
    words = ["alpha", "Beta", "été", "ÉTÉ", "naïve", "x", "漢字", "á", "z" * 30, "the", "of"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    rows = []
    for _ in range(n):
        source = rng.randrange(sources)
        text = "".join(rng.choice(words[: 20 + 10 * source]) + rng.choice([" ", ", ", "\n", "1", "_", "\x00", "-"]) for _ in range(rng.randrange(60)))
        rows.append((text, rng.choice(["en", "de"]), f"s{source}"))
    return rows


def test_reports_agree_with_brute_force(spark):
    rows = corpus(random.Random(1), 400)
    assert check(spark, rows)
    check(spark, rows, chunk=8, slab=2, block=2)  # many chunks, slabs and tiles
    check(spark, rows, chunk=1, slab=1, block=1, least_docs=40, top=3)


def test_odd_rows(spark):
    rows = corpus(random.Random(2), 200, 3)
    rows += [(None, "en", "s0"), ("", "en", "empty"), ("123 !!", "en", "no words"), (None, None, None), ("alone here", "xx", "only"), ("rare", "yy", "a"), ("words", "yy", "b"), ("the of", None, "s1"), ("the of", "", "s1")]
    rows += [rows[0]] * 50 + [("long " * 50_000 + "tail", "en", "s2")] * 10
    check(spark, rows, chunk=16, slab=2, block=2)


def test_empty_table(spark):
    assert check(spark, []) == []
    assert check(spark, [(None, "en", "a"), (None, "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_counts_are_given_away_before_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(D, "HELD", 5)
    rows = corpus(random.Random(3), 100)
    check(spark, rows, least_docs=3)


def test_shares_of_large_counts_are_exact():
    for total, terms in ((10**6, 50), (2**52 - 10**6, 1000), (10**17, 10**6)):
        n = [0, 1, 12345, total // 3, total]
        assert shares_of(n, total, terms) == [1 + 10**9 * (x + 2) // (total + 2 * terms) for x in n]


def shares_of(n, total, terms):
    return D.shares(np.array(n, np.int64), total, terms).tolist()


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text", "lang", "source").collect()
    assert sorted(map(tuple, queries.op12_divergence(spark, small).collect())) == brute([tuple(r) for r in docs])
