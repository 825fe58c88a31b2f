import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import ngram_join as J
from quire.llm import queries


def shingles(text, size=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size=4, percent=85):
    """(id, text) rows without repeated ids -> {id: (n_shingles, component)}"""
    sets = {i: shingles(t, size) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, s in sets.items():
        shared = defaultdict(int)
        for x in s:
            for j in holders[x]:
                shared[j] += 1
        for j, n in shared.items():
            if 100 * n >= percent * len(s | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, gid string, component int")
    return [tuple(r) for r in J.similar_components(frame, **options).collect()]


def near_copies(seed, bases, copies, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(bases):
        base = rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 14, 25, 60, 150, 400]))
        for _ in range(rng.randint(1, copies)):
            words = base.copy()
            for _ in range(rng.randint(0, edits)):
                k = rng.randrange(len(words))
                how = rng.random()
                words[k : k + 1] = [] if how < 0.3 and len(words) > 1 else [rng.choice(vocabulary)] * (1 if how < 0.7 else 2)
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_brute_force(spark, seed):
    rows = near_copies(seed, 60, 12, 6)
    assert {i: (n, c) for i, n, c in run(spark, rows)} == brute(rows)


def test_large_groups_agree_with_brute_force(spark, monkeypatch):
    rows = near_copies(5, 8, 80, 12)
    for name, value in (("GROUP_DOCS", 10), ("CHUNK", 500), ("PIVOTS", 3), ("QUERIES", 300), ("FOLDED", 20), ("MET", 30)):
        monkeypatch.setattr(J, name, value)
    assert {i: (n, c) for i, n, c in run(spark, rows)} == brute(rows)


def test_shuffle_joins_agree_with_broadcasts(spark, monkeypatch):
    rows = near_copies(6, 30, 10, 5)
    monkeypatch.setattr(J, "BROADCAST_ROWS", -1)
    assert {i: (n, c) for i, n, c in run(spark, rows)} == brute(rows)


def test_query_agrees_with_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    got = {i: (n, c) for i, n, c in queries.op1_ngram_join(spark, small).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("scheme", [(3, 1), (5, 2), (4, 1)])
def test_every_linked_pair_shares_a_signature(scheme):
    rng = np.random.default_rng(3)
    bands = J.Bands(85, scheme)
    for size in [7, 8, 11, 13, 20, 37, 80, 200, 700]:
        for _ in range(40):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            drop, add = rng.integers(0, size // 6 + 1, 2)
            other = np.unique(np.concatenate([base[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            base = np.unique(base)
            both = len(np.intersect1d(base, other))
            if 100 * both >= 85 * (len(base) + len(other) - both) and len(base) + len(other) > 2 * both:
                assert len(np.intersect1d(J.signatures(base, bands), J.signatures(other, bands)))


def test_edge_rows(spark):
    long = " ".join(f"x{k % 977}" for k in range(30000))
    rows = [(5, None), (6, ""), (7, " \t\n"), (9, "One two"), (8, "one TWO"), (None, "one two"), (10, long), (11, long + " y"), (11, long + " y"), (12, "É ß"), (13, "é ß")]
    got = sorted(run(spark, rows), key=str)
    expected = [(5, 0, 5), (6, 0, 6), (7, 0, 7), (9, 1, 8), (8, 1, 8), (None, 1, None), (12, 1, 12), (13, 1, 13)]
    n = len(shingles(long))
    expected += [(10, n, 10), (11, n + 1, 10), (11, n + 1, 10)]
    assert got == sorted(expected, key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_common_passages_agree_with_brute_force(spark, monkeypatch):
    """Short texts around one passage fill buckets with sets that are and aren't alike."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(300):
        words = [f"u{rng.randrange(5000)}" for _ in range(rng.choice([6, 10, 14, 40]))]
        rows.append((k, " ".join(words[: len(words) // 2] + passage + words[len(words) // 2 :])))
    monkeypatch.setattr(J, "PAIRED", 2)
    assert {i: (n, c) for i, n, c in run(spark, rows)} == brute(rows)
    assert {i: (n, c) for i, n, c in run(spark, rows, size=5, percent=80)} == brute(rows, 5, 80)


def test_members_that_are_only_joined_to_the_least_set(spark, monkeypatch):
    """Set 1 is joined to set 0 by one signature, and meets its near copy 2 only in a bucket that set 0 leads."""
    words = lambda k: [f"t{k}w{i}" for i in range(40)]
    rows = [(k, " ".join(words(1)[:-1] + ["other"] if k == 2 else words(k))) for k in range(100)]
    features = [x for _, x in J._sets(pa.array([t for _, t in rows]), 4)]
    own = defaultdict(list)
    for value, members in ((7 << 40, [0, 1, *range(20, 100)]), (9 << 40, range(10))):
        for k in members:
            own[features[k].tobytes()].append(value)
    own = dict(own)
    monkeypatch.setattr(J, "signatures", lambda features, bands: np.array(own.get(features.tobytes(), []), np.uint64))
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {i: (n, c) for i, n, c in J.similar_components(frame).collect()} == brute(rows)


@pytest.mark.parametrize("large", [False, True])
def test_ids_with_several_texts(spark, monkeypatch, large):
    """Rows of one id are one document, also where one of its texts is a copy of an earlier document."""
    if large:
        for name, value in (("GROUP_DOCS", 2), ("CHUNK", 100), ("PIVOTS", 1), ("QUERIES", 100)):
            monkeypatch.setattr(J, name, value)
    text = lambda k, last="": " ".join([*(f"t{k}w{i}" for i in range(40)), last])
    rows = [(3, text(1)), (5, text(1)), (5, text(2)), (9, text(2, "more")), (11, text(2, "less")), (20, text(3)), (21, text(3)), (21, ""), (30, text(4)), (31, text(5)), (31, text(4)), (40, text(6)), (40, text(7)), (41, text(7))]
    rows += [(50 + k, text(1, f"x{k}")) for k in range(6)] + [(60, text(8)), (61, text(8)), (None, text(1))]
    least = {3: 3, 5: 3, 9: 3, 11: 3, 20: 20, 21: 20, 30: 30, 31: 30, 40: 40, 41: 40, 60: 60, 61: 60, None: None, **{50 + k: 3 for k in range(6)}}
    got = sorted(run(spark, rows), key=str)
    assert got == sorted(((i, len(shingles(t)), least[i]) for i, t in rows), key=str)


def test_an_id_with_two_texts_links_what_either_links(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(n)) for x, n in (("a", 100), ("b", 200)))
    got = sorted(run(spark, [(1, a), (5, a), (5, b), (7, b + " z")]))
    assert got == [(1, 97, 1), (5, 97, 1), (5, 197, 1), (7, 198, 1)]


def test_columns_that_clash(spark):
    frame = spark.createDataFrame([(k, "one two three four five", "r", 1, 2, "x") for k in (4, 3)], "doc_id long, text string, Rep string, N int, salt int, SKETCH string")
    assert sorted(tuple(r) for r in J.similar_components(frame).collect()) == [(3, 2, 3), (4, 2, 3)]
