import hashlib
import math
import random

import numpy as np

from quire.llm import queries
from quire.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int, ID string, v int"


def brute(rows, parts=8, entries=16, rounds=6):
    """{place of a row: (codes, error)}, and the codebooks, in Python's integers; rows: (id, vector, label)."""
    kept = [(k, i, [math.floor(x) * 4096 + math.floor((x - math.floor(x)) * 4096) if abs(x) < 2**40 else int(x) * 4096 for x in v]) for k, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    width = max({len(v) for _, _, v in kept}, key=lambda n: (sum(len(v) == n for _, _, v in kept), n))
    fit = [x for x in kept if len(x[2]) == width]
    least = {}
    for k, i, v in fit:
        key = (i is None, i or 0)
        if key not in least or rows[k][1] < least[key][0]:
            least[key] = rows[k][1], v
    starts = [least[key][1] for key in sorted(least)[:entries]]
    at = [p * width // parts for p in range(parts + 1)]
    books = [[v[a:b] for v in starts] for a, b in zip(at, at[1:])]
    far = lambda v, e: sum((x - y) ** 2 for x, y in zip(v, e))
    near = lambda v: [min((far(v[a:b], e), k) for k, e in enumerate(book)) for a, b, book in zip(at, at[1:], books)]
    for _ in range(rounds):
        codes = [near(v) for _, _, v in fit]
        new = []
        for p, (a, b) in enumerate(zip(at, at[1:])):
            mine = [[v[a:b] for (_, _, v), c in zip(fit, codes) if c[p][1] == e] for e in range(len(starts))]
            new.append([[sum(x) // len(m) for x in zip(*m)] if m else books[p][e] for e, m in enumerate(mine)])
        books = new
    out = {k: (None, None) for k, _, _ in kept}
    out |= {k: (bytes(c for _, c in near(v)), sum(d for d, _ in near(v))) for k, _, v in fit}
    return out, books


def check(spark, rows, partitions=3, **how):
    frame = spark.createDataFrame([(i, v, g, "x", k) for k, (i, v, g) in enumerate(rows)], SCHEMA).repartition(partitions)
    made = V.Codes(frame.select("vec_id", "embedding", "label"), **how)
    expected, books = brute(rows, **how)
    cap = lambda x: None if x is None else min(x, V.MOST_LONG)
    by = {}
    for k, (_, error) in expected.items():
        by.setdefault(rows[k][2], []).append(cap(error))
    sums = {g: cap(sum(e for e in errors if e is not None)) if any(e is not None for e in errors) else None for g, errors in by.items()}
    got = sorted(((r.id, r.label, None if r.codes is None else bytes(r.codes), r.error, r.label_error) for r in made.coded.collect()), key=repr)
    assert got == sorted(((rows[k][0], rows[k][2], c, cap(e), sums[rows[k][2]]) for k, (c, e) in expected.items()), key=repr)
    if books:
        assert made.codebooks == books
        assert made.digest() == hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return made


def vectors(rng, n, width):
    return [(i, [rng.gauss(i % 5, 0.4) for _ in range(width)], i % 3 or None) for i in range(n)]


def test_rounds_agree_with_brute_force(spark):
    rows = vectors(random.Random(1), 300, 32)
    made = check(spark, rows)
    assert len(made.shuffled) == 6 and made.shuffled[-1] <= made.shuffled[0]  # only what changes is summed


def test_settled_rounds_shuffle_nothing(spark):
    made = check(spark, [(k, [float(k % 4)] * 8, 1) for k in range(64)], entries=4)
    assert made.shuffled[1:] == [0] * 5


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = vectors(rng, 60, 19)
    rows += [(3, rows[3][1], 0), (3, [9.0] * 19, 0), (None, [0.0] * 19, 5), (-7, None, 1), (-6, [1.0, None] + [0.0] * 17, 1), (-5, [math.nan] * 19, 1), (-4, [math.inf] + [0.0] * 18, 1), (-3, [1.0, 2.0], 5), (-2, [], 6), (200, [-0.0] * 19, 7)]
    check(spark, rows)
    check(spark, rows, parts=3, entries=200, rounds=2)


def test_huge_components_are_exact(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([1e300, -1e300, 1e18, -1e17, 3.7, 2.0**52 + 0.5, -0.1]) for _ in range(8)], k % 2) for k in range(40)]
    check(spark, rows, entries=5, rounds=3)


def test_few_and_none(spark):
    check(spark, vectors(random.Random(4), 3, 16))
    check(spark, [(None, [1.0] * 8, None), (None, [0.5] * 8, None)])
    check(spark, [(1, None, 1)])
    check(spark, [])
    check(spark, [(k, [], 1) for k in range(4)])


def test_a_float_table_with_clashing_names(spark):
    rows = vectors(random.Random(5), 50, 8)
    frame = spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], "vec_id long, embedding array<float>, label int, codes string, error int")
    expected, _ = brute([(i, [float(np.float32(x)) for x in v], g) for i, v, g in rows])
    assert {r.id: (bytes(r.codes), r.error) for r in V.Codes(frame).coded.collect()} == {rows[k][0]: x for k, x in expected.items()}


def test_query(spark, small):
    rows = queries.op11_vector_codes(spark, small).collect()
    given = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    expected, _ = brute(given)
    assert {r.vec_id: (r.code, r.error) for r in rows} == {given[k][0]: (c.hex(), e) for k, (c, e) in expected.items()}
    assert len({r.codebooks_sha256 for r in rows}) == 1
