import math
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import mixing, queries

SCHEMA = "doc_id long, text string, source string, epoch string, tokens int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "e", 0) for i, t, s in rows], SCHEMA)


def corpus(seed, n=400):
    rng = random.Random(seed)
    sources = ["big"] * 20 + ["mid"] * 4 + ["small", None]
    return [(i, "w " * rng.randint(1, 40), rng.choice(sources)) for i in range(n)]


@pytest.fixture(params=[mixing.MOST_SOURCES, 0])
def bound(request, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", request.param)


def test_budget_none_leaves_nothing_out(spark, bound, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 10)
    rows = corpus(1)
    mixture = mixing.Mixture(frame(spark, rows), max_repeats=2.0, block_tokens=500)
    total = Counter()
    for i, t, s in rows:
        total[s] += len(t) // 2
    epochs = {r.source: r.epochs for r in mixture.weights.collect()}
    assert min(epochs.values()) == 1 and abs(max(epochs.values()) - 2) < 1e-6
    z = sum((v / sum(total.values())) ** mixture.exponent for v in total.values())
    for r in mixture.weights.collect():
        assert abs(r.weight - (total[r.source] / sum(total.values())) ** mixture.exponent / z) < 1e-9
    plan = mixture.schedule().collect()
    uses = Counter(r.doc_id for r in plan)
    assert set(uses) == {i for i, *_ in rows} and max(uses.values()) <= 2
    by = defaultdict(list)
    for r in plan:
        by[r.source].append(r)
    for source, own in by.items():
        assert [r.place for r in sorted(own, key=lambda r: (r.place, r.n_tokens))][-1] <= epochs[source] * total[source] + 1
        assert sum(r.n_tokens for r in own) > epochs[source] * total[source] - 40
        places = sorted((r.place, r.n_tokens) for r in own)
        assert all(p == sum(n for _, n in places[: k + 1]) for k, (p, _) in enumerate(places))
    real = Counter(r.doc_id for r in mixture.realise().collect())
    assert real == uses
    shares = Counter((r.block, r.source) for r in plan for _ in range(r.n_tokens))
    for b in range(2, mixture.blocks):
        assert abs(shares[b, "big"] / sum(v for (x, _), v in shares.items() if x == b) - 1 / z * (total["big"] / sum(total.values())) ** mixture.exponent) < 0.15


def test_budget_and_entropy(spark):
    rows = corpus(2)
    mixture = mixing.Mixture(frame(spark, rows), budget=1500, target_entropy=0.8, max_repeats=None)
    weights = [r.weight for r in mixture.weights.collect()]
    assert abs(-sum(w * math.log(w) for w in weights) - 0.8 * math.log(4)) < 1e-6
    plan = mixture.schedule().collect()
    for source, weight in ((r.source, r.weight) for r in mixture.weights.collect()):
        used = sum(r.n_tokens for r in plan if r.source == source)
        assert weight * 1500 - 41 < used <= weight * 1500 + 1
    assert Counter(r.doc_id for r in mixture.realise().collect()) == Counter(r.doc_id for r in plan)


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", "a"), (3, "w " * 50000, "a"), (4, "x", "b"), (4, "x", "b"), (None, "y", "b")]
    mixture = mixing.Mixture(frame(spark, rows), max_repeats=3)
    plan = Counter((r.doc_id, r.source) for r in mixture.schedule().collect())
    assert plan[1, None] == 1 and plan[2, "a"] == 1 and plan[3, "a"] == 1 and plan[4, "b"] in (4, 6) and plan[None, "b"] in (2, 3)
    real = mixture.realise()
    assert Counter((r.doc_id, r.source) for r in real.collect()) == plan and real.columns == ["doc_id", "text", "source", "epoch", "tokens"]
    empty = mixing.Mixture(frame(spark, []))
    assert empty.schedule().count() == 0 and empty.realise().count() == 0
    alone = mixing.Mixture(frame(spark, [(1, "a b", "s"), (2, "c", "s")]))
    assert alone.exponent == 1 and alone.schedule().count() == 2


def spark_hash(*values):
    """Spark's xxhash64: each value is hashed with the hash of those before it as the seed; null changes nothing."""
    seed = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True)
            seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def brute_schedule(docs, limit):
    """(doc_id, source, n_tokens, epoch, block, place) of (doc_id, source, n_tokens) rows with distinct ids and no budget."""
    tokens, count = Counter(), Counter()
    for _, s, n in docs:
        tokens[s] += n
        count[s] += 1
    total, used = sum(tokens.values()), {s: n for s, n in tokens.items() if n}
    most, least = max(used.values()), min(used.values())
    a = 1.0 if len(used) < 2 else max(0.0, 1 - math.log(limit) / math.log(most / least)) if most > least else 0.0
    z = sum((n / total) ** a for n in used.values())
    budget = z * most / (most / total) ** a
    ranges, out = max(1, max(count.values()) // mixing.RANGE), []
    blocks = max(1, math.ceil(budget / 1_000_000 - 1e-9))
    for s in tokens:
        epochs = (used[s] / total) ** a / z * budget / used[s] if s in used else 1.0
        epochs = round(epochs) if abs(epochs - round(epochs)) < 1e-9 else epochs
        for e in range(max(1, math.ceil(epochs))):
            own, at = [], e * tokens[s]
            for i, source, n in docs:
                if source == s:
                    h = spark_hash(mixing.SEED, None if i is None else (i, 8), (e, 4))
                    own.append(((h >> 24) % ranges, h, i, n))
            for *_, i, n in sorted(own):
                at += n
                if at <= epochs * tokens[s] + 1e-6 or n == 0:
                    quota = epochs * tokens[s]
                    block = min(blocks, max(1, math.ceil(at / quota * blocks))) if quota > 0 else 1
                    out.append((i, s, n, e, block, at))
    return out


def test_query_agrees_with_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 40)
    docs = [(r.doc_id, r.source, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op4_mixing(spark, small).collect())
    assert got == sorted(brute_schedule(docs, 2.0))


def test_limits_that_cannot_be_met_are_told(spark):
    rows = corpus(3)
    assert mixing.Mixture(frame(spark, rows)).met
    beyond = mixing.Mixture(frame(spark, rows), budget=1e9, max_repeats=2.0)
    assert not beyond.met and beyond.exponent == 1.0
    assert not mixing.Mixture(frame(spark, rows), target_entropy=0.01, max_repeats=None).met
    assert mixing.Mixture(frame(spark, [])).met


def test_names_that_clash(spark):
    schema = "doc_id long, text string, source string, _source string, _epoch int, _cut int, _whole boolean, __Source string, __cut int, WEIGHT double"
    docs = spark.createDataFrame([(k, "a b", "s" if k % 3 else "t", "x", 1, 2, True, "y", 3, 0.5) for k in range(9)], schema)
    mixture = mixing.Mixture(docs)
    made = mixture.realise()
    assert made.columns == docs.columns and {r["__Source"] for r in made.collect()} == {"y"}
    assert Counter(r.doc_id for r in made.collect()) == Counter(r.doc_id for r in mixture.schedule().collect())


def test_rows_without_an_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 100)
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("other words").alias("text"), F.lit("t").alias("source")))
    mixture = mixing.Mixture(docs)
    rows = mixture.schedule().where("source = 's'").collect()
    assert len(rows) == 5000 and len({r.place for r in rows}) == 5000
    assert mixture.realise().where("source = 's'").count() == 5000
    cut = mixing.Mixture(docs, budget=6000.0, max_repeats=None, target_entropy=None)
    assert cut.realise().count() == cut.schedule().count()
