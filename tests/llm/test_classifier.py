import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import classifier, queries
from quire.llm.kernel import Words


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op7_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.predicted, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    good = [p for p, q in held if q == 1]
    bad = [p for p, q in held if q == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.05 * len(bad)


def test_scores_agree_with_plain_sums(spark):
    rng = np.random.default_rng(1)
    weights = rng.normal(size=(1 << classifier.BITS) + 1).astype(np.float32)
    texts = ["a b c", "", None, "A!! B!! A!! B!!", "x x x", "wort " * 1000, "a b c"]
    frame = spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in classifier.score(frame, weights).collect()}
    for k, (index, value) in enumerate(classifier.features(pa.array(texts))):
        total = sum(float(weights[i]) * v for i, v in zip(index.tolist(), value.tolist())) + float(weights[-1])
        assert abs(got[k] - 1 / (1 + np.exp(-total))) < 1e-9
        assert not len(value) or abs(value @ value - 1) < 1e-9
    assert got[1] == got[2] and got[0] == got[6]


def test_features_count_words_and_pairs():
    sizes = [len(i) for i, _ in classifier.features(pa.array(["one", "one two", "one one", "", "é É"]))]
    assert sizes[:4] == [2, 5, 5, 0]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    weights = classifier.train(docs, labels)
    assert not weights.any()
    assert [r.score for r in classifier.score(docs, weights).collect()] == [0.5, 0.5]
    assert classifier.score(docs.limit(0), weights).count() == 0


def plain_ftrl(rows, passes, alpha, beta, l1, l2):
    """The published per-coordinate update, with dictionaries and floats."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(passes):
        for index, value, label in rows:
            own = {**dict(zip(index.tolist(), map(float, value))), "bias": 1.0}
            w = {i: weight(i) for i in own}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in own.items())))
            for i, v in own.items():
                g, old = (p - label) * v, n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / alpha * w[i]
    return weight, z


def test_training_agrees_with_another_implementation(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choices(words[:40] if k % 3 else words[20:], k=rng.randint(1, 30))) for k in range(200)]
    labels = [int(k % 3 > 0) for k in range(200)]
    rows = [(i, v.astype(np.float32), y) for (i, v), y in zip(classifier.features(pa.array(texts)), labels)]
    for steps in (dict(passes=4, alpha=8.0, beta=1.0, l1=0.02, l2=0.02), dict(passes=1, alpha=0.5, beta=0.3, l1=0.2, l2=0.0)):
        got = classifier.ftrl(rows, **steps)
        weight, seen = plain_ftrl(rows, **steps)
        for i in seen:
            assert abs(got[-1 if i == "bias" else i] - weight(i)) < 1e-4
        assert set(np.flatnonzero(got[:-1]).tolist()) <= set(seen)
    # The same rows through Spark: in the order of their hashed ids.
    ids = [3 * k + 1 for k in range(200)]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    known = spark.createDataFrame(list(zip(ids, labels)), "doc_id long, quality int").repartition(3)
    order = {r[0]: r[1] for r in known.select("doc_id", F.xxhash64(F.col("doc_id").cast("string"), F.lit("train"))).collect()}
    by = sorted(range(200), key=lambda k: order[ids[k]])
    assert np.array_equal(classifier.train(docs, known), classifier.ftrl([rows[k] for k in by]))
    assert np.array_equal(classifier.train(docs, known, max_rows=50), classifier.ftrl([rows[k] for k in by[:50]]))


def test_rows_of_one_id_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(1, f"text {k % 7}") for k in range(100)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    weights = classifier.train(docs, labels, max_rows=3)
    assert np.array_equal(weights, classifier.train(docs.repartition(7), labels, max_rows=3)) and weights.any()


def test_fold_loss_prefers_useful_steps():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdef" if k % 2 else "defghi", k=12)) for k in range(120)]
    rows = [(i, v, k % 2) for k, (i, v) in enumerate(classifier.features(pa.array(texts)))]
    assert classifier.fold_loss(rows) < classifier.fold_loss(rows, alpha=0.001) < 0.7


def test_words_of_two_letters_do_not_collide():
    """Thue-Morse words: a hash that is linear modulo 2^64 gives these pairs one value."""
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
        raw = a.encode() + b" " + b.encode()
        x, y = Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)).hash.tolist()
        assert x != y
    words = ["a" * n for n in range(1, 40)] + ["b" + "a" * n for n in range(40)] + ["a\0", "a\0\0"]
    raw = " ".join(words).encode()
    hashes = Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8)).hash.tolist()
    assert len(set(hashes)) == len(set(words))
    again = Words(np.array([0, 3 + len(raw)]), np.frombuffer(b"xy " + raw, np.uint8)).hash.tolist()
    assert again[1:] == hashes


def test_a_score_in_another_case_is_replaced(spark):
    frame = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, SCORE string")
    assert classifier.score(frame, np.zeros((1 << classifier.BITS) + 1, np.float32)).columns == ["doc_id", "text", "score"]
