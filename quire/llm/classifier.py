"""A text-quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its words, its pairs of neighbouring words, the same of
the words' shapes (runs of letters, capitals, digits, marks), and pairs that
repeat a word, hashed to 2^18 buckets. A bucket's value is 1 + ln(count), and a
text's values have length one, so long texts don't outweigh short ones.

Training takes at most `max_rows` labelled rows, those with the least hashes of
their ids (ties by id and label, rows of one id by a digest of the text). Their
features are made where the texts lie and brought to one task, which returns
the weights. Scoring is a map over Arrow batches with sparse dot products.

Defined results: null and empty texts have no features and get the bias alone;
very long texts are read whole, and weigh no more than others; of a word's
shape the first six runs tell; an empty table stays empty; without any labelled
row all scores are 0.5; rows with null labels or ids teach nothing; repeated
rows get equal scores; columns of the input are passed on, one named `score`
(in any case) is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.columns import without
from quire.llm.kernel import Words, give_back, mix, pieces

BITS = 18
MAX_ROWS = 6000

_SHAPE = np.full(256, 7, np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[0x80:] = 1, 2, 3, 1
_SHAPE[list(b".,;:!?'\"-()")] = 5
_SHAPE[list(b"!")] = 6


def _shapes(words: Words) -> np.ndarray:
    """Hashes of the words' shapes, with runs of one class folded to one mark."""
    kind = _SHAPE[words.data]
    head = words.word.copy()
    head[1:] &= (kind[1:] != kind[:-1]) | ~words.word[:-1]
    head[words.start] = True
    places = np.flatnonzero(head)
    first = np.searchsorted(places, words.start)
    count = np.searchsorted(places, words.end) - first
    out = mix(np.minimum(count, 8).astype(np.uint64) + np.uint64(99))
    for k in range(6):  # the first six runs tell
        at = np.minimum(first + k, max(0, len(places) - 1))
        mark = np.where(count > k, kind[places[at]], 0) if len(places) else np.zeros(0)
        out = mix(out * np.uint64(11) + mark.astype(np.uint64))
    return out


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, values) of each text."""
    for _, at, data in pieces(column):
        plain = Words(at, data, lower=True)
        shapes = _shapes(Words(at, data, hashed=False))
        views = []
        for salt, tokens in ((1, plain.hash), (2, shapes)):
            views.append((mix(tokens + np.uint64(salt)), 1))
            views.append((mix(tokens[:-1] * np.uint64(0x2545F4914F6CDD1D) + tokens[1:] + np.uint64(salt + 10)), 2))
        again = plain.hash[:-1] == plain.hash[1:]
        buckets = [(v >> np.uint64(64 - BITS)).astype(np.int64) for v, _ in views]
        for a, b in zip(plain.bounds[:-1].tolist(), plain.bounds[1:].tolist()):
            if a == b:
                yield np.zeros(0, np.int64), np.zeros(0)
                continue
            own = np.concatenate([x[a : b - n + 1] for x, (_, n) in zip(buckets, views)] + [np.zeros(int(again[a : b - 1].sum()), np.int64)])
            index, count = np.unique(own, return_counts=True)
            value = 1 + np.log(count)
            yield index, value / np.sqrt(value @ value)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = 4, alpha: float = 8.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """Weights by bucket, and the bias in the last place; rows are taken in order."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(index):
        zi = z[index]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(n[index])) / alpha + l2))

    for _ in range(passes):
        for index, value, label in rows:
            index, value = np.append(index, size - 1), np.append(value, 1.0)
            w = weights(index)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / alpha
            z[index] += g - sigma * w
            n[index] += g * g
    return weights(np.arange(size)).astype(np.float32)


def fold_loss(rows: list[tuple[np.ndarray, np.ndarray, int]], folds: int = 3, **steps: float) -> float:
    """Mean log loss of rows under weights that were learned from the other folds: what the defaults of `ftrl` were chosen by.

    Rows are dealt to folds by their place. Only rows that may teach belong here.
    """
    losses = []
    for fold in range(folds):
        weights = ftrl([r for k, r in enumerate(rows) if k % folds != fold], **steps)
        for index, value, label in rows[fold::folds]:
            p = 1 / (1 + np.exp(-np.clip(weights[index] @ value + weights[-1], -35, 35)))
            losses.append(-np.log(max(p if label else 1 - p, 1e-6)))
    return float(np.mean(losses))


def _by_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, digest, text, label) with the text's features in its place."""
    names = ["order", "digest", "label", "index", "value"]
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            found = [(i.astype("<i4").tobytes(), v.astype("<f4").tobytes()) for i, v in features(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *(pa.array([f[k] for f in found], pa.binary()) for k in (0, 1))], names=names)
    give_back()


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights learned from `labels` (key, label 0 or 1); of them, `max_rows` with the least hashes are used.

    Texts are read and made features where they lie; only the features of at most `max_rows` rows are brought together.
    """
    order = F.xxhash64(F.col(key).cast("string"), F.lit("train"))
    few = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), order.alias("order")).orderBy("order", "key", "label").limit(max_rows)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(few), "key").select("order", F.xxhash64("text").alias("digest"), "text", "label")
    # Rows that share an id could be many: the bound holds for them as well.
    held = rows.mapInArrow(_by_features, "order long, digest long, label int, index binary, value binary").orderBy("order", "digest", "label").limit(max_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            order, digest, label, index, value = (c.to_pylist() for c in batch.columns)
            got += zip(order, digest, label, index, value)
        got.sort()
        if got:
            made = ftrl([(np.frombuffer(i, "<i4"), np.frombuffer(v, "<f4"), y) for _, _, y, i, v in got])
            yield pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary())], names=["weights"])
            got.clear()
        give_back()

    found = held.repartition(1).mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(bytes(found[0]["weights"]), np.float32) if found else np.zeros((1 << BITS) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Adds `score`, from 0 to 1."""
    kept = without(docs.columns, ["score"])
    schema = T.StructType([f for f in docs.schema.fields if f.name in kept] + [T.StructField("score", T.DoubleType())])
    used = np.flatnonzero(weights[:-1])
    sparse, values, bias = used.astype(np.int32), weights[used], float(weights[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        dense = np.zeros(1 << BITS)
        dense[sparse] = values
        for batch in batches:
            sums = np.array([dense[index] @ value for index, value in features(batch.column(batch.schema.get_field_index(text)))])
            old = [batch.column(batch.schema.get_field_index(c)).cast(target.field(c).type) for c in kept]
            yield pa.RecordBatch.from_arrays([*old, pa.array(1 / (1 + np.exp(-(sums + bias))), pa.float64())], schema=target)
        give_back()

    return docs.mapInArrow(run, schema)
