"""Temperature mixing: sources sampled by powers of their token shares, in exact, budgeted block permutations.

A source with share p gets weight p^a / sum of p^a; the exponent a between 0
(all alike) and 1 (as they are) is found by bisection: the least one that keeps
every source's epochs within `max_repeats` and the weights' entropy within
`target_entropy` (a fraction of that of equal weights), if given.

A source's budget, weight times all tokens, is whole epochs and a part of one.
Each epoch is a permutation of its own by keyed hashes; the last one is cut
where its tokens are used up. A document's place in its source's budget gives
its block, so every block holds the sources by weight.

Without `budget`, it is chosen so that the source which is repeated least is
used exactly once; nothing is left out then.

Places are running sums over hash ranges: sums of ranges first, then within
each, so no task gets a whole source. Only ids, hashes and counts are shuffled;
texts stay where they are. The driver holds numbers by source, up to
`MOST_SOURCES`; beyond that, each step of the bisection is a query.

Defined results: a null source is a source; documents without tokens are in
every epoch of their source, at no cost, also where the budget is used up; a
source without tokens is used once; rows that share an id are rows of their
own, with one place in the permutation, those without an id by their texts; very long texts are counted whole; an
empty table gives no rows. `realise` returns the columns of the input and no
others, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.columns import fresh
from quire.llm.workspace import Workspace

MOST_SOURCES = 50_000
#: Documents of a hash range, about.
RANGE = 4000
SEED = "mix"


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


class Shares:
    """Moments of the sources' token counts under an exponent."""

    def __init__(self, sources: DataFrame, n: int):
        used = sources.where("tokens > 0").select(F.col("tokens").cast("double").alias("t"))
        self.frame, self.local = used, None
        if n <= MOST_SOURCES:
            self.local = np.array([r["t"] for r in used.collect()])
            self.n, self.total, self.most, self.least = (len(self.local), *(float(f(self.local)) if len(self.local) else 0.0 for f in (np.sum, np.max, np.min)))
        else:
            row = used.agg(F.count("*"), F.sum("t"), F.max("t"), F.min("t")).first()
            self.n, self.total, self.most, self.least = row[0], row[1] or 0.0, row[2] or 0.0, row[3] or 0.0

    def sums(self, a: float) -> tuple[float, float]:
        """Sum of p^a, and of p^a * ln(p^a)."""
        if self.local is not None:
            w = (self.local / self.total) ** a
            return float(w.sum()), float((w * np.log(w)).sum())
        w = F.pow(F.col("t") / self.total, F.lit(a))
        row = self.frame.agg(F.sum(w), F.sum(w * F.log(w))).first()
        return row[0], row[1]

    def entropy(self, a: float) -> float:
        z, s = self.sums(a)
        return math.log(z) - s / z

    def repeats(self, a: float, budget: float | None) -> float:
        """Epochs of the source that is repeated most; for an exponent up to 1 it is the least one."""
        if budget is None:
            return (self.most / self.least) ** (1 - a)
        z, _ = self.sums(a)
        return budget * (self.least / self.total) ** a / z / self.least


def exponent(shares: Shares, budget: float | None, target_entropy: float | None, max_repeats: float | None, steps: int = 50) -> float:
    """The least exponent in [0, 1] within both limits; 1 if even that is beyond one (`Mixture.met` tells)."""
    if shares.n < 2:
        return 1.0
    limits = budget, target_entropy, max_repeats
    if within(shares, 0.0, *limits):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if within(shares, middle, *limits) else (middle, high)
    return high


def within(shares: Shares, a: float, budget: float | None, target_entropy: float | None, max_repeats: float | None) -> bool:
    """Whether an exponent keeps to the limits that are given."""
    if not shares.n:
        return True
    fits = max_repeats is None or shares.repeats(a, budget) <= max_repeats * (1 + 1e-12)
    return fits and (target_entropy is None or shares.n < 2 or shares.entropy(a) <= target_entropy * math.log(shares.n) + 1e-12)


class Mixture:
    """`exponent`, and `met`: whether it keeps to the limits; `weights`: source, docs, tokens, weight, epochs; `schedule`: one row for each use of a document; `realise`: the documents themselves."""

    def __init__(self, docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", tokens=count_words, budget: float | None = None, target_entropy: float | None = None, max_repeats: float | None = 2.0, block_tokens: int = 1_000_000, seed: str = SEED):
        self.docs, self.key, self.source, self.seed, self.tokens, self.text = docs, key, source, seed, tokens(F.col(text)), text
        work = Workspace(docs.sparkSession)
        self.rows = work.table(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), self.tokens.alias("n_tokens"), self._salt(F.col(key), F.col(text)).alias("salt")))
        counted = work.table(self.rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")))
        self.n = counted.count()
        shares = Shares(counted, self.n)
        self.exponent = a = exponent(shares, budget, target_entropy, max_repeats)
        #: Whether the limits could be met; if not, sources are mixed as they are.
        self.met = within(shares, a, budget, target_entropy, max_repeats)
        z = shares.sums(a)[0] if shares.n else 1.0
        if budget is None:
            budget = z * shares.most / (shares.most / shares.total) ** a if shares.n else 0.0
        self.budget, self.blocks = budget, max(1, math.ceil(budget / block_tokens))
        weight = F.pow(F.col("tokens") / F.lit(shares.total or 1.0), F.lit(a)) / F.lit(z)
        full = F.when(F.col("tokens") > 0, weight * F.lit(budget) / F.col("tokens")).otherwise(F.lit(1.0))
        near = F.when(F.abs(full - F.round(full)) < 1e-9, F.round(full)).otherwise(full)  # a whole epoch, but for rounding
        self.weights = counted.select("source", "docs", "tokens", F.when(F.col("tokens") > 0, weight).otherwise(0.0).alias("weight"), near.alias("epochs"))
        self.ranges = max(1, (counted.agg(F.max("docs")).first()[0] or 1) // RANGE)

    @staticmethod
    def _salt(key: Column, text: Column) -> Column:
        """Rows without an id are told apart by their texts; null, which changes no hash, for all others."""
        return F.when(key.isNull(), F.xxhash64(text))

    def _hash(self, key: Column, epoch: Column, salt: Column) -> Column:
        return F.xxhash64(F.lit(self.seed), key, epoch, salt)

    def _sized(self, frame: DataFrame) -> DataFrame:
        return F.broadcast(frame) if self.n <= MOST_SOURCES else frame

    def schedule(self) -> DataFrame:
        """doc_id, source, n_tokens, epoch, block, place: see `_placed`."""
        return self._placed().drop("salt")

    def _placed(self) -> DataFrame:
        """doc_id, source, n_tokens, epoch, block, place (tokens of the source's budget used with this document)."""
        side = self._sized(self.weights.select(F.col("source").alias("s"), "tokens", "epochs"))
        used = self.rows.join(side, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        used = used.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil("epochs").cast("int") - 1))))
        used = used.withColumn("h", self._hash(F.col("doc_id"), F.col("epoch"), F.col("salt")))
        used = used.withColumn("part", F.pmod(F.shiftright("h", 24), F.lit(self.ranges)))
        own = ["source", "epoch", "part"]
        sums = used.groupBy(*own).agg(F.sum("n_tokens").alias("sum"))
        before = F.sum("sum").over(Window.partitionBy("source", "epoch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.select(*(F.col(c).alias(f"_{c}") for c in own), F.coalesce(before, F.lit(0)).alias("before"))
        running = F.sum("n_tokens").over(Window.partitionBy(*own).orderBy("h", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        placed = used.withColumn("running", running).join(sums, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in own])
        placed = placed.withColumn("place", F.col("epoch") * F.col("tokens") + F.col("before") + F.col("running"))
        quota = F.col("epochs") * F.col("tokens")
        placed = placed.where((F.col("place") <= quota + 1e-6) | (F.col("n_tokens") == 0))
        block = F.when(quota > 0, F.least(F.lit(self.blocks), F.greatest(F.lit(1), F.ceil(F.col("place") / quota * self.blocks)))).otherwise(1)
        return placed.select("doc_id", "source", "n_tokens", F.col("epoch").cast("int").alias("epoch"), block.cast("long").alias("block"), F.col("place").cast("long").alias("place"), "salt")

    def realise(self) -> DataFrame:
        """The rows of `docs`, each as often as the schedule uses it. No text is shuffled: only the place of each epoch's cut is joined."""
        of, n, cut, whole, drawn = fresh(self.docs.columns, "source", "epoch", "cut", "whole", "tokens")

        def point(h: Column, key: Column) -> Column:
            return F.struct(F.pmod(F.shiftright(h, 24), F.lit(self.ranges)).alias("part"), h.alias("h"), key.alias("key"))

        last = self._placed().where("n_tokens > 0").groupBy("source", "epoch").agg(F.max(point(self._hash(F.col("doc_id"), F.col("epoch"), F.col("salt")), F.col("doc_id"))).alias(cut)).select(F.col("source").alias("s"), F.col("epoch").alias("e"), cut)
        most = F.greatest(F.lit(0), F.ceil("epochs").cast("int") - 1)
        side = self.weights.select(F.col("source").alias(of), "epochs", F.explode(F.sequence(F.lit(0), most)).alias(n))
        side = side.join(last, F.col(of).eqNullSafe(F.col("s")) & (F.col(n) == F.col("e")), "left").select(of, n, cut, (F.col(n) + 1 <= F.col("epochs")).alias(whole))
        joined = self.docs.withColumn(drawn, self.tokens).join(self._sized(side), F.col(self.source).cast("string").eqNullSafe(F.col(of)))
        used = F.col(whole) | F.coalesce(point(self._hash(F.col(self.key), F.col(n), self._salt(F.col(self.key), F.col(self.text))), F.col(self.key)) <= F.col(cut), F.lit(False)) | (F.col(drawn) == 0)
        return joined.where(used).select(*self.docs.columns)
