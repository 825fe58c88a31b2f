"""Variable-capacity best-fit packing of documents into training sequences.

Documents, longest first, go into the open sequence that they leave least room
in (of equal ones, into the one filled last). If none has room, as many sequences are opened as the rest of their length
needs, with the capacity of least cost per token, as the documents still to come
can fill it; at the end each sequence is cut down to the least permitted
capacity that holds its contents.

Documents of one length are alike, so the whole corpus is packed from a
histogram of lengths: at most `max(capacities)` counts reach the driver, and
sequences with equal contents are handled as one class. The plan says, for each
length, which ranks go to which sequences; ranks are counted within hash ranges
of a length, so a length that a third of all documents share is spread over
many tasks. No texts are shuffled, only ids and lengths.

A document longer than the largest capacity is cut into full pieces and a rest.
Defined results: documents without tokens (null and empty texts too) take no
place and get one row with a null `bin_id`; repeated rows are packed each, equal
lengths in the order of hash ranges, ids and pieces; very long texts are counted
whole; an empty table gives no rows. Other columns are not used, whatever their
names.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.mixing import count_words
from quire.llm.workspace import Workspace

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: Tokens that opening a sequence costs besides its capacity.
OVERHEAD = 16
#: Pieces of a hash range, about.
RANGE = 20_000


class Plan:
    """Best-fit decreasing over a histogram of lengths."""

    def __init__(self, counts: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD):
        self.capacities, self.overhead = tuple(sorted(capacities)), overhead
        self.left = np.zeros(self.capacities[-1] + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.bins = 0
        #: For each length: (first rank, first bin, pieces in each bin, place in the bin).
        self.segments: dict[int, list[tuple[int, int, int, int]]] = {}
        self._room: list[int] = []  # the sorted rooms of open classes
        self._open: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, used)
        for length in np.flatnonzero(self.left)[::-1].tolist():
            self._place(length)
        ends = [(first + 0, n, used) for classes in self._open.values() for first, n, used in classes]
        self._ends = sorted(ends)

    def _add(self, room: int, first: int, n: int, used: int) -> None:
        if n:
            if room not in self._open:
                insort(self._room, room)
                self._open[room] = []
            self._open[room].append((first, n, used))

    def _place(self, length: int) -> None:
        rank, count = 0, int(self.left[length])
        out = self.segments[length] = []
        self.left[length] = 0
        while count:
            at = bisect_left(self._room, length)
            if at < len(self._room):
                room = self._room[at]
                first, n, used = self._open[room].pop()
                if not self._open[room]:
                    del self._open[room]
                    self._room.pop(at)
            else:
                capacity = self._capacity(length, count)
                room, first, used = capacity, self.bins, 0
                n = -(-count // (capacity // length))
                self.bins += n
            each = room // length
            full = min(n, count // each)
            if full:
                out.append((rank, first, each, used))
                rank, count = rank + full * each, count - full * each
                self._add(room - each * length, first, full, used + each * length)
            if full < n and count:
                out.append((rank, first + full, count, used))
                self._add(room - count * length, first + full, 1, used + count * length)
                rank, count, full = rank + count, 0, full + 1
            self._add(room, first + full, n - full, used)

    def _capacity(self, length: int, count: int) -> int:
        """The capacity with the least cost per token, filled with this length and the largest ones still to come."""
        best, cost = 0, float("inf")
        for capacity in self.capacities:
            if capacity < length:
                continue
            each = min(count, capacity // length)
            filled = each * length
            below = length
            while filled < capacity:
                fits = np.flatnonzero(self.left[1 : min(below, capacity - filled + 1)])
                if not len(fits):
                    break
                below = int(fits[-1]) + 1
                filled += below * min(int(self.left[below]), (capacity - filled) // below)
            price = (capacity + self.overhead) / filled
            if price <= cost + 1e-12:
                best, cost = capacity, price
        return best

    def tables(self) -> dict[str, np.ndarray]:
        """Sorted arrays to look up a (length, rank), and a bin's contents."""
        rows = [(length, *s) for length in sorted(self.segments) for s in sorted(self.segments[length])]
        names = ("length", "rank", "bin", "each", "at")
        out = {n: np.array([r[k] for r in rows], np.int64) for k, n in enumerate(names)}
        ends = np.array(self._ends, np.int64).reshape(-1, 3)
        return out | {"end_bin": ends[:, 0], "end_used": ends[:, 2]}


def look_up(tables: dict[str, np.ndarray], capacities: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, capacity, offset in the bin) of pieces by length and rank among those of their length."""
    low, high = np.searchsorted(tables["length"], length, "left"), np.searchsorted(tables["length"], length, "right") - 1
    while (low < high).any():  # the last segment that starts at or before the rank
        middle = (low + high + 1) // 2
        after = tables["rank"][middle] <= rank
        low, high = np.where(after, middle, low), np.where(after, high, middle - 1)
    step = rank - tables["rank"][low]
    each = tables["each"][low]
    bins = tables["bin"][low] + step // each
    used = tables["end_used"][np.searchsorted(tables["end_bin"], bins, "right") - 1]
    return bins, capacities[np.searchsorted(capacities, used)], tables["at"][low] + step % each * length


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", tokens=count_words, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """One row for each piece: doc_id, piece, first_token, n_tokens, bin_id, capacity, place (tokens before it in its sequence)."""
    work, most = Workspace(docs.sparkSession), max(capacities)
    sized = docs.select(F.col(key).cast("long").alias("doc_id"), tokens(F.col(text)).alias("all"), F.xxhash64(F.col(text)).alias("digest"))
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil(F.col("all") / most) - 1))))
    pieces = pieces.select("doc_id", "piece", "digest", (F.col("piece") * most).alias("first_token"), F.least(F.lit(most).cast("long"), F.col("all") - F.col("piece") * most).alias("n_tokens"))
    pieces = work.table(pieces)
    ranges = max(1, pieces.count() // RANGE)
    part = F.pmod(F.xxhash64("doc_id", "piece", "digest"), F.lit(ranges))  # the digest spreads rows that share an id or have none
    sums = work.table(pieces.where("n_tokens > 0").groupBy("n_tokens", part.alias("part")).agg(F.count("*").alias("n")))
    counts = {r["n_tokens"]: r["n"] for r in sums.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # one row for each length up to the largest capacity
    tables = Plan(counts, capacities, overhead).tables()
    sizes = np.array(sorted(capacities), np.int64)

    before = F.coalesce(F.sum("n").over(Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.where("n_tokens > 0").withColumn("part", part)
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("n_tokens", "part").orderBy("doc_id", "piece")) - 1)
    # A merge join needs no shuffle here, and what it joins grows with the corpus.
    ranked = ranked.join(sums.select("n_tokens", "part", before.alias("before")).hint("merge"), ["n_tokens", "part"])
    ranked = ranked.select("doc_id", "piece", "first_token", "n_tokens", (F.col("before") + F.col("k")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            bins, capacity, at = look_up(tables, sizes, length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(bins), pa.array(capacity), pa.array(at)], names=["doc_id", "piece", "first_token", "n_tokens", "bin_id", "capacity", "place"])

    schema = "doc_id long, piece long, first_token long, n_tokens long, bin_id long, capacity long, place long"
    none = F.lit(None).cast("long")
    return ranked.mapInArrow(place, schema).unionByName(pieces.where("n_tokens <= 0").select("doc_id", "piece", "first_token", "n_tokens", none.alias("bin_id"), none.alias("capacity"), none.alias("place")))
