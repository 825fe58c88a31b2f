"""Product quantisation of vectors, in exact integers: codebooks by Lloyd's rounds whose sums are kept up to date by differences.

A vector's components become integers, floor(scale * x), and are cut into
consecutive parts, alike in length but for one component. Each part position
has a codebook, which starts as that part of the vectors with the least ids. A
round gives each part its nearest entry (least squared distance, then least
index), and replaces each entry by the floor of its parts' mean; unused entries
stay.

What a round knows of the one before is kept: a table of all vectors' entries
in the shared folder, and the running sums and counts of each entry. A part
whose entry changes takes itself from the old entry's sum and adds itself to
the new one's; only these differences are summed within each task and then
shuffled, a few rows for each entry, so later rounds shuffle next to nothing,
and none shuffles a vector. The driver holds the codebooks and their sums:
entries times components, whatever the number of vectors.

Integers are exact at any size: within 53 bits distances are products of
matrices of doubles without rounding, beyond that Python's integers; sums are
shuffled by limbs of 32 bits. Errors beyond 63 bits read 2^63 - 1, as do their
sums.

Defined results: rows whose vector is null, or holds null, a NaN or an infinity,
are dropped. The vectors' length is the commonest one (the longest of those
that are alike common); rows of other lengths stay, with null code and error.
Rows that share an id have a row each; the least of their vectors counts as a
start; a null id comes after all others. With fewer ids than entries, codebooks
are shorter. An empty table gives no rows. Columns other than id, vector and
label are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.kernel import give_back
from quire.llm.workspace import Workspace

#: Labels (16 bytes each) up to which their sums are broadcast, after they have been counted.
BROADCAST_LABELS = 1_000_000
MOST_LONG = (1 << 63) - 1
_LIMB = 32
_SUMS = T.StructType([T.StructField(c, T.IntegerType()) for c in ("part", "entry", "place", "limb")] + [T.StructField("value", T.LongType())])


def whole(scale: int, values: np.ndarray) -> np.ndarray:
    """floor(scale * x): doubles that hold integers of up to 53 bits exactly, else Python's integers."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0**53 and math.log2(scale).is_integer():
        return scaled
    out = np.empty(values.size, object)
    for k, x in enumerate(values.astype(np.float64).ravel().tolist()):
        n, d = x.as_integer_ratio()
        out[k] = scale * n // d
    return out.reshape(values.shape)


def bounds(width: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and where the last one ends."""
    return [k * width // parts for k in range(parts + 1)]


def nearest(block: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """Of each row, the nearest entry and its squared distance."""
    n, width = block.shape
    if not width or not n:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    most = max(max((abs(x) for entry in book for x in entry), default=0), 0 if block.dtype == object else float(np.abs(block).max()))
    if block.dtype != object and 4 * width * int(most) ** 2 < 1 << 53:
        entries = np.array(book, np.float64)
        far = (entries**2).sum(1)[None, :] - 2 * (block @ entries.T) + (block**2).sum(1)[:, None]
        best = far.argmin(1)
        return best, far[np.arange(n), best].astype(np.int64)
    best, errors = np.zeros(n, np.int64), []
    for k, row in enumerate(block.tolist()):
        far = [sum((int(x) - y) ** 2 for x, y in zip(row, entry)) for entry in book]
        best[k] = far.index(min(far))
        errors.append(min(far))
    return best, errors


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a batch, all of which have this length and no null."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    sign, x, k = (-1 if x < 0 else 1), abs(x), 0
    while x:
        if part := x & ((1 << _LIMB) - 1):
            yield k, sign * part
        x >>= _LIMB
        k += 1


class Codes:
    """`codebooks`: entries by part; `coded`: id, label, codes (bytes, null for other lengths), error, label_error; `shuffled`: rows of differences of each round."""

    def __init__(self, vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, key: str = "vec_id", vector: str = "embedding", label: str = "label"):
        if not 0 < entries <= 256:
            raise ValueError("a code is a byte: 1 to 256 entries")
        self.spark, self.parts, self.entries, self.scale = vectors.sparkSession, parts, entries, scale
        self.work = Workspace(self.spark)
        rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        self.rows = rows.where(F.col("v").isNotNull() & finite)
        common = self.rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        self.width = common["n"] if common else 0
        self.at = bounds(self.width, parts)
        self.codebooks = self._start()
        self.shuffled: list[int] = []
        self.coded = self._rounds(rounds)

    def _start(self) -> list[list[list[int]]]:
        """Parts of the vectors with the least ids: each task gives its own least ones, so no vector is shuffled but those."""
        most, own = self.entries, self.rows.schema
        schema, order = T.StructType([own["id"], own["v"]]), lambda i: (i is None, i)

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            target, held = to_arrow_schema(schema), {}
            for batch in batches:
                ids = batch.column(0).to_pylist()
                near = set(sorted({*ids, *held}, key=order)[:most])
                held = {i: v for i, v in held.items() if i in near}
                for k in (k for k, i in enumerate(ids) if i in near):
                    v = batch.column(1)[k].as_py()
                    if ids[k] not in held or v < held[ids[k]]:
                        held[ids[k]] = v
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), target.field(k).type) for k, c in enumerate((held, held.values()))], schema=target)

        firsts = self.rows.where(F.size("v") == self.width).select("id", "v").mapInArrow(least, schema)
        made = firsts.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(most).collect()
        vectors = [[int(x) for x in whole(self.scale, np.array(r["v"], np.float64)).tolist()] for r in made]
        return [[v[a:b] for v in vectors] for a, b in zip(self.at, self.at[1:])]

    def _rounds(self, rounds: int) -> DataFrame:
        books, n_entries = self.codebooks, len(self.codebooks[0])
        if not n_entries:
            empty = self.rows.select("id", "label").withColumns({"codes": F.lit(None).cast("binary"), "error": F.lit(None).cast("long"), "label_error": F.lit(None).cast("long")})
            return empty
        fit = self.rows.where(F.size("v") == self.width)
        sums = {(p, e): [0] * (1 + b - a) for p, (a, b) in enumerate(zip(self.at, self.at[1:])) for e in range(n_entries)}
        held = fit.withColumn("new", F.lit(None).cast("binary"))
        for _ in range(rounds):
            table = self.work.table(self._assign(held, books))
            found = self._changes(table.where("old is null or old <> new"))
            changes = found.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value")).where("value <> 0").collect()
            self.shuffled.append(len(changes))
            for r in changes:
                sums[r["part"], r["entry"]][r["place"]] += r["value"] << _LIMB * r["limb"]
            books = [[[x // sums[p, e][0] for x in sums[p, e][1:]] if sums[p, e][0] else entry for e, entry in enumerate(book)] for p, book in enumerate(books)]
            self.work.drop(held)
            held = table
        self.codebooks = books
        coded = self.work.table(self._assign(held, books, final=True).unionByName(self.rows.where(F.size("v") != self.width).select("id", "label", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("long").alias("error"))))
        self.work.drop(held)
        whole_sum = F.sum(F.col("error").cast("decimal(38,0)"))
        by = self.work.table(coded.groupBy(F.col("label").alias("l")).agg(F.when(whole_sum > MOST_LONG, MOST_LONG).otherwise(whole_sum).cast("long").alias("label_error")))
        side = F.broadcast(by) if by.count() <= BROADCAST_LABELS else by
        return coded.join(side, F.col("label").eqNullSafe(F.col("l")), "left").drop("l")

    def _assign(self, rows: DataFrame, books: list, final: bool = False) -> DataFrame:
        """Beside each vector its last codes (`old`) and those by these codebooks (`new`); at last, codes and errors instead of vectors."""
        at, scale, width = self.at, self.scale, self.width
        own = rows.schema
        code = [T.StructField("codes", T.BinaryType()), T.StructField("error", T.LongType())] if final else [own["v"], T.StructField("old", T.BinaryType()), T.StructField("new", T.BinaryType())]
        schema = T.StructType([own["id"], own["label"], *code])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            target = to_arrow_schema(schema)
            for batch in batches:
                values = whole(scale, _matrix(batch.column(2), width))
                made = [nearest(values[:, a:b], book) for a, b, book in zip(at, at[1:], books)]
                codes = np.stack([best for best, _ in made], 1).astype(np.uint8)
                data = pa.array([c.tobytes() for c in codes], pa.binary())
                if final:
                    errors = [min(MOST_LONG, sum(map(int, e))) for e in zip(*(e for _, e in made))] if any(isinstance(e, list) for _, e in made) else np.sum([e for _, e in made], 0)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data, pa.array(errors, pa.int64())], schema=target)
                else:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).cast(target.field(2).type), batch.column(3), data], schema=target)
            give_back()

        return rows.select("id", "label", "v", "new").mapInArrow(run, schema)

    def _changes(self, rows: DataFrame) -> DataFrame:
        """Differences of counts (place 0) and sums (from place 1 on) that one task's parts make, for each entry that gains or loses one."""
        at, scale, width = self.at, self.scale, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[int, int], list[int]] = {}
            for batch in batches:
                values = whole(scale, _matrix(batch.column(0), width))
                if values.dtype != object and np.abs(values).max(initial=0) * len(values) >= 2.0**53:
                    values = np.vectorize(int, otypes=[object])(values)
                new = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(values), -1).astype(np.int64)
                was = batch.column(1).to_pylist()
                first = np.array([x is None for x in was], bool)
                old = np.frombuffer(b"".join(bytes(new.shape[1]) if x is None else x for x in was), np.uint8).reshape(new.shape).astype(np.int64)
                for p, (a, b) in enumerate(zip(at, at[1:])):
                    block, moved = values[:, a:b], first | (old[:, p] != new[:, p])
                    for sign, entry, rows_of in ((1, new[:, p], moved), (-1, old[:, p], moved & ~first)):
                        for e in np.unique(entry[rows_of]).tolist():
                            mine = rows_of & (entry == e)
                            held = total.setdefault((p, e), [0] * (1 + b - a))
                            for k, x in enumerate([int(mine.sum()), *block[mine].sum(0).tolist()]):
                                held[k] += sign * int(x)
            found = [(p, e, k, limb, x) for (p, e), row in total.items() for k, value in enumerate(row) for limb, x in _limbs(value)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found), (pa.int32(),) * 4 + (pa.int64(),))], names=_SUMS.names)
            give_back()

        return rows.select("v", "old", "new").mapInArrow(run, _SUMS)

    def digest(self) -> str:
        """SHA-256 of all entries' integers by part, entry and place."""
        return hashlib.sha256(",".join(str(x) for book in self.codebooks for entry in book for x in entry).encode()).hexdigest()


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The query's rows as SQL, each round a table expression; for tables whose vectors are of one length and whose ids differ."""
    steps = [f"""kept AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    piece AS MATERIALIZED (
        SELECT rid, (k - 1) // (len(v) // {parts}) AS p, (k - 1) % (len(v) // {parts}) AS j, v[k] AS x FROM (SELECT rid, v, unnest(range(1, len(v) + 1)) AS k FROM kept)),
    book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, j, x AS c FROM piece WHERE rid <= {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""near{r} AS MATERIALIZED (
        SELECT rid, p, min(far * {entries} + e) AS m FROM (SELECT rid, p, e, sum((x - c) * (x - c)) AS far FROM piece JOIN book{r} USING (p, j) GROUP BY rid, p, e) GROUP BY rid, p)""")
        if r < rounds:
            steps.append(f"""book{r + 1} AS MATERIALIZED (
        SELECT p, e, j, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c
        FROM book{r} LEFT JOIN (SELECT p, CAST(m % {entries} AS BIGINT) AS e, j, sum(x) AS s, count(*) AS n FROM piece JOIN near{r} USING (rid, p) GROUP BY ALL) USING (p, e, j))""")
    return "WITH " + ",\n    ".join(steps) + f""",
    coded AS (SELECT rid, string_agg(printf('%02x', CAST(m % {entries} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY rid)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) FROM book{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (rid)"""
