"""Divergence audit: how far the sources of a language lie from each other in their use of words, and which words set each apart.

A term is a run of letters; the terms of a language are those in at least
`least_docs` of its documents. A group is a source within a language. Each term
has a smoothed share p of a group (parts of a thousand million, rounded down),
and two shares differ by floor((p - q)^2 / (p + q)).

Pairs of groups are compared by two-dimensional tiling. The terms of a language
are numbered in chunks; a group's counts of a chunk are packed into one row.
Groups are numbered in blocks, and each row is sent to the tiles of its block
with every block of its language. A task walks through the chunks of a tile
(of one slab of them, where a language has very many), holds one chunk of its
two blocks at a time, and adds to the tile's matrix of pairs. Terms that no
group of the tile has in a chunk differ alike in all: they are added at the end
by their number, so work follows the counts that are there.

Words are counted within tasks before they are shuffled, by language, source
and term; no row of a hot source or language is shuffled as such. All
arithmetic is exact: 64-bit where it fits, decimals or Python's integers beyond.

Defined results: null text, language and source are empty strings; a group
without terms is compared with counts of zero; a language without terms gives
pairs of difference 0; a single source has no pairs; repeated rows count each;
texts of any length are counted whole; an empty table gives no rows; columns
other than text, language and source are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.kernel import give_back
from quire.llm.workspace import Workspace

#: Shares are parts of this.
UNIT = 1_000_000_000
#: Terms of a chunk, chunks of a slab, and groups of a block, about.
CHUNK, SLAB, BLOCK = 1024, 4096, 8
#: Distinct terms that a task holds before it gives its counts away, and rows whose texts it holds at once.
HELD, ROWS = 120_000, 256
#: Groups, or languages (some 50 bytes each), up to which they are broadcast, after they have been counted.
BROADCAST_GROUPS = 200_000
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents by task, not summed yet; a null term for each group, with its documents."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "term")] + [T.StructField(c, T.LongType()) for c in ("n", "docs")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for (of, at), (n, within) in held.items():
                terms = [t.decode() if t is not None else None for t in n]
                for k in range(0, len(terms), 10_000):
                    some = terms[k : k + 10_000]
                    columns = [[of] * len(some), [at] * len(some), some, list(n.values())[k : k + 10_000], [within[t] for t in list(n)[k : k + 10_000]]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)
            held.clear()

        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            for row, of, at in zip(*(batch.column(k).to_pylist() for k in range(3))):
                group = (of or "", at or "")
                if group not in held:
                    held[group] = Counter(), Counter()
                n, within = held[group]
                terms = _TERM.findall((row or "").encode().lower())  # bytes.lower changes A to Z alone
                n.update(terms)
                within.update(set(terms))
                n[None] += 0
                within[None] += 1
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from give()
        yield from give()
        give_back()

    return docs.select(text, lang, source).mapInArrow(run, schema)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * terms)), exactly."""
    return (F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)"), (total + 2 * terms).cast("decimal(20,0)"))).cast("long")


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(n: np.ndarray, total: int, terms: int) -> np.ndarray:
    """As `share`, by long division in steps of a thousand."""
    whole = total + 2 * terms
    rest = n.astype(np.int64 if whole < 1 << 53 else object) + 2
    out = rest // whole
    rest = rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return (out + 1).astype(np.int64)


class Audit:
    """`pairs`: lang, source, other, value; `terms`: lang, source, term, value, rank, of those used more than in the language, the ranks to `top`; `report`: both as items of groups, with ranks."""

    def __init__(self, docs: DataFrame, least_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source", chunk: int = CHUNK, slab: int = SLAB, block: int = BLOCK):
        self.top, self.chunk, self.slab, self.block = top, chunk, slab, block
        self.work = work = Workspace(docs.sparkSession)
        by_group = work.table(counts(docs, text, lang, source).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        found = by_group.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        vocabulary = work.table(found.select("lang", "term", "of_lang"))
        sizes = work.table(vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("lang_total")))
        if sizes.count() <= BROADCAST_GROUPS:
            sizes = F.broadcast(sizes)
        kept = by_group.where("term is not null").select("lang", "source", "term", "n").join(self._numbered(vocabulary, sizes), ["lang", "term"])
        self.kept = work.table(kept)
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = by_group.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
        groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "terms", "lang_total")))
        # Blocks of a language hold consecutive sources; pairs of all of them are the result, so no language has very many.
        self.groups = work.table(groups.withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("lang")) / block).cast("int")))
        self.few = self.groups.count() <= BROADCAST_GROUPS

    def _numbered(self, vocabulary: DataFrame, sizes: DataFrame) -> DataFrame:
        """The terms with their places: hashed to chunks, and numbered within each."""
        chunks = sizes.select("lang", F.ceil(F.col("terms") / self.chunk).cast("int").alias("chunks"), "terms", "lang_total")
        placed = vocabulary.join(chunks, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
        return placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).drop("chunks")

    def _with_groups(self, rows: DataFrame, *columns: str) -> DataFrame:
        side = self.groups.select("lang", "source", *columns)
        return rows.join(F.broadcast(side) if self.few else side, ["lang", "source"])

    def terms(self) -> DataFrame:
        rows = self._with_groups(self.kept, "total")
        p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("of_lang"), F.col("lang_total"), F.col("terms"))
        rows = rows.select("lang", "source", "term", p.alias("p"), q.alias("q")).where("p > q").select("lang", "source", "term", difference(F.col("p"), F.col("q")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= self.top)

    def pairs(self) -> DataFrame:
        """Both directions of each pair of sources of a language."""
        packed = self.kept.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("c"))
        packed = self._with_groups(packed, "number", "blocks", "total", "terms").select("lang", "number", "blocks", "total", "terms", "chunk", F.col("c.place").alias("places"), F.col("c.n").alias("counts"), F.floor(F.col("chunk") / self.slab).cast("int").alias("slab"))
        # A group's own row comes before its counts in every slab of its language: chunk -1, with nothing in it.
        slabs = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("terms") / self.chunk) / self.slab)).cast("int")
        none = self.groups.select("lang", "number", "blocks", "total", "terms", F.lit(-1).alias("chunk"), F.array().cast("array<int>").alias("places"), F.array().cast("array<bigint>").alias("counts"), F.explode(F.sequence(F.lit(0), slabs - 1)).alias("slab"))
        own = F.floor(F.col("number") / self.block).cast("int")
        tiled = packed.unionByName(none).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiled = tiled.withColumn("a", F.least("own", "with")).withColumn("b", F.greatest("own", "with")).drop("own", "with", "blocks")
        tile = ["lang", "a", "b", "slab"]
        sums = tiled.repartition(*tile).sortWithinPartitions(*tile, "chunk", "number").select(*tile, "chunk", "number", "total", "terms", "places", "counts").mapInArrow(_tiles(self.block), "lang string, x int, y int, value bigint")
        half = sums.groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
        both = half.unionByName(half.select("lang", F.col("y").alias("x"), F.col("x").alias("y"), "value"))
        side = self.groups.select("lang", "source", "number", "total", "terms")
        side = F.broadcast(side) if self.few else side
        one = side.select("lang", F.col("number").alias("x"), "source", F.col("total").alias("t"), "terms")
        two = side.select("lang", F.col("number").alias("y"), F.col("source").alias("other"), F.col("total").alias("u"))
        joined = both.join(one, ["lang", "x"]).join(two, ["lang", "y"])
        rest = F.when(F.col("terms") > 0, F.col("terms") * difference(share(F.lit(0), F.col("t"), F.greatest(F.col("terms"), F.lit(1))), share(F.lit(0), F.col("u"), F.greatest(F.col("terms"), F.lit(1))))).otherwise(0)
        return joined.select("lang", "source", "other", (F.col("value") + rest).alias("value"))

    def report(self) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "other"))
        pairs = self.pairs().withColumn("rank", rank).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
        return pairs.unionByName(self.terms().select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def _tiles(block: int):
    """A map over rows that are sorted by tile, chunk and group: the pairs of each tile with the sum of what their terms differ beyond terms of no count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("value", pa.int64())])
        tile, chunk = None, None
        known: dict[int, tuple[int, int, int]] = {}  # a group's total, terms, and share of a term without a count
        sums: dict[tuple[int, int], int] = {}
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def add() -> None:
            """The chunk that is held."""
            places = np.unique(np.concatenate([p for p, _ in held.values()]))
            numbers = sorted(known)
            table = np.empty((len(numbers), len(places)), np.int64)
            for row, k in zip(table, numbers):
                total, terms, least = known[k]
                row[:] = least
                if k in held:
                    p, n = held[k]
                    row[np.searchsorted(places, p)] = shares(n, total, terms)
            base = np.array([known[k][2] for k in numbers], np.int64)
            first = [i for i, k in enumerate(numbers) if k // block == tile[1]]
            second = np.array([i for i, k in enumerate(numbers) if k // block == tile[2]], np.int64)
            for i in first:
                others = second[second > i]
                if len(others):
                    p, q = table[i], table[others]
                    far = ((q - p) ** 2 // (q + p)).sum(1) - len(places) * ((base[others] - base[i]) ** 2 // (base[others] + base[i]))
                    for j, x in zip(others.tolist(), far.tolist()):
                        sums[numbers[i], numbers[j]] = sums.get((numbers[i], numbers[j]), 0) + x
            held.clear()

        def give() -> Iterator[pa.RecordBatch]:
            if held:
                add()
            if tile is not None:
                found = [(tile[0], x, y, sums.get((x, y), 0)) for x in known if x // block == tile[1] for y in known if y // block == tile[2] and y > x]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)
            known.clear()
            sums.clear()

        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(8))))
            for k, (lang, a, b, slab, at, number, total, terms) in enumerate(keys):
                if (lang, a, b, slab) != tile:
                    yield from give()
                    tile, chunk = (lang, a, b, slab), None
                if at < 0:
                    known[number] = total, terms, int(shares(np.zeros(1, np.int64), total, terms)[0]) if terms else 1
                    continue
                if at != chunk and held:
                    add()
                chunk = at
                held[number] = batch.column(8)[k].values.to_numpy(), batch.column(9)[k].values.to_numpy()
        yield from give()
        give_back()

    return run


#: The query's rows as SQL.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS of_lang FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
s AS (SELECT lang, count(*) AS terms, sum(of_lang) AS total FROM v GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY lang, source, term),
k AS (SELECT lang, source, sum(coalesce(n, 0)) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n,
        1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 2)) // (k.total + 2 * terms) AS p,
        1 + (CAST(1000000000 AS HUGEINT) * (of_lang + 2)) // (s.total + 2 * terms) AS q
    FROM k JOIN s USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
own AS (SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM own) WHERE rank <= 10
"""
