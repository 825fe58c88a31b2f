"""Exact similarity join of documents on word n-grams, by PartEnum signatures.

A document is the set of its distinct word n-grams (hashed to 64 bits); two
documents link if their Jaccard similarity is at least `percent` / 100. What is
returned is the component that each document reaches over links.

Signatures. Sizes are cut into bands so that linked sets lie in one band or in
two neighbouring ones; each band has an instance for the pairs whose larger set
it holds, with the largest Hamming distance k of such pairs. An instance deals
the hashed feature domain into groups of partitions. As k differences can't
spoil all groups, linked sets agree on all but `spare` partitions of slack + 1
groups at least; each subset of that many partitions of a group gives a
signature. A subset without features would be shared by unrelated sets and
gives none; a set with more such groups than the slack is dealt anew with
another seed, level by level, and so is each partner that could be missed. No
link is lost.

Work. Copies are folded by a digest of their sets. Signatures are packed by
the block of their hash range. Up to eight sets that share one are paired. Of
more, each is first held against the least of them, and only where that fails
all of the bucket against each other in one task. A pair stays a candidate if
histograms of the hashed features differ by no more than linked sets can. A
bucket beyond a bound is joined to its least set, in each batch before the
shuffle or in its block: a signature that a third of all rows share reaches a
block once from each batch. The components of
candidate pairs and joints are closed under links. Members of a large
one get more selective signatures, which take it apart unless it is alike. A
small one is resolved exactly in one task; one that is still large in salted
chunks against a few pivots, and then against all documents outside its largest
part, in blocks. The pairs of a group are never spelt out.

Defined results: null and empty texts, and texts without words, have no
n-grams and link with nothing; very long texts are read whole; a row without an
id has a null component; rows that share an id, and repeated rows, share a
component; an empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.graph import components
from quire.llm.kernel import Words, give_back, mix, pieces, shingle_sets
from quire.llm.workspace import Workspace

#: (partitions of a group, partitions that may differ): the first is tried on all, the next on members of large candidate groups.
SCHEMES = ((3, 1), (5, 2))
LEVELS = 8
#: Signatures that are sorted at once, and that a block receives, about.
FLUSH, BLOCK = 1 << 19, 1_000_000
#: Documents that share a signature: up to PAIRED they are paired; beyond FOLDED in a batch, or MET in a block, they are joined to the least of them.
PAIRED, FOLDED, MET = 8, 64, 4000
#: Fewest cells of the sketch that bounds two sets' difference from below, and features to a cell, about.
CELLS, CELL = 64, 8
#: A candidate group beyond either is resolved by many tasks.
GROUP_DOCS, GROUP_FEATURES = 20_000, 1_000_000
#: Pivots of a large group; features of its members, and of the documents they are compared with, in one task.
PIVOTS, CHUNK, QUERIES = 48, 500_000, 300_000
#: Rows (16 bytes each) up to which a side is broadcast, after it has been counted.
BROADCAST_ROWS = 1_000_000


class Bands:
    """Bands of set sizes for a similarity, and the groups that a scheme of signatures has in each."""

    def __init__(self, percent: int, scheme: tuple[int, int] = SCHEMES[0]):
        self.percent, self.first, self.last = percent, [1], [100 // percent]
        self.split, self.spare = scheme
        self.subsets = np.array([[i in c for c in combinations(range(self.split), self.split - self.spare)] for i in range(self.split)], float)
        self._groups: dict[int, tuple[int, int]] = {}

    def of(self, size: int) -> int:
        while self.last[-1] < size:
            self.first.append(self.last[-1] + 1)
            self.last.append(self.first[-1] * 100 // self.percent)
        return int(np.searchsorted(self.last, size))

    def instances(self, size: int) -> list[tuple[int, int]]:
        """(instance, its largest Hamming distance) of those that a set takes part in."""
        own = self.of(size)
        self.of(self.last[own] + 1)
        out = []
        for j in (own, own + 1):
            k = 2 * (100 - self.percent) * self.last[j] // (100 + self.percent)
            if k and (j == own or 100 * size >= self.percent * self.first[j]):
                out.append((j, k))
        return out

    def groups(self, instance: int, k: int) -> tuple[int, int]:
        """(groups, slack) of an instance: the slack that lets a set of common size expect the fewest signatures over all levels."""
        if instance not in self._groups:
            least = k // (self.spare + 1) + 1
            best = (math.inf, least, 0)
            for slack in range(1, least // 3 + 8, max(1, least // 64)):
                groups = least + slack
                held = self.first[instance] / groups * (self.split - self.spare) / self.split
                thin = groups * min(1.0, self.subsets.shape[1] * math.exp(-held))
                inside = term = math.exp(-thin)
                for i in range(1, slack + 1):
                    term *= thin / i
                    inside += term
                best = min(best, (groups / max(inside, 1e-9), groups, slack))
            self._groups[instance] = best[1:]
        return self._groups[instance]


def signatures(features: np.ndarray, bands: Bands) -> np.ndarray:
    """64-bit signatures of a set of hashed features."""
    low = (features & np.uint64(0xFFFFFF)).astype(float)
    high = (features >> np.uint64(24) & np.uint64(0xFFFFFF)).astype(float)
    out = []
    for instance, k in bands.instances(len(features)):
        groups, slack = bands.groups(instance, k)
        parts = groups * bands.split
        for level in range(LEVELS):
            seed = mix(np.array([instance * LEVELS + level + 1], np.uint64))
            part = (mix(features ^ seed) >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)
            part = part.astype(np.int64)
            count, a, b = (np.bincount(part, weights=w, minlength=parts).reshape(groups, bands.split) @ bands.subsets for w in (None, low, high))
            value = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(b.astype(np.uint64))
            value = mix(value ^ mix(np.arange(value.size, dtype=np.uint64).reshape(value.shape) + seed * np.uint64(3)))
            full = count > 0
            last = level == LEVELS - 1
            out.append(value.reshape(-1) if last else value[full])
            if int((~full).any(axis=1).sum()) <= slack:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for first, at, data in pieces(column):
        for k, features in enumerate(shingle_sets(Words(at, data, lower=True), size)):
            yield first + k, features


def _digest(features: np.ndarray) -> tuple[int, int]:
    raw = np.frombuffer(hashlib.blake2b(features.tobytes(), digest_size=16).digest(), np.int64)
    return int(raw[0]), int(raw[1])


def _sketch(features: np.ndarray) -> bytes:
    """Counts of the features by the first bits of a hash; more cells for larger sets, as chance evens out large counts."""
    bits = max(CELLS.bit_length() - 1, (len(features) // CELL).bit_length())
    cells = np.bincount((mix(features) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(cells, 65535).astype("<u2").tobytes()


def _folded(sketch: bytes, cells: int) -> np.ndarray:
    """A sketch with fewer cells."""
    return np.frombuffer(sketch, "<u2").astype(np.int32).reshape(cells, -1).sum(axis=1)


def _profile(size: int):
    def run(batches):
        for batch in batches:
            ids, n, hi, lo, sketch = batch.column(0), [], [], [], []
            for _, features in _sets(batch.column(1), size):
                h, w = _digest(features)
                n.append(len(features))
                hi.append(h)
                lo.append(w)
                sketch.append(_sketch(features))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n, hi, lo)), pa.array(sketch, pa.binary())], names=["doc_id", "n", "hi", "lo", "sketch"])
        give_back()

    return run


_PACKED = "block int, keys binary, nodes binary, counts binary, pairs binary"


def _packed(blocks: list, keys: list, nodes: list, counts: list, pairs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *(pa.array(x, pa.binary()) for x in (keys, nodes, counts, pairs))], names=["block", "keys", "nodes", "counts", "pairs"])


def _buckets(values: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (value, node) by value, the place of each bucket's first one, and the buckets' sizes."""
    order = np.lexsort((nodes, values))
    values, nodes = values[order], nodes[order]
    if len(values):
        new = np.concatenate([[True], (values[1:] != values[:-1]) | (nodes[1:] != nodes[:-1])])
        values, nodes = values[new], nodes[new]
    head = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values, nodes, head, np.diff(np.append(head, len(values)))


def _members(chosen: np.ndarray, head: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all members of the chosen buckets, and of the first one of each one's bucket."""
    first, count = np.repeat(head[chosen], size[chosen]), size[chosen]
    return first + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), first


def _joints(nodes: np.ndarray, head: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """Members of buckets beyond a size, each with the least one."""
    at, first = _members(size > most, head, size)
    pairs = np.stack([nodes[at], nodes[first]], axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _pack(values: np.ndarray, nodes: np.ndarray, blocks: int) -> pa.RecordBatch:
    """Packs signatures and nodes by block; of a bucket beyond FOLDED, only the least node goes on, and its joints."""
    values, nodes, head, size = _buckets(values, nodes)
    pairs = _joints(nodes, head, size, FOLDED)
    first = np.zeros(len(values), bool)
    first[head] = True
    going = first | np.repeat(size <= FOLDED, size)
    values, nodes = values[going], nodes[going]
    block = ((values >> np.uint64(40)) * np.uint64(blocks) >> np.uint64(24)).astype(np.int64)
    order = np.lexsort((nodes, block))
    values, nodes, block = values[order], nodes[order], block[order]
    keys = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    rows: tuple[list, ...] = ([], [], [], [], [])
    for a, b in zip(cuts, [*cuts[1:], len(block)]):
        runs = np.flatnonzero(np.concatenate([[True], nodes[a + 1 : b] != nodes[a : b - 1]]))
        for out, x in zip(rows, (int(block[a]), keys[a:b].tobytes(), nodes[a:b][runs].tobytes(), np.diff([*runs, b - a]).astype(np.int32).tobytes(), b"")):
            out.append(x)
    for k in range(0, len(pairs), 1 << 16):
        for out, x in zip(rows, (int(mix(pairs[k : k + 1, 0].astype(np.uint64))[0] % np.uint64(blocks)), b"", b"", b"", pairs[k : k + (1 << 16)].tobytes())):
            out.append(x)
    return _packed(*rows)


def _held(column: pa.Array, _: int) -> Iterator[tuple[int, np.ndarray]]:
    for k, features in enumerate(column):
        yield k, np.frombuffer(features.as_buffer(), np.uint64)


def _enumerate(sets, size: int, percent: int, scheme: tuple[int, int], blocks: int):
    """Packs the signatures of (doc_id, text or features); `sets` reads the second column."""

    def run(batches):
        bands = Bands(percent, scheme)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            seen: set[bytes] = set()
            values, nodes, held = [], [], 0
            for row, features in sets(batch.column(1), size):
                if ids[row] is None or not len(features):
                    continue
                digest = hashlib.blake2b(features.tobytes(), digest_size=16).digest()
                if digest in seen:
                    continue  # a copy; the earlier one stands for its set
                seen.add(digest)
                own = signatures(features, bands)
                values.append(own)
                nodes.append(np.full(len(own), ids[row], np.int64))
                held += len(own)
                if held >= FLUSH:
                    yield _pack(np.concatenate(values), np.concatenate(nodes), blocks)
                    values, nodes, held = [], [], 0
            if held:
                yield _pack(np.concatenate(values), np.concatenate(nodes), blocks)
        give_back()

    return run


#: Kinds of rows: two nodes; a node, the least one of its bucket, and the bucket; a node and the least one of a bucket that is too large.
PAIR, MEMBER, JOINT = range(3)


def _candidates(table: pa.Table) -> pa.Table:
    """Pairs, members of buckets, and joints of a block."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint8).reshape(-1, 6)
    values = np.zeros((len(keys), 8), np.uint8)
    values[:, :6] = keys
    values = values.view("<u8").reshape(-1)
    nodes = np.repeat(np.frombuffer(b"".join(table.column("nodes").to_pylist()), np.int64), np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32))
    values, nodes, head, size = _buckets(values, nodes)
    joints = [np.frombuffer(b"".join(table.column("pairs").to_pylist()), np.int64).reshape(-1, 2), _joints(nodes, head, size, MET)]
    joints = np.unique(np.concatenate(joints), axis=0)
    pairs = [np.zeros((0, 2), np.int64)]
    for count in range(2, PAIRED + 1):
        at = head[size == count]
        pairs += [np.stack([nodes[at + i], nodes[at + j]], axis=1) for i in range(count) for j in range(i)]
    pairs = np.unique(np.concatenate(pairs), axis=0)
    at, first = _members((size > PAIRED) & (size <= MET), head, size)
    block = np.array(table.column("block").to_pylist()[:1] or [0], np.uint64)
    bucket = (values[at] | (block << np.uint64(48))).view(np.int64)  # blocks beyond 2^16 may share a name, which only widens a bucket
    parts = (pairs[:, 0], pairs[:, 1], PAIR), (nodes[at], nodes[first], MEMBER), (joints[:, 0], joints[:, 1], JOINT)
    kinds = np.concatenate([np.full(len(x), kind, np.int32) for x, _, kind in parts])
    buckets = np.concatenate([np.zeros(len(pairs), np.int64), bucket, np.zeros(len(joints), np.int64)])
    give_back()
    return pa.table({"a": pa.array(np.concatenate([x for x, *_ in parts])), "b": pa.array(np.concatenate([y for _, y, _ in parts])), "bucket": pa.array(buckets), "kind": pa.array(kinds)})


def _near_enough(percent: int):
    """Pairs whose sketches differ by no more than those of linked sets."""

    def run(batches):
        for batch in batches:
            a, b, sizes = batch.column(0), batch.column(1), [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3)]
            least = np.zeros(len(a), np.int64)
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                cells = min(len(x), len(y)) // 2
                least[k] = np.abs(_folded(x, cells) - _folded(y, cells)).sum()
            kept = pa.array((100 + percent) * least <= (100 - percent) * (sizes[0] + sizes[1]))
            yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], names=["a", "b"])

    return run


def _within(percent: int):
    """Of each bucket, near pairs enough to connect all that are near; each set is held against all others."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("a", "ascending")])
        bucket, node, n = (table.column(c).to_numpy() for c in ("bucket", "a", "n"))
        sketches = table.column("sketch").to_pylist()
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        out: set[tuple[int, int]] = set()
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            held = Union(int(b - a))
            fewest = min(map(len, sketches[a:b])) // 2
            cells = np.stack([_folded(x, fewest) for x in sketches[a:b]])
            for k in range(a, b):
                least = np.abs(cells[: k - a] - cells[k - a]).sum(axis=1)
                for j in np.flatnonzero((100 + percent) * least <= (100 - percent) * (n[a:k] + n[k])).tolist():
                    held.join(j, int(k - a))
            out.update((int(node[a + k]), int(node[a + root])) for k in range(b - a) if (root := held.root(k)) != k)
        give_back()
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return run


class Index:
    """Inverted index of a few sets, to count what another set shares with each."""

    def __init__(self, sets: list[np.ndarray]):
        features = np.concatenate(sets)
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(features, kind="stable")
        self.features, first = np.unique(features[order], return_index=True)
        self.owners, self.first, self.sets = owners[order], np.append(first, len(features)), len(sets)
        self.sizes = np.array([len(s) for s in sets])

    def linked(self, features: np.ndarray, percent: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.features, features), len(self.features) - 1)
        at = at[self.features[at] == features]
        begin, count = self.first[at], self.first[at + 1] - self.first[at]
        total = int(count.sum())
        if not total:
            return np.zeros(0, np.int64)
        step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        shared = np.bincount(self.owners[np.repeat(begin, count) + step], minlength=self.sets)
        return np.flatnonzero(100 * shared >= percent * (self.sizes + len(features) - shared))


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = k = self.up[self.up[k]]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def clusters(sets: list[np.ndarray], percent: int) -> list[int]:
    """For each set, the least set that it reaches over links. What has joined the first set needs no look of its own."""
    held = Union(len(sets))
    if len(sets) > 1:
        index = Index(sets)
        for k, features in enumerate(sets):
            if k == 0 or held.root(k) != held.root(0):
                for j in index.linked(features, percent).tolist():
                    held.join(k, j)
    return [held.root(k) for k in range(len(sets))]


def _resolve(percent: int):
    def run(table: pa.Table) -> pa.Table:
        groups: dict[int, dict[tuple, np.ndarray]] = {}
        for gid, doc, features in zip(*(table.column(c).to_pylist() for c in ("gid", "doc_id", "features"))):
            groups.setdefault(gid, {})[doc, hash(features)] = np.frombuffer(features, np.uint64)
        docs, least = [], []
        for group in groups.values():
            members = sorted(group)
            roots = clusters([group[m] for m in members], percent)
            same = {}
            for (doc, _), root in zip(members, roots):  # rows with one id are one document
                same.setdefault(doc, []).append(root)
            if any(len(v) > 1 for v in same.values()):
                held = Union(len(members))
                for k, root in enumerate(roots):
                    held.join(k, root)
                for v in same.values():
                    for root in v[1:]:
                        held.join(v[0], root)
                roots = [held.root(k) for k in range(len(members))]
            docs += [doc for doc, _ in members]
            least += [members[root][0] for root in roots]
        give_back()
        return pa.table({"node": pa.array(docs, pa.int64()), "component": pa.array(least, pa.int64())})

    return run


def _compare(percent: int):
    def run(table: pa.Table) -> pa.Table:
        queries, members = [], []  # an id may have several sets
        for query, doc, features in zip(*(table.column(c).to_pylist() for c in ("query", "doc_id", "features"))):
            (queries if query else members).append((doc, np.frombuffer(features, np.uint64)))
        pairs = []
        if queries and members:
            names = [doc for doc, _ in queries]
            index = Index([features for _, features in queries])
            number = {d: k for k, d in enumerate(sorted({d for d, _ in queries + members}))}
            held = Union(len(number))
            for doc, features in members:
                for j in index.linked(features, percent).tolist():
                    held.join(number[doc], number[names[j]])
            back = list(number)
            pairs = [(back[k], back[root]) for k in range(len(back)) if (root := held.root(k)) != k]
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    return run


def _against(members: DataFrame, queries: DataFrame, percent: int) -> DataFrame:
    """Links of all members of each group with its queries; both have gid, doc_id, features, salts and blocks."""
    block = lambda: F.pmod(F.xxhash64("doc_id", F.lit(2)), "blocks").cast("int")
    salt = F.pmod(F.xxhash64("doc_id", F.lit(1)), "salts").cast("int")
    rows = members.select("gid", "doc_id", "features", salt.alias("salt"), F.explode(F.expr("sequence(0, cast(blocks as int) - 1)")).alias("part"), F.lit(False).alias("query"))
    asked = queries.select("gid", "doc_id", "features", F.explode(F.expr("sequence(0, cast(salts as int) - 1)")).alias("salt"), block().alias("part"), F.lit(True).alias("query"))
    return rows.unionByName(asked).groupBy("gid", "salt", "part").applyInArrow(_compare(percent), "a long, b long")


def _sized(frame: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a side that was counted and is small enough."""
    return F.broadcast(frame) if rows <= BROADCAST_ROWS else frame


def _large_groups(work: Workspace, sets: DataFrame, large: DataFrame, n_large: int, percent: int) -> DataFrame:
    """(node, component) of the members of large groups."""
    members = work.table(sets.join(_sized(large, n_large), "gid").withColumn("salts", F.ceil(F.col("weight") / CHUNK)))
    few = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.greatest(F.lit(1), F.floor(F.col("docs") / PIVOTS))) == 0
    one = F.lit(1).alias("blocks")
    columns = ["gid", "doc_id", "features", "salts"]
    links = work.table(_against(members.select(*columns, one), members.where(few).select(*columns, one), percent))
    alone = members.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    reached = work.table(components(work, links))
    part = members.select("gid", "doc_id").join(reached.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("gid", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    sizes = part.groupBy("gid", "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy("gid").agg(F.max_by("component", F.struct("c", "component")).alias("main"))
    open_ = part.join(_sized(main, n_large), "gid").where("component <> main").select("doc_id").distinct()
    rest = members.where(~few).join(open_, "doc_id", "left_semi")
    counts = work.table(rest.groupBy("gid").agg(F.ceil(F.sum("n") / QUERIES).alias("blocks")))
    n_open = counts.count()
    if n_open:
        side = _sized(counts, n_open)
        more = _against(members.join(side, "gid").select(*columns, "blocks"), rest.join(side, "gid").select(*columns, "blocks"), percent)
        links = work.table(links.union(more))
    out = components(work, links)
    return alone.join(out, F.col("a") == F.col("node"), "left").select(F.col("a").alias("node"), F.coalesce("component", "a").alias("component")).distinct()


def similar_components(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 4, percent: int = 85) -> DataFrame:
    """One row for each row of `docs`: `doc_id`, `n_shingles` and `component_id`, the least id that it reaches over links.

    `size`: words of an n-gram; a shorter text is one n-gram. `percent`: least similarity in per cent.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    profile = work.table(rows.mapInArrow(_profile(size), "doc_id long, n long, hi long, lo long, sketch binary"))
    copied = profile.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1")
    salted = copied.select("hi", "lo", "rep", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    own = profile.withColumn("salt", F.when(F.col("n") > 0, F.pmod("doc_id", F.lit(16)).cast("int")))
    named = work.table(own.join(salted.hint("merge"), ["hi", "lo", "salt"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"), "sketch"))
    total = profile.agg(F.sum("n")).first()[0] or 0
    work.drop(profile)

    alias = named.where("rep <> doc_id").select("doc_id", "rep").distinct()
    # An id with several sets can't go by another's name: it is joined to what its copies stand for.
    several = named.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
    several = work.table(several.select("doc_id"))
    n_several, bridges = several.count(), None
    if n_several:
        bridges = work.table(alias.join(_sized(several, n_several), "doc_id", "left_semi"))
        alias = alias.join(_sized(several, n_several), "doc_id", "left_anti")

    def grouped(rows: DataFrame, sets, scheme: tuple[int, int], features: int, copies: bool) -> DataFrame:
        """(doc_id, gid): the components of candidate pairs of the rows (doc_id, text or features)."""
        blocks = min(1 << 20, max(32, features * 6 // 10 // BLOCK))
        packed = rows.mapInArrow(_enumerate(sets, size, percent, scheme, blocks), _PACKED)
        found = work.table(packed.groupBy("block").applyInArrow(_candidates, "a long, b long, bucket long, kind int"))
        pairs = found.where("a <> b").groupBy("a", "b").agg(F.max(F.when(F.col("kind") == MEMBER, -1).otherwise(F.col("kind"))).alias("kind"), F.max(F.col("kind") == MEMBER).alias("led"))
        pairs = work.table(pairs)
        loose = pairs.where(F.col("kind") != JOINT)
        # A member may be far from its least set, or only be joined to it, and still be near another member.
        held = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("doc_id"))
        asked = work.table(loose.select(F.explode(F.array("a", "b")).alias("doc_id")).union(held).distinct())
        sketch = work.table(named.select("doc_id", "n", "sketch").join(_sized(asked, asked.count()), "doc_id", "left_semi"))
        for c in ("a", "b"):
            loose = loose.join(sketch.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")), c)
        near = work.table(loose.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(_near_enough(percent), "a long, b long"))
        # Buckets whose least set is far from one of theirs.
        far = work.table(pairs.where("led").select("a", "b").join(near, ["a", "b"], "left_anti"))
        members = found.where(F.col("kind") == MEMBER)
        mixed = work.table(members.join(_sized(far, far.count()), ["a", "b"], "left_semi").select("bucket").distinct())
        rows = members.join(_sized(mixed, mixed.count()), "bucket", "left_semi").join(sketch, F.col("a") == F.col("doc_id"))
        rows = work.table(rows.select("bucket", "a", "n", "sketch"))
        bins = F.pmod(F.xxhash64("bucket"), F.lit(max(8, rows.count() // 20_000)))
        apart = rows.groupBy(bins.alias("bin")).applyInArrow(_within(percent), "a long, b long")
        kept = pairs.where(F.col("kind") == JOINT).select("a", "b").union(near).union(apart).distinct()
        for c in ("a", "b") if copies else ():
            kept = kept.join(alias.withColumnRenamed("doc_id", c), c, "left").withColumn(c, F.coalesce("rep", c)).select("a", "b")
        if bridges is not None:
            kept = kept.union(bridges.select("doc_id", "rep"))
        edges = components(work, kept)
        return work.table(edges.select(F.col("node").alias("doc_id"), F.col("component").alias("gid")))

    def features(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                ids, texts, gids = batch.slice(first, 500).columns
                found = [x for _, x in _sets(texts, size)]
                yield pa.RecordBatch.from_arrays([gids, ids, pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["gid", "doc_id", "n", "features"])
        give_back()

    groups = grouped(rows, _sets, SCHEMES[0], total, True)
    # A representative's text; another row with its id may differ, and then counts as well.
    sets = work.table(rows.join(_sized(groups, groups.count()), "doc_id").select("doc_id", "text", "gid").mapInArrow(features, "gid long, doc_id long, n long, features binary"))
    found = None
    for scheme in (*SCHEMES[1:], None):
        weights = sets.groupBy("gid").agg(F.count("*").alias("docs"), F.sum("n").alias("weight"))
        large = work.table(weights.where((F.col("docs") > GROUP_DOCS) | (F.col("weight") > GROUP_FEATURES)))
        n_large, held = large.count(), sets.agg(F.sum("n")).first()[0] or 0
        small = sets.join(_sized(large.select("gid"), n_large), "gid", "left_anti") if n_large else sets
        bins = F.pmod(F.xxhash64("gid"), F.lit(max(8, held // 500_000)))
        done = small.withColumn("bin", bins).groupBy("bin").applyInArrow(_resolve(percent), "node long, component long")
        found = done if found is None else found.union(done)
        if not n_large:
            break
        if scheme is None:
            found = found.union(_large_groups(work, sets, large, n_large, percent))
        else:
            members = work.table(sets.join(_sized(large.select("gid"), n_large), "gid", "left_semi"))
            again = grouped(members.select("doc_id", "features"), _held, scheme, members.agg(F.sum("n")).first()[0], False)
            sets = work.table(members.drop("gid").join(_sized(again, again.count()), "doc_id").select("gid", "doc_id", "n", "features"))
    found = work.table(found.groupBy("node").agg(F.min("component").alias("component")))
    work.clear(found, named)
    # A representative may stand for a third of all rows: its component is met in 16 places. Copies of it
    # outgrow what Spark expects of the small table, so that it isn't to broadcast them.
    salted = found.select(F.col("node").alias("rep"), "component", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
    named = named.withColumn("salt", F.pmod("doc_id", F.lit(16)).cast("int"))
    return named.join(salted.hint("merge"), ["rep", "salt"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
