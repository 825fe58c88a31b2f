"""Token ids of a corpus in flat binary files, with 64-bit offsets of documents.

A written folder holds, for each range of documents in ascending order of their
keys, three files: `.ids` (unsigned little-endian integers of 2 bytes where the
vocabulary allows, else 4), `.keys` (an Arrow file of keys and lengths) and
`.offsets` (signed little-endian 64-bit integers: where each document begins,
counted in ids from the first of all documents, and where the last one ends).
`index` (Parquet) has a row for each range with its base, the ids before it.

Texts are sorted by a range shuffle and encoded where they arrive, so each is
encoded once. A task writes under a name of its own, and only names that its
row of the manifest gives are read: a repeated task leaves files that nobody
reads. Bases are prefix sums over the manifest in two levels (blocks of ranges,
then ranges of a block); no number of a document passes the driver or one task.
Files are mapped into memory where the folder is on a file system of the
machine, and read as a whole elsewhere.

Words are encoded once for each worker, and told apart by 64-bit hashes, where
the tokenizer is a byte-level BPE without normaliser: its pattern begins a new
part at each single space between other characters, at each single line feed,
and at a full stop or comma after an ASCII letter, so such pieces have the same
ids alone as in their text. Texts with other blanks, and all texts of any other
tokenizer, are encoded as a whole.

Defined results: a null or empty text has the end id alone; rows without a key
come last; rows that share a key stand in the order of their texts' hashes, and
copies of a row in any order, as they are alike; a key that many rows share is
spread over ranges by that hash and by row; other columns are not read; an
empty table has no files and no rows. Strings of special tokens in a text are
ordinary text.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
from collections.abc import Callable, Iterable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.kernel import Words, buffers, give_back, hashes, mix
from quire.llm.workspace import Workspace

#: Ranges of a block of the prefix sums.
BLOCK = 1024
#: Words that a worker remembers before it begins anew; a text with a longer word than this many characters is encoded as a whole.
WORDS, LONGEST = 1_200_000, 1000
#: More than a word's ids have bytes.
_ROOM = 1 << 16
#: What a word's place may put before it.
_BEFORE = ("", " ", "\n", " ")
#: Ids that are read back at once, unless one document has more.
PIECE = 1 << 20
_ODD = re.compile(r"\s")
_STOPS, _LETTERS = frozenset(".,"), frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _byte_level(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    first = made.get("pre_tokenizer") or {}
    return made.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space", True) and (made.get("model") or {}).get("type") == "BPE"


class Encoder:
    """Ids of texts, each as bytes of `dtype`, from a tokenizer's file."""

    def __init__(self, path: str, dtype: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives each core a task
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.by_word = Tokenizer.from_file(path), dtype, _byte_level(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()

    @classmethod
    def of(cls, path: str, dtype: str) -> Encoder:
        """The worker's own. This class reaches a worker anew with each task, so what is to be kept hangs on a module of its own."""
        kept = sys.modules.setdefault("_quire_encoders", ModuleType("_quire_encoders")).__dict__
        if (path, dtype) not in kept:
            kept[path, dtype] = cls(path, dtype)
        return kept[path, dtype]

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str], known: dict[str, bytes]) -> None:
        """Encodes pieces, many in one call; a piece begins with its space, if it has one.

        A space and ASCII letters are one part of the tokenizer's pattern, so such pieces are encoded as one text, by whose parts
        the ids are told apart; others are sequences of their own.
        """
        letters = [p for p in pieces if p[0] == " " and p.isascii() and p[1:].isalpha()]
        self._encoded(letters, known, "".join)
        if len(letters) < len(pieces):
            held = set(letters)
            self._encoded([p for p in pieces if p not in held], known, list)

    def _encoded(self, pieces: list[str], known: dict[str, bytes], given: Callable) -> None:
        for k in range(0, len(pieces), 4096):
            some = pieces[k : k + 4096]
            made = self.tokenizer.encode(given(some), is_pretokenized=given is list, add_special_tokens=False)
            ids, of = np.array(made.ids, self.dtype), np.array(made.word_ids, np.int64)
            ends = np.searchsorted(of, np.arange(len(some) + 1)) * ids.itemsize
            data = ids.tobytes()
            for piece, a, b in zip(some, ends[:-1].tolist(), ends[1:].tolist()):
                known[piece] = data[a:b]

    def _known(self, words: Words, kinds: np.ndarray) -> np.ndarray:
        """Where each word's ids are in the store, and how many bytes, as one number; what isn't there yet is encoded, each word once. -1: only its whole text can be."""
        if len(self.slots) > WORDS:
            self._forget()
        keys = mix(words.hash + kinds.astype(np.uint64))
        own, first, back = np.unique(keys, return_index=True, return_inverse=True)
        slots = list(map(self.slots.get, own.tolist()))
        new = [k for k, slot in enumerate(slots) if slot is None]
        at = first[new]
        data, start, end, kind = words.data, words.start[at], words.end[at], kinds[at]
        spelt = [bytes(data[a:b]).decode() for a, b in zip(start.tolist(), end.tolist())]
        # A word before a full stop or comma has its own ids there.
        stem_keys = mix(hashes(data, start, np.maximum(end - 1, start + 1)) + kind.astype(np.uint64)).tolist()
        asked: dict[int, str] = {}  # by key, words with what stands before them
        stems: dict[int, tuple[int, str]] = {}  # by key, the stem's key and the mark
        for word, key, stem, before in zip(spelt, own[new].tolist(), stem_keys, kind.tolist()):
            if len(word) > LONGEST or _ODD.search(word):
                self.slots[key] = -1
            elif word[-1] in _STOPS and word[-2:-1] in _LETTERS:
                stems[key] = stem, word[-1]
                if stem not in self.slots:
                    asked[stem] = _BEFORE[before] + word[:-1]
            else:
                asked[key] = _BEFORE[before] + word
        fresh: dict[str, bytes] = {}
        self._learn([*dict.fromkeys(asked.values()), *_STOPS], fresh)
        for key, word in asked.items():
            self._keep(key, fresh[word])
        for key, (stem, mark) in stems.items():
            a, n = divmod(self.slots[stem], _ROOM)
            self._keep(key, self.store[a : a + n] + fresh[mark])
        for k in new:
            slots[k] = self.slots[int(own[k])]
        return np.array(slots, np.int64)[back]

    def _keep(self, key: int, ids: bytes) -> None:
        self.slots[key] = len(self.store) * _ROOM + len(ids)
        self.store += ids

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.store = bytearray()

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word or not texts:
            return self._whole(texts)
        at, data = buffers(pa.array(texts, pa.large_string()))
        words = Words(at, data)
        n, bounds = len(words.start), words.bounds
        # What stands before each word: nothing, where its text begins, or one blank or line feed; anything else makes its text odd.
        before = np.zeros(n, np.int64)
        gap = words.start[1:] - words.end[:-1]
        mark = data[np.minimum(words.end[:-1], len(data) - 1)] if n else gap
        before[1:] = np.where(gap != 1, 3, np.where(mark == 32, 1, np.where(mark == 10, 2, 3)))
        firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
        before[firsts] = 0
        odd = np.zeros(len(texts), bool)
        held = bounds[:-1] < bounds[1:]
        odd[held] = (words.start[firsts] != at[:-1][held]) | (words.end[bounds[1:][held] - 1] != at[1:][held])
        odd[~held] = at[:-1][~held] < at[1:][~held]
        slots = self._known(words, before)
        bad = np.concatenate([[0], np.cumsum((slots < 0) | (before == 3))])
        odd |= bad[bounds[1:]] > bad[bounds[:-1]]
        item = np.dtype(self.dtype).itemsize
        first, size = (x // item for x in np.divmod(np.maximum(slots, 0), _ROOM))
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = np.frombuffer(bytes(self.store) or bytes(item), self.dtype)[np.repeat(first - ends[:-1], size) + np.arange(ends[-1])].tobytes()
        cut = (ends[bounds] * item).tolist()
        whole = np.flatnonzero(odd).tolist()
        by = dict(zip(whole, self._whole([texts[k] for k in whole])))
        return [by[k] if k in by else ids[a:b] for k, (a, b) in enumerate(zip(cut, cut[1:]))]


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _view(uri: str, dtype: str) -> np.ndarray:
    from pyarrow import fs

    where, path = _place(uri)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with where.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype)


def _keys(uri: str) -> pa.Table:
    from pyarrow import fs

    where, path = _place(uri)
    f = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
    return pa.ipc.open_file(f).read_all()


def _runs(texts: Iterable[str | None], limit: int = 1 << 22) -> Iterator[list[str]]:
    """Texts in order, about `limit` characters at a time."""
    run, size = [], 0
    for text in texts:
        run.append(text or "")
        size += len(run[-1])
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


#: Of a written range, and then of its place among all.
_MANIFEST = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("docs", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("name", T.StringType())])

_INDEX = T.StructType([*_MANIFEST, T.StructField("base", T.LongType()), T.StructField("offsets", T.StringType())])


class TokenFiles:
    """Files that are written: `index` has part, docs, tokens, name, base, offsets; `read` gives the documents back."""

    def __init__(self, folder: str, index: DataFrame, dtype: str, key: T.StructField):
        self.folder, self.index, self.dtype, self.key = folder, index, dtype, key

    def read(self) -> DataFrame:
        """Key, start (ids before the document), n_tokens, and ids (binary: unsigned little-endian 32-bit), from the files alone."""
        folder, dtype = self.folder, self.dtype
        schema = T.StructType([self.key, T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            target = to_arrow_schema(schema)
            for row in (r for b in batches for r in b.to_pylist()):
                ids, at = _view(f"{folder}/{row['name']}.ids", dtype), _view(f"{folder}/{row['offsets']}.offsets", "<i8")
                keys = _keys(f"{folder}/{row['name']}.keys").column(0).combine_chunks()
                local, k, n = at - row["base"], 0, len(at) - 1
                while k < n:
                    end = min(n, max(k + 1, int(np.searchsorted(local, local[k] + PIECE, "right")) - 1))
                    data = np.ascontiguousarray(ids[local[k] : local[end]], "<u4")
                    offsets = np.ascontiguousarray((local[k : end + 1] - local[k]) * 4, "<i4")
                    binary = pa.Array.from_buffers(pa.binary(), end - k, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                    held = keys.slice(k, end - k).cast(target.field(0).type)
                    yield pa.RecordBatch.from_arrays([held, pa.array(at[k:end], pa.int64()), pa.array(np.diff(at[k : end + 1]), pa.int64()), binary], schema=target)
                    k = end
                del ids, at, local
            give_back()

        return dealt(self.index.select("name", "base", "offsets")).mapInArrow(run, schema)


def dealt(rows: DataFrame) -> DataFrame:
    """A row for each file, dealt over all cores."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism * 4, 8))


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, text: str = "text", key: str = "doc_id") -> TokenFiles:
    """Encodes all texts with a file of the tokenizers library, `end_id` after each, in ascending order of `key`.

    The tokenizer's file must be on every machine under its path. Without `folder`, files go when the driver ends.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    size = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    work = Workspace(spark)
    folder = (folder or f"{work.folder}/files").rstrip("/")
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = named.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).orderBy(F.col("key").asc_nulls_last(), "hash", "row").select("key", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, end = TaskContext.get().partitionId(), np.array([end_id], dtype).tobytes()
        name, docs_here, tokens, ids, keys, lengths = f"{part:07d}-{uuid.uuid4().hex}", 0, 0, None, None, pa.field("length", pa.int64())
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids is None:
                where, path = _place(folder)
                where.create_dir(path, recursive=True)
                ids = where.open_output_stream(f"{path}/{name}.ids")
                of_keys = where.open_output_stream(f"{path}/{name}.keys")
                shape = pa.schema([pa.field("key", batch.schema.field(0).type), lengths])
                keys = pa.ipc.new_file(of_keys, shape)
            counts, encoder = [], Encoder.of(tokenizer, dtype)
            for run in _runs(x.as_py() for x in batch.column(1)):
                made = encoder.encode(run)
                ids.write(end.join([*made, b""]))
                counts += [len(x) // len(end) + 1 for x in made]
            keys.write_batch(pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], schema=shape))
            docs_here, tokens = docs_here + len(counts), tokens + sum(counts)
        if ids is not None:
            for f in (keys, of_keys, ids):
                f.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "docs": docs_here, "tokens": tokens, "name": name}], schema=pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("name", pa.string())]))
        give_back()

    manifest = work.table(rows.mapInArrow(encode, _MANIFEST)).withColumn("block", F.floor(F.col("part") / BLOCK))
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = manifest.groupBy("block").agg(F.sum("tokens").alias("tokens")).select("block", before(Window.orderBy("block")).alias("below"))
    based = manifest.withColumn("base", before(Window.partitionBy("block").orderBy("part"))).join(blocks, "block").withColumn("base", F.col("base") + F.col("below"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = _keys(f"{folder}/{row['name']}.keys").column(1).to_numpy()
                at = np.concatenate([[row["base"]], row["base"] + np.cumsum(lengths)]).astype("<i8")
                row["offsets"] = f"{row['name']}-{uuid.uuid4().hex}"
                where, path = _place(f"{folder}/{row['offsets']}.offsets")
                with where.open_output_stream(path) as f:
                    f.write(at.tobytes())
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([*batch.schema, pa.field("offsets", pa.string())]))

    dealt(based.select(*_INDEX.names[:-1])).mapInArrow(place, _INDEX).write.parquet(f"{folder}/index")
    return opened(spark, folder, dtype, named.schema["key"].dataType, key)


def opened(spark: SparkSession, folder: str, dtype: str = "<u2", key_type: T.DataType | None = None, key: str = "doc_id") -> TokenFiles:
    """Files that were written before."""
    return TokenFiles(folder.rstrip("/"), spark.read.schema(_INDEX).parquet(f"{folder.rstrip('/')}/index"), dtype, T.StructField(key, key_type or T.LongType()))
