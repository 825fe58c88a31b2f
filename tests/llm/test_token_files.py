import random
import zlib
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pytest
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from quire.llm import queries
from quire.llm import token_files as F

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay as they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(texts, path=BYTES):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["foo", "bar's", "don't", ".", ",", "...", ". ", " ", " ", " ", "  ", "\n", "\n\n", "\t", "é", "ж", "漢", " ", "　", "\0", "\x1c", "\x85", "12", "3a", "<|endoftext|>", "ab.", "cd,", "x.y", "🙂", "'", "A" * 50, "\r\n"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_pieces_have_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(F, "WORDS", 200)  # forgets, and remembers again
    texts = odd_texts(4000)
    encoder = F.Encoder(BYTES, "<u2")
    assert encoder.by_word
    made = [x for k in range(0, len(texts), 37) for x in encoder.encode(texts[k : k + 37])]
    assert [np.frombuffer(x, "<u2").tolist() for x in made] == plain(texts)


def test_other_tokenizers_encode_whole_texts():
    encoder = F.Encoder(WORDS, "<u4")
    assert not encoder.by_word
    texts = odd_texts(300)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == plain(texts, WORDS)


def check(spark, rows, end=2, kind="long", path=BYTES, **how):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], f"doc_id {kind}, text string, start int, ids string").repartition(4)
    files = F.write(frame, path, end, **how)
    got = files.read().orderBy("start").collect()
    starts = [r.start for r in got]
    lengths = [r.n_tokens for r in got]
    assert starts == np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(int).tolist() if got else not rows
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is None, i))
    ids = {t: (*x, end) for (_, t), x in zip(rows, plain([t for _, t in rows], path))}
    made = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got]
    assert sorted(made, key=repr) == sorted(((i, ids[t]) for i, t in rows), key=repr)
    assert all(len(m) == n for (_, m), n in zip(made, lengths))
    return files, got


def test_round_trip_of_odd_rows(spark):
    rows = list(enumerate(odd_texts(300, 2)))
    rows += [(None, "no id"), (None, None), (None, "no id"), (7, "again"), (7, "again"), (7, "other"), (-5, ""), (-6, None), (10**15, "word " * 50_000)]
    check(spark, rows)


def test_a_hot_key_is_spread_and_places_are_defined(spark, many_ranges):
    rows = [(1, f"text {k % 50}") for k in range(3000)] + [(k, "x") for k in range(1000)]
    files, got = check(spark, rows)
    assert files.index.count() > 1
    again = F.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), BYTES, 2).read().orderBy("start").collect()
    assert [(r.doc_id, r.start, bytes(r.ids)) for r in got] == [(r.doc_id, r.start, bytes(r.ids)) for r in again]


def test_empty_table(spark):
    files, got = check(spark, [])
    assert got == [] and files.index.count() == 0


def test_other_keys_and_wider_ids(spark):
    check(spark, [("b", "two"), ("a", "one"), (None, "three"), ("é", "four")], kind="string")
    files, _ = check(spark, [(1, "one"), (2, "two")], end=70_000)
    assert files.dtype == "<u4"


def test_blocks_of_the_prefix_sums(spark, many_ranges, monkeypatch):
    monkeypatch.setattr(F, "BLOCK", 2)
    files, _ = check(spark, [(k, f"text number {k}") for k in range(200)])
    assert files.index.count() > 4


def test_pieces_that_are_read_at_once(spark, monkeypatch):
    monkeypatch.setattr(F, "PIECE", 3)
    check(spark, [(k, "word " * (k % 7)) for k in range(60)])


def test_files_of_a_folder(spark, many_ranges, tmp_path):
    rows = [(k, f"text {k}") for k in range(50)]
    files, got = check(spark, rows, folder=f"file://{tmp_path}/corpus")
    index = sorted(files.index.collect(), key=lambda r: r.base)
    folder = urlparse(files.folder).path
    flat = np.concatenate([np.fromfile(f"{folder}/{r.name}.ids", "<u2") for r in index])
    assert flat.tolist() == [x for ids in plain([t for _, t in rows]) for x in (*ids, 2)]
    offsets = [np.fromfile(f"{folder}/{r.offsets}.offsets", "<i8") for r in index]
    assert all(a[-1] == b[0] for a, b in zip(offsets, offsets[1:])) and offsets[-1][-1] == len(flat)
    Path(folder, "0000000-orphan.ids").write_bytes(b"of a task that was lost")
    again = F.opened(spark, files.folder).read().orderBy("start").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in got]


def test_query(spark, small):
    docs = sorted(pq.read_table(f"{small}/documents.parquet").select(["doc_id", "text"]).to_pylist(), key=lambda r: r["doc_id"])
    at, expected = 0, []
    for r, ids in zip(docs, plain([r["text"] for r in docs])):
        ids = [*ids, 2]
        expected.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.op13_token_files(spark, small).collect())) == expected
