import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from quire.llm import gif, queries


def test_lzw_round_trips():
    rng = random.Random(1)
    for bits in (2, 4, 8):
        for n in (0, 1, 2, 5, 3000, 40000):
            for alphabet in (1, 2, 1 << bits):
                data = bytes(rng.randrange(alphabet) for _ in range(n))
                assert gif.lzw_decode(gif.lzw_encode(data, bits), bits, n) == data


def test_known_stream():
    """The 10 by 10 sample picture of the format's public descriptions."""
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    image = gif.lzw_decode(stream, 2, 100)
    assert len(image) == 100 and list(image[:10]) == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2] and set(image) == {0, 1, 2}


def picture(frames, size=(4, 2), palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0x81, 0, 0), bytes(v for c in palette for v in c)]
    for left, top, w, h, samples, disposal, clear, delay, flags, local in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), delay, clear or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags | (0x81 if local else 0)))
        out.append(bytes(v for c in local for v in c) if local else b"")
        out.append(b"\x02" + gif._blocks(gif.lzw_encode(bytes(samples), 2)))
    return b"".join([*out, b"\x21\xfe\x03abc\x00", b"\x3b"])


def canvases(image):
    return [f["canvas"].copy() for f in gif.decode_gif(image)]


def test_disposal_transparency_and_palettes():
    full = [0, 0, 4, 2, [1] * 8]
    spot = [1, 0, 2, 1, [2, 3]]
    red, green, blue, black = (255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0)
    local = ((9, 9, 9), (8, 8, 8), (7, 7, 7), (6, 6, 6))
    for disposal, left in ((1, [red, green, blue, red]), (2, [red, black, black, red]), (3, [red] * 4)):
        made = canvases(picture([(*full, 1, None, 4, 0, None), (*spot, disposal, None, 5, 0, None), (3, 1, 1, 1, [0], 1, 0, 6, 0, None)]))
        assert made[1][0].tolist() == [list(c) for c in (red, green, blue, red)]
        assert made[2][0].tolist() == [list(c) for c in left]
        assert made[2][1].tolist() == [list(red)] * 4  # the last frame is clear
    made = canvases(picture([(*full, 1, None, 4, 0, None), (*spot, 1, 3, 5, 0, local)]))
    assert made[1][0].tolist() == [list(red), [7, 7, 7], list(red), list(red)]
    frames = list(gif.decode_gif(picture([(*full, 1, None, 4, 0, None), (*spot, 1, None, 5, 0, None)])))
    assert [(f["start_ms"], f["delay_ms"]) for f in frames] == [(0, 40), (40, 50)]


def test_interlace():
    rows = [0, 8, 4, 12, 2, 6, 10, 14, 1, 3, 5, 7, 9, 11, 13, 15]
    samples = [r % 4 for r in rows]
    made = list(gif.decode_gif(picture([(0, 0, 1, 16, samples, 0, None, 0, 0x40, None)], size=(1, 16))))
    assert made[0]["samples"].tolist() == [r % 4 for r in range(16)]


def test_query_reads_back_what_it_stored(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op8_gif(spark, small).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        cells = [int(x) for x in r.feature.split("colours=")[1].split(",")]
        grey = np.frombuffer(payload, np.uint8) >> 6
        assert [cells[21 * k] for k in range(4)] == np.bincount(grey, minlength=4).tolist() and sum(cells) >= len(payload)


@pytest.fixture(scope="module")
def odd(spark):
    long = "".join(chr(97 + k * k % 26) for k in range(200_000))
    rows = [(1, None, "m"), (2, "", "m"), (3, "é😀", "m"), (4, long, "m"), (4, long, "m")]
    return gif.encode(spark.createDataFrame(rows, "doc_id long, text string, media string"))


def test_edge_rows(spark, odd):
    rows = gif.decode(odd).collect()
    sizes = sorted((r.doc_id, r.n_bytes, len(r.payload), len(r.frames), r.error) for r in rows)
    assert sizes == [(1, 0, 64, 1, None), (2, 0, 64, 1, None), (3, 6, 64, 1, None), *[(4, 200000, 200000, 7, None)] * 2]
    broken = spark.createDataFrame([(None,), (b"",), (b"GIF89a",), (b"GIF89a" + bytes(40),)], "media binary")
    assert all(r.payload is None and r.frames == [] and r.error for r in gif.decode(broken).collect())
    assert gif.decode(gif.encode(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def plain_encode(payload):
    """The stored form, written anew: one table of byte strings, one bit after another."""
    out = bytearray(b"GIF89a")
    parts = [payload[k : k + 64 * 512] for k in range(0, len(payload), 64 * 512)]
    out += struct.pack("<HHBBB", 64, len(parts[0]) // 64, 0xF7, 0, 0)
    for grey in range(256):
        out += bytes([grey] * 3)
    for part in parts:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 4, 4, 0, 0) + struct.pack("<BHHHHB", 0x2C, 0, 0, 64, len(part) // 64, 0) + b"\x08"
        bits, known, width, string = [], {}, 9, b""

        def put(code, width, bits=bits):
            bits += [code >> i & 1 for i in range(width)]

        put(256, 9)
        known = {bytes([k]): k for k in range(256)}
        free = 258
        for byte in part:
            if string + bytes([byte]) in known:
                string += bytes([byte])
                continue
            put(known[string], width)
            if free < 4096:
                known[string + bytes([byte])] = free
                if free == 1 << width and width < 12:
                    width += 1
                free += 1
            else:
                put(256, width)
                known, free, width = {bytes([k]): k for k in range(256)}, 258, 9
            string = bytes([byte])
        put(known[string], width)
        if free == 1 << width and width < 12:
            width += 1
        put(257, width)
        bits += [0] * (-len(bits) % 8)
        raw = bytes(sum(b << i for i, b in enumerate(bits[k : k + 8])) for k in range(0, len(bits), 8))
        for k in range(0, len(raw), 255):
            out += bytes([len(raw[k : k + 255])]) + raw[k : k + 255]
        out += b"\0"
    return bytes(out + b";")


def test_stored_form_agrees_with_another_encoder(spark, small):
    rng = random.Random(3)
    for n, alphabet in ((64, 256), (128, 1), (6400, 3), (64 * 700, 256), (64 * 300, 20), (64 * 1100, 2)):
        payload = bytes(rng.randrange(alphabet) for _ in range(n))
        assert gif.encode_payload(payload) == plain_encode(payload), (n, alphabet)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op8_gif(spark, small).collect():
        raw = (docs[r.doc_id] or "").encode()
        image = plain_encode(raw + bytes(-len(raw) % 64 if raw else 64))
        assert (r.media_bytes, r.media_sha256) == (len(image), hashlib.sha256(image).hexdigest())


def codes_of(codes, width=3):
    bits = [c >> i & 1 for c in codes for i in range(width)]
    return np.packbits(bits, bitorder="little").tobytes()


def test_streams_that_break_the_format():
    assert gif.lzw_decode(codes_of([4, 1, 6, 5]), 2, 10) == bytes([1, 1, 1])
    for codes in ([4, 1, 7, 5], [4, 6, 1, 5], [4, 1, 4, 6, 5]):
        with pytest.raises(ValueError):
            gif.lzw_decode(codes_of(codes), 2, 10)
    for bits in (0, 1, 9, 255):
        with pytest.raises(ValueError):
            gif.lzw_decode(b"", bits, 10)


def test_sizes_are_checked_before_memory_is_taken(spark):
    head = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0)
    frame = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x01\x00\x00;"
    rows = gif.decode(spark.createDataFrame([(head,), (frame,)], "media binary")).collect()
    assert [(r.payload, r.frames) for r in rows] == [(None, []), (None, [])] and all("pixels" in r.error for r in rows)
    # A full table whose longest entry is called for again and again.
    zeros = gif.lzw_encode(bytes(8_000_000), 2)[:5000]
    bits = np.unpackbits(np.frombuffer(zeros, np.uint8), bitorder="little")
    bomb = np.packbits(np.concatenate([bits[: len(bits) // 12 * 12], np.ones(12 * 400_000, np.uint8)]), bitorder="little").tobytes()
    try:
        assert len(gif.lzw_decode(bomb, 2, 1000)) == 1000
    except (ValueError, IndexError):
        pass


def test_names_that_clash(spark):
    frame = spark.createDataFrame([(1, "a", "m", "n")], "doc_id long, text string, MEDIA string, N_Bytes string")
    made = gif.encode(frame)
    assert made.columns == ["doc_id", "text", "media", "n_bytes"]
    assert gif.decode(made.withColumnRenamed("n_bytes", "Frames")).columns == ["doc_id", "text", "media", "payload", "frames", "error"]
