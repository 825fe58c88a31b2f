"""GIF images as columns: lossless storage of byte payloads, decoding of frames, and colour histograms.

`encode` stores texts as greyscale animations; `decode` reads any GIF: LZW code
streams of variable width, local and global palettes, interlace, disposal and
transparency. Both are maps over Arrow batches without a shuffle; a task holds
one slice of a batch.

Defined results: a null or empty text is stored as one row of zero samples; a
very long text as many frames; an empty table stays empty. A null or damaged
image decodes to no frames, a null payload and `error` set, as does one whose
header asks for more than `PIXELS` pixels, before any of them is allocated, and
one whose code stream breaks the format. Repeated rows are stored alike; columns
of the input that are named like an output column (in any case) are replaced by
it, all others are passed on.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.columns import without
from quire.llm.kernel import buffers

WIDTH = 64
ROWS = 512
DELAY_MS = 40
#: Pixels of the largest canvas or frame that is decoded.
PIXELS = 1 << 24
#: Bytes of media that one output batch holds, about.
SLICE = 8 << 20

FRAME = T.StructType(
    [
        T.StructField("index", T.IntegerType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("delay_ms", T.IntegerType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("top", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("disposal", T.IntegerType()),
        T.StructField("histogram", T.ArrayType(T.LongType())),
    ]
)


def _widths(bits: int) -> np.ndarray:
    """Code widths by position after a clear code, for roots of `bits` bits; beyond the end all are 12."""
    first = (1 << bits) + 2
    out, width, at = [], bits + 1, first
    while width < 12:
        out += [width] * ((1 << width) - at + (at == first))
        at, width = 1 << width, width + 1
    return np.array(out, np.int64)


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """GIF's LZW code stream of samples below 2^bits, packed with the lowest bit first."""
    clear = 1 << bits
    codes: list[int] = []
    cuts: list[int] = []
    known: dict[int, int] = {}
    free = clear + 2
    if samples:
        at = samples[0]
        for sample in samples[1:]:
            key = at << 8 | sample
            code = known.get(key)
            if code is not None:
                at = code
                continue
            codes.append(at)
            if free < 4096:
                known[key] = free
                free += 1
            else:
                codes.append(clear)
                cuts.append(len(codes))
                known, free = {}, clear + 2
            at = sample
        codes.append(at)
    codes.append(clear + 1)
    schedule = _widths(bits)
    widths = np.full(len(codes), 12, np.int64)
    for a, b in zip([0, *cuts], [*cuts, len(codes)]):
        n = min(b - a, len(schedule))
        widths[a : a + n] = schedule[:n]
    values = np.concatenate([[clear], codes]).astype(np.uint16)
    widths = np.concatenate([[bits + 1], widths])
    raw = np.unpackbits(values.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")[:, :12]
    return np.packbits(raw[np.arange(12) < widths[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """Samples of a code stream; decoding ends at its end code, its last whole code or after `most` samples.

    A first code that is no sample, and a code beyond the next free one, are errors.
    """
    if not 2 <= bits <= 8:
        raise ValueError("samples of no permitted size")
    clear = 1 << bits
    raw = np.unpackbits(np.frombuffer(stream, np.uint8), bitorder="little")
    schedule = _widths(bits)
    runs = [(int(w), int((schedule == w).sum())) for w in range(bits + 1, 12)]
    roots = [bytes([k]) for k in range(clear)] + [b"", b""]
    room = 4096 - len(roots)
    out: list[bytes] = []
    at = made = 0

    def put(table: list[bytes], codes) -> None:
        """Entries of a full table; few codes may stand for more samples than memory holds, so they end with `most`."""
        nonlocal made
        if len(codes):
            upto = made + np.cumsum(np.array([len(x) for x in table])[codes])
            n = int(np.searchsorted(upto, most)) + 1
            out.extend(table[c] for c in np.asarray(codes)[:n].tolist())
            made = int(upto[min(n, len(upto)) - 1])

    while made < most:
        found, pos = [], at
        for width, count in [*runs, (12, None)]:
            left = (len(raw) - pos) // width
            count = left if count is None else min(count, left)
            if width == 12:
                count = min(count, 1 << 16)
            part = raw[pos : pos + count * width].reshape(count, width) @ (1 << np.arange(width))
            stop = np.flatnonzero((part == clear) | (part == clear + 1))
            if len(stop):
                part = part[: stop[0] + 1]
            found.append(part)
            pos += len(part) * width
            if len(stop) or count == 0:
                break
        codes = np.concatenate(found).tolist()
        if not codes:
            break
        last = codes[-1]
        ended = last in (clear, clear + 1)
        if ended:
            codes.pop()
        if codes:
            if codes[0] >= clear:
                raise ValueError("a first code that is no sample")
            new = np.array(codes[1 : room + 1], np.int64)
            if (new > len(roots) + np.arange(len(new))).any():
                raise ValueError("a code beyond the table")
            table = roots.copy()
            prior = table[codes[0]]
            part = [prior]
            for code in codes[1 : room + 1]:
                entry = table[code] if code < len(table) else prior + prior[:1]
                table.append(prior + entry[:1])
                part.append(entry)
                prior = entry
            out += part
            made += sum(map(len, part))
            put(table, codes[room + 1 :])
        if last == clear + 1 or made >= most:
            break
        if not ended:  # a full table without a clear code goes on with codes of 12 bits
            if len(raw) - pos < 12:
                break
            rest = raw[pos : pos + (len(raw) - pos) // 12 * 12].reshape(-1, 12) @ (1 << np.arange(12))
            stop = np.flatnonzero((rest == clear) | (rest == clear + 1))
            put(table, rest[: stop[0]] if len(stop) else rest)
            if not len(stop) or rest[stop[0]] == clear + 1:
                break
            pos += (int(stop[0]) + 1) * 12
        at = pos
    return b"".join(out)[:most]


def _blocks(stream: bytes) -> bytes:
    return b"".join(bytes([len(part)]) + part for part in (stream[k : k + 255] for k in range(0, len(stream), 255))) + b"\0"


_GREYS = bytes(np.repeat(np.arange(256, dtype=np.uint8), 3))


def encode_payload(payload: bytes) -> bytes:
    """A GIF whose frames hold the payload's bytes as grey samples, 64 in a row; its length is a multiple of 64."""
    frames = [payload[k : k + WIDTH * ROWS] for k in range(0, len(payload), WIDTH * ROWS)]
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, len(frames[0]) // WIDTH, 0xF7, 0, 0), _GREYS]
    for samples in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, DELAY_MS // 10, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(samples) // WIDTH, 0))
        out.append(b"\x08" + _blocks(lzw_encode(samples)))
    return b"".join([*out, b"\x3b"])


def _interlaced(rows: np.ndarray) -> np.ndarray:
    out, at = np.empty_like(rows), 0
    for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)):
        n = len(range(first, len(rows), step))
        out[first::step] = rows[at : at + n]
        at += n
    return out


def decode_gif(image: bytes) -> Iterator[dict]:
    """Timed frames: place, delay, disposal, `samples` (palette indices) and `canvas` (the picture shown, RGB)."""
    if image[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, back = struct.unpack_from("<HHBB", image, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(image, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    if width * height > PIXELS:
        raise ValueError(f"a canvas of {width * height} pixels")
    ground = shared[back] if shared is not None and back < len(shared) else np.zeros(3, np.uint8)
    canvas = np.empty((height, width, 3), np.uint8)
    canvas[:] = ground
    delay, disposal, clear, clock, index = 0, 0, None, 0, 0

    def data(at: int) -> tuple[bytes, int]:
        parts = []
        while image[at]:
            parts.append(image[at + 1 : at + 1 + image[at]])
            at += 1 + image[at]
        return b"".join(parts), at + 1

    while at < len(image) and image[at] != 0x3B:
        mark = image[at]
        if mark == 0x21:
            label = image[at + 1]
            body, at = data(at + 2)
            if label == 0xF9 and len(body) >= 4:
                how, ticks, see = struct.unpack_from("<BHB", body)
                delay, disposal, clear = ticks * 10, how >> 2 & 7, see if how & 1 else None
        elif mark == 0x2C:
            left, top, w, h, how = struct.unpack_from("<HHHHB", image, at + 1)
            at += 10
            palette = shared
            if how & 0x80:
                n = 2 << (how & 7)
                palette = np.frombuffer(image, np.uint8, 3 * n, at).reshape(n, 3)
                at += 3 * n
            if w * h > PIXELS:
                raise ValueError(f"a frame of {w * h} pixels")
            bits = image[at]
            stream, at = data(at + 1)
            samples = np.frombuffer(lzw_decode(stream, bits, w * h), np.uint8)
            if len(samples) < w * h:
                raise ValueError("a frame lacks samples")
            if how & 0x40:
                samples = _interlaced(samples.reshape(h, w)).reshape(-1)
            if palette is None:
                raise ValueError("a frame has no palette")
            kept = canvas.copy() if disposal == 3 else None
            rows, columns = max(0, min(h, height - top)), max(0, min(w, width - left))
            grid = samples.reshape(h, w)[:rows, :columns]
            if len(grid) and int(grid.max(initial=0)) >= len(palette):
                raise ValueError("a sample lies outside its palette")
            area = canvas[top : top + rows, left : left + columns]
            if clear is None:
                area[:] = palette[grid]
            else:
                seen = grid != clear
                area[seen] = palette[grid[seen]]
            yield {"index": index, "start_ms": clock, "delay_ms": delay, "left": left, "top": top, "width": w, "height": h, "disposal": disposal, "samples": samples, "canvas": canvas}
            if disposal == 2:
                area[:] = ground
            elif kept is not None:
                canvas = kept
            clock, index = clock + delay, index + 1
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("an unknown block")


def colour_histogram(canvas: np.ndarray) -> list[int]:
    """Pixels in each of 64 cells, by the two highest bits of red, green and blue."""
    high = canvas.reshape(-1, 3) >> 6
    return np.bincount(high[:, 0] * 16 + high[:, 1] * 4 + high[:, 2], minlength=64).tolist()


def _over(frame: DataFrame, make, added: list[T.StructField]) -> DataFrame:
    kept = without(frame.columns, [f.name for f in added])
    schema = T.StructType([f for f in frame.schema.fields if f.name in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for a, b, columns in make(batch):
                old = [batch.column(batch.schema.get_field_index(c)).slice(a, b - a).cast(target.field(c).type) for c in kept]
                new = [pa.array(v, target.field(f.name).type) for f, v in zip(added, columns)]
                yield pa.RecordBatch.from_arrays([*old, *new], schema=target)

    return frame.mapInArrow(run, schema)


def encode(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `media` (a GIF of the text's UTF-8 bytes, padded with zeros to a positive multiple of 64) and `n_bytes` (before padding)."""

    def make(batch):
        at, data = buffers(batch.column(batch.schema.get_field_index(text)))
        raw, known = data.tobytes(), {}
        a, held, media, sizes = 0, 0, [], []
        for i in range(len(at) - 1):
            payload = raw[at[i] : at[i + 1]]
            image = known.get(payload)
            if image is None:
                image = known[payload] = encode_payload(payload + bytes(-len(payload) % WIDTH if payload else WIDTH))
            media.append(image)
            sizes.append(len(payload))
            held += len(image)
            if held > SLICE:
                yield a, i + 1, (media, sizes)
                a, held, media, sizes, known = i + 1, 0, [], [], {}
        if media:
            yield a, len(at) - 1, (media, sizes)

    return _over(docs, make, [T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())])


def decode(images: DataFrame, media: str = "media") -> DataFrame:
    """Adds `payload` (all frames' samples), `frames` (timed, with colour histograms) and `error`."""

    def make(batch):
        column, known = batch.column(batch.schema.get_field_index(media)), {}
        a, held, out = 0, 0, ([], [], [])
        for i, image in enumerate(column):
            image = image.as_py()
            got = known.get(image)
            if got is None:
                payload, frames, error = [], [], None
                try:
                    for frame in decode_gif(image or b""):
                        payload.append(frame["samples"].tobytes())
                        canvas = frame.pop("canvas")
                        del frame["samples"]
                        frames.append(frame | {"histogram": colour_histogram(canvas)})
                except (ValueError, IndexError, struct.error) as e:
                    payload, frames, error = None, [], str(e) or type(e).__name__
                got = known[image] = (None if payload is None else b"".join(payload), frames, error)
            for part, value in zip(out, got):
                part.append(value)
            held += len(image or b"") + len(got[0] or b"")
            if held > SLICE:
                yield a, i + 1, out
                a, held, out, known = i + 1, 0, ([], [], []), {}
        if out[0]:
            yield a, len(column), out

    return _over(images, make, [T.StructField("payload", T.BinaryType()), T.StructField("frames", T.ArrayType(FRAME)), T.StructField("error", T.StringType())])
