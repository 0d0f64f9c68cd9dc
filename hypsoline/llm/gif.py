"""GIF as a media column: LZW code streams, palettes, disposal and transparency, timed frames, colour histograms."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import col, map_arrow

WIDTH = 192
#: The height of a frame that encode_samples() makes; longer payloads become more frames.
HEIGHT = 1024
#: Hundredths of a second that such a frame is shown.
DELAY = 4
GREY = bytes(v for i in range(256) for v in (i, i, i))


def widths(n: int, min_size: int) -> np.ndarray:
    """The widths of the n codes after a clear code: code i is read with max(0, i - 1) + 1 entries more in the table."""
    entries = (1 << min_size) + 1 + np.arange(n)  # entries in the table when code i is read
    entries[:1] += 1
    return np.minimum(12, np.maximum(min_size + 1, np.floor(np.log2(entries)).astype(np.int64) + 1))


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """The code stream of 8-bit samples, codes packed from the low bit; the table is cleared when it is full."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    codes, ends = [clear], [0]  # ends: where in codes the clear codes stand
    append = codes.append
    table: dict[int, int] = {}
    free = end + 1
    if data:
        prefix = data[0]
        for byte in data[1:]:
            key = prefix << 8 | byte
            if key in table:
                prefix = table[key]
                continue
            append(prefix)
            if free < 4096:
                table[key] = free
                free += 1
            else:
                ends.append(len(codes))
                append(clear)
                table = {}
                free = end + 1
            prefix = byte
        append(prefix)
    append(end)
    sizes = np.empty(len(codes), np.int64)
    sizes[0] = min_size + 1
    for a, b in zip(ends, [*ends[1:], len(codes) - 1], strict=True):
        sizes[a + 1 : b + 1] = widths(b - a, min_size)
    at = np.cumsum(sizes) - sizes
    value = np.array(codes, dtype=np.uint32) << (at & 7).astype(np.uint32)
    out = np.zeros((int(at[-1] + sizes[-1]) + 7) // 8 + 3, np.uint8)
    first = at >> 3
    for k in range(3):  # codes share bytes, but their bits are apart, so sums of them are unions
        out += np.bincount(first + k, (value >> np.uint32(8 * k)) & np.uint32(255), minlength=len(out)).astype(np.uint8)
    return out[: (int(at[-1] + sizes[-1]) + 7) // 8].tobytes()


def lzw_decode(stream: bytes, min_size: int, most: int) -> bytes:
    """At most `most` samples of a code stream. A stream that ends early gives what it has; a code that can't be
    there raises ValueError.

    The widths of codes follow from their place after the last clear code, so a stretch of codes is unpacked at once.
    """
    clear, end = 1 << min_size, (1 << min_size) + 1
    start = [bytes((i,)) for i in range(clear)] + [b"", b""]
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    total = len(stream) * 8
    bit, out, size, done = 0, [], 0, 0
    put = out.append
    chunk = min(8192, total // (min_size + 1) + 1)
    step = widths(chunk, min_size)
    offsets = np.cumsum(step) - step
    while bit < total and size < most:
        table, before, seen = list(start), None, 0  # seen: codes since the clear code
        append = table.append
        while True:
            if seen:  # a table that stays full: all codes have the full width
                w = np.full(chunk, 12, np.int64)
                at = bit + np.arange(chunk) * w
            else:
                w, at = step, bit + offsets
            fits = int(np.searchsorted(at + w, total, side="right"))
            at, w = at[:fits], w[:fits]
            i = at >> 3
            got = ((raw[i] | raw[i + 1] << np.uint32(8) | raw[i + 2] << np.uint32(16)) >> (at & 7).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)
            stops = np.flatnonzero((got == clear) | (got == end))
            n = int(stops[0]) if len(stops) else len(got)
            codes = got[:n].tolist()
            if codes and before is None:
                if codes[0] > end:
                    raise ValueError("first code out of range")
                before = table[codes[0]]
                put(before)
                codes = codes[1:]
            room = 4096 - len(table)
            for code in codes[:room]:  # each code adds an entry
                try:
                    entry = table[code]
                except IndexError:
                    if code != len(table):
                        raise ValueError("code out of range") from None
                    entry = before + before[:1]
                put(entry)
                append(before + entry[:1])
                before = entry
            if len(codes) > room:
                out += [table[code] for code in codes[room:]]
                before = out[-1]
            size = sum(map(len, out[done:])) + size
            done = len(out)
            if size >= most:
                return b"".join(out)[:most]
            if len(stops):
                bit = int(at[n] + w[n])
                if got[n] == end:
                    return b"".join(out)[:most]
                break
            if fits < chunk:
                return b"".join(out)[:most]
            bit, seen = int(at[-1] + w[-1]), 1
    return b"".join(out)[:most]


def blocks(data: bytes) -> bytes:
    """data as sub-blocks of up to 255 bytes, with the block that ends them."""
    return b"".join(bytes((len(part),)) + part for part in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode_frames(width: int, height: int, palette: bytes, frames: list[dict], loop: bool = False) -> bytes:
    """A GIF89a file. A frame: indices (bytes), left, top, width, height, delay, disposal, transparent (or None),
    palette (or None)."""
    depth = max(1, (len(palette) // 3 - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | 0x70 | depth - 1, 0, 0), palette.ljust(3 << depth, b"\0")]
    if loop:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for f in frames:
        clear = f.get("transparent")
        out.append(struct.pack("<4BHBB", 0x21, 0xF9, 4, f.get("disposal", 1) << 2 | (clear is not None), f.get("delay", DELAY), clear or 0, 0))
        own = f.get("palette")
        bits = max(1, (len(own) // 3 - 1).bit_length()) if own else 0
        out.append(struct.pack("<BHHHHB", 0x2C, f.get("left", 0), f.get("top", 0), f["width"], f["height"], 0x80 | bits - 1 if own else 0))
        if own:
            out.append(own.ljust(3 << bits, b"\0"))
        out += [b"\x08", blocks(lzw_encode(f["indices"]))]
    return b"".join([*out, b"\x3b"])


def encode_samples(samples: bytes, width: int = WIDTH, height: int = HEIGHT) -> bytes:
    """8-bit samples, whole rows of them, as frames with a grey palette, of which each sample is an index."""
    size = width * height
    parts = [samples[i : i + size] for i in range(0, len(samples), size)]
    tall = min(height, len(samples) // width)
    return encode_frames(width, tall, GREY, [{"indices": p, "width": width, "height": len(p) // width} for p in parts])


def _order(rows: int) -> np.ndarray:
    """The picture's row of each stored row of an interlaced frame."""
    return np.concatenate([np.arange(a, rows, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode_gif(data: bytes, most_pixels: int = 1 << 26, copies: bool = True) -> Iterator[dict]:
    """The frames as shown: rgba canvas, delay and start in milliseconds, the frame's own rectangle. Without copies, the
    canvas is the decoder's own and holds until the next frame is asked for.

    Disposal: 0 and 1 leave the frame, 2 clears its rectangle to transparent, 3 puts back what was there before.
    Transparent indices leave the canvas. Raises ValueError on what is not a GIF, is cut off before its trailer,
    or has a canvas or frame of more than `most_pixels`, the memory bound.
    """

    def need(at: int, n: int) -> bytes:
        if at + n > len(data):
            raise ValueError("cut off")
        return data[at : at + n]

    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", need(6, 7))
    if width * height > most_pixels:
        raise ValueError("too large")
    at = 13
    shared = None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        shared, at = np.frombuffer(need(at, n), np.uint8).reshape(-1, 3), at + n
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = 0
    clear = None
    number, start = 0, 0

    def chain(at: int) -> tuple[bytes, int]:
        parts = []
        while n := need(at, 1)[0]:
            parts.append(need(at + 1, n))
            at += 1 + n
        return b"".join(parts), at + 1

    while True:
        mark = need(at, 1)[0]
        if mark == 0x3B:
            return
        if mark == 0x21:
            label = need(at + 1, 1)[0]
            body, at = chain(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0] * 10
                clear = body[3] if body[0] & 1 else None
            continue
        if mark != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, flags = struct.unpack("<HHHHB", need(at + 1, 9))
        if w * h > most_pixels:
            raise ValueError("too large")
        at += 10
        palette = shared
        if flags & 0x80:
            n = 3 << (flags & 7) + 1
            palette, at = np.frombuffer(need(at, n), np.uint8).reshape(-1, 3), at + n
        if palette is None:
            raise ValueError("no palette")
        min_size = need(at, 1)[0]
        if not 1 <= min_size <= 11:
            raise ValueError("bad code size")
        stream, at = chain(at + 1)
        got = np.frombuffer(lzw_decode(stream, min_size, w * h), np.uint8)
        if len(got) < w * h:
            raise ValueError("cut off")
        indices = np.empty((h, w), np.uint8)
        if flags & 0x40:
            indices[_order(h)] = got.reshape(h, w)
        else:
            indices[:] = got.reshape(h, w)
        if indices.size and indices.max() >= len(palette) and (clear is None or (indices[indices >= len(palette)] != clear).any()):
            raise ValueError("index outside the palette")
        kept = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        seen = indices[: area.shape[0], : area.shape[1]]
        opaque = np.full((256, 4), 255, np.uint8)
        opaque[: len(palette), :3] = palette
        if clear is None:
            area[:] = opaque[seen]
        else:
            area[seen != clear] = opaque[seen[seen != clear]]
        yield {"frame": number, "start_ms": start, "delay_ms": delay, "left": left, "top": top, "width": w, "height": h, "rgba": canvas.copy() if copies else canvas}
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = kept
        number, start = number + 1, start + delay
        delay = disposal = 0
        clear = None


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of 64 colours, two bits of each of red, green and blue; transparent pixels don't count."""
    px = rgba.reshape(-1, 4)
    bins = (px[:, 0] >> 6 << 4) + (px[:, 1] >> 6 << 2) + (px[:, 2] >> 6)
    return np.bincount(bins[px[:, 3] > 0], minlength=64)


def brightness(rgba: np.ndarray) -> np.ndarray:
    """Counts of 256 levels of brightness, 0.299 red + 0.587 green + 0.114 blue; transparent pixels don't count."""
    px = rgba.reshape(-1, 4)
    level = (px[:, 0] * np.uint32(299) + px[:, 1] * np.uint32(587) + px[:, 2] * np.uint32(114)) // 1000
    return np.bincount(level[px[:, 3] > 0], minlength=256)


def both_histograms(rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """histogram() and brightness(); of pixels that are grey and opaque, both follow from the counts of one channel."""
    px = np.ascontiguousarray(rgba).reshape(-1, 4)
    words = px.view("<u4")[:, 0]
    red = px[:, 0]
    if not np.array_equal(words, red * np.uint32(0x010101) + np.uint32(0xFF000000)):
        return histogram(rgba), brightness(rgba)
    levels = np.bincount(red, minlength=256)
    return np.bincount((np.arange(256) >> 6) * 21, levels, minlength=64).astype(np.int64), levels


FRAME = (
    "frame int, start_ms long, delay_ms long, left_x int, top_y int, width int, height int, rgba binary, histogram array<long>, brightness array<long>"
)


def _batched(df: DataFrame, source: Column, fields: list[T.StructField], one) -> DataFrame:
    """Adds fields, the tuple one(x) of each value of source; input columns of their names are replaced."""
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def make(rows: pa.RecordBatch, arrays: list[pa.Array]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for at in range(0, rows.num_rows, 128):
            got = [one(x.as_py()) for x in arrays[0].slice(at, 128)]
            yield rows.slice(at, 128), [pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)]

    names = {f.name.lower() for f in fields}
    return map_arrow(df, [c for c in df.columns if c.lower() not in names], [source], fields, make)


def store(df: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """Adds `out`, a GIF of the binary column `payload`, whole rows of WIDTH samples; null stays null."""
    return _batched(df, col(payload).cast("binary"), [T.StructField(out, T.BinaryType())], lambda x: (None if x is None else encode_samples(bytes(x)),))


def frames(df: DataFrame, media: str = "media") -> DataFrame:
    """A row for each frame of each GIF in `media`: df's columns, the fields of FRAME and error.

    Null media give no row; a damaged file gives the frames before the damage and then one row whose error says what
    is wrong. Input columns of these names are replaced. One frame is held at a time.
    """
    fields = [*T.StructType.fromDDL(FRAME).fields, T.StructField("error", T.StringType())]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def make(rows: pa.RecordBatch, arrays: list[pa.Array]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for i, media_ in enumerate(arrays[0]):
            try:
                for f in decode_gif(media_.as_py(), copies=False) if media_.is_valid else ():
                    row = [f["frame"], f["start_ms"], f["delay_ms"], f["left"], f["top"], f["width"], f["height"], f["rgba"].tobytes(), *[h.tolist() for h in both_histograms(f["rgba"])], None]
                    yield rows.slice(i, 1), [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]
            except ValueError as e:
                yield rows.slice(i, 1), [pa.array([v], k) for v, k in zip([None] * 10 + [str(e)], kinds, strict=True)]

    names = {f.name.lower() for f in fields}
    return map_arrow(df, [c for c in df.columns if c.lower() not in names], [col(media)], fields, make)


READ = "payload binary, n_frames int, duration_ms long, area long, histogram array<long>, brightness array<long>, error string"


def read_back(data: bytes | None) -> tuple:
    """The fields of READ of a GIF: what store() put in, and sums over its frames' own rectangles."""
    if data is None:
        return (None,) * 7
    parts, colours, levels, n, ms, area = [], np.zeros(64, np.int64), np.zeros(256, np.int64), 0, 0, 0
    error = None
    try:
        for f in decode_gif(bytes(data), copies=False):
            own = f["rgba"][f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"]]
            parts.append(own[:, :, 0].tobytes())
            shown = both_histograms(own)
            colours, levels = colours + shown[0], levels + shown[1]
            n, ms, area = n + 1, ms + f["delay_ms"], area + f["width"] * f["height"]
    except ValueError as e:
        error = str(e)
    return None if error else b"".join(parts), n, ms, area, colours.tolist(), levels.tolist(), error


def samples(df: DataFrame, media: str = "media") -> DataFrame:
    """Adds the fields of READ, from the GIFs of the column `media`. Null media give nulls; a damaged file gives no payload,
    the sums of the frames before the damage, and what is wrong."""
    return _batched(df, col(media), T.StructType.fromDDL(READ).fields, read_back)


def stored(df: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """store() and samples() in one pass: the GIF is read back from its own bytes where it is made."""
    fields = [T.StructField(out, T.BinaryType()), *T.StructType.fromDDL(READ).fields]

    def one(x: bytes | None) -> tuple:
        media = None if x is None else encode_samples(bytes(x))
        return media, *read_back(media)

    return _batched(df, col(payload).cast("binary"), fields, one)


def op5(docs: DataFrame) -> DataFrame:
    """The contract's digests of each text's payload as stored in a GIF and read back. The feature says how many frames of
    what area and duration there are, and the counts of each brightness that occurs."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    n = F.octet_length(raw)
    padded = (F.greatest(F.lit(1), F.ceil(n / F.lit(WIDTH)))) * WIDTH
    given = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat(raw, F.repeat(F.lit(" "), (padded - n).cast("int")).cast("binary")).alias("given"))
    back = stored(given, "given").drop("given")
    levels = F.transform("brightness", lambda n, i: F.struct(i.alias("i"), n.alias("n")))
    seen = F.transform(F.filter(levels, lambda x: x["n"] > 0), lambda x: F.concat_ws("=", x["i"], x["n"]))
    feature = F.concat_ws(";", F.concat_ws("/", "n_frames", "area", "duration_ms"), F.array_join(seen, ","))
    tail = F.expr("substring(payload, -16, 16)")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        "n_frames",
        "duration_ms",
    )
