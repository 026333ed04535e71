"""TIFF columns: pages out of stored TIFF bytes, and texts stored as TIFF bytes.

The reader walks the chain of image directories (classic TIFF, either byte order), decodes strips or
tiles that are stored plainly, with PackBits, LZW or deflate, undoes the horizontal predictor and
gives one row for each page. The writer makes single- or multi-page grayscale files of 8-bit
samples with the same set of layouts. Both work on one value at a time, inside Arrow batches.

Results in special cases: null bytes have no page; bytes that are no TIFF, or break off, have one
row whose `error` is set and whose other columns are null, after the pages that could be read. Samples
of other than 8 bits, planar layout and BigTIFF are such errors. Texts are stored in one of several
layouts, by a checksum of their bytes: equal texts in the same one.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.shared import binary_views, text_frame

# Fixed values of the TIFF 6.0 format.
PLAIN, LZW, ADOBE_DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 317, 322, 323, 324, 325
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}

#: A page of more samples than this is refused: a damaged header must not take the memory.
MAX_SAMPLES = 1 << 31


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three equal bytes or more as repeats, the rest as literals."""
    a = np.frombuffer(data, np.uint8)
    out = bytearray()
    if not len(a):
        return b""
    cut = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [len(a)]])
    literal = 0
    at = 0

    def flush(to: int) -> None:
        nonlocal literal
        while literal < to:
            k = min(128, to - literal)
            out.append(k - 1)
            out.extend(data[literal : literal + k])
            literal += k

    for at, to in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if to - at >= 3:
            flush(at)
            while at < to:
                k = min(128, to - at)
                if k == 1:
                    break
                out += bytes((257 - k, data[at]))
                at += k
            literal = at
    flush(len(data))
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; the width grows one code early, as TIFF has it."""
    table: list[bytes] = [bytes((i,)) for i in range(256)] + [b"", b""]
    out = bytearray()
    held = bits = 0
    width, last = 9, None
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            if code > 255:
                raise TiffError("LZW data start with no literal")
            entry = table[code]
        elif code < len(table):
            entry = table[code]
            table.append(last + entry[:1])
        elif code == len(table):
            entry = last + last[:1]
            table.append(entry)
        else:
            raise TiffError("LZW code out of range")
        out += entry
        last = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out = bytearray()
    held = bits = 0

    def put(code: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    width, table = 9, {bytes((i,)): i for i in range(256)}
    put(256)
    nxt, have = 258, b""
    for i in range(len(data)):
        byte = data[i : i + 1]
        if have + byte in table:
            have += byte
            continue
        put(table[have])
        table[have + byte] = nxt
        nxt += 1
        have = byte
        if nxt == 4095:
            put(table[have])
            put(256)
            width, table = 9, {bytes((k,)): k for k in range(256)}
            nxt, have = 258, b""
        elif nxt == 1 << width and width < 12:
            width += 1
    if have:
        put(table[have])
        nxt += 1
        if nxt == 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _packed(block: np.ndarray, compression: int, predictor: int) -> bytes:
    """block: rows x row bytes."""
    if predictor == 2:
        block = np.diff(block, axis=1, prepend=np.uint8(0))
    data = block.tobytes()
    if compression == LZW:
        return lzw_encode(data)
    if compression in (ADOBE_DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    if compression == PACKBITS:
        width = block.shape[1]
        return b"".join(pack_bits(data[i : i + width]) for i in range(0, len(data), width))
    return data


def write_tiff(pages: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 1, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, big_endian: bool = False) -> bytes:
    """pages: 2-dimensional uint8 arrays. tile: (height, width), else strips."""
    order = ">" if big_endian else "<"
    out = bytearray((b"MM" if big_endian else b"II") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width = page.shape
        if tile:
            th, tw = tile
            grown = np.zeros((-(-height // th) * th, -(-width // tw) * tw), np.uint8)
            grown[:height, :width] = page
            blocks = [grown[y : y + th, x : x + tw] for y in range(0, grown.shape[0], th) for x in range(0, grown.shape[1], tw)]
        else:
            blocks = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, sizes = [], []
        for block in blocks:
            data = _packed(np.ascontiguousarray(block), compression, predictor)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1])]
        tags += [(TILE_WIDTH, 4, [tile[1]]), (TILE_LENGTH, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_BYTES, 4, sizes)]
        if predictor != 1:
            tags.append((PREDICTOR, 3, [predictor]))
        entries = []
        for tag, kind, values in sorted(tags):
            data = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(data) > 4:
                place = len(out) + len(out) % 2
                out += bytes(place - len(out)) + data
                data = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + data.ljust(4, b"\0"))
        out += bytes(len(out) % 2)
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += bytes(4)
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags: dict[int, list] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        size = TYPE_SIZE.get(kind, 0) * count
        if not size:
            continue
        place = at + 10 + 12 * k
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size > len(data):
            raise TiffError("a tag's values lie beyond the end")
        code = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}.get(kind)
        if code:
            tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        out = data
    elif compression == PACKBITS:
        out = unpack_bits(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (ADOBE_DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from None
    else:
        raise TiffError(f"compression {compression} is not read")
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out[:size]


def read_pages(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(width, height, samples per pixel, sample bytes) of each page, rows from the top."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(order + "HI", data, 2)
    if magic != 42:
        raise TiffError("no classic TIFF")
    seen = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a ring")
        seen.add(at)
        try:
            tags, nxt = _directory(data, at, order)
        except struct.error:
            raise TiffError("a directory breaks off") from None
        one = lambda tag, default: (tags.get(tag) or [default])[0]  # noqa: E731, B023
        width, height, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
        if width < 1 or height < 1 or width * height * samples > MAX_SAMPLES:
            raise TiffError("the page's size is missing or too large")
        if any(b != 8 for b in tags.get(BITS, [1])):
            raise TiffError("only 8-bit samples are read")
        compression, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
        if predictor not in (1, 2):
            raise TiffError(f"predictor {predictor} is not read")
        if one(284, 1) != 1 and samples > 1:
            raise TiffError("only interleaved samples are read")
        tiled = TILE_OFFSETS in tags
        bw, bh = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        offsets, sizes = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, []), tags.get(TILE_BYTES if tiled else STRIP_BYTES, [])
        if bw < 1 or bh < 1:
            raise TiffError("the strip or tile size is missing")
        across = -(-width // bw)
        if len(offsets) < across * -(-height // bh) or len(sizes) < len(offsets):
            raise TiffError("strips or tiles are missing")
        page = np.zeros((height, width * samples), np.uint8)
        k = 0
        for y in range(0, height, bh):
            for x in range(0, width, bw):
                rows = bh if tiled else min(bh, height - y)
                if offsets[k] + sizes[k] > len(data):
                    raise TiffError("a strip or tile lies beyond the end")
                block = np.frombuffer(_unpacked(data[offsets[k] : offsets[k] + sizes[k]], compression, rows * bw * samples), np.uint8).reshape(rows, bw, samples)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=np.uint8)
                block = block.reshape(rows, bw * samples)[: height - y, : (width - x) * samples]
                page[y : y + block.shape[0], x * samples : x * samples + block.shape[1]] = block
                k += 1
        yield width, height, samples, page.tobytes()
        at = nxt


PAGE_SCHEMA = "page int, width int, height int, samples int, pixels binary, error string"
_PAGE = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())]


def pages(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row per page of every TIFF in `column`: `key`, page (from 0), width, height, samples, pixels, error."""
    frame = df.select(F.col(key).alias("key"), F.col(column).alias("data"))
    kind = frame.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("key", batch.schema.field(0).type), *_PAGE])
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                if data is None:
                    continue
                rows, name, error = [], batch.column(0)[i].as_py(), None
                try:
                    for k, (w, h, s, px) in enumerate(read_pages(data)):
                        rows.append({"key": name, "page": k, "width": w, "height": h, "samples": s, "pixels": px})
                except TiffError as e:
                    error = str(e)
                if error:
                    rows.append({"key": name, "error": error})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return frame.mapInArrow(run, f"key {kind}, {PAGE_SCHEMA}").withColumnRenamed("key", key)


@dataclass(frozen=True)
class Layout:
    """How a text is stored: compression, predictor, tile (height, width) or strips, byte order, pages at most."""

    compression: int
    predictor: int = 1
    tile: tuple[int, int] | None = None
    rows_per_strip: int = 1024
    big_endian: bool = False
    pages: int = 1


#: The layouts that texts are dealt to.
LAYOUTS = (
    Layout(ADOBE_DEFLATE),
    Layout(ADOBE_DEFLATE, 2, None, 64, True, 3),
    Layout(OLD_DEFLATE, 2, (32, 64)),
    Layout(LZW, 1, (64, 64), big_endian=True),
    Layout(LZW, 2, None, 256, False, 2),
    Layout(PACKBITS, 1, None, 128, False, 2),
    Layout(PACKBITS, 1, (16, 32), big_endian=True),
    Layout(PLAIN, 1, (16, 16), pages=4),
)


def layout_of(data: bytes, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    return layouts[zlib.crc32(data) % len(layouts)]


def store_text(data: bytes, layout: Layout, row: int = 64) -> tuple[bytes, bytes]:
    """The payload (padded with zero bytes to a positive multiple of `row`) and the TIFF that holds it, its rows dealt evenly to pages."""
    payload = data + bytes((-len(data)) % row if data else row)
    lines = np.frombuffer(payload, np.uint8).reshape(-1, row)
    pages = np.array_split(lines, min(layout.pages, len(lines)))
    return payload, write_tiff(pages, layout.compression, layout.predictor, layout.rows_per_strip, layout.tile, layout.big_endian)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def feature_of(read: list[tuple[int, int, int, bytes]]) -> str:
    """Sizes of the decoded pages, mean, and the share of each quarter of the sample range."""
    counts = sum(np.bincount(np.frombuffer(pixels, np.uint8), minlength=256) for _, _, _, pixels in read)
    n = max(1, int(counts.sum()))
    quarters = counts.reshape(4, 64).sum(axis=1)
    mean = int((counts * np.arange(256)).sum()) / n
    return "+".join(f"{w}x{h}" for w, h, _, _ in read) + f" mean={mean:.3f} quarters=" + ",".join(f"{q / n:.4f}" for q in quarters)


def text_digests(docs: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Every text stored as TIFF pages of 64 samples a row, read back, and digested.

    Null texts count as empty; each input row has one output row, repeated ones too; a null doc_id stays
    null; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = binary_views(batch.column(1))
            rows = []
            for i, name in enumerate(batch.column(0).to_pylist()):
                data = raw[offsets[i] : offsets[i + 1]].tobytes()
                _, stored = store_text(data, layout_of(data, layouts))
                read = list(read_pages(stored))
                back = b"".join(pixels for _, _, _, pixels in read)
                rows.append((name, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), feature_of(read)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _DIGEST.types, strict=True)], schema=_DIGEST)

    return text_frame(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(run, DIGEST)
