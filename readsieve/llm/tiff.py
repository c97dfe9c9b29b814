"""TIFF media columns: read image directories and emit one row per page; write text payloads as TIFF.

The reader takes classic TIFF of either byte order: strips or tiles, stored plainly or with
PackBits, LZW or deflate; 1-, 8-, 16- and 32-bit samples, chunky or planar; horizontal
differencing and floating-point predictors.  Pixels come out row by row, samples interleaved
(planar images are interleaved), multi-byte samples little-endian, 1-bit rows padded to a byte.

Edge cases: null or empty media gives no pages; media that cannot be read gives one row with
page -1 and the reason in ``error``; pages before the fault are kept; a directory that points back
to an earlier one ends the walk; repeated rows are read each on its own; an empty table gives an
empty result; other columns are kept by ``read_pages``, but for those named like its own, and
ignored by ``text_media``.

Faulty are also images and tiles without width or height, and sizes that the stored bytes can't
fill however well they are packed (``EXPANSION``) or that exceed ``MOST_PAGE_BYTES``, which a row
could not hold.  Both are known before any memory is taken, and no strip is unpacked beyond its size.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Workspace
from .common import LONG_ROWS, id_and_text, map_arrow, text_bytes

# Fixed values of the TIFF 6.0 specification and its technical notes: tags, types, compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
TYPES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}
PLAIN, LZW, DEFLATE, PACKBITS, DEFLATE_OLD = 1, 5, 8, 32773, 32946

#: Bytes that one stored byte can stand for at most: 128 in two; a code of 12 bits names 3,839 at most; zlib's own bound.
EXPANSION = {PLAIN: 1, PACKBITS: 64, LZW: 2560, DEFLATE: 1032, DEFLATE_OLD: 1032}
#: Pixels of a page, in bytes; a value of a Spark row must stay below 2 GiB.
MOST_PAGE_BYTES = 1 << 30
#: Bytes of pixels that are handed on together.
TOGETHER = 64_000_000

#: Payloads are stored in rows of this many samples.
ROW = 64
ROWS_IN_STRIP = 256


class Page(NamedTuple):
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes


def unpack_bits(data: bytes, size: float = math.inf) -> bytes:
    """PackBits: a count byte, then literals or one byte to repeat. Stops when it has ``size`` bytes."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Repeats of three or more are packed; all else is literal."""
    out, at, literal = bytearray(), 0, 0

    def flush(end: int) -> None:
        for i in range(literal, end, 128):
            part = data[i : min(end, i + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    while at < len(data):
        n = 1
        while n < 128 and at + n < len(data) and data[at + n] == data[at]:
            n += 1
        if n >= 3:
            flush(at)
            out += bytes([257 - n, data[at]])
            literal = at + n
        at += n
    flush(len(data))
    return bytes(out)


def unpack_lzw(data: bytes, size: float = math.inf) -> bytes:
    """LZW with codes of 9 to 12 bits, high bits first; 256 clears the table, 257 ends. Stops when it has ``size`` bytes."""
    out, table, last = bytearray(), [], b""
    width, held, have = 9, 0, 0
    for byte in data:
        if len(out) >= size:
            break
        held, have = held << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code, held = held >> have, held & ((1 << have) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, width = [bytes([i]) for i in range(256)] + [b"", b""], b"", 9
            continue
        if not table:
            raise ValueError("LZW data begins without a clear code")
        if code < len(table):
            found = table[code]
        elif last and code == len(table):
            found = last + last[:1]
        else:
            raise ValueError(f"LZW code {code} is not in the table")
        out += found
        if last and len(table) < 4096:
            table.append(last + found[:1])
        last = found
        # the writer widens its codes one entry early
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """The writer for ``unpack_lzw``."""
    held, have, out = 0, 0, bytearray()
    table: dict[bytes, int] = {}
    width = 9

    def emit(code: int) -> None:
        nonlocal held, have
        held, have = held << width | code, have + width
        while have >= 8:
            have -= 8
            out.append(held >> have & 255)
        held &= (1 << have) - 1

    emit(256)
    table, entries = {bytes([i]): i for i in range(256)}, 258
    last = b""
    for i in range(len(data)):
        longer = last + data[i : i + 1]
        if longer in table:
            last = longer
            continue
        emit(table[last])
        table[longer] = entries
        entries += 1
        # the reader is one entry behind
        width = 12 if entries > 2047 else 11 if entries > 1023 else 10 if entries > 511 else 9
        if entries >= 4094:
            emit(256)
            table, entries, width = {bytes([i]): i for i in range(256)}, 258, 9
        last = data[i : i + 1]
    if last:
        emit(table[last])
        entries += 1
        width = 12 if entries > 2047 else 11 if entries > 1023 else 10 if entries > 511 else 9
    emit(257)
    if have:
        out.append(held << (8 - have) & 255)
    return bytes(out)


def _inflated(data: bytes, size: int) -> bytes:
    stream = zlib.decompressobj()
    out = stream.decompress(data, size)
    if not stream.eof:
        stream.decompress(stream.unconsumed_tail, 1)  # reads the checksum, if that is all that is left
    return out


def _unpacked(data: bytes, compression: int, size: int) -> bytes:
    """The first ``size`` bytes of a strip or tile."""
    if compression == PLAIN:
        out = data[:size]
    elif compression in (DEFLATE, DEFLATE_OLD):
        out = _inflated(data, size)
    else:
        out = (unpack_bits if compression == PACKBITS else unpack_lzw)(data, size)
    if len(out) < size:
        raise ValueError(f"a strip or tile has {len(out)} bytes instead of {size}")
    return out[:size]


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """The integer tags of the directory at an offset, and where the next one is."""
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind in TYPES:
            form = f"{order}{count}{TYPES[kind]}"
            where = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (where,) = struct.unpack_from(order + "I", data, where)
            tags[tag] = list(struct.unpack_from(form, data, where))
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _unpredicted(rows: np.ndarray, predictor: int, width: int, samples: int, size: int, order: str) -> np.ndarray:
    """rows: bytes by row of one strip or tile. Gives little-endian samples, as bytes by row."""
    if predictor == 3:
        planes = np.cumsum(rows.reshape(len(rows), width * size, samples), axis=1, dtype=np.uint8) if samples > 1 else np.cumsum(rows, axis=1, dtype=np.uint8)
        planes = planes.reshape(len(rows), size, width * samples)  # high bytes first
        return np.ascontiguousarray(planes[:, ::-1].transpose(0, 2, 1)).reshape(len(rows), -1)
    kind = np.dtype(f"{order}u{size}")
    values = rows.view(kind).reshape(len(rows), width, samples)
    if predictor == 2:
        values = np.cumsum(values, axis=1, dtype=kind.newbyteorder("="))
    return np.ascontiguousarray(values.astype(kind.newbyteorder("<"))).view(np.uint8).reshape(len(rows), -1)


def _page(data: bytes, tags: dict[int, list[int]], order: str) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height = one(WIDTH), one(HEIGHT)
    samples, bits = one(SAMPLES, 1), one(BITS, 1)
    if not width or not height or samples < 1:
        raise ValueError("the image has no size")
    if bits not in (1, 8, 16, 32) or any(b != bits for b in tags.get(BITS, [])):
        raise ValueError(f"samples of {tags.get(BITS)} bits are not supported")
    compression, predictor, planar = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), one(PLANAR, 1) == 2 and samples > 1
    if predictor not in (1, 2, 3) or predictor == 2 and bits == 1 or predictor == 3 and bits < 16:
        raise ValueError(f"predictor {predictor} of {bits}-bit samples is not supported")
    if compression not in EXPANSION:
        raise ValueError(f"compression {compression} is not supported")
    tiled = TILE_OFFSETS in tags
    tall = one(TILE_HEIGHT) if tiled else min(one(ROWS_PER_STRIP, height), height)
    wide = one(TILE_WIDTH) if tiled else width
    if not tall or not wide:
        raise ValueError("strips or tiles have no size")
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_COUNTS])
    across, down = -(-width // wide), -(-height // tall)
    own = 1 if planar else samples  # samples in a strip or tile
    size = max(1, bits // 8)
    row_bytes = lambda w: -(-w * own // 8) if bits == 1 else w * own * size
    if planar and bits == 1:
        raise ValueError("planar 1-bit images are not supported")
    n_planes = samples if planar else 1
    if n_planes * height * row_bytes(width) > MOST_PAGE_BYTES:
        raise ValueError(f"{width} x {height} pixels are more than a row can hold")
    if min(len(offsets), len(counts)) < n_planes * across * down:
        raise ValueError("strips or tiles are missing")
    for i in range(n_planes * across * down):
        n = tall if tiled else min(tall, height - i % (across * down) * tall)
        if offsets[i] + counts[i] > len(data):
            raise ValueError("a strip or tile lies outside the file")
        if n * row_bytes(wide) > counts[i] * EXPANSION[compression]:
            raise ValueError(f"{counts[i]} bytes can't hold {n * row_bytes(wide)}")
    planes = []
    for plane in range(n_planes):
        out = np.zeros((height, row_bytes(width)), dtype=np.uint8)
        for k in range(across * down):
            i = plane * across * down + k
            y, x = k // across * tall, k % across * wide
            n = tall if tiled else min(tall, height - y)
            part = _unpacked(data[offsets[i] : offsets[i] + counts[i]], compression, n * row_bytes(wide))
            rows = np.frombuffer(part, np.uint8).reshape(n, row_bytes(wide))
            if bits > 1:
                rows = _unpredicted(rows, predictor, wide, own, size, order)
            n, w = min(n, height - y), row_bytes(min(wide, width - x))
            left = row_bytes(x)
            out[y : y + n, left : left + w] = rows[:n, :w]
        planes.append(out)
    if planar:
        out = np.stack([p.reshape(height, width, size) for p in planes], axis=2)
    return Page(width, height, samples, bits, compression, predictor, out.tobytes())


def read(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    if data[:4] == b"II*\0":
        order = "<"
    elif data[:4] == b"MM\0*":
        order = ">"
    else:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(data, at, order)
        yield _page(data, tags, order)


def write(payloads: list[bytes], compression: int = DEFLATE, predictor: int = 2) -> bytes:
    """A file with one page of 8-bit samples per payload; lengths are positive multiples of ROW."""
    pack = {PLAIN: bytes, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: pack_bits, LZW: pack_lzw}[compression]
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for k, payload in enumerate(payloads):
        rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
        if predictor == 2:
            rows = np.concatenate([rows[:, :1], np.diff(rows, axis=1)], axis=1)
        strips = [pack(rows[i : i + ROWS_IN_STRIP].tobytes()) for i in range(0, len(rows), ROWS_IN_STRIP)]
        n, at = len(strips), len(out)
        table = at + 2 + 10 * 12 + 4  # after the directory: offsets and counts, if they don't fit in their tags
        first = table + (8 * n if n > 1 else 0)
        offsets = [first + sum(map(len, strips[:i])) for i in range(n)] if n < 64 else (np.cumsum([0, *map(len, strips[:-1])]) + first).tolist()
        counts = list(map(len, strips))
        end = offsets[-1] + counts[-1]
        end += end % 2
        tags = [(WIDTH, ROW, 1), (HEIGHT, len(rows), 1), (BITS, 8, 1), (COMPRESSION, compression, 1), (PHOTOMETRIC, 1, 1)]
        tags += [(STRIP_OFFSETS, table if n > 1 else offsets[0], n), (SAMPLES, 1, 1), (ROWS_PER_STRIP, ROWS_IN_STRIP, 1)]
        tags += [(STRIP_COUNTS, table + 4 * n if n > 1 else counts[0], n), (PREDICTOR, predictor, 1)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", tag, 4, count, value) for tag, value, count in tags)
        out += struct.pack("<I", end if k + 1 < len(payloads) else 0)
        if n > 1:
            out += struct.pack(f"<{n}I", *offsets) + struct.pack(f"<{n}I", *counts)
        out += b"".join(strips)
        out += b"\0" * (end - len(out))
    return bytes(out)


def payload(text: bytes | None) -> bytes:
    """The text with zero bytes up to a positive multiple of ROW."""
    data = text or b""
    return data + bytes(-len(data) % ROW or (0 if data else ROW))


def features(page: Page) -> str:
    """Size, mean and spread of an 8-bit page, and its histogram in 16 bins as shares of 255."""
    values = np.frombuffer(page.pixels, np.uint8)
    bins = np.bincount(values >> 4, minlength=16)
    shares = (bins * 255 + len(values) // 2) // max(1, len(values))
    return f"{page.width}x{page.height};{values.mean():.4f};{values.std():.4f};{bytes(shares.astype(np.uint8)).hex()}"


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text stored as a TIFF of one page."""

    def encode(batches):
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            media = [write([payload(x)]) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array(media, pa.large_binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(id_and_text(docs), encode, "doc_id long, n_bytes long, media binary")


_INT, _LONG, _STRING = T.IntegerType(), T.LongType(), T.StringType()
_TYPES = {"page": _INT, "width": _LONG, "height": _LONG, "samples": _INT, "bits": _INT, "compression": _INT, "predictor": _INT, "pixels": T.BinaryType(), "feature": _STRING, "error": _STRING}
PAGE = T.StructType([T.StructField(name, kind) for name, kind in _TYPES.items()])


def read_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """The table with its media column read: one row per page (see the module for faulty media).

    Columns named like those of PAGE are replaced.
    """
    media = media.drop(*(name for name in PAGE.names if name != column))
    kept = media.schema.fieldNames()

    def rows(data):
        if data:
            k = 0
            try:
                for k, page in enumerate(read(data), 1):
                    yield (k - 1, *page, features(page) if page.bits == 8 else None, None)
            except (ValueError, LookupError, ArithmeticError, TypeError, MemoryError, struct.error, zlib.error) as e:
                yield (-1, *[None] * 8, f"page {k}: {type(e).__name__}: {e}")

    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.large_binary(), pa.string(), pa.string()]
    names = PAGE.names

    def gathered(batch, found):
        source = batch.take(pa.array([i for i, _ in found], pa.int64()))
        columns = list(zip(*[row for _, row in found])) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([*source.columns, *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names=[*kept, *names])

    def decode(batches):
        for batch in batches:
            found, held = [], 0
            for i, data in enumerate(batch.column(column).to_pylist()):
                for row in rows(data):
                    found.append((i, row))
                    held += len(data) + len(row[names.index("pixels")] or b"")
                    if held > TOGETHER:
                        yield gathered(batch, found)
                        found, held = [], 0
            yield gathered(batch, found)

    return map_arrow(media, decode, T.StructType([*media.schema.fields, *PAGE.fields]))


def text_media(docs: DataFrame, work: Workspace | None = None) -> DataFrame:
    """One row per document: its payload's digests, read back from the stored TIFF."""
    work = work or Workspace(docs.sparkSession, "tiff", LONG_ROWS)
    pages = read_pages(encode_texts(docs))
    digests = pages.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -ROW, ROW)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "page",
        "error",
    )
    return work.save(digests)
