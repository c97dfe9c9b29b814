"""Block gzip: gzip files of many small members, each of which tells its size, read by many tasks.

A member holds 64 KiB of text at most.  A file is cut into ranges of bytes; a range's task looks for the first
member that begins in it, checks it (its size leads to another member or to the file's end, and its checksum is right), and
goes on from member to member.  A line belongs to the range in which it begins, but one that begins with a range is read by
the task before, as that one can't know whether its own last line has ended; lines may cross any number of
members and ranges.

Files are opened by Arrow's file systems, in the tasks: what these don't know, or can't reach, is read as any other gzip file.
"""

from __future__ import annotations

import json
import logging
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

log = logging.getLogger(__name__)
FORMAT = "readsieve_block_gzip"
# How a member begins (but for bytes 4 to 9: time, flags and system), and the member that ends a file.
BEGINS, EXTRA, HEADER = b"\x1f\x8b\x08\x04", b"\x06\x00BC\x02\x00", 18
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Text of a member, and the most bytes that it may have packed.
MEMBER_TEXT, MEMBER_BYTES = 65_280, 65_536
#: Lines that leave a task together.
BATCH_LINES = 10_000
#: A row's place has its number within its range in so many bits: deflate packs 1,032 to 1 at best, and a row has 14 bytes.
ROW_BITS = 32
_BLANK = bytes(range(33))


def is_member(head: bytes) -> bool:
    return len(head) >= HEADER and head.startswith(BEGINS) and head[10:16] == EXTRA


def _size(head: bytes) -> int:
    return struct.unpack_from("<H", head, 16)[0] + 1


def member(text: bytes) -> bytes:
    """A member with this text, of ``MEMBER_TEXT`` bytes at most."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = packer.compress(text) + packer.flush()
    if len(data) + HEADER + 8 > MEMBER_BYTES:
        packer = zlib.compressobj(0, zlib.DEFLATED, -15)
        data = packer.compress(text) + packer.flush()
    head = BEGINS + b"\0\0\0\0\0\xff" + EXTRA + struct.pack("<H", len(data) + HEADER + 8 - 1)
    return head + data + struct.pack("<II", zlib.crc32(text), len(text))


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """A whole file of block gzip."""
    waiting = bytearray()
    for chunk in chunks:
        waiting += chunk
        while len(waiting) >= MEMBER_TEXT:
            yield member(bytes(waiting[:MEMBER_TEXT]))
            del waiting[:MEMBER_TEXT]
    if waiting:
        yield member(bytes(waiting))
    yield END


def _unpack(packed: bytes) -> bytes | None:
    """The text of a whole member, or null if its checksum is wrong."""
    unpacker = zlib.decompressobj(31)
    try:
        text = unpacker.decompress(packed)
    except zlib.error:
        return None
    return text if unpacker.eof and not unpacker.unused_data else None


def first_member(file, start: int, size: int) -> int:
    """Where the first member at or after ``start`` begins; the file's size if there is none."""
    if start == 0:
        return 0
    file.seek(start)
    near = file.read(MEMBER_BYTES + HEADER)  # some member begins within this, if any does
    at = near.find(BEGINS)
    while at >= 0:
        head = near[at : at + HEADER]
        if is_member(head):
            end = start + at + _size(head)
            file.seek(start + at)
            packed = file.read(_size(head) + HEADER)
            follows = end == size or is_member(packed[_size(head) :])
            if follows and _unpack(packed[: _size(head)]) is not None:
                return start + at
        at = near.find(BEGINS, at + 1)
    return size


def _texts(file, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """From a member on: where each begins, and its text."""
    while at < size:
        file.seek(at)
        packed = file.read(MEMBER_BYTES)
        if not is_member(packed):
            raise ValueError(f"no block of block gzip at {at}")
        text = _unpack(packed[: _size(packed)])
        if text is None:
            raise ValueError(f"broken block of block gzip at {at}")
        yield at, text
        at += _size(packed)


def lines_of_range(file, start: int, end: int, size: int) -> Iterator[bytes]:
    """The lines that belong to a range, in order and without their ends."""
    skipping = start > 0  # the line at hand belongs to an earlier range
    rest = bytearray()
    for at, text in _texts(file, first_member(file, start, size), size):
        last = at >= end  # beyond the range: only what completes its last line
        if skipping:
            if last:
                return
            cut = text.find(b"\n")
            if cut < 0:
                continue
            text, skipping = text[cut + 1 :], False
        cut = (text.find(b"\n") if last else text.rfind(b"\n")) + 1
        if not cut:
            rest += text
            continue
        rest += text[:cut]
        yield from bytes(rest).splitlines()
        if last:
            return
        rest = bytearray(text[cut:])
    yield from bytes(rest).splitlines()


class _Range(InputPartition):
    def __init__(self, number: int, path: str, start: int, end: int, size: int):
        self.number, self.path, self.start, self.end, self.size = number, path, start, end, size


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.files, self.step = json.loads(options["files"]), int(options["step"])

    def partitions(self):
        starts = ((path, size, at) for path, size in self.files for at in range(0, size, self.step))
        return [_Range(i, path, at, at + self.step, size) for i, (path, size, at) in enumerate(starts)]

    def read(self, partition):
        system, path = fs.FileSystem.from_uri(partition.path)
        number, values = partition.number << ROW_BITS, []
        with system.open_input_file(path) as file:
            for line in lines_of_range(file, partition.start, partition.end, partition.size):
                if line.strip(_BLANK):  # as Spark's reader
                    values.append(line.decode("utf-8", "replace"))
                if len(values) == BATCH_LINES:
                    yield _batch(number, values)
                    number, values = number + len(values), []
        if values:
            yield _batch(number, values)


def _batch(number: int, values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(number, number + len(values)), pa.int64()), pa.array(values, pa.string())], ["place", "value"])


class BlockGzip(DataSource):
    """Lines of files of block gzip (option ``files``: JSON of [uri, size], in order; ``step``: bytes of a range)."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return "place long not null, value string"

    def reader(self, schema):
        return _Reader(self.options)


def _head(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as file:
        return file.read(HEADER)


def read_lines(spark: SparkSession, files: list[tuple[str, int]], step: int) -> DataFrame | None:
    """place (in the order of files, then of lines) and value; null if not all files are block gzip that Arrow can open."""
    try:
        if not all(is_member(_head(uri)) for uri, _ in files):
            return None
    except (OSError, pa.ArrowException) as e:
        log.warning("not read by ranges: %s", e)
        return None
    spark.dataSource.register(BlockGzip)
    return spark.read.format(FORMAT).option("files", json.dumps(files)).option("step", str(step)).load()
