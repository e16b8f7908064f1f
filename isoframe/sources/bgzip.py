"""Lines of block-gzip files as a Spark data source: spark.dataSource.register(BlockGzipLines), format "bgzip-lines".

A block-gzip file is a chain of gzip members of at most 64 kB, so it can be read from any member on. A file is dealt out in
byte ranges; a range has the lines that begin in its members: it skips the line that an earlier member began and finishes
its last one from the members that follow. Rows are (file, at, value): `at` is the offset of the member that the line begins
in times 2^16 plus its place there, so (file, at) is the order of the file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from isoframe.sources.bam import blocks, find_block

RANGE_BYTES = 32 << 20
SCHEMA = "file string, at long, value string"
_ROWS = 20_000


def lines_of(f, first: int, stop: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in members of [first, stop), without their ends."""
    start = 0 if first == 0 else find_block(f, first, size)
    if start is None or start >= stop:
        return
    # A line begins at a member's first byte if the byte before it ends one; the member before tells.
    skip = first > 0 and not _ends_a_line(f, start)
    line: list[bytes] | None = None
    place = 0
    for at, data in blocks(f, start):
        if at >= stop and line is None:
            return
        p = 0
        while p < len(data):
            if not skip and line is None:
                if at >= stop:
                    return
                line, place = [], at << 16 | p
            end = data.find(b"\n", p)
            if line is not None:
                line.append(data[p:end] if end >= 0 else data[p:])
            if end < 0:
                break
            if line is not None:
                yield place, b"".join(line).removesuffix(b"\r")
            skip, line, p = False, None, end + 1
    if line is not None:
        yield place, b"".join(line).removesuffix(b"\r")


def _ends_a_line(f, start: int) -> bool:
    """Whether the last byte before the member at `start` is a line's end, by the nearest member before it that is not empty."""
    low = start
    while low > 0:
        low = max(0, low - (1 << 17))
        at = 0 if low == 0 else find_block(f, low, start)
        last = None
        if at is not None:
            for _, data in blocks(f, at, start):
                last = data[-1:] or last
        if last is not None:
            return last == b"\n"
    return True


class Range(InputPartition):
    def __init__(self, path: str, first: int, stop: int, size: int):
        self.path, self.first, self.stop, self.size = path, first, stop, size


class LineReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", options.get("paths", "")).split(",") if p]
        self.bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self):
        return [Range(p, a, min(a + self.bytes, n), n) for p in self.paths for n in [os.path.getsize(p)] for a in range(0, n, self.bytes)] or [Range("", 0, 0, 0)]

    def read(self, part):
        if not part.path:
            return
        with open(part.path, "rb") as f:
            held: list[tuple[int, bytes]] = []
            for row in lines_of(f, part.first, part.stop, part.size):
                held.append(row)
                if len(held) == _ROWS:
                    yield self._batch(part.path, held)
                    held = []
            yield self._batch(part.path, held)

    @staticmethod
    def _batch(path: str, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), pa.array([p for p, _ in rows], pa.int64()), pa.array([v.decode() for _, v in rows], pa.string())], names=["file", "at", "value"])


class BlockGzipLines(DataSource):
    """Options: path (several by commas), rangeBytes. Files must be on storage that every node mounts."""

    @classmethod
    def name(cls):
        return "bgzip-lines"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return LineReader(self.options)


def is_block_gzip(path: str) -> bool:
    """Whether a path is one file on mounted storage whose first gzip member states its size."""
    if not os.path.isfile(path):
        return False
    with open(path, "rb") as f:
        head = f.read(18)
    return head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"BC"


def read_lines(spark: SparkSession, paths: list[str] | str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, at, value) of block-gzip files."""
    spark.dataSource.register(BlockGzipLines)
    return spark.read.format("bgzip-lines").option("paths", paths if isinstance(paths, str) else ",".join(paths)).option("rangeBytes", range_bytes).load()


def compress(data: bytes, block: int = 60_000, end: bool = True) -> bytes:
    """Bytes as block-gzip, with the empty member that ends such a file, if it is the end."""
    out = bytearray()
    for i in [*range(0, len(data), block), *[None] * end]:
        part = data[i : i + block] if i is not None else b""
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = z.compress(part) + z.flush()
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(part), len(part))
    return bytes(out)
