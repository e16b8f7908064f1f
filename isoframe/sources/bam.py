"""BAM files as a Spark data source: spark.dataSource.register(BamSource); spark.read.format("bam").load(path).

Rows are (sample, qname, flag, chrom, pos, cigar), what read processing needs; bases and qualities are skipped unread. A
file is dealt out in byte ranges. A range begins at the first compressed block in it; whether a record begins there is
found by walking candidates, so ranges are read by tasks of their own and no record is read twice.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sample string, qname string, flag int, chrom string, pos long, cigar string"
OPERATIONS = "MIDNSHP=X"
RANGE_BYTES = 32 << 20
_MAGIC = b"\x1f\x8b\x08\x04"
_ROWS = 20_000
#: Bytes of one record at most; longer sizes are no records'.
LONGEST_RECORD = 1 << 28
#: Bytes that hold the fixed fields of a record, its name and its first operations.
FIXED_BYTES = 36 + 255 + 64
_TAG_BYTES = {b"A": 1, b"c": 1, b"C": 1, b"s": 2, b"S": 2, b"i": 4, b"I": 4, b"f": 4}


def blocks(f, start: int, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, contents) of the BGZF blocks that begin in [start, stop)."""
    at = start
    while stop is None or at < stop:
        f.seek(at)
        head = f.read(18)
        if len(head) < 18 or head[:4] != _MAGIC:
            return
        size = _block_size(f, at, head)
        f.seek(at)
        raw = f.read(size)
        extra = struct.unpack_from("<H", raw, 10)[0]
        yield at, zlib.decompress(raw[12 + extra : -8], -15)
        at += size


def _block_size(f, at: int, head: bytes) -> int:
    extra = struct.unpack_from("<H", head, 10)[0]
    f.seek(at + 12)
    fields, i = f.read(extra), 0
    while i + 4 <= len(fields):
        n = struct.unpack_from("<H", fields, i + 2)[0]
        if fields[i : i + 2] == b"BC":
            return struct.unpack_from("<H", fields, i + 4)[0] + 1
        i += 4 + n
    raise ValueError("a gzip member without a block size: not BGZF")


def find_block(f, start: int, size: int) -> int | None:
    """The first block that begins at or after an offset, confirmed by the block after it."""
    f.seek(start)
    window = f.read(min(2 << 16, size - start))
    i = window.find(_MAGIC)
    while i >= 0:
        try:
            head = window[i : i + 18]
            after = start + i + _block_size(f, start + i, head)
            f.seek(after)
            if after == size or f.read(4) == _MAGIC:
                return start + i
        except (ValueError, struct.error, IndexError):
            pass
        i = window.find(_MAGIC, i + 1)
    return None


class Stream:
    """Bytes of consecutive blocks, with the block that each record begins in."""

    def __init__(self, f, start: int):
        self.source, self.data, self.at, self.base = blocks(f, start), b"", 0, []

    def fill(self, n: int) -> bool:
        while len(self.data) - self.at < n:
            block = next(self.source, None)
            if block is None:
                return False
            keep = self.at
            self.data = self.data[keep:] + block[1]
            self.base = [(p - keep, o) for p, o in self.base if p - keep > -(1 << 17)] + [(len(self.data) - len(block[1]), block[0])]
            self.at = 0
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise EOFError
        out = self.data[self.at : self.at + n]
        self.at += n
        return out

    def to_record(self, contigs: int, stop: int) -> bool:
        """Go to the first record that begins in a block before stop; False if none does, as inside a very long record."""
        look, seen = 1 << 18, 0
        while True:
            more = self.fill(look)
            at = first_record(self.data, contigs, seen)
            if at is not None:
                self.at = at
                return self.block() < stop
            beyond = [p for p, o in self.base if o >= stop]
            if not more or beyond and len(self.data) - beyond[0] >= FIXED_BYTES:
                return False
            seen, look = max(0, len(self.data) - FIXED_BYTES), 2 * look

    def block(self) -> int:
        """File offset of the block that the next byte is in."""
        return next(o for p, o in reversed(self.base) if p <= self.at)


def read_header(f) -> tuple[list[str], list[int], Stream]:
    s = Stream(f, 0)
    if s.take(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    s.take(struct.unpack("<i", s.take(4))[0])
    names, lengths = [], []
    for _ in range(struct.unpack("<i", s.take(4))[0]):
        names.append(s.take(struct.unpack("<i", s.take(4))[0])[:-1].decode())
        lengths.append(struct.unpack("<i", s.take(4))[0])
    return names, lengths, s


def plausible(data: bytes, at: int, contigs: int) -> bool:
    """Whether a record can begin here, by its fixed fields, its name and its first operations."""
    if len(data) - at < 36:
        return False
    size, ref, pos, l_name, _, _, n_cigar, _, l_seq, mate, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)[:11]
    if not (32 <= size < LONGEST_RECORD and -1 <= ref < contigs and pos >= -1 and -1 <= mate < contigs and mate_pos >= -1 and l_name > 1 and l_seq >= 0 and 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size):
        return False
    name = data[at + 36 : at + 36 + l_name]
    ops = struct.unpack_from(f"<{max(0, min(n_cigar, 16, (len(data) - at - 36 - l_name) // 4))}I", data, min(at + 36 + l_name, len(data)))
    return len(name) == l_name and name[-1] == 0 and all(0x21 <= c <= 0x7E for c in name[:-1]) and all(o & 15 < len(OPERATIONS) for o in ops)


def first_record(data: bytes, contigs: int, start: int = 0) -> int | None:
    """The first offset from which a chain of plausible records runs through the data."""
    for at in range(start, len(data) - 36):
        p = at
        while plausible(data, p, contigs):
            p += 4 + struct.unpack_from("<i", data, p)[0]
            if p > len(data) - FIXED_BYTES:
                return at
    return None


def long_cigar(body: bytes, at: int) -> tuple[int, ...] | None:
    """The operations of a CG tag among the tags from an offset on: where they are too many for the record's own field."""
    while at + 3 <= len(body):
        tag, kind = body[at : at + 2], body[at + 2 : at + 3]
        at += 3
        if kind in b"ZH":
            at = body.index(0, at) + 1
        elif kind == b"B":
            n = struct.unpack_from("<i", body, at + 1)[0]
            if tag == b"CG" and body[at : at + 1] == b"I":
                return struct.unpack_from(f"<{n}I", body, at + 5)
            at += 5 + n * _TAG_BYTES[body[at : at + 1]]
        else:
            at += _TAG_BYTES[kind]
    return None


def records(f, first: int, stop: int, size: int) -> Iterator[tuple]:
    """(qname, flag, contig, pos, cigar) of the records that begin in blocks of [first, stop)."""
    names, _, s = read_header(f)
    if first:
        start = find_block(f, first, size)
        if start is None or start >= stop:
            return
        s = Stream(f, start)
        if not s.to_record(len(names), stop):
            return
    while s.fill(4) and s.block() < stop:
        body = s.take(struct.unpack("<i", s.take(4))[0])
        ref, pos, l_name, _, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", body)
        ops = struct.unpack_from(f"<{n_cigar}I", body, 32 + l_name)
        if n_cigar == 2 and ops[0] == l_seq << 4 | 4 and ops[1] & 15 == 3:  # a placeholder: clipped as a whole, then skipped
            ops = long_cigar(body, 32 + l_name + 8 + (l_seq + 1) // 2 + l_seq) or ops
        cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in ops) or "*"
        yield body[32 : 32 + l_name - 1].decode(), flag, names[ref] if ref >= 0 else None, pos, cigar


class Range(InputPartition):
    def __init__(self, path: str, sample: str, first: int, stop: int, size: int):
        self.path, self.sample, self.first, self.stop, self.size = path, sample, first, stop, size


class BamReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", options.get("paths", "")).split(",") if p]
        self.samples = [s for s in options.get("samples", "").split(",") if s] or [os.path.basename(p).removesuffix(".bam") for p in self.paths]
        self.bytes = int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self):
        out = []
        for path, sample in zip(self.paths, self.samples, strict=True):
            size = os.path.getsize(path)
            out += [Range(path, sample, a, min(a + self.bytes, size), size) for a in range(0, size, self.bytes)]
        return out

    def read(self, part):
        with open(part.path, "rb") as f:
            rows = []
            for r in records(f, part.first, part.stop, part.size):
                rows.append(r)
                if len(rows) == _ROWS:
                    yield self._batch(part.sample, rows)
                    rows = []
            yield self._batch(part.sample, rows)

    @staticmethod
    def _batch(sample: str, rows: list[tuple]) -> pa.RecordBatch:
        q, flag, chrom, pos, cigar = zip(*rows, strict=True) if rows else ((),) * 5
        return pa.RecordBatch.from_arrays([pa.array([sample] * len(rows), pa.string()), pa.array(q, pa.string()), pa.array(flag, pa.int32()), pa.array(chrom, pa.string()), pa.array(pos, pa.int64()), pa.array(cigar, pa.string())], names=["sample", "qname", "flag", "chrom", "pos", "cigar"])


class BamSource(DataSource):
    """Options: path (several by commas), samples (names in order), rangeBytes. Files must be on storage that every node mounts."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BamReader(self.options)


def read_bam(spark: SparkSession, paths: dict[str, str], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Alignments of samples; paths: sample to file."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").option("paths", ",".join(paths.values())).option("samples", ",".join(paths)).option("rangeBytes", range_bytes).load()


def read_contigs(path: str) -> list[tuple[str, int]]:
    """Names and lengths of a file's contigs."""
    with open(path, "rb") as f:
        names, lengths, _ = read_header(f)
    return list(zip(names, lengths, strict=True))


def write_bam(path: str, contigs: list[tuple[str, int]], rows: list[tuple[str, int, str, int, str]], block: int = 60_000) -> None:
    """A small BAM file of (qname, flag, chrom, pos, cigar), without bases: for fixtures and round trips. More operations than
    the record's field can count go to a CG tag."""
    number = {c: i for i, (c, _) in enumerate(contigs)}
    out = bytearray(b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", len(contigs)))
    for c, n in contigs:
        out += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n)
    import re

    for q, flag, chrom, pos, cigar in rows:
        ops = [int(n) << 4 | OPERATIONS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        tags = b""
        if len(ops) > 0xFFFF:
            tags = b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
            ops = [4, sum(o >> 4 for o in ops if o & 15 in (0, 2, 3, 7, 8)) << 4 | 3]
        body = struct.pack("<iiBBHHHiiii", number.get(chrom, -1), pos, len(q) + 1, 0, 0, len(ops), flag, 0, -1, -1, 0) + q.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + tags
        out += struct.pack("<i", len(body)) + body
    with open(path, "wb") as f:
        for i in [*range(0, len(out), block), None]:
            data = bytes(out[i : i + block]) if i is not None else b""
            z = zlib.compressobj(6, zlib.DEFLATED, -15)
            packed = z.compress(data) + z.flush()
            f.write(_MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(packed) + 25) + packed + struct.pack("<II", zlib.crc32(data), len(data)))
