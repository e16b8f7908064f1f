"""FASTA in byte ranges: contigs of any length as chunks of a fixed size, read by many tasks.

Lines are dealt out by Spark's text source in splits that begin anywhere, also inside a contig. A first pass sums up each
split in one row: the bases before its first header, its last header and the bases after it. Carried on from split to split
these give the contig and the base at which each split begins; the second pass then cuts every split's bases at the borders
of chunks, and the two parts of a chunk that a border of splits runs through meet by (contig, chunk).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 14
SPLIT = "file string, split long"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, value): lines in file order within each split, which the offset of its first byte names."""
    lines = spark.read.text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[str]]]:
    """(file, split, lines) of stretches of one split; a split may come in several."""
    for b in batches:
        files, splits, values = (c.to_pylist() for c in b.columns)
        at = 0
        while at < len(values):
            end = at
            while end < len(values) and splits[end] == splits[at] and files[end] == files[at]:
                end += 1
            yield files[at], splits[at], values[at:end]
            at = end


def summaries(lines: DataFrame) -> DataFrame:
    """(file, split, head, name, description, tail): bases before the first header of a split, its last header, bases after that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list | None = None  # file, split, head, name, description, tail

        def row(x: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True))], schema=schema)

        schema = pa.schema([("file", pa.string()), ("split", pa.int64()), ("head", pa.int64()), ("name", pa.string()), ("description", pa.string()), ("tail", pa.int64())])
        for file, split, values in _runs(batches):
            if now is None or now[:2] != [file, split]:
                if now is not None:
                    yield row(now)
                now = [file, split, 0, None, None, 0]
            for v in values:
                if v.startswith(">"):
                    now[3], now[4] = header(v)
                    now[5] = 0
                else:
                    now[2 if now[3] is None else 5] += len(bases(v))
        if now is not None:
            yield row(now)

    return lines.mapInArrow(run, f"{SPLIT}, head long, name string, description string, tail long")


def header(line: str) -> tuple[str, str | None]:
    """Name and description: the name ends at the first white space."""
    name, _, rest = line[1:].strip().partition(" ") if " " in line else line[1:].strip().partition("\t")
    return name, rest.strip() or None


def bases(line: str) -> str:
    return "".join(line.split())


def carried(rows: list) -> dict[tuple[str, int], tuple[str | None, int]]:
    """The contig and its base at which each split begins, from the summaries of all splits."""
    out: dict[tuple[str, int], tuple[str | None, int]] = {}
    file, name, base = None, None, 0
    for r in sorted(rows, key=lambda r: (r["file"], r["split"])):
        if r["file"] != file:
            file, name, base = r["file"], None, 0
        out[r["file"], r["split"]] = (name, base)
        name, base = (name, base + r["head"]) if r["name"] is None else (r["name"], r["tail"])
    return out


def read_fasta_chunks(spark: SparkSession, path: str, size: int = CHUNK) -> DataFrame:
    """(chrom, chunk, seq): the bases of each contig in pieces of `size`, numbered from 0, as `sequence.chunked` gives them.

    path: a file, a folder or a pattern, plain or of a codec that Spark reads (only plain files are split). A split's row of a
    few bytes passes through the driver. Bases before a file's first header are an error; contigs without bases have no chunk; two
    contigs of one name are an error where both have bases.
    """
    lines = numbered_lines(spark, path)
    begins = carried(summaries(lines).collect())
    shared = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, now, name, base, held, length = shared.value, None, None, 0, [], 0
        out: list[tuple[str, int, int, str]] = []

        def flush(all_of_it: bool) -> None:
            """Whole chunks of what is held, and what is left if nothing more of it can come."""
            nonlocal base, held, length
            text = "".join(held)
            at = 0
            while at < len(text) and (all_of_it or len(text) - at >= size - (base + at) % size):
                end = min(len(text), at + size - (base + at) % size)
                out.append((name, (base + at) // size, (base + at) % size, text[at:end]))
                at = end
            base, held = base + at, [text[at:]]
            length = len(text) - at

        for file, split, values in _runs(batches):
            if now != (file, split):
                flush(True)
                now, held, length = (file, split), [], 0
                name, base = where[now]
            for v in values:
                if v.startswith(">"):
                    flush(True)
                    name, base, held, length = header(v)[0], 0, [], 0
                    continue
                s = bases(v)
                if s and name is None:
                    raise ValueError(f"bases before the first header of {file}")
                held.append(s)
                length += len(s)
                if length >= 4 * size:
                    flush(False)
            if len(out) >= 256:
                yield _pieces(out)
                out = []
        flush(True)
        if out:
            yield _pieces(out)

    pieces = lines.mapInArrow(cut, "chrom string, chunk long, at int, seq string")
    part = F.sort_array(F.collect_list(F.struct("at", "seq")))
    whole = pieces.groupBy("chrom", "chunk").agg(part.alias("p"))
    # Parts of one chunk follow each other without a gap or an overlap, or two contigs have one name.
    ends = F.aggregate("p", F.lit(0), lambda n, x: F.when(x["at"] == n, n + F.length(x["seq"])).otherwise(F.lit(-1 << 30)))
    checked = F.when(ends >= 0, F.array_join(F.transform("p", lambda x: x["seq"]), "")).otherwise(F.raise_error(F.concat(F.lit("two contigs named "), "chrom")))
    return whole.select("chrom", "chunk", checked.alias("seq"))


def _pieces(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    chrom, chunk, at, seq = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(chrom, pa.string()), pa.array(chunk, pa.int64()), pa.array(at, pa.int32()), pa.array(seq, pa.string())], names=["chrom", "chunk", "at", "seq"])
