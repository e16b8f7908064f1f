"""Samples' multi-table text files as a sink: spark.dataSource.register(BlockSink), format "sample-blocks".

One file a sample holds named tables in a fixed order, each a header line and its rows, tab-separated, with an empty line
after it; `text.read_blocks` reads them back. Files are block-gzip. A task writes its samples under names of its own; the
commit gives the files of all tasks their names at once, and whatever other attempts have left goes. So a failed or repeated
task leaves no file, and a failed job none at all.
"""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from isoframe.sources.bgzip import compress

SUFFIX = ".txt.gz"
#: Bytes of text that a task holds before it compresses them.
HELD_BYTES = 4 << 20


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: (temporary name, sample) of each file."""

    files: list[tuple[str, str]]


class _File:
    """A block-gzip file in the making."""

    def __init__(self, path: str):
        self.path, self.out, self.held, self.size = path, open(path, "wb"), [], 0  # noqa: SIM115

    def add(self, line: str) -> None:
        data = line.encode() + b"\n"
        self.held.append(data)
        self.size += len(data)
        if self.size >= HELD_BYTES:
            self.out.write(compress(b"".join(self.held), end=False))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.out.write(compress(b"".join(self.held)))
        self.out.close()


class BlockWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.folder, self.overwrite = options["path"], overwrite
        self.scratch = os.path.join(self.folder, f"_temporary-{uuid4().hex}")

    def write(self, iterator: Iterator) -> Written:
        """Rows (sample, line), each sample's together and in order."""
        os.makedirs(self.scratch, exist_ok=True)
        files: list[tuple[str, str]] = []
        now: _File | None = None
        sample = None
        try:
            for row in iterator:
                if now is None or row[0] != sample:
                    if now is not None:
                        now.close()
                    sample = row[0]
                    now = _File(os.path.join(self.scratch, uuid4().hex))
                    files.append((now.path, sample))
                now.add(row[1])
            if now is not None:
                now.close()
        except BaseException:
            if now is not None:
                now.out.close()
            for path, _ in files:
                os.unlink(path)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        found = [f for m in messages if m is not None for f in m.files]
        if len({s for _, s in found}) < len(found):
            self.abort(messages)
            raise ValueError("rows of one sample came from several tasks")
        target = {s: os.path.join(self.folder, s + SUFFIX) for _, s in found}
        if not self.overwrite and (there := sorted(p for p in target.values() if os.path.exists(p))):
            self.abort(messages)
            raise FileExistsError(there[0])
        for path, s in found:
            os.replace(path, target[s])
        shutil.rmtree(self.scratch, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.scratch, ignore_errors=True)


class BlockSink(DataSource):
    """Option: path, a folder on storage that every node mounts."""

    @classmethod
    def name(cls):
        return "sample-blocks"

    def schema(self):
        return "sample string, line string"

    def writer(self, schema, overwrite):
        return BlockWriter(self.options, overwrite)


def block_lines(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(sample, block, n, line): the lines of all files. Tables have a sample column and are written in the order given, under their
    names, rows sorted by all columns from the left; every sample that any table has gets the headers of all."""
    samples = None
    for df in tables.values():
        own = df.select(F.col("sample").cast("string").alias("sample"))
        samples = own if samples is None else samples.union(own)
    samples = samples.where("sample is not null").distinct()
    out = None
    for k, (name, df) in enumerate(tables.items()):
        columns = [c for c in df.columns if c != "sample"]
        if not columns:
            raise ValueError(f"table {name!r} has no columns")
        head = "\t".join([name, *columns[1:]])  # a table's name is its first header cell
        cells = [F.coalesce(F.regexp_replace(F.col(f"`{c}`").cast("string"), r"[\t\r\n]", " "), F.lit("NA")) for c in columns]
        n = F.row_number().over(Window.partitionBy("sample").orderBy(*[F.col(f"`{c}`") for c in columns]))
        rows = df.where("sample is not null").select(F.col("sample").cast("string").alias("sample"), F.lit(k).alias("block"), n.cast("long").alias("n"), F.concat_ws("\t", *cells).alias("line"))
        frame = samples.select("sample", F.lit(k).alias("block"), F.explode(F.array(F.struct(F.lit(0).cast("long").alias("n"), F.lit(head).alias("line")), F.struct(F.lit((1 << 63) - 1).alias("n"), F.lit("").alias("line")))).alias("x"))
        both = rows.union(frame.select("sample", "block", "x.n", "x.line"))
        out = both if out is None else out.union(both)
    return out


def write_blocks(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str, overwrite: bool = False) -> None:
    """A file for each sample, folder/sample.txt.gz, with the tables in the order given.

    Nulls are NA, tabs and line ends within a cell become spaces. Without overwrite a file that is there already is an error and
    nothing is written; other files of the folder stay.
    """
    os.makedirs(folder, exist_ok=True)
    spark.dataSource.register(BlockSink)
    lines = block_lines(tables).repartition("sample").sortWithinPartitions("sample", "block", "n")
    lines.select("sample", "line").write.format("sample-blocks").mode("overwrite" if overwrite else "append").save(folder)


def reference_tables(store, names: Sequence[str], columns: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """Tables of a reference as blocks of one file, named `reference`."""
    chosen = columns or {}
    return {n: store.read(n).select(F.lit("reference").alias("sample"), *chosen.get(n, [c for c, t in store.read(n).dtypes if not t.startswith(("array", "struct", "map"))])) for n in names}
