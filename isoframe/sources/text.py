"""Text sources: FASTA, GTF, BED, blank-line separated tables; file discovery."""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoframe.sources import bgzip
from isoframe.sources.store import settle

GTF_COLUMNS = ("chrom", "source", "type", "start", "end", "score", "strand", "phase", "attributes")
ATTRIBUTES = ("gene_id", "gene_name", "gene_biotype", "gene_type", "transcript_id", "transcript_name", "transcript_biotype", "transcript_type", "transcript_support_level", "exon_number", "exon_id", "ccds_id", "protein_id")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, description, seq, ord): one row for each record, in file order. The name ends at the first white space."""
    rows = spark.read.option("lineSep", ">").text(path).select("value", F.monotonically_increasing_id().alias("ord")).where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.expr("substring(value, length(regexp_extract(value, '^([^\\r\\n]*)', 1)) + 1)"), r"\s", "")
    return rows.select(F.split(head, r"\s")[0].alias("chrom"), F.nullif(F.regexp_extract(head, r"^\S+\s+(.*)$", 1), F.lit("")).alias("description"), body.alias("seq"), "ord")


def read_gtf(spark: SparkSession, path: str, attributes: Sequence[str] = ATTRIBUTES) -> DataFrame:
    """Rows of a GTF, plain, gzip or block-gzip, with the attributes asked for as columns; attributes that no row has are left out."""
    if bgzip.is_block_gzip(path):  # many tasks, where Spark's own reader has one for a compressed file
        cells = F.split("value", "\t")
        raw = bgzip.read_lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(*[cells[i].cast("long" if c in ("start", "end") else "string").alias(c) for i, c in enumerate(GTF_COLUMNS)])
    else:
        raw = spark.read.csv(path, sep="\t", comment="#", quote="", schema=", ".join(f"{c} {'long' if c in ('start', 'end') else 'string'}" for c in GTF_COLUMNS))
    value = lambda a: F.nullif(F.regexp_extract("attributes", rf'(?:^|;\s*){a}\s+"?([^";]*)"?', 1), F.lit(""))
    rows = raw.select("chrom", "source", "type", "start", "end", "strand", "phase", *[value(a).alias(a) for a in attributes])
    found = rows.agg(*[F.max(F.col(a).isNotNull()).alias(a) for a in attributes]).first()
    return rows.select("chrom", "source", "type", "start", "end", "strand", "phase", *[a for a in attributes if found and found[a]])


def is_bed(line: str) -> bool:
    parts = line.rstrip("\n").split("\t")
    return len(parts) >= 3 and parts[1].isdigit() and parts[2].isdigit()


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, name, strand), 1-based closed; three columns suffice."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser)") & (F.trim("value") != ""))
    p = F.split("value", "\t")
    strand = F.when(F.get(p, F.lit(5)).isin("+", "-"), F.get(p, F.lit(5))).otherwise("*")
    return lines.select(p[0].alias("chrom"), (p[1].cast("bigint") + 1).alias("start"), p[2].cast("bigint").alias("end"), F.get(p, F.lit(3)).alias("name"), strand.alias("strand"))


def write_bed(df: DataFrame, path: str, name: str | None = None) -> None:
    """BED lines, 0-based half-open."""
    cols = [F.col("chrom"), (F.col("start") - 1).cast("string"), F.col("end").cast("string"), *([F.col(name), F.lit("0"), F.col("strand")] if name else [])]
    df.select(F.concat_ws("\t", *cols).alias("value")).write.mode("overwrite").text(path)


def write_bedgraph(runs: DataFrame, path: str) -> None:
    """Coverage runs as bedGraph lines."""
    runs.select(F.concat_ws("\t", "chrom", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), F.col("depth").cast("string")).alias("value")).write.mode("overwrite").text(path)


def split_blocks(text: str) -> Iterator[list[list[str]]]:
    """Blank-line separated tables of tab-separated lines, each with its header first."""
    block: list[list[str]] = []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            block.append(line.rstrip("\r").split("\t"))
        elif block:
            yield block
            block = []


def read_blocks(spark: SparkSession, paths: dict[str, str], wanted: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables of samples' multi-table text files by the name of their first header cell, each with a sample column.

    paths: sample to file, plain or gzip. A column is numeric where every value of it is. Files are read by tasks, one each;
    a table's columns are those of its first file.
    """
    names = {p: s for s, p in paths.items()}
    files = spark.read.format("binaryFile").load(list(names)).select("path", "content")

    def run(batches):
        import pandas as pd

        for frame in batches:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                raw = bytes(content)
                text = (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode()
                for block in split_blocks(text):
                    if wanted is None or block[0][0] in wanted:
                        out += [(path, block[0][0], block[0], row) for row in block[1:]]
            yield pd.DataFrame(out, columns=["path", "block", "header", "row"])

    rows = files.mapInPandas(run, "path string, block string, header array<string>, row array<string>")
    tail = F.element_at(F.split("path", "/"), -1)
    by_tail = F.create_map(*[x for p, s in names.items() for x in (F.lit(os.path.basename(p)), F.lit(s))]) if len({os.path.basename(p) for p in names}) == len(names) else None
    plain = F.regexp_replace("path", r"^file:/+", "/")
    by_path = F.create_map(*[x for p, s in names.items() for x in (F.lit(os.path.abspath(p)), F.lit(s))])
    rows = rows.withColumn("sample", F.coalesce(by_path[plain], by_tail[tail]) if by_tail is not None else by_path[plain]).drop("path")
    rows = settle(rows)  # read for the headers, for the kinds of columns, and for each table
    out: dict[str, DataFrame] = {}
    for r in rows.groupBy("block").agg(F.first("header").alias("header")).collect():
        own = rows.where(F.col("block") == r["block"]).select("sample", *[F.get("row", F.lit(i)).alias(c) for i, c in enumerate(r["header"])])
        number = own.agg(*[F.bool_and(F.col(f"`{c}`").try_cast("double").isNotNull()).alias(c) for c in r["header"]]).first()
        out[r["block"]] = own.select("sample", *[F.col(f"`{c}`").cast("double").alias(c) if number[c] else F.col(f"`{c}`") for c in r["header"]])
    return out


def find_samples(folder: str, suffix: str | Sequence[str], level: int = 0) -> list[tuple[str, ...]]:
    """(sample, file, ...) of files with a suffix below a folder; the sample is the file's stem, or the folder `level` above it.

    Several suffixes are combined only if each finds the same samples.
    """
    suffixes = [suffix] if isinstance(suffix, str) else list(suffix)
    tables = []
    for s in suffixes:
        found = {}
        for path in sorted(glob.glob(os.path.join(folder, "**", f"*{s}"), recursive=True)):
            name, parent = os.path.basename(path)[: -len(s)], os.path.dirname(path)
            for _ in range(level):
                name, parent = os.path.basename(parent), os.path.dirname(parent)
            if name in found:
                raise ValueError(f"two files for sample {name!r}: {found[name]} and {path}")
            found[name] = path
        tables.append(found)
    if any(t.keys() != tables[0].keys() for t in tables):
        raise ValueError(f"the samples of {suffixes} differ")
    return [(s, *(t[s] for t in tables)) for s in sorted(tables[0])]


def find_fastq(folder: str, paired: bool = True, suffix: str = ".fastq.gz", level: int = 0) -> list[tuple[str, ...]]:
    return find_samples(folder, [f"_1{suffix}", f"_2{suffix}"] if paired else suffix, level)


def find_bams(folder: str, suffix: str = ".bam", level: int = 0) -> list[tuple[str, ...]]:
    return find_samples(folder, suffix, level)


def find_outputs(folder: str, level: int = 0) -> list[tuple[str, ...]]:
    """Samples' result tables, with their coverage files where all samples have one."""
    try:
        return find_samples(folder, [".txt.gz", ".cov"], level)
    except ValueError:
        return find_samples(folder, ".txt.gz", level)


def rename_contigs(df: DataFrame, alias: DataFrame) -> DataFrame:
    """df with contigs named by alias (old, new); names it lacks stay. Each old and each new name counts once, the first."""
    one = alias.select("old", "new").where("old is not null and new is not null").groupBy("old").agg(F.min("new").alias("new")).groupBy("new").agg(F.min("old").alias("old"))
    # As many rows as there are contigs: sent to all tasks, for a join by name would make each contig's rows one task's.
    return df.join(F.broadcast(one), df.chrom == one.old, "left").withColumn("chrom", F.coalesce("new", "chrom")).drop("old", "new")
