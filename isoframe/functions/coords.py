"""Column expressions for genomic coordinates: 1-based closed intervals in flat columns chrom, start, end, strand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Name = str | Column


def _col(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def width(start: Name = "start", end: Name = "end") -> Column:
    return _col(end) - _col(start) + 1


def flip(strand: Name = "strand") -> Column:
    """The other strand; '*' stays."""
    return F.translate(_col(strand), "+-", "-+")


def strands_meet(a: Name, b: Name) -> Column:
    """Equal strands, or either of them '*'."""
    return (_col(a) == _col(b)) | (_col(a) == "*") | (_col(b) == "*")


def parse_interval(text: Name) -> Column:
    """'chrom:start-end/strand' or 'chrom:pos' to a struct; a missing strand is '*', what does not parse is null.

    start > end is null as well; use check_intervals to raise instead.
    """
    t = _col(text)
    # One match a text: its four parts are told apart by line ends, which none of them can hold; what does not match has empty ones.
    parts = F.split(F.regexp_replace(t, r"^(.+):(\d+)(?:-(\d+))?(?:/([+*-]))?$|[\s\S]+", "$1\n$2\n$3\n$4\n"), "\n")
    start = F.get(parts, 1).try_cast("bigint")
    end = F.coalesce(F.get(parts, 2).try_cast("bigint"), start)
    strand = F.get(parts, 3)
    return F.when(start <= end, F.struct(F.get(parts, 0).alias("chrom"), start.alias("start"), end.alias("end"), F.when(strand == "", "*").otherwise(strand).alias("strand")))


def format_interval(chrom: Name = "chrom", start: Name = "start", end: Name = "end", strand: Name | None = "strand") -> Column:
    """The natural key of a junction: 'chrom:start-end/strand'."""
    body = F.concat(_col(chrom), F.lit(":"), _col(start).cast("string"), F.lit("-"), _col(end).cast("string"))
    return body if strand is None else F.concat(body, F.lit("/"), _col(strand))


def check_intervals(df: DataFrame, text: str) -> DataFrame:
    """df with column text parsed to chrom, start, end, strand; raises while running if one does not parse."""
    parsed = parse_interval(text)
    bad = F.raise_error(F.concat(F.lit("not an interval: "), F.coalesce(F.col(text), F.lit("null")))).cast("struct<chrom:string,start:bigint,end:bigint,strand:string>")
    return df.select("*", F.coalesce(parsed, bad).alias("_interval")).select(*df.columns, "_interval.*")


def to_one_based(start: Name = "start") -> Column:
    """Start of a 0-based half-open interval as 1-based closed."""
    return _col(start) + 1


def to_zero_based(start: Name = "start") -> Column:
    return _col(start) - 1


def donor(start: Name = "start", end: Name = "end", strand: Name = "strand") -> Column:
    """The base of an intron beside its upstream exon."""
    return F.when(_col(strand) == "-", _col(end)).otherwise(_col(start))


def acceptor(start: Name = "start", end: Name = "end", strand: Name = "strand") -> Column:
    """The base of an intron beside its downstream exon."""
    return F.when(_col(strand) == "-", _col(start)).otherwise(_col(end))


def reverse_complement(seq: Name) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGTUacgtuRYKMBVDHrykmbvdh", "TGCAAtgcaaYRMKVBHDyrmkvbhd"))


def contig_name(header: Name) -> Column:
    """A FASTA header without its description."""
    return F.split(_col(header), r"\s")[0]


def strip_version(gene_id: Name) -> Column:
    """Ensembl-style ids without a version: one dot at most is cut, others stay."""
    g = _col(gene_id)
    return F.when(g.startswith("ENS") & (F.size(F.split(g, r"\.")) == 2), F.split(g, r"\.")[0]).otherwise(g)
