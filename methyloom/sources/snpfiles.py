"""SNP inputs as text lines: BED, VCF and JSON objects, aliases and name lists.

gzip and bzip2 files are read by Spark itself, xz files by Python (one task a file, as for gzip);
compress(1) files have no codec here and are not read.
"""

from __future__ import annotations

import io
import itertools
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.snps import from_json_objects


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """value, file and ord (by file, in order of the list, then by line) of text files, compressed or not."""
    out = None
    for number, path in enumerate(paths):
        lines = _xz_lines(spark, path) if path.endswith(".xz") else spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
        lines = lines.select("value", F.lit(path).alias("file"), F.struct(F.lit(number).alias("file"), F.col("ord").alias("line")).alias("ord"))
        out = lines if out is None else out.unionByName(lines)
    return out


def _xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of xz files, unpacked piece by piece."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                number = 0
                with lzma.open(io.BytesIO(content), "rt", encoding="utf-8", errors="replace", newline="\n") as lines:
                    while batch := list(itertools.islice(lines, 10_000)):
                        yield pd.DataFrame({"value": [x.rstrip("\r\n") for x in batch], "ord": range(number, number + len(batch))})
                        number += len(batch)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "value string, ord long")


def tokens(line: Column, delimiter: str | None = "\t") -> Column:
    """Fields of a line, without white space about them; parted by white space if no delimiter is given."""
    if delimiter is None:
        return F.filter(F.split(line, r"\s+"), lambda x: x != "")
    return F.transform(F.split(line, f"\\Q{delimiter}\\E"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))


def sniff(first_line: str) -> str:
    """``json``, ``vcf`` or ``bed`` by a file's first line."""
    if first_line.startswith("{"):
        return "json"
    return "vcf" if first_line.startswith("##fileformat=VCF") else "bed"


def parse_bed(lines: DataFrame) -> DataFrame:
    """contig, pos (1-based) and name of BED lines of five fields or more and a width of one;
    ``track`` lines are headers."""
    rows = lines.filter(~F.startswith("value", F.lit("track "))).select(tokens(F.col("value")).alias("f")).filter(F.size("f") >= 5)
    rows = rows.select(F.get("f", F.lit(0)).alias("contig"), F.get("f", F.lit(1)).try_cast("long").alias("a"), F.get("f", F.lit(2)).try_cast("long").alias("pos"), F.get("f", F.lit(3)).alias("name"))
    return rows.filter("pos - a = 1").drop("a")


def parse_vcf(lines: DataFrame) -> DataFrame:
    """contig, pos and name of VCF lines whose REF and ALT are single letters."""
    rows = lines.filter(~F.startswith("value", F.lit("#"))).select(tokens(F.col("value")).alias("f")).filter(F.size("f") >= 5)
    rows = rows.filter((F.length(F.get("f", F.lit(3))) == 1) & (F.length(F.get("f", F.lit(4))) == 1))
    rows = rows.select(F.get("f", F.lit(0)).alias("contig"), F.get("f", F.lit(1)).try_cast("long").alias("pos"), F.get("f", F.lit(2)).alias("name"))
    return rows.filter("pos is not null")


def read_snps(spark: SparkSession, *paths: str, kind: str | None = None) -> DataFrame:
    """contig, pos, name, maf (null where unknown) and ord (order of files, which decides which SNP of a position
    is the first) of SNP files, each of its own kind unless given."""
    out = None
    for number, path in enumerate(paths):
        lines = read_lines(spark, path)
        first = lines.first()
        parse = {"bed": parse_bed, "vcf": parse_vcf, "json": from_json_objects}[kind or sniff(first[0] if first else "")]
        rows = parse(lines)
        rows = rows if "maf" in rows.columns else rows.withColumn("maf", F.lit(None).cast("double"))
        rows = rows.withColumn("ord", F.lit(number))
        out = rows if out is None else out.unionByName(rows)
    return out


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    return parse_aliases(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


def parse_aliases(lines: DataFrame) -> DataFrame:
    """alias, name and ord (order in the file) of two-column lines (ord, value)."""
    rows = lines.select(tokens(F.col("value")).alias("f"), "ord").filter(F.size("f") >= 2)
    return rows.select(F.get("f", F.lit(0)).alias("alias"), F.get("f", F.lit(1)).alias("name"), "ord")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return parse_names(spark.read.text(path))


def parse_names(lines: DataFrame) -> DataFrame:
    """Distinct first words of lines."""
    return lines.select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("name")).filter("name <> ''").distinct()


def write_index(snps: DataFrame, path: str) -> None:
    """SNP index: Parquet by contig, sorted by position, so lookups prune to a contig and its pages. Tasks
    write ranges of positions, several to a large contig."""
    snps.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos").write.mode("overwrite").partitionBy("contig").parquet(path)


def read_index(spark: SparkSession, path: str, contig: str | None = None) -> DataFrame:
    """The index, or one contig's partition of it."""
    rows = spark.read.parquet(path)
    return rows if contig is None else rows.filter(F.col("contig") == contig)
