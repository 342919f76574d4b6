"""Reference sequences, regions and alignments from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bases import base_code, base_letter
from ..operators.cigar import parse_cigar
from ..operators.contigs import valid_regions
from ..operators.model import settled
from ..operators.templates import carried
from .snpfiles import tokens


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig, pos (1-based) and ref (code, null for N) of a FASTA file, read split by split."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("ord")]
    return parse_fasta(spark.read.text(path).select(*place, "value"))


def parse_fasta(lines: DataFrame) -> DataFrame:
    """Bases of FASTA lines (file, part, ord, value; parts and lines inside them in order). A line's place is
    the sum of the lengths before it, less that at its contig's header; sums and headers run inside a
    part, and a table of parts carries them on, so no task holds a contig. Lines before the first header go."""
    header = F.startswith("value", F.lit(">"))
    rows = lines.select("file", F.col("part").alias("_stretch"), "ord", "value", F.when(header, "").otherwise(F.regexp_replace("value", r"\s", "")).alias("_seq"))
    own = W.partitionBy("file", "_stretch").orderBy("ord")
    size = F.length("_seq").cast("long")
    rows, before = carried(rows, size, F.sum, F.sum, by="file")
    inside = F.sum(size).over(own.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_at", F.coalesce(before, F.lit(0)) + F.coalesce(inside, F.lit(0))).drop("_before")
    mark = F.when(header, F.struct("_stretch", "ord", F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("name"), "_at"))
    rows, before = carried(rows, mark, F.max, F.max, by="file")
    rows = rows.withColumn("_last", F.coalesce(F.max(mark).over(own.rowsBetween(W.unboundedPreceding, 0)), before)).filter("_last is not null and _seq <> ''")
    letters = rows.select(F.col("_last.name").alias("contig"), (F.col("_at") - F.col("_last._at")).alias("at"), F.posexplode(F.split("_seq", "")).alias("i", "letter"))
    return letters.select("contig", (F.col("at") + F.col("i") + 1).cast("long").alias("pos"), base_code(F.col("letter")).cast("int").alias("ref"))


def read_fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """name, length, offset, line_bases and line_width of a FASTA index."""
    return parse_fasta_index(spark.read.text(path))


def parse_fasta_index(lines: DataFrame) -> DataFrame:
    f = lambda i: F.get("f", F.lit(i)).try_cast("long")
    rows = lines.select(tokens(F.col("value")).alias("f")).filter(F.size("f") >= 5)
    return rows.select(F.get("f", F.lit(0)).alias("name"), f(1).alias("length"), f(2).alias("offset"), f(3).alias("line_bases"), f(4).alias("line_width"))


def reference_string(ref: DataFrame, spans: DataFrame) -> DataFrame:
    """Reference letters of each span (contig, start_pos, end_pos; inclusive, of moderate length), N where nothing is known."""
    rows = spans.withColumn("pos", F.explode(F.sequence("start_pos", "end_pos"))).join(ref.select("contig", "pos", "ref"), ["contig", "pos"], "left")
    letters = F.array_sort(F.collect_list(F.struct("pos", base_letter(F.col("ref")).alias("l"))))
    return rows.groupBy("contig", "start_pos", "end_pos").agg(F.array_join(F.transform(letters, lambda x: x["l"]), "").alias("letters"))


def read_sizes(spark: SparkSession, path: str) -> DataFrame:
    return parse_sizes(spark.read.text(path))


def parse_sizes(lines: DataFrame) -> DataFrame:
    """Contig names: the first field of each line."""
    return lines.select(F.get(tokens(F.col("value")), F.lit(0)).alias("name")).filter("name <> ''").distinct()


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return parse_regions(spark.read.text(path))


def parse_regions(lines: DataFrame) -> DataFrame:
    """1-based inclusive regions of BED lines; lines of fewer than three fields or no width are skipped."""
    rows = lines.select(tokens(F.col("value")).alias("f")).filter(F.size("f") >= 3)
    bed = rows.select(F.get("f", F.lit(0)).alias("contig"), F.get("f", F.lit(1)).try_cast("long").alias("start0"), F.get("f", F.lit(2)).try_cast("long").alias("end"))
    return valid_regions(bed)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM text file, compressed or not, in the form of :func:`parse_sam`; ord is the order in the file."""
    return parse_sam(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


def parse_sam(lines: DataFrame) -> DataFrame:
    """SAM lines (ord, value) as ord, qname, flag, contig, pos, mapq, mate_contig, mate_pos, isize, cigar,
    seq, qual (array) and tags (array of tag, value). Header lines and lines of fewer than eleven fields go."""
    lines = lines.filter(~F.startswith("value", F.lit("@")))
    f = lambda i: F.get("f", F.lit(i))
    # settled: filters of the fields would otherwise split the line again for each use of a field
    rows = settled(lines.select("ord", F.split("value", "\t").alias("f"))).filter(F.size("f") >= 11)
    mate = F.when(f(6) == "=", f(2)).otherwise(f(6))
    quality = F.when(f(10) == "*", F.expr("cast(array() as array<int>)")).otherwise(F.transform(F.split(f(10), ""), lambda c: F.ascii(c) - 33))
    tags = F.transform(F.slice("f", 12, F.size("f")), lambda t: F.struct(F.substring(t, 1, 2).alias("tag"), F.substr(t, F.lit(6)).alias("value")))
    return rows.select("ord", f(0).alias("qname"), f(1).cast("int").alias("flag"), f(2).alias("contig"), f(3).cast("long").alias("pos"), f(4).cast("int").alias("mapq"), mate.alias("mate_contig"), f(7).cast("long").alias("mate_pos"), f(8).cast("int").alias("isize"), parse_cigar(f(5)).alias("cigar"), f(9).alias("seq"), quality.alias("qual"), tags.alias("tags"))


def read_header(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Contigs (name, length, assembly, md5, species) and read groups (bc, sm, ds; one of each barcode)
    of a SAM header."""
    return parse_header(spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()))


def parse_header(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of lines (ord, value). Headers are small; contigs are numbered in one task."""
    lines = lines.filter(F.startswith("value", F.lit("@")))
    keyed = lines.select("ord", F.substring("value", 1, 3).alias("kind"), F.expr(r"map_from_entries(transform(filter(slice(split(value, '\t'), 2, size(split(value, '\t'))), x -> instr(x, ':') > 0), x -> struct(substring(x, 1, 2), substring(x, 4))))").alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    contigs = keyed.filter("kind = '@SQ'").select((F.row_number().over(W.orderBy("ord")) - 1).alias("ix"), get("SN").alias("name"), get("LN").cast("long").alias("length"), get("AS").alias("assembly"), get("M5").alias("md5"), get("SP").alias("species"))
    groups = keyed.filter("kind = '@RG'").select("ord", get("BC").alias("bc"), get("SM").alias("sm"), get("DS").alias("ds"))
    groups = groups.groupBy("bc").agg(F.min_by(F.struct("sm", "ds"), "ord").alias("s")).select("bc", "s.*")
    return contigs, groups
