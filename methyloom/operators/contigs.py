"""Contig sets and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .templates import blocks

BIN = 1 << 14  # positions; an interval meets the bins it covers


def resolve_contigs(reference: DataFrame, header: DataFrame, sizes: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Names to work on, in four cases: in reference and header; of these, those among the sizes; those
    that have regions; or, with both, those that have regions, each of which must be among the
    sizes (a region's contig that is not is left out, see :func:`missing_contigs`). All have a column name."""
    names = reference.select("name").intersect(header.select("name"))
    for wanted in (sizes, regions):
        if wanted is not None:
            names = names.join(wanted.select("name").distinct(), "name", "left_semi")
    return names


def contig_union(*sources: DataFrame) -> DataFrame:
    """Every name once, with the number of the first source that has it."""
    out = None
    for i, source in enumerate(sources):
        part = source.select("name", F.lit(i).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("name").agg(F.min("source").alias("source"))


def missing_contigs(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Names asked for that are not known."""
    return wanted.select("name").distinct().join(known.select("name"), "name", "left_anti")


def binned(intervals: DataFrame, start: str = "start_pos", end: str = "end_pos") -> DataFrame:
    return intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / BIN), F.floor(F.col(end) / BIN))))


def region_overlaps(regions: DataFrame) -> DataFrame:
    """Pairs of regions (both inclusive) of one contig that overlap: start/end of the earlier, start2/end2
    of the later; a region that is there twice overlaps itself. Equal keys are bins, so no nested
    loop over all pairs."""
    rows = regions.groupBy("contig", "start_pos", "end_pos").agg(F.count(F.lit(1)).alias("times"))
    a = binned(rows)
    b = binned(rows.select("contig", F.col("start_pos").alias("start2"), F.col("end_pos").alias("end2")), "start2", "end2")
    later = "start_pos < start2 or (start_pos = start2 and (end_pos < end2 or (end_pos = end2 and times > 1)))"
    pairs = a.join(b, ["contig", "_bin"]).filter(f"({later}) and start2 <= end_pos")
    return pairs.select("contig", "start_pos", "end_pos", "start2", "end2").distinct()


def valid_regions(bed: DataFrame) -> DataFrame:
    """BED rows (start0, end) with a width, as 1-based inclusive regions."""
    return bed.filter("start0 < end").select("contig", (F.col("start0") + 1).cast("long").alias("start_pos"), F.col("end").cast("long").alias("end_pos"))


def without_overlaps(regions: DataFrame) -> DataFrame:
    """Regions, in order of start (of equal starts, of end), that overlap no earlier one that is kept
    itself; of equal regions one. Each stretch that regions cover without a gap is settled by itself."""
    keys = ["contig", "start_pos", "end_pos"]
    rows = blocks(regions.select("contig", F.col("start_pos").alias("st"), F.col("end_pos").alias("en")).distinct(), gap=0)
    each = rows.groupBy("contig", "block").agg(F.array_sort(F.collect_list(F.struct("st", "en"))).alias("r"))
    # the list so far and the end of its last region
    start = F.struct(F.slice("r", 1, 1).alias("kept"), F.get(F.col("r"), F.lit(0))["en"].alias("reach"))

    def step(state: Column, x: Column) -> Column:
        return F.when(x["st"] > state["reach"], F.struct(F.concat(state["kept"], F.array(x)).alias("kept"), x["en"].alias("reach"))).otherwise(state)

    kept = each.select("contig", F.explode(F.aggregate("r", start, step, lambda state: state["kept"])).alias("k")).select("contig", F.col("k.st").alias("start_pos"), F.col("k.en").alias("end_pos"))
    return regions.dropDuplicates(keys).join(kept, keys, "left_semi")


def clamped_regions(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """Regions cut off at their contig's end (``contigs``: name, length), with the column beyond that says
    which were; regions that begin beyond it, or on contigs not listed, go."""
    ends = contigs.select(F.col("name").alias("contig"), F.col("length").alias("_length"))
    rows = regions.join(ends, "contig").filter("start_pos <= _length").withColumn("beyond", F.col("end_pos") > F.col("_length"))
    return rows.withColumn("end_pos", F.least("end_pos", "_length").cast("long")).drop("_length")


def reads_in_regions(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads that overlap a region (fetch by overlap: contig, pos and the CIGAR's span)."""
    span = F.aggregate("cigar", F.lit(0), lambda total, c: total + F.when(c["op"].isin("M", "=", "X", "D", "N"), c["len"]).otherwise(0))
    rows = reads.withColumn("_end", F.col("pos") + F.greatest(span, F.lit(1)) - 1)
    left, right = binned(rows, "pos", "_end").alias("s"), binned(regions).alias("r")
    on = (F.col("s.contig") == F.col("r.contig")) & (F.col("s._bin") == F.col("r._bin")) & (F.col("s.pos") <= F.col("r.end_pos")) & (F.col("s._end") >= F.col("r.start_pos"))
    # a read that spans a bin's edge is there twice
    return left.join(right, on, "left_semi").dropDuplicates(["ord"]).drop("_bin", "_end")


def with_contig_ids(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows of listed contigs with the contig's number in the header (``contigs``: name, ix)."""
    return rows.join(contigs.select(F.col("name").alias("contig"), "ix"), "contig")


def sites_in_regions(sites: DataFrame, regions: DataFrame, how: str = "left_semi") -> DataFrame:
    """Sites inside some region (``left_semi``), outside all (``left_anti``), or with each region
    (``inner``). An equi-join on bins, then the exact bounds."""
    left, right = sites.withColumn("_bin", F.floor(F.col("pos") / BIN)).alias("s"), binned(regions).alias("r")
    on = (F.col("s.contig") == F.col("r.contig")) & (F.col("s._bin") == F.col("r._bin")) & F.col("s.pos").between(F.col("r.start_pos"), F.col("r.end_pos"))
    joined = left.join(right, on, how)
    if how == "inner":
        return joined.select("s.*", "r.start_pos", "r.end_pos").drop("_bin")
    return joined.drop("_bin")


def gc_bins(ref: DataFrame, width: int = 100) -> DataFrame:
    """contig, bin, first and gc: percent of G and C among ``width`` positions; 255 if any is not A, C, G or T
    (or missing). Bins count from ``first``, the contig's first known base."""
    first = ref.filter("ref is not null").groupBy("contig").agg(F.min("pos").alias("first"))
    rows = ref.join(first, "contig").filter("pos >= first").withColumn("bin", F.floor((F.col("pos") - F.col("first")) / width).cast("int"))
    out = rows.groupBy("contig", "bin").agg(F.min("first").alias("first"), F.count("ref").alias("known"), F.count_if(F.col("ref").isin(1, 2)).alias("gc"))
    return out.select("contig", "bin", "first", F.when(F.col("known") < width, 255).otherwise(F.floor(F.col("gc") * 100 / width)).cast("int").alias("gc"))
