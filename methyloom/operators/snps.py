"""Known SNPs: building the index and looking sites up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .model import skipped
from .templates import carried

BIN_BITS = 6  # positions a bin: 64


def split_name(snps: DataFrame) -> DataFrame:
    """Add prefix and digits: the name without, and only, its trailing digits."""
    return snps.withColumns({"prefix": F.regexp_replace("name", "[0-9]+$", ""), "digits": F.regexp_extract("name", "([0-9]*)$", 1)})


def with_bin(snps: DataFrame) -> DataFrame:
    return snps.withColumns({"bin": F.shiftright("pos", BIN_BITS), "offset": F.col("pos").bitwiseAND(F.lit((1 << BIN_BITS) - 1)).cast("int")})


def flagged(snps: DataFrame, limit: float, selected: DataFrame | None = None) -> DataFrame:
    """Add flagged: an allele frequency of ``limit`` or more, or a selected name."""
    frequent = F.coalesce(F.col("maf") >= limit, F.lit(False))
    if selected is None:
        return snps.withColumn("flagged", frequent)
    names = selected.select("name").distinct().withColumn("_chosen", F.lit(True))
    return snps.join(names, "name", "left").withColumn("flagged", frequent | F.col("_chosen").isNotNull()).drop("_chosen")


def rename_contigs(snps: DataFrame, aliases: DataFrame) -> DataFrame:
    """SNPs under the names that aliases stand for; contigs without an alias drop out. The first of
    several names of an alias wins (aliases: alias, name, and ord if order matters)."""
    order = F.col("ord") if "ord" in aliases.columns else F.col("name")
    first = aliases.groupBy("alias").agg(F.min_by("name", order).alias("_name"))
    return snps.join(first, snps["contig"] == first["alias"]).drop("contig", "alias").withColumnRenamed("_name", "contig")


def one_per_position(snps: DataFrame) -> DataFrame:
    """The first SNP of each position: the first read where there is a column ord, then by name."""
    order = [c for c in ("ord", "name") if c in snps.columns]
    rest = [c for c in snps.columns if c not in ("contig", "pos", *order)]
    return snps.groupBy("contig", "pos").agg(F.min(F.struct(*order, *rest)).alias("s")).select("contig", "pos", "s.*")


def bitmaps(snps: DataFrame) -> DataFrame:
    """contig, bin, mask (64 bits), fq_mask (of flagged ones) and n."""
    bit = F.expr("shiftleft(1L, offset)")
    none = F.lit(0).cast("long")
    return with_bin(one_per_position(snps)).groupBy("contig", "bin").agg(F.bit_or(bit).alias("mask"), F.coalesce(F.bit_or(F.when(F.col("flagged"), bit)), none).alias("fq_mask"), F.count(F.lit(1)).alias("n"))


def bin_deltas(snps: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """contig, bin and delta: how far the bin lies from the one before that holds SNPs (the first: from
    0). Windows hold a stretch of bins; the last bin of earlier stretches is carried in."""
    rows = with_bin(snps).select("contig", "bin").distinct().withColumn("_stretch", F.floor(F.col("bin") / stretch))
    rows, before = carried(rows, F.col("bin"), F.max, F.max)
    last = F.lag("bin").over(W.partitionBy("contig", "_stretch").orderBy("bin"))
    return rows.select("contig", "bin", (F.col("bin") - F.coalesce(last, before, F.lit(0))).cast("long").alias("delta"))


def bitmap_rank(snps: DataFrame) -> DataFrame:
    """contig, pos and rank: entries of the bin below each SNP's own, as a popcount of the mask."""
    rows = with_bin(one_per_position(snps)).join(bitmaps(snps).select("contig", "bin", "mask"), ["contig", "bin"])
    below = F.col("mask").bitwiseAND(F.expr("~shiftleft(-1L, offset)"))
    return rows.select("contig", "pos", F.bit_count(below).cast("int").alias("rank"))


def index_totals(snps: DataFrame) -> DataFrame:
    """Of each contig: SNPs, flagged ones, first and last bin, distinct name prefixes, and the most SNPs of a bin."""
    rows = split_name(with_bin(one_per_position(snps)))
    largest = rows.groupBy("contig", "bin").agg(F.count(F.lit(1)).alias("n")).groupBy("contig").agg(F.max("n").alias("largest_bin"))
    totals = rows.groupBy("contig").agg(F.count(F.lit(1)).alias("snps"), F.count_if("flagged").alias("flagged"), F.min("bin").alias("min_bin"), F.max("bin").alias("max_bin"), F.count_distinct("prefix").alias("prefixes"))
    return totals.join(largest, "contig")


def lookup(sites: DataFrame, snps: DataFrame) -> DataFrame:
    """Sites with id (``.`` if unknown) and rs_found: 0 unknown, 1 known, 3 known and flagged."""
    known = snps.select("contig", "pos", F.col("name").alias("_name"), F.col("flagged").alias("_flagged"))
    joined = sites.join(known, ["contig", "pos"], "left")
    found = F.when(F.col("_name").isNull(), 0).when(F.col("_flagged"), 3).otherwise(1)
    return joined.withColumns({"id": F.coalesce("_name", F.lit(".")), "rs_found": found}).drop("_name", "_flagged")


def written_sites(sites: DataFrame, all_positions: bool = False) -> DataFrame:
    """Sites that go to the output: not those homozygous A or T like the reference, unless all
    positions are wanted or a flagged SNP lies there."""
    return sites if all_positions else sites.filter(~skipped(sites) | (F.col("rs_found") == 3))


# fixed values: keys of the public SNP objects
REFSNP_SCHEMA = (
    "refsnp_id string, primary_snapshot_data struct<"
    "placements_with_allele:array<struct<is_ptlp:boolean,alleles:array<struct<allele:struct<spdi:struct<seq_id:string,position:bigint,deleted_sequence:string,inserted_sequence:string>>>>>>,"
    "allele_annotations:array<struct<frequency:array<struct<study_name:string,allele_count:bigint,total_count:bigint,observation:struct<deleted_sequence:string,inserted_sequence:string>>>>>>"
)


def from_json_objects(lines: DataFrame, column: str = "value") -> DataFrame:
    """contig, pos, name and maf of SNP objects, one per line. Only the preferred placement counts,
    and only if its last allele replaces one letter by another; frequencies of studies that observe
    single letters are summed, and fold to one half. Positions are 1-based, as everywhere here."""
    rows = lines.select(F.from_json(column, REFSNP_SCHEMA).alias("o"))
    placed = F.filter("o.primary_snapshot_data.placements_with_allele", lambda p: p["is_ptlp"])
    rows = rows.withColumn("spdi", F.element_at(F.get(placed, F.lit(0))["alleles"], -1)["allele"]["spdi"])
    single = lambda x: (F.length(x["deleted_sequence"]) == 1) & (F.length(x["inserted_sequence"]) == 1)
    counts = F.filter(F.flatten(F.transform("o.primary_snapshot_data.allele_annotations", lambda a: a["frequency"])), lambda f: single(f["observation"]) & (f["allele_count"] <= f["total_count"]) & (f["observation"]["deleted_sequence"] != f["observation"]["inserted_sequence"]))
    added = lambda k: F.aggregate(counts, F.lit(0).cast("long"), lambda t, f: t + f[k])
    seen, total = added("allele_count"), added("total_count")
    rows = rows.filter(single(F.col("spdi")) & (F.col("spdi.deleted_sequence") != F.col("spdi.inserted_sequence")) & F.col("spdi.position").isNotNull())
    share = F.when(total > 0, seen / total)
    return rows.select(F.col("spdi.seq_id").alias("contig"), (F.col("spdi.position") + 1).alias("pos"), F.concat(F.lit("rs"), "o.refsnp_id").alias("name"), F.least(share, 1 - share).alias("maf"))
