"""Alignments to called sites: filters, positions, mates, duplicates, aligned bases, pileup, genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import CallParams
from . import cigar, filters, model
from .pileup import pileup

RESCUED = ("insert_size", "mate_other_contig", "orientation")


def with_positions(reads: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Add fwd_pos and rev_pos, where a template's forward and reverse mates begin. The read's own place
    is known; its mate's is null if the pair is not proper or the mate is unmapped, elsewhere
    (``keep_unmatched``) or not given."""
    flag, reverse = F.col("flag"), F.col("is_reverse")
    wanted = filters.PROPER
    matched = flag.bitwiseAND(F.lit(filters.MATE_UNMAPPED | filters.PROPER)) == wanted
    if params.keep_unmatched:
        apart = (F.col("mate_contig") != F.col("contig")) | (F.abs("isize") > params.max_template)
        turned = F.when(reverse, F.col("pos") < F.col("mate_pos")).otherwise(F.col("pos") > F.col("mate_pos"))
        matched = matched & ~F.coalesce(apart | turned, F.lit(False))
    mate = F.when(matched & filters.has(flag, filters.PAIRED) & (F.col("mate_pos") > 0), F.col("mate_pos"))
    return reads.withColumns({"fwd_pos": F.when(reverse, mate).otherwise(F.col("pos")), "rev_pos": F.when(reverse, F.col("pos")).otherwise(mate)})


def usable_reads(reads: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Reads that pass the filters, with flags decoded, positions, bs_strand (from the tags) and ori:
    0 for the first read of a pair, 1 for the second; of single reads 0 forward, 1 reverse."""
    rows = filters.decode_flags(reads).withColumn("bs_strand", cigar.bisulfite_strand(F.col("tags")))
    reason = filters.filter_reason(params, F.col("mate_contig"), F.col("pos"), F.col("mate_pos"))
    rows = with_positions(rows.filter(reason == "passed"), params)
    return rows.withColumn("ori", F.when(F.col("is_paired"), F.col("is_second")).otherwise(F.col("is_reverse")).cast("int"))


def mean_quality(quals: Column | str) -> Column:
    """Whole mean of an array of base qualities, each capped as everywhere; 0 for none."""
    capped = F.transform(quals, lambda q: F.least(q, F.lit(cigar.MAX_QUAL)))
    return F.when(F.size(quals) > 0, F.floor(F.aggregate(capped, F.lit(0), lambda t, q: t + q) / F.size(quals))).otherwise(0).cast("int")


def templates(reads: DataFrame) -> DataFrame:
    """One row for each (contig, qname): positions and strand (of its first read), mates (1 or 2), whole means
    of mapping quality over mates and of base quality over all bases, and ord, its first read."""
    total = F.aggregate("qual", F.lit(0), lambda t, q: t + F.least(q, F.lit(cigar.MAX_QUAL)))
    # mates rarely meet before the shuffle, so it comes first and without the arrays: nothing is sorted for it
    few = reads.select("contig", "qname", "ord", "fwd_pos", "rev_pos", "bs_strand", "is_reverse", "is_paired", "mapq", F.size("qual").alias("_n"), total.alias("_q"))
    row = F.struct("ord", "fwd_pos", "rev_pos", "bs_strand")
    own = F.struct("ord", "mapq", F.col("_n").alias("n"), F.col("_q").alias("q"))
    rows = few.repartition("contig", "qname").groupBy("contig", "qname").agg(
        F.min(row).alias("_first"),
        F.min(F.when(~F.col("is_reverse"), own)).alias("_fwd"),
        F.min(F.when(F.col("is_reverse"), own)).alias("_rev"),
        F.max("is_paired").alias("paired"),
    )
    part = lambda field: F.coalesce(F.col(f"_fwd.{field}"), F.lit(0)) + F.coalesce(F.col(f"_rev.{field}"), F.lit(0))
    mates = F.when(F.col("_fwd").isNotNull(), 1).otherwise(0) + F.when(F.col("_rev").isNotNull(), 1).otherwise(0)
    rows = rows.withColumns({"mates": mates, "mean_mapq": F.floor(part("mapq") / mates).cast("int"), "mean_qual": F.when(part("n") > 0, F.floor(part("q") / part("n"))).otherwise(0).cast("int")})
    return rows.select("contig", "qname", "_first.*", "mates", "paired", "mean_mapq", "mean_qual")


def without_duplicates(rows: DataFrame) -> DataFrame:
    """Of templates (of :func:`templates`) at the same positions on the same strand the one of the best mean mapping
    quality, then of the best mean base quality, then the first read; pairs and singles apart. n_dup
    counts all of them."""
    rank = F.struct("mean_mapq", "mean_qual", (-F.col("ord")).alias("_ord"), "qname", "ord", "paired")
    best = rows.groupBy("contig", "fwd_pos", "rev_pos", "bs_strand", "mates").agg(F.max(rank).alias("_s"), F.count(F.lit(1)).alias("n_dup"))
    return best.select("contig", "_s.qname", "fwd_pos", "rev_pos", "bs_strand", "mates", "_s.paired", "_s.mean_mapq", "_s.mean_qual", "_s.ord", "n_dup")


def kept_templates(reads: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Templates that go on: a pair whose mate is missing only with ``keep_unmatched``, duplicates
    only with ``keep_duplicates``."""
    rows = templates(reads)
    if not params.keep_unmatched:
        rows = rows.filter("mates = 2 or not paired")
    return rows if params.keep_duplicates else without_duplicates(rows)


def marked_bases(reads: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Every base of the reads of kept templates with the columns clipped, overlap and trimmed that say why it is left out."""
    usable = usable_reads(reads, params)
    kept = kept_templates(usable, params).select("contig", "qname")
    usable = usable.join(kept, ["contig", "qname"], "left_semi")
    return cigar.aligned_bases(cigar.with_mate_overlap(usable), params, clips=True)


def sites_from_reads(reads: DataFrame, ref: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """From alignments (of ``read_sam``) and a reference (contig, pos, ref) to called and filtered sites. Bases become a
    pileup before the reference joins, so that join has one row a site."""
    bases = marked_bases(reads, params).filter("not clipped and base is not null")
    piled = pileup(bases, params).join(ref.select("contig", "pos", "ref"), ["contig", "pos"], "left")
    return model.finished_sites(model.genotyped_pileup(piled, params))
