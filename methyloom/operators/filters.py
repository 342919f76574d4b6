"""Read and base filters: an ordered chain of reasons as one CASE expression."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import CallParams

# fixed values: flag bits of the alignment format
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECOND, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = (1 << i for i in range(12))


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def decode_flags(reads: DataFrame) -> DataFrame:
    """Add is_reverse, is_second, is_paired and the orientation: forward where first-and-forward
    or second-and-reverse."""
    flag = F.col("flag")
    reverse, second = has(flag, REVERSE), has(flag, SECOND)
    return reads.withColumns({"is_reverse": reverse, "is_second": second, "is_paired": has(flag, PAIRED), "orientation": F.when(reverse == second, 0).otherwise(1)})


def filter_reason(params: CallParams = CallParams(), mate_contig: Column | None = None, pos: Column | None = None, mate_pos: Column | None = None) -> Column:
    """Why a read is left out, or ``passed``. Reasons are tried in order, the first one holds.

    Paired reads are also left out if not properly aligned; with ``keep_unmatched`` they count as
    single. ``ignore_duplicates`` lets duplicates pass only among properly checked pairs, and such
    pairs need not be proper either. Mates on other contigs, too large inserts and bad orientation
    make reads of pairs fail unless ``keep_unmatched`` makes them single.
    """
    flag = F.col("flag")
    pair = has(flag, PAIRED) & F.lit(not params.keep_unmatched)
    marked = has(flag, DUPLICATE)
    ignored = F.lit(params.ignore_duplicates) & marked & pair
    reason = (
        F.when(has(flag, SECONDARY | SUPPLEMENTARY), "secondary")
        .when(has(flag, UNMAPPED), "unmapped")
        .when(pair & has(flag, MATE_UNMAPPED), "mate_unmapped")
        .when(has(flag, QC_FAIL), "qc_flags")
        .when(marked & ~ignored, "duplicate")
        .when(pair & ~has(flag, PROPER) & ~ignored, "not_correctly_aligned")
        .when(F.col("mapq") < params.min_mapq, "mapq")
    )
    if mate_contig is not None:
        reason = reason.when(pair & (mate_contig != F.col("contig")), "mate_other_contig")
    reason = reason.when(pair & (F.abs("isize") > params.max_template), "insert_size")
    if pos is not None and mate_pos is not None:
        reverse = has(flag, REVERSE)
        reason = reason.when(pair & ((reverse & (pos < mate_pos)) | (~reverse & (pos > mate_pos))), "orientation")
    return reason.otherwise("passed")


def read_filter_counts(reads: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Reads and bases of each reason. Mates' places are tested where ``reads`` has them (mate_contig,
    pos, mate_pos); a read's bases are its l_qseq or the length of its seq."""
    of = lambda name: F.col(name) if name in reads.columns else None
    reason = filter_reason(params, of("mate_contig"), of("pos"), of("mate_pos"))
    size = F.col("l_qseq") if "l_qseq" in reads.columns else F.length("seq")
    return reads.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("reads"), F.sum(size).cast("long").alias("bases"))


#: Boolean columns that say why a base is left out, and the reasons; clips and overlaps are cut off
#: before trims are counted.
BASE_MARKS = ("clipped", "overlap", "trimmed")


def base_reason(params: CallParams = CallParams(), columns: Iterable[str] = ()) -> Column:
    """Why a base is left out: clipped, overlap, trimmed, low_qual, or ``passed``. The first three come
    from boolean columns of those names where ``columns`` has them."""
    reason = F
    for mark in BASE_MARKS:
        if mark in columns:
            reason = reason.when(F.col(mark), mark)
    return reason.when(F.col("qual") < params.min_qual, "low_qual").otherwise("passed")


def base_filter_counts(bases: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Bases of each reason."""
    return bases.groupBy(base_reason(params, bases.columns).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def passing_bases(bases: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Bases of reads of enough mapping quality that themselves are good enough."""
    kept = bases.filter((F.col("mapq") >= params.min_mapq) & (F.col("qual") >= params.min_qual))
    for mark in BASE_MARKS:
        if mark in bases.columns:
            kept = kept.filter(~F.col(mark))
    return kept
