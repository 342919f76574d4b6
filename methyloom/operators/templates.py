"""Templates: mate pairing, duplicate removal and segmentation into blocks of overlapping reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STRETCH = 1 << 16  # positions handled by one window partition


def pair_mates(reads: DataFrame, keys: list[str] = ["contig", "qname"], block: bool = False) -> DataFrame:  # noqa: B006
    """One row for each template: struct columns fwd and rev (null where that mate is missing), n_fwd
    and n_rev. A template with several reads of one side keeps the leftmost. One aggregation instead
    of a self-join; with ``block`` mates must lie in the same block."""
    by = [*keys, "block"] if block else keys
    columns = [c for c in reads.columns if c not in by]
    row = F.struct("st", *[c for c in columns if c != "st"])
    side = lambda reverse: F.col("is_reverse") == reverse
    return reads.groupBy(*by).agg(
        F.min(F.when(side(0), row)).alias("fwd"),
        F.min(F.when(side(1), row)).alias("rev"),
        F.count_if(side(0)).alias("n_fwd"),
        F.count_if(side(1)).alias("n_rev"),
    )


def out_of_order(reads: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Reads that begin before one read earlier (by ord) on their contig. Running values go over
    stretches of ord."""
    rows = reads.withColumn("_stretch", F.floor(F.col("ord") / stretch))
    rows, before = carried(rows, F.col("pos"), F.max, F.max)
    own = W.partitionBy("contig", "_stretch").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_newest", F.greatest(before, F.max("pos").over(own)))
    return rows.filter("pos < _newest").drop("_stretch", "_before", "_newest")


def unmatched(reads: DataFrame) -> DataFrame:
    """Reads without a mate of the other direction under the same name and contig."""
    mates = reads.select("contig", "qname", (1 - F.col("is_reverse")).alias("is_reverse")).distinct()
    return reads.join(mates, ["contig", "qname", "is_reverse"], "left_anti")


def equal_starts(reads: DataFrame) -> DataFrame:
    """Reads whose mate of the other direction starts at the same place."""
    mates = reads.select("contig", "qname", "st", (1 - F.col("is_reverse")).alias("is_reverse")).distinct()
    return reads.join(mates, ["contig", "qname", "st", "is_reverse"], "left_semi")


def best_of_duplicates(templates: DataFrame, keys: list[str], best: list[str]) -> DataFrame:
    """One row for each key: the row of the largest ``best`` columns in turn, and n_dup, all rows of the
    key. An aggregation by maximum, so copies meet as partial maxima rather than in one task."""
    rest = [c for c in templates.columns if c not in keys and c not in best]
    top = F.max(F.struct(*best, *rest)).alias("_best")
    return templates.groupBy(*keys).agg(top, F.count(F.lit(1)).alias("n_dup")).select(*keys, "_best.*", "n_dup")


def carried(rows: DataFrame, value: Column, start, join, by: str = "contig") -> tuple[DataFrame, Column]:
    """What all stretches (column _stretch) before a row's own add up to, by a small table of one row
    a stretch."""
    per = rows.groupBy(by, "_stretch").agg(start(value).alias("_all"))
    before = W.partitionBy(by).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(per.select(by, "_stretch", join("_all").over(before).alias("_before")), [by, "_stretch"], "left"), F.col("_before")


def blocks(reads: DataFrame, gap: int = 1, stretch: int = STRETCH) -> DataFrame:
    """Add block (from 1 in each contig): a read begins one if it starts more than ``gap`` past the
    end (exclusive) of all reads before it. Running values go over stretches of positions, and what
    earlier stretches amount to is carried in by a table of stretches."""
    order = ["st", "en", *[c for c in ("qname", "mapq", "flag", "isize", "bs_strand") if c in reads.columns]]
    rows = reads.withColumn("_stretch", F.floor(F.col("st") / stretch))
    own = W.partitionBy("contig", "_stretch").orderBy(*order)
    rows, before = carried(rows, F.col("en"), F.max, F.max)
    reach = F.greatest(before, F.max("en").over(own.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_opens", F.when(reach.isNull() | (F.col("st") > reach + gap), 1).otherwise(0)).drop("_before")
    rows, before = carried(rows, F.col("_opens"), F.sum, F.sum)
    number = F.coalesce(before, F.lit(0)) + F.sum("_opens").over(own.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("block", number.cast("long")).drop("_stretch", "_opens", "_before")


def block_extents(reads: DataFrame) -> DataFrame:
    """contig, block, x, y (exclusive) and n of every block."""
    return blocks(reads).groupBy("contig", "block").agg(F.min("st").alias("x"), F.max("en").alias("y"), F.count(F.lit(1)).alias("n"))
