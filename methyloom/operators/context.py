"""Neighbouring positions: sequence context, CpG status and CpG pairs.

Windows are partitioned by contig and a bucket of ``BUCKET`` positions; rows near a bucket's edge are
copied to the bucket beside it and dropped again, so no task holds a whole contig.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bases import GENOTYPES, IUPAC, base_letter, cytosine_strand, letters

BUCKET = 1 << 16


def with_neighbours(rows: DataFrame, columns: list[str], reach: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Add ``{column}_{m|p}{i}``: values at pos - i and pos + i, null where no row has that position.
    Positions are unique within a contig."""
    own = F.floor(F.col("pos") / bucket)
    spread = F.array_distinct(F.array(own, F.floor((F.col("pos") - reach) / bucket), F.floor((F.col("pos") + reach) / bucket)))
    wide = rows.withColumn("_own", own).withColumn("_bucket", F.explode(spread))
    order = W.partitionBy("contig", "_bucket").orderBy("pos")
    added = {}
    for i in range(1, reach + 1):
        # the neighbour at distance i is at most i rows away
        for sign, name in ((-1, "m"), (1, "p")):
            step = F.lag if sign < 0 else F.lead
            for c in columns:
                value = F.lit(None)
                for k in range(1, i + 1):
                    value = F.when(step("pos", k).over(order) == F.col("pos") + sign * i, step(c, k).over(order)).otherwise(value)
                added[f"{c}_{name}{i}"] = value
    return wide.withColumns(added).filter("_bucket = _own").drop("_own", "_bucket")


def five_letters(column: str, letter) -> Column:
    return F.concat(*[letter(F.col(f"{column}{side}")) for side in ("_m2", "_m1", "", "_p1", "_p2")])


def reference_context(ref: DataFrame) -> DataFrame:
    """contig, pos and cx_ref: five reference letters about each position, N where there is none."""
    return with_neighbours(ref, ["ref"]).select("contig", "pos", five_letters("ref", base_letter).alias("cx_ref"))


def called_context(sites: DataFrame) -> DataFrame:
    """contig, pos and cx_call: five letters of called genotypes, N where nothing is called."""
    return with_neighbours(sites.select("contig", "pos", "gt"), ["gt"]).select("contig", "pos", five_letters("gt", lambda g: letters(list(IUPAC), g, "N")).alias("cx_call"))


def cpg_status(gt: Column, before: Column, after: Column) -> Column:
    """CG, H (perhaps), N (no), ? (neighbour not called) or . (neither a C nor a G).

    A genotype with a C looks at the next position, else one with a G at the one before."""
    with_c = [i for i, g in enumerate(GENOTYPES) if "C" in g]
    with_g = [i for i, g in enumerate(GENOTYPES) if "G" in g]
    cc, gg = GENOTYPES.index("CC"), GENOTYPES.index("GG")
    down = F.when(after.isNull(), "?").when(after.isin(*with_g), "H").otherwise("N")
    up = lambda missing: F.when(before.isNull(), missing).when(before.isin(*with_c), "H").otherwise("N")
    return (
        F.when(((gt == cc) & (after == gg)) | ((gt == gg) & (before == cc)), "CG")
        .when(gt == cc, down)
        .when(gt == gg, up("?"))
        .when(gt.isin(*with_c), down)
        .when(gt.isin(*with_g), up("."))
        .otherwise(".")
    )


def with_cpg(sites: DataFrame) -> DataFrame:
    """Add cg, the status, and ref_cpg, whether the reference has a CpG too, from the neighbours'
    genotype and reference; where sites have filters, the neighbours' flt as well."""
    near = with_neighbours(sites, [c for c in ("gt", "ref", "flt") if c in sites.columns], reach=1)
    near = near.withColumn("cg", cpg_status(F.col("gt"), F.col("gt_m1"), F.col("gt_p1")))
    strand = cytosine_strand(F.col("gt"))
    forward = (strand == "+") & (F.col("ref") == 1) & (F.col("ref_p1") == 2)
    backward = (strand == "-") & (F.col("ref_m1") == 1) & (F.col("ref") == 2)
    return near.withColumn("ref_cpg", F.coalesce(forward | backward, F.lit(False)))


def cpg_pairs(sites: DataFrame) -> DataFrame:
    """ref_cpg, all and passed: CpG pairs, counted at their G, by whether the reference has one too."""
    pairs = with_cpg(sites).filter((F.col("cg") == "CG") & (F.col("cs") == "-"))
    return pairs.groupBy("ref_cpg").agg(F.count(F.lit(1)).alias("all"), F.count_if((F.col("flt") == 0) & (F.col("flt_m1") == 0)).alias("passed"))


def non_cpg(ref: Column, before: Column, after: Column) -> Column:
    """A reference C not before a G, or a reference G not after a C, neighbours being known."""
    return F.coalesce(((ref == 1) & after.isNotNull() & (after != 2)) | ((ref == 2) & before.isNotNull() & (before != 1)), F.lit(False))


def conversion_profile(bases: DataFrame, ref: DataFrame, position: Column) -> DataFrame:
    """position and a, b, c, d: bases on non-CpG sites that stayed or turned on their informative
    strand, and the same of all other strands. Bases of quality 20 to 62."""
    near = with_neighbours(ref, ["ref"], reach=1)
    sites = near.filter(non_cpg(F.col("ref"), F.col("ref_m1"), F.col("ref_p1"))).select("contig", "pos")
    rows = bases.filter((F.col("qual") >= 20) & (F.col("qual") < 63)).join(sites, ["contig", "pos"], "left_semi")
    strand, base = F.col("bs_strand"), F.col("base")
    stay = ((strand == 1) & (base == 1)) | ((strand == 2) & (base == 2))
    turn = ((strand == 1) & (base == 3)) | ((strand == 2) & (base == 0))
    rest = ~stay & ~turn
    out = rows.groupBy(position.alias("position"))
    return out.agg(F.count_if(stay).alias("a"), F.count_if(turn).alias("b"), F.count_if(rest & base.isin(1, 2)).alias("c"), F.count_if(rest & base.isin(0, 3)).alias("d"))
