"""Quality-control report: every table is one small aggregation over called sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def _all_passed(condition=None, name: str = "") -> list:
    """Columns counting sites, all and passed, that meet a condition."""
    condition = F.lit(True) if condition is None else condition
    return [F.count_if(condition).alias(f"{name}all"), F.count_if(condition & (F.col("flt") == 0)).alias(f"{name}passed")]


def is_snp():
    return (F.col("alt") != "") & ~F.contains("alt", F.lit(","))


def is_multi():
    return F.contains("alt", F.lit(","))


def variant_totals(sites: DataFrame) -> DataFrame:
    """SNP and multiallelic sites, all and passed."""
    return sites.agg(*_all_passed(is_snp(), "snps_"), *_all_passed(is_multi(), "multi_"))


def snp_totals(sites: DataFrame) -> DataFrame:
    """Sites of known SNPs, and those of them that vary here (sites have rs_found)."""
    known = F.col("rs_found") > 0
    return sites.agg(*_all_passed(known, "sites_"), *_all_passed(known & (F.col("alt") != ""), "variants_"))


def mutations(sites: DataFrame) -> DataFrame:
    """The twelve mutations, all and passed, at all sites and at known SNPs."""
    known = F.col("rs_found") > 0
    return sites.filter("mut is not null").groupBy("mut").agg(*_all_passed(), *_all_passed(known, "known_"))


def contig_totals(sites: DataFrame) -> DataFrame:
    """SNPs, multiallelic and known sites of each contig, and of all together (contig null), in one pass."""
    known = F.col("rs_found") > 0
    return sites.rollup("contig").agg(*_all_passed(is_snp(), "snps_"), *_all_passed(is_multi(), "multi_"), *_all_passed(known, "known_"))


def quality_histogram(sites: DataFrame) -> DataFrame:
    """phred, category and n: all sites, variants, and CpGs that the reference has or has not."""
    cpg = (F.col("cg") == "CG") & F.col("cs").isin("+", "-")
    kinds = F.array_compact(F.array(F.lit("all"), F.when(F.col("alt") != "", "variant"), F.when(cpg & F.col("ref_cpg"), "ref_cpg"), F.when(cpg & ~F.col("ref_cpg"), "nonref_cpg")))
    return sites.select("phred", F.explode(kinds).alias("category")).groupBy("phred", "category").agg(F.count(F.lit(1)).alias("n"))


def qc_histograms(sites: DataFrame) -> DataFrame:
    """stat (qd, fs, mq), value, is_het and n."""
    pairs = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("int").alias("value")) for s in ("qd", "fs", "mq")])
    return sites.select("is_het", F.explode(pairs).alias("p")).groupBy("p.stat", "p.value", "is_het").agg(F.count(F.lit(1)).alias("n"))


def filter_matrix(sites: DataFrame) -> DataFrame:
    """Combinations of the four site filters, by zygosity."""
    return sites.groupBy(F.col("flt").bitwiseAND(F.lit(31)).alias("filters")).pivot("is_het", [False, True]).count().select("filters", F.coalesce(F.col("false"), F.lit(0)).cast("long").alias("hom"), F.coalesce(F.col("true"), F.lit(0)).cast("long").alias("het"))


def coverage(sites: DataFrame) -> DataFrame:
    """depth with counts of all sites, variants and CpGs of that depth, and of CpGs whose
    informative depth it is."""
    cpg = (F.col("cg") == "CG") & F.col("cs").isin("+", "-")
    row = lambda depth, every, inf: F.struct(F.col(depth).alias("depth"), F.lit(every).alias("own"), F.lit(inf).alias("inf"))
    rows = sites.select("alt", "ref_cpg", cpg.alias("cpg"), F.explode(F.array(row("dp", True, False), row("d_inf", False, True))).alias("r"))
    own, inf = F.col("r.own"), F.col("r.inf") & F.col("cpg")
    out = rows.filter(own | inf).groupBy("r.depth").agg(
        F.count_if(own).alias("all"), F.count_if(own & (F.col("alt") != "")).alias("var"),
        F.count_if(own & F.col("cpg") & F.col("ref_cpg")).alias("cpg_ref"), F.count_if(own & F.col("cpg") & ~F.col("ref_cpg")).alias("cpg_nonref"),
        F.count_if(inf & F.col("ref_cpg")).alias("cpg_ref_inf"), F.count_if(inf & ~F.col("ref_cpg")).alias("cpg_nonref_inf"),
    )
    return out


def with_gc_bin(sites: DataFrame, bins: DataFrame, width: int = 100) -> DataFrame:
    """Sites with the number and the GC content of the bin they lie in."""
    firsts = bins.groupBy("contig").agg(F.min("first").alias("_first"))
    rows = sites.join(firsts, "contig").withColumn("bin", F.floor((F.col("pos") - F.col("_first")) / width).cast("int")).drop("_first")
    return rows.join(bins.select("contig", "bin", "gc"), ["contig", "bin"])


def coverage_by_gc(sites: DataFrame, bins: DataFrame, width: int = 100) -> DataFrame:
    """dp, gc and n over sites in usable GC bins (bins: contig, bin, first and gc of
    :func:`contigs.gc_bins`); bins count from each contig's first known base."""
    return with_gc_bin(sites, bins, width).filter("gc <= 100").groupBy("dp", "gc").agg(F.count(F.lit(1)).alias("n"))


def methylation_posterior(sites: DataFrame) -> DataFrame:
    """ref_cpg, bin (0..100) and the summed posterior of methylation bin / 100, all and passed, over
    CpGs with informative bases. Sites of equal counts are added up before the grid is laid out."""
    plus = F.col("cs") == "+"
    rows = sites.filter((F.col("cg") == "CG") & F.col("cs").isin("+", "-"))
    rows = rows.select("ref_cpg", "flt", F.when(plus, F.col("c5")).otherwise(F.col("c6")).alias("a"), F.when(plus, F.col("c7")).otherwise(F.col("c4")).alias("b")).filter("a + b > 0")
    rows = rows.groupBy("ref_cpg", "a", "b").agg(*_all_passed())
    # the largest weight is at m = a / (a + b); less its logarithm, none overflows
    grid = rows.selectExpr("*", "explode(sequence(0, 100)) AS bin", "if(a > 0, a * ln(a / (a + b)), 0D) + if(b > 0, b * ln(b / (a + b)), 0D) AS top")
    side = lambda n, share, end: f"CASE WHEN {n} = 0 THEN 0D WHEN bin = {end} THEN -1e300D ELSE {n} * ln({share}) END"
    grid = grid.selectExpr("ref_cpg", "a", "b", "`all`", "passed", "bin", f"exp({side('a', 'bin / 100D', 0)} + {side('b', '1 - bin / 100D', 100)} - top) AS x")
    total = grid.groupBy("ref_cpg", "a", "b").agg(F.sum("x").alias("total"))
    shares = grid.join(total, ["ref_cpg", "a", "b"])
    return shares.groupBy("ref_cpg", "bin").agg(F.sum(F.expr("x / total * `all`")).alias("weight_all"), F.sum(F.expr("x / total * passed")).alias("weight_passed"))
