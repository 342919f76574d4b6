"""Diploid genotype likelihoods of bisulfite-converted reads, as generated column expressions.

With k of a channel's mean quality, a base has likelihood 1 + k from a homozygous genotype of its own
allele, 1/2 + k from a heterozygous one, k from others. Channels that tell methylation replace
the share of their allele by the conversion at its most likely methylation (``mle``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import GENOTYPES, HET, IUPAC, allele_channels, alt_alleles, cytosine_strand, gt_call, letters, mutation
from ..functions.stats import error_k_sql, fisher, phred, phred_round
from ..params import CallParams
from .pileup import CHANNELS, pileup, with_quality


def mle(n1: str, n2: str, k1: str, k2: str, params: CallParams) -> list[str]:
    """Most likely unconverted share of an informative allele alone, beside the allele that
    conversion makes, and beside another one. Null without informative bases."""
    left, turned = 1 - params.under_conversion, params.over_conversion
    s, d = left + turned, left - turned
    out = []
    for num in (
        f"{n1} * ({s}D + 2 * {k2}) - {n2} * (2 - {s}D + 2 * {k1})",
        f"{n1} * (2 + {s}D + 4 * {k2}) - {n2} * (2 - {s}D + 4 * {k1})",
        f"{n1} * ({s}D + 4 * {k2}) - {n2} * (2 - {s}D + 4 * {k1})",
    ):
        sine = f"greatest(-1D, least(1D, ({num}) / (({n1} + {n2}) * {d}D)))"
        out.append(f"CASE WHEN {n1} + {n2} > 0 THEN 0.5D * ({d}D * {sine} + 2 - {s}D) END")
    return out


def with_mle(sites: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Add k{0..7} and z0..z5: shares at C (channels 5 and 7), then at G (6 and 4)."""
    sites = sites.selectExpr("*", *[f"{error_k_sql(f'm{c}')} AS k{c}" for c in CHANNELS])
    z = mle("c5", "c7", "k5", "k7", params) + mle("c6", "c4", "k6", "k4", params)
    return sites.selectExpr("*", *[f"{x} AS z{i}" for i, x in enumerate(z)])


def likelihood(ch: int, genotype: str) -> str:
    """SQL of the likelihood of one base of a channel given a genotype."""
    k = f"k{ch}"
    own = "ACGT"[ch % 4]
    share = f"{genotype.count(own) / 2}D"
    if ch < 4:
        return f"{share} + {k}"
    z = [f"z{i}" for i in ((0, 1, 2) if ch in (5, 7) else (3, 4, 5))]
    kept = ch in (5, 6)  # an unconverted C or G; else what conversion has made of one
    source, made = ("C", "T") if ch in (5, 7) else ("G", "A")
    if source not in genotype:
        return k if kept else f"{share} + {k}"
    if genotype == source * 2:
        return f"{z[0]} + {k}" if kept else f"1 - {z[0]} + {k}"
    if made in genotype:
        return f"0.5D * {z[1]} + {k}" if kept else f"1 - 0.5D * {z[1]} + {k}"
    return f"0.5D * {z[2]} + {k}" if kept else f"0.5D * (1 - {z[2]}) + {k}"


def prior(genotype: str, bias: float) -> str:
    same = [str(i) for i, b in enumerate("ACGT") if b in genotype]
    gain = math.log(bias) if len(same) == 1 else math.log(0.5 * (1 + bias))
    return f"CASE WHEN ref IN ({', '.join(same)}) THEN {gain!r}D ELSE 0D END"


def with_genotypes(sites: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """Add gl0..gl9 (log10 of the normalised likelihoods), gt (the first best) and wrong (the
    probability of all others). A channel's logarithms are taken once for all genotypes alike."""
    wanted = {(c, likelihood(c, g)) for c in CHANNELS for g in GENOTYPES}
    names = {x: f"_l{i}" for i, x in enumerate(sorted(wanted))}
    logs = [f"CASE WHEN c{c} > 0 THEN c{c} * ln({text}) ELSE 0D END AS {name}" for (c, text), name in names.items()]
    totals = [" + ".join([prior(g, params.reference_bias), *[names[c, likelihood(c, g)] for c in CHANNELS]]) for g in GENOTYPES]
    kept = sites.columns
    sites = sites.selectExpr("*", *logs).selectExpr(*kept, *[f"{x} AS _g{g}" for g, x in enumerate(totals)])
    every = [f"_g{g}" for g in range(10)]
    sites = sites.selectExpr("*", f"greatest({', '.join(every)}) AS _top")
    first = "CASE " + " ".join(f"WHEN {x} = _top THEN {g}" for g, x in enumerate(every)) + " END"
    sites = sites.selectExpr("*", f"{first} AS gt", " + ".join(f"exp({x} - _top)" for x in every) + " AS _sum")
    gl = [f"({x} - _top - ln(_sum)) / {math.log(10)!r}D AS gl{g}" for g, x in enumerate(every)]
    others = " + ".join(f"if(gt = {g}, 0D, exp({x} - _top))" for g, x in enumerate(every))
    return sites.selectExpr(*kept, "gt", *gl, f"({others}) / _sum AS wrong")


def strand_table(cell: int) -> str:
    """SQL of a cell of the 2x2 table (orientation by allele) of the called heterozygous genotype."""
    strand, allele = divmod(cell, 2)
    cases = [f"WHEN {g} THEN " + " + ".join(f"s{strand}c{c}" for c in allele_channels(genotype)[allele]) for g, genotype in enumerate(GENOTYPES) if HET[g]]
    return f"CASE gt {' '.join(cases)} ELSE 0L END"


def with_strand_bias(sites: DataFrame) -> DataFrame:
    """Add fp (Fisher's probability, 1 where homozygous) and fs (its rounded Phred value)."""
    sites = sites.selectExpr("*", *[f"{strand_table(i)} AS _t{i}" for i in range(4)])
    sites = sites.withColumn("fp", fisher("_t0", "_t1", "_t2", "_t3"))
    return sites.withColumn("fs", phred_round(F.col("fp"))).drop("_t0", "_t1", "_t2", "_t3")


def with_phred(sites: DataFrame) -> DataFrame:
    """Add phred, of the genotype's error probability, and qd, phred by depth."""
    sites = sites.withColumn("phred", phred(F.col("wrong")))
    return sites.selectExpr("*", "cast(if(dp1 > 0, floor(phred / dp1), phred) as int) AS qd")


def with_filters(sites: DataFrame) -> DataFrame:
    """Add phred, qd, flt (1 q20, 2 qd2, 4 fs60, 8 mq40, 128 mac1), filter and ft."""
    sites = with_phred(sites)
    tests = {"q20": (1, "phred < 20"), "qd2": (2, "qd < 2"), "fs60": (4, "fs > 60"), "mq40": (8, "mq < 40")}
    flt = " + ".join(f"if({test}, {bit}, 0)" for bit, test in tests.values())
    few = [f"(gt = {g} AND ({' + '.join(f'c{c}' for c in used)}) <= 1)" for g, genotype in enumerate(GENOTYPES) if HET[g] for used in allele_channels(genotype)]
    sites = sites.selectExpr("*", f"{flt} AS _f4").selectExpr("*", f"if(_f4 = 0 AND ({' OR '.join(few)}), 128, _f4) AS flt").drop("_f4")
    names = ", ".join(f"if(flt & {bit} <> 0, '{name}', null)" for name, (bit, _) in tests.items())
    kind = "CASE flt WHEN 0 THEN 'PASS' WHEN 128 THEN 'mac1' ELSE 'fail' END"
    return sites.selectExpr("*", f"{kind} AS filter", f"if(flt IN (0, 128), 'PASS', concat_ws(';', {names})) AS ft")


def with_alleles(sites: DataFrame) -> DataFrame:
    """Add alt, call, mut, cs, is_het and iupac of the called genotype."""
    gt, ref = F.col("gt"), F.col("ref")
    return sites.withColumns({"alt": alt_alleles(gt, ref), "call": gt_call(gt, ref), "mut": mutation(gt, ref), "cs": cytosine_strand(gt), "is_het": letters([str(int(h)) for h in HET], gt) == "1", "iupac": letters(list(IUPAC), gt)})


def gl_list(sites: DataFrame) -> DataFrame:
    """Add gl_vcf: log10 likelihoods over REF and ALTs in VCF's order (all genotypes of the alleles
    present), not below -99.999."""
    ref, alt = F.instr(F.lit("ACGT"), letters(list("ACGT"), F.col("ref"), "N")), F.col("alt")
    first, second = F.instr(F.lit("ACGT"), F.substring(alt, 1, 1)), F.instr(F.lit("ACGT"), F.substring(alt, 3, 1))
    gls = F.array(*[F.greatest(F.col(f"gl{g}"), F.lit(-99.999)) for g in range(10)])

    def of(a: Column, b: Column) -> Column:
        i, j = F.least(a, b), F.greatest(a, b)
        return F.when((i > 0) & (j > 0), F.get(gls, (i * (9 - i) / 2 + j - 5).cast("int")))

    one = F.array(of(ref, ref))
    two = F.concat(one, F.array(of(ref, first), of(first, first)))
    three = F.concat(two, F.array(of(ref, second), of(first, second), of(second, second)))
    return sites.withColumn("gl_vcf", F.when(alt == "", one).when(F.length(alt) == 1, two).otherwise(three))


def mean_quality_list(sites: DataFrame) -> DataFrame:
    """Add mc8 (all eight counts) and amq (mean qualities of channels that have bases)."""
    counts = F.array(*[F.col(f"c{c}") for c in CHANNELS])
    means = F.filter(F.arrays_zip(counts.alias("n"), F.array(*[F.col(f"m{c}") for c in CHANNELS]).alias("m")), lambda x: x["n"] > 0)
    return sites.withColumns({"mc8": counts, "amq": F.transform(means, lambda x: x["m"])})


def skipped(sites: DataFrame) -> Column:
    """Homozygous A or T like the reference: not written unless all positions are."""
    return ((F.col("gt") == 0) & (F.col("ref") == 0)) | ((F.col("gt") == 9) & (F.col("ref") == 3))


def settled(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, which the optimiser neither merges with projections above nor
    pushes filters through: long expressions below are computed once and not copied into each use."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def genotyped_pileup(piled: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    return settled(with_genotypes(with_mle(with_quality(piled), params), params))


def genotyped_sites(bases: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """From bases to genotypes (gt, gl0..gl9, wrong): one shuffle, the rest is expressions."""
    return genotyped_pileup(pileup(bases, params), params)


def finished_sites(sites: DataFrame) -> DataFrame:
    """Genotyped sites with strand bias, filters and alleles. What drops sites by genotype goes before
    this, so that the test of strand bias is left out for them."""
    return settled(with_alleles(with_filters(with_strand_bias(sites))))


def call_sites(bases: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """From bases to called and filtered sites."""
    return finished_sites(genotyped_sites(bases, params))
