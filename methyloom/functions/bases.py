"""Bases, genotypes and channels as column expressions, generated from their rules.

Bases are codes 0..3 for A, C, G, T (null: N). Genotypes are the ten unordered pairs in order of
their letters. Strands: 0 none, 1 C to T, 2 G to A.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"
GENOTYPES = ["".join(pair) for pair in combinations_with_replacement(BASES, 2)]
HET = [g[0] != g[1] for g in GENOTYPES]
IUPAC = "AMRWCSYGKT"  # fixed values: the code letter of each genotype
CONVERTED = {1: (1, 3), 2: (0, 2)}  # strand -> bases that tell methylation


def letters(values: list[str], index: Column, missing: str | None = None) -> Column:
    """The value of a fixed list at a 0-based index; ``missing`` for null."""
    fixed = F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")
    return F.when(index.isNull(), F.lit(missing)).otherwise(F.get(fixed, index.cast("int")))


def base_letter(code: Column) -> Column:
    return letters(list(BASES), code, "N")


def base_code(letter: Column) -> Column:
    """Code of a letter in either case; null for all but A, C, G and T."""
    return F.nullif(F.instr(F.lit(BASES), F.upper(F.substring(letter, 1, 1))), F.lit(0)) - 1


def channel(base: Column, strand: Column) -> Column:
    """Bases that tell methylation on their strand go to channels 4..7, all others keep 0..3."""
    tells = F.lit(False)
    for number, bases in CONVERTED.items():
        tells = tells | ((strand == number) & base.isin(*bases))
    return (base + F.when(tells, 4).otherwise(0)).cast("int")


def allele_channels(genotype: str) -> tuple[list[int], list[int]]:
    """Channels that count for either allele of a heterozygous genotype. A base read as converted
    counts only if the other allele can't have given it."""
    own = {"A": [0], "C": [1, 5], "G": [2, 6], "T": [3]}
    shared = {"A": (4, "G"), "G": (4, "A"), "C": (7, "T"), "T": (7, "C")}
    found = []
    for mine, other in (genotype, genotype[::-1]):
        extra, rival = shared[mine]
        found.append(sorted(own[mine] + ([extra] if other != rival else [])))
    return found[0], found[1]


def alt_alleles(gt: Column, ref: Column) -> Column:
    """Alleles of the genotype other than the reference, in order, as one string; both for N."""
    first, second = letters([g[0] for g in GENOTYPES], gt), letters([g[1] for g in GENOTYPES], gt)
    pair = F.when(first == second, F.array(first)).otherwise(F.array(first, second))
    return F.array_join(F.array_except(pair, F.array(base_letter(ref))), ",")


def mutation(gt: Column, ref: Column) -> Column:
    """``R>A`` where exactly one allele differs from a known reference, else null."""
    alt = alt_alleles(gt, ref)
    return F.when(ref.isNotNull() & (F.length(alt) == 1), F.concat(base_letter(ref), F.lit(">"), alt))


def gt_call(gt: Column, ref: Column) -> Column:
    """0/0, 0/1, 1/1 or 1/2 as in VCF."""
    het = letters([str(int(h)) for h in HET], gt) == "1"
    has_ref = F.contains(letters(GENOTYPES, gt), base_letter(ref))
    return F.when(has_ref & ~het, "0/0").when(has_ref, "0/1").when(het, "1/2").otherwise("1/1")


def cytosine_strand(gt: Column) -> Column:
    """``+`` with a C, ``-`` with a G, ``+-`` with both, else NA."""
    return letters([("+" * ("C" in g) + "-" * ("G" in g)) or "NA" for g in GENOTYPES], gt)
