"""Command-line options of a calling run, as settings and paths."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from .params import MAX_TEMPLATE, MIN_BASE_QUAL, MIN_MAPQ, CallParams
from .sources.outputs import output_kind


@dataclass(frozen=True)
class Run:
    """What to call, from where, and where to."""

    params: CallParams
    alignments: str | None
    reference: str
    output: str | None
    kind: str
    sample: str
    regions: str | None
    sizes: str | None
    snps: str | None
    report: str | None


def pair(text: str) -> tuple[int, int]:
    """``3`` or ``3,5``: one number for both mates or one for each."""
    parts = [int(x) for x in text.split(",")]
    if len(parts) > 2 or min(parts) < 0:
        raise argparse.ArgumentTypeError(f"not one or two numbers: {text}")
    return parts[0], parts[-1]


def rates(text: str) -> tuple[float, float]:
    """Under- and over-conversion; what is no rate falls back to the default."""
    parts = text.split(",")
    if len(parts) != 2:
        raise argparse.ArgumentTypeError("two rates with a comma between them are needed")
    usual = (CallParams.under_conversion, CallParams.over_conversion)
    under, over = (float(x) if 0 <= float(x) < 1 else d for x, d in zip(parts, usual))
    return under, over


def parser() -> argparse.ArgumentParser:
    """Options by their usual letters; those without effect (haploid, blank trim, verbose, threads) are
    accepted, since Spark deals out the work."""
    p = argparse.ArgumentParser(prog="methyloom", description="Genotypes and methylation from bisulfite reads")
    flags = {"-1 --haploid": "", "-d --keep-duplicates": "", "--ignore-duplicates": "", "-k --keep-unmatched": "", "-B --blank-trim": "", "-A --all-positions": "", "--benchmark-mode": "", "-v --verbose": ""}
    for names in flags:
        p.add_argument(*names.split(), action="store_true")
    p.add_argument("-R", "--right-trim", type=pair, default=(0, 0))
    p.add_argument("-L", "--left-trim", type=pair, default=(0, 0))
    p.add_argument("-q", "--mapq-threshold", type=int, default=MIN_MAPQ)
    p.add_argument("-Q", "--bq-threshold", type=int, default=MIN_BASE_QUAL)
    p.add_argument("-l", "--max-template-length", type=int, default=MAX_TEMPLATE)
    p.add_argument("-c", "--conversion", type=rates, default=(CallParams.under_conversion, CallParams.over_conversion))
    p.add_argument("--reference-bias", type=float, default=CallParams.reference_bias)
    p.add_argument("-O", "--output-type", choices=["b", "u", "z", "v"])
    p.add_argument("-t", "--threads")
    for names in ("-o --output", "--report-file", "-n --sample", "-C --contig-bed", "-s --contig-sizes", "-D --dbsnp"):
        p.add_argument(*names.split())
    p.add_argument("-r", "--reference", required=True)
    p.add_argument("alignments", nargs="?")
    return p


def parse_options(argv: list[str]) -> Run:
    """Settings of a run; binary output types raise a ValueError, as they have no writer."""
    a = parser().parse_args(argv)
    params = CallParams(
        min_mapq=a.mapq_threshold, min_qual=a.bq_threshold, max_template=a.max_template_length, left_trim=a.left_trim, right_trim=a.right_trim,
        keep_unmatched=a.keep_unmatched, keep_duplicates=a.keep_duplicates, ignore_duplicates=a.ignore_duplicates, all_positions=a.all_positions,
        benchmark_mode=a.benchmark_mode, under_conversion=a.conversion[0], over_conversion=a.conversion[1], reference_bias=a.reference_bias,
    )
    return Run(params, a.alignments, a.reference, a.output, output_kind(a.output or "", a.output_type), a.sample or "SAMPLE", a.contig_bed, a.contig_sizes, a.dbsnp, a.report_file)
