"""Sinks: VCF text, site tables and the JSON report."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import base_letter
from ..operators import context, model, report

# fixed values: names, numbers and types of the fields, as readers of the format know them
FILTERS = {"PASS": "passes every filter", "fail": "the sample's call fails", "q20": "genotype quality less than 20", "qd2": "quality by depth less than 2", "fs60": "strand bias of more than 60", "mq40": "mapping quality less than 40", "mac1": "one base or none of the rarer allele"}
FORMATS = {
    "GT": ("1", "String", "called genotype"),
    "FT": ("1", "String", "filters that the call fails"),
    "DP": ("1", "Integer", "bases that are not informative of methylation"),
    "MQ": ("1", "Integer", "root mean square of mapping qualities"),
    "GQ": ("1", "Integer", "Phred value of the genotype"),
    "QD": ("1", "Integer", "Phred value by depth"),
    "GL": ("G", "Float", "log10 likelihoods of genotypes"),
    "MC8": ("8", "Integer", "bases of the eight channels"),
    "AMQ": (".", "Integer", "mean base qualities of channels that have bases"),
    "CS": ("1", "String", "strand of the cytosine"),
    "CG": ("1", "String", "whether the call is part of a CpG"),
    "CX": ("1", "String", "five called letters about the site"),
    "FS": ("1", "Integer", "Phred value of strand bias"),
}


def output_kind(path: str, asked: str | None = None) -> str:
    """What to write: ``vcf``, ``vcf.gz`` or ``parquet``, as asked for or by the name's ending. Binary
    forms of VCF have no writer here and raise a ValueError."""
    kinds = {"v": "vcf", "z": "vcf.gz", "vcf": "vcf", "vcf.gz": "vcf.gz", "parquet": "parquet"}
    found = asked or next((k for k in ("vcf.gz", "vcf", "parquet", "bcf") if path.endswith(f".{k}")), "vcf")
    if found not in kinds:
        raise ValueError(f"no writer for output of type {found}")
    return kinds[found]


def vcf_lines(sites: DataFrame) -> DataFrame:
    """contig, pos and line of sites with cx_ref, cx_call, cg, id and all that calling adds."""
    rows = model.mean_quality_list(model.gl_list(sites))
    number = lambda c: F.col(c).cast("string")
    several = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    gl = F.array_join(F.transform("gl_vcf", lambda x: F.format_string("%.3f", x)), ",")
    sample = F.concat_ws(":", "call", "ft", number("dp1"), number("mq"), number("phred"), number("qd"), gl, several("mc8"), several("amq"), "cs", "cg", "cx_call", number("fs"))
    alt = F.when(F.col("alt") == "", ".").otherwise(F.col("alt"))
    line = F.concat_ws("\t", "contig", number("pos"), "id", base_letter(F.col("ref")), alt, number("phred"), "filter", F.concat(F.lit("CX="), "cx_ref"), F.lit(":".join(FORMATS)), sample)
    return rows.select("contig", "pos", line.alias("line"))


def vcf_header(contigs: list[tuple], sample: str, source: str = "methyloom", benchmark: bool = False, groups: list[tuple] = (), snps: str | None = None) -> list[str]:
    """Header lines. ``contigs``: (name, length) and perhaps assembly, md5 and species; ``groups``: (bc,
    sm, ds) of read groups, one of each barcode; ``snps``: a description of the SNP index. With
    ``benchmark`` date, source, groups and SNPs are left out, so that outputs can be compared."""
    lines = ["##fileformat=VCFv4.2"]
    if not benchmark:
        lines += [f"##fileDate={datetime.date.today():%Y%m%d}", f"##source={source}"]
        lines += [f"##dbsnp=<{snps}>"] * (snps is not None)
        once = {bc: (sm, ds) for bc, sm, ds in reversed(list(groups)) if bc is not None}
        for bc in dict.fromkeys(bc for bc, _, _ in groups if bc is not None):
            more = "".join(f',{k}="{v}"' for k, v in zip(("SM", "DS"), once[bc]) if v is not None)
            lines.append(f'##sample_info=<ID="{bc}"{more}>')
    for name, length, *more in contigs:
        lines.append(f"##contig=<ID={name},length={length}" + "".join(f",{k}={v}" for k, v in zip(("assembly", "md5", "sp"), more) if v is not None) + ">")
    lines += ['##INFO=<ID=CX,Number=1,Type=String,Description="five reference letters about the site">']
    lines += [f'##FILTER=<ID={name},Description="{text}">' for name, text in FILTERS.items()]
    lines += [f'##FORMAT=<ID={name},Number={number},Type={kind},Description="{text}">' for name, (number, kind, text) in FORMATS.items()]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def write_vcf(sites: DataFrame, path: str, header: list[str]) -> None:
    """Lines in order of contig and position, range by range, below ``path/body``; the header goes to
    ``path/header`` by its own writer, since parts are written in parallel. Both are gzipped if ``path``
    ends in .vcf.gz."""
    spark = sites.sparkSession
    packed = {"compression": "gzip"} if output_kind(path) == "vcf.gz" else {}
    vcf_lines(sites).repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos").select("line").write.mode("overwrite").text(f"{path}/body", **packed)
    spark.createDataFrame([(x,) for x in header], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/header", **packed)


def write_sites(sites: DataFrame, path: str) -> None:
    """Sites as Parquet by contig, sorted by position; tasks write ranges, several to a large contig."""
    sites.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos").write.mode("overwrite").partitionBy("contig").parquet(path)


def json_report(sites: DataFrame, read_counts: DataFrame | None = None, date: str | None = None, base_counts: DataFrame | None = None, profile: DataFrame | None = None, gc: DataFrame | None = None) -> str:
    """The report over written sites (with cg, ref_cpg, rs_found), each part a small aggregate. Counts of
    reads and bases by reason, the conversion profile and GC bins (contig, bin, first, gc) add their
    parts where given."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    totals = {
        "SNPS": rows(report.variant_totals(sites))[0],
        "dbSNP": rows(report.snp_totals(sites))[0],
        "CpG": rows(context.cpg_pairs(sites)),
        "QCDistributions": rows(report.qc_histograms(sites)),
        "VCFFilterStats": rows(report.filter_matrix(sites)),
        "coverage": rows(report.coverage(sites).orderBy("depth")),
        "quality": rows(report.quality_histogram(sites)),
        "mutations": rows(report.mutations(sites)),
        "methylation": rows(report.methylation_posterior(sites)),
    }
    if gc is not None:
        totals["coverageGC"] = rows(report.coverage_by_gc(sites, gc))
    if profile is not None:
        totals["NonCpGreadProfile"] = rows(profile.orderBy("position"))
    tree = {"source": "methyloom", "date": date or f"{datetime.datetime.now():%Y-%m-%d}", "totalStats": totals, "contigStats": rows(report.contig_totals(sites))}
    levels = {"ReadLevel": read_counts, "BaseLevel": base_counts}
    if any(x is not None for x in levels.values()):
        tree["filterStats"] = {name: rows(x) for name, x in levels.items() if x is not None}
    return json.dumps(tree, sort_keys=True)
