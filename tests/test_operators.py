"""Hand-made cases for what tables cannot feed: CIGARs, trims, overlaps, tags, and the model's rules."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from methyloom.functions import bases as B
from methyloom.functions import stats
from methyloom.operators import alignments, cigar, context, contigs, filters, model, pileup, report, snps, templates
from methyloom.params import CallParams


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def reads(spark, *specs):
    out = [(c["contig"] if "contig" in c else "chr1", c["qname"], c["pos"], c.get("rev", False), c.get("second", False), 60, 1, 0, c["cigar"], c["seq"], [c.get("q", 30)] * len(c["seq"])) for c in specs]
    df = spark.createDataFrame(out, "contig string, qname string, pos long, is_reverse boolean, is_second boolean, mapq int, bs_strand int, ori int, c string, seq string, qual array<int>")
    return df.withColumn("cigar", cigar.parse_cigar(F.col("c"))).drop("c")


def test_channels_follow_strand(spark):
    df = spark.range(12).select((F.col("id") % 4).cast("int").alias("b"), F.floor(F.col("id") / 4).cast("int").alias("s"))
    got = {(r.s, r.b): r.c for r in df.withColumn("c", B.channel(F.col("b"), F.col("s"))).collect()}
    assert [got[0, b] for b in range(4)] == [0, 1, 2, 3]
    assert [got[1, b] for b in range(4)] == [0, 5, 2, 7]
    assert [got[2, b] for b in range(4)] == [4, 1, 6, 3]


def test_allele_channels():
    assert B.allele_channels("AG") == ([0], [2, 6])
    assert B.allele_channels("CT") == ([1, 5], [3])
    assert B.allele_channels("AC") == ([0, 4], [1, 5, 7])
    assert B.allele_channels("GT") == ([2, 4, 6], [3, 7])


def test_cigar_lengths_and_events(spark):
    df = spark.createDataFrame([("5S10M2I3D4M1S",), (None,), ("*",)], "c string").withColumn("cigar", cigar.parse_cigar(F.col("c")))
    got = df.select(cigar.span(F.col("cigar"), cigar.IN_READ).alias("read"), cigar.span(F.col("cigar"), cigar.IN_REF).alias("ref"), cigar.events(F.col("cigar")).alias("e")).collect()
    assert (got[0].read, got[0].ref) == (22, 17)
    assert [(e.op, e.read, e.ref) for e in got[0].e] == [("S", 0, 0), ("M", 5, 0), ("I", 15, 10), ("D", 17, 10), ("M", 17, 13), ("S", 21, 17)]
    assert (got[1].read, got[2].ref) == (0, 0)


def test_aligned_bases_skip_clips_insertions_and_deletions(spark):
    df = reads(spark, {"qname": "a", "pos": 10, "cigar": "2S2M1I1D2M", "seq": "TTACGTA"})
    got = rows(cigar.aligned_bases(df).select("pos", "base", "read_pos"), "pos")
    assert got == [(10, 0, 2), (11, 1, 3), (13, 3, 5), (14, 0, 6)]


def test_trims_mark_bases_by_mate(spark):
    df = reads(spark, {"qname": "a", "pos": 1, "cigar": "4M", "seq": "ACGT"}, {"qname": "b", "pos": 1, "cigar": "4M", "seq": "ACGT", "second": True})
    got = rows(cigar.aligned_bases(df, CallParams(left_trim=(1, 0), right_trim=(0, 2))).filter("trimmed").select("qname", "pos"), "qname", "pos")
    assert got == [("a", 1), ("b", 3), ("b", 4)]


def test_inner_soft_clip_is_an_error(spark):
    with pytest.raises(Exception, match="soft clip"):
        cigar.check_clips(reads(spark, {"qname": "bad", "pos": 1, "cigar": "2M2S2M", "seq": "ACGTAC"})).collect()


def test_mate_overlap_drops_the_shorter_mate(spark):
    df = reads(spark, {"qname": "a", "pos": 1, "cigar": "6M", "seq": "AAAAAA"}, {"qname": "a", "pos": 5, "cigar": "4M", "seq": "CCCC", "rev": True, "second": True})
    got = rows(cigar.drop_mate_overlap(cigar.aligned_bases(df), df).select("pos", "base"), "pos")
    assert got == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (7, 1), (8, 1)]


def test_mate_overlap_ties_go_by_quality_then_forward(spark):
    def left(q1, q2):
        df = reads(spark, {"qname": "a", "pos": 1, "cigar": "2M", "seq": "AA", "q": q1}, {"qname": "a", "pos": 1, "cigar": "2M", "seq": "CC", "rev": True, "q": q2})
        return {r.base for r in cigar.drop_mate_overlap(cigar.aligned_bases(df), df).collect()}

    assert left(30, 20) == {0} and left(20, 30) == {1} and left(30, 30) == {1}


def test_last_tag_decides_strand(spark):
    df = spark.createDataFrame([([("XG", "CT"), ("NM", "1")],), ([("XG", "CT"), ("YD", "r")],), ([],)], "t array<struct<tag:string,value:string>>")
    assert [r[0] for r in df.select(cigar.bisulfite_strand(F.col("t"))).collect()] == [1, 2, 0]


def test_read_counts_see_the_mates_places(spark):
    flags = [(3, "c", "c", 5, 9), (3, "c", "d", 5, 9), (3, "c", "c", 9, 5), (3 + 16, "c", "c", 5, 9), (3 + 16, "c", "c", 9, 5)]
    df = spark.createDataFrame([(f, 60, 100, "ACGT", *r) for f, *r in flags], "flag int, mapq int, isize int, seq string, contig string, mate_contig string, pos long, mate_pos long")
    assert rows(filters.read_filter_counts(df), "reason") == [("mate_other_contig", 1, 4), ("orientation", 2, 8), ("passed", 2, 8)]


def test_base_reasons_are_all_counted(spark):
    df = reads(spark, {"qname": "a", "pos": 1, "cigar": "2S6M", "seq": "NNAAAAAA"}, {"qname": "a", "pos": 5, "cigar": "4M1S", "seq": "CCCCC", "rev": True, "second": True}, {"qname": "b", "pos": 50, "cigar": "3M", "seq": "GGG", "q": 2})
    marked = cigar.mark_mate_overlap(cigar.aligned_bases(df, CallParams(left_trim=(3, 0)), clips=True), df)
    got = dict(rows(filters.base_filter_counts(marked), "reason"))
    assert got == {"clipped": 3, "overlap": 2, "trimmed": 4, "passed": 7}
    assert filters.passing_bases(marked).count() == 7
    untrimmed = cigar.mark_mate_overlap(cigar.aligned_bases(df, clips=True), df)
    assert dict(rows(filters.base_filter_counts(untrimmed), "reason")) == {"clipped": 3, "overlap": 2, "low_qual": 3, "passed": 8}


def test_filter_reasons_in_order(spark):
    flags = [(3, 60, 100), (3 + 256 + 4, 60, 0), (3 + 4 + 8, 60, 0), (3 + 8, 60, 0), (3 + 512 + 1024, 60, 0), (3 + 1024, 60, 0), (1, 60, 0), (3, 5, 0), (3, 60, 1001)]
    df = spark.createDataFrame(flags, "flag int, mapq int, isize int")
    got = [r[0] for r in df.select(filters.filter_reason()).collect()]
    assert got == ["passed", "secondary", "unmapped", "mate_unmapped", "qc_flags", "duplicate", "not_correctly_aligned", "mapq", "insert_size"]
    ignoring = [r[0] for r in df.select(filters.filter_reason(CallParams(ignore_duplicates=True))).collect()]
    assert ignoring[5] == "passed"
    single = [r[0] for r in df.select(filters.filter_reason(CallParams(keep_unmatched=True))).collect()]
    assert single[3] == single[6] == single[8] == "passed" and single[5] == "duplicate"


def test_fisher_against_plain_sum(spark):
    tables = [(3, 1, 0, 5), (0, 0, 0, 0), (10, 10, 10, 10), (1, 0, 0, 1), (300, 280, 20, 5)]
    df = spark.createDataFrame(tables, "a long, b long, c long, d long")
    got = [r[0] for r in df.select(stats.fisher(*"abcd")).collect()]
    for (a, b, c, d), p in zip(tables, got):
        n, r0, k0 = a + b + c + d, a + b, a + c
        total = sum(math.comb(r0, x) * math.comb(n - r0, k0 - x) / math.comb(n, k0) for x in range(max(0, k0 - n + r0), min(r0, k0) + 1) if abs(x * n - r0 * k0) >= abs(a * n - r0 * k0)) if n else 1
        assert p == pytest.approx(total, rel=1e-9)


def test_likelihoods_normalise_and_follow_evidence(spark):
    out = [("chr1", p, 1, s, 0, b, 35, 60) for p, s, b, n in [(1, 0, 0, 10), (2, 1, 3, 12), (3, 0, 1, 6), (3, 0, 3, 6)] for _ in range(n)]
    df = spark.createDataFrame(out, "contig string, pos long, ref int, bs_strand int, ori int, base int, qual int, mapq int")
    got = {r.pos: r for r in model.call_sites(df).collect()}
    for r in got.values():
        assert sum(10 ** r[f"gl{g}"] for g in range(10)) == pytest.approx(1, abs=1e-9)
    assert B.GENOTYPES[got[1].gt] == "AA"  # all A, unconverted
    assert B.GENOTYPES[got[2].gt] == "CC"  # all T on the C to T strand: an unmethylated reference C
    assert B.GENOTYPES[got[3].gt] == "CT" and got[3].call == "0/1" and got[3].mut == "C>T"


def test_pileup_counts_every_surviving_base(spark):
    df = spark.createDataFrame([("c", 1, 0, 1, 0, 1, q, 60) for q in (19, 20, 43)], "contig string, pos long, ref int, bs_strand int, ori int, base int, qual int, mapq int")
    r = pileup.pileup(df).first()
    assert (r.n, r.c5, r.dp1, r.d_inf) == (2, 2, 0, 2)


def test_neighbours_across_bucket_edges(spark):
    df = spark.createDataFrame([("c", p, p % 4) for p in (1, 2, 3, 5, 8, 9, 10)], "contig string, pos long, ref int")
    wide, narrow = (context.with_neighbours(df, ["ref"], bucket=b).orderBy("pos").collect() for b in (1 << 16, 4))
    assert wide == narrow
    assert [r.ref_p1 for r in wide] == [2, 3, None, None, 1, 2, None]


def test_cpg_status_mirrors(spark):
    cc, gg, at = (B.GENOTYPES.index(g) for g in ("CC", "GG", "AT"))
    df = spark.createDataFrame([(cc, None, gg), (gg, cc, None), (cc, None, at), (gg, at, None), (cc, None, None), (at, None, None)], "g int, a int, b int")
    assert [r[0] for r in df.select(context.cpg_status(F.col("g"), F.col("a"), F.col("b"))).collect()] == ["CG", "CG", "N", "N", "?", "."]


def test_blocks_with_any_stretch(spark):
    spans = [(1, 5), (3, 9), (10, 12), (14, 15), (30, 200), (150, 160), (202, 210)]
    df = spark.createDataFrame([("c", a, b) for a, b in spans], "contig string, st long, en long")
    want = [1, 1, 1, 2, 3, 3, 4]
    for stretch in (1 << 16, 10, 3):
        assert [r.block for r in templates.blocks(df, stretch=stretch).orderBy("st").collect()] == want


def test_ignored_regions_hide_no_others(spark):
    rng = random.Random(5)
    bed = [("a", 1, 10), ("a", 8, 20), ("a", 15, 30), ("a", 15, 30), ("a", 40, 50), ("b", 5, 9)]
    bed += [("c", s, s + rng.randrange(60)) for s in (rng.randrange(200_000) for _ in range(3_000))]
    got = rows(contigs.without_overlaps(spark.createDataFrame(bed, "contig string, start_pos long, end_pos long")), "contig", "start_pos")
    kept = []
    for r in sorted(bed):
        if not any(k[0] == r[0] and r[1] <= k[2] and k[1] <= r[2] for k in kept):
            kept.append(r)
    assert got == kept and ("a", 15, 30) in got


def test_regions_and_aliases(spark):
    bed = spark.createDataFrame([("c", 5, 5), ("c", 0, 10), ("c", 9, 20), ("c", 30, 40)], "contig string, start0 long, end long")
    kept = rows(contigs.without_overlaps(contigs.valid_regions(bed)).select("start_pos", "end_pos"), "start_pos")
    assert kept == [(1, 10), (31, 40)]
    known = spark.createDataFrame([("1", 5, "rs1"), ("x", 6, "rs2")], "contig string, pos long, name string")
    names = spark.createDataFrame([("1", "chr1", 0), ("1", "other", 1)], "alias string, name string, ord int")
    assert rows(snps.rename_contigs(known, names).select("contig", "pos"), "pos") == [("chr1", 5)]


def test_empty_inputs(spark):
    df = spark.createDataFrame([], "contig string, pos long, ref int, bs_strand int, ori int, base int, qual int, mapq int")
    assert model.call_sites(df).collect() == []
    assert templates.blocks(spark.createDataFrame([], "contig string, st long, en long")).collect() == []


def test_parameters_are_checked():
    assert CallParams(min_qual=99).min_qual == 43
    with pytest.raises(ValueError):
        CallParams(under_conversion=1.5)


def test_duplicates_keep_the_best_template(spark):
    base = [("a", 1, 50, 30), ("b", 2, 60, 20), ("c", 3, 60, 25), ("d", 4, 60, 25)]
    out = [(o, q, 99, "chr1", 10, m, "chr1", 30, 60, [("M", 4)], "ACGT", [x] * 4, [("XG", "CT")]) for q, o, m, x in base]
    out += [(o + 10, q, 147, "chr1", 30, m, "chr1", 10, -60, [("M", 4)], "ACGT", [x] * 4, [("XG", "CT")]) for q, o, m, x in base]
    out += [(30, "alone", 99, "chr1", 10, 60, "chr1", 30, 60, [("M", 4)], "ACGT", [40] * 4, [("XG", "CT")])]
    schema = "ord long, qname string, flag int, contig string, pos long, mapq int, mate_contig string, mate_pos long, isize int, cigar array<struct<op:string,len:int>>, seq string, qual array<int>, tags array<struct<tag:string,value:string>>"
    usable = alignments.usable_reads(spark.createDataFrame(out, schema))
    kept = alignments.kept_templates(usable).collect()
    assert [(r.qname, r.n_dup, r.mean_qual) for r in kept] == [("c", 4, 25)]  # of equals the first read
    more = {r.qname for r in alignments.kept_templates(usable, CallParams(keep_unmatched=True)).collect()}
    assert more == {"c", "alone"}
    every = {r.qname for r in alignments.kept_templates(usable, CallParams(keep_duplicates=True)).collect()}
    assert every == {"a", "b", "c", "d"}
    ref = spark.createDataFrame([("chr1", p, 0) for p in range(1, 40)], "contig string, pos long, ref int")
    sites = alignments.sites_from_reads(spark.createDataFrame(out, schema), ref).collect()
    assert sorted(r.pos for r in sites) == [10, 11, 12, 13, 30, 31, 32, 33] and all(r.n == 1 for r in sites)


def test_gc_bins_count_from_the_first_known_base(spark):
    ref = spark.createDataFrame([("c", p, None if p <= 150 else 1) for p in range(1, 351)], "contig string, pos long, ref int")
    got = contigs.gc_bins(ref)
    assert rows(got.select("bin", "first", "gc"), "bin") == [(0, 151, 100), (1, 151, 100)]
    sites = spark.createDataFrame([("c", 151), ("c", 250), ("c", 251), ("c", 5)], "contig string, pos long")
    assert rows(report.with_gc_bin(sites, got).select("pos", "bin"), "pos") == [(151, 0), (250, 0), (251, 1)]


def test_fisher_of_deep_tables(spark):
    df = spark.createDataFrame([(3000, 2900, 10, 4000), (20000, 20000, 20000, 20000)], "a long, b long, c long, d long")
    one, two = [r[0] for r in df.select(stats.fisher(*"abcd")).collect()]
    assert 0 <= one < 1e-200 and abs(two - 1) < 1e-6
