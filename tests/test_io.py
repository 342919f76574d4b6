from __future__ import annotations

import datetime
import json
import lzma

import pytest
from pyspark.sql import functions as F

from methyloom import options
from methyloom.operators import context, model, snps
from methyloom.sources import genome, outputs, snpfiles
from methyloom.streaming import batch, live

SAM = "@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:40\n@RG\tID:1\tBC:b1\tSM:s1\n@RG\tID:2\tBC:b1\tSM:s2\nr1\t99\tchr1\t3\t60\t4M\t=\t10\t11\tACGT\tIIII\tXG:Z:CT\tNM:i:0\nr1\t147\tchr1\t10\t60\t4M\t=\t3\t-11\tACGN\t*\n"


def test_fasta_and_sam(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">chr1 some text\nACg\nTN\n>chr2\nC\n")
    got = [tuple(r) for r in genome.read_fasta(spark, str(tmp_path / "g.fa")).orderBy("contig", "pos").collect()]
    assert got == [("chr1", 1, 0), ("chr1", 2, 1), ("chr1", 3, 2), ("chr1", 4, 3), ("chr1", 5, None), ("chr2", 1, 1)]
    (tmp_path / "a.sam").write_text(SAM)
    r = genome.read_sam(spark, str(tmp_path / "a.sam")).orderBy("ord").collect()
    assert [(x.qname, x.pos, x.mate_contig, len(x.qual)) for x in r] == [("r1", 3, "chr1", 4), ("r1", 10, "chr1", 0)]
    assert r[0].tags[0].tag == "XG" and r[0].qual[0] == 40
    contigs, groups = genome.read_header(spark, str(tmp_path / "a.sam"))
    assert contigs.first().length == 40 and [tuple(x) for x in groups.collect()] == [("b1", "s1", None)]


def test_fasta_headers_may_hold_marks(spark, tmp_path):
    (tmp_path / "g.fa").write_text("lost\n>c1 a > b\nAC\n\nG T\n>c2\n>c3 >\nnA\n")
    got = [tuple(r) for r in genome.read_fasta(spark, str(tmp_path / "g.fa")).orderBy("contig", "pos").collect()]
    assert got == [("c1", 1, 0), ("c1", 2, 1), ("c1", 3, 2), ("c1", 4, 3), ("c3", 1, None), ("c3", 2, 0)]
    spans = spark.createDataFrame([("c1", 0, 5), ("c3", 1, 2)], "contig string, start_pos long, end_pos long")
    ref = genome.read_fasta(spark, str(tmp_path / "g.fa"))
    assert {r.contig: r.letters for r in genome.reference_string(ref, spans).collect()} == {"c1": "NACGTN", "c3": "NA"}


def test_packed_lines_and_index(spark, tmp_path):
    with lzma.open(tmp_path / "a.xz", "wt") as out:
        out.write("one\ntwo\r\nthree")
    (tmp_path / "b.txt").write_text("four\n")
    got = snpfiles.read_lines(spark, str(tmp_path / "a.xz"), str(tmp_path / "b.txt")).orderBy("ord").collect()
    assert [r.value for r in got] == ["one", "two", "three", "four"]
    (tmp_path / "g.fai").write_text("c1\t8\t4\t60\t61\nshort\n")
    assert [tuple(r) for r in genome.read_fasta_index(spark, str(tmp_path / "g.fai")).collect()] == [("c1", 8, 4, 60, 61)]


def test_header_lines():
    lines = outputs.vcf_header([("c1", 9, "b37", None, "x")], "s", groups=[("b1", "s1", None), ("b1", "s2", None), (None, "s3", None)], snps="known")
    assert "##contig=<ID=c1,length=9,assembly=b37,sp=x>" in lines and '##sample_info=<ID="b1",SM="s1">' in lines and "##dbsnp=<known>" in lines
    kinds = {x.split("ID=")[1].split(",")[0]: x.split(",")[1:3] for x in lines if x.startswith("##FORMAT")}
    assert kinds["GL"] == ["Number=G", "Type=Float"] and kinds["MC8"] == ["Number=8", "Type=Integer"] and kinds["GT"] == ["Number=1", "Type=String"]
    assert set(kinds) == set(outputs.FORMATS)
    assert not any(x.startswith(("##fileDate", "##sample_info", "##dbsnp")) for x in outputs.vcf_header([], "s", benchmark=True, groups=[("b", "s", None)], snps="k"))
    assert [outputs.output_kind(x) for x in ("a.vcf.gz", "a.parquet", "a")] == ["vcf.gz", "parquet", "vcf"]
    with pytest.raises(ValueError):
        outputs.output_kind("a.bcf")


def test_snp_files(spark, tmp_path):
    (tmp_path / "a.bed").write_text("track x\nchr1\t4\t5\trs1\t+\nchr1\t4\t7\trs2\t+\nchr1\t1\t2\n")
    (tmp_path / "b.vcf").write_text("##fileformat=VCFv4.2\n#CHROM\nchr1\t9\trs3\tA\tG\t.\nchr1\t9\trs4\tA\tGT\t.\n")
    one = {"refsnp_id": "7", "primary_snapshot_data": {"placements_with_allele": [{"is_ptlp": True, "alleles": [{"allele": {"spdi": {"seq_id": "chr1", "position": 20, "deleted_sequence": "A", "inserted_sequence": x}}} for x in "AG"]}], "allele_annotations": [{"frequency": [{"study_name": "s", "allele_count": 9, "total_count": 10, "observation": {"deleted_sequence": "A", "inserted_sequence": "G"}}]}]}}
    (tmp_path / "c.json").write_text(json.dumps(one) + "\n")
    got = [tuple(r) for r in snpfiles.read_snps(spark, *[str(tmp_path / x) for x in ("a.bed", "b.vcf", "c.json")]).orderBy("pos").collect()]
    assert [x[:3] for x in got] == [("chr1", 5, "rs1"), ("chr1", 9, "rs3"), ("chr1", 21, "rs7")] and abs(got[2][3] - 0.1) < 1e-12
    assert [snpfiles.sniff(x) for x in ("{}", "##fileformat=VCFv4.2", "chr1\t1")] == ["json", "vcf", "bed"]


def test_index_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 5, "rs1", True), ("chr2", 6, "rs2", False)], "contig string, pos long, name string, flagged boolean")
    snpfiles.write_index(df, str(tmp_path / "i"))
    assert snpfiles.read_index(spark, str(tmp_path / "i"), "chr2").first().name == "rs2"


def sites(spark):
    out = [("chr1", p, r, 0, i % 2, b, 35, 60) for p, r, b in [(1, 1, 1), (2, 2, 2), (3, 0, 2)] for i in range(8)]
    df = spark.createDataFrame(out, "contig string, pos long, ref int, bs_strand int, ori int, base int, qual int, mapq int")
    known = spark.createDataFrame([("chr1", 3, "rs9", True)], "contig string, pos long, name string, flagged boolean")
    return snps.lookup(context.with_cpg(model.call_sites(df)), known)


def test_vcf_and_report(spark, tmp_path):
    s = sites(spark)
    full = s.join(context.called_context(s), ["contig", "pos"]).withColumn("cx_ref", F.lit("NNNNN"))
    outputs.write_vcf(full, str(tmp_path / "v"), outputs.vcf_header([("chr1", 3)], "sample", benchmark=True))
    body = [r[0].split("\t") for r in spark.read.text(str(tmp_path / "v/body")).orderBy(F.split("value", "\t")[1]).collect()]
    assert [x[1:5] for x in body] == [["1", ".", "C", "."], ["2", ".", "G", "."], ["3", "rs9", "A", "G"]]
    assert body[2][9].startswith("1/1:") and "CG" in body[0][9]
    tree = json.loads(outputs.json_report(s, date="2020-01-01"))
    assert tree["totalStats"]["SNPS"]["snps_all"] == 1 and tree["totalStats"]["dbSNP"]["variants_all"] == 1
    assert any(x["contig"] is None for x in tree["contigStats"])
    assert tree["totalStats"]["CpG"] == [{"ref_cpg": True, "all": 1, "passed": tree["totalStats"]["CpG"][0]["passed"]}] and "filterStats" not in tree


def test_streams_equal_batches(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    out = [(i, t0 + datetime.timedelta(minutes=m), i % 2, "a", 1.0) for i, m in enumerate([0, 1, 5, 50, 51, 200, 201, 2000])]
    df = spark.createDataFrame(out, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = live.read_files(spark, str(tmp_path / "in"), df.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    live.run_to_end(live.live_sessions(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.user_id, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.user_id, r.n) for r in batch.sessions(df.filter("event_id < 7")).collect()}
    assert got == want


def test_mates_meet_in_a_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    at = lambda m: t0 + datetime.timedelta(minutes=m)
    df = spark.createDataFrame([(at(0), "a", 0, 1), (at(5), "a", 1, 9), (at(0), "b", 0, 2), (at(30), "b", 1, 8), (at(1), "c", 1, 3)], "ts timestamp, qname string, is_reverse int, st long")
    df.write.parquet(str(tmp_path / "in"))
    stream = live.read_files(spark, str(tmp_path / "in"), df.schema)
    live.run_to_end(live.live_pairs(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = [(r.fwd_qname, r.fwd_st, r.rev_st) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("a", 1, 9)]  # b's mate comes after the allowed lateness, c has none


def test_best_duplicate_stream(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t0, "c", 1, "a", 10), (t0, "c", 1, "b", 30), (t0, "c", 1, "d", 30), (t0 + datetime.timedelta(days=1), "c", 2, "e", 5)], "ts timestamp, contig string, st long, qname string, mapq long").coalesce(1)
    df.write.parquet(str(tmp_path / "in"))
    stream = live.read_files(spark, str(tmp_path / "in"), df.schema)
    live.run_to_end(live.live_best_of_duplicates(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = [(r.qname, r.n) for r in spark.read.parquet(str(tmp_path / "out")).filter("st = 1").collect()]
    assert got == [("b", 3)]


def test_options():
    run = options.parse_options(["-r", "g.fa", "-L5", "-R", "1,2", "-k", "-q", "30", "-Q", "99", "-c", "0.02,7", "-o", "x.vcf.gz", "--benchmark-mode", "-t", "3", "a.sam"])
    p = run.params
    assert (p.left_trim, p.right_trim, p.keep_unmatched, p.min_mapq, p.min_qual) == ((5, 5), (1, 2), True, 30, 43)
    assert (p.under_conversion, p.over_conversion, p.benchmark_mode) == (0.02, 0.05, True)
    assert (run.kind, run.reference, run.alignments) == ("vcf.gz", "g.fa", "a.sam")
    with pytest.raises(ValueError):
        options.parse_options(["-r", "g.fa", "-O", "b"])
    with pytest.raises(SystemExit):
        options.parse_options(["a.sam"])
