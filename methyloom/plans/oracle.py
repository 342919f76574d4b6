"""DuckDB SQL of the registered queries, written from the definitions rather than from the operators:
the genotype model, for one, is a table of ten genotypes crossed with sites."""

from __future__ import annotations

import math

from .fixtures import VIEWS

ORACLES: dict[str, str] = {}
CH = range(8)
ALL16 = ", ".join(f"s{s}c{c}" for s in (0, 1) for c in CH)


def fx(*names: str) -> str:
    return ",\n".join(f"{name} AS ({VIEWS[name]})" for name in names)


CHANNELS = """ch AS (SELECT *, CAST(base + CASE WHEN (bs_strand = 1 AND base IN (1, 3)) OR (bs_strand = 2 AND base IN (0, 2)) THEN 4 ELSE 0 END AS INT) AS channel FROM fx_bases)"""

PILE = f"""
{fx("fx_bases")}, {CHANNELS},
pile0 AS (SELECT contig, pos, min(ref) AS ref, count(*) AS n,
  {", ".join(f"count(*) FILTER (WHERE ori = {s} AND channel = {c}) AS s{s}c{c}" for s in (0, 1) for c in CH)},
  {", ".join(f"CAST(coalesce(sum(qual) FILTER (WHERE channel = {c}), 0) AS BIGINT) AS q{c}" for c in CH)},
  CAST(sum(mapq * mapq) AS BIGINT) AS mq2
  FROM ch WHERE mapq >= 20 AND qual >= 20 GROUP BY contig, pos),
pile1 AS (SELECT *, {", ".join(f"s0c{c} + s1c{c} AS c{c}" for c in CH)} FROM pile0),
pile AS (SELECT *, c0 + c1 + c2 + c3 AS dp1, c4 + c5 + c6 + c7 AS d_inf, c0 + c1 + c2 + c3 + c4 + c5 + c6 + c7 AS dp FROM pile1)"""

QUALITY = f"""{PILE},
qual0 AS (SELECT *, {", ".join(f"CAST(CASE WHEN c{c} > 0 THEN floor(0.5 + q{c} / c{c}) ELSE 0 END AS INT) AS m{c}" for c in CH)},
  CAST(floor(0.5 + (q0 + q1 + q2 + q3 + q4 + q5 + q6 + q7) / n) AS INT) AS aq, CAST(floor(0.5 + sqrt(mq2 / n)) AS INT) AS mq FROM pile)"""


def k_of(q: str) -> str:
    e = f"least(pow(10.0::DOUBLE, -{q} / 10.0::DOUBLE), 0.5::DOUBLE)"
    return f"({e} / (3 - 4 * {e}))"


S, D = 0.99 + 0.05, 0.99 - 0.05


def z_of(num: str, a: str, b: str) -> str:
    return f"CASE WHEN {a} + {b} > 0 THEN 0.5::DOUBLE * ({D!r}::DOUBLE * greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({num}) / (({a} + {b}) * {D!r}::DOUBLE))) + 2 - {S!r}::DOUBLE) END"


def zs(a: str, b: str, ka: str, kb: str) -> list[str]:
    s = f"{S!r}::DOUBLE"
    return [
        z_of(f"{a} * ({s} + 2 * {kb}) - {b} * (2 - {s} + 2 * {ka})", a, b),
        z_of(f"{a} * (2 + {s} + 4 * {kb}) - {b} * (2 - {s} + 4 * {ka})", a, b),
        z_of(f"{a} * ({s} + 4 * {kb}) - {b} * (2 - {s} + 4 * {ka})", a, b),
    ]


MLE = f"""{QUALITY},
ks AS (SELECT *, {", ".join(f"{k_of(f'm{c}')} AS k{c}" for c in CH)} FROM qual0),
mle AS (SELECT *, {", ".join(f"{x} AS z{i}" for i, x in enumerate(zs("c5", "c7", "k5", "k7") + zs("c6", "c4", "k6", "k4")))} FROM ks)"""

GENOTYPE_ROWS = ", ".join(f"({g}, '{a}', '{b}')" for g, (a, b) in enumerate((a, b) for i, a in enumerate("ACGT") for b in "ACGT"[i:]))


def share(base: str) -> str:
    return f"((CASE WHEN a1 = '{base}' THEN 0.5::DOUBLE ELSE 0 END) + (CASE WHEN a2 = '{base}' THEN 0.5::DOUBLE ELSE 0 END))"


def with_base(base: str) -> str:
    return f"(a1 = '{base}' OR a2 = '{base}')"


P = {c: f"{share(b)} + k{c}" for c, b in enumerate("ACGT")}
P[4] = f"k4 + CASE WHEN NOT {with_base('G')} THEN {share('A')} WHEN a1 = 'G' AND a2 = 'G' THEN 1 - z3 WHEN a1 = 'A' THEN 1 - 0.5::DOUBLE * z4 ELSE 0.5::DOUBLE * (1 - z5) END"
P[5] = f"k5 + CASE WHEN NOT {with_base('C')} THEN 0 WHEN a1 = 'C' AND a2 = 'C' THEN z0 WHEN a2 = 'T' THEN 0.5::DOUBLE * z1 ELSE 0.5::DOUBLE * z2 END"
P[6] = f"k6 + CASE WHEN NOT {with_base('G')} THEN 0 WHEN a1 = 'G' AND a2 = 'G' THEN z3 WHEN a1 = 'A' THEN 0.5::DOUBLE * z4 ELSE 0.5::DOUBLE * z5 END"
P[7] = f"k7 + CASE WHEN NOT {with_base('C')} THEN {share('T')} WHEN a1 = 'C' AND a2 = 'C' THEN 1 - z0 WHEN a2 = 'T' THEN 1 - 0.5::DOUBLE * z1 ELSE 0.5::DOUBLE * (1 - z2) END"

REF = "substr('ACGT', ref + 1, 1)"
GENO = f"""{MLE},
geno AS (SELECT * FROM (VALUES {GENOTYPE_ROWS}) t(g, a1, a2)),
ll AS (SELECT contig, pos, g, CASE WHEN a1 = {REF} AND a2 = {REF} THEN {math.log(2)!r}::DOUBLE WHEN a1 = {REF} OR a2 = {REF} THEN {math.log(1.5)!r}::DOUBLE ELSE 0 END
  + {" + ".join(f"CASE WHEN c{c} > 0 THEN c{c} * ln({P[c]}) ELSE 0 END" for c in CH)} AS l FROM mle CROSS JOIN geno),
tops AS (SELECT contig, pos, max(l) AS top FROM ll GROUP BY 1, 2),
sums AS (SELECT ll.contig, ll.pos, any_value(top) AS top, sum(exp(l - top)) AS total, min(g) FILTER (WHERE l = top) AS gt FROM ll JOIN tops USING (contig, pos) GROUP BY 1, 2),
gls AS (SELECT contig, pos, CAST(any_value(gt) AS INT) AS gt, {", ".join(f"max((l - top - ln(total)) / ln(10.0::DOUBLE)) FILTER (WHERE g = {g}) AS gl{g}" for g in range(10))},
  coalesce(sum(exp(l - top)) FILTER (WHERE g <> gt), 0) / any_value(total) AS wrong FROM ll JOIN sums USING (contig, pos) GROUP BY 1, 2)"""

#: channels of either allele of the heterozygous genotypes, as the rules have them
PAIRS = {1: ("0,4", "1,5,7"), 2: ("0", "2,6"), 3: ("0,4", "3,7"), 5: ("1,5,7", "2,4,6"), 6: ("1,5", "3"), 8: ("2,4,6", "3,7")}


def cell(strand: str, allele: int) -> str:
    add = lambda chans: " + ".join(f"{strand}c{c}" for c in chans.split(","))
    return "CASE gt " + " ".join(f"WHEN {g} THEN {add(x[allele])}" for g, x in PAIRS.items()) + " ELSE 0 END"


def fisher(a: str, b: str, c: str, d: str) -> str:
    n, r0, r1, k0 = f"({a} + {b} + {c} + {d})", f"({a} + {b})", f"({c} + {d})", f"({a} + {c})"
    lf = lambda x: f"lgamma(({x}) + 1.0::DOUBLE)"
    base = f"{lf(r0)} + {lf(r1)} + {lf(k0)} + {lf(f'{b} + {d}')} - {lf(n)}"
    term = f"CASE WHEN abs(x * {n} - {r0} * {k0}) >= abs({a} * {n} - {r0} * {k0}) THEN exp({base} - {lf('x')} - {lf(f'{r0} - x')} - {lf(f'{k0} - x')} - {lf(f'{r1} - {k0} + x')}) ELSE 0 END"
    return f"CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum([{term} FOR x IN generate_series(greatest(0, {k0} - {r1}), least({r0}, {k0}))])) END"


GT_LETTERS = "CASE gt " + " ".join(f"WHEN {g} THEN '{a}{b}'" for g, (a, b) in enumerate((a, b) for i, a in enumerate("ACGT") for b in "ACGT"[i:])) + " END"
SITES = f"""{GENO},
site0 AS (SELECT mle.*, gls.* EXCLUDE (contig, pos), {", ".join(f"{cell(f's{i // 2}', i % 2)} AS t{i}" for i in range(4))}, {GT_LETTERS} AS gl_, {REF} AS rl FROM mle JOIN gls USING (contig, pos)),
site1 AS (SELECT *, {fisher("t0", "t1", "t2", "t3")} AS fp, CAST(CASE WHEN wrong <= 0 THEN 255 ELSE least(floor(-10 * log10(wrong)), 255) END AS INT) AS phred FROM site0),
site2 AS (SELECT *, CAST(floor(-10 * log10(greatest(fp, 1e-20)) + 0.5) AS INT) AS fs, CAST(CASE WHEN dp1 > 0 THEN floor(phred / dp1) ELSE phred END AS INT) AS qd,
  substr(gl_, 1, 1) <> substr(gl_, 2, 1) AS is_het FROM site1),
site3 AS (SELECT *, CASE WHEN phred < 20 THEN 1 ELSE 0 END + CASE WHEN qd < 2 THEN 2 ELSE 0 END + CASE WHEN fs > 60 THEN 4 ELSE 0 END + CASE WHEN mq < 40 THEN 8 ELSE 0 END AS f4 FROM site2),
site4 AS (SELECT *, CAST(CASE WHEN f4 = 0 AND is_het AND ({cell("", 0)} <= 1 OR {cell("", 1)} <= 1) THEN 128 ELSE f4 END AS INT) AS flt FROM site3),
sites AS (SELECT *, CASE WHEN flt = 0 THEN 'PASS' WHEN flt = 128 THEN 'mac1' ELSE 'fail' END AS filter,
  CASE WHEN flt IN (0, 128) THEN 'PASS' ELSE concat_ws(';', CASE WHEN flt & 1 > 0 THEN 'q20' END, CASE WHEN flt & 2 > 0 THEN 'qd2' END, CASE WHEN flt & 4 > 0 THEN 'fs60' END, CASE WHEN flt & 8 > 0 THEN 'mq40' END) END AS ft,
  concat_ws(',', CASE WHEN substr(gl_, 1, 1) <> rl THEN substr(gl_, 1, 1) END, CASE WHEN is_het AND substr(gl_, 2, 1) <> rl THEN substr(gl_, 2, 1) END) AS alt,
  CASE WHEN NOT contains(gl_, rl) AND is_het THEN '1/2' WHEN NOT contains(gl_, rl) THEN '1/1' WHEN is_het THEN '0/1' ELSE '0/0' END AS call,
  CASE WHEN contains(gl_, 'C') AND contains(gl_, 'G') THEN '+-' WHEN contains(gl_, 'C') THEN '+' WHEN contains(gl_, 'G') THEN '-' ELSE 'NA' END AS cs,
  substr('AMRWCSYGKT', gt + 1, 1) AS iupac FROM site4),
muts AS (SELECT contig, pos, CASE WHEN length(alt) = 1 THEN concat(rl, '>', alt) END AS mut FROM sites)"""

CPG = f"""{SITES}, {fx("fx_snps")},
near AS (SELECT s.*, a.gt AS gt_m, b.gt AS gt_p, a.ref AS ref_m, b.ref AS ref_p, a.flt AS flt_m FROM sites s
  LEFT JOIN sites a ON a.contig = s.contig AND a.pos = s.pos - 1 LEFT JOIN sites b ON b.contig = s.contig AND b.pos = s.pos + 1),
cpg AS (SELECT *, CASE WHEN (gt = 4 AND gt_p = 7) OR (gt = 7 AND gt_m = 4) THEN 'CG'
    WHEN gt <> 7 AND contains(gl_, 'C') THEN CASE WHEN gt_p IS NULL THEN '?' WHEN gt_p IN (2, 5, 7, 8) THEN 'H' ELSE 'N' END
    WHEN contains(gl_, 'G') THEN CASE WHEN gt_m IS NULL THEN CASE WHEN gt = 7 THEN '?' ELSE '.' END WHEN gt_m IN (1, 4, 5, 6) THEN 'H' ELSE 'N' END
    ELSE '.' END AS cg,
  coalesce((cs = '+' AND ref = 1 AND ref_p = 2) OR (cs = '-' AND ref_m = 1 AND ref = 2), FALSE) AS ref_cpg FROM near),
snp AS (SELECT *, maf >= 0.25 AS flagged FROM fx_snps),
looked AS (SELECT c.*, coalesce(s.name, '.') AS id, CASE WHEN s.name IS NULL THEN 0 WHEN s.flagged THEN 3 ELSE 1 END AS rs_found, m.mut
  FROM cpg c LEFT JOIN snp s ON s.contig = c.contig AND s.pos = c.pos JOIN muts m ON m.contig = c.contig AND m.pos = c.pos),
written AS (SELECT * FROM looked WHERE NOT ((gt = 0 AND ref = 0) OR (gt = 9 AND ref = 3)) OR rs_found = 3)"""

SNP = f"{fx('fx_snps')}, snp AS (SELECT *, maf >= 0.25 AS flagged FROM fx_snps)"


def oracle(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = f"WITH {ctes}\n{select}" if ctes else select


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0::DOUBLE AS {n}" for n in names)


READS = fx("fx_reads")


def reason(pair: bool) -> str:
    rest = "WHEN flag & 8 > 0 THEN 'mate_unmapped'" if pair else ""
    end = "WHEN flag & 2 = 0 THEN 'not_correctly_aligned'" if pair else ""
    size = "WHEN isize > 1000 THEN 'insert_size'" if pair else ""
    return f"CASE WHEN flag & 2304 > 0 THEN 'secondary' WHEN flag & 4 > 0 THEN 'unmapped' {rest} WHEN flag & 512 > 0 THEN 'qc_flags' WHEN flag & 1024 > 0 THEN 'duplicate' {end} WHEN mapq < 20 THEN 'mapq' {size} ELSE 'passed' END"


for name, pair in (("f01_read_filter_reason", True), ("f02_single_filter_reason", False)):
    oracle(name, READS, f"SELECT {reason(pair)} AS reason, count(*) AS reads, CAST(sum(l_qseq) AS BIGINT) AS bases FROM fx_reads GROUP BY 1")
oracle("f08_contig_selection", fx("fx_reads", "fx_regions"), "SELECT contig, count(*) AS reads FROM fx_reads WHERE contig IN (SELECT contig FROM fx_regions WHERE start_pos < 200) GROUP BY 1")
oracle("p01_flag_decode", READS, "SELECT CAST(flag & 16 > 0 AS INT) AS is_reverse, CAST(flag & 128 > 0 AS INT) AS is_second, CAST((flag & 16 > 0) <> (flag & 128 > 0) AS INT) AS orientation, count(*) AS n FROM fx_reads GROUP BY 1, 2, 3")
oracle("j01_mate_pairs", READS, """SELECT contig, qname, min(st) FILTER (WHERE is_reverse = 0) AS fwd_st, min(st) FILTER (WHERE is_reverse = 1) AS rev_st,
  count(*) FILTER (WHERE is_reverse = 0) AS n_fwd, count(*) FILTER (WHERE is_reverse = 1) AS n_rev FROM fx_reads GROUP BY 1, 2 HAVING count(DISTINCT is_reverse) = 2""")
oracle("j02_mate_missing", READS, """SELECT contig, is_reverse, count(*) AS reads, CAST(sum(l_qseq) AS BIGINT) AS bases FROM fx_reads r
  WHERE NOT EXISTS (SELECT 1 FROM fx_reads m WHERE m.contig = r.contig AND m.qname = r.qname AND m.is_reverse <> r.is_reverse) GROUP BY 1, 2""")
oracle("j03_same_pos", READS, """SELECT contig, count(*) AS reads FROM fx_reads r
  WHERE EXISTS (SELECT 1 FROM fx_reads m WHERE m.contig = r.contig AND m.qname = r.qname AND m.st = r.st AND m.is_reverse <> r.is_reverse) GROUP BY 1""")
oracle("w01_islands", READS, """SELECT contig, CAST(block AS BIGINT) AS block, min(st) AS x, max(en) AS y, count(*) AS n FROM (
  SELECT contig, st, en, sum(opens) OVER (PARTITION BY contig ORDER BY st, en, qname, mapq, flag, isize, bs_strand ROWS UNBOUNDED PRECEDING) AS block FROM (
    SELECT *, CASE WHEN st <= 1 + max(en) OVER (PARTITION BY contig ORDER BY st, en, qname, mapq, flag, isize, bs_strand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
    FROM fx_reads)) GROUP BY 1, 2""")
oracle("w02_dedup", READS, """SELECT contig, st, en, bs_strand, best_mapq, best_len, n_dup FROM (SELECT contig, st, en, bs_strand, mapq AS best_mapq, l_qseq AS best_len,
  count(*) OVER (PARTITION BY contig, st, en, bs_strand) AS n_dup, row_number() OVER (PARTITION BY contig, st, en, bs_strand ORDER BY mapq DESC, l_qseq DESC) AS rn FROM fx_reads) WHERE rn = 1""")
oracle("a18_extents", READS, "SELECT contig, min(st) AS start_pos, max(en) AS max_pos, max(l_qseq) AS max_len FROM fx_reads GROUP BY 1")

# alignments: expected values come from the numbers that the lines are made of, not from the lines

SAM = f"""{fx("fx_sam")},
strands AS (SELECT *, CASE substr(t2, 1, 2) WHEN 'ZS' THEN 2 WHEN 'YD' THEN 1 ELSE CASE t1 WHEN 'XG:Z:CT' THEN 1 WHEN 'XG:Z:GA' THEN 2 ELSE 0 END END AS strand,
  flag & 16 > 0 AS rev, flag & 128 > 0 AS second, flag & 1 > 0 AS paired FROM fx_sam),
quals AS (SELECT ord, list_transform(range(rl), lambda i: least(43, ascii(substr(qual, CAST(i + 1 AS INT), 1)) - 33)) AS qs FROM fx_sam),
reasons AS (SELECT *, CASE WHEN flag & 1024 > 0 THEN 'duplicate' WHEN paired AND flag & 2 = 0 THEN 'not_correctly_aligned' WHEN mapq < 20 THEN 'mapq'
  WHEN paired AND mate_contig <> contig THEN 'mate_other_contig' WHEN paired AND isize > 1000 THEN 'insert_size'
  WHEN paired AND ((rev AND pos < mate_pos) OR (NOT rev AND pos > mate_pos)) THEN 'orientation' ELSE 'passed' END AS reason FROM strands),
usable AS (SELECT r.*, CAST(list_sum(qs) AS BIGINT) AS qsum, CASE WHEN paired THEN CAST(second AS INT) ELSE CAST(rev AS INT) END AS ori,
  CASE WHEN NOT rev THEN pos WHEN flag & 3 = 3 AND mate_pos > 0 THEN mate_pos END AS fwd_pos, CASE WHEN rev THEN pos WHEN flag & 3 = 3 AND mate_pos > 0 THEN mate_pos END AS rev_pos
  FROM reasons r JOIN quals USING (ord) WHERE reason = 'passed')"""


def sam_bases(left: tuple[int, int] = (0, 0), right: tuple[int, int] = (0, 0), source: str = "usable") -> str:
    """All bases of the reads of a table: those matched, and those clipped (without a place)."""
    return f"""pieces AS (SELECT *, UNNEST([{{'at': a, 'off': 0, 'n': b, 'clip': FALSE}}, {{'at': a + b + c, 'off': b, 'n': d, 'clip': FALSE}}, {{'at': a + b + c + d, 'off': b + d + e, 'n': f, 'clip': FALSE}},
    {{'at': 0, 'off': 0, 'n': a, 'clip': TRUE}}, {{'at': rl - g, 'off': 0, 'n': g, 'clip': TRUE}}]) AS s FROM {source}),
  laid AS (SELECT *, UNNEST(range(s.n)) AS i FROM pieces),
  lettered AS (SELECT *, CAST(s.at + i AS INT) AS at_, CASE WHEN NOT s.clip THEN pos + s.off + i END AS p, s.clip AS clipped, strpos('ACGT', substr(seq, CAST(s.at + i + 1 AS INT), 1)) - 1 AS base_ FROM laid),
  based AS (SELECT *, least(43, ascii(substr(qual, at_ + 1, 1)) - 33) AS q, CASE WHEN rev THEN rl - 1 - at_ ELSE at_ END AS read_pos,
    at_ < CASE WHEN second THEN {left[1]} ELSE {left[0]} END OR at_ >= rl - CASE WHEN second THEN {right[1]} ELSE {right[0]} END AS trimmed FROM lettered WHERE base_ >= 0 OR clipped)"""


OVERLAPS = """sides AS (SELECT contig, qname, rev, max({'a': pos, 'b': pos + span, 'm': CAST(floor(list_sum(list_transform(range(rl), lambda i: ascii(substr(qual, CAST(i + 1 AS INT), 1)) - 33)) / rl) AS BIGINT)}) AS x FROM usable GROUP BY 1, 2, 3),
  meet AS (SELECT f.contig, f.qname, f.x AS f, r.x AS r, CASE WHEN f.x.b - f.x.a <> r.x.b - r.x.a THEN f.x.b - f.x.a > r.x.b - r.x.a ELSE f.x.m > r.x.m END AS rev
    FROM sides f JOIN sides r ON f.contig = r.contig AND f.qname = r.qname AND NOT f.rev AND r.rev WHERE f.x.b >= r.x.a AND r.x.b > f.x.a),
  marked AS (SELECT t.*, coalesce(p >= CASE WHEN t.rev THEN m.f.a ELSE m.r.a END AND p < CASE WHEN t.rev THEN m.f.b ELSE m.r.b END, FALSE) AS overlap FROM based t LEFT JOIN meet m ON m.contig = t.contig AND m.qname = t.qname AND m.rev = t.rev)"""
TEMPLATES = """firsts AS (SELECT contig, qname, min({'ord': ord, 'f': fwd_pos, 'r': rev_pos, 's': strand}) AS x, bool_or(paired) AS paired,
    min({'ord': ord, 'q': mapq, 'n': rl, 't': qsum}) FILTER (WHERE NOT rev) AS f, min({'ord': ord, 'q': mapq, 'n': rl, 't': qsum}) FILTER (WHERE rev) AS r FROM usable GROUP BY 1, 2),
  tpl AS (SELECT contig, qname, x.f AS fwd_pos, x.r AS rev_pos, x.s AS bs_strand, x.ord AS ord, paired, CAST((f IS NOT NULL) AS INT) + CAST((r IS NOT NULL) AS INT) AS mates,
    CAST(floor((coalesce(f.q, 0) + coalesce(r.q, 0)) / (CAST((f IS NOT NULL) AS INT) + CAST((r IS NOT NULL) AS INT))) AS INT) AS mean_mapq,
    CAST(floor((coalesce(f.t, 0) + coalesce(r.t, 0)) / (coalesce(f.n, 0) + coalesce(r.n, 0))) AS INT) AS mean_qual FROM firsts),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY contig, fwd_pos, rev_pos, bs_strand, mates ORDER BY mean_mapq DESC, mean_qual DESC, ord) AS rn, count(*) OVER (PARTITION BY contig, fwd_pos, rev_pos, bs_strand, mates) AS n_dup FROM %s)"""
oracle("s01_sam_records", SAM, "SELECT ord, qname, flag, contig, pos, mapq, mate_contig, mate_pos, isize, rl AS seq_len, rl AS quals, 2 AS tags FROM fx_sam")
oracle("s03_region_scan", f"{SAM}, {fx('fx_regions')}", "SELECT ord, contig, pos FROM fx_sam s WHERE EXISTS (SELECT 1 FROM fx_regions r WHERE r.contig = s.contig AND s.pos <= end_pos AND s.pos + span - 1 >= start_pos)")
oracle("p03_positions", SAM, "SELECT ord, CASE WHEN NOT rev THEN pos WHEN flag & 11 = 3 THEN mate_pos ELSE 0 END AS fwd_pos, CASE WHEN rev THEN pos WHEN flag & 11 = 3 THEN mate_pos ELSE 0 END AS rev_pos FROM strands")
oracle("p04_cigar", SAM, "SELECT ord, rl AS read_len, span AS ref_span, CAST(3 + CAST(a > 0 AS INT) + CAST(c > 0 AS INT) + CAST(e > 0 AS INT) + CAST(g > 0 AS INT) AS INT) AS ops FROM fx_sam")
oracle("p05_aligned_bases", f"{SAM}, {sam_bases()}", "SELECT contig, p AS pos, CAST(base_ AS INT) AS base, count(*) AS n, CAST(sum(q) AS BIGINT) AS quality FROM based WHERE NOT clipped GROUP BY 1, 2, 3")
oracle("p06_strand_tags", SAM, "SELECT CAST(strand AS INT) AS bs_strand, count(*) AS reads FROM strands GROUP BY 1")
oracle("p10_read_positions", f"{SAM}, {sam_bases((2, 1), (0, 3))}", "SELECT CAST(second AS INT) AS is_second, CAST(read_pos AS INT) AS read_pos, CAST(trimmed AS INT) AS trimmed, count(*) AS n FROM based WHERE NOT clipped GROUP BY 1, 2, 3")
oracle("p08_soft_clips", SAM, "SELECT contig, CAST(rev AS INT) AS is_reverse, CAST(sum(a + g) AS BIGINT) AS n FROM usable GROUP BY 1, 2 HAVING sum(a + g) > 0")
oracle("p09_mate_overlap", f"{SAM}, {sam_bases()}, {OVERLAPS}", "SELECT contig, CAST(rev AS INT) AS is_reverse, CAST(overlap AS INT) AS overlap, count(*) AS n FROM marked WHERE NOT clipped GROUP BY 1, 2, 3")
oracle("f04_mate_filters", SAM, "SELECT reason, count(*) AS reads, CAST(sum(rl) AS BIGINT) AS bases FROM reasons GROUP BY 1")
oracle("a04_base_reasons", f"{SAM}, {sam_bases((2, 1), (0, 3))}, {OVERLAPS}", "SELECT CASE WHEN clipped THEN 'clipped' WHEN overlap THEN 'overlap' WHEN trimmed THEN 'trimmed' WHEN q < 20 THEN 'low_qual' ELSE 'passed' END AS reason, count(*) AS n FROM marked GROUP BY 1")
oracle("a24_read_quality", SAM, "SELECT ord, CAST(floor(list_sum(qs) / len(qs)) AS INT) AS mean_qual FROM quals")
oracle("p26_template_quality", f"{SAM}, {TEMPLATES % 'tpl'}", "SELECT contig, qname, coalesce(fwd_pos, 0) AS fwd_pos, coalesce(rev_pos, 0) AS rev_pos, CAST(bs_strand AS INT) AS bs_strand, mates, mean_mapq, mean_qual, ord FROM tpl")
oracle("w02_template_duplicates", f"{SAM}, {TEMPLATES % 'tpl'}", "SELECT contig, qname, ord, n_dup FROM ranked WHERE rn = 1")
FROM_READS = f"""{SAM}, {TEMPLATES % "(SELECT * FROM tpl WHERE mates = 2 OR NOT paired)"}, chosen AS (SELECT u.* FROM usable u JOIN ranked k ON k.contig = u.contig AND k.qname = u.qname AND rn = 1),
  {sam_bases((2, 1), (0, 3), "chosen")}, {OVERLAPS.replace("FROM usable", "FROM chosen")}, {fx("fx_ref")},
  fx_bases AS (SELECT m.contig, p AS pos, ref, CAST(strand AS INT) AS bs_strand, ori, mapq, CAST(q AS INT) AS qual, CAST(base_ AS INT) AS base FROM marked m JOIN fx_ref x ON x.contig = m.contig AND x.pos = m.p WHERE NOT clipped AND NOT overlap AND NOT trimmed)"""
oracle("r01_sites_from_reads", SITES.replace(fx("fx_bases"), FROM_READS, 1), "SELECT contig, pos, dp, gt, phred, flt, filter, ft, alt FROM sites")


oracle("f09_base_filter", fx("fx_bases"), "SELECT CASE WHEN qual < 20 THEN 'low_qual' ELSE 'passed' END AS reason, count(*) AS n FROM fx_bases GROUP BY 1")
oracle("p12_channel", f"{fx('fx_bases')}, {CHANNELS}", "SELECT contig, pos, channel, count(*) AS n FROM ch GROUP BY 1, 2, 3")
oracle("a01_pileup", PILE, f"SELECT contig, pos, n, {ALL16}, {', '.join(f'q{c}' for c in CH)}, mq2 FROM pile")
oracle("a02_depths", PILE, "SELECT contig, pos, dp, dp1, d_inf FROM pile")
oracle("p25_site_quality", QUALITY, f"SELECT contig, pos, aq, mq, {', '.join(f'm{c}' for c in CH)} FROM qual0")
oracle("m01_error_model", fx("fx_bases") + f", q AS (SELECT DISTINCT qual AS q FROM fx_bases), k AS (SELECT q, least(pow(10.0::DOUBLE, -q / 10.0::DOUBLE), 0.5::DOUBLE) AS e, {k_of('q')} AS k FROM q), l AS (SELECT *, ln(k) AS ln_k, ln(0.5 + k) AS ln_k_half, ln(1 + k) AS ln_k_one FROM k)", f"SELECT q, {r6('e', 'k', 'ln_k', 'ln_k_half', 'ln_k_one')} FROM l")
oracle("m02_methylation_mle", MLE, f"SELECT contig, pos, {r6(*[f'z{i}' for i in range(6)])} FROM mle")
oracle("m03_genotype", SITES, f"SELECT contig, pos, gt, phred, qd, {r6(*[f'gl{g}' for g in range(10)])} FROM sites")
oracle("m04_fisher", f"{PILE}, t AS (SELECT contig, pos, {fisher('s0c0', 's0c1', 's1c0', 's1c1')} AS p FROM pile)", f"SELECT contig, pos, {r6('p')} FROM t")
oracle("p22_strand_bias", SITES, f"SELECT contig, pos, {r6('fp')}, fs FROM sites")
ORDER = "(VALUES (0, 'A', 'A'), (1, 'A', 'C'), (2, 'A', 'G'), (3, 'A', 'T'), (4, 'C', 'C'), (5, 'C', 'G'), (6, 'C', 'T'), (7, 'G', 'G'), (8, 'G', 'T'), (9, 'T', 'T')) v(g, a, b)"
oracle("p23_gl_list", f"""{SITES}, alleles AS (SELECT contig, pos, rl, right(concat(rl, replace(alt, ',', '')), 1) AS last_, concat(rl, replace(alt, ',', '')) AS al FROM sites),
  lg AS (SELECT contig, pos, UNNEST([{', '.join(str(g) for g in range(10))}]) AS g, UNNEST([{', '.join(f'gl{g}' for g in range(10))}]) AS gl FROM sites),
  used AS (SELECT lg.contig, lg.pos, greatest(gl, -99.999::DOUBLE) AS gl, a = rl AND b = rl AS is_ref, a = last_ AND b = last_ AS is_last FROM lg JOIN {ORDER} ON v.g = lg.g JOIN alleles x ON x.contig = lg.contig AND x.pos = lg.pos AND contains(al, a) AND contains(al, b)),
  both_ AS (SELECT contig, pos, count(*) AS n, max(gl) FILTER (WHERE is_ref) AS gl_ref, max(gl) FILTER (WHERE is_last) AS gl_alt FROM used GROUP BY 1, 2)""",
       f"SELECT contig, pos, n, {r6('gl_ref', 'gl_alt')} FROM both_")
oracle("p24_counts_qualities", SITES, f"SELECT contig, pos, concat_ws(',', {', '.join(f'c{c}' for c in CH)}) AS mc8, concat_ws(',', {', '.join(f'CASE WHEN c{c} > 0 THEN CAST(m{c} AS VARCHAR) END' for c in CH)}) AS amq FROM sites")
oracle("f13_site_filters", SITES, "SELECT contig, pos, flt, filter, ft FROM sites")
oracle("p13_alleles", SITES, "SELECT contig, pos, alt, call, mut, cs, iupac FROM sites JOIN muts USING (contig, pos)")


def around(view: str, value: str, letter: str) -> str:
    joins = " ".join(f"LEFT JOIN {view} n{i} ON n{i}.contig = x.contig AND n{i}.pos = x.pos + {d}" for i, d in enumerate((-2, -1, 1, 2)))
    parts = ", ".join(letter.format(f"{t}.{value}") for t in ("n0", "n1", "x", "n2", "n3"))
    return f"SELECT x.contig, x.pos, concat({parts}) AS cx FROM {view} x {joins}"


oracle("w03_context", f"""{SITES}, {fx('fx_ref')}, cc AS ({around('sites', 'iupac', "coalesce({}, 'N')")}), cr AS ({around('fx_ref', 'ref', "coalesce(substr('ACGT', {} + 1, 1), 'N')")})""", "SELECT cc.contig, cc.pos, cc.cx AS cx_call, cr.cx AS cx_ref FROM cc LEFT JOIN cr USING (contig, pos)")
oracle("w04_cpg_status", CPG, "SELECT contig, pos, cg, CAST(ref_cpg AS INT) AS ref_cpg FROM cpg")
oracle("w05_cpg_pairs", CPG, """SELECT CAST(ref_cpg AS INT) AS ref_cpg, count(*) AS "all", count(*) FILTER (WHERE flt = 0 AND flt_m = 0) AS passed FROM cpg WHERE cg = 'CG' AND cs = '-' GROUP BY 1""")
oracle("j08_reads_reference", fx("fx_bases", "fx_ref"), "SELECT substr('ACGT', r.ref + 1, 1) AS ref, substr('ACGT', base + 1, 1) AS base, count(*) AS n FROM fx_bases b JOIN fx_ref r USING (contig, pos) GROUP BY 1, 2")
oracle("a15_noncpg_profile", f"""{fx('fx_bases', 'fx_ref')}, nb AS (SELECT r.contig, r.pos FROM fx_ref r LEFT JOIN fx_ref a ON a.contig = r.contig AND a.pos = r.pos - 1 LEFT JOIN fx_ref b ON b.contig = r.contig AND b.pos = r.pos + 1
  WHERE (r.ref = 1 AND b.ref <> 2) OR (r.ref = 2 AND a.ref <> 1)),
  rb AS (SELECT CAST(qual % 16 AS INT) AS position, base, (bs_strand = 1 AND base = 1) OR (bs_strand = 2 AND base = 2) AS stay, (bs_strand = 1 AND base = 3) OR (bs_strand = 2 AND base = 0) AS turn
    FROM fx_bases JOIN nb USING (contig, pos) WHERE qual >= 20 AND qual < 63)""",
       """SELECT position, count(*) FILTER (WHERE stay) AS a, count(*) FILTER (WHERE turn) AS b, count(*) FILTER (WHERE NOT stay AND NOT turn AND base IN (1, 2)) AS c,
  count(*) FILTER (WHERE NOT stay AND NOT turn AND base IN (0, 3)) AS d FROM rb GROUP BY 1""")

SNPQ, MULTI = "length(alt) = 1", "contains(alt, ',')"


def both(test: str, prefix: str) -> str:
    return f"count(*) FILTER (WHERE {test}) AS \"{prefix}all\", count(*) FILTER (WHERE ({test}) AND flt = 0) AS \"{prefix}passed\""


oracle("a05_variant_totals", CPG, f"SELECT {both(SNPQ, 'snps_')}, {both(MULTI, 'multi_')} FROM written")
oracle("a06_snp_totals", CPG, f"SELECT {both('rs_found > 0', 'sites_')}, {both('''rs_found > 0 AND alt <> '' ''', 'variants_')} FROM written")
oracle("a08_mutations", CPG, f"SELECT mut, {both('TRUE', '')}, {both('rs_found > 0', 'known_')} FROM written WHERE mut IS NOT NULL GROUP BY 1")
CPGS = "cg = 'CG' AND cs IN ('+', '-')"
oracle("a09_quality_hist", CPG, f"""SELECT phred, 'all' AS category, count(*) AS n FROM written GROUP BY 1 UNION ALL SELECT phred, 'variant', count(*) FROM written WHERE alt <> '' GROUP BY 1
  UNION ALL SELECT phred, CASE WHEN ref_cpg THEN 'ref_cpg' ELSE 'nonref_cpg' END, count(*) FROM written WHERE {CPGS} GROUP BY 1, 2""")
oracle("a10_qc_hist", CPG, " UNION ALL ".join(f"SELECT '{s}' AS stat, {s} AS value, CAST(is_het AS INT) AS is_het, count(*) AS n FROM written GROUP BY 2, 3" for s in ("qd", "fs", "mq")))
oracle("a11_filter_matrix", CPG, "SELECT CAST(flt & 31 AS INT) AS filters, count(*) FILTER (WHERE NOT is_het) AS hom, count(*) FILTER (WHERE is_het) AS het FROM written GROUP BY 1")
oracle("a12_coverage", f"""{CPG}, own AS (SELECT dp AS depth, count(*) AS "all", count(*) FILTER (WHERE alt <> '') AS var, count(*) FILTER (WHERE {CPGS} AND ref_cpg) AS r, count(*) FILTER (WHERE {CPGS} AND NOT ref_cpg) AS n FROM written GROUP BY 1),
  inf AS (SELECT d_inf AS depth, count(*) FILTER (WHERE ref_cpg) AS ri, count(*) FILTER (WHERE NOT ref_cpg) AS ni FROM written WHERE {CPGS} GROUP BY 1)""",
       """SELECT depth, coalesce("all", 0) AS "all", coalesce(var, 0) AS var, coalesce(r, 0) AS cpg_ref, coalesce(n, 0) AS cpg_nonref, coalesce(ri, 0) AS cpg_ref_inf, coalesce(ni, 0) AS cpg_nonref_inf FROM own FULL JOIN inf USING (depth)""")
GC = f"""{fx('fx_ref_n')}, firsts AS (SELECT contig, min(pos) AS first FROM fx_ref_n WHERE ref IS NOT NULL GROUP BY 1),
gc AS (SELECT r.contig, CAST(floor((pos - first) / 100) AS INT) AS bin, first, CAST(CASE WHEN count(ref) < 100 THEN 255 ELSE count(*) FILTER (WHERE ref IN (1, 2)) END AS INT) AS gc
  FROM fx_ref_n r JOIN firsts f ON f.contig = r.contig WHERE pos >= first GROUP BY 1, 2, 3)"""
oracle("a17_gc_bins", GC, 'SELECT contig, bin, "first", gc FROM gc')
oracle("a13_coverage_gc", f"{PILE}, {GC}", "SELECT dp, gc, count(*) AS n FROM pile JOIN gc ON gc.contig = pile.contig AND gc.bin = CAST(floor((pos - first) / 100) AS INT) WHERE gc <= 100 GROUP BY 1, 2")
oracle("p30_gc_bin_of_site", f"{PILE}, {GC}", "SELECT pile.contig, pos, bin, gc FROM pile JOIN gc ON gc.contig = pile.contig AND pos - first >= 100 * bin AND pos - first < 100 * bin + 100")
oracle("a14_methylation_posterior", f"""{CPG}, ab AS (SELECT contig, pos, CAST(ref_cpg AS INT) AS ref_cpg, flt, CASE cs WHEN '+' THEN c5 ELSE c6 END AS a, CASE cs WHEN '+' THEN c7 ELSE c4 END AS b FROM written WHERE {CPGS}),
  grid AS (SELECT ab.*, CAST(i AS INT) AS bin, pow(i / 100.0::DOUBLE, a) * pow(1 - i / 100.0::DOUBLE, b) AS w FROM ab, (SELECT UNNEST(generate_series(0, 100)) AS i) WHERE a + b > 0),
  shares AS (SELECT ref_cpg, bin, flt, w / sum(w) OVER (PARTITION BY contig, pos) AS p FROM grid)""",
       "SELECT ref_cpg, bin, round(sum(p), 6) + 0.0::DOUBLE AS weight_all, round(coalesce(sum(p) FILTER (WHERE flt = 0), 0), 6) + 0.0::DOUBLE AS weight_passed FROM shares GROUP BY 1, 2")
oracle("a16_contig_rollup", CPG, f"SELECT coalesce(contig, 'all') AS contig, {both(SNPQ, 'snps_')}, {both(MULTI, 'multi_')}, {both('rs_found > 0', 'known_')} FROM written GROUP BY ROLLUP (contig)")
oracle("o02_coverage_sorted", PILE, "SELECT dp, count(*) AS n FROM pile GROUP BY 1 ORDER BY 1")
oracle("o06_deepest_sites", PILE, "SELECT contig, pos, dp FROM pile ORDER BY dp DESC, contig, pos LIMIT 100")

NAMES = """a AS (SELECT DISTINCT concat('c', s_nationkey) AS name FROM supplier), b AS (SELECT DISTINCT concat('c', c_nationkey) AS name FROM customer), c AS (SELECT concat('c', n_nationkey) AS name FROM nation),
  r AS (SELECT concat('c', r_regionkey) AS name FROM region), h AS (SELECT DISTINCT concat('c', s_suppkey) AS name FROM supplier)"""
oracle("j04_contig_sets", NAMES, "SELECT name, CAST(min(source) AS INT) AS source FROM (SELECT name, 0 AS source FROM a UNION ALL SELECT name, 1 FROM b UNION ALL SELECT name, 2 FROM c) GROUP BY 1")
oracle("u01_contig_intersection", NAMES, "SELECT name FROM c INTERSECT SELECT name FROM h INTERSECT SELECT name FROM r")
oracle("u03_contig_difference", NAMES, "SELECT name FROM c EXCEPT SELECT name FROM r")
REG = f"{fx('fx_regions')}, g AS (SELECT DISTINCT 'chr1' AS contig, start_pos, end_pos + start_pos % 90 AS end_pos FROM fx_regions)"
OVER = "(a.start_pos < b.start_pos OR (a.start_pos = b.start_pos AND a.end_pos < b.end_pos)) AND b.start_pos <= a.end_pos"
oracle("j06_region_overlap", REG, f"SELECT a.contig, a.start_pos, a.end_pos, b.start_pos AS start2, b.end_pos AS end2 FROM g a JOIN g b ON {OVER}")
oracle("f16_regions_kept", f"""RECURSIVE {REG}, n AS (SELECT *, row_number() OVER (PARTITION BY contig ORDER BY start_pos, end_pos) AS i FROM g),
  walk AS (SELECT contig, i, start_pos, end_pos, TRUE AS kept, end_pos AS reach FROM n WHERE i = 1 UNION ALL
    SELECT n.contig, n.i, n.start_pos, n.end_pos, n.start_pos > w.reach, CASE WHEN n.start_pos > w.reach THEN n.end_pos ELSE w.reach END FROM walk w JOIN n ON n.contig = w.contig AND n.i = w.i + 1)""",
       "SELECT contig, start_pos, end_pos FROM walk WHERE kept")
oracle("j10_region_sites", f"{PILE}, {fx('fx_regions')}", "SELECT r.contig, start_pos, count(*) AS sites, CAST(sum(dp) AS BIGINT) AS depth FROM pile p JOIN fx_regions r ON r.contig = p.contig AND pos BETWEEN start_pos AND end_pos GROUP BY 1, 2")
oracle("f12_emit", f"{PILE}, {fx('fx_regions')}", "SELECT contig, pos, dp FROM pile p WHERE EXISTS (SELECT 1 FROM fx_regions r WHERE r.contig = p.contig AND p.pos BETWEEN start_pos AND end_pos)")

oracle("j09_snp_lookup", CPG, "SELECT contig, pos, id, CAST(rs_found AS INT) AS rs_found FROM looked")
oracle("f11_homref_skip", CPG, "SELECT contig, pos, gt, CAST(rs_found AS INT) AS rs_found FROM written")
oracle("f19_maf_flag", fx("fx_snps"), "SELECT contig, pos, name, CAST(maf >= 0.25 OR pos % 5 = 0 AS INT) AS flagged FROM fx_snps")
oracle("j12_alias", f"{fx('fx_snps')}, al AS (SELECT concat('chr', n_nationkey % 4 + 1) AS alias, arg_min(n_name, n_nationkey) AS name FROM nation GROUP BY 1)", "SELECT al.name AS contig, pos, s.name AS snp FROM fx_snps s JOIN al ON alias = contig")
oracle("j13_selected", fx("fx_snps"), "SELECT contig, count(*) AS n FROM fx_snps WHERE pos % 3 = 0 GROUP BY 1")
oracle("a21_snp_bitmap", SNP, "SELECT contig, pos >> 6 AS bin, count(*) AS bits, count(*) FILTER (WHERE flagged) AS fq_bits, count(*) AS n FROM snp GROUP BY 1, 2")
oracle("a22_index_totals", SNP, "SELECT contig, count(*) AS snps, count(*) FILTER (WHERE flagged) AS flagged, min(pos >> 6) AS min_bin, max(pos >> 6) AS max_bin, count(DISTINCT regexp_replace(name, '[0-9]+$', '')) AS prefixes, max(in_bin) AS largest_bin FROM (SELECT *, count(*) OVER (PARTITION BY contig, pos >> 6) AS in_bin FROM snp) GROUP BY 1")
oracle("w09_bitmap_rank", SNP, "SELECT contig, pos, CAST(row_number() OVER (PARTITION BY contig, pos >> 6 ORDER BY pos) - 1 AS INT) AS rank FROM snp")
oracle("w08_bin_delta", SNP, "SELECT contig, bin, bin - coalesce(lag(bin) OVER (PARTITION BY contig ORDER BY bin), 0) AS delta FROM (SELECT DISTINCT contig, pos >> 6 AS bin FROM snp)")
oracle("p29_bins", fx("fx_snps"), "SELECT contig, pos, pos >> 6 AS bin, CAST(pos & 63 AS INT) AS \"offset\" FROM fx_snps")
oracle("p27_name_split", fx("fx_snps"), "SELECT name, 'rs' AS prefix, substr(name, 3) AS digits FROM fx_snps")
oracle("s12_snp_parse", fx("fx_snps"), "SELECT contig, pos, name FROM fx_snps")
oracle("s13_vcf_parse", fx("fx_snps"), "SELECT contig, pos, name FROM fx_snps WHERE pos % 3 <> 0")
oracle("s14_json_snps", f"""{fx('fx_snps')}, n AS (SELECT *, pos % 97 + CASE WHEN pos % 41 <= 50 THEN pos % 41 END AS a FROM fx_snps WHERE pos % 4 IN (2, 3)), m AS (SELECT *, a / 150.0::DOUBLE AS z FROM n)""",
       "SELECT contig, pos, name, round(least(z, 1 - z), 6) + 0.0::DOUBLE AS maf FROM m")
oracle("s14_json_props", "", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
oracle("s20_tokenise", "", "SELECT p_partkey, CAST(3 AS BIGINT) AS n, trim(p_name) AS \"first\", trim(p_type) AS \"last\" FROM part")
oracle("u05_union_inputs", fx("fx_snps"), "SELECT contig, pos, CASE WHEN pos % 2 = 0 THEN name ELSE concat('a', name) END AS name FROM fx_snps WHERE pos % 2 = 0 OR pos % 3 = 0")
oracle("s16_alias_file", "", "SELECT concat('r', n_regionkey) AS alias, arg_min(n_name, n_nationkey) AS name FROM nation WHERE n_nationkey > 2 GROUP BY 1")
oracle("s17_selected_names", fx("fx_snps"), "SELECT DISTINCT substr(name, 1, 4) AS name FROM fx_snps")
oracle("s20_white_space", "", "SELECT p_partkey, CAST(len(string_split(p_type, ' ')) + 1 AS BIGINT) AS n, p_brand AS \"last\" FROM part")
oracle("s04_header", "", "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS ix, n_name AS name, CAST(n_nationkey * 100 + 7 AS BIGINT) AS length, CASE WHEN n_nationkey % 2 = 0 THEN concat('x:', n_regionkey) ELSE '-' END AS species FROM nation")
oracle("s06_fasta", fx("fx_ref_n"), "SELECT contig, pos, ref FROM fx_ref_n WHERE ref IS NOT NULL")
oracle("s07_reference_string", fx("fx_ref_n", "fx_regions"), """SELECT r.contig, start_pos, start_pos + 9 AS end_pos, string_agg(coalesce(substr('ACGT', ref + 1, 1), 'N'), '' ORDER BY i) AS letters
  FROM (SELECT *, UNNEST(range(10)) AS i FROM fx_regions) r LEFT JOIN fx_ref_n x ON x.contig = r.contig AND x.pos = start_pos + i GROUP BY 1, 2, 3""")
oracle("s08_contig_sizes", "", "SELECT n_name AS name FROM nation")
oracle("s09_contig_bed", "", "SELECT n_name AS contig, CAST(n_nationkey * 10 + 1 AS BIGINT) AS start_pos, CAST(n_nationkey * 10 + n_regionkey AS BIGINT) AS end_pos FROM nation WHERE n_nationkey % 6 <> 0 AND n_regionkey > 0")
oracle("f17_regions_at_ends", f"{fx('fx_ref', 'fx_regions')}, sizes AS (SELECT contig, max(pos) - 30 AS n FROM fx_ref GROUP BY 1)", "SELECT r.contig, start_pos, least(end_pos, n) AS end_pos, CAST(end_pos > n AS INT) AS beyond FROM fx_regions r JOIN sizes s ON s.contig = r.contig WHERE start_pos <= n")
oracle("j07_contig_ids", READS, "SELECT contig, CAST(substr(contig, 4) AS INT) AS ix, count(*) AS reads FROM fx_reads WHERE contig <> 'chr2' GROUP BY 1, 2")
oracle("o01_out_of_order", SAM, "SELECT ord, contig, pos FROM (SELECT *, max(pos) OVER (PARTITION BY contig ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM fx_sam) WHERE pos < newest")
oracle("u06_distinct", fx("fx_snps"), "SELECT count(DISTINCT name) AS names, count(DISTINCT contig || '/' || pos) AS positions, count(DISTINCT contig) AS contigs FROM fx_snps")

oracle("st1_session_blocks", "", """SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (
    SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events)) GROUP BY user_id, s""")
oracle("st3_late_events", "", """SELECT event_type, count(*) FILTER (WHERE late) AS late, count(*) AS n FROM (
  SELECT event_type, ts < max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) - INTERVAL 10 MINUTE AS late FROM events) GROUP BY 1""")
oracle("st5_windows", "", """SELECT epoch_us(w) AS start_us, event_type, count(*) AS n FROM (SELECT event_type, UNNEST([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE,
  time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS w FROM events) GROUP BY 1, 2""")
oracle("st0_tumbling", "", "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
