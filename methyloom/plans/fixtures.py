"""Portable SQL views that derive reads, bases, references, SNPs and regions from the star-schema
tables; the same text runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FX_REF = """
SELECT concat('chr', CAST(k + 1 AS STRING)) AS contig, CAST(p_partkey + 1 AS BIGINT) AS pos, CAST((p_size + k) % 4 AS INT) AS ref
FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks
"""

#: The same with unknown bases at each contig's start.
FX_REF_N = """
SELECT contig, pos, CASE WHEN pos > 31 * CAST(substr(contig, 4) AS INT) THEN ref END AS ref
FROM (SELECT concat('chr', CAST(k + 1 AS STRING)) AS contig, CAST(p_partkey + 1 AS BIGINT) AS pos, CAST((p_size + k) % 4 AS INT) AS ref
      FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ks) r0
"""

FX_BASES = """
SELECT contig, pos, ref, bs_strand, ori, mapq, qual,
       CAST(CASE WHEN bs_strand = 1 AND raw = 1 AND ln % 4 <> 0 THEN 3 WHEN bs_strand = 2 AND raw = 2 AND ln % 4 <> 0 THEN 0 ELSE raw END AS INT) AS base
FROM (SELECT contig, pos, ref, bs_strand, ori, mapq, qual, ln, CASE WHEN q0 % 10 = 0 THEN (ref + 1 + ln % 3) % 4 ELSE ref END AS raw
      FROM (SELECT concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) AS contig, CAST(l_partkey + 1 AS BIGINT) AS pos,
                   CAST((p_size + l_suppkey % 5) % 4 AS INT) AS ref,
                   CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS bs_strand,
                   CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS ori, CAST(10 + l_orderkey % 51 AS INT) AS mapq,
                   CAST(12 + (CAST(l_quantity AS INT) * 7 + l_linenumber) % 32 AS INT) AS qual,
                   CAST(l_quantity AS INT) AS q0, l_linenumber AS ln
            FROM lineitem JOIN part ON p_partkey = l_partkey) b0) b1
"""

FX_READS = """
SELECT concat('chr', CAST(l_suppkey % 5 + 1 AS STRING)) AS contig, CAST(l_orderkey AS BIGINT) AS qname,
       CAST(l_orderkey * 20 + l_linenumber * 3 AS BIGINT) AS st,
       CAST(l_orderkey * 20 + l_linenumber * 3 + CAST(l_quantity AS BIGINT) AS BIGINT) AS en,
       CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS is_reverse,
       CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 0 END AS bs_strand, CAST(10 + l_partkey % 51 AS INT) AS mapq,
       CAST(1 + CASE WHEN l_partkey % 5 <> 0 THEN 2 ELSE 0 END + CASE WHEN l_partkey % 41 = 0 THEN 4 ELSE 0 END
              + CASE WHEN l_partkey % 43 = 0 THEN 8 ELSE 0 END + CASE l_linestatus WHEN 'F' THEN 0 ELSE 16 END
              + CASE WHEN l_linenumber % 2 = 0 THEN 128 ELSE 64 END + CASE WHEN l_partkey % 47 = 0 THEN 256 ELSE 0 END
              + CASE WHEN l_partkey % 53 = 0 THEN 512 ELSE 0 END + CASE WHEN l_partkey % 37 = 0 THEN 1024 ELSE 0 END AS INT) AS flag,
       CAST(l_partkey % 1400 AS INT) AS isize, CAST(l_quantity AS INT) AS l_qseq
FROM lineitem
"""

FX_SNPS = """
SELECT concat('chr', CAST(p_partkey % 5 + 1 AS STRING)) AS contig, CAST(p_partkey + 1 AS BIGINT) AS pos,
       concat('rs', CAST(1000 + p_partkey AS STRING)) AS name, CAST(p_size AS DOUBLE) / CAST(100 AS DOUBLE) AS maf
FROM part WHERE p_partkey % 7 = 0
"""

FX_REGIONS = """
SELECT concat('chr', CAST(n_nationkey % 5 + 1 AS STRING)) AS contig, CAST(n_nationkey * 70 + 1 AS BIGINT) AS start_pos,
       CAST(n_nationkey * 70 + 50 AS BIGINT) AS end_pos
FROM nation
"""

#: Alignments as text lines (value) and the numbers they are made of: soft clip a, match b, insertion
#: c, match d, deletion e, match f, soft clip g.
FX_SAM = """
SELECT *, concat_ws(chr(9), qname, CAST(flag AS STRING), contig, CAST(pos AS STRING), CAST(mapq AS STRING), cigar,
         CASE WHEN mate_contig = contig THEN '=' ELSE mate_contig END, CAST(mate_pos AS STRING), CAST(isize AS STRING), seq, qual, t1, t2) AS value
FROM (SELECT *, substr(repeat('ACGTNTGCAC', 6), CAST(1 + ok % 9 AS INT), rl) AS seq, substr(repeat('5?NBF:!', 10), CAST(1 + pk % 6 AS INT), rl) AS qual,
         concat(CASE WHEN a > 0 THEN concat(CAST(a AS STRING), 'S') ELSE '' END, CAST(b AS STRING), 'M', CASE WHEN c > 0 THEN concat(CAST(c AS STRING), 'I') ELSE '' END, CAST(d AS STRING), 'M',
                CASE WHEN e > 0 THEN concat(CAST(e AS STRING), 'D') ELSE '' END, CAST(f AS STRING), 'M', CASE WHEN g > 0 THEN concat(CAST(g AS STRING), 'S') ELSE '' END) AS cigar
      FROM (SELECT *, CAST(a + b + c + d + f + g AS INT) AS rl, CAST(b + d + e + f AS INT) AS span
            FROM (SELECT CAST(l_orderkey AS BIGINT) AS ok, CAST(l_partkey AS BIGINT) AS pk, CAST(l_orderkey * 8 + l_linenumber AS BIGINT) AS ord,
                         concat('r', CAST(l_orderkey AS STRING), '_', CAST(CAST(FLOOR(l_linenumber / 2) AS INT) AS STRING)) AS qname,
                         concat('chr', CAST(l_orderkey % 5 + 1 AS STRING)) AS contig,
                         CAST(l_orderkey % 97 * 20 + l_linenumber * 3 + l_partkey % 11 + 1 AS BIGINT) AS pos,
                         CASE WHEN l_partkey % 29 = 0 THEN 'chrX' ELSE concat('chr', CAST(l_orderkey % 5 + 1 AS STRING)) END AS mate_contig,
                         CAST(l_orderkey % 97 * 20 + l_linenumber * 3 + l_suppkey % 23 + 1 AS BIGINT) AS mate_pos,
                         CAST(10 + l_partkey % 51 AS INT) AS mapq, CAST(l_partkey % 1100 AS INT) AS isize,
                         CAST(CASE WHEN l_partkey % 7 <> 0 THEN 1 + CASE WHEN l_partkey % 5 <> 0 THEN 2 ELSE 0 END ELSE 0 END
                              + CASE l_linestatus WHEN 'F' THEN 0 ELSE 16 END + CASE WHEN l_linenumber % 2 = 0 THEN 128 ELSE 64 END
                              + CASE WHEN l_partkey % 37 = 0 THEN 1024 ELSE 0 END AS INT) AS flag,
                         CAST(l_linenumber % 3 AS INT) AS a, CAST(5 + l_partkey % 7 AS INT) AS b, CAST(l_suppkey % 3 AS INT) AS c, CAST(4 + l_orderkey % 5 AS INT) AS d,
                         CAST(l_linenumber % 4 AS INT) AS e, CAST(3 + l_partkey % 4 AS INT) AS f, CAST(l_suppkey % 2 AS INT) AS g,
                         CASE l_returnflag WHEN 'A' THEN 'XG:Z:CT' WHEN 'N' THEN 'XG:Z:GA' ELSE 'NM:i:0' END AS t1,
                         CASE l_linenumber WHEN 4 THEN 'ZS:Z:-+' WHEN 5 THEN 'YD:Z:f' ELSE 'AS:i:9' END AS t2
                  FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag
                        FROM lineitem GROUP BY l_orderkey, l_linenumber) li) n0) n1) n2
"""

VIEWS = {"fx_sam": FX_SAM, "fx_ref": FX_REF, "fx_ref_n": FX_REF_N, "fx_bases": FX_BASES, "fx_reads": FX_READS, "fx_snps": FX_SNPS, "fx_regions": FX_REGIONS}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables of a folder, without registering anything in the session."""
    text, used = VIEWS[name], {}
    for other in TABLES:
        for word in (f"FROM {other}", f"JOIN {other}"):
            if word in text:
                text = text.replace(word, f"{word.split()[0]} {{{other}}}")
                used[other] = table(spark, sf_dir, other)
    return spark.sql(text, **used)
