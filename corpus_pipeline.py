"""The corpus pipeline: stages that each work on all documents the stage before has kept.

Language ID, line dedup, near-duplicate removal, benchmark decontamination, byte-level BPE. Each stage
takes and returns the columns of ``documents``, but for the last, which returns the digests of the
ids. Texts that line dedup has emptied stay as empty documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methyloom.llm import adaptjoin, cgkdecon, crflang, linedup, segbpe
from methyloom.llm.common import documents, fresh_path, removed, stored
from methyloom.llm.queries import PATTERN, RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.4  # of the language's mean word probability


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that are no language's by their words; fill in a
    missing lang."""
    model = crflang.fit(docs)
    labelled = crflang.with_language(docs.select(*COLUMNS), model)
    kept = labelled.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of runs of two or more lines, and of long single lines."""
    return linedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8): the one of
    the smallest doc_id. Rows are found again by doc_id and text, so of rows that repeat a doc_id, or
    have none, each stays or goes by its own text; of rows equal in both one stays. Texts without words stay."""
    members = adaptjoin.jaccard_members(docs, width=5, percent=80, count_links=False).select("doc_id", "th", "comp")
    first = members.filter("comp is not null").groupBy("comp", "doc_id", "th").agg(F.count(F.lit(1)).alias("c"))
    first = first.groupBy("comp").agg(F.min(F.struct("doc_id", "th", "c")).alias("s")).select("s.*")
    alone = members.filter("comp is null").select("doc_id", "th").distinct().withColumn("c", F.lit(1).cast("long"))
    kept = stored(first.unionByName(alone), "kept").withColumnsRenamed({"doc_id": "_kept", "th": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("_th") == F.col("_hash"))
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_th")).join(kept, same)
    if not kept.filter("c > 1").isEmpty():
        rows = rows.filter("c = 1").unionByName(rows.filter("c > 1").dropDuplicates(["doc_id", "_th"]))
    return rows.select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return cgkdecon.decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and the text again from the ids, as digests."""
    return segbpe.digests(docs, RANKS, PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again; what the stage before has
    written goes once it has been read."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
