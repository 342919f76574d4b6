"""The registered queries: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adaptjoin, cgkdecon, crflang, jpegmedia, linedup, pfpdedup, reshard, secretscan, segbpe, tokenfiles
from .common import documents, fresh_path

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpegmedia.digests(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crflang.digests(documents(spark, sf_dir))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptjoin.jaccard_components(documents(spark, sf_dir), width=3, percent=90)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.digests(documents(spark, sf_dir))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfpdedup.digests(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, rewrite the shards that change, and describe every row from the files themselves."""
    placed = reshard.reshard(documents(spark, sf_dir).select("doc_id", "text"))
    path = fresh_path(spark, "shards")
    affected = reshard.rewrite(spark, placed, path)
    columns = ["doc_id", "size", "text_crc32", "shard"]
    same = placed.filter(~F.col("shard").isin(affected)) if affected else placed
    rows = same.select(*columns)
    if affected:
        files = spark.read.parquet(path)
        again = {"size": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, "text_crc32": F.crc32(F.coalesce("text", F.lit("")))}
        rows = files.withColumns(again).select(*columns).unionByName(rows)
    done = reshard.with_slots(rows)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(documents(spark, sf_dir))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segbpe.digests(documents(spark, sf_dir), RANKS, PATTERN)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cgkdecon.find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tokenfiles.write_token_files(documents(spark, sf_dir), TOKENIZER)
    return tokenfiles.read_token_files(spark, files)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_language_id": op2_language_id,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_line_dedup": op4_line_dedup,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_sharding": op6_sharding,
    "op7_secret_scans": op7_secret_scans,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_token_files": op10_token_files,
}

ORACLES: dict[str, str] = {"op4_line_dedup": linedup.DIGEST_SQL}
