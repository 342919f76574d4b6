"""What the corpus operators share: where intermediate tables go, and how Python batches are cut."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = 1 << 20  # of the table that tells which rows need not move
CHUNK_CHARS = 4_000_000  # text handled at once inside one Python task
BATCH_ROWS = 1_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or where that is unset
    (tests on one machine) a temporary one, which is then also set as the checkpoint folder. With
    executors on other machines the setting must be there: a ValueError says so."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    known = getattr(context, "_methyloom_dir", None)
    if known is None:
        local = tempfile.mkdtemp(prefix="methyloom-")
        atexit.register(shutil.rmtree, local, True)
        known = context._methyloom_dir = f"file://{local}"
        context.setCheckpointDir(known)
    return known


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below :func:`shared_dir` that nothing uses yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage, and a lost
    executor costs nothing that was already written. What was shuffled on the way goes when the write
    has ended, since nothing but the written table is read afterwards."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._methyloom_path = path
    relieve(spark)
    return out


def relieve(spark: SparkSession) -> None:
    """Let the driver collect its garbage once its heap has grown to half of what it may have: plans that
    ran are dead by then, and the heap shrinks again."""
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        gc.collect()  # what Python still refers to stays alive in the JVM
        spark.sparkContext._jvm.System.gc()


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing reads any more."""
    for table in tables:
        removed(table.sparkSession, table._methyloom_path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`fresh_path` through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def chunks(frames: Iterable[pd.DataFrame], column: str, limit: int = CHUNK_CHARS) -> Iterator[pd.DataFrame]:
    """Cut frames into pieces of whole rows holding about ``limit`` characters of ``column``; one
    longer text makes a piece of its own."""
    for frame in frames:
        start = held = 0
        for i, text in enumerate(frame[column]):
            size = len(text) if text is not None else 0
            if held and held + size > limit:
                yield frame.iloc[start:i]
                start, held = i, 0
            held += size
        if start < len(frame):
            yield frame.iloc[start:]


def release() -> None:
    """Give the memory that Arrow and the allocator hold for later back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` with :func:`release` at its end: Python workers serve many tasks, and what one leaves in its
    allocators adds to what the next ones need."""

    def whole(frames: Iterator) -> Iterator:
        try:
            yield from run(frames)
        finally:
            release()

    return whole


def over_texts(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """``mapInPandas`` for rows that hold texts: small Arrow batches (``BATCH_ROWS`` rows, set for the
    session where it asks for more), and memory that goes back after each task."""
    bounded_batches(df.sparkSession)
    return df.mapInPandas(releasing(run), schema)


def bounded_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def extended(schema: T.StructType, **fields: str) -> T.StructType:
    """The schema with more fields at its end; the given one stays as it is."""
    more = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields.items()]
    return T.StructType([*schema.fields, *more])


def touched(docs: DataFrame, keys: DataFrame, *on: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs`` that may have one of ``keys`` (all that have, and few others while keys are
    few), or with ``left_anti`` the rest: by a broadcast table of at most ``CELLS`` hash cells, so no text moves."""
    cell = F.pmod(F.xxhash64(*on), F.lit(CELLS)).cast("int")
    cells = keys.select(cell.alias("_cell")).distinct()
    return docs.withColumn("_cell", cell).join(F.broadcast(cells), "_cell", how).drop("_cell")


HOT = 1_000  # a key with more than this fraction of all rows is hot; there are fewer than that


def with_key_values(rows: DataFrame, values: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has one row for each key and, in ``count``, how many
    rows have it (``total``: all rows). Hot keys (fewer than ``HOT``) are joined by broadcast, and
    their rows are dealt by all they hold instead of their key, so none gathers in one task."""
    more = [c for c in values.columns if c != key]
    hot = values.filter(F.col(count) > total / HOT).select(F.col(key), F.struct(*more).alias("_hot"))
    rest = values.select(F.col(key).alias("_key"), F.struct(*more).alias("_own"))
    dealt = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*rows.columns))
    tagged = rows.join(F.broadcast(hot), key, "left").withColumn("_at", dealt)
    joined = tagged.join(rest, F.col("_at") == F.col("_key"), "left").withColumn("_own", F.coalesce("_hot", "_own"))
    return joined.filter("_own is not null").select(*rows.columns, "_own.*")


def text_size(text: str = "text"):
    """UTF-8 bytes of a text column, 0 for null."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
