"""Flat token files: unsigned integers of all documents back to back, 64-bit offsets, mapped on reading.

Documents are dealt by ranges of doc_id and sorted, so the files in order of their number hold the
corpus in ascending doc_id order. Each task writes three files of its partition: ``ids-N.bin``
(``uint16`` if the vocabulary allows, else ``uint32``), ``offsets-N.bin`` (``uint64``, documents + 1
entries, counted from the partition's first id) and ``docs-N.bin`` (``int64`` doc_ids). A partition's
place in the whole corpus, its base, is the prefix sum of the id counts before it; only those counts,
one per partition, reach the driver.

A task writes under a name of its own and renames at the end, so a retried or doubled task leaves one
whole file. Null texts count as empty: such documents hold the end id alone. Rows with the same
doc_id are kept apart, in order of their texts' hashes; a null doc_id comes first and reads back as
null (the lowest 64-bit integer stands for it in the file).
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fresh_path, over_texts
from .segbpe import SPACES, word_runs

CACHE_ENTRIES = 1_000_000  # runs remembered by a Python worker, some 200 MB
JOINED = 64  # runs encoded as one text
_spaces = frozenset(regex.findall(f"[{SPACES}]", "".join(map(chr, range(0xD800))) + "\ufeff"))
NO_ID = np.iinfo(np.int64).min

_encoders: dict[str, RunEncoder] = {}


class RunEncoder:
    """A tokenizer of the tokenizers library that encodes each distinct run of text once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        # runs are cut at white space; tokens added by hand may reach across that, then whole texts are encoded
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = any(t.lstrip or t.rstrip or t.single_word or t.normalized or t.content.split() != [t.content] for t in added)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        own = self.tokenizer.get_added_tokens_decoder()
        self.sizes = np.zeros(max([*vocabulary.values(), *own], default=0) + 1, np.int64)  # bytes of each id, a character each
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        for i, t in own.items():
            self.sizes[i] = len(t.content.encode("utf-8"))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in made]

    def ids_of_runs(self, runs: list[str]) -> Iterator[tuple[str, bytes]]:
        """Runs and their ids. Runs that a text may be cut before and after are encoded many at once, back to
        back, and the ids are dealt out by their bytes; where those do not meet the runs' ends, one by one."""
        single, joined = [], []
        for run in runs:
            (single if self.whole or run[0] not in " \n" or run[-1] in _spaces else joined).append(run)
        yield from zip(single, self.ids(single))
        parts = [joined[at : at + JOINED] for at in range(0, len(joined), JOINED)]
        for part, made in zip(parts, self.ids(["".join(part) for part in parts])):
            ends = np.cumsum([len(run.encode("utf-8")) for run in part])
            upto = np.cumsum(self.sizes[np.frombuffer(made, self.dtype)])
            at = np.searchsorted(upto, ends)
            if len(upto) and upto[-1] == ends[-1] and (upto[at] == ends).all():
                cuts = [0, *((at + 1) * self.dtype.itemsize).tolist()]
                yield from zip(part, [made[a:b] for a, b in zip(cuts[:-1], cuts[1:])])
            else:
                yield from zip(part, self.ids(part))

    def learn(self, runs: set[str]) -> None:
        """Remember the ids of runs; those the older memory holds move over without encoding."""
        if len(self.known) + len(runs) > CACHE_ENTRIES // 2:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        missing = []
        for run in runs:
            if (got := older.get(run)) is None:
                missing.append(run)
            else:
                known[run] = got
        for at in range(0, len(missing), 20_000):
            known.update(self.ids_of_runs(missing[at : at + 20_000]))

    def encode(self, texts: list[str], end: int) -> list[bytes]:
        tail, out = array(self.code, [end]).tobytes(), []
        for at in range(0, len(texts), 512):
            runs = [[text] * bool(text) if self.whole else word_runs(text) for text in texts[at : at + 512]]
            coded = [list(map(self.known.get, part)) for part in runs]
            holes = [(part, got, [i for i, x in enumerate(got) if x is None]) for part, got in zip(runs, coded) if None in got]
            new = {part[i] for part, _, at_i in holes for i in at_i}
            if new:
                self.learn(new)
                for part, got, at_i in holes:
                    for i in at_i:
                        got[i] = self.known[part[i]]
            out += [b"".join(got) + tail for got in coded]
        return out


def encoder(path: str) -> RunEncoder:
    if path not in _encoders:
        _encoders[path] = RunEncoder(path)
    return _encoders[path]


@dataclass(frozen=True)
class TokenFiles:
    """Where the files are, and each partition's number, documents, ids and base."""

    path: str
    dtype: str
    parts: tuple[tuple[int, int, int, int], ...]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> TokenFiles:
    """Encode ``docs`` (doc_id, text), append ``end_id`` to each document and write the files."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    fs, folder = _filesystem(path)
    fs.create_dir(folder, recursive=True)
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = encoder(tokenizer_path)
        fs, folder = _filesystem(path)
        number, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        names = [f"{kind}-{number:06d}.bin" for kind in ("ids", "offsets", "docs")]
        out, n_docs, n_ids = [], 0, 0
        for part in chunks(frames, "text"):
            if not out:
                out = [fs.open_output_stream(f"{folder}/.{mine}-{name}") for name in names]
            coded = made.encode([text or "" for text in part["text"]], end_id)
            out[0].write(b"".join(coded))
            sizes = np.array([len(x) // made.dtype.itemsize for x in coded], np.uint64)
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64) + np.uint64(n_ids)
            out[1].write(starts[:-1].astype("<u8").tobytes())
            ids = part["doc_id"]
            out[2].write(ids.fillna(NO_ID).astype("<i8").to_numpy().tobytes() if ids.isna().any() else ids.to_numpy().astype("<i8").tobytes())
            n_docs, n_ids = n_docs + len(part), int(starts[-1])
        if out:
            out[1].write(np.array([n_ids], "<u8").tobytes())
            for stream, name in zip(out, names):
                stream.close()
                fs.move(f"{folder}/.{mine}-{name}", f"{folder}/{name}")
            yield pd.DataFrame({"number": [number], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = sorted(over_texts(dealt, run, "number long, n_docs long, n_ids long").collect())
    bases = np.concatenate([[0], np.cumsum([r["n_ids"] for r in rows], dtype=np.int64)]) if rows else []
    parts = tuple((r["number"], r["n_docs"], r["n_ids"], int(base)) for r, base in zip(rows, bases))
    return TokenFiles(path, encoder(tokenizer_path).dtype.str, parts)


def _mapped(fs: pafs.FileSystem, name: str, dtype: str) -> np.ndarray:
    """The file's numbers: mapped where it is local to a mount, else read whole."""
    if fs.type_name == "local":
        return np.memmap(name, dtype=dtype, mode="r") if os.path.getsize(name) else np.empty(0, dtype)
    with fs.open_input_file(name) as file:
        return np.frombuffer(file.read(), dtype=dtype)


def read_token_files(spark: SparkSession, files: TokenFiles, rows: int = 5_000, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (and ``token_ids`` if wished) of every document, in tasks
    of one file each; ids are read document by document from the mapped file."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", token_ids array<long>" * with_ids
    if not files.parts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(list(files.parts), "number long, n_docs long, n_ids long, base long")
    path, dtype = files.path, files.dtype

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = _filesystem(path)
        for frame in frames:
            for number, base in zip(frame["number"], frame["base"]):
                ids = _mapped(fs, f"{folder}/ids-{number:06d}.bin", dtype)
                offsets = _mapped(fs, f"{folder}/offsets-{number:06d}.bin", "<u8").astype(np.int64)
                doc_ids = _mapped(fs, f"{folder}/docs-{number:06d}.bin", "<i8")
                for at in range(0, len(doc_ids), rows):
                    bounds = offsets[at : at + rows + 1]
                    own = [np.asarray(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                    part = pd.DataFrame({"doc_id": pd.array(doc_ids[at : at + rows], dtype="Int64"), "start": bounds[:-1] + base, "n_tokens": np.diff(bounds), "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in own]})
                    part.loc[part["doc_id"] == NO_ID, "doc_id"] = pd.NA
                    if with_ids:
                        part["token_ids"] = [x.astype(np.int64) for x in own]
                    yield part

    return over_texts(listed.repartition(len(files.parts), "number"), run, schema)
