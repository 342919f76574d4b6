"""Removal of long repeated byte strings by prefix-free parsing.

**Parse.** A rolling hash of ``trigger`` units cuts texts into phrases: a place where the hash is 0 modulo
``period`` begins one. What a window of ``length`` units holds decides alone which triggers it holds,
so equal windows, wherever they start, have their first trigger at the same offset (their anchor).
Windows whose first ``REACH_SHARE`` begin no phrase, in text of few distinct words, take the least hash
there instead. All windows of one anchor form a segment: a phrase's suffixes together with what
follows it in the parse. Units are bytes; :func:`passages` runs the same over words.

**Order.** Suffixes need telling apart only within ``length`` units, so places in corpus order are
named by hashes instead of ranks: neighbours of a suffix array whose longest common prefix is
``length`` or more are just the places of one name. The suffix arrays of dictionary and parse
themselves are not built (the README gives the figures). Two levels of names keep the work small, as
the dictionary and the parse do for a suffix array of a whole text:

1. the *core* of a segment, the units that all its windows share after the anchor; segments of
   unique cores have no repeated window and drop out;
2. the *context*, all units of the segment's windows; a context that occurs twice repeats in every
   window. Only contexts that are unique beside others of the same core, the edges of repeated
   regions, are opened into finer segments and then single windows, against one member of each
   other context.

Names are polynomials modulo the prime 2**61 - 1 over random values of units, so text made of regular patterns
collides no more than any other; a context's name is compared together with its core's. Cores are
counted before rows are joined and hot ones joined by broadcast, so no group of copies meets in one
task. Texts move between executors only where they hold something to open or to remove.

Null texts count as empty. Texts shorter than ``length`` stay. Rows that repeat doc_id and text are
documents like any others, so each is a copy of the other; texts of one doc_id are told apart by a
64-bit hash, null doc_ids included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .adaptjoin import mix, word_hashes
from .common import chunks, dropped, over_texts, stored, touched, with_key_values

LENGTH = 400
PASSAGE_WORDS = 51
REACH_SHARE = 0.7  # of the window's length: how far an anchor may lie from its start
PRIME = (1 << 61) - 1
_BASE = 0x1A2B3C4D5E6F7081 % PRIME
_INVERSE = pow(_BASE, -1, PRIME)


@dataclass(frozen=True)
class Units:
    """What windows are made of, and how they are parsed."""

    words: bool
    length: int
    trigger: int
    period: int
    steps: tuple[int, ...]  # windows of the finer segments that edges are opened into
    chunk: int = 600_000  # characters of text handled at once

    def split(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The values of all texts' units, and each text's first unit and number of units."""
        if self.words:
            values, bounds = word_hashes(texts)
            return values, bounds[:-1], np.diff(bounds)
        coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(x) for x in coded], np.int64)
        return _BYTES[np.frombuffer(b"".join(coded), np.uint8)], np.cumsum(size) - size, size


def byte_units(length: int = LENGTH) -> Units:
    return Units(False, length, 12, 80, (8, 1), 80_000)  # arrays of so many units stay in a core's cache


def word_units(length: int = PASSAGE_WORDS) -> Units:
    return Units(True, length, 3, 16, (1,))


_BYTES = mix(np.arange(256, dtype=np.uint64) + np.uint64(1000))
_P, _61, _31, _30, _32, _29 = (np.uint64(x) for x in (PRIME, 61, 31, 30, 32, 29))
_LOW31, _LOW30, _LOW32, _LOW29 = (np.uint64((1 << k) - 1) for k in (31, 30, 32, 29))


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _61)
    return np.where(x >= _P, x - _P, x)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, for factors below it."""
    a1, a0, b1, b0 = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return reduced(np.uint64(2) * a1 * b1 + (middle >> _30) + ((middle & _LOW30) << _31) + a0 * b0)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime; up to 2**20 of them are kept."""
    known = _powers.get(base, np.ones(1, np.uint64))
    while len(known) < n:
        known = np.concatenate([known, product(known, np.uint64(pow(base, len(known), PRIME)))])
    if len(known) <= 1 << 20:
        _powers[base] = known
    return known[:n]


class Hasher:
    """Names of any stretch of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        terms = product(reduced(values), powers(_BASE, len(values)))
        low, high = np.cumsum(terms & _LOW32), np.cumsum(terms >> _32)
        total = reduced(reduced(low) + (high >> _29) + ((high & _LOW29) << _32))
        self.total = np.concatenate([np.zeros(1, np.uint64), total])
        self.back = powers(_INVERSE, len(values) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(product(reduced(self.total[end] + (_P - self.total[start])), self.back[start]))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all stretches of ``width`` values, from those of powers of two."""
    count, level, done, step = len(values) - width + 1, values, None, 1
    held = 0
    while held < width:
        if width & step:
            done = level[:count] if done is None else done * _ODD + level[held : held + count]
            held += step
        if 2 * step <= width:
            level = level[:-step] * np.uint64((2 * step + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1) + level[step:]
        step *= 2
    return mix(done)


_ODD = np.uint64(0xD6E8FEB86659FD93)


def _least(rolled: np.ndarray, width: int) -> np.ndarray:
    """For each place, where the least of ``width`` values from there on stands, the first of equals
    (by their upper halves)."""
    keyed = rolled & np.uint64(0xFFFFFFFF00000000) | np.arange(len(rolled), dtype=np.uint64)
    done = 1
    while done < width:
        step = min(done, width - done)
        keyed[:-step] = np.minimum(keyed[:-step], keyed[step:])
        done += step
    return (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments(texts: list[str | None], units: Units) -> tuple[np.ndarray, ...]:
    """Of all windows of all texts, by anchor: text number, first and last window start and
    anchor (in the text), core name and context name."""
    values, first, size = units.split(texts)
    length = units.length
    count = np.maximum(size - length + 1, 0)
    empty = np.empty(0, np.int64)
    if not count.sum():
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), count)
    start = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    name = Hasher(values)
    width = min(units.trigger, length)
    rolled = rolling(values, width)
    reach = min(int(length * REACH_SHARE), length - width)
    marks = np.append(np.nonzero(rolled % np.uint64(units.period) == 0)[0], 1 << 60)
    anchor = marks[np.searchsorted(marks, start)]
    level = np.ones(len(start), np.uint64)
    rest = np.nonzero(anchor - start > reach)[0]
    if len(rest):
        anchor[rest], level[rest] = _least(rolled, reach + 1)[start[rest]], 2
    change = np.ones(len(start), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (level[1:] != level[:-1]) | (owner[1:] != owner[:-1])
    lo_at = np.nonzero(change)[0]
    hi_at = np.append(lo_at[1:], len(start)) - 1
    lo, hi, anchor, level, owner = start[lo_at], start[hi_at], anchor[lo_at], level[lo_at], owner[lo_at]
    core = mix(name(anchor, anchor + length - reach) + level)
    context = mix(name(lo, hi + length) + _shape(anchor, lo, hi))
    return owner, lo - first[owner], hi - first[owner], anchor - first[owner], core, context


def _shape(anchor: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix(((anchor - lo) << 20 | (anchor - hi)).astype(np.uint64))


ROWS = "doc_id long, th long, lo int, hi int, anchor int, core long, context long"


def _segment_rows(docs: DataFrame, units: Units) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "text", units.chunk):
            owner, lo, hi, anchor, core, context = segments(list(part["text"]), units)
            ids = part["doc_id"].astype("Int64").array[owner] if len(owner) else pd.array([], "Int64")
            yield pd.DataFrame({"doc_id": ids, "th": part["th"].to_numpy()[owner], "lo": lo, "hi": hi, "anchor": anchor, "core": core.astype(np.int64), "context": context.astype(np.int64)})

    return over_texts(docs, run, ROWS)


def _finer_rows(opened: DataFrame, units: Units, step: int) -> DataFrame:
    """Segments of ``step`` windows, cut from those listed beside each text at multiples of ``step`` from
    their anchors; a core is what all windows of an uncut segment share."""
    length = units.length

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "text", units.chunk // 2):
            values, first, _ = units.split(list(part["text"]))
            listed = [np.array([(s["lo"], s["hi"], s["anchor"], s["core"]) for s in own], np.int64).reshape(-1, 4) for own in part["list"]]
            row = np.repeat(np.arange(len(part)), [len(x) for x in listed])
            lo, hi, anchor, core = np.concatenate(listed).T
            n = (anchor - lo) // step - (anchor - hi) // step + 1
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - (anchor - hi) // step, n)
            row, lo, hi, anchor, core = (np.repeat(x, n) for x in (row, lo, hi, anchor, core))
            near = anchor - k * step  # the last window start of the uncut segment
            lo, hi, at = np.maximum(lo, near - step + 1), np.minimum(hi, near), first[row]
            name = Hasher(values)
            inner = mix(name(at + near, at + near - step + 1 + length) + mix(core.astype(np.uint64) + k.astype(np.uint64)))
            whole = mix(name(at + lo, at + hi + length) + _shape(anchor, lo, hi))
            ids = part["doc_id"].astype("Int64").array[row]
            yield pd.DataFrame({"doc_id": ids, "th": part["th"].to_numpy()[row], "lo": lo, "hi": hi, "anchor": anchor, "core": inner.astype(np.int64), "context": whole.astype(np.int64)})

    return over_texts(opened.select("doc_id", "th", "text", "list"), run, ROWS)


def _same_text() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))


def _with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts that have a list, with it, and perhaps a few others."""
    rows = touched(docs, lists, "doc_id", "th")
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "list")
    return rows.join(lists, _same_text(), "left").drop("_id", "_th")


def _classified(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of stored segments (which are dropped): those that repeat as a whole, and one member of each
    context of the cores where some context is unique beside others."""
    total = rows.count()
    cores = rows.groupBy("core").agg(F.count(F.lit(1)).alias("c"), F.min("context").alias("c1"), F.max("context").alias("c2")).filter("c > 1")
    found = stored(with_key_values(rows, cores.select("core", "c", (F.col("c1") != F.col("c2")).alias("mixed")), "core", "c", total).drop("c"), f"{name}-repeated")
    dropped(rows)
    whole = found.filter("not mixed").select("doc_id", "th", "lo", "hi")
    mixed = found.filter("mixed").drop("mixed")
    contexts = stored(mixed.groupBy("core", "context").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "th", "lo", "hi", "anchor")).alias("p")), f"{name}-contexts")
    often = contexts.filter("c > 1").select(F.xxhash64("core", "context").alias("both"), "core", "context", "c")
    many = with_key_values(mixed.withColumn("both", F.xxhash64("core", "context")), often.withColumnsRenamed({"core": "core2", "context": "context2"}), "both", "c", total)
    whole = whole.unionByName(many.filter("core = core2 and context = context2").select("doc_id", "th", "lo", "hi"))
    edges = contexts.groupBy("core").agg(F.min("c").alias("least"), F.count(F.lit(1)).alias("c")).filter("least = 1").select("core", "c")
    opened = with_key_values(contexts.select("core", "p"), edges, "core", "c", total)
    return whole, opened.select("p.*", "core")


def repeated_windows(docs: DataFrame, units: Units) -> DataFrame:
    """doc_id, th, lo and hi: ranges of starts of windows that also start elsewhere. ``docs`` has
    doc_id, text and th, a hash that tells apart rows of one doc_id."""
    out, opened = _classified(stored(_segment_rows(docs, units), "segments"), "segments")
    for step in units.steps:
        # rows that repeat doc_id and text give the same segments; their contexts are not unique anyway
        lists = stored(opened.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi", "anchor", "core")).alias("list")), "opened")
        finer = _finer_rows(_with_lists(docs, lists).filter("list is not null"), units, step)
        whole, opened = _classified(stored(finer.distinct(), "finer"), "finer")
        dropped(lists)
        out = out.unionByName(whole)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end bytes) and th (the text's
    hash) of every row of ``docs`` (doc_id, text)."""
    docs = keyed(docs)
    starts = repeated_windows(docs, byte_units(length))
    lists = stored(starts.groupBy("doc_id", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("list")), "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, th long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "text", 2_000_000):
            rows = []
            for doc_id, text, own, th in zip(part["doc_id"], part["text"], part["list"], part["th"]):
                raw = (text or "").encode("utf-8", "surrogatepass")
                spans = merged([(s["lo"], s["hi"] + length) for s in own] if own is not None else [])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((doc_id, len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans], th))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "th"]).astype({"doc_id": "Int64"})

    changed = over_texts(_with_lists(docs, lists).select("doc_id", "text", "list", "th"), run, schema)
    others = touched(docs, lists, "doc_id", "th", how="left_anti")
    zero = F.lit(0).cast("long")
    others = others.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), "th")
    return changed.unionByName(others)


def passages(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, th and n_passage_words of every text that has any: words (A-Z lower-cased, parted by white
    space) that lie in a run of ``words`` words that also starts elsewhere. Nothing is removed."""
    starts = repeated_windows(keyed(docs), word_units(words))
    lists = starts.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("list"))
    covered = F.expr(f"""aggregate(list, named_struct('end', 0, 'n', 0L), (s, x) -> named_struct(
        'end', greatest(s.end, x.hi + {words}), 'n', s.n + greatest(0, x.hi + {words} - greatest(s.end, x.lo))), s -> s.n)""")
    return lists.select("doc_id", "th", covered.alias("n_passage_words"))


def digests(docs: DataFrame) -> DataFrame:
    """The removal's digests, and how many words lie in passages of over 50 words that stand elsewhere
    too (these may be shorter than what is removed)."""
    said = passages(docs).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "n_passage_words")
    said = stored(said, "passages")
    rows = remove_repeats(docs).join(said, _same_text(), "left")
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.coalesce("n_passage_words", F.lit(0)).cast("long").alias("n_passage_words"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted union of intervals; touching ones join."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
