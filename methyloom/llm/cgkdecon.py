"""Benchmark decontamination by CGK embeddings.

A document is contaminated by an item if some run of its words is within ``floor(distance * n)`` word
edits (insert, delete, replace) of the item's n words. Words are runs of letters, digits and bytes
above 127; A-Z count as a-z.

**Candidates.** A CGK walk reads a word sequence with a pointer; at each of 3 n steps it writes the
word under the pointer, and a random bit chosen by step and word says whether the pointer moves on.
Two sequences few edits apart fall into step again, so their edit distance becomes Hamming distance.
The index holds a key for each item and walk: what the walk wrote at ``BITS`` sampled steps. A window
of a document as long as an item takes as candidates all items that have its own key of some walk.
The number of walks is the least that reaches ``RECALL`` on simulated copies at the threshold
(:func:`walks_for`); it depends on the items' length.

Windows are embedded only where they can match: n words with k edits keep a run of
``ceil((n - k) / (k + 1))`` words in common, so windows start where a document shares such a run with an
item, shifted by up to k words either way, all of them. This filter loses nothing, whatever the texts.

**Verification.** The exact edit distance of the item to the best run near the candidate decides.

Items without words match nothing; null or empty texts are clean. Equal items each match, and rows that
repeat a doc_id or lack one are each judged by their own text. The benchmark is a stated query set:
it is read in blocks of ``BLOCK_ITEMS`` items, so what goes to the workers is bounded.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .adaptjoin import mix, word_hashes
from .common import bounded_batches, chunks, over_texts, releasing

DISTANCE = 0.2
BITS = 3
RECALL = 0.97
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 32_000_000

_NONWORD = np.ones(256, bool)
_NONWORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(texts, _NONWORD)


def embed(windows: list[np.ndarray], seed: int) -> list[np.ndarray]:
    """CGK walks of word sequences under one random function; past the end a pad is written."""
    if not windows:
        return []
    n = np.array([len(x) for x in windows])
    table = np.zeros((len(windows), int(n.max()) + 1), np.uint64)
    for i, x in enumerate(windows):
        table[i, : len(x)] = x
    at, rows = np.zeros(len(windows), np.int64), np.arange(len(windows))
    out = np.zeros((len(windows), 3 * int(n.max())), np.uint64)
    for step in range(out.shape[1]):
        here = table[rows, np.minimum(at, n)]
        out[:, step] = here
        coin = mix(here ^ np.uint64((seed * 1_000_003 + step) & (2**63 - 1))) & np.uint64(1)
        at = np.minimum(at + coin.astype(np.int64), n)
    return [x[: 3 * k] for x, k in zip(out, n)]


def best_run(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edits between the item and any run of ``text``, and that run's start and end."""
    n, m = len(item), len(text)
    cost, start = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for i in range(n):
        differ = (text != item[i]).astype(np.int64)
        sub, gone = cost[:-1] + differ, cost[1:] + 1
        now, came = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        now[0], came[0] = i + 1, 0
        take = sub <= gone
        now[1:] = np.where(take, sub, gone)
        came[1:] = np.where(take, start[:-1], start[1:])
        low = np.minimum.accumulate(now - steps)  # insertions: from the best place to the left
        first = np.maximum.accumulate(np.where(now - steps == low, steps, 0))
        cost, start = low + steps, came[first]
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


@functools.cache
def agreement(n: int, edits: int, pairs: int = 96, walks: int = 16) -> np.ndarray:
    """For simulated pairs of n words and a copy with so many edits, the share of early steps that agree
    under each of some walks."""
    rng = np.random.default_rng((n, edits))
    ones, twos = [], []
    for _ in range(pairs):
        one = rng.integers(1, 1 << 62, n, dtype=np.uint64)
        two = one.tolist()
        for at in np.sort(rng.choice(n, edits, replace=False))[::-1].tolist():
            kind = int(rng.integers(3))
            new = [int(rng.integers(1, 1 << 62))]
            two[at : at + 1] = [] if kind == 0 else new if kind == 1 else [two[at], *new]
        two = two[:n] + [0] * (n - len(two))
        ones.append(one)
        twos.append(np.array(two, np.uint64))
    used = early(n)
    same = [[np.mean(x[:used] == y[:used]) for x, y in zip(embed(ones, r), embed(twos, r))] for r in range(walks)]
    return np.array(same)


def early(n: int) -> int:
    """Steps that keys are sampled from: by then few walks have come to the end, after which all write
    the same pad."""
    return max(1, 3 * n // 2)


@functools.cache
def walks_for(n: int, edits: int, bits: int = BITS, recall: float = RECALL) -> int:
    """Walks after which all but ``1 - recall`` of simulated copies have shared a key with the original."""
    missed = 1 - agreement(n, edits) ** bits  # of each pair, by one walk
    per_walk = np.log(np.maximum(missed, 1e-9)).mean(axis=0)
    number = 1
    while np.exp(number * per_walk).mean() > 1 - recall and number < 512:
        number += 1
    return number


def rounded_up(n: int) -> int:
    """Lengths for which walks are counted: an eighth apart."""
    step = max(1, (1 << (n.bit_length() - 1)) // 8)
    return -(-n // step) * step


class Benchmark:
    """Items with their shared-run filter and the index of their walks, as the workers use them."""

    def __init__(self, items: list[tuple[int, str | None]], distance: float = DISTANCE, bits: int = BITS, recall: float = RECALL):
        flat, bounds = words_of([text for _, text in items])
        self.items = [(item_id, flat[a:b]) for (item_id, _), a, b in zip(items, bounds[:-1], bounds[1:]) if b > a]
        self.edits = [int(distance * len(x) + 1e-9) for _, x in self.items]
        self.bits = bits
        seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for i, (_, x) in enumerate(self.items):
            q = -(-(len(x) - self.edits[i]) // (self.edits[i] + 1))
            for o, h in enumerate(runs(x, q).tolist()):
                seeds[q][h].append((i, o))
        self.seeds = {q: dict(x) for q, x in seeds.items()}
        self.sorted = {q: np.array(sorted(x), np.uint64) for q, x in self.seeds.items()}
        self.filters = {}
        for q, x in self.sorted.items():
            self.filters[q] = np.zeros(1 << 20, bool)
            self.filters[q][(x & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.walks = {len(x): walks_for(rounded_up(len(x)), int(distance * rounded_up(len(x)) + 1e-9), bits, recall) for _, x in self.items}
        keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for r in range(max(self.walks.values(), default=0)):
            own = [i for i, (_, x) in enumerate(self.items) if r < self.walks[len(x)]]
            keys.append(self.keys([self.items[i][1] for i in own], r))
            owners.append(np.array(own, np.int64))
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(keys, kind="stable")
        self.index, self.owners = keys[order], owners[order]

    def keys(self, windows: list[np.ndarray], walk: int) -> np.ndarray:
        """What a walk wrote at its sampled steps, as one number with the length and the walk."""
        out = np.empty(len(windows), np.uint64)
        for i, written in enumerate(embed(windows, walk)):
            key = np.array([len(windows[i]) << 32 | walk], np.uint64)
            for word in written[sampled(len(windows[i]), walk, self.bits)]:
                key = mix(key) + word
            out[i] = mix(key)[0]
        return out

    def candidates(self, text: np.ndarray, hits: list[tuple[int, int]]) -> tuple[set[tuple[int, int]], int]:
        """(item, window start) that the index gives for the windows at and around the shared runs
        (item, start), one for each run, and how many windows had no candidate."""
        open_ = {}
        for n, start in sorted({(len(self.items[i][1]), start) for i, start in hits}):
            k = max(self.edits[i] for i, s in hits if s == start and len(self.items[i][1]) == n)
            open_[n, start] = [s for s in sorted(range(start - k, start + k + 1), key=lambda s: abs(s - start)) if 0 <= s < len(text)] or [max(0, min(start, len(text) - 1))]
        wanted = defaultdict(set)
        for i, start in hits:
            wanted[len(self.items[i][1]), start].add(i)
        found: set[tuple[int, int]] = set()
        padded = np.concatenate([text, np.zeros(max((n for n, _ in open_), default=0), np.uint64)])
        for walk in range(max((self.walks[n] for n, _ in open_), default=0)):
            tried = [(n, start, s) for (n, start), own in open_.items() if walk < self.walks[n] for s in own]
            if not tried:
                break
            keys = self.keys([padded[s : s + n] for n, _, s in tried], walk)
            a, b = np.searchsorted(self.index, keys, "left"), np.searchsorted(self.index, keys, "right")
            for j in np.nonzero(b > a)[0]:
                n, start, s = tried[j]
                for i in self.owners[a[j] : b[j]].tolist():
                    found.add((i, s))
                    wanted[n, start].discard(i)
            open_ = {x: own for x, own in open_.items() if wanted[x]}
        return found, len(open_)

    def find(self, text: np.ndarray, hits: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, first word, end word) of the best verified run of each item."""
        best: dict[int, tuple[int, int, int]] = {}
        for i, start in sorted(self.candidates(text, hits)[0]):
            x, k = self.items[i][1], self.edits[i]
            if i in best and (best[i][0] == 0 or best[i][1] - k <= start <= best[i][2]):
                continue
            a = max(0, start - 2 * k)
            edits, s, e = best_run(x, text[a : start + len(x) + 3 * k])
            if edits <= k and (i not in best or edits < best[i][0]):
                best[i] = (edits, a + s, a + e)
        return [(self.items[i][0], *x) for i, x in best.items()]


@functools.cache
def sampled(n: int, walk: int, bits: int) -> np.ndarray:
    """The steps of a walk over n words that make up its key."""
    return np.random.default_rng((n, walk)).choice(early(n), min(bits, early(n)), replace=False)


def runs(words: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q words."""
    if len(words) < q:
        return np.empty(0, np.uint64)
    out = words[: len(words) - q + 1]
    for j in range(1, q):
        out = mix(out) + words[j : len(words) - q + 1 + j]
    return out


def matches(bench: Benchmark, texts: list[str | None]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For the number of each text that holds an item: (item_id, edits, first word, end word)."""
    words, bounds = words_of(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for q, known in bench.sorted.items():
        got = runs(words, q)
        at = np.nonzero(bench.filters[q][(got & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
        at = at[known[np.minimum(np.searchsorted(known, got[at]), len(known) - 1)] == got[at]]
        at = at[owner[at] == owner[at + q - 1]]
        for p, h in zip(at.tolist(), got[at].tolist()):
            row = int(owner[p])
            hits[row] += [(i, p - int(bounds[row]) - o) for i, o in bench.seeds[q][h]]
    found = {row: bench.find(words[bounds[row] : bounds[row + 1]], list(dict.fromkeys(own))) for row, own in hits.items()}
    return {row: own for row, own in found.items() if own}


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(row["text"] or "") > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"] or "")
    if block:
        yield block


def find_items(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE) -> DataFrame:
    """doc_id, item_id, edits, first_word and end_word for every contaminated document and each item
    it holds (``docs``: doc_id, text; ``benchmark``: item_id, text), one row each."""
    schema = "doc_id long, item_id long, edits long, first_word long, end_word long"
    out = docs.sparkSession.createDataFrame([], schema)

    def finder(bench: Benchmark):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in chunks(frames, "text", 1_000_000):
                ids = part["doc_id"].tolist()
                rows = [(ids[row], *x) for row, own in matches(bench, list(part["text"])).items() for x in own]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits", "first_word", "end_word"]).astype("Int64")

        return run

    for items in _blocks(benchmark):
        out = out.unionByName(over_texts(docs.select("doc_id", "text"), finder(Benchmark(items, distance)), schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, distance: float = DISTANCE) -> DataFrame:
    """``docs`` without the rows whose text holds an item, in one pass for each block of items; only the
    texts go to Python."""

    def holds(bench: Benchmark) -> Column:
        def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for column in columns:
                found = []
                for part in chunks([column.to_frame("text")], "text", 1_000_000):
                    bad = matches(bench, list(part["text"]))
                    found += [row in bad for row in range(len(part))]
                yield pd.Series(found, dtype=bool)

        whole = releasing(run)

        def judge(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
            yield from whole(columns)

        return F.pandas_udf(judge, "boolean")(F.col("text"))

    bounded_batches(docs.sparkSession)
    for items in _blocks(benchmark):
        docs = docs.filter(~holds(Benchmark(items, distance)))
    return docs
