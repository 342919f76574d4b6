"""Byte-level BPE with a segment tree over byte positions.

Every leaf of the tree holds the merge key of the symbol that starts at that byte with its right
live neighbour: ``rank * size + position``, or a value beyond all keys where no merge applies. The
root is thus the lowest rank and, among equals, the leftmost position. A merge changes three leaves
(the merged symbol, its left neighbour, the swallowed symbol), each in log2(size) steps, so a piece
of n bytes takes O(n log n) whatever its contents. :func:`merge_pieces` runs the trees of many short pieces in
lockstep, one numpy step for a merge in each; long pieces have a tree each (:func:`merge_piece`).

Null texts count as empty; an empty text has no ids; any UTF-8 text is allowed, however long.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, extended, over_texts

ENCODE_CHARS = 1_000_000  # of texts whose new runs are merged together
CACHE_ENTRIES = 200_000  # runs of at most 64 characters remembered by a Python worker, some 40 MB


def load_ranks(path: str) -> dict[bytes, int]:
    """Read a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece of text by lowest-rank, leftmost merges."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << (n - 1).bit_length()
    none = 1 << 60
    get = ranks.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank * size + i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b
    end = list(range(1, n + 1))  # of the symbol that starts here
    before = list(range(-1, n - 1))  # start of the live symbol to the left
    while (best := tree[1]) < none:
        at = best & (size - 1)
        gone = end[at]
        stop = end[at] = end[gone]
        changed = [(gone, none), (at, none)]
        if stop < n:
            before[stop] = at
            rank = get(piece[at : end[stop]])
            if rank is not None:
                changed[1] = (at, rank * size + at)
        left = before[at]
        if left >= 0:
            rank = get(piece[left:stop])
            changed.append((left, none if rank is None else rank * size + left))
        for node, key in changed:
            node += size
            if tree[node] == key:
                continue
            tree[node] = key
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                if other < key:
                    key = other
                if tree[node] == key:
                    break
                tree[node] = key
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : end[at]]])
        at = end[at]
    return ids


NONE = np.int64(1 << 60)
LOCKSTEP_BYTES = 64  # pieces up to this length run together


class PairTable:
    """Ranks of pairs of tokens (by their own ranks), by an open hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int64)
        slot = self.slots(keys)
        while len(keys):  # each round the first key to claim a free slot gets it, the others move on
            free = self.keys[slot] < 0
            taken, first = np.unique(slot[free], return_index=True)
            which = np.nonzero(free)[0][first]
            self.keys[taken], self.values[taken] = keys[which], values[which]
            rest = np.ones(len(keys), bool)
            rest[which] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no token is made of it."""
        keys = left << 32 | right
        slot, out = self.slots(keys), np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
        return out


def merge_pieces(pieces: list[bytes], single: np.ndarray, pairs: PairTable) -> list[bytes]:
    """Ids (as little-endian unsigned 32-bit integers) of pieces of at most ``LOCKSTEP_BYTES`` bytes (``single``: the rank of each byte), the trees of
    pieces of like lengths in lockstep."""
    out = [b""] * len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    bits = np.array([max(1, (n - 1).bit_length()) for n in range(LOCKSTEP_BYTES + 1)])[sizes]
    for depth in np.unique(bits).tolist():
        which = np.nonzero(bits == depth)[0]
        size, n = 1 << depth, sizes[which]
        rows = np.arange(len(which))
        data = np.frombuffer(b"".join([pieces[i].ljust(size, b"\0") for i in which]), np.uint8).reshape(len(which), size)
        symbol = single[data]
        after = np.tile(np.arange(1, size + 2), (len(which), 1))  # start of the next live symbol
        before = np.tile(np.arange(-1, size), (len(which), 1))  # start of the live symbol to the left
        alive = np.arange(size) < n[:, None]
        tree = np.full((len(which), 2 * size), NONE)
        rank = pairs(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(len(which), size - 1)
        key = rank * size + np.arange(size - 1)
        tree[:, size:-1] = np.where((rank >= 0) & (np.arange(1, size) < n[:, None]), key, NONE)
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        live = rows[tree[:, 1] < NONE]
        while len(live):
            best = tree[live, 1]
            at, merged = best & (size - 1), best >> depth
            gone = after[live, at]
            stop = after[live, gone]
            symbol[live, at], after[live, at], alive[live, gone] = merged, stop, False
            inner = stop < n[live]
            before[live[inner], stop[inner]] = at[inner]
            left = before[live, at]
            first = left >= 0
            here = np.full(len(live), NONE)
            rank = pairs(merged[inner], symbol[live[inner], stop[inner]])
            here[inner] = np.where(rank >= 0, rank * size + at[inner], NONE)
            rank = pairs(symbol[live[first], left[first]], merged[first])
            tree[live[first], size + left[first]] = np.where(rank >= 0, rank * size + left[first], NONE)
            tree[live, size + at], tree[live, size + gone] = here, NONE
            for row, leaf in ((live[first], left[first]), (live, at), (live, gone)):
                node = size + leaf
                for _ in range(depth):
                    node >>= 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        raw, start = symbol[alive].astype("<u4").tobytes(), 0
        for i, end in zip(which.tolist(), ends):
            out[i], start = raw[start:end], end
    return out


class Codec:
    """Encoder and decoder over one rank file; remembers runs of text up to ``CACHE_ENTRIES``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.single, self.pairs = np.array([ranks[bytes([b])] for b in range(256)], np.int64), PairTable(ranks)
        # texts that are one token each: as a whole piece they are encoded at once
        self.whole: dict[str, bytes] = {}
        for token, rank in ranks.items():
            try:
                text = token.decode()
            except UnicodeDecodeError:
                continue
            if self.find(text) == [text]:
                self.whole[text] = array("I", [rank]).tobytes()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def learn(self, runs: set[str]) -> dict[str, bytes]:
        """Ids of runs; those the older memory holds move over, short ones are remembered."""
        made: dict[str, bytes] = {}  # of runs
        several: dict[str, list[str]] = {}  # pieces of runs that have more than one
        older, find, whole = self.older.get, self.find, self.whole.get
        singles, pieces = [], set()
        for run in runs:
            got = older(run) or whole(run)
            if got is None:
                own = find(run)
                if len(own) == 1:
                    singles.append(run)
                else:
                    several[run] = own
                    pieces.update(own)
            else:
                made[run] = got
        merged: dict[str, bytes] = {}  # of pieces, each as it stands
        group, lines = [], []
        for piece in pieces.union(singles):
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                merged[piece] = array("I", [rank]).tobytes()
            elif len(raw) > LOCKSTEP_BYTES:
                merged[piece] = array("I", merge_piece(raw, self.ranks)).tobytes()
            else:
                group.append(piece)
                lines.append(raw)
        for at in range(0, len(group), 20_000):
            merged.update(zip(group[at : at + 20_000], merge_pieces(lines[at : at + 20_000], self.single, self.pairs)))
        for run in singles:
            made[run] = merged[run]
        for run, own in several.items():
            made[run] = b"".join([merged[piece] for piece in own])
        if len(self.known) + len(made) > CACHE_ENTRIES // 2:
            self.older, self.known = self.known, {}
        self.known.update({run: ids for run, ids in made.items() if len(run) <= 64})
        return made

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts as little-endian unsigned 32-bit integers; new runs of all texts are merged together."""
        out, runs, held = [], [], 0
        for i, text in enumerate(texts):
            runs.append(word_runs(text))
            held += len(text)
            if held < ENCODE_CHARS and i + 1 < len(texts):
                continue
            coded = [list(map(self.known.get, own)) for own in runs]
            new = {run for own, got in zip(runs, coded) if None in got for run, x in zip(own, got) if x is None}
            made = self.learn(new) if new else {}
            for own, got in zip(runs, coded):
                if None in got:
                    got = [made[run] if x is None else x for run, x in zip(own, got)]
                out.append(np.frombuffer(b"".join(got), dtype="<u4"))
            runs, held = [], 0
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


#: White space by any definition in use; only between another character and a space or line feed
#: is a text cut, and there every pattern of this family also ends a piece.
SPACES = r"\t\n\x0b\x0c\r\x1c-\x20\x85\xa0 ᠎ -​    　﻿"
_cut = regex.compile(rf"(?<=[^{SPACES}])(?=[ \n])")
_odd = regex.compile(rf"[{SPACES}][ \n]|[\0\t\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")


#: Bytes of the characters that _odd looks for, or that begin one in UTF-8.
_suspect = bytes([0, 9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])


def word_runs(text: str) -> list[str]:
    """Cut a text where a space or line feed follows another kind of character: the parts can be
    encoded one by one, since no piece of the pattern runs or looks across such a place."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    plain = not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text) and len(raw.translate(None, _suspect)) == len(raw)
    if plain or _odd.search(text) is None:
        return text.replace(" ", "\0 ").replace("\n", "\0\n").lstrip("\0").split("\0")
    return [run for run in _cut.split(text) if run]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's own codec of this file, made once."""
    key = (path, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(load_ranks(path), pattern)
    return _codecs[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add the ids of ``text`` as ``array<long>`` in column ``ids`` (replaced if it exists)."""
    kept = [c for c in docs.columns if c != ids]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = extended(docs.schema, **{ids: "array<long>"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = codec(ranks_path, pattern)
        for part in chunks(frames, text):
            yield part.assign(**{ids: [x.astype(np.int64) for x in made.encode_all([t or "" for t in part[text]])]})

    return over_texts(docs, run, schema)


def decode_ids(ids: DataFrame, ranks_path: str, pattern: str, column: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for as binary column ``to``; null ids give null."""
    kept = [c for c in ids.columns if c != to]
    ids = ids.select(*[F.col(f"`{c}`") for c in kept])
    schema = extended(ids.schema, **{to: "binary"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = codec(ranks_path, pattern)
        for part in frames:
            yield part.assign(**{to: [None if x is None else made.decode(x) for x in part[column]]})

    return over_texts(ids, run, schema)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document, by one encoding and one
    decoding pass in the same task, so that no id list leaves the worker."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = codec(ranks_path, pattern)
        for part in chunks(frames, "text"):
            rows = []
            for doc_id, ids in zip(part["doc_id"], made.encode_all([text or "" for text in part["text"]])):
                back = made.decode(ids.tolist())
                rows.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return over_texts(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
