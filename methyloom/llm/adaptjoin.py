"""Jaccard self-join of documents over word shingles with adaptive multi-match prefixes.

Shingles are ordered by their estimated document frequency, rarest first. A document of n shingles can
miss m = ``n - ceil(percent * n / 100)`` of them in a partner. Indexed by its first m + l, it shares at
least l with every partner whose own prefix reaches as far. A longer prefix costs more entries, but
asks for l shared ones before two sets are compared: each document takes the l that its own
estimated cost (entries scanned, candidates compared) favours.

**Bounds.** Of two documents let x be the one whose prefix ends first. All of x's indexed shingles that
the partner has are in the partner's prefix too. So x's entries that nobody shares are missing there,
and so are the partner's up to that place; together they must not exceed the difference that the
similarity allows. Documents with too many such entries can only be the partner whose prefix ends
later, which few are: most of a corpus drops out here. Pairs are checked against the same bound, then
for l_x shared entries, then by parity maps, and only then by their sets.

**Parity maps.** A class's map has a bit for each of at least 2 n cells (powers of two, up to ``MAP_BITS``): whether an odd
number of its shingles fall there. Bits that differ between two maps, the larger one folded to the
smaller's size, are no more than the shingles that one set has and the other has not, so a pair with too
many of them is dissimilar for certain. Maps take a thirtieth of the sets; of the sets only
those move that the pairs left ask for.

**Groups.** Documents of equal sets form one class; classes are joined. Not all pairs of an index entry
are tried: in some rounds every member is compared with one hub of its entry, the one with the
fewest entries of its own, and what is linked is merged; then only pairs of different components are
candidates. So a group of thousands of near copies costs a multiple of its size, and no link
between components is missed. Links inside a component are counted once the components are known: of
small ones all pairs are compared, of large ones all pairs of blocks of ``BLOCK`` classes of like sizes,
each block pair in one matrix product. That work grows with the square of a large component.

Document frequencies come from one count sketch of all documents (``SKETCH_CELLS`` cells, whatever the
input; summed over partitions). It steers order and cost only: any estimate gives the same components.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, dropped, over_texts, stored, touched
from .components import components

SKETCH_CELLS = 1 << 24  # a byte each; about a tenth of the shingles makes a sharp order
MATCHES = (0.5, 1.0, 2.0)  # l as a share of the shingles that may miss
COMPARE_COST = 20.0  # of comparing two sets, in index entries scanned
HUB_ROUNDS = 2
SMALL_ENTRY = 24  # members
SMALL_COMPONENT = 6  # classes: all pairs of so few are joined, more are compared in blocks
BLOCK = 256  # classes compared at once
MAP_BITS = 1 << 16  # of the largest parity maps; the smallest have 256

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (splitmix64's finaliser)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64))
for _upper in range(65, 91):
    _BYTES[_upper] = _BYTES[_upper + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
def word_hashes(texts: list[str | None], between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts (A-Z lower-cased; ``between`` says for each byte whether
    it parts words: space and \\t to \\r by default), and where each text's words begin; one entry
    more than texts. A word's hash is the sum of random values of its (byte, place) pairs, so words
    of regular patterns collide no more than others."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*coded, b""]), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    space = between[data]
    before = np.concatenate([[True], space[:-1]])
    start = np.nonzero(~space & before)[0]
    end = np.nonzero(space & ~before)[0]
    size = end - start
    inside = ~space
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(_BYTES[data[inside]] + place.astype(np.uint64) * _M2))])
    upto = np.cumsum(size)
    words = mix(total[upto] - total[upto - size] + size.astype(np.uint64) * _M1)
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in coded])])
    return words, np.searchsorted(start, at)


def shingle_sets(texts: list[str | None], width: int = 3) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of ``width`` words; with fewer words, the
    whole sequence as one; none without words."""
    words, bounds = word_hashes(texts)
    if len(words) >= width:
        runs = words[: len(words) - width + 1]
        for k in range(1, width):
            runs = mix(runs) + words[k : len(words) - width + 1 + k]
        runs = mix(runs)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        elif b > a:
            whole = words[a : a + 1]
            for k in range(a + 1, b):
                whole = mix(whole) + words[k : k + 1]
            out.append(mix(whole ^ np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_id(own: np.ndarray) -> int:
    """64-bit name of a set, the same for equal sets."""
    parts = np.array([own.sum(), mix(own).sum(), len(own)], np.uint64)
    return int(mix(mix(mix(parts[:1]) + parts[1:2]) + parts[2:])[0].astype(np.int64))


def frequency_sketch(docs: DataFrame, width: int, cells: int = SKETCH_CELLS, blocks: int = 64) -> tuple[np.ndarray, int]:
    """Document frequencies of cells of shingles over all documents, coded in a byte each by
    :data:`FREQUENCIES`, and their mean."""
    each = cells // blocks

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(cells, np.uint16)
        for part in chunks(frames, "text", 1_000_000):
            own = np.concatenate(shingle_sets(list(part["text"]), width))
            at, times = np.unique(own & np.uint64(cells - 1), return_counts=True)
            at = at.astype(np.int64)
            held[at] = np.minimum(held[at] + times, 65_535)
        yield pd.DataFrame({"block": range(blocks), "counts": [zlib.compress(x.astype("<u2").tobytes(), 1) for x in held.reshape(blocks, each)]})

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(each, np.int64)
        for frame in frames:
            for x in frame["counts"]:
                held += np.frombuffer(zlib.decompress(x), "<u2")
        # a byte a cell: up to 128 as it is, from there half the bits of the logarithm's fraction
        coded = np.where(held <= 128, held, np.minimum(128 + 6 * np.log2(np.maximum(held, 128) / 128), 255)).astype(np.uint8)
        yield pd.DataFrame({"block": [key[0]], "counts": [coded.tobytes()], "total": [int(held.sum())]})

    rows = over_texts(docs.select("text"), count, "block int, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary, total long").collect()
    found = np.zeros((blocks, each), np.uint8)
    for r in rows:
        found[r["block"]] = np.frombuffer(r["counts"], np.uint8)
    return found.ravel(), sum(r["total"] for r in rows) // cells


#: What the bytes of a sketch stand for.
FREQUENCIES = np.where(np.arange(256) <= 128, np.arange(256), 128 * 2.0 ** ((np.arange(256) - 128) / 6)).astype(np.int64)


def prefix(own: np.ndarray, sketch: np.ndarray, load: int, percent: int) -> tuple[np.ndarray, int]:
    """The keys a set is indexed by, in order, and the set's l. A key is the frequency code of a
    shingle's cell and 55 bits of its hash."""
    n = len(own)
    miss = n - -(-percent * n // 100)
    code = sketch[(own & np.uint64(len(sketch) - 1)).astype(np.int64)].astype(np.uint64)
    keys = np.sort(code << np.uint64(55) | own >> np.uint64(9)).astype(np.int64)
    others = np.cumsum(np.maximum(FREQUENCIES[keys >> 55] - load, 1) - 1)
    levels = sorted({min(n - miss, int(share * miss) + 2) for share in MATCHES})
    cost = [others[miss + k - 1] * (1 + COMPARE_COST / k) + miss + k for k in levels]
    best = levels[int(np.argmin(cost))]
    return keys[: miss + best], best


def _sets(docs: DataFrame, width: int, sketch: np.ndarray, load: int, percent: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "text", 1_000_000):
            rows = []
            for doc_id, th, own in zip(part["doc_id"], part["th"], shingle_sets(list(part["text"]), width)):
                keys, match = prefix(own, sketch, load, percent) if len(own) else (np.empty(0, np.int64), 0)
                rows.append((doc_id, th, len(own), class_id(own) if len(own) else 0, keys, match))
            yield pd.DataFrame(rows, columns=["doc_id", "th", "n", "cid", "keys", "l"]).astype({"doc_id": "Int64"})

    return over_texts(docs.select("doc_id", "th", "text"), run, "doc_id long, th long, n long, cid long, keys array<long>, l int")


def parity_map(own: np.ndarray) -> np.ndarray:
    """Cell c is bit c % 64 of word c // 64; cells are the hashes' lowest bits, so a map folds to a half by
    exclusive or of its halves."""
    cells = min(max(256, 1 << (2 * len(own) - 1).bit_length()), MAP_BITS)
    odd = np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def differing(x: str, y: str) -> str:
    """SQL: bits in which two parity maps differ, the longer one folded to the shorter one's length."""
    small = f"least(size({x}), size({y}))"

    def folded(m: str) -> str:
        part = f"transform(sequence(0, {small} - 1), i -> aggregate(sequence(i, size({m}) - 1, {small}), 0L, (s, k) -> s ^ {m}[k]))"
        return f"if(size({m}) = {small}, {m}, {part})"

    return f"aggregate(zip_with({folded(x)}, {folded(y)}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"


def _allowed(percent: int, n: str = "n", n2: str = "n2") -> str:
    """SQL: shingles that only one of two sets of these sizes may have."""
    return f"({n} + {n2} - 2 * ceil({percent} * ({n} + {n2}) / {100 + percent}.0D))"


def _texts_of(docs: DataFrame, width: int, wanted: DataFrame) -> DataFrame:
    """cid, n, parity map and set of the texts in ``wanted`` (th, their hashes); copies repeat."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in chunks(frames, "text", 1_000_000):
            sets = [x for x in shingle_sets(list(part["text"]), width) if len(x)]
            yield pd.DataFrame({"cid": [class_id(x) for x in sets], "n": [len(x) for x in sets], "odd": [parity_map(x) for x in sets], "own": [x.astype(np.int64) for x in sets]})

    rows = touched(docs.select("th", "text"), wanted, "th").join(wanted, "th", "left_semi")
    return over_texts(rows.select("text"), run, "cid long, n int, odd array<long>, own array<long>")


def _of(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """cid and set of the ``classes`` (cid), each once; no other set moves."""
    rows = touched(sets.select("cid", "own"), classes, "cid").join(classes, "cid", "left_semi")
    return rows.groupBy("cid").agg(F.first("own").alias("own"))


def _likely(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parity maps (cid, n, odd) do not rule them out."""
    one = maps.select(F.col("cid").alias("a"), "n", F.col("odd").alias("x"))
    two = maps.select(F.col("cid").alias("b"), F.col("n").alias("n2"), F.col("odd").alias("y"))
    return pairs.join(one, "a").join(two, "b").filter(f"100 * least(n, n2) >= {percent} * greatest(n, n2) and {differing('x', 'y')} <= {_allowed(percent)}").select("a", "b")


def _verified(pairs: DataFrame, maps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b) of classes whose sets are similar enough."""
    pairs = stored(_likely(pairs, maps, percent), "likely")
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    held = _of(sets, wanted)
    one = held.select(F.col("cid").alias("a"), F.col("own").alias("x"))
    two = held.select(F.col("cid").alias("b"), F.col("own").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").filter(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def partners(x: list[np.ndarray], y: list[np.ndarray], percent: int, width: int = 8192) -> np.ndarray:
    """For each set of ``x`` and each of ``y`` whether the two are similar enough, exactly."""
    keys = [np.concatenate(s) for s in (x, y)]
    common = np.intersect1d(*keys)
    sides = []
    for s, k in zip((x, y), keys):
        row = np.repeat(np.arange(len(s)), [len(v) for v in s])
        held = np.isin(k, common)
        at = np.searchsorted(common, k[held])
        order = np.argsort(at, kind="stable")
        sides.append((row[held][order], at[order]))
    both = np.zeros((len(x), len(y)), np.int64)
    for start in range(0, len(common), width):
        dense = []
        for s, (row, at) in zip((x, y), sides):
            a, b = np.searchsorted(at, [start, start + width])
            part = np.zeros((len(s), min(width, len(common) - start)), np.float32)
            part[row[a:b], at[a:b] - start] = 1
            dense.append(part)
        both += (dense[0] @ dense[1].T).astype(np.int64)
    n, n2 = (np.array([len(v) for v in s], np.int64) for s in (x, y))
    return 100 * both >= percent * (n[:, None] + n2[None, :] - both)


def _degrees(known: DataFrame, maps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """cid and n_links: how many other classes each class of a component (cid, component) is similar
    to. All its partners are in its own component."""
    sizes = known.groupBy("component").agg(F.count(F.lit(1)).alias("c"))
    known = stored(known.join(sizes, "component"), "sized")
    few = known.filter(f"c <= {SMALL_COMPONENT}").select("component", "cid")
    pairs = few.withColumnRenamed("cid", "a").join(few.withColumnRenamed("cid", "b"), "component").filter("a < b").select("a", "b")
    found = stored(_verified(pairs, maps, sets, percent), "linked")
    few = found.select(F.col("a").alias("cid")).unionByName(found.select(F.col("b").alias("cid"))).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))

    # similar sets are in one band of sizes or in neighbours (a band is a little wider than it need be)
    step = float(np.log(100.0 / percent)) * 1.001 + 1e-6
    many = known.filter(f"c > {SMALL_COMPONENT}").select("component", "cid").join(maps.select("cid", "n"), "cid")
    many = stored(many, "many")
    large = many.select("cid")
    many = many.withColumn("band", F.floor(F.log("n") / F.lit(step)))
    parts = many.groupBy("component", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))).cast("int").alias("parts"))
    many = many.join(parts, ["component", "band"]).select("component", "cid", "band", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"))
    many = many.withColumn("band2", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    many = many.join(parts.withColumnRenamed("band", "band2"), ["component", "band2"]).withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    one, two = F.struct("band", "part"), F.struct(F.col("band2").alias("band"), F.col("part2").alias("part"))
    many = many.select("component", "cid", F.least(one, two).alias("x"), F.greatest(one, two).alias("y"), (one <= two).alias("left"))
    many = many.select("component", "cid", "x.*", F.col("y.band").alias("band2"), F.col("y.part").alias("part2"), "left").join(_of(sets, large), "cid")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        side, own = frame["left"].to_numpy(bool), [np.asarray(v) for v in frame["own"]]
        cid = frame["cid"].to_numpy()
        if first["band"] == first["band2"] and first["part"] == first["part2"]:
            return pd.DataFrame({"cid": cid, "n": partners(own, own, percent).sum(axis=1) - 1})
        x, y = [v for v, s in zip(own, side) if s], [v for v, s in zip(own, side) if not s]
        if not x or not y:
            return pd.DataFrame({"cid": cid[:0], "n": cid[:0]})
        linked = partners(x, y, percent)
        return pd.DataFrame({"cid": np.concatenate([cid[side], cid[~side]]), "n": np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])})

    many = many.groupBy("component", "band", "part", "band2", "part2").applyInPandas(count, "cid long, n long")
    return few.unionByName(many.groupBy("cid").agg(F.sum("n").alias("n_links")))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of ``docs`` (doc_id, text).

    Texts without words (null ones too) have no shingles, no links and their own doc_id as component.
    n_links counts the other classes that a row's class is linked to, all of them. Rows that repeat a
    doc_id, or have none, each get their own text's result.
    """
    members = jaccard_members(docs, width, percent)
    first = members.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("first"))
    return members.join(first, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def jaccard_members(docs: DataFrame, width: int = 3, percent: int = 90, count_links: bool = True) -> DataFrame:
    """doc_id, th (the text's 64-bit hash), n (shingles), comp (a number of the component, null without
    shingles) and, with ``count_links``, n_links (null for none) of every row of ``docs``."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    sketch, load = frequency_sketch(docs, width)
    found = stored(_sets(docs, width, sketch, load, percent), "sets")
    classes = found.filter("n > 0").groupBy("cid").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("l").alias("l"), F.first("keys").alias("keys"))
    classes, every = stored(classes, "classes"), found
    found = stored(found.select("doc_id", "th", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid")), "members")
    dropped(every)

    entries = classes.select(F.explode("keys").alias("key"), "cid")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    mine = entries.join(shared, "key").groupBy("cid").agg(F.collect_list("key").alias("mine"))
    most = F.floor(F.col("n") * (100 - percent) / percent)
    own = classes.join(mine, "cid").select("cid", "th", "n", "l", F.element_at("keys", -1).alias("last"), "mine", F.array_except("keys", "mine").alias("alone"))
    own, every = stored(own.withColumn("strong", F.size("alone") <= most), "classes"), classes
    dropped(every)

    # a pair needs a strong class, and the partner's prefix ends no earlier than its
    rows = own.select("cid", "th", "n", "l", "last", "strong", F.size("alone").alias("alone_n"), F.explode("mine").alias("key"))
    ends = rows.groupBy("key").agg(F.min(F.when(F.col("strong"), F.col("last"))).alias("first_end"), F.count(F.lit(1)).alias("c")).filter("first_end is not null and c > 1")
    index = stored(rows.join(ends, "key").filter("strong or last >= first_end").drop("first_end", "c"), "entries")
    # texts of equal sets have one class; of each class one text is asked for
    sets = stored(_texts_of(docs, width, index.select("th").distinct()), "compared")
    maps = stored(sets.groupBy("cid").agg(F.first("n").alias("n"), F.first("odd").alias("odd")), "maps")
    index = index.drop("th").withColumn("band", F.floor(F.log("n") / F.log(F.lit(100.0 / percent))).cast("int"))

    allowed = _allowed(percent)
    near = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
    # the one of two whose prefix ends first is strong, and its unshared keys are not too many
    earlier = f"if(last < last2 or (last = last2 and cid < hub), strong and alone_n <= {allowed}, strong2 and alone_n2 <= {allowed})"
    links, known = None, None
    for turn in range(HUB_ROUNDS):
        rows = index.withColumn("comp", F.col("cid")) if known is None else index.join(known, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
        # even rounds take the most central class of an entry as its hub, odd ones any
        worth = F.col("alone_n").cast("long") if turn % 2 == 0 else F.lit(0).cast("long")
        told = [F.col(c).alias(f"{c}2") for c in ("n", "last", "strong", "alone_n", "comp")]
        hub = rows.groupBy("key", "band").agg(F.min(F.struct(worth.alias("w"), F.xxhash64("cid", F.lit(turn)).alias("h"), F.col("cid").alias("hub"), *told)).alias("s"), F.min("comp").alias("c1"), F.max("comp").alias("c2"))
        hub = hub.filter("c1 <> c2").select("key", "band", "s.*")
        pairs = rows.join(hub, ["key", "band"]).filter(f"comp <> comp2 and {near} and {earlier}").select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b")).distinct()
        new = _verified(pairs, maps, sets, percent)
        links = stored(new if links is None else links.unionByName(new), "links")
        known = components(links).select(F.col("id").alias("cid"), "component")

    rows = index.select("key", "cid").join(known, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    sizes = rows.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count(F.lit(1)).alias("size")).filter("c1 <> c2").select("key", "size")
    rows = stored(rows.join(sizes, "key").join(index.select("key", "cid", "n", "l", "last", "strong", "alone_n"), ["key", "cid"]), "open")

    # a is the class whose prefix ends first; tests are the joins' own conditions, cheapest first
    first = f"strong and (last < last2 or (last = last2 and cid < cid2)) and comp <> comp2 and {near} and alone_n <= {allowed}"
    unshared = "alone_n + every2 * size(filter(some2, x -> x <= last))"
    common = "array_intersect(mine, mine2)"
    exact = f"size({common}) >= l and {unshared} + size(mine) + size(filter(mine2, x -> x <= last)) - 2 * size({common}) <= {allowed}"
    # of a class's unshared keys all if they are few, else every fourth, for a lower bound
    fourth = "transform(filter(sequence(4, greatest(size(alone), 4), 4), i -> i <= size(alone)), i -> alone[i - 1])"
    arrays = own.select("cid", "mine", F.when(F.col("strong"), 1).otherwise(4).alias("every"), F.expr(f"if(strong, alone, {fourth})").alias("some"))

    def second(df: DataFrame, *columns: str) -> DataFrame:
        return df.select(*[c for c in ("key",) if c in df.columns], *[F.col(c).alias(f"{c}2") for c in columns])

    # pairs of small entries are few; their keys are compared once the pairs are known
    small = rows.filter(f"size <= {SMALL_ENTRY}")
    few = small.join(second(small, "cid", "comp", "n", "last"), "key").filter(first).select("cid", "cid2", "n", "n2", "l", "last", "alone_n").distinct()
    few = few.join(arrays.select("cid", "mine"), "cid").join(second(arrays, "cid", "mine", "every", "some"), "cid2").filter(exact).select("cid", "cid2")
    # large entries carry the keys, and a pair counts at its first common key only; the component that
    # most members of an entry belong to is joined with the other members, never with itself
    large = rows.filter(f"size > {SMALL_ENTRY}").drop("size")
    main = large.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "comp")).alias("s")).select("key", F.col("s.comp").alias("main"))
    large = large.join(main, "key").join(arrays, "cid").repartition("key")
    others = large.filter("comp <> main")

    def tested(one: DataFrame, two: DataFrame) -> DataFrame:
        both = one.join(second(two, "cid", "comp", "n", "last", "mine", "every", "some"), "key")
        return both.filter(f"{first} and {unshared} <= {allowed} and array_min({common}) = key and {exact}").select("cid", "cid2")

    many = tested(others, large).unionByName(tested(large.filter("comp = main"), others))
    pairs = stored(few.unionByName(many).select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b")).distinct(), "pairs")
    links = stored(links.unionByName(_verified(pairs, maps, sets, percent)).distinct(), "links")
    known = components(links).select(F.col("id").alias("cid"), "component")

    members = found.select("doc_id", "th", "n", "cid").join(known, "cid", "left")
    shown = ["doc_id", "th", "n", F.coalesce("component", "cid").alias("comp")]
    if not count_links:
        return members.select(*shown)
    return members.join(_degrees(known, maps, sets, percent), "cid", "left").select(*shown, "n_links")
