"""Reads to aligned bases: CIGAR, trims, clips, mate overlap. Array expressions, no UDFs.

A CIGAR is an array of (op, len). Every operation advances in the read (M, =, X, I, S), in the
reference (M, =, X, D), or in neither (H, P, N do not place bases here).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bases import base_code
from ..params import MAX_QUAL, CallParams

IN_READ = ("M", "=", "X", "I", "S")
IN_REF = ("M", "=", "X", "D")
OVERLAP = ("_over_a", "_over_b")  # columns of with_mate_overlap


def parse_cigar(text: Column) -> Column:
    """``10M2I`` to an array of (op, len); ``*`` and null give an empty array."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(\d+[MIDNSHP=X])"), 1)
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.left(p, F.length(p) - 1).cast("int").alias("len")))


def span(cigar: Column, ops: tuple[str, ...]) -> Column:
    """Length over the operations named: the reference span or the read length."""
    return F.aggregate(cigar, F.lit(0), lambda total, c: total + F.when(c["op"].isin(*ops), c["len"]).otherwise(0))


def events(cigar: Column) -> Column:
    """Operations with their first place in read and reference (both from 0)."""
    empty = F.expr("cast(array() as array<struct<op:string,len:int,read:int,ref:int>>)")
    start = F.struct(F.lit(0).alias("read"), F.lit(0).alias("ref"), empty.alias("out"))

    def step(state: Column, c: Column) -> Column:
        here = F.struct(c["op"].alias("op"), c["len"].alias("len"), state["read"].alias("read"), state["ref"].alias("ref"))
        return F.struct(
            (state["read"] + F.when(c["op"].isin(*IN_READ), c["len"]).otherwise(0)).alias("read"),
            (state["ref"] + F.when(c["op"].isin(*IN_REF), c["len"]).otherwise(0)).alias("ref"),
            F.concat(state["out"], F.array(here)).alias("out"),
        )

    return F.aggregate(cigar, start, step, lambda state: state["out"])


def check_clips(reads: DataFrame) -> DataFrame:
    """Soft clips are legal only beside the ends (hard clips aside); others raise an error."""
    inner = F.replace(F.array_join("cigar.op", ""), F.lit("H"), F.lit(""))
    legal = ~F.contains(F.substr(inner, F.lit(2), F.greatest(F.length(inner) - 2, F.lit(0))), F.lit("S"))
    return reads.withColumn("cigar", F.when(legal, F.col("cigar")).otherwise(F.raise_error(F.concat(F.lit("soft clip inside read "), F.col("qname")))))


def aligned_bases(reads: DataFrame, params: CallParams = CallParams(), clips: bool = False) -> DataFrame:
    """One row for each base that a read aligns: pos, base (code), qual (capped), read_pos (in the read
    as sequenced: from the end for reverse reads) and trimmed. ``reads`` has contig, qname, pos
    (1-based), is_reverse, is_second, mapq, bs_strand, ori, cigar, seq and qual (array). Inserted and
    clipped bases, and bases other than A, C, G and T, give no row; deletions neither. With ``clips``
    soft-clipped bases of any letter have rows too, without pos, marked by the column clipped."""
    left = F.when(F.col("is_second"), params.left_trim[1]).otherwise(params.left_trim[0])
    right = F.when(F.col("is_second"), params.right_trim[1]).otherwise(params.right_trim[0])
    kept = ["contig", "qname", "is_reverse", "is_second", "mapq", "bs_strand", "ori", *[c for c in OVERLAP if c in reads.columns]]
    rows = check_clips(reads).withColumn("_event", F.explode(events(F.col("cigar")))).filter(F.col("_event.op").isin("M", "=", "X", *["S"] * clips) & (F.col("_event.len") > 0))
    # an event's own letters and numbers only, so that little is copied for each base
    first, size = F.col("_event.read"), F.col("_event.len")
    rows = rows.select(*kept, (F.col("_event.op") == "S").alias("clipped"), (F.col("pos") + F.col("_event.ref")).alias("_pos"), first.alias("_first"), size.alias("_size"),
                       F.length("seq").alias("_n"), F.substr("seq", first + 1, size).alias("_letters"), F.slice("qual", first + 1, size).alias("_quals"))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_size") - 1)))
    at, n, clipped = F.col("_first") + F.col("_i"), F.col("_n"), F.col("clipped")
    rows = rows.withColumns({
        "read_pos": F.when(F.col("is_reverse"), n - 1 - at).otherwise(at),
        "base": base_code(F.substring(F.col("_letters"), F.col("_i") + 1, F.lit(1))).cast("int"),
        "qual": F.least(F.get("_quals", F.col("_i")), F.lit(MAX_QUAL)),
        # trims count from the ends of the read as it is stored
        "trimmed": (at < left) | (at >= n - right),
        "pos": F.when(~clipped, F.col("_pos") + F.col("_i")).cast("long"),
    })
    keep = ["contig", "qname", "pos", "base", "read_pos", "trimmed", "is_reverse", "is_second", "mapq", "bs_strand", "ori", *["clipped"] * clips]
    if OVERLAP[0] in kept:
        inside = (F.col("pos") >= F.col(OVERLAP[0])) & (F.col("pos") < F.col(OVERLAP[1]))
        rows, keep = rows.withColumn("overlap", F.coalesce(inside, F.lit(False))), [*keep, "overlap"]
    return rows.filter(F.col("base").isNotNull() | clipped).select(*keep, "qual")


def with_mate_overlap(reads: DataFrame) -> DataFrame:
    """Add _over_a and _over_b: the places from and up to which a read's bases overlap its mate's and are left out, by
    the rule of :func:`mark_mate_overlap`; null where none are. :func:`aligned_bases` makes the column overlap of
    them. Reads meet their mates in one shuffle, before they become bases; CIGARs, qualities and sequences
    are packed for it."""
    end = F.col("pos") + span(F.col("cigar"), IN_REF)
    mean = F.floor(F.aggregate("qual", F.lit(0), lambda x, y: x + y) / F.size("qual"))
    rows = reads.withColumns({"_own": F.struct(F.col("pos").alias("a"), end.alias("b"), mean.alias("mean")), "_ops": F.array_join("cigar.op", ""), "_lens": F.col("cigar.len")}).drop("cigar")
    mates = W.partitionBy("contig", "qname")
    side = lambda r: F.max(F.when(F.col("is_reverse") == F.lit(r), F.col("_own"))).over(mates)
    rows = rows.withColumns({"_f": side(False), "_r": side(True)})
    meet = F.col("_f").isNotNull() & F.col("_r").isNotNull() & (F.col("_f.b") >= F.col("_r.a")) & (F.col("_r.b") > F.col("_f.a"))
    rows = rows.withColumn("_kept", F.when(meet & (F.col("is_reverse") == loser("_f", "_r")), F.when(F.col("is_reverse"), F.col("_f")).otherwise(F.col("_r"))))
    cigar = F.arrays_zip(F.when(F.col("_ops") == "", F.expr("cast(array() as array<string>)")).otherwise(F.split("_ops", "")).alias("op"), F.col("_lens").alias("len"))
    return rows.withColumns({OVERLAP[0]: F.col("_kept.a"), OVERLAP[1]: F.col("_kept.b"), "cigar": cigar}).drop("_own", "_ops", "_lens", "_f", "_r", "_kept")


def loser(f: str, r: str) -> Column:
    """True where the reverse one of two overlapping mates (structs of a, b and mean) loses its overlapping bases."""
    size = lambda x: F.col(f"{x}.b") - F.col(f"{x}.a")
    return F.when(size(f) != size(r), size(f) > size(r)).otherwise(F.col(f"{f}.mean") > F.col(f"{r}.mean"))


def mark_mate_overlap(bases: DataFrame, reads: DataFrame) -> DataFrame:
    """Add overlap: where mates overlap, true for the overlapping bases of the one of the shorter reference span; of
    equal spans, of the lower (whole) mean quality; of equal qualities, of the forward mate."""
    extent = reads.select("contig", "qname", "is_reverse", F.col("pos").alias("a"), (F.col("pos") + span(F.col("cigar"), IN_REF)).alias("b"), F.floor(F.aggregate("qual", F.lit(0), lambda x, y: x + y) / F.size("qual")).alias("mean"))
    side = lambda r: F.max(F.when(F.col("is_reverse") == F.lit(r), F.struct("a", "b", "mean")))
    both = extent.groupBy("contig", "qname").agg(side(False).alias("f"), side(True).alias("r"))
    both = both.filter("f is not null and r is not null and f.b >= r.a and r.b > f.a")
    loses = loser("f", "r")
    both = both.select("contig", "qname", loses.alias("is_reverse"), F.when(loses, F.col("f")).otherwise(F.col("r")).alias("kept"))
    over = both.select("contig", "qname", "is_reverse", F.col("kept.a").alias("_a"), F.col("kept.b").alias("_b"))
    marked = bases.join(over, ["contig", "qname", "is_reverse"], "left")
    inside = (F.col("pos") >= F.col("_a")) & (F.col("pos") < F.col("_b"))
    return marked.withColumn("overlap", F.coalesce(inside, F.lit(False))).drop("_a", "_b")


def drop_mate_overlap(bases: DataFrame, reads: DataFrame) -> DataFrame:
    """``bases`` without those that :func:`mark_mate_overlap` marks."""
    return mark_mate_overlap(bases, reads).filter(~F.col("overlap")).drop("overlap")


def bisulfite_strand(tags: Column) -> Column:
    """0 none, 1 C to T, 2 G to A from a read's tags (an array of (tag, value) in file order): the
    last tag that speaks decides."""
    first = lambda t: F.substring(t["value"], 1, 1)
    # fixed values: tags and letters of the usual aligners
    says = lambda t: (
        F.when(t["tag"].isin("ZB", "XG", "XB") & (first(t) == "C"), 1)
        .when(t["tag"].isin("ZB", "XG", "XB") & (first(t) == "G"), 2)
        .when((t["tag"] == "ZS") & (first(t) == "+"), 1)
        .when((t["tag"] == "ZS") & (first(t) == "-"), 2)
        .when((t["tag"] == "YD") & (first(t) == "f"), 1)
        .when((t["tag"] == "YD") & (first(t) == "r"), 2)
    )
    return F.aggregate(tags, F.lit(0), lambda found, t: F.coalesce(says(t), found))
