"""Pileup: counts by strand and channel at each position, in one partial-and-final aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import channel
from ..params import CallParams
from .filters import passing_bases

CHANNELS = range(8)


def with_channel(bases: DataFrame) -> DataFrame:
    return bases.withColumn("channel", channel(F.col("base"), F.col("bs_strand")))


def pileup(bases: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """One row for each covered position: n, s{0,1}c{0..7} (orientation, channel), c{0..7}, q{0..7}
    (sums of quality), mq2 (sum of squared mapping quality), dp1, d_inf and dp. ``bases`` has contig,
    pos, bs_strand, ori, base, qual and mapq; sums stay whole numbers. With ref there, sites have it too."""
    rows = with_channel(passing_bases(bases, params))
    sums = ["count(1) AS n", *["min(ref) AS ref"] * ("ref" in bases.columns), "sum(cast(mapq as bigint) * mapq) AS mq2"]
    sums += [f"count_if(channel = {c} AND ori = {s}) AS s{s}c{c}" for s in (0, 1) for c in CHANNELS]
    sums += [f"cast(coalesce(sum(if(channel = {c}, qual, null)), 0) as bigint) AS q{c}" for c in CHANNELS]
    out = rows.groupBy("contig", "pos").agg(*map(F.expr, sums))
    counts = [f"s0c{c} + s1c{c} AS c{c}" for c in CHANNELS]
    total = lambda over: " + ".join(f"c{c}" for c in over)
    return out.selectExpr("*", *counts).selectExpr("*", f"{total(range(4))} AS dp1", f"{total(range(4, 8))} AS d_inf", f"{total(CHANNELS)} AS dp")


def with_quality(piled: DataFrame) -> DataFrame:
    """Add m{0..7} (mean quality of a channel, 0 where empty), aq (of the site) and mq (root mean
    square of mapping quality), all rounded."""
    mean = [f"cast(if(c{c} > 0, floor(0.5D + q{c} / c{c}), 0) as int) AS m{c}" for c in CHANNELS]
    every = " + ".join(f"q{c}" for c in CHANNELS)
    return piled.selectExpr("*", *mean, f"cast(floor(0.5D + ({every}) / n) as int) AS aq", "cast(floor(0.5D + sqrt(mq2 / n)) as int) AS mq")
