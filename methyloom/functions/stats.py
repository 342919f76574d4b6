"""Statistics as column expressions: factorials, Fisher's exact test, Phred values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE = 256


def ln_factorials(*terms: tuple[int, str]) -> str:
    """SQL of the sum of sign * ln n! over (sign, n): a table below TABLE, Stirling's series (error
    under 1e-13) from there. One expression for all terms, so the table stands in it once."""
    table = ", ".join(f"{math.lgamma(i + 1)!r}D" for i in range(TABLE))
    n = "lf_x.n"
    series = f"({n} + 0.5D) * ln({n} + 1D) - {n} - 1D + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12 * ({n} + 1D)) - 1D / (360 * pow({n} + 1D, 3))"
    items = ", ".join(f"struct({sign}D as s, cast({n} as int) as n)" for sign, n in terms)
    return f"aggregate(array({items}), 0D, (lf_t, lf_x) -> lf_t + lf_x.s * if(lf_x.n < {TABLE}, get(array({table}), lf_x.n), {series}))"


def fisher(c0: str, c1: str, c2: str, c3: str) -> Column:
    """Two-sided exact test of [c0 c1; c2 c3] (names of columns): the probability of all tables with the same margins
    at least as far from expectation as this one; 1 for an empty table. The first table's logarithm
    comes from factorials, each next one's from the ratio to the one before."""
    r0, r1, k0, k1, n = f"({c0} + {c1})", f"({c2} + {c3})", f"({c0} + {c2})", f"({c1} + {c3})", f"({c0} + {c1} + {c2} + {c3})"
    low, high = f"greatest(0L, {k0} - {r1})", f"least({r0}, {k0})"
    margins = [(1, r0), (1, r1), (1, k0), (1, k1), (-1, n)]
    first = ln_factorials(*margins, (-1, low), (-1, f"{r0} - {low}"), (-1, f"{k0} - {low}"), (-1, f"{r1} - {k0} + {low}"))
    # the names of the lambdas' variables must not be those of columns
    ratio = f"ln(cast({r0} - at_x as double) * ({k0} - at_x) / ((at_x + 1D) * ({r1} - {k0} + at_x + 1D)))"
    far = f"abs(at_x * {n} - {r0} * {k0}) >= abs({c0} * {n} - {r0} * {k0})"
    step = f"struct(so_far.t + if({far}, exp(so_far.l), 0D) as t, so_far.l + {ratio} as l)"
    total = f"aggregate(sequence({low}, {high}), struct(0D as t, {first} as l), (so_far, at_x) -> {step}, so_far -> so_far.t)"
    return F.expr(f"CASE WHEN {n} = 0 THEN 1D ELSE least({total}, 1D) END")


def phred(wrong: Column) -> Column:
    """Whole-number Phred value of an error probability, 255 at most."""
    return F.when(wrong <= 0, 255).otherwise(F.least(F.floor(-10 * F.log10(wrong)), F.lit(255))).cast("int")


def phred_round(p: Column) -> Column:
    """Rounded Phred value of a test's probability, which counts as 1e-20 at least."""
    return F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-20))) + 0.5).cast("int")


def error_k_sql(qual: str) -> str:
    """SQL of k = e / (3 - 4 e) of the error probability e of a quality, e being a half at most."""
    e = f"least(pow(10D, -{qual} / 10D), 0.5D)"
    return f"{e} / (3 - 4 * {e})"


def error_k(qual: str) -> Column:
    return F.expr(error_k_sql(qual))
