"""Settings of variant and methylation calling, with the limits that option parsing enforces."""

from __future__ import annotations

from dataclasses import dataclass

MAX_QUAL = 43  # base qualities are capped here
TRIMMED_QUAL = 63  # marks a trimmed base in packed forms; here a boolean column says so
MIN_BASE_QUAL = 20
MIN_MAPQ = 20
MAX_TEMPLATE = 1000


@dataclass(frozen=True)
class CallParams:
    """One immutable set of options. Qualities outside 1..MAX_QUAL are clamped, as options are."""

    min_mapq: int = MIN_MAPQ
    min_qual: int = MIN_BASE_QUAL
    max_template: int = MAX_TEMPLATE
    left_trim: tuple[int, int] = (0, 0)
    right_trim: tuple[int, int] = (0, 0)
    keep_unmatched: bool = False
    keep_duplicates: bool = False
    ignore_duplicates: bool = False
    all_positions: bool = False
    benchmark_mode: bool = False
    under_conversion: float = 0.01
    over_conversion: float = 0.05
    reference_bias: float = 2.0
    maf_limit: float = 1.0

    def __post_init__(self):
        object.__setattr__(self, "min_qual", max(1, min(MAX_QUAL, self.min_qual)))
        object.__setattr__(self, "min_mapq", max(0, min(255, self.min_mapq)))
        if not 0 <= self.under_conversion < 1 or not 0 <= self.over_conversion < 1:
            raise ValueError("conversion rates lie in [0, 1)")
        if self.reference_bias <= 0:
            raise ValueError("the reference bias is positive")
        if not 0 <= self.maf_limit <= 1:
            raise ValueError("the allele frequency limit lies in [0, 1]")
