"""What is read from a pair store and how."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PairParam:
    """fragments: frag_id, chr, chr_idx, start, end (none: a genome without fragments, then chromosomes: chr, chr_idx, length).
    restrict: chromosome names, or pairs of names. discard: chr, start, end. cap: pairs kept per two fragments.
    """

    fragments: DataFrame | None = None
    chromosomes: DataFrame | None = None
    restrict: tuple = ()
    discard: DataFrame | None = None
    cap: int | None = None

    def __post_init__(self):
        if self.fragments is None and self.chromosomes is None:
            raise ValueError("fragments or chromosomes are needed")
        if self.cap is not None and self.cap < 1:
            raise ValueError("cap must be positive")

    @property
    def dnase(self) -> bool:
        return self.fragments is None

    def reform(self, **changes) -> PairParam:
        return replace(self, **changes)

    def __repr__(self) -> str:
        mode = "no fragments" if self.dnase else "fragments"
        return f"PairParam({mode}, restrict={self.restrict or 'none'}, discard={'yes' if self.discard is not None else 'none'}, cap={self.cap or 'none'})"


@dataclass(frozen=True)
class Interactions:
    """Counts over pairs of regions. pairs: a1, a2 (a1 >= a2), counts (one slot per library), other columns;
    regions: region_id, chr, chr_idx, start, end, nfrags; libraries: names in the slots' order; totals: lib, total.
    """

    pairs: DataFrame
    regions: DataFrame
    libraries: tuple[str, ...]
    totals: DataFrame
    width: int | None = None

    def with_pairs(self, pairs: DataFrame) -> Interactions:
        return replace(self, pairs=pairs)
