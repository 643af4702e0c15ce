"""Defaults of the analysis and checks of its settings."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

#: Versions that a stored run may be replayed under, with their weights and threshold.
VERSIONS = {
    "hybrid-v1": (Decimal("0.50"), Decimal("0.30"), Decimal("0.20"), Decimal("0.8000")),
    "hybrid-v2": (Decimal("0.50"), Decimal("0.25"), Decimal("0.25"), Decimal("0.7500")),
}


def check_ngram_range(low: int, high: int) -> None:
    """Raise unless 1 <= low <= high are whole numbers."""
    if any(isinstance(x, bool) or not isinstance(x, int) for x in (low, high)) or not 1 <= low <= high:
        raise ValueError(f"invalid n-gram range ({low}, {high})")


@dataclass(frozen=True)
class Config:
    """Weights, threshold and gram ranges of one analysis."""

    word_weight: Decimal = Decimal("0.50")
    char_weight: Decimal = Decimal("0.25")
    overlap_weight: Decimal = Decimal("0.25")
    threshold: Decimal = Decimal("0.7500")
    word_range: tuple[int, int] = (1, 3)
    char_range: tuple[int, int] = (3, 5)
    version: str = "hybrid-v2"

    def __post_init__(self) -> None:
        weights = (self.word_weight, self.char_weight, self.overlap_weight)
        if any(not 0 <= w <= 1 for w in weights) or sum(weights) != 1:
            raise ValueError("weights must lie in [0, 1] and sum to exactly 1")
        if not 0 <= self.threshold <= 1:
            raise ValueError("the threshold must lie in [0, 1]")
        check_ngram_range(*self.word_range)
        check_ngram_range(*self.char_range)

    @property
    def least_word_cosine(self) -> float:
        """Word cosine that every match needs, whatever the other signals."""
        return float((self.threshold - self.char_weight - self.overlap_weight) / self.word_weight) if self.word_weight else 0.0

    @staticmethod
    def prefix_share(cosine: float) -> float:
        """Least share of a text's squared counts that its shared grams have in a pair of that cosine."""
        c2, k2 = cosine**2, (math.log(1.5) + 1) ** 2
        return c2 * k2 / (1 + c2 * (k2 - 1)) if cosine > 0 else 0.0

    @classmethod
    def from_snapshot(cls, snapshot: dict[str, str]) -> Config:
        """The settings stored with a run; an unknown version is refused."""
        if snapshot.get("algorithm_version") not in VERSIONS:
            raise ValueError("unsupported_algorithm_version")
        keys = ("word_tfidf_weight", "character_tfidf_weight", "word_overlap_weight", "similarity_threshold")
        if any(k not in snapshot for k in keys):
            raise ValueError("missing_algorithm_snapshot")
        return cls(*(Decimal(snapshot[k]) for k in keys), version=snapshot["algorithm_version"])
