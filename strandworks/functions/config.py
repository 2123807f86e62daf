"""Checks and constants that are settled on the driver before any job is submitted."""

from __future__ import annotations

import math
from dataclasses import dataclass

IGNORED_LABEL = -100
STRATEGIES = ("proportional", "uniform", "sqrt")


@dataclass(frozen=True)
class DataConfig:
    """How a corpus is split, cut and sampled."""

    train: float = 0.6
    val: float = 0.2
    test: float = 0.2
    seq_length: int = 1024
    merge_size: int = 1
    strategy: str = "proportional"
    overlap_stride: int | None = None
    patch_size: int = 1

    def __post_init__(self):
        if abs(self.train + self.val + self.test - 1) > 1e-6 or min(self.train, self.val, self.test) < 0:
            raise ValueError("split ratios must be non-negative and sum to 1")
        if self.strategy not in STRATEGIES:
            raise ValueError(f"sampling strategy must be one of {STRATEGIES}")
        if self.seq_length < 1 or self.merge_size < 1:
            raise ValueError("seq_length and merge_size must be positive")
        s = self.overlap_stride
        if s is not None and (not 0 < s < self.seq_length or s % self.patch_size):
            raise ValueError("overlap_stride must lie in (0, seq_length) and be a multiple of patch_size")


def overlap_stride(patches: int | None, stride: int | None, patch_size: int) -> int:
    """Patches times patch size, else the stride, else one patch."""
    return patches * patch_size if patches else stride or patch_size


def frequency_total(vocab: int, target_mass: float = 0.01, given: int | None = None) -> int:
    """The integer total that probabilities are quantised to: a power of two unless given."""
    total = given or 1 << max(15, math.ceil(math.log2(max(32768, vocab + 1, math.ceil(vocab / target_mass)))))
    if not vocab < total <= (1 << 30) + 2:
        raise ValueError(f"frequency total {total} must exceed {vocab} and be at most 2**30 + 2")
    return total


def grouped_widths(k: int, m: int) -> list[int]:
    """How many bases each coding step of a k-mer takes: m, m, ..., the rest."""
    return [min(m, k - i) for i in range(0, k, m)]


def max_target_tokens(seq_length: int, prefix: int) -> int:
    if seq_length <= prefix:
        raise ValueError("the prefix leaves no room in the window")
    return seq_length - prefix
