"""Validated settings of hash families, tables and prefix filters, and their TOML form."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class LshConfig:
    """k concatenated and l output hashes, grid resolution, seed of the family."""

    resolution: float
    k: int = 2
    l: int = 8  # noqa: E741
    seed: int = 0

    def __post_init__(self):
        if self.k < 2:
            raise ValueError("k must be 2 or more: both sides of the tensor need a hash")
        if self.l < 1:
            raise ValueError("l must be positive")
        if not self.resolution > 0:
            raise ValueError("resolution must be positive")

    @property
    def side(self) -> int:
        """Values of each side: the least r with r * r >= l."""
        r = int(self.l**0.5)
        return r if r * r >= self.l else r + 1


@dataclass(frozen=True)
class TrieConfig:
    """Hamming range search over sketches of ``bits`` words."""

    bits: int = 8
    radius: int = 8
    errors: int = 8
    in_weight: float = 1.0
    split_threshold: float | None = None
    distance: float | None = None

    def __post_init__(self):
        if not 1 <= self.bits <= 8:
            raise ValueError("bits must be between 1 and 8")
        if not 0 <= self.errors <= 16:
            raise ValueError("errors must be between 0 and 16")
        if self.radius < 0:
            raise ValueError("radius must not be negative")

    def check(self, lsh: LshConfig) -> None:
        if lsh.l != self.bits:
            raise ValueError("a sketch needs as many hashes as bits")


@dataclass(frozen=True)
class TableConfig:
    """Collision search; verification happens only when both options are set."""

    distance: float | None = None
    verify_fraction: float | None = None

    @property
    def verifies(self) -> bool:
        return self.distance is not None and self.verify_fraction is not None and 0 < self.verify_fraction <= 1


def load(path: str | Path) -> tuple[LshConfig, TrieConfig | TableConfig]:
    """Read a TOML file with the sections ``[lsh]`` and ``[index]``."""
    with open(path, "rb") as f:
        data = tomllib.load(f)
    index = {{"splitthreshold": "split_threshold"}.get(k, k): v for k, v in data.get("index", {}).items()}
    kind = TrieConfig if "bits" in index or "radius" in index or "errors" in index else TableConfig
    unknown = set(index) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown index settings: {sorted(unknown)}")
    return LshConfig(**data["lsh"]), kind(**index)
