"""Seeded families of grid hashes of trajectories, as column expressions.

Base hash of a curve: snap to a shifted grid, drop repeated cells, take the dot product with 64-bit
coefficients modulo 2**64, keep the upper 32 bits.  Spark's long product raises on overflow, so the
product is formed from 32-bit limbs whose sums stay below 2**63.

The l output hashes are combinations of r left and r right values (r * r >= l), so only r * k base
hashes are evaluated.

``sign`` does the same over Arrow batches with numpy, whose 64-bit product wraps as wanted; it is the
faster way for whole tables and needs no bound on the number of points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpath.config import LshConfig
from nearpath.functions.curves import drop_repeats, let, snap

_MASK = 0xFFFFFFFF
_M64 = (1 << 64) - 1


class Draws:
    """splitmix64 stream of a seed."""

    def __init__(self, seed: int):
        self.state = seed & _M64

    def word(self) -> int:
        self.state = (self.state + 0x9E3779B97F4A7C15) & _M64
        z = self.state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _M64
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _M64
        return z ^ (z >> 31)

    def unit(self) -> float:
        return (self.word() >> 11) / (1 << 53)


@dataclass(frozen=True)
class BaseHash:
    """Shift of the grid, one coefficient more than points, and offsets of the points if perturbed."""

    shift_x: float
    shift_y: float
    coefficients: tuple[int, ...]
    offsets_x: tuple[float, ...] = ()
    offsets_y: tuple[float, ...] = ()


@dataclass(frozen=True)
class Family:
    """A drawn member of the hash family for curves of up to ``max_points`` points.

    Every base hash has its own streams, so a larger ``max_points`` changes none of its numbers.
    """

    config: LshConfig
    max_points: int
    left: tuple[tuple[BaseHash, ...], ...]
    right: tuple[tuple[BaseHash, ...], ...]
    mixers: tuple[int, ...]
    perturbed: bool = False

    @classmethod
    def draw(cls, config: LshConfig, max_points: int, perturbed: bool = False) -> Family:
        delta, numbers = config.resolution, iter(range(1, 1 << 20))

        def base() -> BaseHash:
            number = next(numbers)
            stream = lambda use: Draws(config.seed * 1_000_003 + number * 8 + use)
            shift, words, dx, dy = map(stream, range(4))
            coefficients = tuple(words.word() for _ in range(max_points + 1))
            offsets = [tuple((d.unit() - 0.5) * delta for _ in range(max_points)) for d in (dx, dy)] if perturbed else [(), ()]
            return BaseHash(shift.unit() * delta, shift.unit() * delta, coefficients, *offsets)

        own = Draws(config.seed * 1_000_003)
        mixers = tuple(own.word() for _ in range(config.k))
        side = lambda n: tuple(tuple(base() for _ in range(n)) for _ in range(config.side))
        return cls(config, max_points, side((config.k + 1) // 2), side(config.k // 2), mixers, perturbed)


def _longs(values) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot_hash(cells: Column, coefficients: tuple[int, ...]) -> Column:
    """Upper half of the dot product modulo 2**64; cell i meets coefficients i (x) and i + 1 (y)."""
    high, low = _longs(c >> 32 for c in coefficients), _longs(c & _MASK for c in coefficients)

    def total(cs: Column, part: Column) -> Column:
        terms = F.transform(cs, lambda c, i: c["x"] * F.get(part, i) + c["y"] * F.get(part, i + 1))
        # the upper limb only counts modulo 2**32
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: a + t)

    def wide(cs: Column) -> Column:
        terms = F.transform(cs, lambda c, i: (c["x"] * F.get(high, i) + c["y"] * F.get(high, i + 1)).bitwiseAND(F.lit(_MASK)))
        return F.aggregate(terms, F.lit(0).cast("long"), lambda a, t: (a + t).bitwiseAND(F.lit(_MASK)))

    return let(cells, lambda cs: (wide(cs) + F.shiftright(total(cs, low), 32)).bitwiseAND(F.lit(_MASK)))


def linear_hash(pts: Column, base: BaseHash, delta: float) -> Column:
    return dot_hash(drop_repeats(snap(pts, delta, base.shift_x, base.shift_y)), base.coefficients)


def perturbed_hash(pts: Column, base: BaseHash, delta: float) -> Column:
    """Each point is moved by the offset of its index and snapped; the cells are hashed as a curve."""
    cells = drop_repeats(snap(pts, delta, _doubles(base.offsets_x), _doubles(base.offsets_y)))
    return linear_hash(cells, base, delta)


def mix_hash(hashes: list[Column], mixers: tuple[int, ...]) -> Column:
    """Upper half of the sum of products of 32-bit hashes with 64-bit mixers, modulo 2**64."""
    high, low = F.lit(0).cast("long"), F.lit(0).cast("long")
    for h, c in zip(hashes, mixers):
        ch, cl = F.lit(c >> 32).cast("long"), F.lit(c & _MASK).cast("long")
        top, bottom = F.shiftright(h, 16), h.bitwiseAND(F.lit(0xFFFF))
        v = bottom * cl
        w = top * cl + F.shiftright(v, 16)
        low = low + F.shiftleft(w.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(v.bitwiseAND(F.lit(0xFFFF)))
        # h * ch modulo 2**32, by 16-bit halves of h
        high = high + F.shiftright(w, 16) + (bottom * ch).bitwiseAND(F.lit(_MASK)) + F.shiftleft((top * ch).bitwiseAND(F.lit(0xFFFF)), 16)
    return (high + F.shiftright(low, 32)).bitwiseAND(F.lit(_MASK))


def multi_hash(pts: Column, family: Family) -> Column:
    """Array of the l hashes of a curve."""
    c = family.config
    base = perturbed_hash if family.left[0][0].offsets_x else linear_hash
    value = lambda group: mix_hash([base(pts, b, c.resolution) for b in group], family.mixers)
    sides = F.struct(F.array(*map(value, family.left)).alias("left"), F.array(*map(value, family.right)).alias("right"))

    def combine(s: Column) -> Column:
        pairs = [(a, b) for a in range(c.side) for b in range(c.side)][: c.l]
        return F.array(*[mix_hash([s["left"][a], s["right"][b]], family.mixers[:2]) for a, b in pairs])

    return let(sides, combine)


# Arrow batches

def _half_away(v: np.ndarray) -> np.ndarray:
    return (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int64)


def _kept(cx: np.ndarray, cy: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """Cells that differ from the one before in their curve."""
    keep = np.ones(len(cx), dtype=bool)
    keep[1:] = (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1]) | (curve[1:] != curve[:-1])
    return keep


def _places(curve: np.ndarray) -> np.ndarray:
    """Index of every row within its curve."""
    start = np.flatnonzero(np.r_[True, curve[1:] != curve[:-1]]) if len(curve) else curve
    return np.arange(len(curve)) - np.repeat(start, np.diff(np.r_[start, len(curve)]))


def base_hashes(x: np.ndarray, y: np.ndarray, curve: np.ndarray, curves: int, base: BaseHash, delta: float) -> np.ndarray:
    if base.offsets_x:
        at = _places(curve)
        cx, cy = _half_away((x + np.asarray(base.offsets_x)[at]) / delta), _half_away((y + np.asarray(base.offsets_y)[at]) / delta)
        keep = _kept(cx, cy, curve)
        x, y, curve = cx[keep].astype(np.float64), cy[keep].astype(np.float64), curve[keep]
    cx, cy = _half_away((x + base.shift_x) / delta), _half_away((y + base.shift_y) / delta)
    keep = _kept(cx, cy, curve)
    cx, cy, curve = cx[keep], cy[keep], curve[keep]
    at, c = _places(curve), np.asarray(base.coefficients, dtype=np.uint64)
    terms = cx.view(np.uint64) * c[at] + cy.view(np.uint64) * c[at + 1]
    out = np.zeros(curves, dtype=np.uint64)
    if len(terms):
        start = np.flatnonzero(np.r_[True, curve[1:] != curve[:-1]])
        out[curve[start]] = np.add.reduceat(terms, start)
    return out >> np.uint64(32)


def sign(curves: DataFrame, family: Family, kept: tuple[str, ...] = ()) -> DataFrame:
    """id, ``hashes`` and the columns ``kept``; longer curves than the family has numbers for get more of the same streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shift = family, np.uint64(32)
        for batch in batches:
            pts = batch.column(1)
            flat, n = pts.flatten(), np.diff(pts.offsets.to_numpy())
            x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in "xy")
            longest = int(n.max()) if len(n) else 0
            if longest > own.max_points:
                own = Family.draw(own.config, 1 << longest.bit_length(), own.perturbed)
            c, curve = own.config, np.repeat(np.arange(len(n)), n)
            mixers = [np.uint64(m) for m in own.mixers]
            value = lambda group: sum(base_hashes(x, y, curve, len(n), b, c.resolution) * m for b, m in zip(group, mixers)) >> shift
            left, right = [value(g) for g in own.left], [value(g) for g in own.right]
            pairs = [(a, b) for a in range(c.side) for b in range(c.side)][: c.l]
            words = np.stack([(left[a] * mixers[0] + right[b] * mixers[1]) >> shift for a, b in pairs], axis=1).astype(np.int64) if len(n) else np.zeros((0, c.l), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * c.l), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *batch.columns[2:]], names=["id", "hashes", *kept])

    asked = curves.select("id", "pts", *[F.col(c).alias(f"kept_{c}") for c in kept])
    kinds = "".join(f", {c} {curves.schema[c].dataType.simpleString()}" for c in kept)
    return asked.mapInArrow(run, f"id long, hashes array<bigint>{kinds}")
