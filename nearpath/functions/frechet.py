"""Discrete Fréchet distance (Eiter and Mannila) and its decision, over Arrow batches.

Pairs of a batch are sorted by their lengths and run through the recurrence many at once, one
anti-diagonal at a time, so the work is whole-array numpy.  Shorter curves of a group repeat their last
point, which changes no distance.  The decision gives up on a pair as soon as a whole anti-diagonal (with
the one before it) is out of reach.  An empty side has distance 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpath.functions.curves import ends_apart

#: Cells of the longest anti-diagonal of a group of pairs, such that its arrays stay in the cache.
_CELLS = 1 << 14


def frechet(a: np.ndarray, b: np.ndarray, bound: float | None = None) -> np.ndarray:
    """Distances of pairs ``a`` (pairs, n, 2) and ``b`` (pairs, m, 2); with a bound, distances over it
    may come out as infinity."""
    pairs, n, m = len(a), a.shape[1], b.shape[1]
    if not n or not m:
        return np.zeros(pairs)
    live = np.arange(pairs)
    out = np.full(pairs, np.inf)
    a, back = np.ascontiguousarray(a.transpose(2, 1, 0)), np.ascontiguousarray(b[:, ::-1].transpose(2, 1, 0))
    # so (i, d - i) of an anti-diagonal are two slices
    # cells of an anti-diagonal by row i, at i + 1: those of the last two, and the next
    one, two, new = (np.full((n + 1, pairs), np.inf) for _ in range(3))
    two[0] = -np.inf  # before the first cell
    limit = np.inf if bound is None else bound * bound
    for d in range(n + m - 1):
        low, high = max(0, d - m + 1), min(n - 1, d) + 1
        at = m - 1 - d
        cost = a[0, low:high] - back[0, at + low : at + high]
        cost *= cost
        gap = a[1, low:high] - back[1, at + low : at + high]
        gap *= gap
        cost += gap
        best = np.minimum(one[low:high], one[low + 1 : high + 1], out=gap)  # (i - 1, j) and (i, j - 1)
        np.minimum(best, two[low:high], out=best)  # (i - 1, j - 1)
        np.maximum(best, cost, out=new[low + 1 : high + 1])
        new[: low + 1], new[high + 1 :] = np.inf, np.inf
        two, one, new = one, new, two
        if bound is not None and d % 8 == 7:
            hope = np.minimum(one.min(axis=0), two.min(axis=0)) <= limit
            if 2 * hope.sum() < len(hope):
                live, a, back, one, two = live[hope], a[:, :, hope], back[:, :, hope], one[:, hope], two[:, hope]
                new = np.full_like(one, np.inf)
                if not len(live):
                    return out
    out[live] = np.sqrt(one[n])
    return out


def _points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat = column.flatten()
    xy = np.stack([flat.field("x").to_numpy(zero_copy_only=False), flat.field("y").to_numpy(zero_copy_only=False)], axis=1) if len(flat) else np.zeros((0, 2))
    offsets = column.offsets.to_numpy()
    return xy, offsets - offsets[0]


def distances(a: pa.Array, b: pa.Array, bound: float | None = None) -> np.ndarray:
    xa, oa = _points(a)
    xb, ob = _points(b)
    return _of_pairs((xa, oa[:-1], np.diff(oa)), (xb, ob[:-1], np.diff(ob)), bound)


def _of_pairs(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], bound: float | None) -> np.ndarray:
    """Each side: points, and of each pair where its curve begins in them and its length."""
    (xa, oa, na), (xb, ob, nb) = a, b
    out = np.zeros(len(na))
    some = np.flatnonzero((na > 0) & (nb > 0))
    unit = 1 << np.maximum(0, np.frexp(na[some])[1] - 4)
    about = -(-na[some] // unit) * unit  # an eighth more at most
    by = np.lexsort((nb[some], about))
    order, about = some[by], about[by]
    begin = 0
    while begin < len(order):
        # a group: as many pairs as the cache holds, of about the same lengths
        m = int(nb[order[begin]])
        r = order[begin : begin + max(16, _CELLS // max(1, int(min(about[begin], m))))]
        same = (about[begin : begin + len(r)] == about[begin]) & (nb[r] <= m + m // 8)
        r = r[: len(r) if same.all() else int(np.argmin(same))]
        begin += len(r)
        sides = [x[o[r][:, None] + np.minimum(np.arange(int(k[r].max())), k[r][:, None] - 1)] for x, o, k in ((xa, oa, na), (xb, ob, nb))]
        out[r] = frechet(*sides, bound)
    return out


def _block_distances(batch: pa.RecordBatch, bound: float | None, at_once: int = 1 << 16) -> Iterator[tuple[np.ndarray, ...]]:
    """Of rows that are pairs of blocks of curves: ids of both sides and the distance, many pairs at once; of blocks
    with ``copies`` and ``hashes`` also in how many hashes a pair differs and for how many it stands.
    A block with itself and ``mirror`` give both orders of a pair, computed once."""
    sides, more = [], []
    for n in ("query", "candidate"):
        curves = batch.column(n)
        flat, at = curves.flatten(), curves.offsets.to_numpy()
        x, o = _points(flat.field("pts"))
        if flat.type.get_field_index("copies") >= 0:
            hashes, copies = flat.field("hashes"), flat.field("copies").to_numpy(zero_copy_only=False)
            words = hashes.flatten().to_numpy(zero_copy_only=False)
            more.append((words.reshape(len(copies), -1) if len(words) else np.zeros((len(copies), 0), np.int64), copies))
        sides.append((flat.field("id").to_numpy(zero_copy_only=False), at - at[0], x, o[:-1], np.diff(o)))
    (qid, qat, xa, oa, na), (cid, cat, xb, ob, nb) = sides
    itself, mirror = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("itself", "mirror"))
    held, size = [], 0
    for row in range(len(batch)):
        i, j = np.arange(qat[row], qat[row + 1]), np.arange(cat[row], cat[row + 1])
        # a long side goes through in parts
        for k in range(0, len(i), part := max(1, at_once // max(1, len(j)))):
            p, q = np.repeat(i[k : k + part], len(j)), np.tile(j, len(i[k : k + part]))
            if itself[row]:
                once = qid[p] <= cid[q]
                p, q = p[once], q[once]
            held.append((p, q, np.full(len(p), mirror[row]) & (qid[p] != cid[q])))
            size += len(p)
            if size >= at_once:
                yield from _measured(held, qid, cid, (xa, oa, na), (xb, ob, nb), bound, more)
                held, size = [], 0
    if held:
        yield from _measured(held, qid, cid, (xa, oa, na), (xb, ob, nb), bound, more)


def _measured(held, qid, cid, a, b, bound, more=()) -> Iterator[tuple[np.ndarray, ...]]:
    p, q, other = (np.concatenate(c) for c in zip(*held))
    found = _of_pairs((a[0], a[1][p], a[2][p]), (b[0], b[1][q], b[2][q]), bound)
    query, candidate, extra = qid[p], cid[q], ()
    if more:
        (ha, ca), (hb, cb) = more
        extra = (ha[p] != hb[q]).sum(axis=1).astype(np.int32), ca[p] * cb[q]
    yield query, candidate, found, *extra
    if other.any():
        yield candidate[other], query[other], found[other], *(c[other] for c in extra)


def with_distance(pairs: DataFrame, bound: float | None = None, keep: tuple[str, ...] = ("query", "candidate"), blocks: bool = False) -> DataFrame:
    """``pairs`` has the columns keep, a and b (points); gives keep and ``distance``.

    With ``blocks`` a row is a pair of blocks of curves and stands for all pairs of theirs: query and candidate
    are arrays of (id, pts); ``itself``: both are the same block; ``mirror``: the other order is wanted too.
    So a curve goes to a task once for a block and not once for each pair.  Where the blocks' curves have ``copies``
    and ``hashes`` too, ``differing`` hashes and the ``pairs`` of rows come with the distance.
    """
    if blocks:

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for columns in _block_distances(batch, bound):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*("query", "candidate", "distance", "differing", "pairs")[: len(columns)]])

        kinds = ", ".join(f"{n} {pairs.schema[n].dataType.elementType['id'].dataType.simpleString()}" for n in ("query", "candidate"))
        more = ", differing int, pairs long" if "copies" in pairs.schema["query"].dataType.elementType.names else ""
        return pairs.select("query", "candidate", "itself", "mirror").mapInArrow(measure, f"{kinds}, distance double{more}")
    names = list(keep)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*names).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = distances(batch.column("a"), batch.column("b"), bound)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found)], names=[*names, "distance"])

    return pairs.select(*names, "a", "b").mapInArrow(run, f"{kinds}, distance double")


def within(pairs: DataFrame, bound: float, keep: tuple[str, ...] = ("query", "candidate")) -> DataFrame:
    """Pairs at most ``bound`` apart: the end points decide first, without leaving the JVM."""
    near = pairs.filter(ends_apart(F.col("a"), F.col("b")) <= bound)
    return with_distance(near, bound, keep).filter(F.col("distance") <= bound).select(*keep)
