"""Column functions against plain models and known values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearpath.config import LshConfig, TrieConfig, load
from nearpath.functions import curves as C
from nearpath.functions import sketch as S
from nearpath.functions.frechet import distances, frechet, within
from nearpath.functions.lsh import Family, multi_hash, sign
from nearpath.operators.hamming import split_threshold

M64 = 1 << 64
POINT = "struct<x:double,y:double>"


def half_away(v):
    return int(math.copysign(math.floor(abs(v) + 0.5), v)) if v else 0


def model_hash(points, base, delta):
    def cells(pts, sx, sy):
        out = []
        for i, (x, y) in enumerate(pts):
            c = (half_away((x + (sx[i] if isinstance(sx, tuple) else sx)) / delta), half_away((y + (sy[i] if isinstance(sy, tuple) else sy)) / delta))
            if not out or out[-1] != c:
                out.append(c)
        return out

    if base.offsets_x:
        points = cells(points, base.offsets_x, base.offsets_y)
    r = base.coefficients
    return sum(x * r[i] + y * r[i + 1] for i, (x, y) in enumerate(cells(points, base.shift_x, base.shift_y))) % M64 >> 32


def model_multi(points, family):
    c, m = family.config, family.mixers
    side = lambda groups: [sum(model_hash(points, b, c.resolution) * w for b, w in zip(g, m)) % M64 >> 32 for g in groups]
    left, right = side(family.left), side(family.right)
    return [(a * m[0] + b * m[1]) % M64 >> 32 for a in left for b in right][: c.l]


@pytest.mark.parametrize("k,l,perturbed", [(2, 8, False), (3, 5, False), (2, 8, True)])
def test_multi_hash_matches_big_integers(spark, k, l, perturbed):  # noqa: E741
    rng = random.Random(k * l)
    curves = [(i, [(rng.uniform(-40, 60), rng.uniform(-9, 9)) for _ in range(rng.randint(1, 12))]) for i in range(40)]
    family = Family.draw(LshConfig(resolution=2.5, k=k, l=l, seed=3), 12, perturbed)
    df = spark.createDataFrame(curves, f"id long, pts array<{POINT}>")
    want = {i: model_multi(p, family) for i, p in curves}
    assert {r.id: r.h for r in df.select("id", multi_hash(F.col("pts"), family).alias("h")).collect()} == want
    few = Family.draw(family.config, 2, perturbed)  # grows by itself
    assert {r.id: r.hashes for r in sign(df, few).collect()} == want


def test_grid(spark):
    row = spark.sql("SELECT array(named_struct('x', -2.5D, 'y', 2.5D), named_struct('x', -2.6D, 'y', 2.6D), named_struct('x', 9D, 'y', 0D)) AS pts")
    got = row.select(C.drop_repeats(C.snap(F.col("pts"), 1.0, 0.0, 0.0)).alias("c"), C.bounding_box(F.col("pts")).alias("b"), C.longest_step(F.col("pts"), 1.0).alias("s")).first()
    assert [tuple(c) for c in got.c] == [(-3, 3), (9, 0)]
    assert (got.b.min_x, got.b.max_y) == (-2.6, 2.6)
    assert got.s == pytest.approx(math.hypot(11.6, 2.6))


def test_sketch_known_values(spark):
    one = spark.range(1)
    words = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    sample = words(3348024405, 1932228148, 4083539617, 3119178199)
    got = one.select(
        S.hamming(words(1, 0, 1), words(1, 0, 1)).alias("a"), S.hamming(words(1, 2, 3, 4, 5), words(1, 2, 4, 4, 5)).alias("b"),
        S.characters(sample).alias("chars"), S.pack_bytes(sample, 4).alias("packed"),
        S.bytes_to_code(words(*range(1, 33)), 4).alias("code"),
        S.hamming_early_exit(words(0xFF, 0xFF00), words(0, 0), 6).alias("early"), S.hamming_early_exit(words(0xF, 0xFF00), words(0, 0), 6).alias("late"),
    ).first()
    assert (got.a, got.b) == (0, 3)
    assert got.chars[:8] == [13, 8, 11, 0, 11, 6, 9, 12]
    assert got.packed[:6] == [141, 11, 107, 201, 104, 87]
    assert got.code == [1431655765, 1717986918, 2021161080, 2139127680]
    assert (got.early, got.late) == (8, 12)


def test_split_thresholds():
    assert split_threshold(3, 8, 8) == pytest.approx(16.0)
    assert split_threshold(8, 8, 8) == pytest.approx(0.112323, rel=1e-4)
    assert split_threshold(9, 8, 8) == pytest.approx(0.104076, rel=1e-4)


def model_frechet(a, b):
    d = np.linalg.norm(a[:, None] - b[None], axis=2)
    out = np.full(d.shape, np.inf)
    for i in range(len(a)):
        for j in range(len(b)):
            before = [out[p, q] for p, q in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if p >= 0 and q >= 0]
            out[i, j] = max(d[i, j], min(before) if before else 0)
    return out[-1, -1]


def test_frechet_matches_the_recurrence():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 7), (6, 6), (13, 4), (30, 41)):
        a, b = rng.normal(size=(9, n, 2)), rng.normal(size=(9, m, 2))
        want = [model_frechet(x, y) for x, y in zip(a, b)]
        assert np.allclose(frechet(a, b), want)
        bound = float(np.median(want))
        assert ((frechet(a, b, bound) <= bound) == (np.array(want) <= bound)).all()
    assert frechet(np.zeros((2, 0, 2)), np.zeros((2, 3, 2))).tolist() == [0, 0]


def test_within(spark):
    rng = random.Random(4)
    rows = [(i, i + 1, [(rng.random(), rng.random()) for _ in range(rng.randint(1, 6))], [(rng.random(), rng.random()) for _ in range(rng.randint(1, 6))]) for i in range(60)]
    df = spark.createDataFrame(rows, f"query long, candidate long, a array<{POINT}>, b array<{POINT}>")
    want = {(q, c) for q, c, a, b in rows if model_frechet(np.array(a), np.array(b)) <= 0.6}
    assert {tuple(r) for r in within(df, 0.6).collect()} == want and 0 < len(want) < 60
    import pyarrow as pa

    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    as_list = lambda k: pa.array([[{"x": x, "y": y} for x, y in r[k]] for r in rows], kind)
    got = distances(as_list(2).slice(7), as_list(3).slice(7))
    assert np.allclose(got, [model_frechet(np.array(r[2]), np.array(r[3])) for r in rows[7:]])


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text("[lsh]\nl = 8\nk = 2\nresolution = 0.09\nseed = 1\n[index]\nbits = 8\nerrors = 4\nradius = 8\nin_weight = 1.0\n")
    lsh, trie = load(tmp_path / "a.toml")
    assert (lsh.side, trie.errors) == (3, 4)
    for bad in (lambda: LshConfig(resolution=0.0), lambda: LshConfig(resolution=1.0, k=1), lambda: TrieConfig(bits=9), lambda: TrieConfig(bits=4).check(lsh)):
        with pytest.raises(ValueError):
            bad()
