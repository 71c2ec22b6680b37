"""Searches, sources, streaming and quality measures."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from nearpath.config import LshConfig, TableConfig, TrieConfig
from nearpath.functions.lsh import Family
from nearpath.operators import collide, evaluate, hamming, verify
from nearpath.plans.index import TableIndex, TrieIndex
from nearpath.sources import points as P
from nearpath.streaming.append import append_signatures

LSH = LshConfig(resolution=4.0, seed=2)


@pytest.fixture(scope="module")
def codes(spark):
    rng = random.Random(8)
    base = [[rng.getrandbits(32) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(120):
        code = list(rng.choice(base))
        for _ in range(rng.randint(0, 14)):
            code[rng.randrange(8)] ^= 1 << rng.randrange(32)
        rows.append((i, code))
    return rows, spark.createDataFrame(rows, "id long, code array<bigint>")


@pytest.fixture(scope="module")
def curves(spark):
    rng = random.Random(9)
    rows = [(i, o, rng.choice([1.0, 9.0, 17.0]) + rng.random(), rng.choice([2.0, 12.0])) for i in range(80) for o in range(rng.randint(1, 3))]
    return P.assemble(spark.createDataFrame(rows, "id long, ord long, x double, y double")).cache()


def ham(a, b, upto=32):
    m = 0
    for x, y in zip(a, b):
        m |= x ^ y
    return (m & ((1 << upto) - 1)).bit_count()


def test_band_search_is_exact(codes):
    rows, df = codes
    want = {(q, c, ham(a, b)) for q, a in rows for c, b in rows if ham(a, b) <= 8}
    assert {tuple(r) for r in hamming.band_search(df, df, 8).collect()} == want
    assert {tuple(r) for r in hamming.linear_search(df, df, 8).collect()} == want


def test_prefix_search(codes):
    rows, df = codes
    exact = {tuple(r) for r in hamming.band_search(df, df, 8).collect()}
    assert {tuple(r) for r in hamming.prefix_search(df, df, TrieConfig(errors=8)).collect()} == exact
    lossy = TrieConfig(errors=3)
    depth = {r.id: r.depth for r in hamming.leaf_depths(df, lossy).collect()}
    assert set(depth) == {i for i, _ in rows} and all(1 <= d <= 32 for d in depth.values())
    code = dict(rows)
    assert {tuple(r) for r in hamming.prefix_search(df, df, lossy).collect()} == {(q, c, d) for q, c, d in exact if ham(code[q], code[c], depth[c]) <= 3}


def test_leaf_depths_follow_the_insertion_order(spark):
    rows = [(i, [i & 1, 0, 0, 0, 0, 0, 0, 0]) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, code array<bigint>")
    got = {r.id: r.depth for r in hamming.leaf_depths(df, TrieConfig(split_threshold=3)).collect()}
    assert all(d > 1 for d in got.values()) and len(set(got.values())) <= 2  # equal codes part nowhere, so leaves sink as they fill


def plain_leaf_depths(rows, limit):
    """Insertion one by one into a tree of one-character labels."""
    path = lambda code: [sum((w >> i & 1) << j for j, w in enumerate(code)) for i in range(32)]
    leaves, inner = {}, {()}
    for i, code in rows:
        p, d = path(code), 0
        while tuple(p[:d]) in inner and d < 32:
            d += 1
        held = leaves.setdefault(tuple(p[:d]), [])
        held.append((i, p))
        if d < 32 and limit <= len(held):
            inner.add(tuple(p[:d]))
            for j, q in leaves.pop(tuple(p[:d])):
                leaves.setdefault(tuple(q[: d + 1]), []).append((j, q))
    return {i: len(k) for k, held in leaves.items() for i, _ in held}


@pytest.mark.parametrize("at_once", [1, 4, 10**6])
def test_leaf_depths_level_by_level(spark, codes, at_once):
    """Few different codes, some very common: the same leaves whether a task builds a node or levels do."""
    rng = random.Random(5)
    base = [[rng.getrandbits(3) for _ in range(8)] for _ in range(3)]
    rows = [(i, list(rng.choice(base))) for i in range(60)]
    for _, code in rows[::3]:
        code[rng.randrange(8)] ^= 1 << rng.randrange(5)
    df = spark.createDataFrame(rows, "id long, code array<bigint>")
    found = hamming.leaf_depths(df, TrieConfig(split_threshold=5), at_once=at_once)
    assert {r.id: r.depth for r in found.collect()} == plain_leaf_depths(rows, 5) and found.count() == len(rows)


def test_early_exit_search(spark, codes):
    rows, df = codes
    early = lambda a, b: next((n for k in range(1, 9) if (n := ham(a[:k], b[:k])) > 6), ham(a, b))
    odd = [(500, [0xFF, 0xFF00, 0, 0, 0, 0, 0, 0]), (501, [0] * 8)]
    both = spark.createDataFrame([*rows, *odd], "id long, code array<bigint>")
    got = [(r["query"], r.candidate, r.prefix_distance) for r in hamming.early_exit_search(both, both, 8, 6).collect()]
    want = {(q, c, early(a, b)) for q, a in rows + odd for c, b in rows + odd if early(a, b) <= 8}
    assert set(got) == want and len(got) == len(want) and (500, 501, 8) in want  # 16 positions differ
    plan = hamming.early_exit_search(both, both, 8, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "band" in plan


def test_trie_index_judges_by_the_early_count(spark, curves, monkeypatch):
    from nearpath.plans import index

    rows = [(1, [0] * 8), (2, [0xFF, 0xFF00, 0, 0, 0, 0, 0, 0]), (3, [0x1FF] + [0] * 7)]
    signed = spark.createDataFrame(rows, "id long, hashes array<bigint>")
    monkeypatch.setattr(index.collide, "signatures", lambda *_: signed)
    near = spark.createDataFrame([(i, [(0.0, 0.0)]) for i in (1, 2, 3)], "id long, pts array<struct<x:double,y:double>>")
    got = {tuple(r) for r in TrieIndex(near, LSH, TrieConfig(distance=1.0)).query(near).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1), (2, 3), (3, 2)}  # nine differing positions in the first word are too many


def test_tree_statistics(spark, codes):
    rows, df = codes
    config = TrieConfig(split_threshold=4)
    depths = hamming.leaf_depths(df, config)
    got = hamming.index_statistics(df, depths, config).first()
    depth = {r.id: r.depth for r in depths.collect()}
    path = {i: tuple(sum((w >> p & 1) << j for j, w in enumerate(code)) for p in range(depth[i])) for i, code in rows}
    nodes = {p[:k] for p in path.values() for k in range(1, len(p) + 1)}
    assert (got.size, got.leaves, got.splits, got.max_depth) == (len(rows), len(set(path.values())), len(nodes - set(path.values())), max(depth.values()))
    edges = hamming.tree_edges(df, depths).collect()
    assert len(edges) == len(nodes) and sum(e.sketches for e in edges if e.leaf) == len(rows)


def test_edit_distance(spark):
    rng = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rows = [([rng.randint(0, 3) for _ in range(rng.randint(0, 7))], [rng.randint(0, 3) for _ in range(rng.randint(0, 7))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>").select("a", "b", evaluate.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == plain(r.a, r.b) for r in got)


def test_collisions(curves):
    signed = collide.signatures(curves, Family.draw(LSH, 8)).cache()
    rows = {r.id: r.hashes for r in signed.collect()}
    want = {(q, c, n) for q, a in rows.items() for c, b in rows.items() if (n := sum(x == y for x, y in zip(a, b)))}
    assert {tuple(r) for r in collide.scores(signed, signed).collect()} == want
    assert all((i, i, 8) in want for i in rows)
    assert {tuple(r) for r in collide.scores(signed, signed, at_once=2).collect()} == want  # most buckets are dealt
    some = signed.filter("id < 9")
    assert {tuple(r) for r in collide.scores(some, signed, at_once=3).collect()} == {w for w in want if w[0] < 9}
    assert {r.t: r.distinct_hashes for r in collide.distinct_hashes(signed).collect()} == {t: len({h[t] for h in rows.values()}) for t in range(8)}


def test_score_cut(spark):
    scored = spark.createDataFrame([(0, i, s) for i, s in enumerate([1] * 5 + [2] * 3 + [8] * 2)], "query long, candidate long, score int")
    for fraction, want in ((0.0, 0), (0.04, 0), (0.5, 1), (0.51, 1), (0.55, 2), (0.8, 2), (1.0, 8)):
        assert verify.score_cut(scored, fraction).first().cut == want, fraction


def test_indexes(curves):
    truth = {(r.query, r.candidate) for r in evaluate.distance_matrix(curves, curves).filter("distance <= 1").collect()}
    found = {tuple(r) for r in TableIndex(curves, LSH, TableConfig(distance=1.0, verify_fraction=1.0)).query(curves).collect()}
    assert found and found <= truth
    loose = {tuple(r) for r in TableIndex(curves, LSH).query(curves).collect()}
    assert found <= loose
    part = {tuple(r) for r in TableIndex(curves, LSH, TableConfig(distance=1.0, verify_fraction=0.3)).query(curves).collect()}
    assert found <= part <= loose
    assert {(i, i) for i in (r.id for r in curves.collect())} <= {tuple(r) for r in TrieIndex(curves, LSH).query(curves).collect()}


def test_quality(spark):
    pairs = lambda *p: spark.createDataFrame(list(p), "query long, candidate long")
    got = evaluate.confusion(pairs((1, 1), (1, 2), (2, 2)), pairs((1, 1), (2, 3)), 3, 4).first()
    assert (got.tp, got.fp, got.fn, got.tn) == (1, 1, 2, 8) and (got.precision, got.recall, got.f1) == (0.5, 0.33, 0.4)
    asked = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    each = {r["query"]: (r.tp, r.fp, r.fn, r.precision, r.recall, r.f1) for r in evaluate.scores_per_query(pairs((1, 1), (1, 2)), pairs((1, 1), (2, 3)), asked).collect()}
    assert each == {1: (1, 0, 1, 1.0, 0.5, 0.67), 2: (0, 1, 0, 0.0, None, 0.0), 9: (0, 0, 0, 0.0, 0.0, 0.0)}
    nothing = evaluate.confusion(pairs((1, 1)).limit(0), pairs((1, 1)).limit(0), 3, 4).first()
    assert (nothing.tp, nothing.tn, nothing.precision) == (0, 12, None)


def test_sources(spark, tmp_path):
    (tmp_path / "taxi.csv").write_text('TRIP_ID,POLYLINE,MISSING_DATA\n5,"[[-8.6,41.1],[-8.7,41.2]]",False\n6,"[[1,2]]",True\n')
    assert sorted(map(tuple, P.read_polyline_csv(spark, str(tmp_path / "taxi.csv")).collect())) == [(5, 0, 41.1, -8.6), (5, 1, 41.2, -8.7)]
    (tmp_path / "t.txt").write_text("h\n" * 4 + "0 1.5 2.5 3\n1 1.6 2.6 3\n2 9 8 7\n")
    rows = P.read_trajectory_text(spark, str(tmp_path / "t.txt"), points_each=2).collect()
    assert len({r.id for r in rows}) == 2 and sorted((r.ord, r.x, r.y) for r in rows) == [(0, 2.5, 1.5), (0, 8.0, 9.0), (1, 2.6, 1.6)]
    (tmp_path / "b.bin").write_bytes(struct.pack("<3q", 1, -2, 3))
    assert [r.code for r in P.read_binary_sketches(spark, str(tmp_path / "b.bin")).orderBy("pos").collect()] == [[1], [-2], [3]]
    (tmp_path / "v.bvecs").write_bytes(b"".join(struct.pack("<I", 32) + bytes(range(1, 33)) for _ in range(2)))
    assert [r.code for r in P.read_bvecs(spark, str(tmp_path / "v.bvecs"), 3, width=32).collect()] == [[1431655765, 1717986918, 2021161080]] * 2
    (tmp_path / "r.json").write_text('{"name": "x", "candidates": {"7": ["1", "2"], "8": []}}')
    assert sorted(map(tuple, P.read_results_json(spark, str(tmp_path / "r.json")).collect())) == [(7, 1), (7, 2)]
    spark.createDataFrame([(1, 0.5, 0.1), (1, 0.6, 0.2), (2, 0.0, 0.0)], P.POINTS).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert {r.id: [tuple(p) for p in r.pts] for r in P.assemble(P.read_points(spark, str(tmp_path / "p"))).collect()}[1] == [(0.5, 0.1), (0.6, 0.2)]
    P.write_pairs(spark.createDataFrame([(1, 2)], "query int, candidate int"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).dtypes == [("query", "bigint"), ("candidate", "bigint")]
    wide = P.wide_matrix(spark.createDataFrame([(1, 5, 0.5), (2, 5, 0.7)], "query long, candidate long, distance double"), [1, 2])
    assert sorted(map(tuple, P.unpivot_matrix(wide).collect())) == [(1, 5, 0.5), (2, 5, 0.7)]


def test_nulls_and_empty(spark, curves):
    rows = spark.createDataFrame([(1, 0, 1.0, None), (None, 0, 1.0, 1.0), (2, 0, 1.0, 1.0)], "id long, ord long, x double, y double")
    assert [r.id for r in P.assemble(rows).collect()] == [2]
    none = curves.limit(0)
    assert TableIndex(none, LSH).query(curves).count() == 0 and TrieIndex(none, LSH).query(none).count() == 0


def test_streaming_appends_like_one_batch(spark, curves, tmp_path):
    family = Family.draw(LSH, 8)
    for part in range(3):
        curves.filter(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(curves.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = append_signatures(stream, family, str(tmp_path / "table"), str(tmp_path / "ckpt"))
    running.processAllAvailable()
    running.stop()
    got = {r.id: r.hashes for r in spark.read.parquet(str(tmp_path / "table")).collect()}
    assert got == {r.id: r.hashes for r in collide.signatures(curves, family).collect()}


def test_command_line(spark, tmp_path, capsys):
    from nearpath.plans import run

    rows = [(i, float(o), float(i % 5)) for i in range(20) for o in range(2)]
    spark.createDataFrame(rows, P.POINTS).coalesce(1).write.parquet(str(tmp_path / "d.parquet"))
    (tmp_path / "c.toml").write_text("[lsh]\nresolution = 3.0\n[index]\nbits = 8\nradius = 8\nerrors = 8\n")
    run.main(["build", "--data", str(tmp_path / "d.parquet"), "-c", str(tmp_path / "c.toml"), "--out", str(tmp_path / "sig")])
    run.main(["query", "--data", str(tmp_path / "d.parquet"), "--queries", str(tmp_path / "d.parquet"), "-c", str(tmp_path / "c.toml"), "--out", str(tmp_path / "out")])
    assert '"queries_with_candidates": 20' in capsys.readouterr().out
    assert {(i, i) for i in range(20)} <= {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    flags = ["--resolution", "3", "-l", "8", "--bits", "8", "--errors", "8"]
    run.main(["build", "--data", str(tmp_path / "d.parquet"), *flags, "--out", str(tmp_path / "sig2"), "--steps", "3"])
    stats = json.loads(capsys.readouterr().out)
    assert stats["index_stats"]["size"] == stats["trajectories"] == 20 and 1 <= len(stats["mem"]) <= 3 and "20" in stats["mem"]
    signed = lambda name: {tuple([r.id, *r.hashes]) for r in spark.read.parquet(str(tmp_path / name)).collect()}
    assert signed("sig") == signed("sig2") and len(signed("sig")) == 20
    run.main(["query", "--data", str(tmp_path / "d.parquet"), "--queries", str(tmp_path / "d.parquet"), "--resolution", "3", "--distance", "1", "--verify-fraction", "1", "--out", str(tmp_path / "out2"), "--candidates", str(tmp_path / "json")])
    stats = json.loads(capsys.readouterr().out)
    found = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    assert {tuple(r) for r in P.read_results_json(spark, str(tmp_path / "json"), lines=True).collect()} == found and stats["index_query_size"] == len(found)
    assert stats["config"]["index"] == {"distance": 1.0, "verify_fraction": 1.0} and stats["dataset_load"] >= 0
    with pytest.raises(SystemExit):
        run.main(["build", "--data", "x", "--out", "y"])
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "e.parquet").mkdir()
    assert run.list_datasets(spark, str(tmp_path)) == [str(tmp_path / "d.parquet"), str(tmp_path / "deep" / "e.parquet")] and len(list(run.grid(k=[2, 3], l=[8, 16]))) == 4


def test_polyline_and_json(spark, tmp_path):
    line = spark.createDataFrame([(1, [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)])], "id long, pts array<struct<x:double,y:double>>")
    assert line.select(P.polyline(F.col("pts"))).first()[0] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    P.write_json(line, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().points[1] == [40.7, -120.95]


def test_truth_holds_near_pairs_that_never_collide(spark, monkeypatch):
    from nearpath.plans import queries

    rng = random.Random(3)
    walk = lambda: [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(rng.randint(1, 3))]
    rows = [(i, walk()) for i in range(60)] + [(60, [(0.0, 0.0)]), (61, [(4.0, 0.0)]), (62, [(-4.0, 0.0)]), (63, [])]
    curves = spark.createDataFrame(rows, "id long, pts array<struct<x:double,y:double>>")
    want = {(r["query"], r.candidate) for r in evaluate.distance_matrix(curves, curves).filter("distance <= 4").collect()}
    got = [(r["query"], r.candidate) for r in evaluate.near_pairs(curves, curves, 4.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want and (60, 61) in want and (60, 62) in want and (63, 5) in want
    curves = curves.filter("id <> 63")
    near = len([1 for a, b in want if 63 not in (a, b)])
    monkeypatch.setattr(queries, "line_curves", lambda *_: curves)
    r = queries.seed_summary(spark, "").first()
    assert r.avg_tp + r.avg_fn == near
    r = queries.confusion(spark, "").first()
    assert r.tp + r.fn == near
    signed = collide.signatures(curves, queries.family_for(queries.LINE_LSH))
    assert near > verify.verify_all(collide.scores(signed, signed), curves, curves, 4.0).count()  # some never collide
