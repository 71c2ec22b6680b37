"""Tables of copies under other keys: the same results as SQL, and equal curves meet once."""

import duckdb
import pytest

from nearpath.operators import collide, copies, evaluate
from nearpath.plans import files  # noqa: F401
from nearpath.plans import queries as search
from tests.test_entry import SF, pytestmark, rows_of  # noqa: F401

TIMES, CURVES, USERS = 4, 60, 5


@pytest.fixture(scope="module")
def copied(tmp_path_factory):
    """Few orders and users, each several times."""
    place, con = tmp_path_factory.mktemp("copied"), duckdb.connect()
    shifted = {
        "lineitem": f"SELECT l.* REPLACE (l_orderkey + 1000000 * i AS l_orderkey) FROM '{SF}/lineitem.parquet' l, range({TIMES}) r(i) WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM '{SF}/lineitem.parquet' ORDER BY 1 LIMIT {CURVES})",
        "events": f"SELECT e.* REPLACE (user_id + 1000000 * i AS user_id, event_id + 1000000 * i AS event_id) FROM '{SF}/events.parquet' e, range({TIMES}) r(i) WHERE user_id IN (SELECT DISTINCT user_id FROM '{SF}/events.parquet' ORDER BY 1 LIMIT {USERS})",
    }
    for name, sql in shifted.items():
        con.execute(f"COPY ({sql}) TO '{place}/{name}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{place}/{name}.parquet'")
    return str(place), con


def noting(f, seen, at):
    def call(*args, **kwargs):
        seen.append(args[at].count())
        return f(*args, **kwargs)

    return call


@pytest.mark.parametrize("name", ["confusion", "scores_per_query", "quality_summary", "frechet_range", "table_index", "candidates_by_query", "collision_scores", "frechet_of_collisions", "pair_file", "candidates_per_query", "hamming_of_collisions", "seed_summary", "collision_join", "partial_verify_scores", "results_json"])
def test_curves_collide_once(spark, copied, monkeypatch, name):
    place, con = copied
    seen = []
    monkeypatch.setattr(collide, "_met", noting(collide._met, seen, 1))
    assert rows_of(search.QUERIES[name](spark, place).toPandas()) == rows_of(con.sql(search.ORACLES[name]).df())
    assert seen and max(seen) <= CURVES


def test_near_curves_are_compared_once(spark, copied, monkeypatch):
    place, con = copied
    seen = []
    monkeypatch.setattr(evaluate, "verify_all", noting(evaluate.verify_all, seen, 0))
    got = rows_of(search.QUERIES["near_pairs"](spark, place).toPandas())
    assert got == rows_of(con.sql(search.ORACLES["near_pairs"]).df())
    assert seen and max(seen) < len(got[0]) / TIMES


@pytest.mark.parametrize("name", ["frechet_matrix", "percentiles", "hash_correlation", "histogram", "frechet_filter"])
def test_distances_are_computed_once(spark, copied, monkeypatch, name):
    place, con = copied
    seen = []
    monkeypatch.setattr(evaluate, "with_distance", noting(evaluate.with_distance, seen, 0))
    assert rows_of(search.QUERIES[name](spark, place).toPandas()) == rows_of(con.sql(search.ORACLES[name]).df())
    assert seen and max(seen) <= USERS * (USERS + 1) // 2


@pytest.mark.parametrize("at_once", [2, 4096])
def test_fold(spark, at_once):
    """Very common values are gathered in parts, and no row is lost."""
    rows = [(i, [i % 3, 0] if i % 5 else [i, 1]) for i in range(60)]
    f = copies.fold(spark.createDataFrame(rows, "id long, hashes array<bigint>"), "hashes", at_once)
    held = {}
    for r in f.members.collect():
        held.setdefault(r.id, []).extend(r.ids)
    by = {}
    for i, v in rows:
        by.setdefault(tuple(v), []).append(i)
    assert {k: sorted(v) for k, v in held.items()} == {min(v): v for v in by.values()}
    assert {(r.id, tuple(r.hashes), r.copies) for r in f.classes.collect()} == {(min(v), k, len(v)) for k, v in by.items()}
    if at_once == 2:
        assert f.members.count() > f.classes.count()
    pairs = [(min(a), min(b)) for a in by.values() for b in by.values()]
    got = [tuple(r) for r in copies.expand(spark.createDataFrame(pairs, "query long, candidate long"), f, f).collect()]
    assert len(got) == 3600 and len(set(got)) == 3600


def test_vector_pairs_are_compiled(spark):
    """Codes are made once, and no pair goes through an interpreted function."""
    plan = search.QUERIES["hash_vector_distances"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" not in plan


def test_trie_codes_are_made_once(spark, monkeypatch):
    from nearpath.plans import index

    plans, found = [], index.hamming.early_exit_search
    monkeypatch.setattr(index.hamming, "early_exit_search", lambda a, b, *rest: plans.append(b._jdf.queryExecution().optimizedPlan().toString()) or found(a, b, *rest))
    search.QUERIES["trie_index"](spark, SF)
    assert plans and "MapInArrow" not in plans[0]


def test_early_exit_codes_are_made_once(spark):
    assert "MapInArrow" not in search.QUERIES["hamming_early_exit"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_of_curves_meet(spark, monkeypatch):
    """All pairs, each of one set measured once; a curve goes to a task once for a block, not for each pair."""
    import numpy as np

    from nearpath.functions import frechet as measure

    rng = np.random.default_rng(3)
    curves = {i: rng.random((1 + i % 9, 2)) for i in range(40)}
    frame = lambda ids: spark.createDataFrame([(i, [tuple(map(float, p)) for p in curves[i]]) for i in ids], "id long, pts array<struct<x:double,y:double>>")
    cores, seen = spark.sparkContext.defaultParallelism, []
    monkeypatch.setattr(evaluate, "with_distance", noting(evaluate.with_distance, seen, 0))
    monkeypatch.setattr(measure._block_distances, "__defaults__", (7,))
    rows, few = frame(range(40)), frame(range(7))
    blocks = min(40, 4 * cores)
    for queries, data, n, pairs, most in ((rows, rows, 40, 820, blocks * (blocks + 1) // 2), (few, rows, 7, 280, 7 * blocks)):
        got = [tuple(r) for r in evaluate.distance_matrix(queries, data, 6).collect()]
        want = {(i, j): float(measure.frechet(curves[i][None], curves[j][None])[0]) for i in range(n) for j in range(40)}
        assert len(got) == len(want) and all(abs(want[i, j] - d) < 1e-6 and d == round(d, 6) for i, j, d in got)
        assert {(i, j) for i, j, _ in got} == set(want) and seen.pop() <= most < pairs


@pytest.mark.parametrize("empty", [0, 2])
def test_near_pairs_are_checked_in_one_order(spark, monkeypatch, empty):
    """Curves of one set meet once; only empty ones, if there are any, meet all others."""
    rows = [(i, [(float(i), 0.0), (float(i), 1.0)]) for i in range(20)] + [(100 + i, []) for i in range(empty)]
    seen = []
    monkeypatch.setattr(evaluate, "verify_all", noting(evaluate.verify_all, seen, 0))
    frame = spark.createDataFrame(rows, "id long, pts array<struct<x:double,y:double>>")
    near = evaluate.near_pairs(frame, frame, 4.0)
    got = [tuple(r) for r in near.collect()]
    want = {(i, j) for i, p in rows for j, q in rows if not p or not q or abs(i - j) <= 4}
    assert len(got) == len(want) and set(got) == want
    assert seen == [sum(i <= j for i, j in want if j < 100)]
    assert empty or "Union" not in near._jdf.queryExecution().optimizedPlan().toString()


def exchanged(frame):
    """Columns of each shuffle of a plan."""
    import re

    text = frame._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"\n[ :+|-]*(?:Aggregate|Join) ", "\n" + text)), text


@pytest.mark.parametrize("name", ["collision_scores", "collision_join", "hamming_of_collisions"])
def test_colliding_pairs_are_not_shuffled(spark, name):
    """A pair is scored in the first table in which it collides: one join, and nothing is grouped by pairs."""
    steps, text = exchanged(search.QUERIES[name](spark, SF))
    assert steps == 1 and "Aggregate" not in text


@pytest.mark.parametrize("name, steps", [("frechet_of_collisions", 1), ("frechet_range", 1), ("partial_verify_scores", 4), ("table_index", 4)])
def test_checked_pairs_are_not_shuffled(spark, name, steps):
    """Pairs carry their points: one join each time they are found, and one with the cut."""
    found, text = exchanged(search.QUERIES[name](spark, SF))
    assert found == steps and "Aggregate" not in text


@pytest.mark.parametrize("name", ["histogram", "hash_correlation"])
def test_measured_pairs_are_not_shuffled(spark, monkeypatch, name):
    """Hashes and copies go with the blocks: pairs meet no other table and are not written."""
    written, found = [], evaluate.cut
    monkeypatch.setattr(evaluate, "cut", lambda df, n: written.append(n) or found(df, n))
    text = search.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    measured = text[: text.index("MapInArrow")]
    assert "Join Inner, (" not in measured and "Join LeftOuter" not in measured and set(written) <= {"blocks", "means"}


@pytest.mark.parametrize("at_once", [2, 4096])
def test_large_classes_collide_too(spark, at_once):
    """Ids of small classes travel with the pairs; those of larger ones are found by a join, and no pair is lost."""
    rows = [(i, [1, 2]) for i in range(copies.FEW + 6)] + [(100 + i, [1, 3]) for i in range(3)] + [(200, [5, 3]), (201, [9, 9])]
    frame = spark.createDataFrame(rows, "id long, hashes array<bigint>")
    assert copies.fold(frame, "hashes", at_once).many
    got = [tuple(r) for r in collide.scores(frame, frame, at_once).collect()]
    want = {(i, j, n) for i, a in rows for j, b in rows if (n := sum(x == y for x, y in zip(a, b)))}
    assert len(got) == len(want) and set(got) == want
