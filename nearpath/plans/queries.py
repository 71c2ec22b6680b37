"""The registered queries over the test tables, and their SQL.

Query set and data set are the whole table each time (a self-join, equal pairs included).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.config import LshConfig, TableConfig, TrieConfig
from nearpath.functions import curves as C
from nearpath.functions import sketch as S
from nearpath.functions.frechet import with_distance
from nearpath.functions.lsh import Family, linear_hash, multi_hash, perturbed_hash
from nearpath.operators import collide, evaluate, hamming, preprocess, verify
from nearpath.operators.copies import Folded, expand, fold, weighed
from nearpath.plans import oracles as O
from nearpath.plans.index import TableIndex, TrieIndex, family_for
from nearpath.sources import points as P
from nearpath.sources.store import cut

LINE_LSH = LshConfig(resolution=6.0, seed=11)
VECTOR_LSH = LshConfig(resolution=0.9, seed=5)
HOUR_LSH = LshConfig(resolution=120.0, seed=7)
DISTANCE = 4.0
FRACTION = 0.25
RADIUS = 8
#: Coefficients in the SQL: more than the points of any curve of the test tables.
_SQL_POINTS = 400

Spark = SparkSession


def line_curves(spark: Spark, sf: str) -> DataFrame:
    return P.assemble(P.lineitem_points(spark, sf), P.line_place)


def event_curves(spark: Spark, sf: str) -> DataFrame:
    return P.assemble(P.event_points(spark, sf))


def vector_curves(spark: Spark, sf: str) -> DataFrame:
    return P.assemble(P.embedding_points(spark, sf))


def hour_curves(spark: Spark, sf: str) -> DataFrame:
    return P.assemble(P.hour_points(spark, sf))


def line_signatures(spark: Spark, sf: str) -> DataFrame:
    return collide.signatures(line_curves(spark, sf), family_for(LINE_LSH))


def line_classes(spark: Spark, sf: str) -> tuple[Folded, Folded]:
    """Classes of equal curves, with their points and with their signatures."""
    curves = fold(line_curves(spark, sf), "pts")
    return curves, collide.signed_classes(curves, family_for(LINE_LSH))


def vector_codes(spark: Spark, sf: str) -> DataFrame:
    return collide.signatures(vector_curves(spark, sf), family_for(VECTOR_LSH)).withColumnRenamed("hashes", "code")


def line_codes(spark: Spark, sf: str) -> DataFrame:
    return line_signatures(spark, sf).withColumnRenamed("hashes", "code")


_LINE = Family.draw(LINE_LSH, 64)
_LINE_MOVED = Family.draw(LINE_LSH, 64, perturbed=True)
_VECTOR = Family.draw(VECTOR_LSH, _SQL_POINTS)
_HOUR = Family.draw(HOUR_LSH, 64)
QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# sources and curves

@query(f"WITH p AS ({O.EVENTS}) SELECT id, count(*)::INTEGER AS n_points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM p GROUP BY id")
def assemble_stats(spark: Spark, sf: str) -> DataFrame:
    return preprocess.statistics(event_curves(spark, sf))


@query(f"WITH p AS ({O.LINES}) SELECT max(n)::INTEGER AS max_points, count(*) AS curves FROM (SELECT count(*) AS n FROM p GROUP BY id)")
def dataset_size(spark: Spark, sf: str) -> DataFrame:
    return line_curves(spark, sf).agg(F.max(F.size("pts")).alias("max_points"), F.count("*").alias("curves"))


@query(f"WITH p AS ({O.LINES}), c AS (SELECT DISTINCT id FROM p ORDER BY id LIMIT 100) SELECT p.id, count(*)::INTEGER AS n_points FROM p JOIN c ON p.id = c.id GROUP BY p.id")
def first_100(spark: Spark, sf: str) -> DataFrame:
    return P.first_n(line_curves(spark, sf), 100).select("id", F.size("pts").alias("n_points"))


@query(f"WITH p AS ({O.EVENTS}), s AS (SELECT id, ord, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) * 111.32 AS step FROM p WINDOW w AS (PARTITION BY id ORDER BY ord)) SELECT id, count(step) AS steps, round(max(step), 6) AS longest FROM s GROUP BY id")
def step_lengths(spark: Spark, sf: str) -> DataFrame:
    return P.step_lengths(P.event_points(spark, sf)).groupBy("id").agg(F.count("step").alias("steps"), F.round(F.max("step"), 6).alias("longest"))


@query(f"WITH p AS ({O.LINES}), s AS (SELECT id, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) * 111.32 AS step FROM p WINDOW w AS (PARTITION BY id ORDER BY ord)) SELECT id FROM s GROUP BY id HAVING coalesce(max(step), 0) < 4000")
def short_steps(spark: Spark, sf: str) -> DataFrame:
    return preprocess.short_steps(line_curves(spark, sf), 4000).select("id")


@query(f"WITH p AS ({O.LINES}) SELECT id, count(*)::INTEGER AS n_points FROM p GROUP BY id HAVING count(*) BETWEEN 3 AND 6")
def point_count(spark: Spark, sf: str) -> DataFrame:
    return preprocess.point_count(line_curves(spark, sf), 3, 6).select("id", F.size("pts").alias("n_points"))


@query(f"WITH p AS ({O.LINES}) SELECT id, count(*) AS points FROM (SELECT DISTINCT id, x, y FROM p) GROUP BY id")
def distinct_points(spark: Spark, sf: str) -> DataFrame:
    return preprocess.distinct_points(P.lineitem_points(spark, sf)).groupBy("id").agg(F.count("*").alias("points"))


@query(f"WITH p AS ({O.VECTORS}) SELECT id, ord::INTEGER AS ord, round(sqrt(x * x + y * y), 6) AS r, round(atan2(y, x), 6) AS theta FROM p")
def polar_points(spark: Spark, sf: str) -> DataFrame:
    rows = P.embedding_points(spark, sf).select("id", (F.col("ord") + 1).cast("int").alias("ord"), C.polar(F.col("x"), F.col("y")).alias("p"))
    return rows.select("id", "ord", F.round("p.r", 6).alias("r"), F.round("p.theta", 6).alias("theta"))


@query("WITH s AS (SELECT DISTINCT user_id AS id FROM events), q AS (SELECT id FROM s ORDER BY md5('42:' || id), id LIMIT 20) SELECT s.id, q.id IS NOT NULL AS sampled FROM s LEFT JOIN q ON s.id = q.id")
def sample_split(spark: Spark, sf: str) -> DataFrame:
    curves = event_curves(spark, sf).select("id")
    asked, rest = P.split(curves, P.sample_ids(curves, 20))
    return asked.withColumn("sampled", F.lit(True)).unionByName(rest.withColumn("sampled", F.lit(False)))


# base hashes

@query(f"WITH pts AS ({O.VECTORS}), fam AS (SELECT 0 AS f, 0.05::DOUBLE AS sx, 0.1::DOUBLE AS sy), cells AS ({O.snapped('pts', 'fam', 0.2)}) SELECT id, i::INTEGER AS i, cx, cy FROM cells")
def grid_dedup(spark: Spark, sf: str) -> DataFrame:
    cells = C.drop_repeats(C.snap(F.col("pts"), 0.2, 0.05, 0.1))
    return vector_curves(spark, sf).select("id", F.posexplode(cells).alias("i", "c")).select("id", "i", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


@query(f"WITH {O.base_hashes(O.VECTORS, _VECTOR)} SELECT id, h AS hash FROM base WHERE f = 0")
def linear_hashes(spark: Spark, sf: str) -> DataFrame:
    curves = vector_curves(spark, sf)
    return curves.select("id", linear_hash(F.col("pts"), family_for(VECTOR_LSH, curves).left[0][0], VECTOR_LSH.resolution).alias("hash"))


@query(f"WITH {O.base_hashes(O.LINES, _LINE_MOVED, perturbed=True)} SELECT id, h AS hash FROM base WHERE f = 0")
def perturbed_hashes(spark: Spark, sf: str) -> DataFrame:
    curves = line_curves(spark, sf)
    return curves.select("id", perturbed_hash(F.col("pts"), family_for(LINE_LSH, curves, perturbed=True).left[0][0], LINE_LSH.resolution).alias("hash"))


@query(f"WITH {O.signatures(O.LINES, _LINE)} SELECT id, t, hash FROM sig")
def multi_hashes(spark: Spark, sf: str) -> DataFrame:
    return collide.buckets(line_signatures(spark, sf))


@query(f"WITH {O.signatures(O.LINES, _LINE_MOVED, perturbed=True)} SELECT id, t, hash FROM sig")
def perturbed_multi_hashes(spark: Spark, sf: str) -> DataFrame:
    return collide.buckets(collide.signatures(line_curves(spark, sf), family_for(LINE_LSH, perturbed=True)))


@query(f"WITH {O.signatures(O.LINES, _LINE)} SELECT id, t, hash FROM sig")
def multi_hashes_expression(spark: Spark, sf: str) -> DataFrame:
    """The same hashes by column expressions alone."""
    curves = line_curves(spark, sf)
    return curves.select("id", F.posexplode(multi_hash(F.col("pts"), family_for(LINE_LSH, curves))).alias("t", "hash"))


# collisions

@query(f"WITH {O.signatures(O.LINES, _LINE)} SELECT t, count(DISTINCT hash) AS distinct_hashes FROM sig GROUP BY t")
def distinct_hashes(spark: Spark, sf: str) -> DataFrame:
    return collide.distinct_hashes(line_signatures(spark, sf))


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.COLLIDE} SELECT query, candidate FROM scored")
def collision_join(spark: Spark, sf: str) -> DataFrame:
    _, signed = line_classes(spark, sf)
    return expand(collide.class_scores(signed, signed, kept=("few",)).drop("score"), signed, signed)


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.COLLIDE} SELECT query, candidate, score FROM scored")
def collision_scores(spark: Spark, sf: str) -> DataFrame:
    _, signed = line_classes(spark, sf)
    return expand(collide.class_scores(signed, signed, kept=("few",)), signed, signed)


@query(f"WITH {O.signatures(O.LINES, _LINE)} SELECT DISTINCT id AS query FROM sig")
def colliding_queries(spark: Spark, sf: str) -> DataFrame:
    signed = line_signatures(spark, sf)
    return collide.colliding_queries(signed, signed)


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.COLLIDE} SELECT query, count(*) AS candidates FROM scored GROUP BY query")
def candidates_per_query(spark: Spark, sf: str) -> DataFrame:
    _, signed = line_classes(spark, sf)
    return collide.class_counts(signed, signed)


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.COLLIDE} SELECT query, array_to_string(list(candidate ORDER BY candidate), ',') AS candidates FROM scored GROUP BY query")
def candidates_by_query(spark: Spark, sf: str) -> DataFrame:
    _, signed = line_classes(spark, sf)
    return collide.class_lists(signed, signed, lambda ids: F.concat_ws(",", F.transform(F.sort_array(ids), lambda c: c.cast("string"))))


_CUT = f"hist AS (SELECT score, sum(count(*)) OVER (ORDER BY score) AS up_to, floor(sum(count(*)) OVER () * {FRACTION} + 0.5) AS wanted FROM scored GROUP BY score), cut AS (SELECT coalesce(min(score), 0)::INTEGER AS cut FROM hist WHERE up_to >= wanted)"


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.COLLIDE}, {_CUT} SELECT cut FROM cut")
def score_threshold(spark: Spark, sf: str) -> DataFrame:
    signed = line_signatures(spark, sf)
    return verify.score_cut(collide.scores(signed, signed), FRACTION)


# sketches

@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.codes(8)} SELECT id, i::INTEGER AS i, ({' | '.join(f'(((c{j} >> i) & 1) << {j})' for j in range(8))})::INTEGER AS c FROM code, range(0, 32) AS r(i)")
def char_at(spark: Spark, sf: str) -> DataFrame:
    return line_codes(spark, sf).select("id", F.posexplode(S.characters(F.col("code"))).alias("i", "c"))


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.codes(8)} SELECT id, i::INTEGER AS i, ({' | '.join(f'(((c{j} >> (2 * i)) & 1) << {j}) | (((c{j} >> (2 * i + 1)) & 1) << {j + 4})' for j in range(4))})::INTEGER AS b FROM code, range(0, 16) AS r(i)")
def pack_bytes(spark: Spark, sf: str) -> DataFrame:
    rows = line_codes(spark, sf).select("id", F.slice("code", 1, 4).alias("code"))
    return rows.select("id", F.posexplode(S.pack_bytes(F.col("code"), 4)).alias("i", "b")).select("id", "i", F.col("b").cast("int").alias("b"))


@query(f"WITH {O.signatures(O.VECTORS, _VECTOR)}, {O.codes(8)} SELECT a.id AS query, b.id AS candidate, bit_count({O.mask(8)})::INTEGER AS distance FROM code a, code b WHERE bit_count({O.mask(8)}) <= {RADIUS}")
def hamming_linear(spark: Spark, sf: str) -> DataFrame:
    codes = vector_codes(spark, sf)
    return hamming.linear_search(codes, codes, RADIUS)


@query(ORACLES["hamming_linear"])
def hamming_banded(spark: Spark, sf: str) -> DataFrame:
    codes = vector_codes(spark, sf)
    return hamming.band_search(codes, codes, RADIUS)


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.codes(8)}, met AS (SELECT DISTINCT a.id AS query, b.id AS candidate FROM sig a JOIN sig b ON a.t = b.t AND a.hash = b.hash) SELECT a.id AS query, b.id AS candidate, bit_count({O.mask(8)})::INTEGER AS distance FROM met JOIN code a ON a.id = query JOIN code b ON b.id = candidate WHERE bit_count({O.mask(8)}) <= {RADIUS}")
def hamming_of_collisions(spark: Spark, sf: str) -> DataFrame:
    _, signed = line_classes(spark, sf)
    met = collide.class_scores(signed, signed, kept=("few", "hashes"))
    apart = met.select("query", "candidate", "qfew", "cfew", S.hamming_words(F.col("qhashes"), F.col("chashes"), LINE_LSH.l).alias("distance"))
    return expand(apart.filter(F.col("distance") <= RADIUS), signed, signed)


def _early(bound: int) -> str:
    part = lambda n: " | ".join(f"xor(a.c{j}, b.c{j})" for j in range(n))
    return "CASE " + " ".join(f"WHEN bit_count({part(n)}) > {bound} THEN bit_count({part(n)})" for n in range(1, 8)) + f" ELSE bit_count({part(8)}) END"


_GREY = f"""grey AS (SELECT query, candidate, CASE WHEN d <= 6 THEN 'accept' WHEN d <= 8 THEN 'check' ELSE 'drop' END AS verdict, d AS prefix_distance
  FROM (SELECT a.id AS query, b.id AS candidate, ({_early(6)})::INTEGER AS d FROM code a, code b))"""


def _vector_pairs(spark: Spark, sf: str) -> DataFrame:
    codes = cut(vector_codes(spark, sf), "codes")  # else signed again for each block of pairs
    return codes.select(F.col("id").alias("query"), F.col("code").alias("qcode")).crossJoin(codes.select(F.col("id").alias("candidate"), F.col("code").alias("ccode")))


@query(f"WITH {O.signatures(O.VECTORS, _VECTOR)}, {O.codes(8)}, {_GREY} SELECT query, candidate, prefix_distance, verdict FROM grey")
def hamming_early_exit(spark: Spark, sf: str) -> DataFrame:
    return verify.grey_zone(_vector_pairs(spark, sf), RADIUS)


def _doubtful(codes: DataFrame) -> DataFrame:
    """Pairs of codes that the early-exit count accepts or leaves in doubt."""
    return hamming.early_exit_search(codes, codes, RADIUS, verify.sure_up_to(RADIUS))


@query(f"WITH {O.signatures(O.VECTORS, _VECTOR)}, {O.codes(8)}, {_GREY} SELECT verdict, count(*) AS pairs FROM grey GROUP BY verdict")
def verification_counters(spark: Spark, sf: str) -> DataFrame:
    codes = cut(vector_codes(spark, sf), "codes")
    return verify.counters(verify.grey_zone(_doubtful(codes), RADIUS), codes.count() ** 2)


_LEAVES = O.leaves(hamming.split_limits(TrieConfig()))
_LOSSY = TrieConfig(errors=4)


@query(f"WITH {O.signatures(O.VECTORS, _VECTOR)}, {O.codes(8)}, {O.leaves(hamming.split_limits(_LOSSY))} SELECT a.id AS query, b.id AS candidate, bit_count({O.mask(8)})::INTEGER AS distance FROM code a, code b JOIN leaf ON leaf.id = b.id WHERE bit_count({O.mask(8)}) <= {RADIUS} AND bit_count(({O.mask(8)}) & ((1::BIGINT << depth) - 1)) <= 4")
def prefix_search(spark: Spark, sf: str) -> DataFrame:
    codes = cut(vector_codes(spark, sf), "codes")
    return hamming.prefix_search(codes, codes, _LOSSY)


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.codes(8)}, {_LEAVES} SELECT id, depth FROM leaf")
def leaf_depths(spark: Spark, sf: str) -> DataFrame:
    return hamming.leaf_depths(cut(line_codes(spark, sf), "codes"), TrieConfig())


def _tree(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame]:
    codes = cut(line_codes(spark, sf), "codes")
    return codes, cut(hamming.leaf_depths(codes, TrieConfig()), "leaf-depths")


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.codes(8)}, {_LEAVES}, {O.CHARACTERS}, n AS (SELECT level, path[1:level] AS node, max(depth) AS last FROM chars JOIN leaf USING (id), unnest(range(1, depth + 1)) AS u(level) GROUP BY 1, 2) SELECT (SELECT count(*) FROM leaf) AS size, (SELECT max(depth) FROM leaf) AS max_depth, (SELECT round(avg(depth), 6) FROM leaf) AS avg_depth, count(*) FILTER (last = level) AS leaves, count(*) FILTER (last > level) AS splits FROM n")
def index_statistics(spark: Spark, sf: str) -> DataFrame:
    codes, depths = _tree(spark, sf)
    return hamming.index_statistics(codes, depths, TrieConfig())


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.codes(8)}, {_LEAVES}, {O.CHARACTERS} SELECT level::INTEGER AS level, array_to_string(path[1:level - 1], '.') AS prefix, path[level] AS label, count(*) AS sketches, max(depth) = level AS leaf FROM chars JOIN leaf USING (id), unnest(range(1, depth + 1)) AS u(level) GROUP BY 1, 2, 3, level")
def tree_edges(spark: Spark, sf: str) -> DataFrame:
    return hamming.tree_edges(*_tree(spark, sf))


_CHAR = lambda i: "(" + " | ".join(f"(((c{j} >> {i}) & 1) << {j})" for j in range(8)) + ")::INTEGER"


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.codes(8)}, e AS (SELECT 0 AS level, '' AS prefix, {_CHAR(0)} AS label FROM code UNION ALL SELECT 1, ({_CHAR(0)})::VARCHAR, {_CHAR(1)} FROM code) SELECT level, prefix, label, count(*) AS sketches FROM e GROUP BY level, prefix, label")
def prefix_edges(spark: Spark, sf: str) -> DataFrame:
    return hamming.prefix_edges(line_codes(spark, sf), 2)


# distances, verification, quality

@query(f"WITH pts AS ({O.EVENTS}), {O.ALL_PAIRS}, {O.distances('pairs')} SELECT query, candidate, round(distance, 6) AS distance FROM dist")
def frechet_matrix(spark: Spark, sf: str) -> DataFrame:
    curves = event_curves(spark, sf)
    return evaluate.distance_matrix(curves, curves, 6)


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.COLLIDE}, {O.distances('scored')} SELECT query, candidate, round(distance, 6) AS distance FROM dist")
def frechet_of_collisions(spark: Spark, sf: str) -> DataFrame:
    curves, signed = line_classes(spark, sf)
    met = collide.class_scores(signed, signed, kept=("few", "pts")).withColumnsRenamed({"qpts": "a", "cpts": "b"})
    found = with_distance(met, keep=("query", "candidate", "qfew", "cfew")).withColumn("distance", F.round("distance", 6))
    return expand(found, curves, curves)


@query(f"WITH RECURSIVE {O.signatures(O.LINES, _LINE)}, {O.COLLIDE}, {O.reach('scored', DISTANCE)} SELECT query, candidate FROM near")
def frechet_range(spark: Spark, sf: str) -> DataFrame:
    curves, signed = line_classes(spark, sf)
    met = collide.class_scores(signed, signed, kept=("few", "pts")).drop("score").withColumnsRenamed({"qpts": "a", "cpts": "b"})
    return expand(verify.verify_all(met, curves.classes, curves.classes, DISTANCE), curves, curves)


@query(f"WITH RECURSIVE {O.signatures(O.LINES, _LINE)}, {O.COLLIDE}, {_CUT}, low AS (SELECT query, candidate FROM scored, cut WHERE score <= cut), {O.reach('low', DISTANCE)} SELECT query, candidate, false AS verified FROM scored, cut WHERE score > cut UNION ALL SELECT query, candidate, true FROM near")
def partial_verify_scores(spark: Spark, sf: str) -> DataFrame:
    curves, signed = line_classes(spark, sf)
    return verify.class_by_score(collide.class_scores(signed, signed, kept=("copies", "few", "pts")), curves, curves, FRACTION, DISTANCE)


@query(f"WITH RECURSIVE {O.signatures(O.VECTORS, _VECTOR)}, {O.codes(8)}, {_GREY}, doubt AS (SELECT query, candidate FROM grey WHERE verdict = 'check'), {O.reach('doubt', 0.3)} SELECT query, candidate, false AS verified FROM grey WHERE verdict = 'accept' UNION ALL SELECT query, candidate, true FROM near")
def partial_verify_sketches(spark: Spark, sf: str) -> DataFrame:
    curves, codes = vector_curves(spark, sf), cut(vector_codes(spark, sf), "codes")
    return verify.by_sketch(_doubtful(codes), curves, curves, RADIUS, 0.3)


@query(f"WITH RECURSIVE {O.signatures(O.VECTORS, _VECTOR)}, {O.codes(8)}, {O.leaves(hamming.split_limits(_LOSSY))}, {_GREY}, held AS (SELECT query, candidate, verdict FROM grey JOIN code a ON a.id = query JOIN code b ON b.id = candidate JOIN leaf ON leaf.id = candidate WHERE bit_count(({O.mask(8)}) & ((1::BIGINT << depth) - 1)) <= 4), doubt AS (SELECT query, candidate FROM held WHERE verdict = 'check'), {O.reach('doubt', 0.3)} SELECT query, candidate FROM held WHERE verdict = 'accept' UNION ALL SELECT query, candidate FROM near")
def trie_index(spark: Spark, sf: str) -> DataFrame:
    """The whole plan: tree search with few errors, then partial verification."""
    curves = vector_curves(spark, sf)
    return TrieIndex(curves, VECTOR_LSH, TrieConfig(errors=4, distance=0.3)).query(curves)


@query(f"WITH RECURSIVE {O.signatures(O.LINES, _LINE)}, {O.COLLIDE}, {_CUT}, low AS (SELECT query, candidate FROM scored, cut WHERE score <= cut), {O.reach('low', DISTANCE)} SELECT query, candidate FROM scored, cut WHERE score > cut UNION ALL SELECT query, candidate FROM near")
def table_index(spark: Spark, sf: str) -> DataFrame:
    """The whole plan: collisions, then partial verification."""
    curves = line_curves(spark, sf)
    return TableIndex(curves, LINE_LSH, TableConfig(distance=DISTANCE, verify_fraction=FRACTION)).query(curves)


@query(f"WITH RECURSIVE pts AS ({O.LINES}), {O.starts_near(DISTANCE)}, {O.reach('close', DISTANCE)} SELECT query, candidate FROM near")
def near_pairs(spark: Spark, sf: str) -> DataFrame:
    """All pairs of curves within the distance, whether they collide or not: the truth of what follows."""
    curves = line_curves(spark, sf)
    return evaluate.near_pairs(curves, curves, DISTANCE)


def _quality(spark: Spark, sf: str) -> tuple[DataFrame, DataFrame, Folded]:
    """Of classes of equal curves: all near pairs; the result, the pairs of at least four collisions; the classes."""
    curves, signed = line_classes(spark, sf)
    return evaluate.class_near_pairs(curves.classes, curves.classes, DISTANCE), collide.class_scores(signed, signed).filter("score >= 4"), curves


_NEAR = f"{O.starts_near(DISTANCE)}, {O.reach('close', DISTANCE)}"
_MARKS = "marks AS (SELECT coalesce(t.query, p.query) AS query, t.query IS NOT NULL AND p.query IS NOT NULL AS tp, t.query IS NULL AS fp, p.query IS NULL AS fn FROM near t FULL JOIN found p ON t.query = p.query AND t.candidate = p.candidate)"
_TRUTH = f"WITH RECURSIVE {O.signatures(O.LINES, _LINE)}, {O.COLLIDE}, {_NEAR}, found AS (SELECT query, candidate FROM scored WHERE score >= 4), {_MARKS}"
_SUMS = "count(*) FILTER (tp) AS tp, count(*) FILTER (fp) AS fp, count(*) FILTER (fn) AS fn"
_RATES = "CASE WHEN tp + fp > 0 THEN round_even(tp / (tp + fp), 2) END AS precision, CASE WHEN tp + fn > 0 THEN round_even(tp / (tp + fn), 2) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round_even(2 * tp / (2 * tp + fp + fn), 2) END AS f1"
_EACH = f"s AS (SELECT query, {_SUMS} FROM marks GROUP BY query), r AS (SELECT id AS query, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, " + ", ".join(f"CASE WHEN s.query IS NULL THEN 0.0 ELSE {m} END AS {m}" for m in ("precision", "recall", "f1")) + f" FROM (SELECT DISTINCT id FROM pts) LEFT JOIN (SELECT *, {_RATES} FROM s) s ON id = query)"


@query(f"{_TRUTH}, s AS (SELECT {_SUMS} FROM marks), k AS (SELECT count(DISTINCT id) AS n FROM pts) SELECT tp, fp, fn, n * n - tp - fp - fn AS tn, {_RATES} FROM s, k")
def confusion(spark: Spark, sf: str) -> DataFrame:
    truth, found, curves = _quality(spark, sf)
    n = curves.rows_held()
    return evaluate.class_confusion(truth, found, curves, curves, n, n)


@query(f"{_TRUTH}, {_EACH} SELECT query, tp, fp, fn, precision, recall, f1 FROM r")
def scores_per_query(spark: Spark, sf: str) -> DataFrame:
    truth, found, curves = _quality(spark, sf)
    return evaluate.class_scores_per_query(truth, found, curves, curves)


@query(f"{_TRUTH}, {_EACH} SELECT {', '.join(f'min({m}) AS min_{m}, max({m}) AS max_{m}, round(avg({m}), 6) AS avg_{m}' for m in ('precision', 'recall', 'f1'))} FROM r")
def quality_summary(spark: Spark, sf: str) -> DataFrame:
    truth, found, curves = _quality(spark, sf)
    return evaluate.summary(evaluate.class_scores_per_query(truth, found, curves, curves))


_SEEDS = (11, 12, 13)


def _runs_sql() -> str:
    """Confusion of each seed against the same truth, then best, worst and mean."""
    family = lambda seed: Family.draw(LshConfig(resolution=LINE_LSH.resolution, seed=seed), 64)
    found = " UNION ALL ".join(f"SELECT {seed} AS seed, query, candidate FROM (WITH {O.signatures(O.LINES, family(seed))}, {O.COLLIDE} SELECT query, candidate FROM scored WHERE score >= 4)" for seed in _SEEDS)
    return f"""WITH RECURSIVE pts AS ({O.LINES}), {_NEAR}, found AS ({found}), seeds AS (SELECT unnest({list(_SEEDS)}) AS seed),
truth AS (SELECT seed, query, candidate FROM seeds, near),
s AS (SELECT coalesce(t.seed, p.seed)::INTEGER AS seed, count(*) FILTER (t.query IS NOT NULL AND p.query IS NOT NULL) AS tp, count(*) FILTER (t.query IS NULL) AS fp, count(*) FILTER (p.query IS NULL) AS fn
      FROM truth t FULL JOIN found p ON t.seed = p.seed AND t.query = p.query AND t.candidate = p.candidate GROUP BY 1),
k AS (SELECT count(DISTINCT id) AS n FROM pts),
r AS (SELECT *, n * n - tp - fp - fn AS tn, {_RATES} FROM s, k)
SELECT arg_max(seed, f1 * 1000 - seed) AS best_seed, max(f1) AS best_f1, arg_min(seed, f1 * 1000 + seed) AS worst_seed, min(f1) AS worst_f1, round(avg(f1), 6) AS avg_f1, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in ('tp', 'fp', 'fn', 'tn'))} FROM r"""


@query(_runs_sql())
def seed_summary(spark: Spark, sf: str) -> DataFrame:
    """Quality of three seeds against all near pairs; one short driver loop over seeds, not over data."""
    curves = fold(line_curves(spark, sf), "pts")
    n, runs = curves.rows_held(), None
    truth = cut(evaluate.class_near_pairs(curves.classes, curves.classes, DISTANCE), "truth")
    for seed in _SEEDS:
        signed = collide.signed_classes(curves, family_for(LshConfig(resolution=LINE_LSH.resolution, seed=seed)))
        found = collide.class_scores(signed, signed)
        one = evaluate.class_confusion(truth, found.filter("score >= 4"), curves, curves, n, n).withColumn("seed", F.lit(seed))
        runs = one if runs is None else runs.unionByName(one)
    return evaluate.by_seed(runs)


# hash distance against true distance, over all pairs of a stated set of curves

_HOUR_PAIRS = f"WITH {O.signatures(O.HOURS, _HOUR)}, {O.ALL_PAIRS}, {O.distances('pairs')}, hs AS (SELECT id, list(hash ORDER BY t) AS hashes FROM sig GROUP BY id), m AS (SELECT query, candidate, len(list_filter(list_zip(a.hashes, b.hashes), lambda z: z[1] <> z[2]))::INTEGER AS differing, distance FROM dist JOIN hs a ON a.id = query JOIN hs b ON b.id = candidate)"


def _hash_and_true(spark: Spark, sf: str) -> DataFrame:
    """For each pair of classes of equal curves, with the ``pairs`` that it stands for."""
    signed = collide.signed_classes(fold(hour_curves(spark, sf), "pts"), family_for(HOUR_LSH))
    return evaluate.class_distances(signed, signed, hashed=True).select("distance", "differing", "pairs")


@query(f"WITH pts AS ({O.HOURS}), {O.ALL_PAIRS}, {O.distances('pairs')}, v AS (SELECT unnest([1, 5, 10, 50, 90]) AS p), q AS (SELECT quantile_cont(distance, [0.01, 0.05, 0.1, 0.5, 0.9]) AS v FROM dist) SELECT p::INTEGER AS p, round(q.v[list_position([1, 5, 10, 50, 90], v.p)], 6) AS value FROM q, v")
def percentiles(spark: Spark, sf: str) -> DataFrame:
    curves = fold(hour_curves(spark, sf), "pts")
    found = weighed(evaluate.class_distances(curves, curves), curves, curves)
    return evaluate.percentiles(found, "distance", (1, 5, 10, 50, 90), "pairs")


@query(f"{_HOUR_PAIRS} SELECT round(corr(differing, distance), 6) AS pearson, count(*) AS pairs FROM m")
def hash_correlation(spark: Spark, sf: str) -> DataFrame:
    return evaluate.weighed_correlation(_hash_and_true(spark, sf), "differing", "distance", "pairs")


@query(f"{_HOUR_PAIRS} SELECT floor(differing / 2.0)::BIGINT AS cell_a, floor(distance / 25.0)::BIGINT AS cell_b, count(*) AS pairs FROM m GROUP BY 1, 2")
def histogram(spark: Spark, sf: str) -> DataFrame:
    return evaluate.histogram2d(_hash_and_true(spark, sf), "differing", "distance", 2.0, 25.0, "pairs")


@query(f"WITH {O.signatures(O.HOURS, _HOUR)}, hs AS (SELECT id, list(hash ORDER BY t) AS h FROM sig GROUP BY id), m AS (SELECT a.id AS query, b.id AS candidate, list_reduce(list_transform(a.h, lambda x: [x]), lambda before, x: list_reduce(list_transform(range(1, len(b.h) + 1), lambda j: [before[j] + CASE WHEN x[1] = b.h[j] THEN 0 ELSE 1 END, before[j + 1] + 1]), lambda acc, v: list_append(acc, least(v[1], v[2], acc[-1] + 1)), [before[1] + 1]), range(0, len(b.h) + 1)) AS last FROM hs a, hs b) SELECT query, candidate, last[-1]::INTEGER AS edits FROM m")
def hash_edit_distances(spark: Spark, sf: str) -> DataFrame:
    signed = collide.signatures(hour_curves(spark, sf), family_for(HOUR_LSH))
    return evaluate.edit_distances(signed, signed)


_VEC_PAIRS = f"WITH {O.signatures(O.VECTORS, _VECTOR)}, hs AS (SELECT id, list(hash ORDER BY t) AS hashes FROM sig GROUP BY id), m AS (SELECT a.id AS query, b.id AS candidate, len(list_filter(list_zip(a.hashes, b.hashes), lambda z: z[1] <> z[2]))::INTEGER AS differing, list_sum(list_transform(list_zip(a.hashes, b.hashes), lambda z: (z[1] - z[2])::DOUBLE * (z[1] - z[2])::DOUBLE)) AS square FROM hs a, hs b)"


@query(f"{_VEC_PAIRS} SELECT query, candidate, differing, round(sqrt(square) / 1e9, 6) AS euclidean FROM m")
def hash_vector_distances(spark: Spark, sf: str) -> DataFrame:
    signed = cut(vector_codes(spark, sf).withColumnRenamed("code", "hashes"), "signatures")  # else signed again for each block of pairs
    return evaluate.vector_distances(signed, signed, VECTOR_LSH.l).withColumn("euclidean", F.round(F.col("euclidean") / 1e9, 6))
