"""Registered queries of sources and sinks: write a table in each form, read it back, state what was read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.functions import curves as C
from nearpath.functions import sketch as S
from nearpath.operators import collide, evaluate, preprocess
from nearpath.operators.copies import expand, fold
from nearpath.plans import oracles as O
from nearpath.plans.index import family_for
from nearpath.plans.queries import _LINE, _VECTOR, LINE_LSH, event_curves, hour_curves, line_classes, line_curves, line_signatures, query, vector_codes
from nearpath.sources import points as P
from nearpath.sources.store import cut, intermediate
from nearpath.streaming.append import append_signatures

Spark = SparkSession
_ENDS = "id, count(*)::INTEGER AS n_points, arg_min(x, ord) AS first_x, arg_min(y, ord) AS first_y, arg_max(x, ord) AS last_x, arg_max(y, ord) AS last_y"


def _ends(curves: DataFrame) -> DataFrame:
    first, last = F.get("pts", 0), F.element_at("pts", -1)
    return curves.select("id", F.size("pts").alias("n_points"), first["x"].alias("first_x"), first["y"].alias("first_y"), last["x"].alias("last_x"), last["y"].alias("last_y"))


@query(f"WITH p AS ({O.EVENTS}) SELECT {_ENDS} FROM p GROUP BY id")
def point_file(spark: Spark, sf: str) -> DataFrame:
    path = intermediate(spark, "points")
    P.write_points(event_curves(spark, sf), path)
    return _ends(P.assemble(P.read_points(spark, path)))


@query(f"WITH p AS ({O.LINES}) SELECT id, ord::INTEGER AS ord, x, y FROM p")
def point_rows(spark: Spark, sf: str) -> DataFrame:
    return P.explode_points(line_curves(spark, sf)).select("id", (F.col("ord") + 1).alias("ord"), "x", "y")


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.COLLIDE} SELECT query, candidate FROM scored")
def pair_file(spark: Spark, sf: str) -> DataFrame:
    path, (_, signed) = intermediate(spark, "pairs"), line_classes(spark, sf)
    P.write_pairs(expand(collide.class_scores(signed, signed, kept=("few",)), signed, signed), path)
    return spark.read.parquet(path)


@query(f"WITH {O.signatures(O.LINES, _LINE)}, {O.COLLIDE} SELECT query, candidate FROM scored")
def results_json(spark: Spark, sf: str) -> DataFrame:
    path, (_, signed) = intermediate(spark, "results"), line_classes(spark, sf)
    P.write_lists_json(collide.class_lists(signed, signed, P.as_texts), path, compression="gzip")  # lists of copies repeat
    return P.read_results_json(spark, path, lines=True)


@query(f"WITH {O.signatures(O.VECTORS, _VECTOR)}, {O.codes(8)} SELECT id, {', '.join(f'c{j} AS w{j}' for j in range(8))} FROM code")
def sketch_file(spark: Spark, sf: str) -> DataFrame:
    path = intermediate(spark, "sketches")
    P.sketch_columns(vector_codes(spark, sf), 8).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("id", *[F.col(f"`{j}`").alias(f"w{j}") for j in range(8)])


@query(f"WITH {O.signatures(O.LINES, _LINE)} SELECT id, t AS i, hash FROM sig")
def hash_file(spark: Spark, sf: str) -> DataFrame:
    path = intermediate(spark, "hashes")
    P.hash_rows(line_signatures(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


@query(f"WITH pts AS ({O.HOURS}), {O.ALL_PAIRS}, {O.distances('pairs')} SELECT query, candidate, round(distance, 6) AS distance FROM dist")
def matrix_file(spark: Spark, sf: str) -> DataFrame:
    """The wide form has a column a query: for query sets that a driver may list."""
    path, curves = intermediate(spark, "matrix"), cut(hour_curves(spark, sf), "curves")
    asked = [r.id for r in curves.select("id").orderBy("id").collect()]
    P.wide_matrix(evaluate.distance_matrix(curves, curves), asked).write.parquet(path)
    return P.unpivot_matrix(spark.read.parquet(path)).withColumn("distance", F.round("distance", 6))


@query(f"WITH p AS ({O.EVENTS}) SELECT id, (ord - 1)::INTEGER AS ord, x, y FROM p")
def polyline_csv(spark: Spark, sf: str) -> DataFrame:
    path = intermediate(spark, "polylines")
    P.write_polyline_csv(event_curves(spark, sf), path)
    return P.read_polyline_csv(spark, path)


@query(f"WITH p AS ({O.EVENTS}) SELECT id, (ord - 1)::INTEGER AS ord, x, y FROM p")
def trajectory_json(spark: Spark, sf: str) -> DataFrame:
    path = intermediate(spark, "trajectories")
    P.write_json(event_curves(spark, sf), path)
    back = spark.read.schema("id long, points array<array<double>>").json(path)
    return back.select("id", F.posexplode("points").alias("ord", "p")).select("id", "ord", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query(f"WITH p AS ({O.EVENTS}) SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM p")
def map_centre(spark: Spark, sf: str) -> DataFrame:
    return preprocess.centre(P.event_points(spark, sf))


@query(f"WITH p AS ({O.LINES}), s AS (SELECT id, ord - 1 AS i, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM p WINDOW w AS (PARTITION BY id ORDER BY ord)) SELECT id, i::INTEGER AS i, x0, y0, x1, y1 FROM s WHERE x1 IS NOT NULL")
def segments(spark: Spark, sf: str) -> DataFrame:
    rows = line_curves(spark, sf).filter(F.size("pts") > 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("pts") - 2))).select("id", "i", C.segment(F.col("pts"), F.col("i")).alias("s"))
    return rows.select("id", "i", F.col("s.start.x").alias("x0"), F.col("s.start.y").alias("y0"), F.col("s.end.x").alias("x1"), F.col("s.end.y").alias("y1"))


@query(f"WITH p AS ({O.LINES}), c AS (SELECT id, ord, x, y FROM p UNION ALL SELECT id, max(ord) + 1, arg_min(x, ord), arg_min(y, ord) FROM p GROUP BY id) SELECT {_ENDS} FROM c GROUP BY id")
def closed_curves(spark: Spark, sf: str) -> DataFrame:
    """Each curve with its first point appended."""
    start = F.get("pts", 0)
    return _ends(line_curves(spark, sf).withColumn("pts", C.append_point(F.col("pts"), start["x"], start["y"])))


@query(f"WITH p AS ({O.LINES}) SELECT id, count(*) FILTER (x > 10 AND y > 10)::INTEGER AS n_points FROM p GROUP BY id HAVING count(*) FILTER (x > 10 AND y > 10) > 0")
def missing_points(spark: Spark, sf: str) -> DataFrame:
    """Points without a coordinate (here: small ones, blanked) are left out; so are curves of none but these."""
    some = P.lineitem_points(spark, sf).select("id", "ord", F.when(F.col("x") > 10, F.col("x")).alias("x"), F.when(F.col("y") > 10, F.col("y")).alias("y"))
    return P.assemble(some).select("id", F.size("pts").alias("n_points"))


@query("WITH b AS (SELECT vec_id AS id, i, floor((embedding[i + 1] + 1) * 100)::BIGINT AS v FROM embeddings, range(0, 32) AS r(i)) SELECT id, j::INTEGER AS j, sum(((v >> j) & 1) << i)::BIGINT AS word FROM b, range(0, 8) AS s(j) GROUP BY id, j")
def sketch_of_bytes(spark: Spark, sf: str) -> DataFrame:
    """Words of the bits of 32 small numbers a vector."""
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    values = F.transform(F.slice("embedding", 1, 32), lambda v: F.floor((v + F.lit(1).cast("float")) * F.lit(100).cast("float")).cast("long"))
    return t.select(F.col("vec_id").alias("id"), F.posexplode(S.bytes_to_code(values, 8)).alias("j", "word"))


@query(f"WITH {O.signatures(O.LINES, _LINE)} SELECT id, t, hash FROM sig")
def streamed_hashes(spark: Spark, sf: str) -> DataFrame:
    """Signatures that a stream appended, one file of curves after the other."""
    arriving, table, mark = (intermediate(spark, n) for n in ("arriving", "appended", "stream"))
    line_curves(spark, sf).repartition(4, "id").write.parquet(arriving)
    stream = spark.readStream.schema("id long, pts array<struct<x:double,y:double>>").option("maxFilesPerTrigger", 1).parquet(arriving)
    append_signatures(stream, family_for(LINE_LSH), table, mark, once=True).awaitTermination()
    return collide.buckets(spark.read.parquet(table).select("id", "hashes"))


@query(f"WITH pts AS ({O.HOURS}), {O.ALL_PAIRS}, {O.distances('pairs')} SELECT query, candidate FROM dist WHERE distance <= 60")
def frechet_filter(spark: Spark, sf: str) -> DataFrame:
    """Pairs of a stated set of curves within a distance, the distances computed with that bound."""
    curves = fold(hour_curves(spark, sf), "pts")
    return expand(evaluate.class_distances(curves, curves, 60.0).filter("distance <= 60").select("query", "candidate"), curves, curves)
