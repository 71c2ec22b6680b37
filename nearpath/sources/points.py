"""Point tables, trajectories and result files.

Points are rows (id, ord, x, y); a trajectory is (id, pts) with pts ordered by ``ord``.  Spark has no
row order, so every source names one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

POINTS = "id long, lat double, lon double"


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A point file with one row a point; the order within a file is the order of its rows."""
    rows = spark.read.schema(POINTS).parquet(path)
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return rows.select("id", F.struct(*place).alias("ord"), F.col("lat").alias("x"), F.col("lon").alias("y"))


def assemble(points: DataFrame, place: Callable[[Column], tuple[Column, Column]] | None = None) -> DataFrame:
    """One row a trajectory, its points in order; one shuffle by id.  Null ids and coordinates are left out.
    Where ``ord`` holds what x and y are made of, ``place`` makes them of it after the shuffle."""
    kept = points.filter("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    ordered = F.sort_array(F.collect_list(F.struct("ord", "x", "y") if place is None else F.col("ord")))
    xy = place or (lambda p: (p["x"], p["y"]))
    return kept.groupBy("id").agg(F.transform(ordered, lambda p: F.struct(*[c.alias(n) for c, n in zip(xy(p), "xy")])).alias("pts"))


def explode_points(curves: DataFrame) -> DataFrame:
    return curves.select("id", F.posexplode("pts").alias("ord", "p")).select("id", "ord", "p.x", "p.y")


def first_n(curves: DataFrame, n: int, order: str | Column = "id") -> DataFrame:
    """The first n trajectories in the stated order."""
    return curves.orderBy(order).limit(n)


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as a curve of (quantity, price / 1000)."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.select(F.col("l_orderkey").alias("id"), F.struct(*LINE_ORDER).alias("ord"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


def line_place(order: Column) -> tuple[Column, Column]:
    """x and y of a line from its ``ord``."""
    return order["l_quantity"], order["l_extendedprice"] / 1000


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a curve of (hour of day, value)."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("ord"), F.hour("ts").cast("double").alias("x"), F.col("value").alias("y"))


def hour_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest value in each hour of the day as a curve of (hour, value) a user."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = t.groupBy(F.col("user_id").alias("id"), F.hour("ts").alias("ord")).agg(F.max("value").alias("y"))
    return rows.select("id", "ord", F.col("ord").cast("double").alias("x"), "y")


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vector components as a curve."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(embedding) div 2 - 1")), lambda i: F.struct(i.alias("ord"), F.get("embedding", (2 * i).cast("int")).cast("double").alias("x"), F.get("embedding", (2 * i + 1).cast("int")).cast("double").alias("y")))
    return t.select(F.col("vec_id").alias("id"), F.explode(pairs).alias("p")).select("id", "p.*")


def read_polyline_csv(spark: SparkSession, path: str) -> DataFrame:
    """Taxi trips: rows marked as missing data go, the JSON polyline [[lon, lat], ...] becomes points."""
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    rows = rows.filter(F.lower("MISSING_DATA") == "false").select(F.col("TRIP_ID").cast("long").alias("id"), F.from_json("POLYLINE", "array<array<double>>").alias("line"))
    return rows.select("id", F.posexplode("line").alias("ord", "p")).select("id", "ord", F.get("p", 1).alias("x"), F.get("p", 0).alias("y"))


def write_polyline_csv(curves: DataFrame, path: str) -> None:
    """The form that ``read_polyline_csv`` reads: longitude (y) first."""
    line = F.to_json(F.transform("pts", lambda p: F.array(p["y"], p["x"])))
    rows = curves.select(F.col("id").alias("TRIP_ID"), line.alias("POLYLINE"), F.lit("False").alias("MISSING_DATA"))
    rows.write.option("header", True).option("escape", '"').csv(path)


def write_points(curves: DataFrame, path: str) -> None:
    """A point file: one row a point, those of a curve together and in order."""
    curves.select("id", F.explode("pts").alias("p")).select("id", F.col("p.x").alias("lat"), F.col("p.y").alias("lon")).write.parquet(path)


def read_trajectory_text(spark: SparkSession, path: str, points_each: int = 721, header: int = 4) -> DataFrame:
    """White-space tables (time lon lat ...), ``points_each`` rows a trajectory after the header lines."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\n").alias("lines"))
    rows = files.select("file", F.posexplode(F.expr(f"slice(lines, {header + 1}, greatest(size(lines) - {header}, 0))")).alias("at", "line")).filter("trim(line) <> ''")
    cells = F.split(F.trim("line"), r"\s+")
    return rows.select(F.xxhash64("file", F.expr(f"at div {points_each}")).alias("id"), F.expr(f"at % {points_each}").alias("ord"), cells[2].cast("double").alias("x"), cells[1].cast("double").alias("y"))


def _binary(spark: SparkSession, path: str):
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_binary_sketches(spark: SparkSession, path: str) -> DataFrame:
    """Little-endian 64-bit words, one sketch of one word each: (file, pos, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(content, dtype="<i8", count=len(content) // 8)
                codes = pa.FixedSizeListArray.from_arrays(pa.array(words), 1).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words)), pa.array(np.arange(len(words))), codes], names=["file", "pos", "code"])

    return _binary(spark, path).mapInArrow(run, "file string, pos long, code array<bigint>")


def read_bvecs(spark: SparkSession, path: str, bits: int, width: int = 64) -> DataFrame:
    """Records [uint32 dim][dim bytes]; the first ``width`` bytes become a sketch of ``bits`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, rows = 0, []
                while at + 4 <= len(content):
                    dim = int.from_bytes(content[at : at + 4], "little")
                    if dim < width:
                        raise ValueError(f"{name}: a vector of {dim} bytes is shorter than {width}")
                    rows.append(np.frombuffer(content, dtype=np.uint8, count=width, offset=at + 4))
                    at += 4 + dim
                codes = [[int(np.packbits((r >> j & 1).astype(np.uint8), bitorder="little").view(f"<i{width // 8}")[0]) for j in range(bits)] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array(codes, pa.list_(pa.int64()))], names=["file", "pos", "code"])

    return _binary(spark, path).mapInArrow(run, "file string, pos long, code array<bigint>")


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.select(F.col("query").cast("long"), F.col("candidate").cast("long")).write.parquet(path, compression="zstd")


def sketch_columns(sketches: DataFrame, bits: int) -> DataFrame:
    """One row a sketch with the columns "0" to "bits - 1"."""
    return sketches.select("id", *[F.get("code", i).alias(str(i)) for i in range(bits)])


def hash_rows(signatures: DataFrame) -> DataFrame:
    """Long form (id, i, hash)."""
    return signatures.select("id", F.posexplode("hashes").alias("i", "hash"))


def wide_matrix(distances: DataFrame, queries: list[int]) -> DataFrame:
    """One row a candidate, one column a query."""
    return distances.groupBy(F.col("candidate").alias("id")).pivot("query", queries).agg(F.first("distance"))


def unpivot_matrix(matrix: DataFrame) -> DataFrame:
    names = [c for c in matrix.columns if c != "id"]
    return matrix.unpivot("id", names, "query", "distance").select(F.col("query").cast("long"), F.col("id").alias("candidate"), "distance")


def as_texts(ids: Column) -> Column:
    return F.sort_array(F.transform(ids, lambda c: c.cast("string")))


def write_results_json(pairs: DataFrame, path: str, name: str = "run") -> None:
    """Statistics objects with ``candidates`` as {query: [candidate, ...]}, one a query and line."""
    write_lists_json(pairs.groupBy("query").agg(as_texts(F.collect_list("candidate")).alias("candidates")), path, name)


def write_lists_json(lists: DataFrame, path: str, name: str = "run", compression: str = "none") -> None:
    """The same from (query, candidates), candidates as texts in order."""
    rows = lists.select(F.lit(name).alias("name"), F.create_map(F.col("query").cast("string"), F.col("candidates")).alias("candidates"))
    rows.write.json(path, compression=compression)


def read_results_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pairs of a run's statistics file with ``candidates`` as {query: [candidate, ...]}; one object a
    file, or a line."""
    text = spark.read.text(path, wholetext=not lines)
    lists = F.from_json(F.get_json_object("value", "$.candidates"), "map<string,array<string>>")
    return text.select(F.explode(lists).alias("query", "found")).select(F.col("query").cast("long"), F.explode("found").alias("candidate")).select("query", F.col("candidate").cast("long"))


def sample_ids(curves: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n ids without replacement, by a hash of id and seed."""
    return curves.select("id").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), "id").limit(n)


def split(curves: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query set, data set): the trajectories with these ids, and the others."""
    return curves.join(ids, "id", "left_semi"), curves.join(ids, "id", "left_anti")


def step_lengths(points: DataFrame, km: float = 111.32) -> DataFrame:
    w = W.partitionBy("id").orderBy("ord")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    return points.select("id", "ord", (F.sqrt(dx * dx + dy * dy) * km).alias("step"))


def write_json(curves: DataFrame, path: str) -> None:
    """One JSON object a trajectory: its id and its points as [[x, y], ...]."""
    curves.select("id", F.transform("pts", lambda p: F.array(p["x"], p["y"])).alias("points")).write.json(path)


def polyline(pts: Column, digits: int = 5) -> Column:
    """Encoded polyline of the points (x first), as text."""
    scaled = F.transform(pts, lambda p: F.array(*[F.floor(p[c] * 10**digits + 0.5).cast("long") for c in "xy"]))
    zero = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"))
    deltas = F.flatten(F.transform(F.sequence(F.lit(1), F.size(scaled)), lambda i: F.zip_with(F.element_at(scaled, i), F.when(i > 1, F.get(scaled, i - 2)).otherwise(zero), lambda a, b: a - b)))

    def chunks(v: Column) -> Column:
        folded = F.when(v < 0, F.shiftleft(-v, 1) - 1).otherwise(F.shiftleft(v, 1))
        five = lambda k: F.shiftright(folded, 5 * k)
        last = F.greatest(F.lit(1), *[F.when(five(k) > 0, F.lit(k + 1)).otherwise(0) for k in range(1, 8)])
        parts = [F.when(last > k, F.char((five(k).bitwiseAND(F.lit(31)) + F.when(last > k + 1, 32).otherwise(0) + 63).cast("long"))).otherwise("") for k in range(8)]
        return F.concat(*parts)

    return F.array_join(F.transform(deltas, chunks), "")
