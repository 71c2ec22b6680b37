"""Filters over whole trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpath.functions.curves import bounding_box, longest_step


def short_steps(curves: DataFrame, km: float) -> DataFrame:
    """Trajectories without a step of ``km`` or more."""
    return curves.filter(F.coalesce(longest_step(F.col("pts")), F.lit(0.0)) < km)


def point_count(curves: DataFrame, least: int, most: int) -> DataFrame:
    return curves.filter(F.size("pts").between(least, most))


def distinct_points(points: DataFrame) -> DataFrame:
    return points.dropDuplicates(["id", "x", "y"])


def statistics(curves: DataFrame) -> DataFrame:
    """id, number of points and bounding box."""
    return curves.select("id", F.size("pts").alias("n_points"), bounding_box(F.col("pts")).alias("b")).select("id", "n_points", "b.*")


def max_points(curves: DataFrame) -> int:
    return curves.agg(F.max(F.size("pts"))).first()[0] or 0


def centre(points: DataFrame) -> DataFrame:
    return points.agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))
