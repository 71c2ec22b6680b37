"""Collision search: pairs of curves that share a hash in one of the l tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearpath.functions.lsh import Family, sign
from nearpath.operators.copies import Folded, both, expand
from nearpath.sources.store import cut


def signatures(curves: DataFrame, family: Family) -> DataFrame:
    return sign(curves, family)


def signed_classes(curves: Folded, family: Family) -> Folded:
    """Classes of equal curves with their ``hashes``."""
    kept = ("copies", "few", "pts")
    return Folded(cut(sign(curves.classes, family, kept), "signatures"), curves.members, curves.many)  # read more than once


def buckets(signed: DataFrame) -> DataFrame:
    return signed.select("id", F.posexplode("hashes").alias("t", "hash"))


def _met(queries: DataFrame, data: DataFrame, at_once: int, kept: tuple[str, ...] = ()) -> DataFrame:
    """(query, candidate, score) once for each pair that shares a bucket, and the columns ``kept`` of both sides
    with q and c before their names.

    Entries of the buckets carry their whole signature: a pair is taken in the first table in which it collides,
    and scored there, so no pair is shuffled.  Buckets of more than ``at_once`` candidates, the 10,000 largest of
    them at most, are dealt to several tasks by the candidate, and their queries go to all of these.
    """
    words = data.agg(F.coalesce(F.max(F.size("hashes")), F.lit(0))).first()[0]

    def entries(side: DataFrame, name: str, p: str) -> DataFrame:
        columns = [F.col("id").alias(name), F.col("hashes").alias(p + "hashes"), *[F.col(c).alias(p + c) for c in kept if c != "hashes"]]
        rows = side.select(*columns, F.posexplode("hashes").alias("t", "hash"))
        return rows.withColumnRenamed("t", p + "t")

    q, c = entries(queries, "query", "q"), entries(data, "candidate", "c")
    heavy = c.groupBy("ct", "hash").count().filter(F.col("count") > at_once).orderBy(F.desc("count")).limit(10_000)
    heavy = cut(heavy.select(F.col("ct").alias("t"), F.col("hash").alias("bucket"), F.ceil(F.col("count") / at_once).alias("parts")), "heavy")
    same = [F.get("qhashes", F.lit(i)) == F.get("chashes", F.lit(i)) for i in range(words)]
    before, score = F.lit(False), F.lit(0)
    for i, equal in enumerate(same):
        before = before | ((F.col("qt") > i) & F.coalesce(equal, F.lit(False)))
        score = score + F.when(equal, 1).otherwise(0)
    on = [q["qt"] == c["ct"], q["hash"] == c["hash"]]
    if not heavy.isEmpty():
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        at = lambda side, p: side.join(F.broadcast(heavy), (side[p + "t"] == heavy["t"]) & (side["hash"] == heavy["bucket"]), "left").drop("t", "bucket")
        c = at(c, "c").withColumn("cpart", F.pmod(F.xxhash64("candidate"), parts)).drop("parts")
        q = at(q, "q").withColumn("qpart", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
        on = [q["qt"] == c["ct"], q["hash"] == c["hash"], q["qpart"] == c["cpart"]]
    met = q.join(c, [*on, ~before])
    return met.select("query", "candidate", score.cast("int").alias("score"), *[p + n for n in kept for p in "qc"])


def class_scores(queries: Folded, data: Folded, at_once: int = 4096, kept: tuple[str, ...] = ()) -> DataFrame:
    """(query, candidate, score) of classes (with ``hashes``): in how many tables the two signatures collide.
    Columns ``kept`` of the classes come along, with q and c before their names."""
    return _met(queries.classes, data.classes, at_once, kept)


def scores(queries: DataFrame, data: DataFrame, at_once: int = 4096) -> DataFrame:
    """(query, candidate, score) of all rows.  Equal signatures meet the same rows, so classes of them meet."""
    q, c = both(queries, data, "hashes", at_once)
    return expand(class_scores(q, c, at_once, ("few",)), q, c)


def collisions(queries: DataFrame, data: DataFrame) -> DataFrame:
    """Distinct (query, candidate)."""
    return scores(queries, data).select("query", "candidate")


def colliding_queries(queries: DataFrame, data: DataFrame) -> DataFrame:
    """Queries with a collision at all."""
    q = buckets(queries).select("t", "hash", F.col("id").alias("query"))
    return q.join(buckets(data).select("t", "hash"), ["t", "hash"], "left_semi").select("query").distinct()


def distinct_hashes(signed: DataFrame) -> DataFrame:
    return buckets(signed).groupBy("t").agg(F.countDistinct("hash").alias("distinct_hashes"))


def candidates_per_query(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("query").agg(F.count("*").alias("candidates"))


def class_counts(queries: Folded, data: Folded, at_once: int = 4096) -> DataFrame:
    """(query, candidates) of all rows: the counts alone, from classes (with ``hashes``) and their sizes."""
    return queries.rows(class_scores(queries, data, at_once, ("copies",)).groupBy("query").agg(F.sum("ccopies").alias("candidates")))


def candidates_by_query(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("query").agg(F.sort_array(F.collect_list("candidate")).alias("candidates"))


def class_lists(queries: Folded, data: Folded, form: Callable[[Column], Column], at_once: int = 4096) -> DataFrame:
    """(query, candidates) of all rows: the ids in a form, brought into it once for each class (with ``hashes``)."""
    ids = data.members.select(F.col("id").alias("candidate"), "ids")
    met = class_scores(queries, data, at_once).join(ids, "candidate")
    return queries.rows(met.groupBy("query").agg(form(F.flatten(F.collect_list("ids"))).alias("candidates")))
