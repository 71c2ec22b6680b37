"""Copies: rows with an equal value are one class.  Pairs are sought between classes; copies are counted, or
written out at the end without another shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearpath.sources.store import cut, release


#: Rows of a class whose ids travel with it.
FEW = 64


@dataclass
class Folded:
    """``classes``: id (the smallest of its rows), the value, ``copies`` and ``few``, the ids of its rows where
    these are at most ``FEW``.  ``members``: id of a class and ``ids`` of its rows, in several parts where there
    are very many.  ``many``: there are classes without ``few``."""

    classes: DataFrame
    members: DataFrame
    many: bool = True

    def rows_held(self) -> int:
        return self.classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]

    def rows(self, each: DataFrame, name: str = "query") -> DataFrame:
        """A row for each member instead of one for each class (in the column ``name``)."""
        ids = self.members.select(F.col("id").alias(name), "ids")
        return each.join(ids, name).withColumn(name, F.explode("ids")).select(*each.columns)


def fold(rows: DataFrame, value: str, at_once: int = 4096) -> Folded:
    """Classes of rows (id and a value) by the value.

    Ids of a value that more than ``at_once`` rows share (or a ten-thousandth of all) are gathered in parts.
    """
    rows = cut(rows.select("id", value), "rows")  # read more than once
    release(rows.sparkSession)  # what made them
    most = max(at_once, rows.count() // 10_000)  # at most 10,000 values have more
    h = F.xxhash64(value).alias("h")
    common = cut(rows.groupBy(h).count().filter(F.col("count") > most).select("h", F.ceil(F.col("count") / most).alias("parts")), "common")
    if common.isEmpty():
        groups = cut(rows.groupBy(value).agg(F.collect_list("id").alias("ids")).select(F.array_min("ids").alias("id"), value, "ids"), "classes")
        release(rows.sparkSession)
        few = F.when(F.size("ids") <= FEW, F.col("ids")).alias("few")
        return Folded(groups.select("id", value, F.size("ids").cast("long").alias("copies"), few), groups.select("id", "ids"), _many(groups.select(few)))
    dealt = rows.withColumn("h", h).join(F.broadcast(common), "h", "left")
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part")
    groups = cut(dealt.groupBy(value, part).agg(F.collect_list("id").alias("ids")), "parts")
    small = F.flatten(F.collect_list(F.when(F.size("ids") <= FEW, F.col("ids"))))
    whole = groups.groupBy(value).agg(F.min(F.array_min("ids")).alias("id"), F.sum(F.size("ids")).alias("copies"), small.alias("few"))
    classes = cut(whole.select("id", value, "copies", F.when(F.col("copies") <= FEW, F.col("few")).alias("few")), "classes")
    same = classes.select("id", F.col(value).alias("same"))
    return Folded(classes, groups.join(same, F.col(value).eqNullSafe(F.col("same"))).select("id", "ids"), _many(classes))


def _many(classes: DataFrame) -> bool:
    return not classes.filter("few IS NULL").isEmpty()


def both(queries: DataFrame, data: DataFrame, value: str, at_once: int = 4096) -> tuple[Folded, Folded]:
    """Of both sides; once if they are the same frame."""
    a = fold(queries, value, at_once)
    return a, a if queries is data else fold(data, value, at_once)


def expand(pairs: DataFrame, queries: Folded, data: Folded) -> DataFrame:
    """All pairs of rows for pairs of classes; the other columns are kept.  Nothing is shuffled after it.

    Pairs that carry the ``few`` of both classes (as qfew and cfew) are written out where they are; only those of
    larger classes travel to the members.
    """
    names = [c for c in pairs.columns if c not in ("qfew", "cfew")]
    exploded = lambda met, q, c: met.withColumn("query", F.explode(q)).withColumn("candidate", F.explode(c)).select(*names)
    near_by = None
    if "qfew" in pairs.columns:
        carried = F.coalesce(F.size("qfew") * F.size("cfew"), F.lit(-1)) > 0  # of both sides, so it stays above their join
        if not (queries.many or data.many):
            return exploded(pairs, "qfew", "cfew")
        near_by, pairs = exploded(pairs.filter(carried), "qfew", "cfew"), pairs.filter(~carried).select(*names)
    b = data.members.select(F.col("id").alias("candidate"), F.col("ids").alias("candidates"))
    a = queries.members.select(F.col("id").alias("query"), F.col("ids").alias("queries"))
    far = exploded(pairs.join(b, "candidate").join(a, "query"), "queries", "candidates")
    return far if near_by is None else near_by.unionByName(far)


def weighed(pairs: DataFrame, queries: Folded, data: Folded) -> DataFrame:
    """Pairs of classes with the number of pairs of rows that each stands for (``pairs``)."""
    a = queries.classes.select(F.col("id").alias("query"), F.col("copies").alias("queries"))
    b = data.classes.select(F.col("id").alias("candidate"), F.col("copies").alias("candidates"))
    return pairs.join(b, "candidate").join(a, "query").select(*pairs.columns, (F.col("queries") * F.col("candidates")).alias("pairs"))
