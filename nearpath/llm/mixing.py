"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Every source's documents, shuffled by a hash of their ids, form one stream of words that is cut
into blocks of equal length.  Slot i of the schedule is the golden-ratio point
``frac(i / phi)`` (in 32-bit integers), mapped through the cumulative targets to a source; the
slots of a source are ranked, and rank r uses block r modulo the source's blocks, so later epochs
repeat the stream from its start.  Joining the slots with the blocks of each document gives the
words that the mix takes of it.

Nothing needs all rows of a source in one task: slot ranks and stream positions are prefix sums
over (source, chunk) totals plus a window within a chunk.  The only single-task window runs over
one row a source.

Defined results: a null text has size 0; the null source is a source of its own, ranked last;
documents without words take nothing; rows repeating an id are separate pieces of the stream (rows
alike in id and size may swap places); an
empty table gives no rows; only the id, text and source columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearpath.llm.common import WORD, cut, documents, row_key, tidy_driver, unused_names, word_count

_SPAN = 1 << 32
#: Fixed value: 2**32 divided by the golden ratio, odd.
_GOLDEN = 2654435769


@dataclass(frozen=True)
class MixPlan:
    """Weights repeat over the sources in code point order; a target stops at ``most`` times its source.

    ``slots`` is the wanted number of schedule slots for the whole mix (the block length follows
    from it); ``slack`` more are drawn against the points' discrepancy.  A source that still has fewer
    slots than it needs (short last blocks cost whole slots) gets the missing ranks at the end.
    """

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    slots: int = 1 << 20
    slack: float = 0.02
    seed: str = "mix"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))


def targets(sizes: DataFrame, plan: MixPlan) -> DataFrame:
    """One row a source: source_size, target, and ``want``, the target as whole words."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, plan.weights)), ((F.row_number().over(by_name) - 1) % len(plan.weights) + 1).cast("int")).cast("long")
    s = sizes.groupBy("source").agg(F.sum("size").alias("s")).withColumn("w", w)
    level = W.orderBy(F.col("s").cast("double") / F.col("w"), F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    big = lambda c: c.cast("decimal(38,0)")
    s = s.withColumns({
        "t": F.sum("s").over(everything), "wt": F.sum("w").over(everything),
        "sb": F.coalesce(F.sum("s").over(level), F.lit(0)), "wb": F.coalesce(F.sum("w").over(level), F.lit(0)),
    })
    s = s.withColumn("capped", big(plan.most * F.col("s")) * big(F.col("wt") - F.col("wb")) < big(F.col("w")) * big(F.col("t") - plan.most * F.col("sb")))
    s = s.withColumns({
        "rest": F.col("t") - F.sum(F.when(F.col("capped"), plan.most * F.col("s")).otherwise(0)).over(everything),
        "wr": F.col("wt") - F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0)).over(everything),
    })
    target = F.when(F.col("capped"), (plan.most * F.col("s")).cast("double")).otherwise(F.col("rest").cast("double") * F.col("w") / F.col("wr"))
    s = s.withColumn("target", target).withColumn("want", F.floor(F.col("target") + 0.5).cast("long"))
    before = by_name.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("edge", big(F.coalesce(F.sum("want").over(before), F.lit(0)))).withColumn("all", big(F.sum("want").over(everything)))
    scale = lambda c: F.expr(f"cast(case when `all` > 0 then ({c}) * {_SPAN} div `all` else 0 end as bigint)")
    return s.select("source", F.col("s").alias("source_size"), "target", "want", scale("edge").alias("low"), scale("edge + cast(want as decimal(38,0))").alias("high"))


def _ranked(df: DataFrame, groups: list[str], chunk: str, order: list[str | Column], amount: Column, out: str) -> DataFrame:
    """Exclusive prefix sum of ``amount`` within groups, in the order (chunk, order), in two levels."""
    within = W.partitionBy(*groups, chunk).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    above = W.partitionBy(*groups).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    totals = df.groupBy(*groups, chunk).agg(F.sum(amount).alias("__sum")).withColumn("__base", F.coalesce(F.sum("__sum").over(above), F.lit(0))).drop("__sum")
    names = {g: f"__k{i}" for i, g in enumerate([*groups, chunk])}
    totals = totals.withColumnsRenamed(names)
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in names.items()]
    own = df.withColumn("__own", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    joined = own.join(totals, same[0] if len(same) == 1 else [*same])
    return joined.withColumn(out, (F.col("__base") + F.col("__own")).cast("long")).drop("__base", "__own", *names.values())


def schedule(per_source: DataFrame, block: int, n_slots: int) -> DataFrame:
    """slot, source, rank, epoch, block_no, length of every slot that the mix uses."""
    cells, shift = 4096, 20
    wanted = (
        per_source.filter("want > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
        .withColumn("need", F.expr(f"(want div source_size) * blocks + cast(ceil((want % source_size) / {block}) as bigint)"))
    )
    ranges = (
        wanted.filter("high > low")
        .withColumn("cell", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))))
        .select("source", "low", "high", "source_size", "want", "blocks", "need", "cell")
    )
    spark = per_source.sparkSession
    points = spark.range(n_slots).select(F.col("id").alias("slot"), ((F.col("id") * _GOLDEN) % _SPAN).alias("x"))
    hit = points.withColumn("cell", F.shiftright("x", shift)).join(ranges, "cell").filter("x >= low AND x < high")
    hit = hit.withColumn("chunk", F.expr(f"slot div {max(1, n_slots // 1024)}"))
    ranked = _ranked(hit, ["source"], "chunk", ["slot"], F.lit(1), "rank").filter("rank < need")
    got = hit.groupBy(F.col("source").alias("got_source")).agg(F.count("*").alias("got"))
    short = wanted.join(got, F.col("source").eqNullSafe(F.col("got_source")), "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    before = W.orderBy(F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)  # one row a source
    short = short.withColumn("base", F.lit(n_slots) + F.coalesce(F.sum(F.expr("need - got")).over(before), F.lit(0)))
    more = short.withColumn("rank", F.explode(F.sequence("got", F.col("need") - 1))).withColumn("slot", F.expr("base + rank - got"))
    plain = ("slot", "source", "rank", "source_size", "want", "blocks")
    ranked = ranked.select(*plain).unionByName(more.select(*plain))
    at = ranked.withColumn("epoch", F.expr("rank div blocks")).withColumn("block_no", F.expr("rank % blocks"))
    left = F.expr(f"least({block}, source_size - block_no * {block}, want - epoch * source_size - block_no * {block})")
    return at.select("slot", "source", "rank", "epoch", "block_no", left.alias("length"), F.expr(f"least({block}, source_size - block_no * {block})").alias("full"))


def mix(docs: DataFrame, plan: MixPlan = MixPlan(), **columns: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken, the words that the mix takes."""
    sizes = cut(sized(docs, **columns), "mix-sizes")
    n_docs, total = sizes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, -(-total // plan.slots))
    n_slots = int(-(-total // block) * (1 + plan.slack)) + 64
    if n_slots >= 1 << 31:
        raise ValueError("at most 2**31 slots: the 32-bit points would repeat")
    per_source = cut(targets(sizes, plan).coalesce(1), "mix-sources")  # one row a source
    tidy_driver(docs.sparkSession)
    digits = max(1, (max(1, n_docs // 500).bit_length() + 3) // 4)
    rows = sizes.withColumn("key", F.md5(F.concat(F.lit(plan.seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")))
    rows = rows.withColumn("chunk", F.substring("key", 1, digits))
    placed = _ranked(rows, ["source"], "chunk", ["key", "doc_id", "size"], F.col("size"), "place")
    used = (
        schedule(per_source, block, n_slots)
        .groupBy(F.col("source").alias("used_source"), "block_no")
        .agg(F.sum(F.expr("if(length = full, 1, 0)")).alias("times"), F.sum(F.expr("if(length < full, length, 0)")).alias("part"))
    )
    pieces = placed.filter("size > 0").withColumn("b", F.explode(F.sequence(F.expr(f"place div {block}"), F.expr(f"(place + size - 1) div {block}"))))
    joined = pieces.join(used, F.col("source").eqNullSafe(F.col("used_source")) & (F.col("b") == F.col("block_no")))
    low = F.greatest(F.col("place"), F.col("b") * block)
    high = F.col("place") + F.col("size")
    amount = (F.least(high, (F.col("b") + 1) * block) - low) * F.col("times") + F.greatest(F.lit(0), F.least(high, F.col("b") * block + F.col("part")) - low)
    taken = joined.groupBy("doc_id", "source", "size", "place").agg(F.sum(amount).cast("long").alias("taken"))
    taken = taken.select("doc_id", "source", "size", "taken").unionByName(unused(placed, taken))
    info = per_source.select(F.col("source").alias("info_source"), "source_size", "target")
    return taken.join(info, F.col("source").eqNullSafe(F.col("info_source"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def unused(placed: DataFrame, taken: DataFrame) -> DataFrame:
    """Documents of which the mix takes nothing."""
    names = {c: f"__{c}" for c in ("doc_id", "source", "size", "place")}
    some = taken.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return placed.filter("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken")).unionByName(
        placed.filter("size > 0").join(some, same, "left_anti").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    )


def resample(docs: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The rows as often as the mix takes them, in whole documents (halves up); columns as they came.

    Rows are mixed, not ids, so rows that repeat an id, or have none, come as often as each is taken.
    Rows alike in all columns come as often as they are taken together.
    """
    key, times, copy = unused_names(docs, "key", "times", "copy")
    rows = docs.withColumn(key, row_key(docs))
    taken = mix(rows, plan, id_col=key).select(F.col("doc_id").alias(key), F.expr("cast(floor(taken / greatest(size, 1) + 0.5) as int)").alias(times))
    taken = cut(taken.groupBy(key).agg(F.sum(times).cast("int").alias(times), F.count("*").alias(copy)), "mix-times")
    tidy_driver(docs.sparkSession)
    if not taken.filter(F.col(copy) > 1).isEmpty():
        rows = rows.dropDuplicates()
    joined = rows.join(taken.filter(F.col(times) > 0).drop(copy).hint("merge"), key)  # one plan at every size
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def _oracle(plan: MixPlan = MixPlan()) -> str:
    weights = "[" + ", ".join(map(str, plan.weights)) + "]"
    m = plan.most
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
s1 AS (SELECT *, {weights}[(row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(plan.weights)} + 1]::BIGINT AS w FROM s0),
s2 AS (SELECT *, sum(s) OVER () AS t, sum(w) OVER () AS wt,
  coalesce(sum(s) OVER (ORDER BY s::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb,
  coalesce(sum(w) OVER (ORDER BY s::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM s1),
s3 AS (SELECT *, {m} * s * (wt - wb) < w * (t - {m} * sb) AS capped FROM s2),
s4 AS (SELECT *, t - sum(CASE WHEN capped THEN {m} * s ELSE 0 END) OVER () AS rest, wt - sum(CASE WHEN capped THEN w ELSE 0 END) OVER () AS wr FROM s3),
s5 AS (SELECT source, s, CASE WHEN capped THEN ({m} * s)::DOUBLE ELSE rest::DOUBLE * w / wr END AS target FROM s4),
s6 AS (SELECT *, floor(target + 0.5)::BIGINT AS want FROM s5),
s7 AS (SELECT *, coalesce(sum(want) OVER (ORDER BY source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS edge, sum(want) OVER () AS everything FROM s6),
k AS (SELECT greatest(1, -(-sum(size) // {plan.slots}))::BIGINT AS block, sum(size)::BIGINT AS total FROM d),
k2 AS (SELECT block, floor(ceil(total / block) * (1 + {plan.slack}))::BIGINT + 64 AS n FROM k),
s8 AS (SELECT source, s, target, want, block, (edge * {_SPAN} // everything)::BIGINT AS low, ((edge + want) * {_SPAN} // everything)::BIGINT AS high, ceil(s / block)::BIGINT AS blocks FROM s7, k2 WHERE everything > 0),
p AS (SELECT i * {_GOLDEN} % {_SPAN} AS x FROM k2, range(n) AS r(i)),
c AS (SELECT source, count(*) AS got FROM s8 JOIN p ON x >= low AND x < high GROUP BY source),
s9 AS (SELECT s8.*, CASE WHEN want = 0 THEN 0 WHEN got >= (want // s) * blocks + ceil((want % s) / block) THEN want ELSE (got // blocks) * s + least((got % blocks) * block, s) END AS flow
       FROM s8 LEFT JOIN c ON s8.source IS NOT DISTINCT FROM c.source),
o AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5('{plan.seed}:' || coalesce(doc_id::VARCHAR, 'null')), doc_id, size, rid) - size AS place FROM d)
SELECT doc_id, size, s6.s AS source_size, s6.target, CASE WHEN size = 0 THEN 0 ELSE (flow // s9.s) * size + greatest(0, least(place + size, flow % s9.s) - place) END::BIGINT AS taken
FROM o JOIN s6 ON o.source IS NOT DISTINCT FROM s6.source LEFT JOIN s9 ON o.source IS NOT DISTINCT FROM s9.source
"""


QUERIES = {"op6_mix": op6_mix}
ORACLES = {"op6_mix": _oracle()}
