"""PII by patterns and information-theoretic sanitisation; DataFrame functions only.

Pattern spans (email, ip, card, phone) are the protected entities.  A term (run of letters) in a text
with an entity reveals it as far as the corpus ties the two together: with document counts, ``PMI(t; e) / IC(e)`` is 1 when the
term only occurs with the entity and falls as it occurs elsewhere,

    disclosure(t, e) = 1 - log2(n_t / n_te) / log2(N / n_e)

where N counts documents (rows), n_e those with the entity, n_t those with the term and n_te those
with both, wherever they stand in the whole text; a term that only stands inside an email is part of
that entity.  Terms over the threshold become spans of kind ``term`` at each of their places in the
documents of the entity: removed where the disclosure is (nearly) full, otherwise
generalised to a placeholder.

Offsets are code points.  They come from running sums over the lengths of matches and of the pieces
between them, in blocks, so a text is scanned twice per kind at most, and time is linear in the text.

Defined results: null text is empty; ids may be null or repeat (rows with the same id and text get
the same spans); terms are judged by documents over the whole table; an entity in every document
discloses nothing (IC 0); an empty table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.llm.common import cut, documents, let

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns in a form that finds the same matches without quadratic rescans: a match
#: of ``email`` or ``ip`` begins where its run of characters begins (or the last match ended), and
#: runs of fewer than 13 digits are no cards from any of their digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SPANS = "array<struct<value:string,start:int,end:int>>"
_TERM_SPANS = "array<struct<start:int,end:int,disclosure:double>>"
_TERM = r"\p{L}++"
#: Entries, or characters, that are handled as one where work would otherwise grow with their square.
_BLOCK = 256
_SIGNS = {"email": "@", "ip": ".", "phone": "+"}


@dataclass(frozen=True)
class Sanitiser:
    """``threshold``: disclosure from which a term is generalised; ``full``: from which it is removed;
    ``contexts``: least number of different texts that hold term and entity."""

    threshold: float = 0.8
    full: float = 0.999
    contexts: int = 2


def _running(values: Column, join: Callable[[Column, Column], Column] = Column.__add__) -> Column:
    """For each entry what the entries before it add up to (from 0), block by block."""
    start = lambda: F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    scan = lambda xs, of: F.aggregate(xs, start(), lambda acc, x: F.struct(join(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values)), F.lit(_BLOCK))
    blocks = F.transform(starts, lambda at: scan(F.slice(values, at, F.lit(_BLOCK)), lambda x: x))

    def put(parts: Column) -> Column:
        bases = scan(parts, lambda p: p["at"])["out"]
        return F.flatten(F.zip_with(parts, bases, lambda p, base: F.transform(p["out"], lambda v: join(base, v))))

    return let(blocks, put)


def _placed(text: Column, pattern: str) -> Column:
    """Array of (value, start, end) of all leftmost, non-overlapping matches."""

    def walk(matches: Column, gaps: Column) -> Column:
        own = F.transform(matches, lambda m, i: F.struct(m.alias("value"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size")))

        def put(parts: Column, before: Column) -> Column:
            return F.zip_with(parts, before, lambda p, at: F.struct(p["value"].alias("value"), (at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end")))

        return let(own, lambda parts: put(parts, _running(F.transform(parts, lambda p: p["gap"] + p["size"]))))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(_SPANS)).otherwise(let(F.split(text, pattern, -1), lambda g: walk(m, g))))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        digit = lambda i: F.ascii(F.substring(d, i, F.lit(1))) - 48
        doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))

    return let(F.reverse(_digits(value)), total) % 10 == 0


_VALID = {
    "email": None,
    "ip": lambda m: F.forall(F.split(m["value"], r"\."), lambda p: p.rlike("^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
    "card": lambda m: (F.length(_digits(m["value"])) <= 19) & _luhn(m["value"]),
    "phone": lambda m: F.length(_digits(m["value"])).between(9, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    found = _placed(text, PATTERNS[kind])
    if kind in _SIGNS:  # most texts lack the sign that every match has
        found = F.when(F.instr(text, _SIGNS[kind]) > 0, found).otherwise(F.array().cast(_SPANS))
    return F.filter(found, _VALID[kind]) if _VALID[kind] else found


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark (hash of id and text), one array of spans a kind, the different entities, and the
    text of rows that have any."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("mark"))
    rows = rows.select("doc_id", "mark", "text", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])

    def named(kind: str, s: Column) -> Column:
        return F.concat(F.lit(kind + ":"), F.lower(s["value"]) if kind == "email" else _digits(s["value"]) if kind != "ip" else s["value"])

    per_kind = lambda k: F.transform(F.col(k), lambda s: named(k, s))
    rows = rows.withColumn("entities", F.array_distinct(F.concat(*map(per_kind, KINDS))))
    return rows.withColumn("text", F.when(F.size("entities") > 0, F.col("text")))


def _terms(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_TERM), F.lit(0)), F.lower))


def disclosures(docs: DataFrame, found: DataFrame, setup: Sanitiser = Sanitiser(), text_col: str = "text") -> DataFrame:
    """entity, term, disclosure of the pairs over the threshold, by counts over all documents."""
    held = found.filter(F.size("entities") > 0).withColumn("content", F.xxhash64("text"))
    n_e = held.select("content", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"), F.countDistinct("content").alias("contents"))
    n_e = n_e.filter(F.col("contents") >= setup.contexts).drop("contents")  # the others have no pair in so many texts
    outside = F.when(F.size("email") > 0, F.regexp_replace("text", PATTERNS["email"], " ")).otherwise(F.col("text"))
    own = held.select("content", outside.alias("text"), F.explode("entities").alias("entity")).join(n_e.select("entity"), "entity", "left_semi")
    pairs = own.select("entity", "content", F.explode(_terms(F.col("text"))).alias("term")).groupBy("entity", "term", "content").agg(F.count("*").alias("rows"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("rows").alias("n_te"), F.count("*").alias("contents")).filter(F.col("contents") >= setup.contexts)
    n_t = docs.select(F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.count("*").alias("n"))
    all_ = pairs.join(n_e, "entity").join(n_t, "term").crossJoin(F.broadcast(total))  # one row
    content = F.log2(F.col("n") / F.col("n_e"))
    value = F.when(content > 0, 1 - F.greatest(F.lit(0.0), F.log2(F.col("n_t") / F.col("n_te"))) / content)
    return all_.select("entity", "term", value.alias("disclosure")).filter(F.col("disclosure") >= setup.threshold)


def _places(text: Column, known: Column) -> Column:
    """Array of (start, end, disclosure) of every place of the known terms, a map to disclosures."""
    valued = F.transform(_placed(text, _TERM), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.try_element_at(known, F.lower(w["value"])).alias("disclosure")))
    return F.filter(valued, lambda w: w["disclosure"].isNotNull())


def private_spans(docs: DataFrame, setup: Sanitiser = Sanitiser(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mark, the arrays of pattern spans and ``term``, the spans of revealing terms.

    A term inside or across a pattern span is part of it already and gives no span of its own.
    """
    found = cut(entities(docs, id_col, text_col), "pii-entities")
    flagged = cut(disclosures(docs, found, setup, text_col), "pii-terms")
    holders = found.select("doc_id", "mark", F.explode("entities").alias("entity")).distinct()
    known = holders.join(flagged, "entity").groupBy("doc_id", "mark", "term").agg(F.max("disclosure").alias("disclosure"))
    known = known.groupBy("doc_id", "mark").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("known"))
    named = known.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "known")
    joined = found.join(named, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    none = F.array().cast(_TERM_SPANS)
    joined = joined.withColumn("term", F.when(F.col("known").isNull(), none).otherwise(_places(F.col("text"), F.col("known"))))
    base = F.concat(*KINDS)
    free = F.filter("term", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select("doc_id", "mark", *KINDS, free.alias("term"))


def sanitise(docs: DataFrame, setup: Sanitiser = Sanitiser(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``clean``: entities become ``[KIND]``, revealing terms ``[TERM]`` or nothing."""
    found = private_spans(docs, setup, id_col, text_col)
    named = lambda k: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("put")))
    marks = F.concat(
        *map(named, KINDS),
        F.transform(F.col("term"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["disclosure"] >= setup.full, F.lit("")).otherwise(F.lit("[TERM]")).alias("put"))),
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("__mark"))
    own = found.select("doc_id", "mark", F.sort_array(marks).alias("marks")).dropDuplicates(["doc_id", "mark"])
    rows = rows.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")

    # spans of two kinds may overlap; the first one stands, and all of both goes
    given = F.coalesce("marks", F.array().cast("array<struct<start:int,end:int,put:string>>"))
    placed = F.zip_with(given, _running(F.transform(given, lambda m: m["end"]), F.greatest), lambda m, at: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["put"].alias("put"), at.alias("at")))

    def text_at(blocks: Column, at: Column, n: Column) -> Column:
        """n characters from ``at`` on, out of the blocks that hold them."""
        first = F.floor(at / _BLOCK).cast("int")
        held = F.array_join(F.slice(blocks, first + 1, F.floor((at + n) / _BLOCK).cast("int") - first + 1), "")
        return F.substring(held, at % _BLOCK + 1, n)

    def put_together(blocks: Column, marks: Column) -> Column:
        pieces = F.transform(marks, lambda m: F.when(m["start"] < m["at"], F.lit("")).otherwise(F.concat(text_at(blocks, m["at"], m["start"] - m["at"]), m["put"])))
        last = F.coalesce(F.array_max(F.transform(marks, lambda m: m["end"])), F.lit(0))
        return F.concat(F.array_join(pieces, ""), text_at(blocks, last, F.greatest(F.length("text") - last, F.lit(0))))

    blocks = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    clean = let(blocks, lambda bs: let(placed, lambda ms: put_together(bs, ms)))
    return rows.select(F.col("__id").alias("doc_id"), F.when(F.size(given) == 0, F.col("text")).otherwise(clean).alias("clean"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans(documents(spark, sf_dir))
    written = lambda k: F.transform(F.col(k), lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string")))
    base = F.concat(*map(written, KINDS))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(F.concat_ws(",", base).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, written("term"))).alias("spans"), F.size("term").cast("long").alias("n_term"),
    )


def _oracle(setup: Sanitiser = Sanitiser()) -> str:
    """The same in SQL, with the contract's own patterns."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = "list_sum(list_transform(range(1, len(dig) + 1), lambda i: CASE WHEN i % 2 = 1 THEN dig[-i]::INTEGER WHEN dig[-i]::INTEGER > 4 THEN 2 * dig[-i]::INTEGER - 9 ELSE 2 * dig[-i]::INTEGER END)) % 10 = 0"
    valid = {
        "email": "true", "phone": "len(dig) BETWEEN 9 AND 15", "card": f"len(dig) BETWEEN 13 AND 19 AND {luhn}",
        "ip": "len(list_filter(string_split(v, '.'), lambda p: NOT regexp_matches(p, '^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$'))) = 0",
    }
    name = {"email": "lower(v)", "ip": "v", "card": "dig", "phone": "dig"}
    placed = lambda what, p: f"SELECT rid, unnest(regexp_extract_all({what}, '{p}')) AS v, unnest(string_split_regex({what}, '{p}')) AS g, generate_subscripts(string_split_regex({what}, '{p}'), 1) AS k FROM d"
    spans = lambda inner: f"SELECT rid, v, s - length(v) AS start, s AS stop FROM (SELECT *, sum(length(g) + coalesce(length(v), 0)) OVER (PARTITION BY rid ORDER BY k) AS s FROM ({inner})) WHERE v IS NOT NULL"
    kinds = ",\n".join(f"{k}_ AS (SELECT rid, {n} AS o, '{k}' AS kind, start::INTEGER AS start, stop::INTEGER AS stop, '{k}:' || {name[k]} AS entity FROM (SELECT *, {digits} AS dig FROM ({spans(placed('t', p))})) WHERE {valid[k]})" for n, (k, p) in enumerate(patterns.items()))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{kinds},
b AS (SELECT * FROM email_ UNION ALL SELECT * FROM ip_ UNION ALL SELECT * FROM card_ UNION ALL SELECT * FROM phone_),
he AS (SELECT DISTINCT rid, entity FROM b),
ne AS (SELECT entity, count(*) AS n_e FROM he JOIN d USING (rid) GROUP BY entity HAVING count(DISTINCT t) >= {setup.contexts}),
ot AS (SELECT DISTINCT rid, lower(unnest(regexp_extract_all(CASE WHEN rid IN (SELECT rid FROM email_) THEN regexp_replace(t, '{patterns["email"]}', ' ', 'g') ELSE t END, '\p{{L}}+'))) AS term FROM d WHERE rid IN (SELECT rid FROM he)),
te AS (SELECT entity, term, count(*) AS n_te FROM he JOIN ne USING (entity) JOIN ot USING (rid) JOIN d USING (rid) GROUP BY entity, term HAVING count(DISTINCT t) >= {setup.contexts}),
tt AS (SELECT DISTINCT rid, lower(unnest(regexp_extract_all(t, '\p{{L}}+'))) AS term FROM d),
nt AS (SELECT term, count(*) AS n_t FROM tt WHERE term IN (SELECT term FROM te) GROUP BY term),
fl AS (SELECT entity, term, ln((SELECT count(*) FROM d) / n_e) / ln(2) AS content, ln(n_t / n_te) / ln(2) AS lost FROM te JOIN ne USING (entity) JOIN nt USING (term)),
kn AS (SELECT DISTINCT rid, term FROM he JOIN fl USING (entity) WHERE content > 0 AND 1 - greatest(0.0, lost) / content >= {setup.threshold}),
w AS ({spans(placed('t', r"\p{L}+"))}),
ts AS (SELECT w.rid, w.start::INTEGER AS start, w.stop::INTEGER AS stop FROM w JOIN kn ON w.rid = kn.rid AND lower(w.v) = kn.term
       WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = w.rid AND b.start < w.stop AND w.start < b.stop)),
x AS (SELECT rid, o, kind, start, stop FROM b UNION ALL SELECT rid, 4, 'term', start, stop FROM ts),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in (*KINDS, "term"))},
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) FILTER (o < 4) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans FROM x GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*KINDS, "term"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


QUERIES = {"op9_pii": op9_pii}
ORACLES = {"op9_pii": _oracle()}
