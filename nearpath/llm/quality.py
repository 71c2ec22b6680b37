"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Each rule names a metric, a direction and a bound.  ``score_quality`` derives the metrics from
the text by built-in functions and turns the whole table into one conjunction; the names of the
rules a document breaks are returned as an array.

Defined results: a null or empty text has no words (all metrics 0) and fails the base rule;
ties, repeated rows and very long texts need no special case, since every row is judged alone;
an empty table gives no rows; columns other than the id and text are not read.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearpath.llm.common import SPACE_CHARS, SPACES, documents, let, words_of

#: Frequent function words of the four languages that are judged.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are", "or", "his", "from", "at", "which",
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "pas", "sur", "au", "avec",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "una", "su", "para", "al", "lo", "como", "más", "o",
)
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document breaks the rule when its metric is below ``least`` or above ``most``; without bounds, never."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: Ratios are per word unless named otherwise.
DEFAULT_RULES = (
    Rule("too_long", "n_words", most=1_000_000),
    Rule("mean_word_length", "mean_word_chars", least=2.0, most=14.0),
    Rule("symbols", "symbol_ratio", most=0.3),
    Rule("stop_words", "stop_ratio", least=0.01),
    Rule("repeated_lines", "dup_line_ratio", most=0.3),
    Rule("short_lines", "words_per_line", least=1.5),
)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text."""

    def covered(ranked: Column) -> Column:
        last = F.size(ranked) - 1

        def same(i: Column, j: Column) -> Column:
            return F.get(ranked, i)["gram"] == F.get(ranked, j)["gram"]

        places = F.sort_array(
            F.transform(
                F.filter(F.sequence(F.lit(0), last), lambda i: F.coalesce((i > 0) & same(i, i - 1), F.lit(False)) | F.coalesce((i < last) & same(i, i + 1), F.lit(False))),
                lambda i: F.get(ranked, i)["at"],
            )
        )
        return let(
            places,
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda here, following: F.least(F.lit(3), F.coalesce(following - here, F.lit(3)))),
                F.lit(0),
                lambda a, b: a + b,
            ),
        )

    def grams(w: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("gram"), i.alias("at")),
            )
        )

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(grams(words), covered)).cast("long")


def _metrics(text: Column) -> Column:
    def build(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
        return let(
            lines,
            lambda ls: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
                (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
                (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(words).alias("n_repeat_words"),
                F.size(ls).cast("long").alias("n_lines"),
                F.size(F.filter(words, lambda w: F.translate(F.lower(w), ".,;:!?", "").isin(*sorted(set(STOP_WORDS))))).cast("long").alias("n_stop_words"),
            ),
        )

    return let(words_of(text), build)


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


_DERIVED = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "words_per_line": ("n_words", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
}


def compile_rules(rules: tuple[Rule, ...]) -> dict[str, Column]:
    """Rule name -> boolean column that is true where the rule is broken."""
    out = {}
    for rule in rules:
        value = _ratio(*_DERIVED[rule.metric]) if rule.metric in _DERIVED else F.col(rule.metric)
        tests = [value < F.lit(rule.least)] * (rule.least is not None) + [value > F.lit(rule.most)] * (rule.most is not None)
        out[rule.name] = functools.reduce(Column.__or__, tests, F.lit(False))
    return out


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the metrics, ``base_failed``, ``broken`` (names of broken rules) and ``kept``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    m = docs.select(F.col(id_col), _metrics(text).alias("m")).select(id_col, "m.*")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in compile_rules(rules).items()]), lambda x: x.isNotNull())
    return m.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words",
        base.alias("base_failed"), broken.alias("broken"), (~base & (F.size(broken) == 0)).alias("kept"),
    )


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "broken").alias("broken"))


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    tests = []
    for r in DEFAULT_RULES:
        value = f"(CASE WHEN {_DERIVED[r.metric][1]} > 0 THEN {_DERIVED[r.metric][0]} / {_DERIVED[r.metric][1]} ELSE 0.0 END)" if r.metric in _DERIVED else r.metric
        test = " OR ".join([f"{value} < {r.least}"] * (r.least is not None) + [f"{value} > {r.most}"] * (r.most is not None))
        tests.append(f"CASE WHEN {test} THEN '{r.name}' END")
    spaces = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{SPACES}'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: translate(x, {spaces}, '') <> '') AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS gram FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
p AS (SELECT rid, least(3, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 3)) AS k FROM c WHERE n > 1),
r AS (SELECT rid, sum(k) AS n_repeat_words FROM p GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, length(translate(t, {spaces}, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda x: translate(lower(x), '.,;:!?', '') IN ({stop})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {", ".join(tests)}) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM b
"""


QUERIES = {"op1_quality": op1_quality}
ORACLES = {"op1_quality": _oracle()}
